import hashlib

from tidewatch.llm import chat

HARD = [r"\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y", "\\", "\\s\\\\h", "", None, "a\r\n#<:\\c", "🙂é" * 3, "</turn>\n", "b" * 70_000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        out.append((conv, len(own), sha("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)), len(loss), sha(loss)))
    return sorted(out, key=str)


def test_round_trip(spark):
    rows = [(c, k, ["user", "assistant", "system", None, "a:b\\: #"][(k + c) % 5], HARD[(k * 7 + c) % len(HARD)]) for c in range(12) for k in range(c)]
    rows += [(50, 3000 - k, "assistant" if k % 2 else "user", f"t{k}") for k in range(2500)] + [(None, 0, "user", "x"), (60, None, "user", "n"), (60, 0, "assistant", "m")]
    rows += [(70, 0, role, text) for role in ("user b", "user", "user:", None) for text in ("$", "#", ":", "<", None)]       # ties by role, then text
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS piece", "2 AS start").repartition(5)
    turns = chat.formatted_turns(df)
    got = chat.digest(turns, chat.examples(turns))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(rows)
    assert chat.digest(chat.formatted_turns(df.limit(0)), chat.examples(chat.formatted_turns(df.limit(0)))).collect() == []


def test_examples_hold_their_prefix(spark):
    rows = [(1, 0, "user", "a#"), (1, 1, "assistant", "b:"), (1, 2, "user", "c"), (1, 3, "assistant", "d<"), (1, 4, "user", "e"), (2, 0, "user", "z")]
    turns = chat.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = [tuple(r) for r in chat.example_texts(turns, chat.examples(turns)).orderBy("conv_id", "example").collect()]
    first = "### user: a\\h</turn>\n### assistant: "
    assert got == [(1, 1, first, "b:"), (1, 3, first + "b\\c</turn>\n### user: c</turn>\n### assistant: ", "d<")]


def test_repeated_rows(spark):
    rows = [(1, 0, "assistant", "a")] * 3
    turns = chat.formatted_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert tuple(chat.digest(turns, chat.examples(turns)).first())[:4] == (1, 3, sha("assistant\na\n" * 3), 3)
