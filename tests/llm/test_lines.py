import random


from tidewatch.llm import lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def brute(rows, threshold, min_chars, short=1):
    first, copies = {}, {}
    for doc, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if line:
                place = (-1 if doc is None else doc, k)
                first[line] = min(first.get(line, place), place)
                copies[line] = copies.get(line, 0) + 1
    known = sorted(first)
    def linked(x, y):
        edits = threshold if min(len(x), len(y)) >= min_chars else short
        return x != y and min(len(x), len(y)) > edits and abs(len(x) - len(y)) <= edits and distance(x, y) <= edits
    near = {x: [y for y in known if linked(x, y)] for x in known}
    out = []
    for line in known:
        seen, todo = {line}, [line]
        while todo:
            for y in near[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        head = min(first[y] for y in seen)
        out.append((*first[line], copies[line], len(near[line]), *head))
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS line", "2 AS id").repartition(4)
    return sorted(tuple(-1 if x is None else x for x in r) for r in lines.near_lines(df, **more).collect())


def test_all_pairs(spark):
    rng = random.Random(6)
    rows = []
    for k in range(40):
        base = "".join(rng.choice("abé 🙂xyz") for _ in range(rng.randrange(14, 40)))
        text = []
        for _ in range(rng.randrange(1, 9)):
            line = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(line))
                line[at:at + rng.randrange(2)] = rng.choice(["", "q", "r"])
            text.append("".join(line))
        rows.append((k, "\n".join(text)))
    rows += [(3, rows[3][1]), (None, rows[4][1]), (90, None), (91, ""), (92, "\n\n"), (93, "short\nshorx"), (94, "x" * 60_000 + "\n" + "x" * 60_001)]
    for threshold in (1, 2):
        assert run(spark, rows, threshold=threshold) == brute(rows[:-1], threshold, lines.MIN_CHARS) + [(94, 0, 1, 1, 94, 0), (94, 1, 1, 1, 94, 0)]
    assert run(spark, []) == []


def test_short_lines(spark):
    rng = random.Random(8)
    rows = [(k, "\n".join("".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(4))) for k in range(15)]
    rows += [(50, "Subscribe now\nRead more here"), (51, "Subscribe now!\nread more here"), (52, "fifteen letters\nfifteen letters!\nfifteen letters!!"),
             (53, "sixteen letters!\nsixteen letters"), (54, "a\nb\nab\nac")]
    assert run(spark, rows) == brute(rows, 2, 16)
    assert run(spark, rows, threshold=3, min_chars=4, short=2) == brute(rows, 3, 4, 2)
    assert run(spark, rows, short=0) == brute(rows, 2, 16, 0)


def test_band(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randrange(9))), "".join(rng.choice("ab") for _ in range(rng.randrange(9)))) for _ in range(600)]
    df = spark.createDataFrame(pairs, "l string, r string")
    for threshold in (1, 2, 3):
        for r in df.select("l", "r", lines.within_edits("l", "r", threshold).alias("near")).collect():
            assert r.near == (distance(r.l, r.r) <= threshold), (r, threshold)


def test_every_place_has_its_class(spark):
    common, near = "a line that many hold", "a line that many hold!"
    rows = [(5, f"{common}\nonly here, in five"), (7, common), (9, f"\n{near}\n{common}"), (9, f"\n{near}\n{common}"), (None, "no id at all"), (8, None)]
    got = sorted(tuple(-1 if x is None else x for x in r) for r in lines.line_places(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 0, 1, 0, -1, 0), (5, 0, 4, 1, 5, 0), (5, 1, 1, 0, 5, 1), (7, 0, 4, 1, 5, 0),
                   (9, 1, 2, 1, 5, 0), (9, 1, 2, 1, 5, 0), (9, 2, 4, 1, 5, 0), (9, 2, 4, 1, 5, 0)]


def test_query_has_a_row_for_every_line(spark, tmp_path):
    from tidewatch.llm import queries

    rows = [(k, "a line that many hold\nanother that many hold") for k in range(20)] + [(20, "one of its own")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_near_lines(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.line_no) for r in got} == {(k, n) for k in range(20) for n in (0, 1)} | {(20, 0)} and len(got) == 41
    assert {(r.class_doc_id, r.class_line_no) for r in got if r.doc_id < 20} == {(0, 0), (0, 1)}
