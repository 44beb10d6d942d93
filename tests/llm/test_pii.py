import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import pii

SIMPLE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def simple(text):
    keep = {
        "email": lambda s: True,
        "ip": lambda s: all(int(p) <= 255 for p in s.split(".")),
        "card": lambda s: 16 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and sum(
            sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0,
        "phone": lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15,
    }
    return [(k, m.start(), m.end()) for k, p in SIMPLE.items() for m in p.finditer(text) if keep[k](m.group())]


@settings(max_examples=1500, deadline=None)
@given(st.text("a%.@-+ 1230()\né", max_size=40))
def test_base_spans_as_listed(text):
    assert [s[:3] for s in pii.personal_spans(text) if s[0] in pii.BASE] == simple(text)


def test_checksums_and_context():
    assert [s[0] for s in pii.personal_spans("IBAN DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    assert pii.personal_spans("DE88 3704 0044 0532 0130 00") == []
    assert [s[0] for s in pii.personal_spans("card 4111 1111 1111 1111")] == ["card"]
    assert pii.personal_spans("4111 1111 1111 1112") == []
    assert [s[0] for s in pii.personal_spans("my SSN: 078-05-1120")] == ["national"]
    assert pii.personal_spans("order 078-05-1120") == []
    near, far = pii.personal_spans("call +49 30 1234567"), pii.personal_spans("+49 30 1234567")
    assert near[0][3] > far[0][3]


def test_long_texts_are_linear():
    for piece in ("a", "1", "1.", "a@", "+1", "@", "1 "):
        pii.personal_spans(piece * 200_000)


def test_rows(spark):
    text = "é🙂 a@b.c 4111111111111111 x 1.2.3.4 +1 (255) 555-8013"
    rows = [(1, text), (1, text), (None, text), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS score")
    got = sorted((tuple(r) for r in pii.digest(pii.find_personal_data(df)).collect()), key=str)
    assert len(got) == 5 and [r[1:5] for r in got].count((1, 1, 1, 1)) == 3
    assert {r[6] for r in got} == {"", "email:3:8,ip:28:35,card:9:25,phone:36:53"}
    assert pii.digest(pii.find_personal_data(df.limit(0))).collect() == []


def test_iban_beside_other_capitals():
    def found(text):
        return [text[s[1]:s[2]] for s in pii.personal_spans(text) if s[0] == "iban"]

    es, de, no = "ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    assert found(f"IBAN {es} BIC CAIXESBB") == [es]
    assert found(f"{es} 12, {es} EUR 1500 and {es} PAID BY BANK") == [es] * 3
    assert found(f"AB12 {de} BIC; {no} KONTO {es.replace(' ', '')} OK") == [de, no, es.replace(" ", "")]
    assert found(f"x{es} BIC, {es}9, {es}b") == []
