import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from quarry.llm import pii, queries


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    """Base spans by the contract's own patterns."""
    text = text or ""
    out = []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for rank, (kind, pat, ok) in enumerate(
        (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
        )
    ):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pat, text) if ok(m[0])]
    return ",".join(x[2] for x in sorted(out))


TEXTS = [
    None, "", "a@b.c", "x@y", "a@b.c.@d.e", "a@b.com_foo@c.com", "foo@bar@baz.com", "..@a.b", "é@a.b.c é x_y%z@q-r.s 😀 t@u.v", "@@a@b.c@", "a@b.c-@d.e",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.1.1.0000255 000.0.0.0 1.2.3 9.9.9.9.", "11.2.3.999.4.4.4.4", "4111 1111 1111 1111, 4111-1111-1111-1112 4111  1111", "0000 0000 0000", "5 4111111111111111",
    "12345678901234567890123 4111111111111111-", "+1 (988) 555-2485 +12345678 ++123456789+ +1-----2 +1234567890123456", "+1.2.3.4.5.6.7.8.9 tel +44 20 7946 0958)", "٣٤٥ +٣", "\n+1\n23456789", "a" * 30000,
    "1" * 30000, "1." * 15000, "a." * 15000 + "@b", "1 " * 20000, "@a.b " * 3000, ("x@y.z 1.2.3.4 4111111111111111 " * 300),
]


def test_base_spans_equal_the_contract(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for r in pii.find_spans(df).collect():
        got = ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.rank < 4)
        assert got == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id][:60]
        assert all(s.value == TEXTS[r.doc_id][s.start : s.end] for s in r.spans)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, sf).collect():
        assert r.base_sha256 == hashlib.sha256(brute(docs[r.doc_id]).encode()).hexdigest()


@pytest.mark.parametrize(
    "text, found",
    [
        ("IBAN DE89 3704 0044 0532 0130 00 ok", ["iban"]),
        ("DE89370400440532013000", ["iban"]),
        ("DE88370400440532013000", []),
        ("my ssn: 123-45-6789", ["ssn"]),
        ("part 123-45-6789", []),
        ("ssn 000-45-6789 ssn 666-12-1234", []),
    ],
)
def test_added_kinds(spark, text, found):
    r = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.kind for s in r.spans if s.kind in ("iban", "ssn")] == found


def test_context_raises_scores(spark):
    df = spark.createDataFrame([(1, "server 10.0.0.1"), (2, "xyz 10.0.0.1")], "doc_id long, text string")
    a, b = (r.spans[0].score for r in pii.find_spans(df).orderBy("doc_id").collect())
    assert a > b


def test_mask_and_odd_rows(spark):
    rows = [(1, "mail é a@b.c now +1 (456) 555-2186.", 0, "q"), (2, None, 0, "q"), (3, "plain", 5, "q"), (3, "plain", 5, "q"), (4, "+1.2.3.4.5.6.7.8.9", 0, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = sorted(((r.doc_id, r.text, r.n_chars, r.spans) for r in pii.mask(df).collect()), key=str)
    assert got == [(1, "mail é [EMAIL] now [PHONE].", 27, "q"), (2, None, None, "q"), (3, "plain", 5, "q"), (3, "plain", 5, "q"), (4, "[PHONE]", 7, "q")]
    assert pii.mask(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, found",
    [
        ("123-45-6789 is the SSN", ["ssn"]),
        ("123-45-6789" + " " * 45 + "ssn", []),
        ("s 123-45-6789 sn", []),
        ("SA03 8000 0000 6080 1016 7519", ["iban"]),
        ("AE070331234567890123456", ["iban"]),
        ("BR1800360305000010009795493C1", ["iban"]),
        ("RS35260005601001611379 UA213223130000026007233566001", ["iban", "iban"]),
        ("IL620108000000099999999", ["iban"]),
        ("IL620108000000099999998", []),
    ],
)
def test_context_after_a_span_and_all_countries(spark, text, found):
    r = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [s.kind for s in r.spans if s.kind in ("iban", "ssn")] == found


def test_many_spans_and_long_texts(spark):
    """A hundred thousand spans in one text, in seconds; pieces are cut at block edges too."""
    text = "é " + "x@y.z +1 (456) 555-2186 ñ " * 50_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    t = time.time()
    r = pii.find_spans(df).select(F.size("spans").alias("n"), F.element_at("spans", -1).alias("last")).first()
    assert r.n == 100_000 and text[r.last.start : r.last.end] == "+1 (456) 555-2186" and time.time() - t < 30
    assert pii.mask(df).first().text == "é " + "[EMAIL] [PHONE] ñ " * 50_000 and time.time() - t < 60


def test_masking_equals_plain_python(spark):
    texts = ["a@b.c" * 3, "x a@1.2.3.4 y", "é" * 1020 + " a@b.c " + "ñ" * 1030 + "+1 988 555 2485", "4111 1111 1111 1111" * 2, "z" * 2047 + "1.2.3.4" + "z" * 5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_spans(df).collect()}
    for r in pii.mask(df).collect():
        t, at, out = texts[r.doc_id], 0, ""
        for s in spans[r.doc_id]:
            if s.start >= at:
                out += t[at : s.start] + f"[{s.kind.upper()}]"
            at = max(at, s.end)
        assert r.text == out + t[at:]
