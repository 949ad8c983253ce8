import hashlib
import re

from fixtures import documents, frame
from pyspark.sql import functions as F

from rayloom.llm import pii, queries

TEXTS = [
    "mail a.b+c@mail7.example.com, or x@y.z.@q.w and no@dot, .a@b.c", "😀 é 10.0.0.255 and 256.1.1.1 1.2.3.4.5.6.7.8 000255.0.0.1 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111",
    "call +41 (0)44 123 45 67 or +1 555 or +1234567890123456 (x) +12.34", "4111111111111111 5500005555555559 one after another", "phone +1 (017) 555-7713 4845168114407329 x",
    "order 4111111111111111 5500005555555559 there", "IBAN GB82 WEST 1234 5698 7654 32 AND more; DE89370400440532013000. XGB82WEST12345698765432", "GB82 WEST 1234 5698 7654 33",
    "ssn 123-45-6789, part 123-45-6789", "tel: (212) 555-0123 and 212-555-0199 later", "", None, "+" * 50 + "1" * 60, "a" * 3000 + "@", "1.2.3.4@x.y 9", "version 1.2.3.4 test a@b.c example",
]


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    """The contract's spans, plainly."""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    )
    return [f"{k}:{m.start()}:{m.end()}" for k, p, fits in kinds for m in re.finditer(p, text or "") if fits(m[0])]


def rows():
    return [(i, t, "en", "a", 0) for i, t in enumerate(TEXTS)] + [(None, TEXTS[2], None, None, None), (0, TEXTS[0], "en", "a", 0)]


def test_base_against_plain_python(spark):
    docs = rows() + documents()
    got = pii.scan_pii(frame(spark, docs, clashes=True)).select("doc_id", pii.listed(F.col("found"), pii.BASE).alias("b"), pii.listed(F.col("found")).alias("s")).collect()
    assert sorted((str(r.doc_id), r.b) for r in got) == sorted((str(d[0]), ",".join(base(d[1]))) for d in docs)
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in got)


def test_added_spans_and_scores(spark):
    got = {r.doc_id: r for r in pii.scan_pii(frame(spark, rows()[: len(TEXTS)])).select("doc_id", pii.listed(F.col("found")).alias("s"), pii.scores(F.col("found")).alias("p")).collect()}
    cut = lambda i: [(k, TEXTS[i][int(a) : int(b)]) for k, a, b in (x.split(":") for x in got[i].s.split(",")) if k not in pii.BASE]
    assert cut(4) == [("card_part", "4111111111111111"), ("card_part", "5500005555555559")]
    assert cut(5) == [("card_part", "4845168114407329"), ("phone_part", "+1 (017) 555-7713")] or cut(5) == [("phone_part", "+1 (017) 555-7713")]
    assert got[6].s == ""  # the word before speaks against cards
    assert cut(7) == [("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000")]
    assert got[8].s == ""
    assert cut(9) == [("identity", "123-45-6789")] and got[9].s.startswith("identity:4:")
    assert cut(10) == [("local_phone", "(212) 555-0123")]
    assert got[16].p == "50,30"  # base spans stay, but words nearby speak against them


def test_masks(spark):
    docs = rows() + [(50, "é" * 5000 + " a@b.cd " + "x" * 5000 + " 10.1.2.3", "en", "a", 0)]
    got = {r.doc_id: r for r in pii.mask_pii(frame(spark, docs[-1:] + docs[: len(TEXTS)], clashes=True)).collect()}
    assert got[50].text == "é" * 5000 + " [EMAIL] " + "x" * 5000 + " [IP]"
    assert got[2].text == "card [CARD] and 4111-1111-1111-1112, [CARD]" and got[12].text is None and got[11].text == "" and got[13].text == TEXTS[13]
    assert got[15].text == "[EMAIL] 9" and got[50].key == 1


def test_checks(spark):
    df = spark.createDataFrame([("4111111111111111", "GB82WEST12345698765432"), ("79927398713", "DE89370400440532013000"), ("79927398714", "DE88370400440532013000")], "a string, b string")
    got = df.select(pii.luhn(F.col("a")).alias("l"), pii.mod97(F.col("b")).alias("m")).collect()
    assert [(r.l, r.m) for r in got] == [(True, True), (True, True), (False, False)]


def test_long_texts_take_linear_time(spark):
    some = "é" + " ".join(f"+1 (017) 555-{i:04d} x{i}@y.example" for i in range(9000))
    text = some + " " + "a." * 200_000 + "9" * 300_000
    got = pii.scan_pii(frame(spark, [(1, text, "en", "a", 0)])).select(pii.listed(F.col("found"), pii.BASE).alias("b")).first().b
    assert got == ",".join(base(some))


def test_query_and_empty(spark):
    got = {r.doc_id: r for r in queries.op13_personal_data(spark, "/root/testdata/sf0.001").collect()}
    for d in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        b = base(d.text)
        assert got[d.doc_id].base_sha256 == hashlib.sha256(",".join(b).encode()).hexdigest()
        assert [got[d.doc_id][f"n_{k}"] for k in pii.BASE] == [sum(x.startswith(k + ":") for x in b) for k in pii.BASE]
    assert pii.scan_pii(frame(spark, [])).count() == 0 and pii.mask_pii(frame(spark, [])).count() == 0
