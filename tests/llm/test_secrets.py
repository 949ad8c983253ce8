import hashlib
import re

from fixtures import frame
from pyspark.sql import functions as F

from rayloom.llm import queries, secrets

KEY = "AKIA" + "B7C2D9E4F1G6H3J8"
TEXTS = [
    'password = "hunter2hunter" and API-KEY: no', "my_api_key:abc123XYZ/=. token=short secret='12345'", f"key {KEY} and {KEY}x AKIASHORT", "hash " + "0a" * 12 + " and " + "0a" * 11 + "f g" + "f" * 80,
    "PASSWD:aaaaaaaaaa PassWord=changeme123", "😀 token: 日本 secret = tok_abcdef é password=p4ssw0rd!", "token=token=abcdefgh secretsecret=qqqqqqq", "Zx9Qw8Er7Ty6Ui5Op4As3Df2 lone token", "", None, "nothing here",
]


def base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.I | re.A):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def rows():
    return [(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(TEXTS)] + [(90 + i, "shared Qw3rTy7uIoP1aSdF5gHjK2 value", "en", f"o{i}", 0) for i in range(4)] + [(None, TEXTS[0], None, None, 0), (0, TEXTS[0], "en", "s0", 0)]


def test_base_spans_against_python(spark):
    got = secrets.scan_secrets(frame(spark, rows(), clashes=True)).select("doc_id", secrets.listed(F.col("found"), True).alias("b"), secrets.listed(F.col("found"), False).alias("a")).collect()
    assert sorted((str(r.doc_id), r.b) for r in got) == sorted((str(r[0]), base(r[1])) for r in rows())
    assert all(set(filter(None, r.b.split(","))) <= set(r.a.split(",")) for r in got)


def test_owners_tell_examples_from_live_ones(spark):
    got = {r.doc_id: r for r in secrets.scan_secrets(frame(spark, rows())).collect()}
    assert [e.live for e in got[7].found] == [True]
    assert got[90].found == []  # a bare token that four owners hold is an example
    held = {r.doc_id: r.text for r in secrets.redact_secrets(frame(spark, rows(), clashes=True)).collect()}
    assert held[7] == "[SECRET] lone token" and held[90] == rows()[len(TEXTS)][1] and held[9] is None and held[8] == ""
    assert held[4].count("[EXAMPLE]") == 2 and "hunter2" not in held[0]


def live_spans(docs):
    """Brute force: all spans with owners, repositories and verdict, of rows ``id, text, lang, source``."""
    import math
    from collections import Counter

    kinds = (
        (0, r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
        (1, r"AKIA[A-Z0-9]+", 0, 20, 0),
        (2, r"[0-9a-f]+", 0, 24, 0),
        (3, r"[A-Za-z0-9+/_=-]+", 0, 16, 0),
    )
    cands, owners, repos = [], {}, {}
    for at, (_, text, lang, source) in enumerate(docs):
        for nth, pattern, group, least, flags in kinds:
            for m in re.finditer(pattern, text or "", flags):
                v = m[group]
                if len(v) < least or nth == 3 and (len(re.findall("[0-9]", v)) < 3 or not re.search("[A-Za-z]", v)):
                    continue
                cands.append((at, m.start(), nth, m.end(), v))
                owners.setdefault(v, set()).add(source)
                repos.setdefault(v, set()).add((source, lang))
    out = [[] for _ in docs]
    for at, a, nth, b, v in cands:
        carried = sum(n * math.log2(len(v) / n) for n in Counter(v).values())
        shape = bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v)) and carried >= secrets.LEAST_BITS
        live = shape and len(owners[v]) < secrets.EXAMPLE_OWNERS and len(repos[v]) < secrets.EXAMPLE_REPOSITORIES
        meets = any(x[0] == at and x[2] < 3 and x[1] < b and a < x[3] for x in cands)
        if nth < 3 or live and not meets:
            out[at].append((a, nth, b, live, len(owners[v]), len(repos[v])))
    return [sorted(x) for x in out]


def held_against_brute_force(spark, some):
    got = [(str(r.doc_id), [(e.start, e.nth, e.end, e.live, e.n_owners, e.n_repositories) for e in r.found]) for r in secrets.scan_secrets(frame(spark, some)).collect()]
    want = live_spans([(r[0], r[1], r[2], r[3]) for r in some])
    assert sorted(got) == sorted((str(r[0]), w) for r, w in zip(some, want))


def test_ownership_against_brute_force(spark):
    copied = [(200 + i, f"see Mn4Bv7Cx2Za9Sd5Fg8Hj1 and {KEY} here", ("en", "de", "fr")[i % 3], f"s{i % 2}", 0) for i in range(6)]
    held_against_brute_force(spark, rows() + copied + [(300, "secret: Pq8Wn3Xb6Yc1 Lk2Jh5Gf8Dd1Sa4Zx7Cv0", "en", "only", 0)])


def test_positions_in_a_text_of_many_matches(spark):
    rng = __import__("random").Random(3)
    text = " ".join("é" * rng.randrange(3) + f"token={rng.randrange(10**7, 10**8)}x" for _ in range(1300))
    got = secrets.scan_secrets(frame(spark, [(1, text, "en", "a", 0)])).select(secrets.listed(F.col("found"), True).alias("b")).first().b
    assert got == base(text) and got.count(",") == 1299


def test_many_spans_of_a_long_text_are_replaced(spark):
    rng = __import__("random").Random(5)
    said = [("é" * rng.randrange(400), f"token={rng.randrange(10**7, 10**8)}") for _ in range(16_000)]
    got = secrets.redact_secrets(frame(spark, [(1, " ".join(a + " " + b for a, b in said), "en", "a", 0), (2, "my token=abcdefgh", "en", "a", 0)])).collect()
    assert {r.doc_id: r.text for r in got} == {1: " ".join(a + " [EXAMPLE]" for a, _ in said), 2: "my [EXAMPLE]"}


def test_without_sources(spark):
    df = spark.createDataFrame([(1, f"a {KEY} b")], "id long, text string")
    assert secrets.redact_secrets(df).first().text == "a [SECRET] b"


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op6_secret_scan(spark, "/root/testdata/sf0.001").collect()}
    for d in docs:
        b = base(d.text)
        assert got[d.doc_id].base_sha256 == hashlib.sha256(b.encode()).hexdigest()
        assert [got[d.doc_id][f"n_{k}"] for k in ("assign", "access", "hex")] == [b.count(k + ":") for k in ("assign", "access", "hex")]


def test_empty(spark):
    assert secrets.scan_secrets(frame(spark, [])).count() == 0 and secrets.redact_secrets(frame(spark, [])).count() == 0
