import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from fixtures import documents, frame

from rayloom.llm import queries, runs

SPACES = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(words[i] == words[i + p] for i in range(len(words) - p)))


def brute_force(words, periods=4, least=6):
    """All runs as start, length, period: for each period the longest stretches of words that equal those a period later."""
    found = []
    for p in range(1, len(words) // periods + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least, periods * p) and smallest_period(words[i : j + p]) == p:
                found.append((i, j - i + p, p))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


@pytest.mark.parametrize("periods,least", [(4, 6), (2, 2), (3, 1)])
def test_arrays_against_brute_force(periods, least):
    rng = random.Random(periods)
    texts = [[rng.randrange(1, k) for _ in range(rng.randrange(60))] for k in (2, 3, 4, 8) for _ in range(60)]
    fib = [[1], [1, 2]]
    while len(fib[-1]) < 200:
        fib.append(fib[-1] + fib[-2])
    texts += [fib[-1], [1] * 300, [1, 2] * 90 + [1, 3] * 90, [], [5]]
    got = list(zip(*(a.tolist() for a in runs.find_runs([np.array(t, np.int64) for t in texts], periods, least))))
    assert got == [(k, *r) for k, t in enumerate(texts) for r in brute_force(t, periods, least)]


def held(rows):
    out = []
    for doc_id, text, *_ in rows:
        words = SPACES.findall(text or "")
        found = brute_force(words)
        out.append((str(doc_id), len(words), found, collapsed(words, found)))
    return sorted(out)


def test_documents_against_brute_force(spark, monkeypatch):
    rows = [r for r in documents() if len(r[1] or "") < 20_000]
    rows += [(2000, "a b " * 7 + "a c c c c c c c d", "en", "a", 0), (2001, "x y x y " * 3 + "x y", "en", "a", 0), (2002, "one two three " * 40 + "end", "en", "a", 0)]
    for words in (250_000, 100, 1):
        monkeypatch.setattr(runs, "CHUNK_WORDS", words)
        got = runs.collapse_runs(frame(spark, rows, clashes=True)).collect()
        assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == held(rows)


def test_a_long_text_and_an_empty_table(spark):
    rng = random.Random(4)
    part = [f"w{rng.randrange(10**6)}" for _ in range(30_000)]
    text = " ".join(["start", *part * 5, "end", *["z"] * 100_000])
    got = runs.collapse_runs(frame(spark, [(1, text, "en", "a", 0)])).first()
    assert [tuple(r) for r in got.runs] == [(1, 150_000, 30_000), (150_002, 100_000, 1)]
    assert got.collapsed == " ".join(["start", *part, "end", "z"])
    assert runs.collapse_runs(frame(spark, [])).count() == 0


def test_query(spark):
    want = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        words, crc = SPACES.findall(r.text or ""), zlib.crc32(str(r.doc_id).encode())
        g, n = crc // 10, len(words)
        if crc % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if n > 4000:
            continue  # too long for brute force
        found = brute_force(words)
        top = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[r.doc_id] = (len(found), *top, top[1] and 1000 * top[1] // top[2], digest("".join(f"{s},{m},{q}\n" for s, m, q in found)), digest(collapsed(words, found)))
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r.doc_id: tuple(r[c] for c in columns) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert {k: got[k] for k in want} == want and sum(w[0] > 0 for w in want.values()) > 3


def test_periods_of_null_and_empty_texts(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    df = spark.createDataFrame([(ids[0], None), (ids[1], ""), (ids[2], " \n "), (ids[3], "one"), (None, "a b c"), (None, None)], "doc_id long, text string")
    told = runs.collapse_runs(df.select("doc_id", queries.with_period(df["doc_id"], df["text"]).alias("text"))).collect()
    assert sorted((r.n_words, r.runs, r.collapsed) for r in told) == [(0, [], "")] * 4 + [(1, [], "one"), (3, [], "a b c")]
