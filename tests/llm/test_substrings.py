import hashlib
import random

import numpy as np
import pytest
from fixtures import documents, frame, prose

from rayloom.llm import substrings


def brute_force(texts, length):
    seen, twice = set(), set()
    for t in texts:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            (twice if s in seen else seen).add(s)
    out = []
    for t in texts:
        gone, spans, end = bytearray(len(t)), 0, -2
        for i in range(len(t) - length + 1):
            if t[i : i + length] in twice:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        for i, g in enumerate(gone):
            spans += bool(g and i - 1 != end)
            end = i if g else end
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def compare(spark, rows, **options):
    found = substrings.remove_repeats(frame(spark, rows, **options)).collect()
    texts = [(r[1] or "").encode() for r in rows]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert got == sorted((str(r[0]), *w) for r, w in zip(rows, brute_force(texts, substrings.LENGTH)))
    shared = sorted((str(r[0]), w[0], w[1]) for r, w in zip(rows, brute_force(texts, substrings.PASSAGE)))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_shared) for r in found) == shared


def test_awkward_rows(spark):
    compare(spark, documents(), clashes=True)


def test_overlaps_and_repeats_within_a_text(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 80) for _ in range(3))
    texts = [a + b, b + a, a + c + a, c[:399] + "x", c[:400] + "y", "q" + c[:401], "ab" * 500, a[: len(a) // 2] + "é" + a[len(a) // 2 :]]
    compare(spark, [(i, t, "en", "a", 0) for i, t in enumerate(texts)])


@pytest.mark.parametrize("hot", [0, 1, 8])
def test_hot_anchors_are_split_with_the_same_result(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_ANCHOR", hot)
    compare(spark, documents())


def test_a_passage_of_many_texts(spark, monkeypatch):
    rng = random.Random(9)
    said, short = prose(rng, 80), prose(rng, 50)[:300]
    rows = [(i, prose(rng, rng.randrange(5, 60)) + " " + (said if i % 3 else short) + " " + prose(rng, 30), "en", "a", 0) for i in range(60)]
    rows += [(100 + i, said[: 420 + i] + str(i) * 9 + short, "en", "a", 0) for i in range(8)]
    monkeypatch.setattr(substrings, "HOT_ANCHOR", 5)
    compare(spark, rows)


def one_gram(rng, n):
    """A text of ``n`` unlike passages around one string of 24 bytes, which has the least hash of all grams in it."""
    def noise(k):
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    least = lambda t: int(substrings.gram_hashes(np.frombuffer(t.encode(), np.uint8)).min())
    gram = min((noise(24) for _ in range(20_000)), key=least)
    return "".join(noise(300) + gram for _ in range(n))


@pytest.mark.parametrize("n,hot", [(300, 20), (20_000, 1_000)])
def test_many_passages_of_one_text(spark, monkeypatch, n, hot):
    rng = random.Random(2)
    text = one_gram(rng, n)
    rows = [(1, text + "x" + text[: 3_000], "en", "a", 0), (2, prose(rng, 100), "en", "a", 0), (3, text[5_000 : 5_700], "en", "a", 0)]
    monkeypatch.setattr(substrings, "HOT_ANCHOR", hot)
    sizes, seen = spark.sparkContext.accumulator(0), substrings.spans_of_collections

    def watched(passages):
        largest = passages.groupBy("hash").count().agg({"count": "max"}).first()[0] or 0
        sizes.add(largest > hot)
        return seen(passages)

    monkeypatch.setattr(substrings, "spans_of_collections", watched)
    if n < 1_000:
        compare(spark, rows)
    else:
        got = {r.doc_id: r.n_removed for r in substrings.remove_repeats(frame(spark, rows)).collect()}
        assert got == {1: 3_000 + 3_000 + 700, 2: 0, 3: 700}
    assert sizes.value == 0  # no collection is larger than the bound


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    rng = random.Random(8)
    text = prose(rng, 900).encode()
    whole = [tuple(x) for x in zip(*[a.tolist() for a in substrings.anchors([text])])]
    monkeypatch.setattr(substrings, "LONGEST_SHARD", 1000)
    parts = [tuple(x) for x in zip(*[a.tolist() for a in substrings.anchors([text])])]
    windows = lambda found: sorted((h, at, w) for _, h, at, lo, hi in found for w in range(lo, hi + 1))
    assert windows(whole) == windows(parts)


def test_empty(spark):
    assert substrings.remove_repeats(frame(spark, [])).count() == 0
