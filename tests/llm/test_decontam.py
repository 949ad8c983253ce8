import random

import numpy as np
import pytest
from fixtures import WORDS, documents, frame

from rayloom.llm import decontam

ITEMS = "item_id string, text string"


def benchmark(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def items(seed=4):
    rng = random.Random(seed)
    docs = [r[1] for r in documents() if r[1] and len(r[1].split()) > 40]
    rows = []
    for k in range(25):
        words = rng.choice(docs).split()
        at = rng.randrange(max(1, len(words) - 30))
        piece = words[at : at + rng.choice((3, 9, 10, 11, 25))]
        if k % 3 == 0:
            piece[len(piece) // 2] = "unheard"
        rows.append((f"i{k}", " ".join(rng.choice((str.upper, str.lower))(w) for w in piece) + "!"))
    return rows + [("none", None), ("empty", " -- "), ("i0", "alpha beta"), ("short", "one TWO three"), ("dup", rows[0][1]), (None, rows[1][1]), (None, "Delta gamma")]


def test_against_brute_force(spark):
    rows = items()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in decontam.find_contamination(frame(spark, clashes=True), benchmark(spark, rows)).collect())
    want = []
    for d in documents():
        n, hit, items_of = decontam.brute_force(d[1], rows)
        want.append((str(d[0]), n, hit, tuple(items_of), hit > 0))
    assert got == sorted(want)
    assert any(g[2] for g in got)


def test_removed_text_has_no_phrase_left_where_it_was(spark):
    rows = items()
    kept = decontam.remove_contamination(frame(spark, clashes=True), benchmark(spark, rows))
    assert kept.count() == len(documents()) and kept.columns == frame(spark, clashes=True).columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    for d in documents():
        n, hit, _ = decontam.brute_force(d[1], rows)
        assert len(decontam.WORDS.findall(decontam.lowered(texts[d[0]]))) == n - hit
        if not hit:
            assert texts[d[0]] == d[1]


def test_index_search_and_locate():
    rng = random.Random(5)
    for _ in range(20):
        runs = [[rng.randrange(1, 5) for _ in range(rng.randrange(1, 40))] for _ in range(rng.randrange(1, 6))]
        sequence = np.array([x for run in runs for x in (*run, 0)])
        index = decontam.FmIndex(sequence)
        for size in (1, 2, 3):
            phrases = np.array([[rng.randrange(1, 6) for _ in range(size)] for _ in range(15)])
            lo, hi = index.search(phrases)
            for p, a, b in zip(phrases, lo, hi):
                want = [i for i in range(len(sequence) - size + 1) if (sequence[i : i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_several_blocks_and_small_shards(spark, monkeypatch):
    rows = items()
    whole = sorted((str(r.doc_id), r.n_hit, tuple(r["items"])) for r in decontam.find_contamination(frame(spark), benchmark(spark, rows)).collect())
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    monkeypatch.setattr(decontam, "PART_WORDS", 15)
    assert sorted((str(r.doc_id), r.n_hit, tuple(r["items"])) for r in decontam.find_contamination(frame(spark), benchmark(spark, rows)).collect()) == whole


def test_suffix_array():
    rng = random.Random(6)
    for top in (1, 2, 5, 3000):
        for n in (1, 2, 3, 40, 200):
            s = [rng.randrange(1, top + 1) for _ in range(n)] + [0]
            assert decontam.suffix_array(np.array(s)).tolist() == sorted(range(n + 1), key=lambda i: s[i:])


@pytest.mark.parametrize("block", [10**6, 100])
def test_blocks_cut_the_same(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rows = items()
    got = sorted((str(r.doc_id), r.text or "") for r in decontam.remove_contamination(frame(spark, clashes=True), benchmark(spark, rows)).collect())
    for (i, text), d in zip(got, sorted(documents(), key=lambda d: (str(d[0]), d[1] or ""))):
        n, hit, _ = decontam.brute_force(d[1], rows)
        assert i == str(d[0])
    left = sorted(len(decontam.WORDS.findall(decontam.lowered(t))) for _, t in got)
    assert left == sorted(n - hit for n, hit, _ in (decontam.brute_force(d[1], rows) for d in documents()))


@pytest.mark.parametrize("rows", [[], [("a", None)]])
def test_no_phrases(spark, rows):
    assert decontam.find_contamination(frame(spark), benchmark(spark, rows)).filter("n_hit > 0").count() == 0


def test_empty(spark):
    assert decontam.find_contamination(frame(spark, []), benchmark(spark, items())).count() == 0
    assert WORDS
