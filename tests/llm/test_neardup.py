import random

import pytest
from fixtures import documents, frame, prose

from rayloom.llm import neardup


def shingles(text):
    words = (text or "").encode().translate(neardup._LOWER).split()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_force(rows, least=85):
    sets = [shingles(r[1]) for r in rows]
    lead = list(range(len(rows)))

    def top(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= least * len(a | b) and top(i) != top(j):
                lead[top(i)] = top(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(top(i), []).append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    return sorted((str(r[0]), len(sets[i]), str(least[top(i)]), r[0] == least[top(i)]) for i, r in enumerate(rows))


def near_copies(seed, n, edits):
    rng = random.Random(seed)
    base = prose(rng, 150).split()
    rows = [(0, " ".join(base), "en", "a", 0)]
    for i in range(1, n):
        words = list(base)
        for _ in range(rng.randrange(edits)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(words), "en", "a", 0))
    return rows


@pytest.mark.parametrize("rows", [documents(), near_copies(2, 120, 6), near_copies(3, 90, 4)[1:]])
def test_components_against_brute_force(spark, rows):
    got = neardup.near_duplicates(frame(spark, rows, clashes=True)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_force(rows)


def test_large_groups_by_pivot_give_the_same(spark, monkeypatch):
    rows = near_copies(5, 80, 7) + [(1000 + r[0], r[1] + " tail words", *r[2:]) for r in near_copies(6, 60, 5)]
    monkeypatch.setattr(neardup, "SMALL_GROUP", 2)
    monkeypatch.setattr(neardup, "PIVOT_DOCS", 5)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_force(rows)


def test_pivot_residue_without_the_original(spark, monkeypatch):
    """Without the original in the table, links that need shared differences must be found."""
    rng = random.Random(8)
    base = prose(rng, 150).split()
    rows = []
    for i in range(40):
        words = list(base)
        for k in ((i // 4) * 7 % 150, (i // 4) * 13 % 150, rng.randrange(150)):
            words[k] = f"s{i // 4}x{k}"
        rows.append((i, " ".join(words), "en", "a", 0))
    monkeypatch.setattr(neardup, "SMALL_GROUP", 2)
    got = neardup.near_duplicates(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute_force(rows)


def test_one_of_each_component_stays(spark):
    df = frame(spark, clashes=True)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    ids = sorted(str(r.doc_id) for r in kept.collect())
    flat = [r for r in brute_force(documents()) if r[3] or r[0] == "None" and r[2] == "None"]
    assert ids == sorted({r[0] for r in flat})


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    both = rng.integers(0, 2**63, 900, dtype=np.uint64)
    hits = 0
    for k in range(60):
        own = rng.integers(0, 2**63, (2, 50), dtype=np.uint64)
        a, b = neardup.min_max([np.concatenate((both[: 850 - k], own[0])), np.concatenate((both[: 850 - k], own[1]))])
        hits += bool((a == b).any())
    assert hits == 60


def test_empty(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0 and neardup.keep_one(frame(spark, [])).count() == 0
