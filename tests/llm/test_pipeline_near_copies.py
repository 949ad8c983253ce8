"""The pipeline's near-duplicate stage at its own threshold, 0.8, against all pairs."""

import corpus_pipeline
import pytest
from fixtures import frame
from test_neardup import brute_force, near_copies, shingles

from rayloom.llm import neardup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("small_group", [neardup.SMALL_GROUP, 2])
def test_near_copies_from_80_hundredths_on_are_one(spark, monkeypatch, small_group):
    monkeypatch.setattr(neardup, "SMALL_GROUP", small_group)
    rows = near_copies(5, 40, 5) + [(1000 + r[0], r[1] + " tail words", *r[2:]) for r in near_copies(6, 30, 4)]
    sets, lead = [shingles(r[1]) for r in rows], list(range(len(rows)))
    between = 0
    for i, a in enumerate(sets):
        for j in range(i):
            both, either = len(a & sets[j]), len(a | sets[j])
            between += 80 * either <= 100 * both < 85 * either
            if 100 * both >= 80 * either and lead[i] != lead[j]:
                lead = [min(lead[i], lead[j]) if x in (lead[i], lead[j]) else x for x in lead]
    want = sorted(rows[i][0] for i in set(lead))
    assert between and len(want) < sum(r[3] for r in brute_force(rows))
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), SF).collect()) == want
