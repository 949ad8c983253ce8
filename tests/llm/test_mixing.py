import random

import pytest
from fixtures import documents, frame
from pyspark.sql import functions as F

from rayloom.llm import mixing


def test_targets_are_capped_and_reshared(spark):
    sizes = spark.createDataFrame([("1a", 10), ("1b", 100), ("1c", 1000)], "skey string, source_size long")
    got = {r.skey: r.target for r in mixing.source_targets(sizes, (3, 2, 1)).collect()}
    assert got == pytest.approx({"1a": 30, "1b": 300, "1c": 780})
    assert {r.target for r in mixing.source_targets(sizes, (1, 1, 1), total_share=3.0).collect()} == {30.0, 300.0, 3000.0}


def test_mix_meets_targets(spark):
    rows = mixing.mix_sources(frame(spark, clashes=True)).collect()
    assert len(rows) == len(frame(spark).collect())
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, []).append(r)
    total = sum(r.size for r in rows)
    for some in by.values():
        assert some[0].source_size == sum(r.size for r in some)
        assert abs(sum(r.taken for r in some) - some[0].target) <= 1
        full = [r for r in some if 0 < r.partial < r.size]
        assert len(full) <= 1
    assert sum(some[0].target for some in by.values()) == pytest.approx(total)


def test_reruns_agree_and_order_does_not_matter(spark):
    df = frame(spark)
    once = sorted((str(r.doc_id), r.taken) for r in mixing.mix_sources(df).collect())
    again = sorted((str(r.doc_id), r.taken) for r in mixing.mix_sources(df.repartition(5).orderBy(F.desc("n_chars"))).collect())
    assert once == again


def plain(rows, weights=(1, 2, 3), seed=42):
    """Brute force for rows ``id, text, lang, source``: everything sorted by source and key."""
    import hashlib
    import math
    import re

    sources, out = {}, []
    for at, r in enumerate(rows):
        text = r[1] or ""
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        name = f"{seed}:{'null:' + hashlib.md5(text.encode()).hexdigest() if r[0] is None else r[0]}"
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        weight = max(0.1, min(1.0, size / 50) * (1.0 if 4 <= (len(text) if r[1] is not None else 0) / max(size, 1) <= 12 else 0.5))
        sources.setdefault((r[3] is None, r[3] or ""), []).append((-math.log(u) / weight, r[0] is None, r[0] or 0, size, at))
    names = sorted(sources)
    size_of = {k: sum(x[3] for x in v) for k, v in sources.items()}
    weight_of = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    capped = set()
    while True:
        share = sum(size_of.values()) - sum(3.0 * size_of[k] for k in capped)
        level = share / max(sum(weight_of[k] for k in names if k not in capped), 1e-9)
        more = {k for k in names if k not in capped and 3.0 * size_of[k] < level * weight_of[k]}
        if not more:
            break
        capped |= more
    for k in names:
        target = 3.0 * size_of[k] if k in capped else level * weight_of[k]
        epochs = int(target // size_of[k]) if size_of[k] else 0
        left = round(target - epochs * size_of[k])
        for *_, size, at in sorted(sources[k]):
            partial = max(0, min(size, left))
            left -= partial
            out.append((at, epochs * size + partial))
    return [taken for _, taken in sorted(out)]


@pytest.mark.parametrize("steps", [4096, 2])
def test_against_brute_force(spark, monkeypatch, steps):
    monkeypatch.setattr(mixing, "STEPS", steps)
    rows = documents() + [(None, f"nobody {i} said this word", "en", "a", 0) for i in range(30)]
    want = sorted((str(r[0]), n) for r, n in zip(rows, plain(rows)))
    assert sorted((str(r.doc_id), r.taken) for r in mixing.mix_sources(frame(spark, rows)).collect()) == want


def test_heavy_documents_come_first(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * 50), "en", "a", 9 if i % 2 else 1) for i in range(400)]
    rng.shuffle(rows)
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), total_share=0.3, quality=F.when(F.col("doc_id") % 2 == 1, 9.0).otherwise(1.0)).collect()
    heavy = sum(r.taken for r in got if r.doc_id % 2)
    assert heavy > 0.7 * sum(r.taken for r in got)


def test_corpus_holds_what_was_taken(spark):
    df = frame(spark, clashes=True)
    corpus = mixing.mix_corpus(df).collect()
    words = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert sum(words(r.text) for r in corpus) == sum(r.taken for r in mixing.mix_sources(df).collect())
    assert corpus[0].asDict().keys() == {*df.columns, "mix_epoch"}
    again = mixing.mix_corpus(df.withColumns({"mix_epoch": F.lit(1), "mix_epoch_2": F.lit(1)}))
    assert [c for c in again.columns if c not in df.columns] == ["mix_epoch", "mix_epoch_2", "mix_epoch_3"]


def test_empty(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert mixing.mix_corpus(frame(spark, [])).count() == 0


def test_quality_that_is_null_or_nan(spark):
    rows = [(i, "word " * 10, "en", "a", 0) for i in range(40)]
    worth = F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("double")).when(F.col("doc_id") % 4 == 1, F.lit(float("nan"))).otherwise(F.lit(1.0))
    got = {r.doc_id: r for r in mixing.mix_sources(frame(spark, rows), quality=worth, total_share=0.25).collect()}
    assert sum(r.taken for r in got.values()) == 100 and all(r.taken == 0 for i, r in got.items() if i % 4 < 2)
    assert all(r.quality == 1e-6 for i, r in got.items() if i % 4 < 2)
