"""The pipeline against the same decisions made in plain Python where they can be, stage by stage."""

import pytest

import corpus_pipeline
from rayloom.lineage import stored
from rayloom.llm import decontam, quality
from fixtures import documents, frame
from test_mixing import plain
from test_neardup import brute_force
from test_secrets import live_spans

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, seen = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(stored(stage(spark, seen[-1], SF), "stage"))
    raw, good, single, clean, safe, mixed = seen
    assert all(df.columns == columns for df in seen[:-1])
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in quality.judge(raw).filter("kept").collect()}
    rows = [tuple(r) for r in good.collect()]
    assert sorted(str(r.doc_id) for r in single.collect()) == sorted(r[0] for r in brute_force(rows, corpus_pipeline.NEAR_JACCARD) if r[3])
    before = {r.doc_id: r.text for r in single.collect()}
    words = lambda t: decontam.WORDS.findall(decontam.lowered(t))
    for r in clean.collect():
        n, hit, _ = decontam.brute_force(before[r.doc_id], bench)
        assert len(words(r.text)) == n - hit and (hit or r.text == before[r.doc_id])
    before = clean.collect()
    spans = live_spans([(r.doc_id, r.text, r.lang, r.source) for r in before])
    assert sorted((r.doc_id, r.text or "") for r in safe.collect()) == sorted((r.doc_id, redacted(r.text, some) or "") for r, some in zip(before, spans))
    kept = safe.collect()
    taken = plain([(r.doc_id, r.text, r.lang, r.source) for r in kept])
    got = {}
    for r in mixed.collect():
        got.setdefault(r.doc_id, []).append((r.epoch, len(r.text.split()), len(r.text.split()) == len((next(k.text for k in kept if k.doc_id == r.doc_id)).split())))
    assert {i: sum(n for _, n, _ in some) for i, some in got.items()} == {r.doc_id: n for r, n in zip(kept, taken) if n}
    for some in got.values():  # complete epochs before the sampled one
        assert [e for e, _, _ in sorted(some)] == list(range(1, len(some) + 1)) and all(whole for _, _, whole in sorted(some)[:-1])


def redacted(text, spans):
    out, at = "", 0
    for start, _, end, live, *_ in spans:
        if start >= at:
            out, at = out + text[at:start] + ("[SECRET]" if live else "[EXAMPLE]"), end
        else:
            at = max(at, end)
    return text if text is None else out + text[at:]


@pytest.mark.parametrize("rows", [documents() + documents()[:5], []])
def test_awkward_rows_pass_every_stage(spark, rows):
    """Nulls, empty and long texts, repeated rows, clashing names, an empty table."""
    docs = frame(spark, rows, clashes=True)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF), "stage")
        assert docs.columns == columns, name
    assert docs.count() == docs.select("doc_id", "text").distinct().count() and bool(rows) == (docs.count() > 0)
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert [c for c in mixed.columns if c not in columns] == ["mix_epoch"] and bool(rows) == (mixed.count() > 0)


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "epoch"} <= set(out.columns) and out.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None
