import hashlib
import zlib

import pytest
from fixtures import documents, frame
from pyspark.sql import functions as F

from rayloom.llm import merkle, queries


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, more=0):
    doc_id, text, lang, source, n = row
    values = [doc_id, source, lang, None if n is None else n + more, text]
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes, at):
    """The root over ``nodes`` and the siblings of the one at ``at`` with their side."""
    path = []
    while len(nodes) > 1:
        if at ^ 1 < len(nodes):
            path.append((nodes[at ^ 1], at % 2))
        else:
            path.append((None, 0))
        nodes, at = [h(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)], at // 2
    return nodes[0], path


def plain(rows):
    """Brute force: the query's columns of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
    subroots = [climb([leaf_of(r) for r in groups[g]], 0)[0] for g in order]
    out = []
    for k, g in enumerate(order):
        leaves = [leaf_of(r) for r in groups[g]]
        for i, r in enumerate(groups[g]):
            root, top = climb(subroots, k)
            path = climb(leaves, i)[1] + top
            at = leaf_of(r, 1) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaves[i]
            for s, left in path:
                at = h(at) if s is None else h(s, at) if left else h(at, s)
            out.append((str(r[0]), leaves[i], subroots[k], root, h(*[s for s, _ in path if s]), at, at == root))
    return sorted(out)


def told(df):
    shown = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    rows = merkle.manifest(df, carry={"shown": shown}).withColumn("folded", merkle.fold(F.coalesce("shown", "leaf"), F.col("path"))).withColumn("s", merkle.siblings(F.col("path"))).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, h(*r.s), r.folded, r.folded == r.root) for r in rows)


@pytest.mark.parametrize("levels", [10, 2, 1])
def test_against_plain_python(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # blocks of 2 and of 4 leaves take several rounds
    rows = documents()
    assert told(frame(spark, rows, clashes=True)) == plain(rows)


def test_one_group_of_all_sizes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 2)
    for n in (1, 2, 3, 4, 5, 8, 9, 16, 17):
        rows = [(i, f"text {i}", None, "a", None) for i in range(n)]
        assert told(frame(spark, rows)) == plain(rows)


def test_many_groups(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    rows = [(i, "same", f"é{i % 7}" if i % 3 else "Z", "a", 1) for i in range(40)] + [(1, "same", "Z", "a", 1)] * 3
    assert told(frame(spark, rows)) == plain(rows)


def test_a_long_text_and_an_empty_table(spark):
    rows = [(1, "word é " * 700_000, "en", "a", 5), (2, "", "en", None, None)]
    assert told(frame(spark, rows)) == plain(rows)
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    columns = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    got = sorted((str(r.doc_id), *[r[c] for c in columns]) for r in queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect())
    assert got == plain(rows) and 0 < sum(not g[-1] for g in got) < len(got)
