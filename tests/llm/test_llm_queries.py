"""The registered queries over whole small tables: against their SQL, or against brute force."""

import base64
import hashlib
import math
import os

import duckdb
import pytest
from test_quality import plain
from test_substrings import brute_force

from rayloom.llm import queries

SF = "/root/testdata/sf0.001"


def told(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    return f"{v:.9g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    df, said = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(said.columns)
    got = sorted(tuple(told(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(told(v) for _, v in sorted(zip(said.columns, r))) for r in said.fetchall())


def test_every_number_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_warc_query(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    want = []
    for p in pages:
        said, lead = (p.html or "").encode(), first[p.html or ""]
        want.append((p.page_id, len(said), base64.b32encode(hashlib.sha1(said).digest()).decode(), *(("response", None) if lead == p.page_id else ("revisit", lead))))
    got = [tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in queries.op2_warc(spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_substring_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = sorted((d.doc_id, *w) for d, w in zip(docs, brute_force([(d.text or "").encode() for d in docs], 400)))
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op4_substring_dedup(spark, SF).collect()) == want


def test_quality_query(spark):
    got = {r.doc_id: r for r in queries.op8_quality_rules(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        r, m = got[d.doc_id], plain(d.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r.base_failed and r.kept)


def test_classifier_query(spark):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = {r.doc_id: r for r in queries.op5_quality_classifier(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    right = sum((got[i].quality >= 0.5) == (r.quality == 1) for i, r in labels.items())
    assert right / len(labels) > 0.85
