import base64
import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from rayloom.llm import warc


def pages(spark):
    rows = [(i, f"https://e.org/{i} x\n%", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1 é") for i in range(40)]
    rows += [(50, None, None), (51, "u", ""), (52, "u", "x" * 300_000), (53, "v", "x" * 300_000), (None, "w", "x" * 300_000), (None, "n", "only here")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.mark.parametrize("few", [100_000, 0])
def test_round_trip(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", few)
    df = pages(spark).withColumns({c: F.lit(1) for c in ("id", "sha", "payload", "first_id", "bytes", "n", "file", "offset")})
    index = warc.write_archives(df)
    got = {(r.page_id, r.url): r for r in warc.read_back(index).collect()}
    first = {}
    for r in sorted(df.collect(), key=lambda r: (r.page_id is None, r.page_id or 0)):
        first.setdefault(r.html or "", r.page_id)
    assert len(got) == df.count()
    for r in df.collect():
        said, g = (r.html or "").encode(), got[(r.page_id, r.url)]
        assert (g.payload_bytes, g.payload_digest) == (len(said), base64.b32encode(hashlib.sha1(said).digest()).decode())
        leads = first[r.html or ""] == r.page_id
        assert (g.record_type, g.refers_to) == (("response", None) if leads else ("revisit", first[r.html or ""]))


def test_archives_are_gzip_members_and_selection_reads_only_its_records(spark):
    index = warc.write_archives(pages(spark)).collect()
    path = index[0].file.removeprefix("file://")
    with gzip.open(path) as f:
        assert f.read().count(b"WARC/1.1\r\nWARC-Type: ") == sum(r.file == index[0].file for r in index)
    assert sum(r.length for r in index if r.file == index[0].file) == os.path.getsize(path)
    some = spark.createDataFrame([r for r in index if r.page_id in (3, 11)], "page_id long, url string, digest string, record_type string, refers_to long, file string, offset long, length long")
    assert sorted(r.page_id for r in warc.read_records(some).collect()) == [3, 11]


@pytest.mark.parametrize("few", [100_000, 0])
def test_repeated_rows(spark, monkeypatch, few):
    """Rows that share the least id of a payload are all responses; a repeated revisit is one each time."""
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", few)
    rows = [(1, "a", "same"), (1, "a", "same"), (2, "b", "same"), (2, "b", "same"), (2, "b", "else"), (None, "c", "none"), (None, "c", "none")]
    got = warc.read_back(warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()
    told = sorted((str(r.page_id), r.payload_bytes, r.record_type, r.refers_to or 0) for r in got)
    assert told == sorted([("1", 4, "response", 0)] * 2 + [("2", 4, "revisit", 1)] * 2 + [("2", 4, "response", 0)] + [("None", 4, "response", 0)] * 2)


def test_small_payloads_are_not_revisited(spark):
    kinds = {r.page_id: r.record_type for r in warc.write_archives(pages(spark), least_revisit=1000).collect()}
    assert kinds[53] == "revisit" and all(kinds[i] == "response" for i in range(40))


def test_reads_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (20, 5), (10**6, 5)]) == [(0, 25, [0, 1, 2]), (10**6, 10**6 + 5, [3])]


def test_empty(spark):
    assert warc.read_back(warc.write_archives(pages(spark).limit(0))).count() == 0
