"""WARC archives written and read through an index.

A task writes its records, each a gzip member of its own, one after the other
and returns their offset, length, URL and digest; that index is stored before
anything is read.  Reading starts from the index: the selected records are
sorted by place, near ones are joined into one byte-range read, and the
members are cut out of it.

Archives go to the folder that all executors share, by whatever file system
its URI names.  A task that is run again writes a new file, and the index
names the file of the attempt that succeeded; files of lost attempts are not
in the index and so are never read.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.lineage import scratch, stored
from rayloom.llm.common import modest_batches, small_enough

#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 1 << 30
#: Bytes of the selected records that a reading task is given about, the most in a read, and the gap that a read passes over.
BLOCK_BYTES, READ_BYTES, GAP_BYTES = 64 << 20, 8 << 20, 64 << 10
#: Payloads that occur more than once: up to so many are broadcast, more are joined by shuffle.
BROADCAST_DIGESTS = 100_000
#: Date of the records, so that reruns agree.
DATE = "1970-01-01T00:00:00Z"

INDEX = "page_id string, url string, digest string, record_type string, refers_to string, file string, offset bigint, length bigint"
RECORD = "page_id string, url string, digest string, record_type string, refers_to string, payload binary"
_PAGE = "urn:page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str):
    """The file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", uri)))


def base32_sha1(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def _safe(value: str) -> str:
    """A header value without white space or control characters; percent-encoded ones come back with ``_plain``."""
    return re.sub(r"[\x00-\x20%\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _plain(value: str) -> str:
    return re.sub(r"%([0-7][0-9A-F])", lambda m: chr(int(m[1], 16)), value)


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response, or a revisit without payload where ``refers_to`` is given; null id or URL has no header."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Date", DATE)]
    if page_id is not None:
        fields.append(("WARC-Record-ID", f"<{_PAGE}{_safe(page_id)}>"))
    if url is not None:
        fields.append(("WARC-Target-URI", _safe(url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<{_PAGE}{_safe(refers_to)}>"), ("WARC-Profile", _REVISIT)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[str | None, str | None, str, str, str | None, bytes | None]:
    """``RECORD`` of one uncompressed record; a revisit has no payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    page = lambda name: _plain(fields[name][1 + len(_PAGE) : -1]) if name in fields else None
    kind = fields["WARC-Type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    url = fields.get("WARC-Target-URI")
    return page("WARC-Record-ID"), None if url is None else _plain(url), fields["WARC-Payload-Digest"].removeprefix("sha1:"), kind, page("WARC-Refers-To"), payload


def write_archives(pages: DataFrame, folder: str | None = None, least_revisit: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for every row of ``pages``; returns the stored index (``INDEX``, the ids of the table's own type).

    A payload is the UTF-8 html; null is empty.  Of equal payloads of at least
    ``least_revisit`` bytes the row of least id is the response, the others
    revisit it.  Null ids come after all others; rows that share the least id,
    or have only null ids, are all responses.  Null URLs have no header.  A
    very long payload is one record, which a task holds.  An empty table gives
    an empty index; other columns are ignored.
    """
    modest_batches(pages.sparkSession)
    spark, kind = pages.sparkSession, pages.select(id_col).schema[0].dataType
    top = f"{folder.rstrip('/')}/warc-{uuid.uuid4().hex}" if folder else scratch(spark, "warc")
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    sha = F.sha1(payload)
    told = pages.select(F.col(id_col).alias("id"), sha.alias("sha"), F.octet_length(payload).alias("bytes"))
    order = F.struct(F.col("id").isNull(), "id")
    again = told.filter(F.col("bytes") >= least_revisit).groupBy("sha").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = stored(again.select("sha", F.col("first.id").alias("first_id")), "payloads")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id")).cast("string")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), sha.alias("sha"))
    if small_enough(again, BROADCAST_DIGESTS):
        planned = base.join(F.broadcast(again), "sha", "left")
    else:  # payloads are shuffled once, by id and digest, of which no pair is hot
        pairs = told.join(again, "sha").filter(~F.col("id").eqNullSafe(F.col("first_id"))).select("id", "sha", "first_id").distinct()
        planned = base.join(pairs, base["id"].eqNullSafe(pairs["id"]) & (base["sha"] == pairs["sha"]), "left").select(base["id"], "url", "payload", base["sha"], "first_id")
    planned = planned.select(F.col("id").cast("string").alias("page_id"), "url", "payload", "sha", refers.alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, path = _open(top)
        files.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, said, sha, refers_to in batch.itertuples(index=False):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    digest = base32_sha1(sha)
                    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                    member = packer.compress(record(page_id, url, said, digest, refers_to)) + packer.flush()
                    out.write(member)
                    rows.append((page_id, url, digest, "response" if refers_to is None else "revisit", refers_to, f"{top}/{name}", at, len(member)))
                    at += len(member)
                yield pd.DataFrame(rows, columns=["page_id", "url", "digest", "record_type", "refers_to", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    index = planned.mapInPandas(write, INDEX)
    return stored(index.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}), "warc-index")


def coalesced(places: list[tuple[int, int]]) -> list[tuple[int, int, list[int]]]:
    """Sorted (offset, length) as reads: start, end, and the places in each."""
    reads: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(places):
        if reads and offset - reads[-1][1] <= GAP_BYTES and offset + length - reads[-1][0] <= READ_BYTES:
            start, end, held = reads[-1]
            held.append(i)
            reads[-1] = (start, max(end, offset + length), held)
        else:
            reads.append((offset, offset + length, [i]))
    return reads


def read_records(index: DataFrame) -> DataFrame:
    """The records that the rows of ``index`` name, as ``RECORD`` with the ids' own type; a row named twice is read twice."""
    kind = index.schema["page_id"].dataType

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, rows in batch.groupby("file", sort=False):
                files, path = _open(file)
                places = list(zip(rows["offset"].tolist(), rows["length"].tolist()))
                with files.open_input_file(path) as source:
                    for start, end, held in coalesced(places):
                        data = source.read_at(end - start, start)
                        found = [parsed(zlib.decompress(data[places[i][0] - start : sum(places[i]) - start], 31)) for i in held]
                        yield pd.DataFrame(found, columns=["page_id", "url", "digest", "record_type", "refers_to", "payload"])

    size = index.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK_BYTES))
    near = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    found = near.mapInPandas(read, RECORD)
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


@F.pandas_udf(T.StringType())
def digest_of(payloads: pd.Series) -> pd.Series:
    import hashlib

    return pd.Series([None if p is None else base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads], dtype=object)


def read_back(index: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of the selected records.

    The digest of a response is computed from its payload.  A revisit takes
    both from the response that it refers to, which must be selected too.
    """
    found = stored(
        read_records(index).select("page_id", "url", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("own_bytes"), digest_of("payload").alias("own_digest"), "digest"),
        "warc-read",
    )
    full = found.filter("record_type = 'response'").select("page_id", "url", F.col("own_bytes").alias("payload_bytes"), F.col("own_digest").alias("payload_digest"), "record_type", "refers_to")
    whose = full.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("digest"), "payload_bytes", "payload_digest").distinct()
    revisits = found.filter("record_type = 'revisit'").join(whose, ["refers_to", "digest"], "left")
    return full.unionByName(revisits.select(*full.columns))


#: DuckDB SQL for the contract's columns; base32 is taken from the digest's bits.
ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages
), bits AS (
  SELECT sha, array_to_string(list_transform(string_split(sha, ''), lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', c)]), '') AS b
  FROM (SELECT DISTINCT sha FROM p)
), named AS (
  SELECT sha, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + list_sum(list_transform(range(5), lambda j: (substr(b, (5 * i + j + 1)::BIGINT, 1) = '1')::INT * [16, 8, 4, 2, 1][j + 1])))::BIGINT, 1)), '') AS payload_digest FROM bits
), firsts AS (
  SELECT sha, min(page_id) AS first_id FROM p GROUP BY sha
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN named USING (sha) JOIN firsts USING (sha)
"""
