"""Exact repeated substrings, removed by a column-wise Burrows-Wheeler construction.

Every window of ``PASSAGE`` bytes has an anchor, the least hash of its grams,
which depends on nothing but the window.  So equal windows have equal anchors,
and windows need to be compared only with those of the same anchor.  The
passage around an anchor that occurs more than once is a row of a collection;
the rows of an anchor are aligned at it.

A task builds the collections that it gets column by column, from the right:
each round inserts one symbol for each row - in the order of the rows those
symbols are the round's part of the collection's Burrows-Wheeler transform -
re-sorts the rows stably by them, and updates the common prefixes of neighbours
from those of the round before.  A string is repeated where a neighbour shares
so many bytes: ``LENGTH`` for what is removed, ``PASSAGE`` for what is only
reported.  The columns of a chunk are read one after the other and dropped;
what stays are an order and a common prefix for each row.

An anchor of many passages is split by the bytes around it: its passages are
cut into narrower pieces, keyed by the bytes that all windows of a piece share,
and equal pieces are one row with a count.  A key that still has many unlike
pieces is split again, down to pieces of one window, where those that are left
have nothing in common to look for.  So no collection has more than
``HOT_ANCHOR`` rows, whether they come from many texts or from one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.lineage import stored
from rayloom.llm.common import maybe_broadcast, modest_batches

#: Bytes of a repeated string that is removed, of one that is reported, and of the grams that anchors are chosen from.
LENGTH, PASSAGE, GRAM = 400, 256, 24
#: Bytes of text that are hashed at once; the positions in them must fit 24 bits.
SHARD_BYTES = 1 << 20
LONGEST_SHARD = 1 << 23
#: Rows of the collections that a task builds at once.
CHUNK_ROWS = 20_000
#: Most rows of a collection, what a task builds at once; an anchor of more passages, and a key of more unlike pieces, is split.  The result is the same.
HOT_ANCHOR = CHUNK_ROWS
#: Windows of a piece at each split: the distances of their starts to the anchor lie between two multiples of it.
PIECES = (64, 8, 1)
#: Bytes of passages in a batch, about.
BATCH_BYTES = 8 << 20
#: Rows of 40 bytes that are broadcast to be joined back; more are joined by shuffle.
BROADCAST_SPANS = 100_000

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64((1 << 24) - 1)


def raw_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_FACTOR), n, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position, by doubling."""
    h = [data.astype(np.uint64) + np.uint64(1)]
    for k in range(4):
        n = 1 << k
        h.append(h[-1][:-n] + h[-1][n:] * _power(n))
    grams = h[4][: len(data) - GRAM + 1] + h[3][16 : len(data) - GRAM + 17] * _power(16)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    return grams ^ (grams >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window of ``width``."""
    least, n = values, 1
    while 2 * n <= width:
        least = np.minimum(least[:-n], least[n:])
        n *= 2
    return np.minimum(least[: len(values) - width + 1], least[width - n :]) if n < width else least


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """``text, hash, at, low, high`` of every anchor: its text, place, and the first and last window that it is the anchor of.

    Places are in the text.  A text longer than ``LONGEST_SHARD`` is cut into
    overlapping parts, so that every window lies in one of them.
    """
    parts = []
    for i, text in enumerate(texts):
        step = LONGEST_SHARD - PASSAGE + 1
        for at in range(0, max(1, len(text) - PASSAGE + 1), step):
            if len(part := text[at : at + LONGEST_SHARD]) >= PASSAGE:
                parts.append((i, at, part))
    found: list[tuple[np.ndarray, ...]] = []
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for k, part in enumerate(parts):
        held.append(part)
        size += len(part[2])
        if k + 1 == len(parts) or size + len(parts[k + 1][2]) > SHARD_BYTES:
            found.append(_anchors(held))
            held, size = [], 0
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*found))


def _anchors(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    grams = gram_hashes(data)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_least(keys, PASSAGE - GRAM + 1) & _PLACE).astype(np.int64)
    ends = np.cumsum([len(p[2]) for p in parts])
    starts = ends - [len(p[2]) for p in parts]
    windows = np.concatenate([np.arange(s, e - PASSAGE + 1) for s, e in zip(starts, ends)])
    owner = np.repeat(np.arange(len(parts)), ends - starts - PASSAGE + 1)
    at = place[windows]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 0) | (np.diff(owner) != 0))))
    last = np.concatenate((first[1:], [len(at)])) - 1
    own, shift = owner[first], np.array([p[1] for p in parts])[owner[first]] - starts[owner[first]]
    return np.array([p[0] for p in parts])[own], grams[at[first]].view(np.int64), at[first] + shift, windows[first] + shift, windows[last] + shift


@F.pandas_udf(T.ArrayType(T.LongType()))
def anchor_hashes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The anchors' hashes of each text, in order of place."""
    for batch in batches:
        texts = [raw_bytes(t) for t in batch]
        owner, hashes, *_ = anchors(texts)
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
        yield pd.Series([hashes[a:b] for a, b in zip(cuts, cuts[1:])], dtype=object)


PASSAGES = "node binary, hash bigint, bytes binary, lead int, last int, at array<bigint>"


def contexts_of(text: bytes, wanted: set[int]) -> list[tuple[int, bytes, int, int, list[int]]]:
    """``hash, bytes, lead, last, at``: the passages around the wanted anchors, each distinct one once, with all its places.

    ``lead``: bytes before the anchor; ``last``: the last window of the anchor.
    The bytes go on to the end of a string of ``LENGTH`` from there, or of the text.
    """
    met: dict[tuple[int, int, int, bytes], list[int]] = {}
    _, hashes, at, low, high = anchors([text])
    for h, a, lo, hi in zip(hashes.tolist(), at.tolist(), low.tolist(), high.tolist()):
        if h in wanted:
            met.setdefault((h, a - lo, hi - lo, text[lo : hi + LENGTH]), []).append(lo)
    return [(h, said, lead, last, places) for (h, lead, last, said), places in met.items()]


def passages_of(texts: DataFrame) -> DataFrame:
    """``PASSAGES`` of texts (``node, text, wanted``), a row a passage, and ``n`` places of each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PASSAGES.split(", ")]
        held, size = [], 0
        for batch in batches:
            for node, text, wanted in zip(batch["node"], batch["text"], batch["wanted"]):
                for row in contexts_of(raw_bytes(text), set(wanted.tolist())):
                    held.append((node, *row))
                    size += len(row[1]) + 8 * len(row[4])
                    if size >= BATCH_BYTES:
                        yield pd.DataFrame(held, columns=names)
                        held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=names)

    return texts.select("node", "text", "wanted").mapInPandas(cut, PASSAGES).withColumn("n", F.size("at").cast("long"))


def repeated_windows(rows: list[bytes], lead: np.ndarray, group: np.ndarray, lengths_of: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each length, the first and last start of a string of it that another row of the group shares; -1 for none.

    Rows are sorted by group and aligned at ``lead``; only starts up to there count.
    """
    n = len(rows)
    lengths = np.array([len(r) for r in rows])
    offsets = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(rows), np.uint8)
    spans = [(np.full(n, -1), np.full(n, -1)) for _ in lengths_of]
    order = np.arange(n)
    common = np.zeros(n + 1, np.int64)  # of each row, in order, with the one before
    for column in range(int((lengths - lead).max()) - 1, -int(lead.max()) - 1, -1):
        window = lead[order] + column
        inside = (window >= 0) & (window < lengths[order])
        symbol = np.where(inside, data[np.where(inside, offsets[order] + window, 0)].astype(np.int64) + 1, 0)
        key = group[order] * 257 + symbol
        turn = np.argsort(key, kind="stable")
        key = key[turn]
        same = np.flatnonzero((key[1:] == key[:-1]) & (symbol[turn[1:]] > 0)) + 1
        fresh = np.zeros(n + 1, np.int64)
        if len(same):
            between = np.empty(2 * len(same), np.int64)
            between[::2], between[1::2] = turn[same - 1] + 1, turn[same] + 1
            fresh[same] = np.minimum.reduceat(common, between)[::2] + 1
        order, common = order[turn], fresh
        if column <= 0:
            shared = np.maximum(common[:-1], common[1:])
            for (least, most), length in zip(spans, lengths_of):
                row = order[shared >= length]
                at = lead[row] + column
                row, at = row[at >= 0], at[at >= 0]
                least[row] = at
                most[row] = np.where(most[row] < 0, at, most[row])
    return spans


SPANS = "node binary, start bigint, end bigint, long boolean"


def repeated_spans(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeated spans (``node, start, end, long``) of whole collections (``node, hash, bytes, lead, last, at, n``), sorted by hash.

    ``n``: how often the row stands; ``long``: of ``LENGTH`` bytes, else of ``PASSAGE``.
    """
    hashes = rows["hash"].to_numpy()
    group = np.cumsum(np.concatenate(([0], np.diff(hashes) != 0)))
    sizes = np.bincount(group)[group]
    said, lead, places, last = rows["bytes"].tolist(), rows["lead"].to_numpy(np.int64), rows["at"].tolist(), rows["last"].to_numpy(np.int64)
    many, own = np.flatnonzero(sizes > 1), rows["n"].to_numpy() > 1
    found = repeated_windows([said[i] for i in many], lead[many], group[many] - group[many[0]], (LENGTH, PASSAGE)) if len(many) else [(np.empty(0), np.empty(0))] * 2
    held = np.array([len(x) for x in said])
    out, node = [], rows["node"].tolist()
    for (low, high), length in zip(found, (LENGTH, PASSAGE)):
        least, most = np.full(len(rows), -1), np.full(len(rows), -1)
        least[many], most[many] = low, high
        whole = own & (held >= length)
        least[whole], most[whole] = 0, np.minimum(last, held - length)[whole]
        out += [(node[i], p + least[i], p + most[i] + length, length == LENGTH) for i in np.flatnonzero(least >= 0) for p in places[i]]
    return pd.DataFrame(out, columns=["node", "start", "end", "long"])


def spans_of_collections(passages: DataFrame) -> DataFrame:
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size >= CHUNK_ROWS:
                rows = pd.concat(held, ignore_index=True)
                cut = int(np.searchsorted(rows["hash"].to_numpy(), rows["hash"].iloc[-1]))
                if cut:
                    yield repeated_spans(rows.iloc[:cut])
                held, size = [rows.iloc[cut:]], len(rows) - cut
        if held:
            yield repeated_spans(pd.concat(held, ignore_index=True))

    return passages.select("node", "hash", "bytes", "lead", "last", "at", "n").repartition("hash").sortWithinPartitions("hash").mapInPandas(scan, SPANS)


def pieces_of(passages: DataFrame, width: int) -> DataFrame:
    """``node, at, hash, piece, bytes, lead, last, n``: passages cut by the distance of windows to the anchor.

    The new ``hash`` is that of the anchor, the distance and the bytes that all
    windows of such a piece hold, so equal windows stay under one key.
    ``piece`` tells unlike pieces apart.
    """
    far = F.explode(F.sequence(F.floor((F.col("lead") - F.col("last")) / width), F.floor(F.col("lead") / width)))
    near = (F.col("lead") - F.col("far") * width).cast("int")
    cut = passages.withColumn("far", far).withColumn("near", near)
    cut = cut.withColumns({"first": F.greatest(F.lit(0), F.col("near") - (width - 1)), "final": F.least("last", "near"), "core": F.substring(F.col("bytes"), F.col("near") + 1, F.lit(PASSAGE - width + 1))})
    said = F.substring(F.col("bytes"), F.col("first") + 1, F.col("final") - F.col("first") + LENGTH)
    lead, last = F.col("lead") - F.col("first"), F.col("final") - F.col("first")
    told = cut.select("node", F.transform("at", lambda a: a + F.col("first")).alias("at"), F.xxhash64("hash", "far", "core").alias("hash"), said.alias("bytes"), lead.alias("lead"), last.alias("last"), "n")
    mark = F.unhex(F.md5(F.concat(F.concat_ws(":", "hash", "lead", "last").cast("binary"), F.lit(b":"), F.col("bytes"))))
    return told.withColumn("piece", mark)


def spans_of_hot(passages: DataFrame, widths: tuple[int, ...] = PIECES) -> DataFrame:
    """The same as :func:`spans_of_collections`, for anchors of any frequency: no task gathers an anchor."""
    cut = pieces_of(passages, widths[0])
    held = stored(cut.groupBy("hash", "piece").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("bytes", "lead", "last")]), "pieces")
    keys = stored(held.groupBy("hash").agg(F.count("*").alias("unlike"), F.sum("n").alias("n")).filter("n > 1").select("hash", "unlike"), "piece-keys")
    rows = held.withColumnRenamed("piece", "node").withColumn("at", F.array(F.lit(0).cast("long")))
    if len(widths) == 1:  # the rows of a key share their only window, and unlike ones nothing longer
        met = rows.join(keys.select("hash"), "hash")
        of = lambda length: F.struct(F.lit(0).cast("long").alias("start"), F.lit(length).cast("long").alias("end"), F.lit(length == LENGTH).alias("long"))
        both = F.when((F.col("n") > 1) & (F.length("bytes") >= LENGTH), F.array(of(PASSAGE), of(LENGTH))).otherwise(F.array(of(PASSAGE)))
        found = met.select("node", F.inline(both))
    else:
        found = spans_of_collections(rows.join(keys.filter(F.col("unlike") <= HOT_ANCHOR).select("hash"), "hash"))
        crowded = keys.filter(F.col("unlike") > HOT_ANCHOR).select("hash")
        if not crowded.isEmpty():
            found = found.unionByName(spans_of_hot(stored(rows.join(crowded, "hash"), "crowded"), widths[1:]))
    found = stored(found, "piece-spans").withColumnRenamed("node", "piece")
    places = cut.select("node", "piece", F.explode("at").alias("at"))
    common = stored(held.filter(F.col("n") > HOT_ANCHOR).select("piece"), "common-pieces")  # one of them is in many texts: joined where those are
    met = places.join(maybe_broadcast(found.join(common, "piece"), BROADCAST_SPANS), "piece")
    rare = places.join(maybe_broadcast(common, BROADCAST_SPANS), "piece", "left_anti").join(found.join(common, "piece", "left_anti"), "piece")
    return met.unionByName(rare).select("node", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "long")


def merged(spans: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


SETTLED = T.StructType(
    [
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("n_shared", T.LongType()),
        T.StructField("gone", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


@F.pandas_udf(SETTLED)
def settled(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """What the repeated spans of a text come to: bytes to remove, runs of them, bytes shared, and the runs."""
    for batch in batches:
        rows = []
        for spans in batch:
            gone = merged([(s["start"], s["end"]) for s in spans if s["long"]])
            shared = merged([(s["start"], s["end"]) for s in spans])
            rows.append((sum(b - a for a, b in gone), len(gone), sum(b - a for a, b in shared), [dict(start=a, end=b) for a, b in gone]))
        yield pd.DataFrame(rows, columns=SETTLED.names)


@F.pandas_udf(T.BinaryType())
def cut_out(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The bytes of a text that none of the runs holds."""
    for texts, runs in batches:
        rows = []
        for text, gone in zip(texts, runs):
            data = raw_bytes(text)
            edges = [0, *(x for s in gone for x in (s["start"], s["end"])), len(data)]
            rows.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        yield pd.Series(rows, dtype=object)


def _node(text: Column, name: Column) -> tuple[Column, Column]:
    """Digests of the text, and of the text with the row's id."""
    key = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return key, F.unhex(F.md5(F.concat(key, F.coalesce(name.cast("string"), F.lit("null")).cast("binary"))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, n_shared, kept, kept_sha256`` of every row of ``docs``.

    Strings of ``LENGTH`` bytes that start anywhere else are removed; ``kept``
    holds the remaining bytes, or null where nothing was removed and the text
    stays as it is.  ``kept_sha256`` is the digest of the remaining bytes in
    either case.  ``n_shared``: bytes in strings of ``PASSAGE`` bytes that
    start anywhere else, removed or not, so that passages too short to be
    removed are seen.

    A null text is empty.  Rows with equal texts of ``LENGTH`` bytes or more
    repeat each other and lose everything, null ids and repeated rows
    included.  Texts of any length are whole; a task holds about 20 bytes a
    byte of its longest text.  An empty table gives no rows;
    other columns are ignored.
    """
    modest_batches(docs.sparkSession)
    key, node = _node(F.col(text_col), F.col(id_col))
    whole = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    measured = stored(
        docs.select(F.col(id_col).alias("doc_id"), key.alias("key"), node.alias("node"), F.octet_length(whole).cast("long").alias("n_bytes"), F.sha2(whole, 256).alias("sha"), anchor_hashes(F.col(text_col)).alias("hashes")),
        "measured",
    )
    copies = measured.groupBy("key").agg(F.count("*").alias("copies"), F.min("node").alias("first"))
    facts = stored(measured.join(copies, "key").withColumn("hashes", F.when(F.col("node") == F.col("first"), F.col("hashes"))).drop("first"), "facts")
    entries = facts.filter("hashes IS NOT NULL").select("key", F.posexplode("hashes").alias("nth", "hash"))
    place = F.struct("key", "nth")
    often = entries.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).filter("low != high").select("hash")
    often = stored(often, "anchors")
    in_texts = facts.filter("hashes IS NOT NULL").select("node", F.explode(F.array_distinct("hashes")).alias("hash"))
    wanted = in_texts.join(often, "hash").groupBy("node").agg(F.collect_list("hash").alias("wanted"))
    texts = docs.select(_node(F.col(text_col), F.col(id_col))[1].alias("node"), F.col(text_col).alias("text"))
    passages = stored(passages_of(texts.join(stored(wanted, "wanted"), "node")), "passages")
    hot = stored(passages.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ANCHOR).select("hash"), "hot")
    if hot.isEmpty():
        spans = spans_of_collections(passages)
    else:
        hot = maybe_broadcast(hot, BROADCAST_SPANS)
        spans = spans_of_collections(passages.join(hot, "hash", "left_anti")).unionByName(spans_of_hot(stored(passages.join(hot, "hash"), "hot-passages")))
    alone = (F.col("copies") == 1) | (F.col("n_bytes") < PASSAGE)
    gone = spans.groupBy("node").agg(F.collect_list(F.struct("start", "end", "long")).alias("spans"))
    met = stored(facts.filter(alone).drop("hashes", "key").join(gone, "node", "left").withColumn("s", settled(F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,long:boolean>>")))).drop("spans"), "met")
    cut = (
        texts.join(met.filter("s.n_removed > 0"), "node")
        .withColumn("kept", cut_out("text", "s.gone"))
        .select("doc_id", "n_bytes", "s.n_removed", "s.n_spans", "s.n_shared", "kept", F.sha2("kept", 256).alias("kept_sha256"))
    )
    same = met.filter("s.n_removed = 0").select("doc_id", "n_bytes", "s.n_removed", "s.n_spans", "s.n_shared", F.lit(None).cast("binary").alias("kept"), F.col("sha").alias("kept_sha256"))
    none, nothing, lost = F.lit(0).cast("long"), hashlib.sha256(b"").hexdigest(), F.col("n_bytes") >= LENGTH
    copied = facts.filter(~alone).select(
        "doc_id",
        "n_bytes",
        F.when(lost, F.col("n_bytes")).otherwise(none).alias("n_removed"),
        F.when(lost, F.lit(1).cast("long")).otherwise(none).alias("n_spans"),
        F.col("n_bytes").alias("n_shared"),
        F.when(lost, F.lit(b"")).alias("kept"),
        F.when(lost, F.lit(nothing)).otherwise(F.col("sha")).alias("kept_sha256"),
    )
    return same.unionByName(cut).unionByName(copied)
