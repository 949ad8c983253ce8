"""Near-duplicate documents by min-max hashing.

A document is the set of its distinct five-word shingles.  Each permutation is
evaluated once per shingle and both its minimum and its maximum are kept, so
75 evaluations give 150 signature values.  Bands of five values find
candidates; a link counts only if the full sets confirm it.

With 30 bands a pair at Jaccard 0.85 is missed with probability 2e-8.  In each
band's bucket the least key is the root, and the documents that share a bucket
with a root are its group.  A group of up to ``SMALL_GROUP`` documents is
compared inside one task.  A larger one is never compared pair by pair: with
``D(x)`` the difference of ``x`` to any pivot set and
``f(x) = 37 |D(x)| - 3 |x|``, two sets have a Jaccard of at least 0.85 exactly
if ``f(x) + f(y) <= 74 |D(x) & D(y)|``.  The document of least ``f`` is linked
with all that need no common difference, which joins them; what is left must
share differences, and those pairs come from an index of the rarest ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.lineage import stored
from rayloom.llm.common import maybe_broadcast, modest_batches
from rayloom.operators.graph import connected_components

SHINGLE_WORDS = 5
#: Rows of a band, bands, and permutations: half of the bands use minima, half maxima.
ROWS, BANDS = 5, 30
PERMUTATIONS = ROWS * BANDS // 2
#: Jaccard of a link, in hundredths.
LEAST_JACCARD = 85
#: Groups of at most so many documents are compared in one task; so many documents make a larger group's pivot.
SMALL_GROUP, PIVOT_DOCS = 24, 24
#: Keys of so many documents are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_KEYS = 200_000
#: Pivots of so many shingles, and centres of so many large groups, are broadcast, so that a group's members stay where they are.
BROADCAST_PIVOTS, BROADCAST_CENTRES = 1_000_000, 100_000
#: Bytes of text that a task hashes at once.
SHARD_BYTES = 1_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
_SEED = np.random.default_rng(20)
_WORD = np.uint64(0x9E3779B97F4A7C15)
_PLACES = _SEED.integers(1, 2**63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SCALES = _SEED.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _SEED.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64)
_BAND_PLACES = _SEED.integers(1, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each lowered text."""
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    inside = _IS_WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return [np.empty(0, np.uint64)] * len(texts)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _WORD))
    words = mixed(np.add.reduceat((raw[inside].astype(np.uint64) + np.uint64(1)) * powers[np.arange(int(lengths.sum())) - np.repeat(first, lengths)], first))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(starts, bounds)
    rolled = np.zeros(max(0, len(words) - SHINGLE_WORDS + 1), np.uint64)
    for k in range(SHINGLE_WORDS):
        rolled += words[k : k + len(rolled)] * _PLACES[k]
    rolled = mixed(rolled)
    found, at = [], 0
    for end in upto:
        n = end - at
        if n >= SHINGLE_WORDS:
            found.append(np.unique(rolled[at : end - SHINGLE_WORDS + 1]))
        elif n:
            found.append(mixed(np.array([(words[at:end] * _PLACES[:n]).sum(dtype=np.uint64) + np.uint64(n)])))
        else:
            found.append(np.empty(0, np.uint64))
        at = end
    return found


def min_max(sets: list[np.ndarray]) -> np.ndarray:
    """Band keys of sets that aren't empty: a row of ``BANDS`` each."""
    flat = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    least = np.empty((PERMUTATIONS, len(sets)), np.uint64)
    most = np.empty_like(least)
    for k in range(PERMUTATIONS):
        value = flat * _SCALES[k]
        value += _SHIFTS[k]
        value >>= np.uint64(24)
        np.minimum.reduceat(value, first, out=least[k])
        np.maximum.reduceat(value, first, out=most[k])
    signature = np.concatenate((least, most)).reshape(BANDS, ROWS, len(sets))
    keys = (signature * _BAND_PLACES[None, :, None]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)[:, None] * _WORD
    return mixed(keys).T.view(np.int64)


def shards(texts: list[str | None]) -> Iterator[list[bytes]]:
    """The lowered texts in order, in lists of about ``SHARD_BYTES``."""
    held, size = [], 0
    for text in texts:
        held.append(lowered(text))
        size += len(held[-1])
        if size >= SHARD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


SKETCH = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


@F.pandas_udf(SKETCH)
def sketches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: list[int] = []
        bands: list = []
        for shard in shards(list(batch)):
            sets = shingle_sets(shard)
            rows = iter(min_max(some) if (some := [s for s in sets if len(s)]) else ())
            counts += map(len, sets)
            bands += [next(rows) if len(s) else [] for s in sets]
        yield pd.DataFrame({"n_shingles": np.array(counts, np.int64), "bands": pd.Series(bands, dtype=object)})


@F.pandas_udf(T.ArrayType(T.LongType()))
def full_sets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield pd.Series([s.view(np.int64) for shard in shards(list(batch)) for s in shingle_sets(shard)], dtype=object)


def text_key(text: Column) -> Column:
    """16 bytes that tell apart texts which differ in more than the case of A-Z."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.unhex(F.md5(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()).cast("binary")))


def linked(a: np.ndarray, b: np.ndarray, least: int) -> bool:
    if 100 * min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= least * (len(a) + len(b) - both)


def spanning_links(keys: list[bytes], sets: list[np.ndarray], least: int) -> list[tuple[bytes, bytes]]:
    """Links that join what the links of a small group join."""
    lead, found = list(range(len(keys))), []

    def top(i: int) -> int:
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(keys)):
        for j in range(i + 1, len(keys)):
            if (p := top(i)) != (q := top(j)) and linked(sets[i], sets[j], least):
                lead[q] = p
                found.append((keys[i], keys[j]))
    return found


def small_group_links(members: DataFrame, least: int) -> DataFrame:
    """``a, b`` of groups of bounded size (``root, key, set``)."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> pd.DataFrame:
            found = []
            root, keys, sets = rows["root"].tolist(), rows["key"].tolist(), rows["set"].tolist()
            at = 0
            for i in range(1, len(root) + 1):
                if i == len(root) or root[i] != root[at]:
                    found += spanning_links(keys[at:i], sets[at:i], least)
                    at = i
            return pd.DataFrame(found, columns=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            rows = pd.concat([*held, batch], ignore_index=True)
            last = rows["root"].to_numpy() == rows["root"].iloc[-1]
            if not last.all():
                yield done(rows[~last])
            held = [rows[last]]
        if held:
            yield done(held[0])

    return members.repartition("root").sortWithinPartitions("root", "key").mapInPandas(scan, "a binary, b binary")


def pivots(sampled: DataFrame) -> DataFrame:
    """``root, pivot``: what more than half of a few sets (``root, key, set``) hold."""

    def common(rows: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(np.concatenate(rows["set"].tolist()), return_counts=True)
        return pd.DataFrame({"root": [rows["root"].iloc[0]], "pivot": [values[2 * counts > len(rows)]]})

    return sampled.groupBy("root").applyInPandas(common, "root binary, pivot array<bigint>")


def large_group_links(members: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """``a, b`` that join what the links of groups of any size join; ``members``: ``root, key``."""
    more, less = 100 - least, 100 + least  # a link: more * (|x| + |y|) >= less * |x ^ y|
    first = members.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy("key"))).filter(F.col("nth") <= PIVOT_DOCS).select("root", "key")
    pivot = maybe_broadcast(stored(pivots(first.join(sets, "key").select("root", "key", "set")), "pivots"), BROADCAST_PIVOTS, F.size("pivot"))
    differ = F.concat(F.array_except("set", "pivot"), F.array_except("pivot", "set"))
    apart = stored(
        members.join(sets, "key").join(pivot, "root").select("root", "key", differ.alias("diff"), F.size("set").alias("n")).withColumn("f", less * F.size("diff") - more * F.col("n")).drop("n"),
        "apart",
    )
    centre = stored(apart.groupBy("root").agg(F.min(F.struct("f", "key")).alias("c")), "centres").select("root", F.col("c.f").alias("least_f"), F.col("c.key").alias("centre"))
    placed = apart.join(maybe_broadcast(centre, BROADCAST_CENTRES), "root").withColumn("star", F.col("f") + F.col("least_f") <= 0)
    stars = placed.filter("star AND key != centre").select(F.col("centre").alias("a"), F.col("key").alias("b"))

    open_roots = stored(placed.filter("NOT star").select("root").distinct(), "open")
    rows = placed.join(maybe_broadcast(open_roots, BROADCAST_CENTRES), "root", "left_semi")
    entries = rows.select("root", "key", F.explode("diff").alias("e"))
    often = entries.groupBy("root", "e").agg(F.count("*").alias("n")).filter("n > 1")
    shared = entries.join(often, ["root", "e"]).groupBy("root", "key").agg(F.sort_array(F.collect_list(F.struct("n", "e"))).alias("common"))
    step = 2 * less
    reach = stored(rows.select("root", "key", "f", "star").join(shared, ["root", "key"]).withColumn("most", step * F.size("common") - F.col("f")), "reach")
    bounds = stored(reach.groupBy("root").agg(F.max("most").alias("most_all")), "bounds")
    live = reach.join(maybe_broadcast(bounds, BROADCAST_CENTRES), "root").filter("f <= most_all").drop("most_all")
    lowest = maybe_broadcast(stored(live.groupBy("root").agg(F.min("f").alias("low")), "lowest"), BROADCAST_CENTRES)
    need = F.greatest(F.lit(1), F.ceil((F.col("f") + F.col("low")) / step)).cast("int")
    live = stored(
        live.join(lowest, "root").withColumn("need", need).filter(F.col("need") <= F.size("common")).select("root", "key", "f", "star", F.col("common.e").alias("common"), "need"),
        "live",
    )
    prefix = F.slice("common", F.lit(1), F.size("common") - F.col("need") + 1)
    side = lambda df, s: df.select("root", F.posexplode(prefix).alias("at" + s, "e"), *[F.col(c).alias(c + s) for c in ("key", "f", "star")], F.size("common").alias("size" + s))
    rest = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))  # from the first common difference on, so many are common at most
    pairs = (
        side(live.filter("NOT star"), "_a")
        .join(side(live, "_b"), ["root", "e"])
        .filter((F.col("key_a") != F.col("key_b")) & (F.col("star_b") | (F.col("key_a") < F.col("key_b"))) & (F.col("f_a") + F.col("f_b") <= step * rest))
        .select("root", "key_a", "key_b", (F.col("f_a") + F.col("f_b")).alias("f"))
        .distinct()
    )
    of = lambda s: live.select("root", F.col("key").alias("key" + s), F.col("common").alias("common" + s))
    checked = pairs.join(of("_a"), ["root", "key_a"]).join(of("_b"), ["root", "key_b"]).filter(F.col("f") <= step * F.size(F.array_intersect("common_a", "common_b")))
    return stars.unionByName(checked.select(F.col("key_a").alias("a"), F.col("key_b").alias("b")))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_JACCARD) -> tuple[DataFrame, DataFrame]:
    """``doc_id, key, n_shingles`` of every row, and ``key, first_id, rows, all_rows, component_id, rep_key`` of every text with words.

    ``key`` stands for the text, ``first_id`` is its least id and ``rows`` the
    number of rows with text and that id, ``all_rows`` with any; ``component_id`` is the least id of
    the text's component, ``rep_key`` the text that has it.
    """
    modest_batches(docs.sparkSession)
    measured = stored(
        docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), sketches(F.col(text_col)).alias("s")).select("doc_id", "key", "s.*"),
        "sketches",
    )
    worded = measured.filter("n_shingles > 0")
    by_id = worded.groupBy("key", "doc_id").agg(F.count("*").alias("rows"))
    firsts = by_id.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rows")).alias("m"), F.sum("rows").alias("all_rows"))
    firsts = firsts.select("key", F.col("m.doc_id").alias("first_id"), F.col("m.rows").alias("rows"), "all_rows")
    firsts = stored(firsts, "firsts")
    unique = stored(worded.join(firsts.select("key", "first_id"), ["key"]).filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("key", "doc_id", "bands"), "unique")
    banded = unique.select("key", F.explode("bands").alias("band"))
    roots = banded.groupBy("band").agg(F.min("key").alias("root"), F.max("key").alias("last")).filter("root != last").select("band", "root")
    pairs = stored(banded.join(roots, "band").filter("key != root").select("root", "key").distinct(), "pairs")
    sized = stored(pairs.groupBy("root").agg((F.count("*") + 1).alias("n")), "groups")
    members = pairs.unionByName(sized.select("root", F.col("root").alias("key"))).join(sized, "root")
    wanted = members.select("key").distinct().join(unique.select("key", F.col("doc_id").alias("first_id")), "key").distinct()
    wanted = maybe_broadcast(stored(wanted, "wanted"), BROADCAST_KEYS)
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    sets = stored(texts.join(wanted, "key").filter(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("key", full_sets("text").alias("set")), "sets")
    small = small_group_links(members.filter(F.col("n") <= SMALL_GROUP).join(sets, "key").select("root", "key", "set"), least)
    large = large_group_links(members.filter(F.col("n") > SMALL_GROUP).select("root", "key"), sets, least)
    named = connected_components(small.unionByName(large))
    placed = firsts.join(named.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    heads = placed.groupBy("component").agg(F.min(F.struct(F.col("first_id").isNull().alias("no"), "first_id", "key")).alias("m"))
    return measured.drop("bands"), placed.join(heads, "component").select("key", "first_id", "rows", "all_rows", F.col("m.first_id").alias("component_id"), F.col("m.key").alias("rep_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_JACCARD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Words are lower-cased (A-Z) and split at ASCII white space.  A text of
    fewer than five words is one shingle; a null or wordless text has none and
    is linked with nothing.  ``component_id`` is the least id reachable over
    links, ``kept`` says that it is the row's own.  Null ids are larger than
    all others: such a row is kept if its whole component has null ids.
    Repeated rows share their result.  An empty table gives no rows; other
    columns are ignored.
    """
    rows, placed = components(docs, id_col, text_col, least)
    with_words = rows.filter("n_shingles > 0").join(placed.select("key", "component_id"), "key").select("doc_id", "n_shingles", "component_id")
    without = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_JACCARD) -> DataFrame:
    """``docs`` with one row of each component, and all rows without words; columns as they were.

    Of repeated rows, alike in id and text, one stays.  Only texts that another
    row repeats or is linked with are looked up; where they are few, no row
    moves.  Null ids, null texts and empty tables are as in
    :func:`near_duplicates`; columns may have any names.
    """
    _, placed = components(docs, id_col, text_col, least)
    decided = placed.filter("rep_key != key OR all_rows > 1").select("key", "rows", "component_id", "rep_key")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    keyed = docs.select(row, F.col(id_col).alias("own_id"), text_key(F.col(text_col)).alias("key"))
    met = keyed.join(maybe_broadcast(stored(decided, "decided"), BROADCAST_KEYS), "key", "left")
    stays = met.filter(F.col("rep_key").isNull() | ((F.col("key") == F.col("rep_key")) & F.col("own_id").eqNullSafe(F.col("component_id"))))
    often = F.coalesce(F.col("rows"), F.lit(1)) > 1
    return stays.filter(~often).select("row.*").unionByName(stays.filter(often).dropDuplicates(["key"]).select("row.*"))


#: DuckDB SQL for the contract's columns: every pair of documents that share a shingle.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * p.n >= 85 * (x.n + y.n - p.n)
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (
  SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id, d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
