"""Mixing sources to target weights by weighted sampling without replacement.

Every document gets an exponential key ``-ln(u) / w`` (Efraimidis and
Spirakis), ``w`` its quality weight and ``u`` a number in (0, 1) that only its
id and the seed decide.  Within a source documents are taken in key order
until the running sum of their sizes meets the source's budget.  A budget
beyond a source's size takes whole epochs first and samples the rest.

All of it is DataFrame functions.  No source is sorted: its keys have places on
a fixed scale, and sums of sizes by (source, place) tell where its budget ends,
first to one of ``STEPS`` ranges of places, then to one of ``STEPS`` places in
it.  Documents before that place are taken, those after it aren't; only those
at it, one in ``STEPS`` squared or so, are ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rayloom.llm.common import WORD, key_of, maybe_broadcast, stored

#: Ranges of the scale of keys, and places in a range.
STEPS = 4096
#: Rows of numbers, one for each source, that are broadcast; more are joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*columns: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(2.0**52)


def default_quality(size: Column, length: Column) -> Column:
    """A weight in [0.1, 1]: short texts and odd word lengths count less."""
    mean = length / F.greatest(size, F.lit(1))
    fits = F.when((mean >= 4) & (mean <= 12), F.lit(1.0)).otherwise(F.lit(0.5))
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), size / F.lit(50.0)) * fits)


def source_targets(sizes: DataFrame, weights: Sequence[float], total_share: float = 1.0, cap: float = 3.0) -> DataFrame:
    """Targets of (skey, source_size): shares by weight, at most ``cap`` times the size.

    Weights repeat over the sources in the order of ``skey``.  What a capped
    source can't take goes to the others by weight until none is above its
    cap; that fixed point is ``min(cap_i, level * w_i)``, found in one pass
    over the sources sorted by ``cap_i / w_i``.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    every = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("nth", F.row_number().over(every.orderBy("skey")) - 1).select(
        "skey",
        "source_size",
        F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * F.lit(float(cap))).alias("most"),
    )
    order = every.orderBy(F.col("most") / F.col("weight"), "skey")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    share = F.sum("source_size").over(every) * F.lit(float(total_share))
    level = (share - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level).withColumn("free", F.col("most") >= F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("skey"), F.col("level")))).over(every)
    return leveled.withColumn("held", first["level"]).select(
        "skey", "source_size", "weight", F.when(F.col("held").isNull(), F.col("most")).otherwise(F.least("most", F.col("held") * F.col("weight"))).alias("target")
    )


def keyed(docs: DataFrame, id_col: str, source_col: str, text_col: str, quality: Column | None, seed: int, carried: Column | None = None) -> DataFrame:
    """``doc_id, source, skey, size, quality, key, place`` of every row, and ``carried``, an expression on ``docs``, as ``row``."""
    more = [] if carried is None else [carried.alias("row")]
    names = ["row"] if more else []
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), *more).withColumn("size", word_count(F.col("text")))
    weight = default_quality(F.col("size"), F.length("text")) if quality is None else F.greatest(F.lit(1e-6), F.coalesce(F.nanvl(quality.cast("double"), F.lit(0.0)), F.lit(0.0)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce("text", F.lit("")))))
    told = base.select(*names, "doc_id", "source", key_of(F.col("source")).alias("skey"), "size", weight.alias("quality"), (-F.log(uniform(F.lit(seed), name)) / weight).alias("key"))
    place = F.floor(F.col("key") / (1 + F.col("key")) * STEPS * STEPS)
    return told.withColumn("place", F.least(F.lit(STEPS * STEPS - 1), place).cast("int"))


def _crossed(sums: DataFrame, at: str) -> DataFrame:
    """Of the sums of a source's sizes by ``at``, the row in which its budget ``left`` ends, with the words ``before`` it."""
    order = Window.partitionBy("skey").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    run = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("words").over(order), F.lit(0)))
    return run.filter((F.col("before") < F.col("left")) & (F.col("left") <= F.col("before") + F.col("words"))).drop("words")


def budgets(rows: DataFrame, weights: Sequence[float], total_share: float, cap: float) -> DataFrame:
    """``skey, source_size, target, epochs, left, cut, before``: whole passes over each source, words left for the last one, the place in which they end, and the words before it."""
    ranges = stored(rows.groupBy("skey", F.floor(F.col("place") / STEPS).cast("int").alias("range")).agg(F.sum("size").alias("words")), "ranges")
    targets = source_targets(ranges.groupBy("skey").agg(F.sum("words").alias("source_size")), weights, total_share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.select("skey", "source_size", "target", epochs.alias("epochs"), F.round(F.col("target") - epochs * F.col("source_size")).cast("long").alias("left"))
    plan = stored(plan, "targets")
    coarse = _crossed(ranges.join(plan.select("skey", "left"), "skey").withColumn("before", F.lit(0).cast("long")), "range")
    coarse = maybe_broadcast(stored(coarse.select("skey", F.col("range").alias("within"), "left", "before"), "range-cuts"), BROADCAST_SOURCES)
    places = rows.join(coarse, "skey").filter(F.floor(F.col("place") / STEPS) == F.col("within")).groupBy("skey", "place", "left", "before").agg(F.sum("size").alias("words"))
    fine = _crossed(places, "place").select("skey", F.col("place").alias("cut"), "before")
    return stored(plan.join(fine, "skey", "left").withColumns({"cut": F.coalesce("cut", F.lit(-1)), "before": F.coalesce("before", F.lit(0).cast("long"))}), "budgets")


def taken_of(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the plan of their source, and ``partial``: the words of the last pass over each."""
    met = rows.join(maybe_broadcast(plan, BROADCAST_SOURCES), "skey")
    sure = met.filter("place != cut").withColumn("partial", F.when(F.col("place") < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long")))
    order = Window.partitionBy("skey").orderBy("key", F.col("doc_id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    run = F.col("left") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = met.filter("place = cut").withColumn("partial", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), run)))
    return sure.unionByName(edge)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (1, 2, 3),
    quality: Column | None = None,
    total_share: float = 1.0,
    cap: float = 3.0,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """One row per document of ``docs`` with what the mix takes of it.

    Returns ``doc_id, source, size, quality, source_size, target, epochs,
    partial, taken``: ``epochs`` whole passes plus the first ``partial`` words
    of the document; ``taken`` is the sum in words.

    Null or empty text has size 0 and is never taken.  A null source is a
    source of its own, last in order.  A row with a null id gets its key from
    its text; rows that are alike in id and text are interchangeable.  Equal
    keys are ordered by id.  A ``quality`` that is null, NaN or below 1e-6
    counts as 1e-6.  A very long text is counted whole.  An empty table gives
    no rows.  Columns other than
    id, source and text are ignored, whatever their names.
    """
    rows = stored(keyed(docs, id_col, source_col, text_col, quality, seed), "mix")
    mixed = taken_of(rows, budgets(rows, weights, total_share, cap))
    return mixed.select("doc_id", "source", "size", "quality", "source_size", "target", "epochs", "partial", (F.col("epochs") * F.col("size") + F.col("partial")).alias("taken"))


def first_words(text: Column, words: Column) -> Column:
    """The text up to the end of its ``words``-th word."""
    parts = F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.greatest(words, F.lit(0)).cast("int"))
    return F.array_join(parts, "")


def mix_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (1, 2, 3),
    quality: Column | None = None,
    total_share: float = 1.0,
    cap: float = 3.0,
    seed: int = 42,
) -> DataFrame:
    """The mixed corpus: each document once per epoch, complete epochs before the sampled one.

    Adds ``epoch`` (from 1; ``mix_epoch`` or ``mix_epoch_2`` and so on where
    that name is taken) to the columns of ``docs``; the last pass over a
    document holds its first words only, where the budget ends within it.
    Edge cases are those of :func:`mix_sources`.  Texts stay where they are:
    what a row gives follows from its own key and its source's budget.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = keyed(docs, id_col, source_col, text_col, quality, seed, carried=row)
    plan = budgets(stored(rows.select("skey", "size", "place"), "mix"), weights, total_share, cap)
    whole = F.struct(F.lit(None).cast("long").alias("words"))
    last = F.array(F.struct(F.when(F.col("partial") < F.col("size"), F.col("partial")).alias("words")))
    passes = F.concat(F.array_repeat(whole, F.col("epochs").cast("int")), F.when(F.col("partial") > 0, last).otherwise(F.array().cast("array<struct<words:bigint>>")))
    each = taken_of(rows, plan).filter("size > 0").select("row", F.posexplode(passes).alias("nth", "pass"))
    text = F.when(F.col("pass.words").isNull(), F.col("row")[text_col]).otherwise(first_words(F.col("row")[text_col], F.col("pass.words")))
    taken, name = {c.lower() for c in docs.columns}, "epoch"
    for n in range(1, len(taken) + 2):
        if name in taken:
            name = "mix_epoch" if n == 1 else f"mix_epoch_{n}"
    return each.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns], (F.col("nth") + 1).cast("long").alias(name))


#: DuckDB SQL for the contract's columns; it shares the keys, not the plan.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(length(text), 0) AS chars,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents
), k AS (
  SELECT doc_id, size, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS skey,
         -ln(u) / greatest(0.1, least(1.0, size / 50.0::DOUBLE)
           * CASE WHEN chars::DOUBLE / greatest(size, 1) BETWEEN 4 AND 12 THEN 1.0 ELSE 0.5 END)::DOUBLE AS key
  FROM d
), s AS (
  SELECT skey, sum(size)::BIGINT AS source_size, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1]::DOUBLE AS w
  FROM k GROUP BY skey
), l AS (
  SELECT *, source_size * 3.0::DOUBLE AS most,
         ((sum(source_size) OVER ())::DOUBLE
           - coalesce((sum(source_size * 3.0::DOUBLE) OVER (ORDER BY source_size * 3.0::DOUBLE / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 0))
         / sum(w) OVER (ORDER BY source_size * 3.0::DOUBLE / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT skey, source_size,
         coalesce(least(most, (SELECT arg_min(level, (most / w, skey)) FROM l WHERE most >= level * w) * w), most)::DOUBLE AS target
  FROM l
), p AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(k.size) OVER (PARTITION BY k.skey ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM k JOIN t USING (skey)
)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken
FROM p
"""
