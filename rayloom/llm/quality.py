"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document is measured once.  For every (language, source) a sketch holds
the distribution of each measure: the counts of logarithmic bins, so any
quantile comes back within a fixed relative error and two sketches merge by
adding counts.  A group's threshold is the quantile of its sketch at which a
cut explains most of the spread of its documents: good ones below, junk above,
the latter no more than half.
Before that each sketch is drawn towards that of its language, and this towards
that of all documents, by ``PRIOR_DOCS`` documents' weight, in groups of every
size alike: a group of junk alone still knows what others look like.  The
thresholds are joined back to filter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.llm.common import key_of, maybe_broadcast, modest_batches, stored

#: Characters that count as symbols: a fixed value of the rules.
SYMBOLS = "#*$%&|<>"
#: ASCII white space, as bytes.split() takes it.
BLANKS = " \t\n\r\x0b\x0c"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Ratio between bin edges of a sketch; quantiles are off by half of it at most, relatively.
GAMMA = 1.02
#: Documents that the sketch of the language, or of everything, weighs in that of a group.
PRIOR_DOCS = 100
#: Share of a measure's variance that the best cut must explain; else the group has no threshold for it.
LEAST_EXPLAINED = 0.7
#: Share of a group that a cut leaves at least: what most documents of a group have is its norm, not junk.
LEAST_LEFT = 0.5
#: Thresholds of up to so many groups are broadcast, more are joined by shuffle.
BROADCAST_GROUPS = 20_000

#: Measures with thresholds and the power of the value that is cut: counts per character spread as their square root, shares of a text evenly.
RULES = {"symbol_ratio": 0.5, "dup_line_ratio": 1.0, "repeat_word_ratio": 1.0}


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """The six measures of one whole text."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(seen := set(windows)) < len(windows):
        counts = Counter(windows)
        end = 0  # words before it are counted
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


@F.pandas_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([measure(t) for t in texts], columns=MEASURES).astype("int64")


def ratios() -> dict[str, Column]:
    """The measures that have thresholds, from the columns of ``measures``."""
    return {
        "symbol_ratio": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_word_ratio": F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    }


def bin_of(value: Column) -> Column:
    """Bin 0 holds values up to 1e-9, bin b those up to ``1e-9 * GAMMA**b``."""
    return F.when(value <= 1e-9, 0).otherwise(F.ceil(F.log(value / 1e-9) / math.log(GAMMA))).cast("int")


def sketch(measured: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """``keys, measure, bin, n``."""
    bins = [F.struct(F.lit(m).alias("measure"), bin_of(v).alias("bin")) for m, v in values.items()]
    return measured.select(*keys, F.inline(F.array(*bins))).groupBy(*keys, "measure", "bin").agg(F.count("*").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of coarser groups, or of several inputs: the counts of equal bins add up."""
    return sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], at: dict[str, float]) -> DataFrame:
    """``keys, measure, docs`` and a column for each quantile of ``at``."""
    ordered = Window.partitionBy(*keys, "measure").orderBy("bin")
    run = sketches.withColumn("upto", F.sum("n").over(ordered)).withColumn("docs", F.sum("n").over(Window.partitionBy(*keys, "measure")))
    value = F.when(F.col("bin") == 0, 0.0).otherwise(2e-9 * F.pow(F.lit(GAMMA), F.col("bin")) / (1 + GAMMA))
    return run.groupBy(*keys, "measure", "docs").agg(*[F.min(F.when(F.col("upto") >= F.col("docs") * q, value)).alias(name) for name, q in at.items()])


def drawn(sketches: DataFrame, keys: list[str], parents: DataFrame, parent_keys: list[str]) -> DataFrame:
    """``sketches`` with ``PRIOR_DOCS`` documents spread as in their parents (``parent_keys, measure, bin, share``), and each bin's ``share``."""
    groups = sketches.select(*keys, "measure").distinct()
    every = groups.join(parents, [*parent_keys, "measure"]).join(sketches, [*keys, "measure", "bin"], "left")
    weighed = every.select(*keys, "measure", "bin", (F.coalesce("n", F.lit(0)) + PRIOR_DOCS * F.col("share")).alias("weight"))
    return weighed.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy(*keys, "measure"))).drop("weight")


def cuts(shares: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, measure, bin, level, explained``: the last bin below the best cut, its quantile, and the share of the variance that it explains.

    What lies above a cut is summed from the far end, and the variance about
    the mean, so a bin's share may be as small as a double can be.  Where
    nothing varies nothing is explained, and nothing is cut.
    """
    power = F.element_at(F.create_map(*[F.lit(x) for pair in RULES.items() for x in pair]), F.col("measure"))
    group = Window.partitionBy(*keys, "measure")
    ordered = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = F.when(F.col("bin") == 0, 0.0).otherwise(F.pow(2e-9 * F.pow(F.lit(GAMMA), F.col("bin")) / (1 + GAMMA), power))
    run = shares.withColumn("x", x).withColumns(
        {
            "below": F.sum("share").over(ordered),
            "above": F.sum("share").over(group.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, -1)),
            "sum_below": F.sum(F.col("share") * F.col("x")).over(ordered),
            "mean": F.sum(F.col("share") * F.col("x")).over(group),
            "top": F.max("bin").over(group),
        }
    ).withColumn("spread", F.sum(F.col("share") * F.pow(F.col("x") - F.col("mean"), 2)).over(group))
    between = F.try_divide(F.pow(F.col("mean") * F.col("below") - F.col("sum_below"), 2), F.col("below") * F.col("above"))
    told = run.filter((F.col("bin") < F.col("top")) & (F.col("below") >= LEAST_LEFT)).withColumn("explained", F.try_divide(between, F.col("spread")))
    best = told.groupBy(*keys, "measure").agg(F.max(F.struct("explained", F.col("bin"), F.col("below").alias("level"))).alias("b"))
    return best.select(*keys, "measure", "b.bin", "b.level", "b.explained")


def thresholds(sketches: DataFrame) -> DataFrame:
    """``lang_key, source_key`` and ``max_<measure>``, the last bin that is kept; null where nothing is cut."""
    total = merge(sketches, [])
    every = total.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("measure"))).drop("n")
    by_lang = drawn(merge(sketches, ["lang_key"]), ["lang_key"], every, [])
    own = cuts(drawn(sketches, ["lang_key", "source_key"], by_lang, ["lang_key"]), ["lang_key", "source_key"])
    clear = F.col("explained") >= LEAST_EXPLAINED
    return own.groupBy("lang_key", "source_key").agg(*[F.max(F.when(clear & (F.col("measure") == m), F.col("bin"))).alias(f"max_{m}") for m in RULES])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """All rows of ``docs`` as ``doc_id, lang_key, source_key, <measures>, max_<measure>, base_failed, kept``.

    ``base_failed``: under 50 words, or more than half of them in repeated
    3-word windows.  ``kept``: base passed and every measure within its
    group's threshold; ``max_<measure>`` is the last bin that is kept.  Null or
    empty text has no words and fails; a very long text is measured whole, in a
    task that holds its words.  A null language or source is a group of its
    own.  Repeated rows count as often as they occur.  An empty table gives no
    rows; other columns are ignored.
    """
    modest_batches(docs.sparkSession)
    measured = stored(
        docs.select(F.col(id_col).alias("doc_id"), key_of(F.col(lang_col)).alias("lang_key"), key_of(F.col(source_col)).alias("source_key"), measures(F.col(text_col)).alias("m")).select(
            "doc_id", "lang_key", "source_key", "m.*"
        ),
        "quality",
    )
    return verdicts(measured, limits(measured))


def limits(measured: DataFrame) -> DataFrame:
    """Thresholds of every group in ``measured``, as a stored table."""
    sketches = stored(sketch(measured, ["lang_key", "source_key"], ratios()), "sketch")
    return maybe_broadcast(stored(thresholds(sketches), "limits"), BROADCAST_GROUPS)


def verdicts(measured: DataFrame, bounds: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    fits = [bin_of(v) <= F.col(f"max_{m}") for m, v in ratios().items()]
    kept = ~F.col("base_failed")
    for fit in fits:
        kept = kept & F.coalesce(fit, F.lit(True))
    return measured.join(bounds, ["lang_key", "source_key"], "left").withColumn("base_failed", failed).withColumn("kept", kept)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Rows are stored once beside their measures, so texts are measured once.
    Null and empty texts go, as in :func:`judge`; null languages and sources
    are groups of their own; repeated rows stay as often as they occur; an
    empty table stays empty.  Columns may have any names.
    """
    modest_batches(docs.sparkSession)
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    measured = docs.select(held, key_of(F.col(lang_col)).alias("lang_key"), key_of(F.col(source_col)).alias("source_key"), measures(F.col(text_col)).alias("m"))
    flat = stored(measured.select("row", "lang_key", "source_key", "m.*"), "measured")
    return verdicts(flat, limits(flat.drop("row"))).filter("kept").select("row.*")


#: DuckDB SQL for the contract's columns, with the sketches' bins.
ORACLE_SQL = (
    r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '\0') AS lang, coalesce(source, '\0') AS source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM windows JOIN twice USING (doc_id, g)) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n, count(DISTINCT l) AS fresh FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(lines.n - fresh, 0)::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(lines.n, 0) AS n_lines
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), r AS (
  SELECT *, n_symbols::DOUBLE / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines::DOUBLE / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words::DOUBLE / greatest(n_words, 1) AS repeat_word_ratio FROM m
), bins AS (
  SELECT lang, source, measure, CASE WHEN v <= 1e-9 THEN 0 ELSE ceil(ln(v / 1e-9) / ln("""
    + str(GAMMA)
    + r"""::DOUBLE))::INT END AS bin
  FROM (UNPIVOT (SELECT lang, source, symbol_ratio, dup_line_ratio, repeat_word_ratio FROM r) ON symbol_ratio, dup_line_ratio, repeat_word_ratio INTO NAME measure VALUE v)
), counts AS (
  SELECT lang, source, measure, bin, count(*) AS n FROM bins GROUP BY ALL
), every AS (
  SELECT measure, bin, sum(n)::DOUBLE / sum(sum(n)) OVER (PARTITION BY measure) AS share FROM counts GROUP BY measure, bin
), lang_weights AS (
  SELECT g.lang, e.measure, e.bin, coalesce(c.n, 0) + """ + str(PRIOR_DOCS) + """ * e.share AS w
  FROM (SELECT DISTINCT lang FROM counts) g CROSS JOIN every e
  LEFT JOIN (SELECT lang, measure, bin, sum(n) AS n FROM counts GROUP BY ALL) c ON c.lang = g.lang AND c.measure = e.measure AND c.bin = e.bin
), by_lang AS (
  SELECT lang, measure, bin, w / sum(w) OVER (PARTITION BY lang, measure) AS share FROM lang_weights
), own_weights AS (
  SELECT g.lang, g.source, l.measure, l.bin, coalesce(c.n, 0) + """ + str(PRIOR_DOCS) + """ * l.share AS w
  FROM (SELECT DISTINCT lang, source FROM counts) g JOIN by_lang l USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.measure = l.measure AND c.bin = l.bin
), own AS (
  SELECT lang, source, measure, bin, w / sum(w) OVER (PARTITION BY lang, source, measure) AS share,
         CASE WHEN bin = 0 THEN 0 ELSE pow(2e-9 * pow(""" + str(GAMMA) + """::DOUBLE, bin) / (1 + """ + str(GAMMA) + """), CASE measure """ + " ".join(f"WHEN '{m}' THEN {v}::DOUBLE" for m, v in RULES.items()) + """ END) END AS x
  FROM own_weights
), run AS (
  SELECT *, sum(share * pow(x - mean, 2)) OVER (PARTITION BY lang, source, measure) AS spread FROM (
    SELECT *, sum(share) OVER o AS below, sum(share) OVER (PARTITION BY lang, source, measure ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
      sum(share * x) OVER o AS sum_below, sum(share * x) OVER g AS mean, max(bin) OVER g AS top
    FROM own WINDOW o AS (PARTITION BY lang, source, measure ORDER BY bin), g AS (PARTITION BY lang, source, measure))
), best AS (
  SELECT lang, source, measure, max(explained) AS explained, arg_max(bin, explained) AS bin
  FROM (SELECT *, pow(mean * below - sum_below, 2) / nullif(below * above, 0) / nullif(spread, 0) AS explained FROM run WHERE bin < top AND below >= """ + str(LEAST_LEFT) + """) GROUP BY ALL
), bounds AS (
  SELECT lang, source, """ + ", ".join(f"max(bin) FILTER (WHERE measure = '{m}' AND explained >= {LEAST_EXPLAINED}) AS max_{m}" for m in RULES) + """ FROM best GROUP BY ALL
), judged AS (
  SELECT r.*, """ + ", ".join(f"max_{m}" for m in RULES) + """, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM r LEFT JOIN bounds USING (lang, source)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND """ + " AND ".join(f"coalesce(CASE WHEN {m} <= 1e-9 THEN 0 ELSE ceil(ln({m} / 1e-9) / ln({GAMMA}::DOUBLE))::INT END <= max_{m}, true)" for m in RULES) + """ AS kept FROM judged"""
)
