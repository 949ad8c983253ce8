import re

import pytest
from fixtures import documents, frame
from pyspark.sql import functions as F

from rayloom.llm import quality


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 800 else {w for w, n in __import__("collections").Counter(windows).items() if n > 1}
    hit = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measures_against_plain_python(spark):
    got = quality.judge(frame(spark, clashes=True)).collect()
    told = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    want = []
    for d in documents():
        m = plain(d[1])
        want.append((str(d[0]), *m, m[0] < 50 or 100 * m[4] > 50 * m[0]))
    assert told == sorted(want)
    assert all(not (r.base_failed and r.kept) for r in got)


def test_sketches_merge_and_bound_their_error(spark):
    rows = [("a" if i % 3 else "b", float(i + 1)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v double")
    s = quality.sketch(df, ["g"], {"v": F.col("v")})
    halves = quality.sketch(df.filter("v <= 1500"), ["g"], {"v": F.col("v")}).unionByName(quality.sketch(df.filter("v > 1500"), ["g"], {"v": F.col("v")}))
    both = quality.quantiles(quality.merge(s, []), [], {"q": 0.75}).first()
    parts = quality.quantiles(quality.merge(halves, []), [], {"q": 0.75}).first()
    assert both == parts and abs(both.q / 2250 - 1) < 0.011


def test_adaptive_thresholds_follow_the_group(spark):
    clean, noisy = ("word " * 3).strip(), "# # word"
    text = lambda unit, k: " ".join(f"{w}{k}x{j}" if w == "word" else w for j in range(80) for w in unit.split())
    rows = [(i, text(clean, i), "en", "prose", 0) for i in range(80)] + [(100 + i, text(noisy, i), "en", "code", 0) for i in range(80)] + [(300, text(noisy, 999), "en", "prose", 0)]
    kept = {r.doc_id: r.kept for r in quality.judge(frame(spark, rows)).collect()}
    assert not kept[300] and all(kept[i] for i in range(80)) and all(kept[100 + i] for i in range(80))


def test_the_same_text_is_judged_by_its_group(spark):
    """On a real table: a text between the thresholds of two sources is kept in one and dropped in the other."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    limits = quality.limits(quality.judge(docs).select("lang_key", "source_key", *quality.MEASURES))
    bounds = limits.withColumn("most", F.col("max_dup_line_ratio")).filter("lang_key = '1en' AND most IS NOT NULL").orderBy("most").collect()
    low, high = bounds[0], bounds[-1]
    edge = lambda b: 1e-9 * quality.GAMMA**b
    n, k = next((n, k) for n in range(2, 60) for k in range(1, n) if edge(low.most) < k / n <= edge(high.most) / quality.GAMMA)
    line = lambda i: " ".join(f"w{i}x{j}" for j in range(3 + 80 // n))
    text = "\n".join(x for i in range(n - k - 1) for x in (("same words", line(i)) if i <= k else (line(i),)))
    fresh = [(-1, text, "en", low.source_key[1:], 0), (-2, text, "en", high.source_key[1:], 0)]
    measured = quality.judge(frame(spark, fresh)).select("doc_id", "lang_key", "source_key", *quality.MEASURES)
    told = {r.doc_id: r for r in quality.verdicts(measured, limits).collect()}
    assert not told[-1].base_failed and not told[-1].kept and told[-2].kept


def test_a_cut_needs_a_clear_gap_and_most_of_the_group(spark):
    even = spark.createDataFrame([("g", "symbol_ratio", 900 + b, 10) for b in range(40)], "g string, measure string, bin int, n long")
    clear = spark.createDataFrame([("g", "symbol_ratio", 0, 90), ("g", "symbol_ratio", 950, 10)], even.schema)
    norm = spark.createDataFrame([("g", "symbol_ratio", 0, 10), ("g", "symbol_ratio", 950, 90)], even.schema)
    shares = lambda df: df.withColumn("share", F.col("n") / F.sum("n").over(__import__("pyspark").sql.Window.partitionBy("g", "measure")))
    cut = lambda df: quality.cuts(shares(df), ["g"]).first()
    assert cut(clear).bin == 0 and cut(clear).explained > 0.99 and abs(cut(clear).level - 0.9) < 1e-9
    assert cut(norm) is None and cut(even).explained < 0.8


@pytest.mark.parametrize("n", [10**4, 10**10, 10**17])
def test_groups_of_any_size(spark, n):
    """A bin of one document among very many, and groups in which nothing varies."""
    rows = [("1en", "1a", m, b, k) for m in quality.RULES for b, k in ((0, n), (950, n // 10), (1000, 1))] + [("1en", "1b", m, 970, n) for m in quality.RULES] + [("1de", "1a", m, 0, 3) for m in quality.RULES]
    got = {(r.lang_key, r.source_key): r for r in quality.thresholds(spark.createDataFrame(rows, "lang_key string, source_key string, measure string, bin int, n long")).collect()}
    assert len(got) == 3 and got["1en", "1a"].max_symbol_ratio == 0
    shares = spark.createDataFrame([("g", "symbol_ratio", 0, 1.0), ("g", "symbol_ratio", 950, 0.0)], "g string, measure string, bin int, share double")
    assert quality.cuts(shares, ["g"]).first().explained is None  # nothing varies


def test_filter_keeps_rows_as_they_are(spark):
    df = frame(spark, clashes=True)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns
    want = sorted(str(r.doc_id) for r in quality.judge(df).filter("kept").collect())
    assert sorted(str(r.doc_id) for r in kept.collect()) == want and want


def test_empty(spark):
    assert quality.judge(frame(spark, [])).count() == 0 and quality.keep_good(frame(spark, [])).count() == 0
