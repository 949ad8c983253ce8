"""Quality classifiers by co-training of two views.

One classifier sees a document's text as a set of hashed tokens, the other its
page metadata: language, source and lengths, nothing of what the text says.
In each round both score all documents.  A view is certain of the documents
that it ranks highest and lowest, a share of as many as each class is expected
to have, so a view whose chances all lie in the middle gives labels too.  Where
one view is certain and the other doesn't contradict, the document is a
pseudo-label for the other; the tasks count the features of all such documents
by class, and the log odds of those counts become a second part of the other
view.  At the end each view, and then their sum, is calibrated on labels that
nothing was fitted on, so pseudo-labels that tell nothing get no weight.

A view has two parts: a logistic regression on at most ``LABELLED`` labelled
rows, fitted on the driver, and the log odds of the pseudo-labels, of which
there is no limit: their counts are bounded by the number of bins, whatever the
corpus.  Whole texts are read once, for the features.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.lineage import stored
from rayloom.llm.common import modest_batches

#: Most labelled rows a model is fitted on, those of least hash; a quarter of them calibrates.
LABELLED = 8_000
#: Rounds of exchange.
ROUNDS = 2
#: Bins of hashed tokens and of hashed metadata.
TOKEN_BINS, META_BINS = 1 << 18, 1 << 12
#: Bins in fewer documents, or whose share of a class is nearer to its base rate than so many deviations, have no weight.
LEAST_ROWS, LEAST_DEVIATIONS = 4, 2.5
#: Share of a class's expected documents that a view is certain of, those ranked furthest; a pseudo-label unless the other view's chance is beyond ``CONTRARY`` on the other side.
CERTAIN, CONTRARY = 0.25, (0.2, 0.8)
#: Steps of a logit, and the largest one, in which ranks are counted.
STEPS, FURTHEST = 64, 20
VIEWS = (("tokens", TOKEN_BINS), ("meta", META_BINS))

TOKENS = re.compile(rb"[a-z0-9\x80-\xff]+|[^\x00-\x20a-z0-9\x80-\xff]+")


_CAPITALS = bytes(range(65, 91))
_MARKS = bytes(b for b in range(33, 127) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def style(raw: bytes) -> list[bytes]:
    """How a text is written, as tokens that no text holds: shares of marks, capitals, fresh words and fresh lines."""
    words, lines = raw.split(), raw.split(b"\n")
    of = [(len(raw) - len(raw.translate(None, kind)), len(raw)) for kind in (_MARKS, _CAPITALS)] + [(len(set(x)), len(x)) for x in (words, lines)]
    return [b"\n%d=%d" % (i, 20 * a // (b or 1)) for i, (a, b) in enumerate(of)]


def token_ids(text: str | None) -> np.ndarray:
    """Bins of the distinct tokens of a whole text: words, runs of other characters, and its style."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    tokens = {*TOKENS.findall((text or "").lower().encode("utf-8", "surrogatepass")), *style(raw)}
    return np.unique(np.fromiter((zlib.crc32(t) & (TOKEN_BINS - 1) for t in tokens), np.int64))


def lengths_of(text: str | None) -> tuple[int, ...]:
    """Lengths of a page, as small numbers: bytes, lines and bytes a line on logarithmic scales."""
    if not text:
        return (0,)
    size, lines = len(text.encode("utf-8", "surrogatepass")), 1 + text.count("\n")
    return tuple(int(2 * math.log(x)) for x in (size, lines, 1 + size / lines))


def meta_ids(values: Sequence[object], text: str | None) -> np.ndarray:
    said = [f"{i}={v}" for i, v in enumerate((*values, *lengths_of(text)))] + ["all=" + "|".join(map(str, values))]
    return np.unique(np.array([zlib.crc32(s.encode("utf-8", "surrogatepass")) & (META_BINS - 1) for s in said], np.int64))


def telling(met: np.ndarray, positive: np.ndarray, rate: float) -> np.ndarray:
    """Bins that are common enough and whose share of positives differs enough from ``rate``."""
    return (met >= LEAST_ROWS) & (np.abs(positive - met * rate) >= LEAST_DEVIATIONS * np.sqrt(met * rate * (1 - rate)))


def fitted(rows: list[np.ndarray], said: np.ndarray, bins: int, steps: int = 200, rate: float = 0.08, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic regression by Adam on all rows; with one class, or none, the smoothed base rate."""
    n, base = len(said), (said.sum() + 1) / (len(said) + 2)
    prior, weights = float(np.log(base / (1 - base))), np.zeros(bins)
    if n == 0 or said.min() == said.max():
        return weights, prior
    columns, row = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    keep = telling(np.bincount(columns, minlength=bins), np.bincount(columns, said[row], bins), said.mean())[columns]
    used, columns = np.unique(columns[keep], return_inverse=True)
    row, w, b = row[keep], np.zeros(len(used)), prior
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for k in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[columns], n), -40, 40)))
        off = (p - said) / n
        g, gb = np.bincount(columns, off[row], len(used)) + ridge * w, off.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        low, high = 1 - 0.9**k, 1 - 0.999**k
        w -= rate * (m / low) / (np.sqrt(v / high) + 1e-8)
        b -= rate * (mb / low) / (math.sqrt(vb / high) + 1e-8)
    weights[used] = w
    return weights, float(b)


def odds(counts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Log odds of each bin from its counts in documents of class 0 and 1 (``counts``: 2 x bins); zero where it tells nothing."""
    if not docs.all():
        return np.zeros(counts.shape[1])
    share = (counts + 0.5) / (docs[:, None] + 1.0)
    rate = docs[1] / docs.sum()
    return np.where(telling(counts.sum(axis=0), counts[1], rate), np.log(share[1] / share[0]), 0.0)


def calibrated(x: np.ndarray, said: np.ndarray, start: Sequence[float]) -> tuple[float, ...]:
    """Weights of the columns of ``x`` and of 1, by Newton steps on the smoothed log loss, drawn towards ``start``; without both classes ``start``."""
    start = np.asarray(start, float)
    if not len(said) or said.min() == said.max():
        return tuple(start)
    x = np.column_stack((x, np.ones(len(said))))
    goal = np.where(said > 0, (said.sum() + 1) / (said.sum() + 2), 1 / (len(said) - said.sum() + 2))

    def cost(a: np.ndarray) -> float:
        z = x @ a
        return float((np.logaddexp(0, z) - goal * z).sum() + 0.5 * ((a - start) ** 2).sum())

    a = start.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -40, 40)))
        grad = x.T @ (p - goal) + a - start
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(len(a)), grad)
        size, now = 1.0, cost(a)
        while size > 1e-6 and cost(a - size * step) > now:
            size /= 2
        a = a - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return tuple(a) if np.isfinite(a).all() else tuple(start)


def packed(models: dict[str, dict]) -> dict[str, dict]:
    """Models as plain tuples of the weights that aren't 0, to be sent to the tasks."""
    few = lambda w: (len(w), np.flatnonzero(w), w[np.flatnonzero(w)])
    return {t: {"both": m["both"]} | {name: (few(m[name][0]), m[name][1], few(m[name][2]), m[name][3]) for name, _ in VIEWS} for t, m in models.items()}


def unpacked(models: dict[str, dict]) -> dict[str, dict]:
    def whole(few: tuple) -> np.ndarray:
        size, at, values = few
        out = np.zeros(size)
        out[at] = values
        return out

    return {t: {"both": m["both"]} | {name: (whole(m[name][0]), m[name][1], whole(m[name][2]), m[name][3]) for name in ("tokens", "meta")} for t, m in models.items()}


def parts_of(view: tuple, rows: list[np.ndarray]) -> np.ndarray:
    """Two columns: the regression's score of each row, and the pseudo-labels' mean log odds times the root of its length."""
    weights, offset, told, _ = view
    lengths = np.array([len(r) for r in rows], np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    bins = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.empty(0, np.int64)
    total = lambda w: np.bincount(owner, w[bins], len(rows))
    return np.column_stack((offset + total(weights), total(told) / np.sqrt(1.0 + lengths)))


def logits_of(model: dict, tokens: list[np.ndarray], meta: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the text, of the metadata, and of both."""
    each = []
    for name, rows in (("tokens", tokens), ("meta", meta)):
        scale = model[name][3]
        each.append(parts_of(model[name], rows) @ np.array(scale[:2]) + scale[2])
    a, b, c = model["both"]
    return each[0], each[1], a * each[0] + b * each[1] + c


def _chances(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


FEATURES = T.StructType([T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("meta", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(FEATURES)
def _features(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for text, *values in batches:
        rows = list(zip(text, *values))
        yield pd.DataFrame({"tokens": [token_ids(r[0]).astype(np.int32) for r in rows], "meta": [meta_ids(r[1:], r[0]).astype(np.int32) for r in rows]})


def features(docs: DataFrame, meta_cols: Sequence[str] = ("lang", "source"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, tokens, meta`` of every row of ``docs``, stored: both views of whole texts.

    A null text is empty, and null metadata is a value of its own.  A very
    long text has as many tokens as it has distinct ones.  Repeated rows and
    null ids stay; other columns are ignored, whatever their names.
    """
    modest_batches(docs.sparkSession)
    return stored(docs.select(F.col(id_col).alias("doc_id"), _features(text_col, *[F.col(c).cast("string") for c in meta_cols]).alias("f")).select("doc_id", "f.*"), "views")


def classify(views: DataFrame, models: dict[str, dict]) -> DataFrame:
    """``doc_id`` and ``<target>_text, <target>_meta, <target>`` probabilities of every row of ``views``; none of an empty table."""
    held = views.sparkSession.sparkContext.broadcast(packed(models))  # plain arrays and tuples: no class of this package
    names = [f"{t}{v}" for t in models for v in ("_text", "_meta", "")]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = unpacked(held.value)
        for tokens, meta in batches:
            rows = [x for m in known.values() for x in logits_of(m, tokens.tolist(), meta.tolist())] if len(tokens) else [np.empty(0)] * len(names)
            yield pd.DataFrame({n: _chances(x) for n, x in zip(names, rows)})

    return views.select("doc_id", score("tokens", "meta").alias("s")).select("doc_id", "s.*")


def steps_of(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logits, -FURTHEST, FURTHEST) * STEPS).astype(np.int64)


def ranked(views: DataFrame, models: dict[str, dict]) -> dict[tuple[str, str], dict[int, int]]:
    """For each target and view, how many documents have a logit in each step: at most so many small numbers."""
    held = views.sparkSession.sparkContext.broadcast(packed(models))
    least = -FURTHEST * STEPS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sums = unpacked(held.value), {}
        for batch in batches:
            for target, model in known.items():
                for (view, _), logits in zip(VIEWS, logits_of(model, batch["tokens"].tolist(), batch["meta"].tolist())):
                    n = sums.setdefault((target, view), np.zeros(2 * FURTHEST * STEPS + 1, np.int64))
                    n += np.bincount(steps_of(logits) - least, minlength=len(n))
        for (target, view), n in sums.items():
            met = np.flatnonzero(n)
            yield pd.DataFrame({"target": target, "view": view, "step": met + least, "n": n[met]})

    told = views.select("tokens", "meta").mapInPandas(count, "target string, view string, step bigint, n bigint").groupBy("target", "view", "step").agg(F.sum("n").alias("n"))
    out: dict[tuple[str, str], dict[int, int]] = {(t, v): {} for t in models for v, _ in VIEWS}
    for r in told.collect():
        out[r.target, r.view][r.step] = r.n
    return out


def certain_steps(counts: dict[int, int], rate: float) -> tuple[int, int]:
    """The step up to which a view is certain of class 0, and that from which it is of class 1.

    Whole steps are taken from either end until ``CERTAIN`` of the documents
    that the class is expected to have are reached, but none on the other
    side of the base rate.
    """
    total, base = sum(counts.values()), int(steps_of(np.array([np.log(rate / (1 - rate))]))[0])
    low, high = -FURTHEST * STEPS - 1, FURTHEST * STEPS + 1
    for steps, wanted in ((sorted(k for k in counts if k < base), CERTAIN * (1 - rate) * total), (sorted((k for k in counts if k > base), reverse=True), CERTAIN * rate * total)):
        met = 0
        for k in steps:
            if met >= wanted:
                break
            met += counts[k]
            low, high = (k, high) if k < base else (low, k)
    return low, high


def exchanged(views: DataFrame, models: dict[str, dict], certain: dict[tuple[str, str], tuple[int, int]]) -> DataFrame:
    """``target, view, said, bin, n``: in how many pseudo-labelled documents for a view each bin is; bin -1 counts the documents.

    A document is a pseudo-label for a view where the other one is ``certain``
    and it is not certain of the contrary.
    """
    held = views.sparkSession.sparkContext.broadcast((packed(models), certain))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (models, edges), sums = held.value, {}
        known = unpacked(models)
        for batch in batches:
            rows = {"tokens": batch["tokens"].tolist(), "meta": batch["meta"].tolist()}
            for target, model in known.items():
                text, meta, _ = logits_of(model, rows["tokens"], rows["meta"])
                for view, bins, by, giver, taker in (("tokens", TOKEN_BINS, "meta", meta, text), ("meta", META_BINS, "tokens", text, meta)):
                    (low, high), step, q = edges[target, by], steps_of(giver), _chances(taker)
                    for said, sure in ((0, (step <= low) & (q < CONTRARY[1])), (1, (step >= high) & (q > CONTRARY[0]))):
                        some = [rows[view][i] for i in np.flatnonzero(sure)]
                        if some:
                            n = sums.setdefault((target, view, said), np.zeros(bins + 1, np.int64))
                            n[:-1] += np.bincount(np.concatenate(some), minlength=bins)
                            n[-1] += len(some)
        for (target, view, said), n in sums.items():
            met = np.flatnonzero(n)
            yield pd.DataFrame({"target": target, "view": view, "said": said, "bin": np.where(met == len(n) - 1, -1, met), "n": n[met]})

    told = views.select("tokens", "meta").mapInPandas(count, "target string, view string, said int, bin int, n bigint")
    return told.groupBy("target", "view", "said", "bin").agg(F.sum("n").alias("n"))


def _model(sample: pd.DataFrame, target: str, regressions: dict, pseudo: dict[str, np.ndarray]) -> dict:
    """A target's model from its regressions, the pseudo-labels' odds, and the calibrating rows of ``sample``."""
    rest = sample[sample["calibrates"]]
    said, model, logits = rest[target].to_numpy(float), {}, []
    for name, bins in VIEWS:
        view = (*regressions[name], pseudo.get(name, np.zeros(bins)))
        x = parts_of((*view, None), rest[name].tolist())
        scale = calibrated(x, said, (1.0, 0.0, 0.0))
        model[name] = (*view, scale)
        logits.append(x @ np.array(scale[:2]) + scale[2])
    base = (sample[target].sum() + 1) / (len(sample) + 2)
    return model | {"both": calibrated(np.column_stack(logits), said, (1.0, 1.0, -float(np.log(base / (1 - base)))))}


def labelled_sample(views: DataFrame, labels: DataFrame, targets: Sequence[str], labelled: int, id_col: str) -> pd.DataFrame:
    """At most ``labelled`` labels of documents in ``views`` with both views, those of least hash; of rows with one id, one is taken."""
    known = labels.select(F.col(id_col).alias("doc_id"), *[F.col(t).cast("double").alias(t) for t in targets]).dropna()
    known = known.join(views.select("doc_id"), "doc_id", "left_semi").withColumn("lot", F.xxhash64("doc_id")).orderBy("lot", *targets).limit(labelled)
    known = stored(known, "labelled")
    ids = known.select("doc_id").distinct()
    one = views.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("tokens", "meta").alias("h"), "tokens", "meta")).alias("v"))
    sample = one.join(F.broadcast(known), "doc_id").select("doc_id", *targets, (F.pmod("lot", F.lit(4)) == 0).alias("calibrates"), "v.tokens", "v.meta").toPandas()
    return sample.sort_values(["doc_id", *targets], kind="stable", ignore_index=True)


def co_train(views: DataFrame, labels: DataFrame, targets: Sequence[str], rounds: int = ROUNDS, labelled: int = LABELLED, id_col: str = "doc_id") -> dict[str, dict]:
    """A model for each 0/1 column of ``labels`` named in ``targets``; ``views`` come from :func:`features`.

    ``given`` in a model tells, round by round, how many documents of class 0
    and 1 each view was given by the other.

    Rows with a null id or label and labels of unknown documents aren't used;
    repeated labels count as often as they occur.  Without labels every score
    is the smoothed base rate.
    """
    sample = labelled_sample(views, labels, targets, labelled, id_col)
    for name, _ in VIEWS:
        sample[name] = [np.asarray(r, np.int32) for r in sample[name]]
    fits = sample[~sample["calibrates"].astype(bool)]
    sample["calibrates"] = sample["calibrates"].astype(bool)
    regressions = {t: {name: fitted(fits[name].tolist(), fits[t].to_numpy(float), bins) for name, bins in VIEWS} for t in targets}
    models = {t: _model(sample, t, regressions[t], {}) for t in targets}
    known = views.sparkSession.createDataFrame([(i,) for i in sample["doc_id"].unique().tolist()], T.StructType([views.schema["doc_id"]]))
    rest = views.join(F.broadcast(known), "doc_id", "left_anti")
    given: dict[str, list] = {t: [] for t in targets}
    for _ in range(rounds if len(sample) else 0):
        certain = {(t, v): certain_steps(n, (sample[t].sum() + 1) / (len(sample) + 2)) for (t, v), n in ranked(rest, models).items()}
        n_of = [F.sum(F.when(F.col("said") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]
        told = stored(exchanged(rest, models, certain).groupBy("target", "view", "bin").agg(*n_of).filter((F.col("n0") + F.col("n1") >= LEAST_ROWS) | (F.col("bin") < 0)), "exchanged")
        pseudo = {}
        for t, (name, bins) in itertools.product(targets, VIEWS):  # a model's bins at a time: at most so many rows
            some = told.filter((F.col("target") == t) & (F.col("view") == name)).select("bin", "n0", "n1").toPandas()
            counts = np.zeros((2, bins + 1))
            counts[:, some["bin"].to_numpy()] = some[["n0", "n1"]].to_numpy().T
            pseudo[t, name] = odds(counts[:, :-1], counts[:, -1])
            given[t].append((name, *map(int, counts[:, -1])))
        models = {t: _model(sample, t, regressions[t], {name: pseudo[t, name] for name, _ in VIEWS}) for t in targets}
    return {t: m | {"given": given[t]} for t, m in models.items()}


def good(quality: Column, toxic: Column, least: float = 0.5) -> Column:
    return (quality >= least) & (toxic < 1 - least)
