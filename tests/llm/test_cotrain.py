import math
import random

import numpy as np
import pytest
from fixtures import frame
from pyspark.sql import functions as F

from rayloom.llm import cotrain

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=600):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        bad, toxic = i % 5 == 0, i % 7 == 0
        text = [rng.choice(words) for _ in range(60)]
        if bad:
            text = [w + "###" for w in text]
        if toxic:
            text[rng.randrange(60)] = rng.choice(("vile", "foul"))
        rows.append((i, " ".join(text), "en", f"s{i % 4}", 0))
        if i % 2:
            labels.append((i, int(not bad), int(toxic)))
    return frame(spark, rows), spark.createDataFrame(labels, LABELS)


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    views = cotrain.features(docs)
    models = cotrain.co_train(views, labels, ("quality", "toxic"))
    got = {r.doc_id: r for r in cotrain.classify(views, models).collect()}
    rest = [i for i in range(600) if i % 2 == 0]
    assert sum((got[i].quality >= 0.5) == (i % 5 > 0) for i in rest) / len(rest) > 0.95
    assert sum((got[i].toxic >= 0.5) == (i % 7 == 0) for i in rest) / len(rest) > 0.95
    assert any(models[t][v][2].any() for t in models for v in ("tokens", "meta"))  # pseudo-labels told something
    again = cotrain.co_train(views.repartition(3), labels, ("quality", "toxic"))
    assert {r.doc_id: round(r.quality, 9) for r in cotrain.classify(views, again).collect()} == {i: round(r.quality, 9) for i, r in got.items()}


def plain(docs, labels, targets, rounds):
    """Brute force of the whole fit: the same small fits, the exchange document by document, from sorted lists."""
    views = {d: (cotrain.token_ids(t), cotrain.meta_ids((lang, source), t)) for d, t, lang, source in docs}
    lot = {r[0]: r[-1] for r in labels}
    known = sorted(labels, key=lambda r: r[0])
    models, given = {}, {}
    for k, target in enumerate(targets):
        fits, rest = [r for r in known if lot[r[0]] % 4], [r for r in known if lot[r[0]] % 4 == 0]
        rate = (sum(r[1 + k] for r in known) + 1) / (len(known) + 2)
        regressions = [cotrain.fitted([views[r[0]][v] for r in fits], np.array([float(r[1 + k]) for r in fits]), bins) for v, (_, bins) in enumerate(cotrain.VIEWS)]

        def model(pseudo):
            parts, logits = [], []
            said = np.array([float(r[1 + k]) for r in rest])
            for v in (0, 1):
                rows = [views[r[0]][v] for r in rest]
                x = np.array([[regressions[v][1] + regressions[v][0][r].sum(), pseudo[v][r].sum() / (1 + len(r)) ** 0.5] for r in rows])
                scale = cotrain.calibrated(x, said, (1.0, 0.0, 0.0))
                parts.append((*regressions[v], pseudo[v], scale))
                logits.append(x @ np.array(scale[:2]) + scale[2])
            return parts, cotrain.calibrated(np.column_stack(logits), said, (1.0, 1.0, -float(np.log(rate / (1 - rate)))))

        def score(m, d):
            z = [p[3][0] * (p[1] + p[0][r].sum()) + p[3][1] * p[2][r].sum() / (1 + len(r)) ** 0.5 + p[3][2] for p, r in zip(m[0], views[d])]
            return z[0], z[1], m[1][0] * z[0] + m[1][1] * z[1] + m[1][2]

        now, given[target] = model([np.zeros(b) for _, b in cotrain.VIEWS]), []
        for _ in range(rounds):
            others = [d for d in views if d not in lot]
            z = {d: score(now, d) for d in others}
            step, base = lambda x: math.floor(min(max(x, -20), 20) * 64), math.floor(math.log(rate / (1 - rate)) * 64)
            pseudo = []
            for v, (_, bins) in enumerate(cotrain.VIEWS):
                by = sorted(others, key=lambda d: z[d][1 - v])
                sides = []
                for way, wanted, beyond in ((by, cotrain.CERTAIN * (1 - rate) * len(by), lambda s: s < base), (by[::-1], cotrain.CERTAIN * rate * len(by), lambda s: s > base)):
                    steps = [step(z[d][1 - v]) for d in way]
                    edge = steps[min(math.ceil(wanted), len(way)) - 1]
                    sides.append([d for d, s in zip(way, steps) if beyond(s) and (s <= edge if way is by else s >= edge)])
                chance = lambda d: 1 / (1 + math.exp(-z[d][v]))
                sides = [[d for d in sides[0] if chance(d) < 0.8], [d for d in sides[1] if chance(d) > 0.2]]
                counts = np.zeros((2, bins))
                for c in (0, 1):
                    for d in sides[c]:
                        counts[c, views[d][v]] += 1
                counts[:, counts.sum(0) < cotrain.LEAST_ROWS] = 0
                docs_of = np.array([len(s) for s in sides], float)
                pseudo.append(cotrain.odds(counts, docs_of))
                given[target].append((cotrain.VIEWS[v][0], *map(int, docs_of)))
            now = model(pseudo)
        models[target] = {d: score(now, d) for d in views}
    return models, given


def test_the_whole_fit_against_brute_force(spark):
    docs, labels = corpus(spark, 400)
    views = cotrain.features(docs)
    models = cotrain.co_train(views, labels, ("quality", "toxic"))
    got = {r.doc_id: r for r in cotrain.classify(views, models).collect()}
    known = [tuple(r) for r in labels.withColumn("lot", F.xxhash64("doc_id")).collect()]
    want, given = plain([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], known, ("quality", "toxic"), cotrain.ROUNDS)
    for t in ("quality", "toxic"):
        assert models[t]["given"] == given[t]
        assert {v for v, a, b in given[t] if a + b} == {"tokens", "meta"}  # labels went both ways
        for i, z in want[t].items():
            assert [got[i][f"{t}{s}"] for s in ("_text", "_meta", "")] == pytest.approx([1 / (1 + math.exp(-min(max(x, -40), 40))) for x in z], abs=1e-6)


def test_metadata_says_nothing_of_the_text():
    same = [cotrain.meta_ids(("en", "a"), t).tolist() for t in ("good words here", "### $$$ %% VILE")]
    assert same[0] == same[1]


@pytest.mark.parametrize("n", [60, 400, 4000])
def test_exchange_does_not_lower_held_out_accuracy(spark, n):
    top = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{top}/documents.parquet")
    labels = spark.read.parquet(f"{top}/labels.parquet")
    fit, held = labels.filter("pmod(hash(doc_id), 2) = 0"), {r.doc_id: r for r in labels.filter("pmod(hash(doc_id), 2) = 1").collect()}
    views = cotrain.features(docs.join(labels, "doc_id", "left_semi"))
    right, given = {}, {}
    for rounds in (0, 2):
        models = cotrain.co_train(views, fit, ("quality", "toxic"), rounds=rounds, labelled=n)
        given[rounds] = {t: m["given"] for t, m in models.items()}
        got = {r.doc_id: r for r in cotrain.classify(views, models).collect()}
        right[rounds] = [sum((got[i][t] >= 0.5) == (r[t] == 1) for i, r in held.items()) / len(held) for t in ("quality", "toxic")]
    print(n, right, given[2])
    assert all(a + b > 0 for t in given[2].values() for _, a, b in t)  # both views give labels in both rounds
    assert all(b >= a - 0.003 for a, b in zip(right[0], right[2]))
    assert min(right[2]) > {60: 0.8, 400: 0.9, 4000: 0.96}[n]


def test_repeated_ids_and_long_texts(spark):
    long = "word " * 20_000 + " ".join(f"t{i}" for i in range(50_000))
    rows = [(1, "one text", "en", "a", 0)] * 40 + [(1, "other text", "en", "b", 0), (2, long, "en", "a", 0), (3, "x", None, None, 0)]
    views = cotrain.features(frame(spark, rows))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1)], LABELS)
    assert len(cotrain.labelled_sample(views, labels, ["quality"], 100, "doc_id")) == 3
    assert cotrain.classify(views, cotrain.co_train(views, labels, ("quality", "toxic"))).count() == len(rows)


def test_awkward_rows_and_no_labels(spark):
    docs = frame(spark, clashes=True)
    views = cotrain.features(docs)
    models = cotrain.co_train(views, spark.createDataFrame([], LABELS), ("quality",))
    got = cotrain.classify(views, models).collect()
    assert len(got) == docs.count() and all(r.quality == pytest.approx(0.5) for r in got)
    one = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 0, 0), (2, None, 0), (99999, 0, 1)], LABELS)
    assert cotrain.classify(views, cotrain.co_train(views, one, ("quality", "toxic"))).filter(F.col("quality").isNull()).count() == 0


def test_empty(spark):
    views = cotrain.features(frame(spark, []))
    assert cotrain.classify(views, cotrain.co_train(views, spark.createDataFrame([(1, 1, 0)], LABELS), ("quality",))).count() == 0
