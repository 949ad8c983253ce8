"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ["key", "node", "size", "row", "tkey", "found", "cands", "m", "s", "epoch", "kept", "rows", "hash"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(400)) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    base = prose(rng, 200)
    shared = prose(rng, 90)
    for i in range(n):
        text = prose(rng, rng.randrange(1, 160))
        if i % 7 == 0:
            words = base.split()
            for _ in range(i // 21):
                words[rng.randrange(len(words))] = "edit" + str(i)
            text = " ".join(words)
        elif i % 7 == 1:
            text = text + "\n" + shared + "\n" + prose(rng, 20)
        elif i % 7 == 2:
            text = "\n".join([prose(rng, 6)] * 4 + [text])
        rows.append((i, text, ("en", "de", None)[i % 3], (None, "a", "b", "c")[i % 4], len(text)))
    long = prose(rng, 6000)
    odd = [
        (1000, None, "en", "a", None), (1001, "", None, None, 0), (1002, " \t\n ", "en", "b", 4), (1003, long, "en", "c", len(long)), (1004, long + " more", "en", "c", 1),
        (1005, "İß Σ ﬁ 中文字符 éé   don't I'LL <|startoftext|> 😀  x", "fr", "a", 1), (1006, "one two three four", "en", "a", 1), (1007, "One two THREE four", "en", "a", 1),
        (None, "no id here but some words all the same to be counted", "en", "a", 1), (7, rows[7][1], "en", "a", 1), (1008, "x" * 5000, "en", "a", 1), (1009, "same line\n" * 300, "en", "b", 1),
    ]
    return rows + odd + [rows[3], rows[3]]


def frame(spark, rows=None, clashes=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASHES}) if clashes else df
