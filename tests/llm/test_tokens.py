import pytest
from fixtures import documents, frame

from rayloom.llm import tokens

public = pytest.importorskip("public_tokenizers")


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(frame(spark, clashes=True), path).collect())
    want = []
    for i, text, *_ in documents():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((str(i), len((text or "").encode()), n, n > 2048))
    assert got == sorted(want)


def test_counts_on_the_test_table(spark):
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in tokens.count_tokens(docs, path).collect()} == want


def test_odd_characters_equal_the_library():
    import json
    import random

    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), tokens.WordBpe(json.load(open(path)))
    rng = random.Random(4)
    pool = "aAzZ09'’ \t\n\u0085  　İıſKΣςß中é́ͅǅⅧ½٣🙂‍﻿\x00\x1c_-<|>endoftext"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 30))) for _ in range(3000)] + ["<|endoftext|>", "a<|endoftext|> b<|startoftext|>", "ΑΣ", "ΑΣ Α"]
    bad = [t for t in texts if own.count(t) != len(library.encode(t, add_special_tokens=False).ids)]
    assert not bad, bad[:5]


def test_merging_lowest_rank_first():
    ranks = {("a", "b"): 1, ("b", "c"): 0, ("a", "bc"): 2}
    assert tokens.merged_length(list("abc"), ranks) == 1
    assert tokens.merged_length(list("aab"), ranks) == 2
    assert tokens.merged_length([], ranks) == 0


def test_empty(spark):
    assert tokens.count_tokens(frame(spark, []), public.path("word_bpe_49k.json")).count() == 0
