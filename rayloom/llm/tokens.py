"""Token counts by heap-and-linked-list byte-pair merging.

A word's symbols form a doubly linked list and its adjacent pairs a heap by
merge rank.  The lowest-rank pair is popped and merged again and again; the
count is the number of initial symbols minus the merges.  No identifier is
looked up or emitted.  Spark hands each task Arrow batches of whole texts; a
bounded memo keeps the counts of words that a task has met.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.llm.common import modest_batches

#: The tokenizer's own white space, contractions and character classes: fixed values.
SPACE = r"\t-\r\x20\x85\xA0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"

#: Words whose counts a task keeps.
MEMO_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left after merging the lowest-rank adjacent pair, leftmost first, until none is known."""
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = list(symbols)
    heap = [(rank, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # one of the two has been merged since
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := ranks.get((a + b, symbols[k]))) is not None:
                heapq.heappush(heap, (rank, i, a + b, symbols[k]))
        if (h := before[i]) >= 0 and (rank := ranks.get((symbols[h], a + b))) is not None:
            heapq.heappush(heap, (rank, h, symbols[h], a + b))
    return left


class WordBpe:
    """Counts of the lower-casing word BPE in a ``tokenizers`` JSON file."""

    def __init__(self, spec: dict):
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"])
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.end = spec["model"].get("end_of_word_suffix") or ""
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.words, self.bytes, self.memo = regex.compile(WORDS), byte_symbols(), {}

    def word(self, word: str) -> int:
        symbols = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        symbols[-1] += self.end
        return merged_length(symbols, self.ranks)

    def piece(self, text: str) -> int:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each character is lowered by itself
        total, memo = 0, self.memo
        for word in self.words.findall(text.lower()):
            if (n := memo.get(word)) is None:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                n = self.word(word)
                if len(word) <= 64:
                    memo[word] = n
            total += n
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text; a special token's string inside it is one token."""
        if self.special is None or "<|" not in text and not self.special.search(text):
            return self.piece(text)
        pieces = self.special.split(text)
        return len(pieces) - 1 + sum(map(self.piece, pieces))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row of ``docs``.

    ``tokenizer`` is the path of a ``tokenizers`` JSON file that the driver can
    open; its contents (a fixed vocabulary, a few MB) go to the tasks as one
    broadcast variable.  A null text counts as empty: no bytes, no tokens.
    Texts of any length are counted whole.  Rows are independent: repeated
    rows and null ids come out as they went in, an empty table gives no rows,
    and other columns are ignored.
    """
    modest_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    slim = {"added_tokens": spec["added_tokens"], "model": {k: spec["model"].get(k) for k in ("merges", "end_of_word_suffix")}}
    held = docs.sparkSession.sparkContext.broadcast(json.dumps(slim))

    @F.pandas_udf(T.LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = WordBpe(json.loads(held.value))
        for texts in batches:
            yield pd.Series([bpe.count(t) if t else 0 for t in texts], dtype="int64")

    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        tokens(F.col(text_col)).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
