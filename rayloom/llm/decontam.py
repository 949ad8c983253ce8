"""Benchmark decontamination with an FM-index per training shard.

A shard is a slice of an Arrow batch of whole documents.  All its words become
symbols, a suffix array gives the Burrows-Wheeler transform, and a wavelet
matrix answers rank queries on it.  All test phrases of a block are searched
backwards at once; the rows found are located by walking to sampled suffix
positions, and the occurrences of a document merge into removal spans.  Words
are told apart by 64-bit hashes; every occurrence is then compared word by word
with its phrase.

The benchmark is streamed through the driver in blocks of a bounded size.  The
first one is broadcast, the others go to files of the shared folder, which a
task reads one after another for some shards at a time.  So the documents are
read and indexed once, whatever the size of the benchmark.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.lineage import scratch
from rayloom.llm.common import modest_batches

#: Words of a phrase; items of fewer words are one phrase.
WINDOW = 10
#: Bytes of text in one index, bytes of words in a block of phrases, and words of an item that are taken as one part.
SHARD_BYTES, BLOCK_BYTES, PART_WORDS = 1_000_000, 2_000_000, 20_000
#: Shards whose indexes are held while all blocks but the first are read one after another.
TOGETHER = 16
#: Every so many positions of the indexed sequence is kept for locating.
SAMPLE = 16

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def lowered(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word."""
    raw = np.frombuffer(data, np.uint8)
    inside = _IS_WORD[raw]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    letters = raw[inside].astype(np.uint64)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _MULTIPLIER))
    hashes = np.add.reduceat((letters + np.uint64(1)) * powers[np.arange(len(letters)) - np.repeat(first, lengths)], first)
    hashes ^= hashes >> np.uint64(29)
    return starts, ends, hashes * _MULTIPLIER


@dataclass
class Phrases:
    """The phrases of a block: words by part of an item, and for each phrase length hashes and the places they stand for."""

    items: list[str | None]
    words: list[list[bytes]]
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> (hashes, first place of each, places as (part, word))

    @classmethod
    def of(cls, parts: list[tuple[str | None, bytes]]) -> Phrases:
        """``parts``: an item and some of its words, joined by blanks."""
        words = [said.split(b" ") for _, said in parts]
        hashes = [hashed_words(said)[2] for _, said in parts]
        met: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for i, h in enumerate(hashes):
            size = min(WINDOW, len(h))
            places = np.column_stack((np.full(len(h) - size + 1, i), np.arange(len(h) - size + 1)))
            met.setdefault(size, []).append((np.lib.stride_tricks.sliding_window_view(h, size), places))
        by_length = {}
        for size, some in met.items():
            rows, places = (np.concatenate(x) for x in zip(*some))
            powers = np.multiply.accumulate(np.full(size, _MULTIPLIER))
            mixed = (rows * powers).sum(axis=1, dtype=np.uint64)
            order = np.argsort(mixed, kind="stable")
            first = np.flatnonzero(np.concatenate(([True], (rows[order[1:]] != rows[order[:-1]]).any(axis=1))))
            by_length[size] = (rows[order[first]], np.append(first, len(order)), places[order])
        return cls([i for i, _ in parts], words, by_length)


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``sequence``, numbers from 0 on of which the last is the only least one.

    Some symbols are packed into a first key; then the sorted length doubles,
    and only suffixes that are still alike are sorted again.
    """
    n, width = len(sequence), int(sequence.max() + 1).bit_length()
    step = max(1, 62 // width)
    key, padded = np.zeros(n, np.int64), np.concatenate((sequence.astype(np.int64) + 1, np.zeros(step, np.int64)))
    for k in range(step):
        key = (key << width) | padded[k : k + n]
    order = np.argsort(key, kind="stable")
    key, alike, rank = key[order], np.arange(n), np.empty(n, np.int64)
    while True:
        head = np.concatenate(([True], key[1:] != key[:-1]))
        rank[order[alike]] = alike[head][np.cumsum(head) - 1]
        sizes = np.diff(np.append(np.flatnonzero(head), len(head)))
        alike = alike[np.repeat(sizes > 1, sizes)]
        if not len(alike):
            return order
        some = order[alike]
        after = np.where(some + step < n, rank[np.minimum(some + step, n - 1)] + 1, 0)
        key = rank[some] * (n + 1) + after
        turn = np.argsort(key, kind="stable")
        order[alike], key, step = some[turn], key[turn], 2 * step


class WaveletMatrix:
    """Rank of a symbol in a prefix, for arrays of symbols and prefixes."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels, self.zeros = [], []
        self.bits = max(1, int(alphabet - 1).bit_length())
        symbols = symbols.astype(np.int32)
        for shift in range(self.bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
            self.levels.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` is among the first ``upto``."""
        lo, hi = np.zeros_like(upto), upto.copy()
        for depth, (ones, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - depth)) & 1).astype(bool)
            a, b = ones[lo], ones[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo


class FmIndex:
    """Backward search in runs of symbols; a run ends in a separator, and no occurrence crosses one.

    ``sequence`` holds symbols from 1 on and a 0 after each run.
    """

    def __init__(self, sequence: np.ndarray):
        n, ends = len(sequence), np.flatnonzero(sequence == 0)
        told = sequence.astype(np.int64) + len(ends) - 1
        told[ends] = np.arange(len(ends) - 1, -1, -1)  # separators are all unlike, and less than any symbol
        order = suffix_array(told)
        self.alphabet = int(sequence.max()) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=self.alphabet))))
        self.last = sequence[order - 1]
        self.wavelet = WaveletMatrix(self.last, self.alphabet)
        self.sampled = np.where((order % SAMPLE == 0) | (sequence[order - 1] == 0), order, -1)
        self.size = n

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows ``lo <= row < hi`` of the suffixes that begin with each phrase; symbols below 1 are in no run."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.flatnonzero(((phrases > 0) & (phrases < self.alphabet)).all(axis=1))
        hi[np.setdiff1d(np.arange(len(phrases)), alive)] = 0
        for column in range(phrases.shape[1] - 1, -1, -1):
            s = phrases[alive, column]
            lo[alive] = self.before[s] + self.wavelet.rank(s, lo[alive])
            hi[alive] = self.before[s] + self.wavelet.rank(s, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence, by steps back to the nearest sampled suffix."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walking = np.flatnonzero(self.sampled[at] < 0)
        while len(walking):
            row = at[walking]
            s = self.last[row]
            at[walking] = self.before[s] + self.wavelet.rank(s, row)
            steps[walking] += 1
            walking = walking[self.sampled[at[walking]] < 0]
        return self.sampled[at] + steps


class Shard:
    """Some texts' words, and the index of them; built once, searched for any number of blocks of phrases."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        self.starts, self.ends, hashes = hashed_words(self.data)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.owner = np.searchsorted(bounds, self.starts, side="right")
        self.counts = np.bincount(self.owner, minlength=len(texts))
        self.firsts = np.cumsum(self.counts) - self.counts
        self.index = None
        if len(hashes):
            self.vocabulary, number = np.unique(hashes, return_inverse=True)
            last = np.unique(np.cumsum(self.counts)[self.counts > 0])
            self.place = np.insert(np.arange(len(hashes)), last, -1)
            self.index = FmIndex(np.insert(number + 1, last, 0))

    def occurrences(self, block: Phrases) -> Iterator[tuple[int, int, str | None, int]]:
        """Confirmed occurrences: text, its first word, item, words."""
        if self.index is None:
            return
        starts, ends = self.starts, self.ends
        for size, (phrases, firsts_of, places) in block.by_length.items():
            at = np.minimum(np.searchsorted(self.vocabulary, phrases), len(self.vocabulary) - 1)
            lo, hi = self.index.search(np.where(self.vocabulary[at] == phrases, at + 1, 0))
            hit = np.flatnonzero(hi > lo)
            many = hi[hit] - lo[hit]
            rows = np.repeat(lo[hit] - np.cumsum(many) + many, many) + np.arange(many.sum())
            for phrase, word in zip(np.repeat(hit, many).tolist(), self.place[self.index.locate(rows)].tolist()):
                said = [self.data[a:b] for a, b in zip(starts[word : word + size].tolist(), ends[word : word + size].tolist())]
                for part, k in places[firsts_of[phrase] : firsts_of[phrase + 1]].tolist():
                    if block.words[part][k : k + size] == said:
                        yield int(self.owner[word]), word, block.items[part], size


def joined(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Word spans (first, last, start, end) merged where they meet or overlap."""
    out: list[tuple[int, ...]] = []
    for a, b, start, end in sorted(spans):
        if out and a <= out[-1][1]:
            x, y, low, high = out[-1]
            out[-1] = (x, max(y, b), low, max(high, end))
        else:
            out.append((a, b, start, end))
    return out


def reports(texts: list[list[bytes]], blocks: Iterable[Phrases]) -> list[tuple[int, list[str], list[tuple[int, ...]]]]:
    """For each text of some shards: words, items by id, and merged spans of words and bytes.  Each block is searched in all shards before the next one."""
    shards = [Shard(t) for t in texts]
    offsets = [np.concatenate(([0], np.cumsum([len(t) + 1 for t in some]))) for some in texts]
    hits: dict[tuple[int, int], set[tuple[int, ...]]] = {}
    items: dict[tuple[int, int], set[str]] = {}
    for block in blocks:
        for k, shard in enumerate(shards):
            for text, word, item, size in shard.occurrences(block):
                own, off = word - int(shard.firsts[text]), int(offsets[k][text])
                hits.setdefault((k, text), set()).add((own, own + size, int(shard.starts[word]) - off, int(shard.ends[word + size - 1]) - off))
                if item is not None:
                    items.setdefault((k, text), set()).add(item)
    return [(int(n), sorted(items.get((k, i), ())), joined(list(hits.get((k, i), ())))) for k, shard in enumerate(shards) for i, n in enumerate(shard.counts)]


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items and their words in blocks of ``BLOCK_BYTES``, streamed through the driver one at a time; at least one block.

    A long item comes in parts that share words, so that every phrase is in one.
    """
    block: list[tuple[str | None, bytes]] = []
    size = 0
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).filter(F.col(text_col).isNotNull()).toLocalIterator(prefetchPartitions=True):
        words = WORDS.findall(lowered(text))
        for at in range(0, max(1, len(words) - WINDOW + 1), PART_WORDS - WINDOW + 1) if words else ():
            if size > BLOCK_BYTES:
                yield block
                block, size = [], 0
            block.append((item, b" ".join(words[at : at + PART_WORDS])))
            size += len(block[-1][1])
    yield block


SPAN = T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "start", "end")])
REPORT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(SPAN))])


def scanner(held, files: list[str]):
    """A column function, text to ``REPORT``, for a broadcast block and for those in ``files``, of which one is held at a time."""

    @F.pandas_udf(REPORT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        first = Phrases.of(held.value)

        def blocks() -> Iterator[Phrases]:
            yield first
            for name in files:
                fs, path = opened(name)
                with fs.open_input_stream(path) as source:
                    yield Phrases.of([(item, words.encode("utf-8", "surrogatepass")) for item, words in json.loads(source.read())])

        for batch in batches:
            rows: list[tuple] = []
            shards: list[list[bytes]] = [[]]
            size, given = 0, list(batch)
            for i, text in enumerate(given):
                shards[-1].append(lowered(text))
                size += len(shards[-1][-1])
                if i == len(given) - 1 or size >= SHARD_BYTES and len(shards) == (TOGETHER if files else 1):
                    rows += [(n, items, [dict(zip(SPAN.names, s)) for s in spans]) for n, items, spans in reports(shards, blocks())]
                    shards, size = [[]], 0
                elif size >= SHARD_BYTES:
                    shards.append([])
                    size = 0
            yield pd.DataFrame(rows, columns=REPORT.names)

    return scan


def opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else "file://" + path)


@F.pandas_udf(T.StringType())
def without(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The text without the bytes of its spans."""
    for texts, runs in batches:
        rows = []
        for text, spans in zip(texts, runs):
            if text is not None and len(spans):
                data = text.encode("utf-8", "surrogatepass")
                edges = [0, *(x for s in spans for x in (s["start"], s["end"])), len(data)]
                text = "".join(data[a:b].decode("utf-8", "surrogatepass") for a, b in zip(edges[::2], edges[1::2]))
            rows.append(text)
        yield pd.Series(rows, dtype=object)


def scanned(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str = "item_id", phrase_col: str = "text") -> DataFrame:
    """``row, report`` of every row of ``docs``: all its columns, and ``REPORT``."""
    spark = docs.sparkSession
    modest_batches(spark)
    blocks = phrase_blocks(benchmark, item_col, phrase_col)
    first, files = next(blocks), []
    for block in blocks:  # each goes to a file of the shared folder, so that neither the driver nor a task holds more than one
        files.append(f"{scratch(spark, 'phrases')}.json")
        fs, path = opened(files[-1])
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out:
            out.write(json.dumps([(item, words.decode("utf-8", "surrogatepass")) for item, words in block]).encode("ascii"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, scanner(spark.sparkContext.broadcast(first), files)(F.col(text_col)).alias("report"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_hit, items, spans, contaminated`` of every row of ``docs``.

    ``items``: ids, as strings, of the items with a phrase in the text;
    ``spans``: merged word and byte ranges of the occurrences.  A null text, or
    one of no words, has zeros and empty lists.  Null or wordless items have
    no phrases; items with a null id are found like others, but not named;
    rows of the same item id are one item.  Texts and items of any length are
    whole.  Repeated rows and null ids come out as they went in; empty tables
    are fine on either side, and other columns are ignored.
    """
    found = scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, "text")
    n_hit = F.aggregate("report.spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select("row.doc_id", "report.n_words", n_hit.alias("n_hit"), "report.items", "report.spans", (F.size("report.spans") > 0).alias("contaminated"))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the occurrences cut out of the texts; all rows and columns stay.

    Null texts stay null, and texts without an occurrence as they are.  Items,
    repeated rows and empty tables are as in :func:`find_contamination`;
    columns may have any names.
    """
    found = scanned(docs, benchmark, text_col)
    text = without(F.col("row")[text_col], F.col("report.spans"))
    return found.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)


def brute_force(text: str | None, benchmark: list[tuple[object, str | None]]) -> tuple[int, int, list[str]]:
    """What ``find_contamination`` must say of one text, by comparing everything."""
    words = WORDS.findall(lowered(text))
    hit, items = set(), set()
    for item, said in benchmark:
        other = WORDS.findall(lowered(said))
        size = min(WINDOW, len(other))
        windows = {tuple(other[i : i + size]) for i in range(len(other) - size + 1)} if other else set()
        for i in range(len(words) - size + 1 if windows else 0):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                if item is not None:
                    items.add(str(item))
    return len(words), len(hit), sorted(items)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


#: DuckDB SQL for the contract's columns, by joining windows.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), s AS (
  SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0
), phrases AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM s)
), windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM s))
), met AS (
  SELECT doc_id, i, n, item FROM windows JOIN phrases USING (n, phrase)
), hits AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM met) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, item FROM met WHERE item IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""
