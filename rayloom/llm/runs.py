"""Periodic runs in texts by the runs theorem.

Every run (a maximal stretch with a smallest period, at least two periods
long) holds a root that is the longest Lyndon word at its place under one of
the two orders of words.  The longest Lyndon word at ``i`` ends before the
next smaller value of the inverse suffix array, so two suffix arrays give two
candidates a word; a candidate's extent to both sides is a longest common
extension, a range minimum over the common prefixes of neighbouring suffixes.

Texts are independent.  A task lays the texts of an Arrow batch beside each
other and works on their words as arrays; a suffix is only ever compared with
suffixes of its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rayloom.llm.common import modest_batches

#: Words of the texts that are worked on at once; a longer text is worked on alone.
CHUNK_WORDS = 250_000

SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


class Suffixes:
    """Ranks and common prefixes of the suffixes of texts laid beside each other.

    ``words`` holds each text's numbers (1 and more) and a 0 behind it,
    ``text`` the text that a place belongs to.  Ranks double the length that
    they compare until all differ; only places that still share a rank are
    sorted again.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray):
        n = len(words)
        self.ends = np.flatnonzero(words == 0)
        key = text * (int(words.max(initial=0)) + 1) + words
        self.order = np.argsort(key, kind="stable")
        told = key[self.order]
        new = np.ones(n, bool)
        new[1:] = told[1:] != told[:-1]
        self.rank = np.empty(n, np.int64)
        self.rank[self.order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        self.history, step = [self.rank.astype(np.int32)], 1
        while True:
            alone = new.copy()
            alone[:-1] &= new[1:]
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            at = self.order[slots]  # no such place is within step of its text's end
            pair = self.rank[at] * n + self.rank[at + step]
            by = np.argsort(pair, kind="stable")
            at, pair = at[by], pair[by]
            self.order[slots] = at
            new[slots[1:]] |= pair[1:] != pair[:-1]
            self.rank[at] = np.maximum.accumulate(np.where(new, np.arange(n), 0))[slots]
            self.history.append(self.rank.astype(np.int32))
            step *= 2

    def next_smaller(self) -> np.ndarray:
        """The first later place whose suffix is smaller; a text's end, smaller than all of it, has itself."""
        rank = self.rank
        after = np.arange(1, len(rank) + 1)
        after[self.ends] = self.ends
        on = np.flatnonzero(rank[after] > rank)
        while len(on):
            after[on] = after[after[on]]  # what lies between is larger than the place passed
            on = on[rank[after[on]] > rank[on]]
        return after

    def prepare(self) -> None:
        """Common prefixes of neighbouring suffixes, and minima over 1, 2, 4, ... of them."""
        a, b = self.order[:-1], self.order[1:]
        common = np.zeros(len(a), np.int32)
        on = np.flatnonzero(self.history[0][a] == self.history[0][b])
        for k in range(len(self.history) - 1, -1, -1):
            told = self.history[k]
            equal = told[a[on] + common[on]] == told[b[on] + common[on]]
            common[on[equal]] += 1 << k
        self.minima = [common]

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the common prefixes of the suffixes at ``i`` and at ``j``, two different places."""
        low, high = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        if not len(low):
            return low
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        while len(self.minima) <= level.max():
            last, half = self.minima[-1], 1 << (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))
        out = np.empty(len(low), np.int64)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.minima[k][low[on]], self.minima[k][high[on] - (1 << int(k))])
        return out


def find_runs(texts: list[np.ndarray], least_periods: int = 4, least_length: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``text, start, length, period`` of all runs of at least ``least_periods`` (2 or more) periods and ``least_length`` words, by text, start and period.

    A text is an array of numbers from 1 on, one a word.
    """
    nothing = np.zeros(0, np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return nothing, nothing, nothing, nothing
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    words = np.zeros(len(text), np.int64)
    here = np.arange(len(text)) - begins[text]
    inside = here < sizes[text]
    words[inside] = np.concatenate(texts)
    mirror = np.where(inside, begins[text] + sizes[text] - 1 - here, np.arange(len(text)))  # the same texts from their ends
    least = Suffixes(words, text)
    roots = []
    for told in (least, Suffixes(np.where(inside, int(words.max()) + 1 - words, 0), text)):
        at = np.flatnonzero(inside)
        behind = told.next_smaller()[at]
        fits = ((behind - at) * least_periods <= sizes[text[at]]) & (words[at] == words[behind])
        roots.append((at[fits], behind[fits]))
    at, behind = (np.concatenate(x) for x in zip(*roots))
    if not len(at):
        return nothing, nothing, nothing, nothing
    least.prepare()
    period = behind - at
    right = least.extend(at, behind)
    whole = right > (least_periods - 2) * period  # for one of the roots that begin in a run's first period
    at, behind, period, right = at[whole], behind[whole], period[whole], right[whole]
    back = Suffixes(words[mirror], text)
    back.prepare()
    left = np.zeros(len(at), np.int64)
    more = here[at] > 0
    left[more] = back.extend(mirror[at[more] - 1], mirror[behind[more] - 1])
    length = period + right + left
    start = here[at] - left
    kept = (length >= least_periods * period) & (length >= least_length)
    told = np.unique(np.stack([text[at], start, period, length], axis=1)[kept], axis=0)
    return told[:, 0], told[:, 1], told[:, 3], told[:, 2]


def _chunk(texts: list[list[bytes]], least_periods: int, least_length: int) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    """Runs a text, their starts, lengths and periods, and each text without repeats."""
    known: dict[bytes, int] = {}
    coded = [np.fromiter((known.setdefault(w, len(known) + 1) for w in t), np.int64, len(t)) for t in texts]
    of, start, length, period = find_runs(coded, least_periods, least_length)
    counts = np.bincount(of, minlength=len(texts))
    kept, first = [], np.concatenate(([0], np.cumsum(counts)))
    for k, words in enumerate(texts):
        if counts[k]:
            mine = slice(first[k], first[k + 1])
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, start[mine] + period[mine], 1)
            np.add.at(edges, start[mine] + length[mine], -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]
        kept.append(b" ".join(words))
    return counts.tolist(), [start, length, period], kept


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_periods: int = 4, least_length: int = 6) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``: each run's ``start, length, period`` by start, then period, and the text without what repeats.

    Words are runs of anything but ASCII white space.  A word is left out of
    ``collapsed`` where any run holds it behind that run's first period; the
    others are joined by one space.  A null or empty text has no words and
    collapses to the empty text.  Texts are taken whole; a task holds about
    400 bytes a word of its longest text, and as much of shorter ones together
    as ``CHUNK_WORDS`` words take.  Rows are independent: repeated rows and
    null ids come out as they went in, an empty table gives no rows, and other
    columns are ignored.
    """
    modest_batches(docs.sparkSession)
    told = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < batch.num_rows:
                first, words, held = at, 0, []
                while at < batch.num_rows and (not words or words < CHUNK_WORDS):
                    held.append((texts[at].as_py() or "").encode("utf-8", "surrogatepass").split())
                    words += len(held[-1])
                    at += 1
                counts, columns, kept = _chunk(held, least_periods, least_length)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32())
                runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(run)))
                sizes = pa.array([len(w) for w in held], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(first, at - first), sizes, runs, pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return told.mapInArrow(work, f"doc_id {told.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")
