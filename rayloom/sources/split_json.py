"""JSON documents of any size, read and written in pieces.

A document is an object of arrays, as COCO has it, or one array of records.
To read one, byte ranges are scanned by a first Spark job: a range tells how
its quotes and brackets add up if it begins outside a string and if it begins
inside one, so the state at the start of every range follows by adding up.
Ranges that touch the outermost level are looked through for the arrays' names
and places.  The second job, a data source with a partition a range, gives out
the elements that begin in its range, as JSON strings that Spark parses.
Nothing is guessed, and a task holds one block and one element.

To write one, each task writes the elements of its partition as a piece, and
the commit joins the pieces, in the order of the partitions, block by block.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a range, of which a task scans one, and of the blocks in which it reads them.
RANGE, BLOCK = 32 << 20, 4 << 20
#: Bytes of elements in an Arrow batch, about.
BATCH = 8 << 20

SCHEMA = "file string, section string, at bigint, value string"
OBJECT, ARRAY = ord("{"), ord("[")


def opened(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path) if ":" in path else "file://" + path)


class Brackets:
    """Brackets outside strings, block by block; ``inside`` and ``slashes`` say how the next block begins."""

    def __init__(self, inside: bool = False, slashes: int = 0):
        self.inside, self.slashes = inside, slashes

    def both(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the block, places of all brackets, and for each whether it is outside a string if the block begins outside one."""
        a = np.frombuffer(block, np.uint8)
        slash = a == 92
        quotes = np.flatnonzero(a == 34)
        if len(quotes) and (self.slashes % 2 and quotes[0] == 0 or slash.any()):
            at = np.arange(len(a))
            plain = np.maximum.accumulate(np.where(slash, -1, at))  # the last byte that is no backslash
            before = np.where(quotes > 0, quotes - 1 - plain[quotes - 1], 0)
            before += np.where(before == quotes, self.slashes, 0)  # they reach back into the block before
            quotes = quotes[before % 2 == 0]
        self.slashes = len(block) - len(block.rstrip(b"\\")) + (self.slashes if slash.all() else 0)
        found = np.flatnonzero((a == 123) | (a == 125) | (a == 91) | (a == 93))
        outside = np.searchsorted(quotes, found) % 2 == 0
        self.odd = bool(len(quotes) % 2)
        return a, found, outside

    def next(self, block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the block, places of the brackets outside strings, and 1 for each that opens, -1 for each that closes."""
        a, found, outside = self.both(block)
        found = found[outside != self.inside]
        self.inside ^= self.odd
        return a, found, np.where(a[found] & 2, 1, -1)  # { and [ have that bit, } and ] don't


def _blocks(source, start: int, end: int) -> Iterator[bytes]:
    source.seek(start)
    while start < end and (block := source.read(min(BLOCK, end - start))):
        yield block
        start += len(block)


def _slashes_before(source, at: int) -> int:
    """Backslashes right before a place."""
    back = 64
    while True:
        first = max(0, at - back)
        source.seek(first)
        n = len(told := source.read(at - first)) - len(told.rstrip(b"\\"))
        if n < at - first or first == 0:
            return n
        back *= 8


def summary(source, start: int, end: int) -> tuple[bool, tuple[int, int], tuple[int, int]]:
    """Whether a range's quotes are odd in number, and for a start outside and inside a string what its brackets add up to and come down to."""
    brackets, odd = Brackets(slashes=_slashes_before(source, start)), False
    total, least = [0, 0], [0, 0]
    for block in _blocks(source, start, end):
        a, found, outside = brackets.both(block)
        for k in (0, 1):  # k: the range begins inside a string
            mine = found[outside != (bool(k) ^ odd)]
            if len(mine):
                sums = total[k] + np.cumsum(np.where(a[mine] & 2, 1, -1))
                total[k], least[k] = int(sums[-1]), min(least[k], int(sums.min()))
        odd ^= brackets.odd
    return odd, (total[0], total[1]), (least[0], least[1])


@dataclass
class Range:
    """Bytes of a file, and how they begin."""

    file: str
    start: int
    end: int
    depth: int
    inside: bool


def _name(source, at: int) -> str:
    """The key whose value begins at a place."""
    back = 256
    while True:
        source.seek(max(0, at - back))
        told = source.read(min(at, back))
        if m := re.search(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', told, re.S):
            return json.loads(b'"' + m[1] + b'"')
        if back >= at:
            raise ValueError("a value without a key")
        back *= 8


def outermost(source, part: Range) -> list[tuple[str | None, int, bool]]:
    """What opens and closes in a range at the level of the document's own values: its name and place, and whether it is an array; no name where it closes.

    For a document that is an array, that array itself is named ``records``.
    """
    brackets, depth, at, found = Brackets(part.inside, _slashes_before(source, part.start)), part.depth, part.start, []
    for block in _blocks(source, part.start, part.end):
        a, places, steps = brackets.next(block)
        after = depth + np.cumsum(steps)
        for i in np.flatnonzero((after <= 2) & (steps > 0) | (after <= 1) & (steps < 0)):
            opens, level = steps[i] > 0, int(after[i])
            if opens and level == 1 and a[places[i]] == ARRAY:
                found.append(("records", at + int(places[i]), True))
            elif opens and level == 2:
                found.append(("", at + int(places[i]), a[places[i]] == ARRAY))
            elif not opens:
                found.append((None, at + int(places[i]), False))
        depth = int(after[-1]) if len(after) else depth
        at += len(block)
    return found


def elements(source, part: Range, level: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the objects that begin in a range at ``level``; the last one is read to its end, wherever that is."""
    brackets, depth, at = Brackets(part.inside, _slashes_before(source, part.start)), part.depth, part.start
    size = source.size()
    began, held = None, []  # where the open element began, and its bytes of blocks before
    ends = itertools.chain(_blocks(source, part.start, part.end), _blocks(source, part.end, size))
    for block in ends:
        a, places, steps = brackets.next(block)
        after = depth + np.cumsum(steps)
        edges = np.flatnonzero(np.where(steps > 0, after == level + 1, after == level))
        first = 0  # from here on the block belongs to the open element
        for i in edges:
            place = int(places[i])
            if steps[i] > 0:
                if at + place >= part.end:
                    return
                if a[place] == OBJECT:
                    began, first = at + place, place
            elif began is not None:
                yield began, b"".join((*held, block[first : place + 1]))
                began, held = None, []
        if began is not None:
            held.append(block[first:])
        depth = int(after[-1]) if len(after) else depth
        at += len(block)
        if at >= part.end and began is None:
            return


@dataclass
class Plan:
    """Ranges of documents, and each file's arrays: name, first and last place, and whether it is an array; ``level`` is that of the elements."""

    ranges: list[Range]
    arrays: dict[str, list[tuple[str, int, int, bool]]]
    levels: dict[str, int]

    def to_json(self) -> str:
        return json.dumps({"ranges": [asdict(r) for r in self.ranges], "arrays": self.arrays, "levels": self.levels})

    @staticmethod
    def from_json(text: str) -> Plan:
        told = json.loads(text)
        return Plan([Range(**r) for r in told["ranges"]], told["arrays"], told["levels"])

    def only(self, names: Iterable[str] | None) -> Plan:
        """The ranges in which arrays of some names lie."""
        if names is None:
            return self
        wanted = {f: [a for a in arrays if a[0] in names and a[3]] for f, arrays in self.arrays.items()}
        return Plan([r for r in self.ranges if any(a[1] < r.end and a[2] >= r.start for a in wanted[r.file])], wanted, self.levels)


def add_up(file: str, size: int, told: list[tuple[int, int, bool, tuple[int, int], tuple[int, int]]]) -> tuple[list[Range], list[Range]]:
    """The ranges of a file with how they begin, and those of them that touch the outermost level, from their summaries in order."""
    depth, inside, ranges, edge = 0, False, [], []
    for start, end, odd, total, least in told:
        ranges.append(Range(file, start, end, depth, inside))
        if depth + least[inside] <= 1:
            edge.append(ranges[-1])
        depth += total[inside]
        inside ^= odd
    if depth or inside:
        raise ValueError(f"{file} is no whole JSON document")
    return ranges, edge


def arrays_of(file: str, source, edges: list[list[tuple[str | None, int, bool]]]) -> tuple[list[tuple[str, int, int, bool]], int]:
    """The arrays of a document, and the level of their elements."""
    found, on, records = [], None, False
    for name, place, is_array in itertools.chain.from_iterable(edges):
        if name == "records":
            records, on = True, ("records", place, True)
        elif records and name is not None:
            continue  # an element of a document that is an array
        elif name is not None:
            on = (_name(source, place), place, is_array)
        elif on is not None and not records:
            found.append((on[0], on[1], place, bool(on[2])))
            on = None
        elif records:
            end = place
    if records:
        found = [("records", on[1], end, True)]
    return found, 1 if records else 2


def make_plan(spark: SparkSession, path: str | list[str], size: int = RANGE) -> Plan:
    """Ranges and arrays of the documents at ``path`` (files, folders or patterns).

    Summaries are worked out by tasks; the driver gathers one small row a
    range and reads the few ranges that touch the outermost level.
    """
    files = [(r.path, r.length) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]
    spans = [(f, a, min(a + size, n)) for f, n in files for a in range(0, n, size)]
    if not spans:
        return Plan([], {f: [] for f, _ in files}, {f: 2 for f, _ in files})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, start, end in batch.itertuples(index=False):
                fs, at = opened(file)
                with fs.open_input_file(at) as source:
                    odd, total, least = summary(source, start, end)
                rows.append((file, start, end, odd, *total, *least))
            yield pd.DataFrame(rows, columns=["file", "start", "end", "odd", "t0", "t1", "l0", "l1"])

    given = spark.createDataFrame(spans, "file string, start bigint, end bigint").repartition(min(len(spans), 4096))
    told: dict[str, list] = {f: [] for f, _ in files}
    for r in given.mapInPandas(scan, "file string, start bigint, end bigint, odd boolean, t0 bigint, t1 bigint, l0 bigint, l1 bigint").collect():
        told[r.file].append((r.start, r.end, r.odd, (r.t0, r.t1), (r.l0, r.l1)))
    plan = Plan([], {}, {})
    for file, size_of in files:
        ranges, edge = add_up(file, size_of, sorted(told[file]))
        plan.ranges += ranges
        fs, at = opened(file)
        with fs.open_input_file(at) as source:
            plan.arrays[file], plan.levels[file] = arrays_of(file, source, [outermost(source, r) for r in edge])
    return plan


class _Part(InputPartition):
    def __init__(self, part: Range, arrays: list, level: int):
        self.part, self.arrays, self.level = part, arrays, level


class _Reader(DataSourceReader):
    def __init__(self, plan: Plan):
        self.plan = plan

    def partitions(self):
        return [_Part(r, self.plan.arrays[r.file], self.plan.levels[r.file]) for r in self.plan.ranges] or [InputPartition(None)]

    def read(self, partition):
        if not isinstance(partition, _Part):
            return
        part, arrays = partition.part, sorted((a[1], a[2], a[0]) for a in partition.arrays if a[3])
        starts, kind = [a[0] for a in arrays], pa.schema([("file", pa.string()), ("section", pa.string()), ("at", pa.int64()), ("value", pa.string())])
        fs, path = opened(part.file)

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kind.types)], schema=kind)

        with fs.open_input_file(path) as source:
            rows, weight = [], 0
            for at, value in elements(source, part, partition.level):
                k = bisect.bisect_right(starts, at) - 1
                if k < 0 or at > arrays[k][1]:
                    continue  # in none of the arrays that are asked for
                rows.append((part.file, arrays[k][2], at, value.decode("utf-8")))
                weight += len(value)
                if weight >= BATCH or len(rows) >= 1000:
                    yield batch(rows)
                    rows, weight = [], 0
            if rows:
                yield batch(rows)


class _Piece(WriterCommitMessage):
    def __init__(self, order: int, names: dict[str, str]):
        self.order, self.names = order, names


class _Writer(DataSourceWriter):
    """Pieces by section; ``sections`` names the arrays in their order.  ``records`` alone is a document that is an array."""

    def __init__(self, options: dict):
        self.path, self.sections = options["path"], options["sections"].split(",")
        self.pieces = f"{self.path}.{uuid.uuid4().hex}.pieces"

    def write(self, iterator):
        from pyspark import TaskContext

        fs, folder = opened(self.pieces)
        fs.create_dir(folder, recursive=True)
        order, names, out, on = TaskContext.get().partitionId(), {}, None, None
        for row in iterator:  # rows of a section come one after another
            if row.section != on:
                if out is not None:
                    out.close()
                on = row.section
                if on in names:
                    raise ValueError("rows of a section must come together")
                names[on] = f"{on}-{order}-{uuid.uuid4().hex}"
                out = fs.open_output_stream(f"{folder}/{names[on]}")
                out.write(row.value.encode("utf-8"))
            else:
                out.write(b",\n" + row.value.encode("utf-8"))
        if out is not None:
            out.close()
        return _Piece(order, names)

    def commit(self, messages):
        fs, folder = opened(self.pieces)
        _, path = opened(self.path)
        half = f"{path}.{uuid.uuid4().hex}.half"
        said = sorted((m for m in messages if m is not None), key=lambda m: m.order)
        try:
            with fs.open_output_stream(half) as out:
                alone = self.sections == ["records"]
                for k, section in enumerate(self.sections):
                    out.write(b"[" if alone else (", " if k else "{").encode() + json.dumps(section).encode() + b": [")
                    for n, name in enumerate(m.names[section] for m in said if section in m.names):
                        out.write(b",\n" if n else b"")
                        with fs.open_input_stream(f"{folder}/{name}") as piece:
                            while block := piece.read(BLOCK):
                                out.write(block)
                    out.write(b"]")
                out.write(b"" if alone else b"}")
            fs.move(half, path)
        except BaseException:
            if fs.get_file_info(half).is_file:
                fs.delete_file(half)
            raise
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs as kinds

        fs, folder = opened(self.pieces)
        if fs.get_file_info(folder).type != kinds.FileType.NotFound:
            fs.delete_dir(folder)


class JsonArrays(DataSource):
    """``split_json``: ``file, section, at, value`` of the elements of a document's arrays, and such rows as a document."""

    @classmethod
    def name(cls):
        return "split_json"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(Plan.from_json(self.options["plan"]))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options))


def read_elements(spark: SparkSession, plan: Plan, names: Iterable[str] | None = None) -> DataFrame:
    """``file, section, at, value``: JSON of the objects in the arrays of some names, or of all; ``at`` is a place in the file."""
    spark.dataSource.register(JsonArrays)
    return spark.read.format("split_json").option("plan", plan.only(names).to_json()).load()


def write_arrays(arrays: dict[str, DataFrame], path: str, order: str = "id") -> None:
    """One document of several arrays, by name, at ``path``; elements ascend by ``order``, null first.

    Rows are dealt out by ranges of (array, order), so a task has its share of
    the elements whatever their number.  The document appears when all of it
    is written; an attempt that fails leaves none.
    """
    spark, rows = next(iter(arrays.values())).sparkSession, None
    for k, (name, df) in enumerate(arrays.items()):
        some = df.select(F.lit(k).alias("nth"), F.lit(name).alias("section"), F.col(order).cast("bigint").alias("key"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
        rows = some if rows is None else rows.unionByName(some)
    spark.dataSource.register(JsonArrays)
    dealt = rows.repartitionByRange("nth", "key", "value").sortWithinPartitions("nth", "key", "value")
    told = dealt.select(F.lit("").alias("file"), "section", F.lit(0).cast("bigint").alias("at"), "value")
    told.write.format("split_json").option("path", path).option("sections", ",".join(arrays)).mode("append").save()
