"""Column functions for matches in long texts: positions, contexts and cuts, in time linear in the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that are summed one by one; longer arrays are summed by such parts.
PART = 512
#: Code points of a block of a text that is cut.
BLOCK = 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sums(lengths: Column) -> Column:
    """Sums of the elements before each, and of all; an append copies the array."""
    return F.aggregate(lengths, F.array(F.lit(0).cast("long")), lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n))


def running(lengths: Column) -> Column:
    """The same part by part, so that long arrays are not copied for each element."""
    parts = let(lengths, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PART).cast("int")), lambda i: _sums(F.slice(x, i * PART + 1, F.lit(PART)))))
    put = lambda p: let(_sums(F.transform(p, lambda x: F.element_at(x, -1))), lambda before: F.concat(F.flatten(F.transform(p, lambda x, i: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda n: n + F.get(before, i)))), F.array(F.element_at(before, -1))))
    return let(parts, put)


def lengths(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.length(p).cast("long"))


def matches(text: Column, pattern: str, entry: Callable[[Column, Column, Column, Column], Column], kind: str) -> Column:
    """``entry(start, match, before, after)`` of each match of ``pattern``, leftmost and non-overlapping, as ``kind``; positions in code points.

    ``before`` and ``after`` are what lies between a match and its neighbours;
    their lengths give the positions.  A text without any match is searched
    once, another twice.  No match and a null text give an empty array.
    """

    def told(parts: Column, i: Column) -> Column:
        start = F.get(parts["gaps"], i + 1) + F.get(parts["sizes"], i)
        return entry(start, F.get(parts["whole"], i), F.get(parts["between"], i), F.get(parts["between"], i + 1))

    def entries(between: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        parts = let(whole, lambda w: F.struct(running(lengths(between)).alias("gaps"), running(lengths(w)).alias("sizes"), w.alias("whole"), between.alias("between")))
        all_told = let(parts, lambda p: F.transform(F.sequence(F.lit(0), F.size(p["whole"]) - 1), lambda i: told(p, i)))
        return F.when(F.size(between) > 1, all_told).otherwise(F.array().cast(kind))

    return F.coalesce(let(F.split(text, pattern, -1), entries).cast(kind), F.array().cast(kind))


def blocks(text: Column) -> Column:
    """A text as blocks of ``BLOCK`` code points, the last one shorter."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of a text in :func:`blocks`; only the blocks that they lie in are read."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    part = lambda i, a, n: F.substring(F.coalesce(F.get(pieces, i), F.lit("")), a.cast("int"), n.cast("int"))
    one = part(first, start % BLOCK + 1, end - start)
    many = F.concat(part(first, start % BLOCK + 1, F.lit(BLOCK)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), part(last, F.lit(1), end % BLOCK))
    return F.when(first == last, one).otherwise(many)
