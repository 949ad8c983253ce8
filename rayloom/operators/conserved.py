"""Counts that a plan gathers as it runs, held against each other when it has run."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class NotConserved(AssertionError):
    """Rows were lost or made on the way."""


class Conservation:
    """Watches tables of one plan; no table is read a second time.

    ``watch`` a table wherever it passes through the plan, state with
    ``expect`` which sums of counts are equal, run the plan, then ``verify``.
    """

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}
        self._equal: list[tuple[tuple[str, ...], tuple[str, ...]]] = []

    def watch(self, df: DataFrame, name: str, **kinds: Column) -> DataFrame:
        """``df``, counted as ``name``, and as ``name.kind`` where a kind's condition is true."""
        seen = Observation(f"{name}-{uuid.uuid4().hex}")
        self._seen[name] = seen
        counts = [F.count(F.lit(1)).alias("all"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in kinds.items()]]
        return df.observe(seen, *counts)

    def expect(self, left: str, right: str) -> None:
        """Sums of counts, as ``tags.TP + tags.FP`` and ``detections``."""
        self._equal.append(tuple(tuple(x.strip() for x in side.split("+")) for side in (left, right)))

    def count(self, name: str) -> int:
        table, _, kind = name.partition(".")
        return self._seen[table].get[kind or "all"]

    def counts(self) -> dict[str, dict[str, int]]:
        return {name: dict(seen.get) for name, seen in self._seen.items()}

    def verify(self) -> dict[str, dict[str, int]]:
        """All counts; an error where a sum isn't what it should be.  The plan must have run."""
        for sides in self._equal:
            told = [sum(self.count(name) for name in side) for side in sides]
            if told[0] != told[1]:
                raise NotConserved(f"{' + '.join(sides[0])} is {told[0]}, {' + '.join(sides[1])} is {told[1]}")
        return self.counts()
