"""Ellipses through point tables of any size."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rayloom.functions.geometry import ellipse_of_scatter, ellipse_ring
from rayloom.lineage import stored

#: Powers of x and y whose sums make up the scatter of a conic's six terms.
POWERS = [(i, j) for i in range(5) for j in range(5 - i)]
#: The terms of a conic, as powers of x and y.
TERMS = [(2, 0), (1, 1), (0, 2), (1, 0), (0, 1), (0, 0)]

ELLIPSE = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y", "a", "b", "angle")] + [T.StructField("ring", T.ArrayType(T.DoubleType()))])


def scatter_of(sums: dict[tuple[int, int], float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 6 x 6 scatter in its parts, of squares and of linear terms."""
    whole = np.array([[sums[a + c, b + d] for c, d in TERMS] for a, b in TERMS])
    return whole[:3, :3], whole[:3, 3:], whole[3:, 3:]


def _solved(corners: int):
    @F.pandas_udf(ELLIPSE)
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for mx, my, spread, *sums in batches:
            rows = []
            for x, y, s, *values in zip(mx, my, spread, *sums):
                known = dict(zip(POWERS, values))
                fit = ellipse_of_scatter(*scatter_of(known)) if known[0, 0] >= 5 and np.isfinite(values).all() else None
                if fit is None or min(fit[2:4]) <= 0:
                    rows.append((None,) * 6)
                    continue
                fit = (fit[0] * s + x, fit[1] * s + y, fit[2] * s, fit[3] * s, fit[4])
                ring = ellipse_ring(*fit, vertices=corners)
                rows.append((*fit, [*ring.tolist(), *ring[:2].tolist()]))
            yield pd.DataFrame(rows, columns=ELLIPSE.names).astype({c: float for c in ELLIPSE.names[:5]})

    return solve


def ellipses(points: DataFrame, by: Sequence[str], x: str = "x", y: str = "y", corners: int = 64) -> DataFrame:
    """``<by>, n, ellipse`` of the points of each group: centre, half axes, angle and a closed ring of ``corners + 1`` vertices.

    The sums of the powers of x and y up to the fourth, about the group's mean
    and by its spread, add up over partitions before anything is shuffled, so
    a group may be of any size.  ``ellipse`` has nulls for fewer than 5 points
    and where the fit degenerates.  Points without a place are left out.
    """
    held = points.select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).dropna(subset=["_x", "_y"])
    facts = held.groupBy(*by).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.greatest(F.coalesce(F.stddev_pop("_x"), F.lit(0.0)), F.coalesce(F.stddev_pop("_y"), F.lit(0.0)), F.lit(1e-12)).alias("_s"))
    facts = stored(facts, "means")
    on = F.lit(True)
    for c in by:
        on = on & held[c].eqNullSafe(facts[c])
    placed = held.join(facts, on).select(*[facts[c] for c in by], "_mx", "_my", "_s", ((F.col("_x") - F.col("_mx")) / F.col("_s")).alias("u"), ((F.col("_y") - F.col("_my")) / F.col("_s")).alias("v"))
    power = lambda c, k: F.lit(1.0) if k == 0 else F.expr(" * ".join([c] * k))
    sums = placed.groupBy(*by).agg(F.first("_mx").alias("_mx"), F.first("_my").alias("_my"), F.first("_s").alias("_s"), *[F.sum(power("u", i) * power("v", j)).alias(f"m{i}{j}") for i, j in POWERS])
    return sums.select(*by, F.col("m00").cast("long").alias("n"), _solved(corners)("_mx", "_my", "_s", *[f"m{i}{j}" for i, j in POWERS]).alias("ellipse"))
