"""A place on a balanced Peano curve: near places mostly have near numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 30


def peano(lat: Column, lon: Column) -> Column:
    """The number of a point after 30 ternary steps; the coordinates are taken into 0 to 360 first."""

    def into(x: Column) -> Column:
        return F.when(x < 0, x + 360).when(x > 360, x - 360).otherwise(x).cast("double")

    start = F.struct(into(lat).alias("x"), into(lon).alias("y"), F.lit(360.0 * math.sqrt(3.0)).alias("w"), F.lit(0).cast("bigint").alias("n"))

    def step(s: Column, _: Column) -> Column:
        h, part = s["w"] / math.sqrt(3.0), s["w"] / 3.0
        first, second = s["x"] < part, s["x"] < part * 2.0
        return F.struct(
            F.when(first, s["y"]).when(second, h - s["y"]).otherwise(s["y"]).alias("x"),
            F.when(first, s["x"]).when(second, s["x"] - part).otherwise(s["x"] - part * 2.0).alias("y"),
            h.alias("w"),
            (s["n"] * 3 + F.when(first, 0).when(second, 1).otherwise(2)).alias("n"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, step)["n"]
