"""Slots of an ascending grid by binary search, for dates and timestamps alike.

The grid is known to the driver and becomes a constant array of the plan, so a slot costs a row a
few comparisons and nothing is joined, however long the grid's span is.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_grid(grid: Sequence[dt.date | dt.datetime], strictly: bool = True) -> list:
    """The grid as a list, if it ascends."""
    grid = list(grid)
    falls = any(b <= a if strictly else b < a for a, b in zip(grid, grid[1:]))
    if not grid or falls:
        raise ValueError("a grid needs at least one date, in strictly ascending order" if strictly else "a grid needs at least one date and must not fall")
    return grid


def grid_array(grid: Sequence[dt.date | dt.datetime], kind: str) -> Column:
    """The grid as an array of ``kind``: one constant, not a tree of them. Datetimes carry no zone: they are wall time."""
    return F.split(F.lit(",".join(str(g) for g in grid)), ",").cast(f"array<{kind}>")


def first_slot(at: Column, grid: Sequence[dt.date | dt.datetime], kind: str) -> Column:
    """Index of the first grid point at or after ``at``; ``len(grid)`` if there is none, null for null."""
    size = len(grid)
    steps = [1 << k for k in range(size.bit_length() - 1, -1, -1)]
    points = grid_array(grid, kind)

    def further(low: Column, step: Column) -> Column:  # low points are known to lie before ``at``
        return F.when(F.get(points, low + step - 1) < at, low + step).otherwise(low)

    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)
    return F.when(at.isNotNull(), found)


def with_first_slot(df: DataFrame, column: str, grid: Sequence[dt.date | dt.datetime], name: str = "slot") -> DataFrame:
    """``first_slot`` of a date or timestamp column."""
    kind = df.schema[column].dataType.simpleString()
    return df.withColumn(name, first_slot(F.col(column), grid, kind))
