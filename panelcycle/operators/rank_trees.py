"""Running quantiles of series whose values come, and may go, slot by slot.

A series' distinct values are sorted once. Counts over that order are kept in a binary indexed tree:
a value that comes or goes changes as many counts as the number of values has binary digits, and the
value at a rank is found by a search of as many steps. Time is so in proportion to rows and asked
slots, whatever lies before a slot.

This is the one part of the library that runs in Python workers: the state has no form in SQL. All
series of a chunk go through each step together as arrays, so small series cost no calls of their own.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# travels to the executors by value, so jobs run where only the driver has the package on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that are worked on together; a chunk holds whole series, a longer series is a chunk of its own.
CHUNK_ROWS = 250_000


def _series_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Rows at which a series begins, in a table sorted by the keys."""
    changed = np.zeros(table.num_rows, bool)
    changed[:1] = True
    for key in keys:
        codes = table.column(key).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed)


class RankTrees:
    """One tree a series over the sorted distinct values of all rows, empty at first."""

    def __init__(self, series: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, series))
        series, values = series[order], values[order]
        first = np.concatenate(([True], (series[1:] != series[:-1]) | (values[1:] != values[:-1])))
        self.values = values[first]
        owners = series[first]
        self.base = np.searchsorted(owners, np.arange(series[-1] + 1))
        self.size = np.diff(np.concatenate((self.base, [len(owners)])))
        self.place = np.empty(len(order), np.int64)  # of each row, from 1
        self.place[order] = np.cumsum(first) - self.base[series]
        self.tree = np.zeros(len(owners), np.int64)
        self.total = np.zeros(len(self.base), np.int64)
        self.first_step = 1 << int(self.size.max()).bit_length() - 1

    def add(self, rows: np.ndarray, series: np.ndarray, signs: np.ndarray) -> None:
        np.add.at(self.total, series, signs)
        at = self.place[rows]
        while len(at):
            np.add.at(self.tree, self.base[series] + at - 1, signs)
            at = at + (at & -at)
            inside = at <= self.size[series]
            at, series, signs = at[inside], series[inside], signs[inside]

    def at_ranks(self, series: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Values at ranks from 0, a row of them per series; ranks lie below the series' totals."""
        base, size = self.base[series][:, None], self.size[series][:, None]
        found, left = np.zeros_like(ranks), ranks.copy()
        step = self.first_step
        while step:
            further = found + step
            count = self.tree[base + np.minimum(further, size) - 1]
            go = (further <= size) & (count <= left)
            found, left = np.where(go, further, found), np.where(go, left - count, left)
            step >>= 1
        return self.values[base + np.minimum(found, size - 1)]


def _quantiles(table: pa.Table, keys: Sequence[str], probs: np.ndarray) -> pa.RecordBatch:
    starts = _series_starts(table, keys)
    series = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [table.num_rows]))))
    slots, signs = (table.column(c).to_numpy().astype(np.int64) for c in ("slot", "_sign"))
    trees = RankTrees(series, table.column("_v").to_numpy())
    order = np.argsort(slots, kind="stable")
    cuts = np.flatnonzero(np.diff(slots[order])) + 1
    owners, at, counts, found = [], [], [], []
    for rows in np.split(order, cuts):
        trees.add(rows, series[rows], signs[rows])
        news = np.unique(series[rows])
        n = trees.total[news]
        position = np.maximum(n - 1, 0)[:, None] * probs
        low, high = np.floor(position).astype(np.int64), np.ceil(position).astype(np.int64)
        below, above = np.split(trees.at_ranks(news, np.concatenate((low, high), axis=1)), 2, axis=1)
        owners.append(news)
        at.append(np.full(len(news), slots[rows[0]]))
        counts.append(n)
        found.append(np.where(low == high, below, (high - position) * below + (position - low) * above))
    owner, slot = np.concatenate(owners), np.concatenate(at)
    by_series = np.lexsort((slot, owner))
    owner, slot = owner[by_series], slot[by_series]
    more = np.concatenate((owner[1:] == owner[:-1], [False]))
    following = pa.array(np.concatenate((slot[1:], [0])), pa.int32(), mask=~more)
    values = np.concatenate(found)[by_series].ravel()
    offsets = np.arange(len(owner) + 1, dtype=np.int32) * len(probs)
    named = [table.column(k).combine_chunks().take(pa.array(starts[owner])) for k in keys]
    return pa.RecordBatch.from_arrays(
        [*named, pa.array(slot, pa.int32()), following, pa.array(np.concatenate(counts)[by_series], pa.int64()),
         pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.float64()))],
        [*keys, "slot", "_next", "n_obs", "_q"],
    )


def running_quantiles(events: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, slot, _next, n_obs, _q): linear-interpolation quantiles after every slot of a series that has events.

    ``events`` (keys, slot, _v, _sign): a value comes with sign 1 and goes with sign -1. ``_next`` is the
    series' next slot with events. Where nothing is left, ``n_obs`` is 0 and ``_q`` means nothing. A
    series is one task's work; ``quantiles.LARGE_SERIES_ROWS`` bounds what callers send here.
    """
    wanted = np.array([float(p) for p in probs])
    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, enough = 0, CHUNK_ROWS
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(held)
            last = int(_series_starts(table, keys)[-1])  # the last series may go on in the next batch
            if last:
                yield _quantiles(table.slice(0, last), keys, wanted)
                held = table.slice(last).to_batches()
                rows, enough = rows - last, CHUNK_ROWS
            else:
                enough = 2 * rows
        if rows:
            yield _quantiles(pa.Table.from_batches(held), keys, wanted)

    ordered = events.select(*keys, "slot", "_v", "_sign").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, f"{kinds}, slot int, _next int, n_obs long, _q array<double>")
