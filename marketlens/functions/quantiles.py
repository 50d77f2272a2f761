"""Exact quantiles of many columns and many subsets of the rows, by narrowing intervals of keys.

A double becomes a 64-bit whole number in the same order.  The wanted place of a column lies in an interval of keys; one pass over the table
counts, for every open interval, how many values fall into each of ``BINS`` equal parts of it.  The part that holds the place is the next interval, for
all columns, subsets and quantiles in the same pass.  An interval ends as soon as it holds one distinct value, or so few values (``GATHER``) that the next pass
fetches them.  So a pass sends counts, never the values of a column: its traffic is bounded by columns x cells x ``BINS`` whatever the number of rows, and the number of
passes grows with the logarithm of the rows (seven at most, as 512^7 parts exhaust 64 bits).

Subsets are unions of *cells*: a whole-number column says in which cell a row lies (a fold, a side of a split), and the subset "all folds but one" is a set of
cells.  All subsets are served by the same counts.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Hashable, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.session import materialize

BINS = 512
#: An interval with at most this number of values is fetched instead of counted once more.
GATHER = 2048
_CELL = "_cell"


def _key_fn():
    """Order-preserving keys of doubles; a closure, so that tasks need NumPy only."""
    def keys(values):
        bits = (values + 0.0).view(np.int64)  # -0.0 is 0.0
        return np.where(bits >= 0, bits, bits ^ np.int64(0x7FFFFFFFFFFFFFFF))
    return keys


keys_of = _key_fn()


def value_of(key: int) -> float:
    bits = key if key >= 0 else key ^ 0x7FFFFFFFFFFFFFFF
    return float(np.array([bits], np.int64).view(np.float64)[0])


def _task_fn(cols: list[str], open_at: dict[int, list[tuple[int, int]]], few: set[tuple[int, int, int]], bins: int):
    """Counts by (column, interval, cell, part), with the smallest and largest key, from Arrow batches.

    Intervals in ``few`` hold few values: each distinct one is a part of its own.
    """
    keys = _key_fn()

    def run(batches):
        import pyarrow as pa
        dense: dict[tuple[int, int, int], tuple] = {}
        sparse: dict[tuple[int, int, int, int], int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            cell = column["_cell"].to_numpy()
            cells = np.unique(cell)
            for c, intervals in open_at.items():
                values = column[cols[c]].to_numpy(zero_copy_only=False).astype(np.float64)  # null is NaN
                known = ~np.isnan(values)
                k, at = keys(values[known]), cell[known]
                for i, (low, high) in enumerate(intervals):
                    inside = (k >= low) & (k <= high)
                    ki, ci = k[inside], at[inside]
                    for one in cells.tolist():
                        kc = ki[ci == one]
                        if not len(kc):
                            continue
                        if (c, low, high) in few:
                            for x, n in zip(*(u.tolist() for u in np.unique(kc, return_counts=True))):
                                sparse[c, i, one, x] = sparse.get((c, i, one, x), 0) + n
                            continue
                        width = (high - low) // bins + 1
                        part = ((kc.view(np.uint64) - np.uint64(low % (1 << 64))) // np.uint64(width)).astype(np.int64)
                        if (c, i, one) not in dense:
                            dense[c, i, one] = (np.zeros(bins, np.int64), np.full(bins, high, np.int64), np.full(bins, low, np.int64))
                        n, least, most = dense[c, i, one]
                        n += np.bincount(part, minlength=bins)
                        np.minimum.at(least, part, kc)
                        np.maximum.at(most, part, kc)
        rows = [(*k, x, n, x, x) for *k, x, n in ((*key, n) for key, n in sparse.items())]
        for key, (n, least, most) in dense.items():
            some = np.flatnonzero(n)
            rows += [(*key, *r) for r in zip(some.tolist(), n[some].tolist(), least[some].tolist(), most[some].tolist())]
        table = np.array(rows, dtype=np.int64).reshape(-1, 7)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in table.T], names=["c", "i", "cell", "part", "n", "low", "high"])
    return run


_SCHEMA = "c long, i long, cell long, part long, n long, low long, high long"


def _count(stored: DataFrame, cols: list[str], open_at: dict[int, list[tuple[int, int]]], few: set) -> dict[tuple[int, int], list]:
    """By (column, interval): ``(part, cell, n, low, high)`` in order of the part."""
    told = stored.mapInArrow(_task_fn(cols, open_at, few, BINS), _SCHEMA)
    total = told.groupBy("c", "i", "cell", "part").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    out: dict[tuple[int, int], list] = {}
    for r in total.collect():
        out.setdefault((r["c"], r["i"]), []).append((r["part"], r["cell"], r["n"], r["low"], r["high"]))
    for rows in out.values():
        rows.sort()
    return out


def quantiles_by_group(df: DataFrame, cols: Sequence[str], probs: Sequence[float], groups: Mapping[Hashable, Collection[int]],
                       cell: Column | None = None, stored: bool = False,
                       ends: Mapping[str, tuple[float | None, float | None]] | None = None) -> dict[Hashable, dict[str, list[float | None]]]:
    """Exact quantiles (linear interpolation; nulls and NaN left out) of ``cols`` for every group of cells.

    ``cell`` is a whole number of each row (0 if not given); ``stored`` says that ``df`` is cheap to read again
    (a checkpoint), otherwise the needed columns are written once.  ``ends`` are the smallest and largest value of every column (NaN left out), if
    they are known already.
    """
    cols = list(cols)
    if not cols:
        return {g: {} for g in groups}
    narrow = df.select((cell if cell is not None else F.lit(0)).cast("long").alias(_CELL), *[F.col(c).cast("double").alias(c) for c in cols])
    if not stored:
        narrow = materialize(narrow)
    if ends is None:
        found = narrow.agg(*[e.alias(f"e{i}") for i, e in enumerate(x for c in cols for x in end_columns(c))]).first()
        ends = {c: (found[2 * i], found[2 * i + 1]) for i, c in enumerate(cols)}
    key = lambda x: int(keys_of(np.array([x]))[0])
    # an open place: (column, low, high) -> [(group, place, values of the group below the interval)]; the first pass tells the number of values
    open_places: dict[tuple[int, int, int], list] = {}
    for c, name in enumerate(cols):
        if ends[name][0] is not None:
            open_places[c, key(ends[name][0]), key(ends[name][1])] = [(g, None, 0) for g in groups]
    at: dict[tuple, float] = {}
    numbers: dict[tuple, int] = {}
    few: set[tuple[int, int, int]] = set()
    while open_places:
        open_at: dict[int, list[tuple[int, int]]] = {}
        for c, low, high in open_places:
            open_at.setdefault(c, []).append((low, high))
        counted = _count(narrow, cols, open_at, few)
        narrower: dict[tuple[int, int, int], list] = {}
        few = set()
        for (c, low, high), wanted in open_places.items():
            rows = counted.get((c, open_at[c].index((low, high))), [])
            everyone = {part: (n, least, most) for part, n, least, most in _by_part(rows)}
            for g, place, before in wanted:
                parts, places = _by_part([r for r in rows if r[1] in groups[g]]), [place]
                if place is None:  # the whole column: now its number of values is known
                    n = numbers[g, c] = sum(x[1] for x in parts)
                    places = sorted({f(p * (n - 1)) for p in probs for f in (math.floor, math.ceil)}) if n else []
                done, i = before, 0
                for want in places:
                    while done + parts[i][1] <= want:
                        done += parts[i][1]
                        i += 1
                    part, _, least, most = parts[i]
                    if least == most:
                        at[g, c, want] = value_of(least)
                        continue
                    n_all, least, most = everyone[part]  # one interval for all groups
                    # values of the group below the interval
                    narrower.setdefault((c, least, most), []).append((g, want, done))
                    if n_all <= GATHER:
                        few.add((c, least, most))
        open_places = narrower

    def value(g: Hashable, c: int, p: float) -> float | None:
        n = numbers.get((g, c), 0)
        if not n:
            return None
        h = p * (n - 1)
        low, high = at[g, c, math.floor(h)], at[g, c, math.ceil(h)]
        return low + (h - math.floor(h)) * (high - low) if high > low else low
    return {g: {name: [value(g, c, p) for p in probs] for c, name in enumerate(cols)} for g in groups}


def end_columns(c: str) -> tuple[Column, Column]:
    """Aggregates for the smallest and largest value of a column."""
    x = F.col(c).cast("double")
    x = F.when(~F.isnan(x), x)
    return F.min(x), F.max(x)


def _by_part(rows: list) -> list[tuple[int, int, int, int]]:
    """``(part, n, low, high)`` of each part in order, cells added up."""
    out: list[list[int]] = []
    for part, _, n, low, high in rows:
        if out and out[-1][0] == part:
            out[-1] = [part, out[-1][1] + n, min(out[-1][2], low), max(out[-1][3], high)]
        else:
            out.append([part, n, low, high])
    return [tuple(x) for x in out]


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float] = (0.5,), stored: bool = False, ends: Mapping | None = None) -> dict[str, list[float | None]]:
    """Exact quantiles of ``cols`` over all rows."""
    return quantiles_by_group(df, cols, probs, {None: {0}}, stored=stored, ends=ends)[None]
