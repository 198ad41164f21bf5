"""Exact order statistics without sorting the data.

``rank_thresholds`` answers "which row stands at rank r?" for a few ranks, per
stratum, by narrowing value intervals: one histogram aggregate over the rows, then
another over the few buckets that hold a wanted rank, until so few rows are left
that they can be fetched. Only bucket counts cross the network. Rows are compared
by all order columns, so equal leading values are told apart by the next column.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1024
HISTOGRAM_ROWS = 200_000
FETCH_ROWS = 20_000


@dataclass
class _Cell:
    """Rows of one stratum whose order columns lie in a box; boxes are disjoint.

    ``wanted`` lists (request, rank, rank counted inside this box). Without bounds
    the box spans all values and ``count`` is unknown.
    """

    stratum: tuple
    fixed: tuple
    lo: float | int | None
    hi: float | int | None
    count: int | None
    wanted: list[tuple[tuple, int, int]]


def _tag_cells(df, strata, order, cells, level):
    """Keep the rows of the cells and add ``_cell``, ``_lo`` and ``_hi``."""
    value = F.col(order[level])
    value_type = df.schema[order[level]].dataType
    if strata:
        fixed = [
            T.StructField(f"_f{i}", df.schema[order[i]].dataType) for i in range(level)
        ]
        keys = [T.StructField(f"_s{i}", df.schema[s].dataType) for i, s in enumerate(strata)]
        schema = T.StructType(
            [T.StructField("_cell", T.IntegerType()), *keys, *fixed]
            + [T.StructField("_lo", value_type), T.StructField("_hi", value_type)]
        )
        boxes = df.sparkSession.createDataFrame(
            [(i, *c.stratum, *c.fixed, c.lo, c.hi) for i, c in enumerate(cells)], schema
        )
        match = F.col("_lo").isNull() | value.between(F.col("_lo"), F.col("_hi"))
        for i, s in enumerate(strata):
            match = match & F.col(s).eqNullSafe(F.col(f"_s{i}"))
        for i in range(level):
            match = match & (F.col(order[i]) == F.col(f"_f{i}"))
        # At most one row per wanted rank: the size of the request, not of the data.
        return df.join(F.broadcast(boxes), match).drop(*[f.name for f in (*keys, *fixed)])

    choice = None
    for i, cell in enumerate(cells):
        inside = F.lit(True) if cell.lo is None else value.between(cell.lo, cell.hi)
        for name, wanted in zip(order, cell.fixed):
            inside = inside & (F.col(name) == F.lit(wanted))
        box = F.array(
            F.struct(
                F.lit(i).alias("_cell"),
                F.lit(cell.lo).cast(value_type).alias("_lo"),
                F.lit(cell.hi).cast(value_type).alias("_hi"),
            )
        )
        choice = F.when(inside, box) if choice is None else choice.when(inside, box)
    # Rows in no box unfold to nothing. A filter instead would be pushed below the
    # projection that makes the order column and compute it once per comparison.
    return df.select("*", F.inline(choice))


def _shortest(rows: list[tuple], at: int) -> tuple:
    """The row at a place of sorted rows, with null for columns that are not needed to
    tell it from its neighbours."""
    row = rows[at]
    near = [rows[i] for i in (at - 1, at + 1) if 0 <= i < len(rows)]
    need = next((n for n in range(1, len(row)) if all(r[:n] != row[:n] for r in near)), len(row))
    return (*row[:need], *(None,) * (len(row) - need))


def _bucket(value: Column, buckets: int) -> Column:
    """Order-preserving bucket of a value inside [_lo, _hi]."""
    lo, hi = F.col("_lo"), F.col("_hi")
    share = (value - lo).cast("double") / (hi - lo).cast("double")
    return F.least(F.floor(share * buckets), F.lit(buckets - 1)).cast("int")


def uniform_thresholds(
    df: DataFrame, order: list[str], ranks: list[int], n: int, bounds: tuple[int, int]
) -> dict[int, tuple] | None:
    """``rank_thresholds`` of ``n`` rows whose first order column is an evenly spread hash.

    The row of a rank then lies within six standard deviations of its expected place, so
    one aggregate is enough: rows inside such windows are counted by value, the rest by
    the gap they are in. None where a window misses its row, equal hashes hold it, or the
    windows would hold too many rows.
    """
    low, high = bounds
    span = high - low + 1
    windows: list[list[int]] = []
    for rank in sorted(set(ranks)):
        place = (rank + 0.5) / n
        reach = (6 * math.sqrt(n * place * (1 - place)) + 10) / n
        first, last = (low + int(min(max(p, 0.0), 1.0) * span) for p in (place - reach, place + reach))
        if windows and first <= windows[-1][1]:
            windows[-1][1] = max(windows[-1][1], last)
        else:
            windows.append([first, last])
    if sum(b - a for a, b in windows) / span * n > HISTOGRAM_ROWS:
        return None
    value = F.col(order[0])
    cell = F.lit(-1 - len(windows)).cast("long")
    for i, (first, last) in reversed(list(enumerate(windows))):
        cell = F.when(value < first, F.lit(-1 - i).cast("long")).when(value <= last, value).otherwise(cell)
    counts = {r[0]: r[1] for r in df.select(*order[:1]).groupBy(cell.alias("cell")).count().collect()}
    inside = sorted(v for v in counts if v >= 0)
    answers, before, wanted = {}, 0, sorted(set(ranks))
    for i, (first, last) in enumerate(windows):
        before += counts.get(-1 - i, 0)
        for v in inside[bisect_left(inside, first) : bisect_right(inside, last)]:
            while wanted and before <= wanted[0] < before + counts[v]:
                if counts[v] > 1:
                    return None
                answers[wanted.pop(0)] = (v, *(None,) * (len(order) - 1))
            before += counts[v]
    return None if wanted else answers


def rank_thresholds(
    df: DataFrame,
    order: list[str],
    cuts: dict[tuple, list[int]],
    strata: list[str] | None = None,
    leave_out: str | None = None,
    bounds: tuple[int, int] | None = None,
) -> dict[tuple, dict[int, tuple]]:
    """Order-column values of the row at each wanted 0-based rank of each stratum.

    ``order`` names numeric columns without nulls, compared lexicographically. Trailing
    columns of an answer are null where the leading ones are the row's alone.
    ``cuts`` maps a request to ranks. A request is a tuple of strata values, ``()``
    without strata; with ``leave_out`` it ends with a value of that column, and rows
    that have it do not count. All such requests of a stratum share one pass.
    ``bounds`` are known limits of the first order column, which is then taken to be
    computed; otherwise it is a stored column and its limits reach the scan.
    """
    strata = strata or []
    part = F.col(leave_out) if leave_out else F.lit(0)
    df = df.select(*strata, *order, part.alias("_part"))
    answers: dict[tuple, dict[int, tuple]] = {request: {} for request in cuts}

    def counts(request: tuple, of_part) -> bool:
        return leave_out is None or request[-1] != of_part

    start: dict[tuple, list] = defaultdict(list)
    for request, ranks in cuts.items():
        stratum = request[:-1] if leave_out else request
        start[stratum] += [(request, rank, rank) for rank in ranks]
    lo, hi = bounds or (None, None)
    pending = [_Cell(s, (), lo, hi, None, w) for s, w in start.items() if w]
    while pending:
        level = min(len(c.fixed) for c in pending)
        cells = [c for c in pending if len(c.fixed) == level]
        pending = [c for c in pending if len(c.fixed) != level]
        value = F.col(order[level])

        todo = []
        for cell in cells:
            if cell.count is None or cell.lo is None or cell.lo != cell.hi:
                todo.append(cell)
            elif level == len(order) - 1 or cell.count == 1:
                rest = (None,) * (len(order) - level - 1)
                for request, rank, _ in cell.wanted:
                    answers[request][rank] = (*cell.fixed, cell.lo, *rest)
            else:  # equal so far: the next column decides
                fixed = (*cell.fixed, cell.lo)
                pending.append(_Cell(cell.stratum, fixed, None, None, cell.count, cell.wanted))
        if not todo:
            continue

        rows_in = df
        if bounds is None and level == 0 and all(c.lo is not None for c in todo):
            rows_in = df.where(value.between(min(c.lo for c in todo), max(c.hi for c in todo)))
        tagged = _tag_cells(rows_in, strata, order, todo, level)
        if all(c.count is not None for c in todo) and sum(c.count for c in todo) <= FETCH_ROWS:
            rows = defaultdict(list)
            for row in tagged.select("_cell", "_part", *order).collect():
                rows[row[0]].append((tuple(row[2:]), row[1]))
            for i, cell in enumerate(todo):
                ordered = sorted(rows[i], key=lambda item: item[0])
                for request, rank, inner in cell.wanted:
                    own = [key for key, p in ordered if counts(request, p)]
                    answers[request][rank] = _shortest(own, inner)
            continue

        if any(c.lo is None for c in todo):
            known = tagged.groupBy("_cell").agg(F.min(value), F.max(value), F.count("*"))
            for row in known.collect():
                cell = todo[row[0]]
                if cell.lo is None:
                    cell.lo, cell.hi, cell.count = row[1], row[2], row[3]
                pending.append(cell)
            continue

        buckets = max(16, min(BUCKETS, HISTOGRAM_ROWS // len(todo)))
        histogram: dict[int, dict[int, list]] = defaultdict(dict)
        for cell, bucket, of_part, n, low, high in (
            tagged.groupBy("_cell", _bucket(value, buckets).alias("_bucket"), "_part")
            .agg(F.count("*"), F.min(value), F.max(value))
            .collect()
        ):
            entry = histogram[cell].setdefault(bucket, [{}, low, high])
            entry[0][of_part] = n
            entry[1], entry[2] = min(entry[1], low), max(entry[2], high)
        for i, cell in enumerate(todo):
            steps = sorted(histogram[i].items())
            inside: dict[int, list] = defaultdict(list)
            by_request = defaultdict(list)
            for request, rank, inner in cell.wanted:
                by_request[request].append((inner, rank))
            for request, ranks in by_request.items():
                ranks.sort()
                before, at = 0, 0
                for bucket, (parts, _, _) in steps:
                    n = sum(c for p, c in parts.items() if counts(request, p))
                    while at < len(ranks) and ranks[at][0] < before + n:
                        inside[bucket].append((request, ranks[at][1], ranks[at][0] - before))
                        at += 1
                    before += n
            for bucket, wanted in inside.items():
                parts, low, high = histogram[i][bucket]
                count = sum(parts.values())
                pending.append(_Cell(cell.stratum, cell.fixed, low, high, count, wanted))
    return answers
