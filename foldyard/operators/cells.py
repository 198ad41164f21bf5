"""Regression trees grown on cells of binned features.

A binned tree sees a row only by its bins, so rows of equal bins, a cell, go the same way
in every tree. What a tree needs of a cell is the weight and the weighted target of its
rows. Boosting on squared errors needs those once, for all rounds. A forest needs them for
each tree's draws, which one pass over the rows adds up, for all trees. Trees are then
grown on at most ``CELLS`` cells, however many rows there are.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import Affine
from .mutual_info import _stacked
from .order_stats import rank_thresholds

CELLS = 1 << 20  # what 32 bins of four features make
VALUES = 1000  # about as many distinct values of a column are counted one by one
CHUNK = 1 << 20  # rows whose draws are added up at once
LOTS = 32  # tasks that share the trees of a forest


def axes(chain: Affine) -> list[int] | None:
    """The feature that each column of ``chain`` is a rising line of, if all are."""
    if chain.is_identity:
        return list(range(chain.weights.shape[0]))
    if not all((column != 0).sum() == 1 and column.max() > 0 for column in chain.weights.T):
        return None
    return [int(np.argmax(column)) for column in chain.weights.T]


def cuts_of_counts(values: list[float], counts: list[int], bins: int) -> list[float]:
    """Spark ML's cuts of sorted values: between all of them if they fit the bins, else
    where the rows so far are nearest to a multiple of their share."""
    middles = [(a + b) / 2 for a, b in zip(values, values[1:])]
    if len(middles) < bins:
        return middles
    share = sum(counts) / bins
    cuts, target, before = [], share, 0
    for n, next_n, middle in zip(counts, counts[1:], middles):
        before += n
        if abs(before - target) < abs(before + next_n - target):
            cuts.append(middle)
            target += share
    return cuts


def train_cuts(df: DataFrame, columns: list[str], k: int, bins: int, fold: str = "fold") -> list[list[list[float]]] | None:
    """Cuts of each fold model and column, from the model's training rows alone; None where
    they would make far too many cells."""
    df = df.where(F.col(fold).isNotNull())
    distinct = df.agg(*[F.approx_count_distinct(c) for c in columns]).first()
    if math.prod(min(bins, n * 0.8) for n in distinct if n) > CELLS:
        return None
    narrow = [i for i, n in enumerate(distinct) if n <= VALUES]
    wide = [i for i, n in enumerate(distinct) if n > VALUES]
    found: list[list[list[float]]] = [[[] for _ in columns] for _ in range(k)]
    if narrow:  # about VALUES rows at most for each of these columns and folds
        counts: dict = defaultdict(lambda: [0] * k)
        rows = _stacked(df, [columns[i] for i in narrow], fold).groupBy("col", "value", fold).count().collect()
        for row in rows:
            counts[row["col"], row["value"]][row[fold]] = row["count"]
        for j, i in enumerate(narrow):
            of_column = sorted((v, n) for (c, v), n in counts.items() if c == j)
            for m in range(k):
                own = [(v, sum(n) - n[m]) for v, n in of_column if sum(n) > n[m]]
                found[m][i] = cuts_of_counts([v for v, _ in own], [n for _, n in own], bins)
    if wide:
        sizes = {r[0]: r[1] for r in df.groupBy(fold).count().collect()}
        n = sum(sizes.values())
        ends = [sorted({int(i * (n - sizes.get(m, 0)) / bins + 0.5) for i in range(1, bins)} - {0}) for m in range(k)]
        asked = {(c, m): sorted({r for end in ends[m] for r in (end - 1, end)}) for c in range(len(wide)) for m in range(k)}
        values = _stacked(df, [columns[i] for i in wide], fold)
        for (c, m), at in rank_thresholds(values, ["value"], asked, strata=["col"], leave_out=fold).items():
            found[m][wide[c]] = sorted({(at[r - 1][0] + at[r][0]) / 2 for r in ends[m]})
    return found


def with_cell(df: DataFrame, columns: list[str], cuts: list[list[float]]) -> DataFrame:
    """Add ``cell`` int: the bins, which hold their upper cut, as digits."""
    used = [(c, own) for c, own in zip(columns, cuts) if own]
    if not used:
        return df.withColumn("cell", F.lit(0))
    splits = [[-math.inf, *np.nextafter(own, math.inf).tolist(), math.inf] for _, own in used]
    names = [f"_bin{i}" for i in range(len(used))]
    cell, size = F.lit(0), 1
    for name, (_, own) in zip(names, used):
        cell = cell + F.col(name).cast("int") * size
        size *= len(own) + 1
    binned = Bucketizer(splitsArray=splits, inputCols=[c for c, _ in used], outputCols=names).transform(df)
    return binned.withColumn("cell", cell).drop(*names)


def places(cuts: list[list[float]]) -> int:
    return math.prod(len(own) + 1 for own in cuts)


def digits(cells: np.ndarray, cuts: list[list[float]]) -> list[tuple[np.ndarray, int]]:
    """(bin of each cell, number of bins) of every feature with cuts."""
    found = []
    for own in cuts:
        if own:
            cells, digit = np.divmod(cells, len(own) + 1)
            found.append((digit, len(own) + 1))
    return found


def grow(bins: list[tuple[np.ndarray, int]], w: np.ndarray, s: np.ndarray, depth: int, least: float, least_gain: float) -> np.ndarray:
    """What a tree of least squares predicts at each cell, from the weights ``w`` and
    weighted targets ``s`` of the cells. Cells of weight 0 go along."""
    value = np.full(len(w), s.sum() / w.sum() if w.sum() else 0.0)
    at, node, open_nodes = np.arange(len(w)), np.zeros(len(w), np.int64), 1
    for _ in range(depth):
        if not len(at):
            break
        own_w, own_s = w[at], s[at]
        total_w, total_s = (np.bincount(node, v, open_nodes) for v in (own_w, own_s))
        best, feature, cut = np.zeros(open_nodes), np.full(open_nodes, -1), np.zeros(open_nodes, np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            unsplit = total_s**2 / total_w
            for j, (digit, width) in enumerate(bins):
                place = node * width + digit[at]
                left_w, left_s = (
                    np.bincount(place, v, open_nodes * width).reshape(-1, width).cumsum(axis=1)[:, :-1] for v in (own_w, own_s)
                )
                right_w, right_s = total_w[:, None] - left_w, total_s[:, None] - left_s
                gain = left_s**2 / left_w + right_s**2 / right_w - unsplit[:, None]
                gain[~((left_w >= least) & (right_w >= least))] = 0.0
                top = gain.argmax(axis=1)
                gain = gain[np.arange(open_nodes), top]
                better = gain > best
                best[better], feature[better], cut[better] = gain[better], j, top[better]
            split = (feature >= 0) & (best >= least_gain * total_w)
        ranks = np.cumsum(split) - 1
        kept = split[node]
        at, node = at[kept], node[kept]
        right = np.zeros(len(at), bool)
        for j, (digit, _) in enumerate(bins):
            here = feature[node] == j
            right[here] = digit[at[here]] > cut[node[here]]
        node, open_nodes = 2 * ranks[node] + right, 2 * int(split.sum())
        total_w, total_s = (np.bincount(node, v[at], open_nodes) for v in (w, s))
        value[at] = (total_s / np.maximum(total_w, 1e-300))[node]
    return value


def _arrays(batches, names: list[str]) -> list[np.ndarray]:
    parts = [[b.column(n).to_numpy(zero_copy_only=False) for n in names] for b in batches if b.num_rows]
    return [np.concatenate(p) for p in zip(*parts)] if parts else []


def boosted(rows: DataFrame, cuts: list, rounds: int, rate: float, depth: int, least: float) -> DataFrame:
    """(cell, p) of Spark ML's boosting on squared errors: a whole first tree, then steps of
    ``rate`` along trees of twice the residuals. ``rows``: cell, y, train."""
    own = F.when(F.col("train"), F.col("y"))
    sums = rows.groupBy("cell").agg(F.count(own).cast("double").alias("n"), F.coalesce(F.sum(own), F.lit(0.0)).alias("s"))

    def run(batches):
        arrays = _arrays(batches, ["cell", "n", "s"])
        if not arrays:
            return
        cell, n, s = arrays
        bins = digits(cell.astype(np.int64), cuts)
        p = grow(bins, n, s, depth, least, 0.0)
        for _ in range(rounds - 1):
            p = p + rate * grow(bins, n, 2 * (s - n * p), depth, least, 0.0)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(p)], names=["cell", "p"])

    return sums.repartition(1).mapInArrow(run, "cell int, p double")  # CELLS rows at most


def draws(rng: np.random.Generator, n: int, rate: float, bootstrap: bool) -> np.ndarray:
    """How often a tree draws each of n rows: Poisson counts, or rows drawn at most once."""
    if not bootstrap:
        return np.ones(n, np.uint8) if rate >= 1 else (rng.random(n) < rate).astype(np.uint8)
    u = rng.integers(0, 1 << 32, n, dtype=np.uint32)
    drawn, term, below, count = np.zeros(n, np.uint8), math.exp(-rate), 0.0, 0
    while (limit := round((below := below + term) * 2**32)) < 1 << 32 and count < 255:
        drawn += u >= np.uint32(limit)
        count += 1
        term *= rate / count
    return drawn


def forest(
    rows: DataFrame, cuts: list, trees: int, rate: float, bootstrap: bool, depth: int, least: float,
    least_gain: float, seed: int, parts: int,
) -> DataFrame:
    """(cell, p) of the mean of ``trees`` trees, each on its own draws. ``rows``: cell, y,
    train; rows of a cell are brought together, so that few sums leave the ``parts``."""

    def add_up(batches):
        part, chunk, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            cell, y, train = _arrays(held, ["cell", "y", "train"])
            order = np.argsort(cell, kind="stable")
            cell, y, out = cell[order], y[order], ~train[order].astype(bool)
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            shown = cell[starts].astype(np.int32).tobytes()
            for t in range(trees):
                w = draws(np.random.default_rng([seed % 2**32, t, part, chunk]), len(y), rate, bootstrap)
                w[out] = 0
                sums = np.add.reduceat(w, starts, dtype=np.int64), np.add.reduceat(w * y, starts)
                columns = [pa.array([t % LOTS]), pa.array([t]), *(pa.array([b], pa.binary()) for b in (shown, sums[0].astype(float).tobytes(), sums[1].tobytes()))]
                yield pa.RecordBatch.from_arrays([c.cast(pa.int32()) if i < 2 else c for i, c in enumerate(columns)], names=["lot", "tree", "cell", "w", "s"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= CHUNK:
                yield from flush()
                held, size, chunk = [], 0, chunk + 1
        if held:
            yield from flush()

    def grow_lot(table: pa.Table) -> pa.Table:
        of_tree: dict[int, list] = defaultdict(list)
        for row in range(table.num_rows):
            of_tree[table.column("tree")[row].as_py()].append(row)
        total = 0.0
        for t in sorted(of_tree):
            cell, w, s = (
                np.concatenate([np.frombuffer(table.column(c)[row].as_buffer(), kind) for row in of_tree[t]])
                for c, kind in (("cell", np.int32), ("w", np.float64), ("s", np.float64))
            )
            cells, at = np.unique(cell, return_inverse=True)
            w, s = (np.bincount(at, v, len(cells)) for v in (w, s))
            total = total + grow(digits(cells.astype(np.int64), cuts), w, s, depth, least, least_gain)
        return pa.table({"cell": cells, "p": total})

    together = rows.repartitionByRange(parts, "cell", "y")
    sums = together.mapInArrow(add_up, "lot int, tree int, cell binary, w binary, s binary")
    grown = sums.repartition(LOTS, "lot").groupBy("lot").applyInArrow(grow_lot, "cell int, p double")
    return grown.groupBy("cell").agg((F.sum("p") / trees).alias("p"))
