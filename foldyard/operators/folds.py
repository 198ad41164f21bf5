"""Cross-validation fold assignment.

Random, contiguous and stratified folds are cuts of an ordering of the rows. The few
rows at the cuts are found by ``rank_thresholds``; every row then gets its fold by
comparing itself with them, so the data is never shuffled or sorted. Grouped folds
are decided on one row per group and joined back.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigDataError
from ..session import materialize
from .order_stats import rank_thresholds, uniform_thresholds
from .rowid import ROW_ID

FOLD_ID = "fold_id"
HASH_DIGITS = 15  # hex digits of md5 that fit a positive long
HASH_BOUNDS = (0, 16**HASH_DIGITS - 1)
BROADCAST_GROUPS = 100_000
HOT_SHARE = 10_000  # a group with more than 1/HOT_SHARE of the rows is hot
WINDOW_GROUPS = 1_000_000  # groups of one size ranked in one window
MAX_CLASSES = 1_000_000
SPREADS = ("squared", "deviation")


@dataclass(frozen=True)
class PartitionSpec:
    """How folds are made. ``spread`` is what stratified groups keep small: the sum of
    ``squared`` class shares, or the mean standard ``deviation`` of a class's shares."""

    mode: str = "random"
    n_splits: int = 10
    shuffle: bool = True
    random_state: int | None = 42
    group_column: str | None = None
    spread: str = "squared"

    @classmethod
    def from_config(cls, section: dict[str, Any]) -> "PartitionSpec":
        spec = cls(
            mode=str(section.get("mode", cls.mode)),
            n_splits=int(section.get("n_splits", cls.n_splits)),
            shuffle=bool(section.get("shuffle", cls.shuffle)),
            random_state=section.get("random_state", cls.random_state),
            group_column=section.get("group_column"),
            spread=str(section.get("spread", cls.spread)),
        )
        if spec.spread not in SPREADS:
            raise ConfigDataError(f"[partition].spread must be one of {SPREADS}")
        if spec.mode not in ("random", "group"):
            raise ConfigDataError("[partition].mode must be 'random' or 'group'")
        if spec.n_splits < 2:
            raise ConfigDataError("[partition].n_splits must be at least 2")
        return spec

    @property
    def seed(self) -> int:
        return 0 if self.random_state is None else self.random_state


def hash_key(seed: int, *values: Column, first: int = 1) -> Column:
    """A positive long drawn from md5 of ``seed:part:...``; same in any SQL engine.

    A part is ``length:value``, or ``-`` for null, so no two lists of values share a text.
    """
    parts = [F.lit(str(seed))]
    for value in values:
        shown = value.cast("string")
        sized = F.concat(F.length(shown).cast("string"), F.lit(":"), shown)
        parts += [F.lit(":"), F.coalesce(sized, F.lit("-"))]
    text = F.concat(*parts)
    return F.conv(F.substring(F.md5(text), first, HASH_DIGITS), 16, 10).cast("long")


def _ordering(df: DataFrame, spec: PartitionSpec, row_id: str | list[str]):
    """The frame, the columns its rows are ordered by, and known limits of the first.

    Shuffled rows are ordered by the hash of their id, or of several key columns of any
    type; then no row numbers are needed at all. Rows that share a key are ordered by a
    hash of all their columns, which is only computed where a cut falls between them.
    """
    if isinstance(row_id, str):
        if not spec.shuffle:
            return df, [row_id], None
        keyed = df.withColumn("_hash", hash_key(spec.seed, F.col(row_id)))
        return keyed, ["_hash", row_id], HASH_BOUNDS
    if not spec.shuffle:
        raise ConfigDataError("Contiguous folds need one numeric row id")
    keys = [F.col(c) for c in row_id]
    everything = [F.col(c) for c in df.columns]
    hashes = {
        "_hash": hash_key(spec.seed, *keys),
        "_hash2": hash_key(spec.seed, *keys, first=HASH_DIGITS + 1),
        "_hash3": hash_key(spec.seed, *everything),
        "_hash4": hash_key(spec.seed, *everything, first=HASH_DIGITS + 1),
    }
    return df.withColumns(hashes), list(hashes), HASH_BOUNDS


HASHES = ("_hash", "_hash2", "_hash3", "_hash4")


def _check_apart(cuts: dict[int, tuple]) -> None:
    """Rows at different ranks must differ, or folds between them would be empty."""
    if len(set(cuts.values())) < len(cuts):
        raise ConfigDataError(
            "Rows at several fold limits are equal in every column; give each row its own key"
        )


def _used_columns(order: list[str], cuts: list[tuple]) -> int:
    """How many order columns the cuts need; the rest of a cut is null."""
    return max((sum(v is not None for v in cut) for cut in cuts), default=1)


def _even_sizes(n: int, k: int) -> list[int]:
    return [n // k + (i < n % k) for i in range(k)]


def _fold_from_cuts(order: list[str], cuts: list[tuple]) -> Column:
    """Number of cut rows at or before this row."""
    used = _used_columns(order, cuts)
    order, cuts = order[:used], [cut[:used] for cut in cuts]
    here = F.struct(*order)
    if len(cuts) <= 32 and all(v is not None for cut in cuts for v in cut):
        at = [F.struct(*[F.lit(v).alias(c) for c, v in zip(order, cut)]) for cut in cuts]
        return sum(((here >= cut).cast("int") for cut in at), F.lit(0))
    table = F.array(
        *[F.struct(*[F.lit(v).cast("long").alias(c) for c, v in zip(order, cut)]) for cut in cuts]
    )
    here = F.struct(*[F.col(c).cast("long").alias(c) for c in order])
    return F.size(F.filter(table, lambda cut: cut <= here))


def random_folds(
    df: DataFrame, spec: PartitionSpec, row_id: str | list[str] = ROW_ID
) -> DataFrame:
    """Balanced folds: hash order when shuffled, row order when not."""
    n = df.count()
    if spec.n_splits > n:
        raise ConfigDataError(f"Cannot make {spec.n_splits} folds of {n} rows")
    keyed, order, bounds = _ordering(df, spec, row_id)
    ranks = list(accumulate(_even_sizes(n, spec.n_splits)))[:-1]
    rows = uniform_thresholds(keyed, order, ranks, n, bounds) if bounds else None
    if rows is None:
        rows = rank_thresholds(keyed, order, {(): ranks}, bounds=bounds)[()]
    _check_apart(rows)
    fold = _fold_from_cuts(order, [rows[r] for r in ranks])
    return keyed.withColumn(FOLD_ID, fold.cast("int")).drop(*HASHES)


def _dealt_counts(first: int, n: int, k: int) -> list[int]:
    """How many of positions first..first+n-1 are dealt to each of k folds in turn."""
    return [(first + n - i + k - 1) // k - (first - i + k - 1) // k for i in range(k)]


def check_classes(labels: list, target: str) -> None:
    if len(labels) > MAX_CLASSES:
        raise ConfigDataError(f"Target '{target}' has too many values to be a class label")
    if any(label is None for label in labels):
        raise ConfigDataError(f"Target '{target}' contains nulls")


def class_profile(df: DataFrame, target: str, order: str = ROW_ID) -> list[tuple]:
    """(class, rows) in order of first appearance; one row per class."""
    rows = (
        df.groupBy(target)
        .agg(F.count("*").alias("n"), F.min(order).alias("first"))
        .limit(MAX_CLASSES + 1)
        .collect()
    )
    check_classes([r[target] for r in rows], target)
    rows.sort(key=lambda r: r["first"])
    return [(r[target], r["n"]) for r in rows]


def stratified_folds(
    df: DataFrame, spec: PartitionSpec, target: str, row_id: str | list[str] = ROW_ID
) -> DataFrame:
    """Folds whose class counts differ by at most one row per class."""
    keyed, order, bounds = _ordering(df, spec, row_id)
    classes = class_profile(keyed, target, row_id if isinstance(row_id, str) else "_hash")
    k = spec.n_splits
    if k > max((n for _, n in classes), default=0):
        raise ConfigDataError(f"{k} folds exceed the members of every class")
    cuts, first = {}, 0
    for label, n in classes:
        edges = list(accumulate(_dealt_counts(first, n, k)))[:-1]
        cuts[(label,)] = [e for e in edges if e < n]
        first += n
    wanted = {s: sorted(set(ranks)) for s, ranks in cuts.items()}
    rows = rank_thresholds(keyed, order, wanted, [target], bounds=bounds)

    for found in rows.values():
        _check_apart(found)
    order = order[: _used_columns(order, [cut for found in rows.values() for cut in found.values()])]
    cut_type = T.StructType([T.StructField(c, T.LongType()) for c in order])
    schema = T.StructType(
        [
            T.StructField("_class", df.schema[target].dataType),
            T.StructField("_cuts", T.ArrayType(cut_type)),
        ]
    )
    table = df.sparkSession.createDataFrame(
        [(s[0], [rows[s][r][: len(order)] for r in ranks]) for s, ranks in cuts.items()], schema
    )
    here = F.struct(*[F.col(c).cast("long").alias(c) for c in order])
    fold = F.size(F.filter("_cuts", lambda cut: cut <= here))
    if len(classes) <= BROADCAST_GROUPS:  # one row per class
        table = F.broadcast(table)
    return (
        keyed.join(table, F.col(target) == F.col("_class"))
        .withColumn(FOLD_ID, fold.cast("int"))
        .drop(*HASHES, "_class", "_cuts")
    )


# -- grouped folds -----------------------------------------------------------------


def place_equal_groups(loads: list[int], size: int, count: int) -> list[int]:
    """How many of ``count`` groups of ``size`` rows each fold gets when every group
    goes to the lightest fold (lowest index on ties); ``loads`` is updated.

    Fold f offers places at loads L, L+size, L+2*size, ...; the cheapest ``count``
    offers win, so their price is found by bisection instead of one group at a time.
    """

    def offers(price: int) -> list[int]:
        return [max(0, (price - load) // size + 1) for load in loads]

    low, high = min(loads), max(loads) + size * count
    while low < high:
        middle = (low + high) // 2
        if sum(offers(middle)) >= count:
            high = middle
        else:
            low = middle + 1
    taken = offers(low - 1)
    for fold, load in enumerate(loads):  # ties at the final price, by index
        if sum(taken) == count:
            break
        if low >= load and (low - load) % size == 0:
            taken[fold] += 1
    for fold, n in enumerate(taken):
        loads[fold] += n * size
    return taken


def _attach(df: DataFrame, group: str, folds: DataFrame, n_groups: int, n_rows: int) -> DataFrame:
    """Join ``folds`` (_group, _size, fold_id) to the rows of its groups.

    Few groups: broadcast. Many: the hot groups, at most HOT_SHARE of them, are
    broadcast so that no shuffle task receives a hot key, and the rest is shuffled.
    """
    same = F.col(group).eqNullSafe(F.col("_group"))
    table = folds.select("_group", FOLD_ID)
    if n_groups <= BROADCAST_GROUPS:
        return df.join(F.broadcast(table), same).drop("_group")
    is_hot = F.col("_size") * HOT_SHARE > n_rows
    hot = F.broadcast(folds.where(is_hot).select("_group", FOLD_ID))
    rest = folds.where(~is_hot).select("_group", FOLD_ID)
    hot_rows = df.join(hot, same).drop("_group")
    cold_rows = df.join(hot, same, "left_anti").join(rest.hint("merge"), same).drop("_group")
    return hot_rows.unionByName(cold_rows)


def group_table(df: DataFrame, group: str) -> DataFrame:
    """One row per group with its size and two hash keys that order equal sizes."""
    key = F.col("_group")
    return (
        df.groupBy(F.col(group).alias("_group"))
        .agg(F.count("*").alias("_size"))
        .withColumn("_h1", F.coalesce(hash_key(0, key), F.lit(0)))
        .withColumn("_h2", F.coalesce(hash_key(0, key, first=HASH_DIGITS + 1), F.lit(0)))
    )


def group_fold_table(groups: DataFrame, k: int) -> DataFrame:
    """(_group, _size, fold_id) from largest-first placement on the lightest fold.

    Only the histogram of group sizes reaches the driver: sizes 1..s need s(s+1)/2
    rows, so it has at most sqrt(2 * rows) entries.
    """
    histogram = groups.groupBy("_size").count().orderBy(F.desc("_size")).collect()
    if sum(r["count"] for r in histogram) < k:
        raise ConfigDataError(f"Cannot make {k} folds of fewer than {k} groups")
    loads = [0] * k
    places = [(r["_size"], r["count"], place_equal_groups(loads, r["_size"], r["count"])) for r in histogram]
    table = groups.sparkSession.createDataFrame(places, "_k long, _count long, _taken array<long>")
    return _deal_ranks(groups, "_size", table)


def _deal_ranks(groups: DataFrame, key: str, places: DataFrame) -> DataFrame:
    """(_group, _size, fold_id): the groups of each key, in hash order, as blocks.

    ``places`` (_k, _count, _taken) has for each key its number of groups and how many of
    them each fold takes. A key that goes to one fold needs no order. Keys with very many
    groups, few by their nature, are cut at exact ranks; the others are ranked in a window
    each. Both give the same folds.
    """
    order = ["_h1", "_h2"]
    used = F.filter("_taken", lambda n: n > 0)
    ends = F.transform(F.sequence(F.lit(1), F.size(used) - 1), lambda i: F.aggregate(F.slice(used, F.lit(1), i), F.lit(0).cast("long"), lambda s, n: s + n))
    table = places.select(
        "_k", "_count",
        F.filter(F.transform("_taken", lambda n, f: F.when(n > 0, f)), lambda f: f.isNotNull()).alias("_folds"),
        F.when(F.size(used) > 1, ends).otherwise(F.array().cast("array<long>")).alias("_ranks"),
    )
    is_large = (F.col("_count") > WINDOW_GROUPS) & (F.size("_folds") > 1)
    large = table.where(is_large).collect()  # each has over WINDOW_GROUPS groups
    columns = ["_group", "_size", F.get("_folds", F.col("_at")).alias(FOLD_ID)]
    here, same_key = F.struct(*order), Window.partitionBy(key).orderBy(*order)
    parts = []
    if large:
        cuts = {(r["_k"],): list(r["_ranks"]) for r in large}
        found = rank_thresholds(
            groups.where(F.col(key).isin([r["_k"] for r in large])), order, cuts, [key], bounds=HASH_BOUNDS
        )
        cut = groups.sparkSession.createDataFrame(
            [(r["_k"], r["_folds"], [found[(r["_k"],)][x] for x in r["_ranks"]]) for r in large],
            f"_k {groups.schema[key].dataType.simpleString()}, _folds array<int>, _cuts array<struct<_h1:long,_h2:long>>",
        )
        at = F.size(F.filter("_cuts", lambda first: first <= here))
        parts.append(groups.join(F.broadcast(cut), F.col(key) == F.col("_k")).withColumn("_at", at).select(*columns))
        groups = groups.join(F.broadcast(cut.select("_k")), F.col(key) == F.col("_k"), "left_anti")
    table = table.where(~is_large)
    if places.count() <= BROADCAST_GROUPS:
        table = F.broadcast(table)
    tabled = groups.join(table, F.col(key) == F.col("_k"))
    ranked = (
        tabled.where(F.size("_folds") > 1)
        .withColumn("_rank", F.row_number().over(same_key) - 1)
        .withColumn("_at", F.size(F.filter("_ranks", lambda first: first <= F.col("_rank"))))
    )
    whole = tabled.where(F.size("_folds") == 1).withColumn("_at", F.lit(0))
    return reduce(DataFrame.unionByName, [*parts, ranked.select(*columns), whole.select(*columns)])


def group_folds(df: DataFrame, spec: PartitionSpec) -> DataFrame:
    """Whole groups per fold, largest first onto the lightest fold; no seed."""
    group = spec.group_column
    groups = materialize(group_table(df, group))
    totals = groups.agg(F.count("*"), F.sum("_size")).first()
    folds = group_fold_table(groups, spec.n_splits)
    return _attach(df, group, folds, totals[0], totals[1] or 0)


# -- stratified grouped folds --------------------------------------------------------
#
# A group is a vector of class counts. Groups are placed largest spread of counts first,
# each on the fold where the class shares of all folds stay most even: where the sum over
# classes of the squared shares grows least. With x the counts a fold has, v the vector
# and t the class totals, that is the fold with the least sum of x * v / t**2, and one
# more copy of v there adds the same constant to it. So any number of equal vectors is
# placed at once, by the prices of the places that the folds offer.

#: Weights 1/t**2 in fixed point; exact to a thousandth up to 10**12 rows a class.
WEIGHT = 10**27
EXACT = "decimal(38,0)"


def place_equal_vectors(
    loads: list[list[int]], vector: dict[int, int], weights: list[int], count: int
) -> list[int]:
    """How many of ``count`` groups with the class counts ``vector`` each fold gets when
    every group goes to the fold with the least price; ties go to the lighter fold, then
    to the lower index. ``loads`` (folds x classes) is updated.

    Fold f offers places at prices P, P+step, P+2*step, ...; the cheapest ``count`` win.
    """
    if count == 1:
        price = [sum(load[c] * v * weights[c] for c, v in vector.items()) for load in loads]
        best = min(range(len(loads)), key=lambda f: (price[f], sum(loads[f]), f))
        for c, v in vector.items():
            loads[best][c] += v
        return [int(f == best) for f in range(len(loads))]
    prices = [sum(load[c] * v * weights[c] for c, v in vector.items()) for load in loads]
    rows = [sum(load) for load in loads]
    step = sum(v * v * weights[c] for c, v in vector.items())
    size = sum(vector.values())

    def offers(price: int) -> list[int]:
        return [max(0, (price - p) // step + 1) for p in prices]

    low, high = min(prices), min(prices) + step * count
    while low < high:
        middle = (low + high) // 2
        if sum(offers(middle)) >= count:
            high = middle
        else:
            low = middle + 1
    taken = offers(low - 1)
    last = [f for f, p in enumerate(prices) if low >= p and (low - p) % step == 0]
    for fold in sorted(last, key=lambda f: (rows[f] + taken[f] * size, f))[: count - sum(taken)]:
        taken[fold] += 1
    for load, n in zip(loads, taken):
        for c, v in vector.items():
            load[c] += n * v
    return taken


def _spread(classes: int) -> Column:
    """Variance of the class counts, times the square of the number of classes."""
    whole = F.lit(0).cast(EXACT)
    counts = F.transform("_vector", lambda x: x["_n"].cast("decimal(18,0)"))
    squares = F.aggregate(counts, whole, lambda s, n: (s + (n * n).cast(EXACT)).cast(EXACT))
    rows = F.aggregate(counts, whole, lambda s, n: (s + n).cast(EXACT)).cast("decimal(18,0)")
    return (squares * F.lit(classes)).cast(EXACT) - (rows * rows).cast(EXACT)


def stratified_group_fold_table(groups: DataFrame, class_totals: list[int], k: int) -> DataFrame:
    """(_group, _size, fold_id) for groups with a ``_vector`` of (class, rows).

    Every group is placed by its own class counts, groups with equal counts at once and in
    hash order. Where a group goes depends on all before it, so the distinct vectors, which
    are fewer than the groups, pass through one task as a sorted stream; it holds the
    folds' class counts alone.
    """
    weights = [WEIGHT // (n * n) for n in class_totals]
    keyed = groups.withColumn("_kind", F.to_json("_vector"))
    vectors = keyed.groupBy("_kind", "_vector").agg(F.count("*").alias("_count"))
    queue = vectors.withColumn("_spread", _spread(len(class_totals))).repartition(1)
    queue = queue.sortWithinPartitions(F.desc("_spread"), "_vector")

    def place(batches):
        loads = [[0] * len(weights) for _ in range(k)]
        for batch in batches:
            counts = batch.column("_count").to_pylist()
            taken = [
                place_equal_vectors(loads, {x["_class"]: x["_n"] for x in vector}, weights, n)
                for vector, n in zip(batch.column("_vector").to_pylist(), counts)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_kind"), batch.column("_count"), pa.array(taken, pa.list_(pa.int64()))],
                names=["_k", "_count", "_taken"],
            )

    places = queue.select("_kind", "_vector", "_count").mapInArrow(place, "_k string, _count long, _taken array<long>")
    return _deal_ranks(keyed, "_kind", materialize(places))


#: Mean deviations this close count as equal; the lighter fold takes the group.
NEAR, NEAR_SHARE = 1e-8, 1e-5


def place_by_deviation(
    groups: Iterator[tuple[list[int], list[int], int]], class_totals: list[int], k: int
) -> Iterator[int]:
    """The fold of each group (classes, rows of each, size) in turn: the one that leaves the
    mean over classes of the standard deviation of a class's shares least.

    With x the rows of a class in the folds, s their sum and e = k * x - s, the deviation
    is ``sqrt(sum(e * e) / k**3) / total``. v more rows in fold f change the sum of squares
    by ``k * v * (2 * e[f] + (k - 1) * v)``: whole numbers, exact at any size, and only
    classes of the group are looked at.
    """
    rows = [[0] * k for _ in class_totals]
    seen, squares, parts = ([0] * len(rows) for _ in range(3))
    unit = [1 / (len(rows) * k**1.5 * n) for n in class_totals]
    weight, whole = [0] * k, 0.0
    for classes, counts, size in groups:
        costs = [whole] * k
        for c, v in zip(classes, counts):
            x, kv, fixed = rows[c], k * v, (k - 1) * v - 2 * seen[c]
            for f in range(k):
                costs[f] += math.sqrt(squares[c] + kv * (2 * k * x[f] + fixed)) * unit[c] - parts[c]
        best = 0
        for f in range(1, k):
            near = abs(costs[f] - costs[best]) <= NEAR + NEAR_SHARE * abs(costs[best])
            if weight[f] < weight[best] if near else costs[f] < costs[best]:
                best = f
        for c, v in zip(classes, counts):
            squares[c] += k * v * (2 * k * rows[c][best] + (k - 1) * v - 2 * seen[c])
            part = math.sqrt(squares[c]) * unit[c]
            whole, parts[c] = whole + part - parts[c], part
            rows[c][best] += v
            seen[c] += v
        weight[best] += size
        yield best


def deviation_group_fold_table(groups: DataFrame, class_totals: list[int], k: int) -> DataFrame:
    """(_group, _size, fold_id) for groups with a ``_vector`` of (class, rows), the largest
    spread of counts first and equal spreads in hash order.

    Each group depends on all before it, so the groups pass through one task as a sorted
    stream; it holds the folds' class counts alone.
    """
    queue = groups.withColumn("_spread", _spread(len(class_totals))).repartition(1)
    queue = queue.sortWithinPartitions(F.desc("_spread"), "_h1", "_h2")
    schema = T.StructType([groups.schema["_group"], groups.schema["_size"], T.StructField(FOLD_ID, T.IntegerType())])

    def place(batches):
        waiting: list[pa.RecordBatch] = []

        def stream():
            for batch in batches:
                if batch.num_rows:
                    waiting.append(batch)
                yield from zip(*(batch.column(c).to_pylist() for c in ("_classes", "_counts", "_size")))

        folds: list[int] = []
        for fold in place_by_deviation(stream(), class_totals, k):
            folds.append(fold)
            if len(folds) == waiting[0].num_rows:
                done = waiting.pop()
                yield pa.RecordBatch.from_arrays(
                    [done.column("_group"), done.column("_size"), pa.array(folds, pa.int32())], names=schema.names
                )
                folds = []

    vector = [F.col("_vector._class").alias("_classes"), F.col("_vector._n").alias("_counts")]
    return queue.select("_group", "_size", *vector).mapInArrow(place, schema)


def stratified_group_folds(
    df: DataFrame, spec: PartitionSpec, target: str
) -> DataFrame:
    """Whole groups per fold with even class shares; plain group folds when no class
    has as many rows as there are folds."""
    group, k = spec.group_column, spec.n_splits
    counts = materialize(
        df.groupBy(F.col(group).alias("_group"), F.col(target).alias("_y")).agg(
            F.count("*").alias("_n")
        )
    )
    per_class = counts.groupBy("_y").agg(F.sum("_n").alias("n"))
    classes = per_class.limit(MAX_CLASSES + 1).collect()
    check_classes([r["_y"] for r in classes], target)
    classes.sort(key=lambda r: r["_y"])
    totals = [r["n"] for r in classes]
    if k > max(totals, default=0):
        return group_folds(df, spec)
    seed = spec.seed if spec.shuffle else 0
    key = F.col("_group")
    schema = T.StructType([T.StructField("_label", df.schema[target].dataType), T.StructField("_class", T.IntegerType())])
    numbers = df.sparkSession.createDataFrame([(r["_y"], i) for i, r in enumerate(classes)], schema)
    if len(classes) <= BROADCAST_GROUPS:  # one row per class
        numbers = F.broadcast(numbers)
    vector = F.array_sort(F.collect_list(F.struct("_class", "_n")))  # at most one per class
    groups = materialize(
        counts.join(numbers, F.col("_y") == F.col("_label"))
        .groupBy("_group")
        .agg(vector.alias("_vector"), F.sum("_n").alias("_size"))
        .withColumn("_h1", F.coalesce(hash_key(seed, key), F.lit(0)))
        .withColumn("_h2", F.coalesce(hash_key(seed, key, first=HASH_DIGITS + 1), F.lit(0)))
    )
    placed = deviation_group_fold_table if spec.spread == "deviation" else stratified_group_fold_table
    folds = materialize(placed(groups, totals, k))
    return _attach(df, group, folds, groups.count(), sum(totals))


def assign_folds(
    df: DataFrame,
    task: str,
    spec: PartitionSpec,
    target: str,
    row_id: str | list[str] = ROW_ID,
) -> DataFrame:
    """Add ``fold_id`` by partition mode and task."""
    if spec.mode == "group":
        if not spec.group_column or spec.group_column not in df.columns:
            raise ConfigDataError(
                f"Group folds need a group column of the data, not {spec.group_column!r}"
            )
        if task == "classification":
            return stratified_group_folds(df, spec, target)
        return group_folds(df, spec)
    if task == "classification":
        return stratified_folds(df, spec, target, row_id)
    return random_folds(df, spec, row_id)


MAX_FOLDS = 100_000  # of a given fold column; one that names rows is not a fold column


def dense_fold_index(df: DataFrame, fold_id: str = FOLD_ID, name: str = "fold") -> DataFrame:
    """Add the 0-based position of each row's fold id among the distinct ids.

    Ids may have any type that sorts. Nulls are an error, and so are more than
    ``MAX_FOLDS`` ids, before they reach the driver.
    """
    ids = [r[0] for r in df.select(fold_id).distinct().limit(MAX_FOLDS + 1).collect()]
    if len(ids) > MAX_FOLDS:
        raise ConfigDataError(f"Column '{fold_id}' has over {MAX_FOLDS} values, too many for folds")
    if None in ids:
        rows = df.where(F.col(fold_id).isNull()).count()
        raise ConfigDataError(f"Column '{fold_id}' is null in {rows} rows; every row needs a fold")
    schema = T.StructType(
        [T.StructField("_id", df.schema[fold_id].dataType), T.StructField(name, T.IntegerType())]
    )
    table = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(sorted(ids))], schema)
    # One row per fold, MAX_FOLDS at most.
    return df.join(F.broadcast(table), F.col(fold_id) == F.col("_id")).drop("_id")


def group_leaks(df: DataFrame, group: str, fold_id: str = FOLD_ID) -> DataFrame:
    """Groups that stand in more than one fold; empty when the folds are sound."""
    return (
        df.groupBy(group)
        .agg(F.min(fold_id).alias("first_fold"), F.max(fold_id).alias("last_fold"))
        .where(F.col("first_fold") < F.col("last_fold"))
    )
