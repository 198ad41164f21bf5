import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldyard.errors import ConfigDataError
from foldyard.operators import folds as FO
from foldyard.operators.folds import PartitionSpec, assign_folds


def _text(seed, *values):
    return ":".join([str(seed), *(f"{len(str(v))}:{v}" for v in values)]).encode()


def _hash(seed, value):
    return int(hashlib.md5(_text(seed, value)).hexdigest()[:15], 16)


@pytest.fixture(scope="module")
def people(spark):
    """600 rows; one group holds a third of them."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        group = "hot" if i % 3 == 0 else f"g{rng.integers(0, 80)}"
        rows.append((i, group, f"c{rng.choice(4, p=[0.5, 0.3, 0.15, 0.05])}", float(i)))
    frame = spark.createDataFrame(rows, "_row_id long, g string, c string, y double")
    return frame.repartition(5).cache(), rows


def _folds(frame, *columns):
    return [tuple(r) for r in frame.select(*columns, "fold_id").collect()]


def test_random_folds_are_hash_blocks(people):
    frame, rows = people
    spec = PartitionSpec(n_splits=7, random_state=3)
    got = dict(_folds(assign_folds(frame, "regression", spec, "y"), "_row_id"))
    order = sorted((_hash(3, i), i) for i, *_ in rows)
    sizes = [600 // 7 + (f < 600 % 7) for f in range(7)]
    expected, at = {}, 0
    for f, size in enumerate(sizes):
        expected.update({i: f for _, i in order[at : at + size]})
        at += size
    assert got == expected


def test_contiguous_folds_follow_row_order(people):
    frame, _ = people
    spec = PartitionSpec(n_splits=7, shuffle=False)
    got = sorted(_folds(assign_folds(frame, "regression", spec, "y"), "_row_id"))
    assert [f for _, f in got] == sorted(f for _, f in got)
    assert sorted(Counter(f for _, f in got).values()) == [85] * 2 + [86] * 5


def test_rows_identified_by_several_columns_need_no_numbers(people):
    frame, rows = people
    keyed = frame.select("g", "c", "y", F.col("y").cast("int").alias("n"))
    spec = PartitionSpec(n_splits=7, random_state=3)
    got = _folds(assign_folds(keyed, "regression", spec, "y", ["g", "n"]), "n")
    digest = {i: hashlib.md5(_text(3, g, i)).hexdigest() for i, g, *_ in rows}
    order = sorted(digest, key=digest.get)
    expected, at = {}, 0
    for f in range(7):
        size = 600 // 7 + (f < 600 % 7)
        expected.update({i: f for i in order[at : at + size]})
        at += size
    assert dict(got) == expected
    strata = _folds(assign_folds(keyed, "classification", spec, "c", ["g", "n"]), "c")
    spread = Counter(strata)
    for c in {c for c, _ in strata}:
        assert max(spread[(c, f)] for f in range(7)) - min(spread[(c, f)] for f in range(7)) <= 1
    with pytest.raises(ConfigDataError, match="Contiguous"):
        assign_folds(keyed, "regression", PartitionSpec(shuffle=False), "y", ["g", "n"])


def test_many_cuts(people):
    frame, _ = people
    spec = PartitionSpec(n_splits=60)
    got = Counter(f for _, f in _folds(assign_folds(frame, "regression", spec, "y"), "_row_id"))
    assert got == {f: 10 for f in range(60)}


@pytest.mark.parametrize("shuffle", [True, False])
def test_stratified_folds_deal_each_class(people, shuffle):
    frame, rows = people
    spec = PartitionSpec(n_splits=4, shuffle=shuffle)
    got = _folds(assign_folds(frame, "classification", spec, "c"), "_row_id", "c")
    first = {}
    for i, _, c, _ in rows:
        first.setdefault(c, i)
    dealt, at = {}, 0
    for c in sorted(first, key=first.get):
        n = sum(r[2] == c for r in rows)
        for i in range(n):
            dealt[(c, (at + i) % 4)] = dealt.get((c, (at + i) % 4), 0) + 1
        at += n
    assert Counter((c, f) for _, c, f in got) == dealt
    for c in first:  # each fold holds a block of the class in order
        key = (lambda i: (_hash(42, i), i)) if shuffle else (lambda i: i)
        blocks = [f for _, f in sorted((key(i), f) for i, d, f in got if d == c)]
        assert blocks == sorted(blocks)


def test_equal_groups_are_placed_like_one_by_one():
    rng = np.random.default_rng(0)
    for _ in range(300):
        k = int(rng.integers(2, 7))
        loads = rng.integers(0, 40, k).tolist()
        size, count = int(rng.integers(1, 12)), int(rng.integers(1, 30))
        slow, taken = list(loads), [0] * k
        for _ in range(count):
            f = slow.index(min(slow))
            slow[f] += size
            taken[f] += 1
        fast = list(loads)
        assert FO.place_equal_groups(fast, size, count) == taken
        assert fast == slow


def _largest_first(rows, k):
    loads = [0] * k
    for n in sorted(Counter(r[1] for r in rows).values(), reverse=True):
        loads[loads.index(min(loads))] += n
    return loads


@pytest.mark.parametrize("few", [True, False])
def test_group_folds_balance_and_never_leak(people, monkeypatch, few):
    """Also on the path for many groups, where hot groups are joined apart."""
    frame, rows = people
    if not few:
        monkeypatch.setattr(FO, "WINDOW_GROUPS", 1)
        monkeypatch.setattr(FO, "BROADCAST_GROUPS", 5)
        monkeypatch.setattr(FO, "HOT_SHARE", 50)
    spec = PartitionSpec("group", n_splits=4, group_column="g")
    folded = assign_folds(frame, "regression", spec, "y")
    got = _folds(folded, "_row_id", "g")
    assert len(got) == 600
    counts = Counter(f for *_, f in got)
    assert [counts[f] for f in range(4)] == _largest_first(rows, 4)
    assert FO.group_leaks(folded, "g").isEmpty()


def test_null_groups_stay_together(spark):
    rows = [(i, None if i % 4 == 0 else f"g{i % 7}") for i in range(60)]
    frame = spark.createDataFrame(rows, "_row_id long, g string")
    spec = PartitionSpec("group", n_splits=3, group_column="g")
    got = _folds(assign_folds(frame, "regression", spec, "_row_id"), "_row_id", "g")
    assert len(got) == 60
    assert len({f for _, g, f in got if g is None}) == 1


def test_equal_vectors_are_placed_like_one_by_one():
    rng = np.random.default_rng(1)
    for _ in range(300):
        k, classes, count = int(rng.integers(2, 6)), int(rng.integers(1, 5)), int(rng.integers(1, 25))
        totals = rng.integers(1, 200, classes).tolist()
        weights = [FO.WEIGHT // (t * t) for t in totals]
        loads = rng.integers(0, 9, (k, classes)).tolist()
        vector = {c: int(n) for c, n in enumerate(rng.integers(0, 4, classes)) if n} or {0: 1}
        slow, taken = [list(load) for load in loads], [0] * k
        for _ in range(count):
            price = [(sum(x[c] * v * weights[c] for c, v in vector.items()), sum(x), f) for f, x in enumerate(slow)]
            f = min(price)[2]
            taken[f] += 1
            for c, v in vector.items():
                slow[f][c] += v
        fast = [list(load) for load in loads]
        assert FO.place_equal_vectors(fast, vector, weights, count) == taken
        assert fast == slow


def _brute_spread(rows, k, seed, hot_share):
    """Groups, largest spread first, each on the fold whose class shares grow least; those of
    equal class counts go to the folds in hash order."""
    classes = sorted({r[2] for r in rows})
    table = defaultdict(lambda: [0] * len(classes))
    for _, g, c, _ in rows:
        table[g][classes.index(c)] += 1
    totals = [sum(v[j] for v in table.values()) for j in range(len(classes))]
    cells = defaultdict(list)
    for g, v in table.items():
        text = "[" + ",".join(f'{{"_class":{c},"_n":{n}}}' for c, n in enumerate(v) if n) + "]"
        cells[text].append(g)
    mean = {
        cell: {c: sum(table[g][c] for g in gs) * 256 // len(gs) for c in range(len(classes)) if any(table[g][c] for g in gs)}
        for cell, gs in cells.items()
    }

    def spread(v):
        return len(classes) * sum(n * n for n in v.values()) - sum(v.values()) ** 2

    state = [[0] * len(classes) for _ in range(k)]
    fold = {}
    for cell in sorted(cells, key=lambda c: (-spread(mean[c]), sorted(mean[c].items()), c)):
        taken = []
        for _ in cells[cell]:
            grown = [(sum(x[c] * v * (FO.WEIGHT // totals[c] ** 2) for c, v in mean[cell].items()), sum(x), f) for f, x in enumerate(state)]
            f = min(grown)[2]
            taken.append(f)
            for c, v in mean[cell].items():
                state[f][c] += v
        fold |= dict(zip(sorted(cells[cell], key=lambda g: _hash(seed, g)), sorted(taken)))
    return fold


@pytest.mark.parametrize("hot_share, window", [(10_000, 1_000_000), (50, 1_000_000), (50, 3), (2, 1)])
def test_stratified_group_folds_match_the_rule_one_by_one(people, monkeypatch, hot_share, window):
    """Hot groups alone, hot and small ones, and cells that are cut at exact ranks."""
    monkeypatch.setattr(FO, "HOT_SHARE", hot_share)
    monkeypatch.setattr(FO, "WINDOW_GROUPS", window)
    frame, rows = people
    spec = PartitionSpec("group", n_splits=4, group_column="g", random_state=42)
    folded = assign_folds(frame, "classification", spec, "c")
    got = _folds(folded, "_row_id", "g")
    assert {g: f for _, g, f in got} == _brute_spread(rows, 4, 42, hot_share)
    assert len(got) == 600 and FO.group_leaks(folded, "g").isEmpty()


def test_small_groups_are_placed_by_their_own_class_counts(spark):
    """Each holds under 1/10,000 of the rows, and groups of one size differ in their classes."""
    rows = [(i, f"g{i % 12_007}", "abc"[(i // 12_007 + (i % 12_007) * (i % 5)) % 3], 0.0) for i in range(33_000)]
    frame = spark.createDataFrame(rows, "_row_id long, g string, c string, y double")
    spec = PartitionSpec("group", n_splits=4, group_column="g", random_state=42)
    got = _folds(assign_folds(frame, "classification", spec, "c"), "g")
    assert dict(got) == _brute_spread(rows, 4, 42, None)


def test_many_small_groups_spread_every_class_evenly(spark):
    """60,000 groups beside one that holds a third of the rows: one rule, no shards."""
    sizes = F.when(F.col("id") < 30_000, F.lit("hot")).otherwise(F.concat(F.lit("g"), F.col("id")))
    label = F.when(F.col("id") % 10 == 0, "rare").otherwise(F.concat(F.lit("c"), F.col("id") % 3))
    frame = spark.range(90_000).select("id", sizes.alias("g"), label.alias("c"))
    folded = assign_folds(frame, "classification", PartitionSpec("group", 3, group_column="g"), "c")
    counts = {(r["c"], r["fold_id"]): r["n"] for r in folded.groupBy("c", "fold_id").agg(F.count("*").alias("n")).collect()}
    for label in ("rare", "c0", "c1", "c2"):
        n = [counts[label, f] for f in range(3)]
        assert max(n) - min(n) <= 2  # the hot group fills its fold's third alone


def test_small_classes_fall_back_to_group_folds(spark):
    rows = [(i, f"g{i}", f"c{i // 2}") for i in range(8)]
    frame = spark.createDataFrame(rows, "_row_id long, g string, c string")
    spec = PartitionSpec("group", n_splits=4, group_column="g")
    got = _folds(assign_folds(frame, "classification", spec, "c"), "g")
    assert Counter(f for _, f in got) == {f: 2 for f in range(4)}


def test_impossible_partitions_are_rejected(people):
    frame, _ = people
    with pytest.raises(ConfigDataError):
        assign_folds(frame, "regression", PartitionSpec(n_splits=601), "y")
    with pytest.raises(ConfigDataError, match="group column"):
        assign_folds(frame, "regression", PartitionSpec("group"), "y")
    with pytest.raises(ConfigDataError):
        assign_folds(frame, "regression", PartitionSpec("group", 100, group_column="c"), "y")
    with pytest.raises(ConfigDataError, match="mode"):
        PartitionSpec.from_config({"mode": "other"})


def test_defaults():
    assert PartitionSpec.from_config({}) == PartitionSpec("random", 10, True, 42, None)


def test_external_ids_become_dense(spark):
    frame = spark.createDataFrame([(9,), (4,), (9,), (30,)], "fold_id int")
    got = FO.dense_fold_index(frame).select("fold_id", "fold").distinct().collect()
    assert {r[0]: r[1] for r in got} == {4: 0, 9: 1, 30: 2}


def test_leaks_are_reported(spark):
    frame = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1)], "g string, fold_id int")
    assert [r["g"] for r in FO.group_leaks(frame, "g").collect()] == ["a"]


def test_fold_assignment_does_not_shuffle_rows(people):
    frame, _ = people
    folded = assign_folds(frame, "classification", PartitionSpec(n_splits=4), "c")
    plan = folded._jdf.queryExecution().executedPlan().toString()
    above_cache = plan.split("InMemoryTableScan")[0]
    assert "Exchange hashpartitioning" not in above_cache and "Sort" not in above_cache
    assert folded.where(F.col("fold_id") < 0).isEmpty()


def test_key_parts_do_not_run_together(spark):
    rows = [("a", None, "b"), ("a", "b", None), (None, "a", "b"), ("a:1", "b", ""), ("a", "1:b", ""), ("-", "a", "b")]
    frame = spark.createDataFrame(rows, "x string, y string, z string")
    hashes = {r[0] for r in frame.select(FO.hash_key(1, *map(F.col, "xyz"))).collect()}
    assert len(hashes) == len(rows)


@pytest.mark.parametrize("mode", ["random", "stratified"])
def test_rows_that_share_keys_fill_every_fold(spark, mode):
    frame = spark.range(103).select("id", (F.col("id") % 3).cast("string").alias("key"), (F.col("id") % 2).alias("y"))
    spec = FO.PartitionSpec(n_splits=5)
    folded = (
        FO.random_folds(frame, spec, ["key"]) if mode == "random" else FO.stratified_folds(frame, spec, "y", ["key"])
    )
    sizes = {r["fold_id"]: r["count"] for r in folded.groupBy("fold_id").count().collect()}
    assert sorted(sizes) == [0, 1, 2, 3, 4] and set(sizes.values()) == {20, 21}


def test_rows_equal_in_every_column_are_refused(spark):
    frame = spark.range(50).select(F.lit("same").alias("key"))
    with pytest.raises(ConfigDataError, match="equal in every column"):
        FO.random_folds(frame, FO.PartitionSpec(n_splits=5), ["key"])


def test_given_fold_ids_of_any_type(spark):
    frame = spark.createDataFrame([("b",), ("a",), ("c",), ("a",)], "fold_id string")
    assert [(r["fold_id"], r["fold"]) for r in FO.dense_fold_index(frame).orderBy("fold_id").collect()] == [
        ("a", 0), ("a", 0), ("b", 1), ("c", 2),
    ]
    with pytest.raises(ConfigDataError, match="null in 2 rows"):
        FO.dense_fold_index(frame.union(spark.createDataFrame([(None,), (None,)], "fold_id string")))
