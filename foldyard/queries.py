"""Registered queries over the driver's tables, and equivalent SQL.

Each query runs the library on whole tables. The SQL spells the same result out in
plain relational terms. Sums are rounded on both sides, since their order differs.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import metrics as M
from .functions.params import grid_list, range_list
from .operators.features import (
    Affine,
    f_scores_classes,
    f_scores_regression,
    keep_percentile,
    own_fold_columns,
    principal_axes,
    row_norm,
    standardise,
)
from .operators.folds import (
    FOLD_ID,
    PartitionSpec,
    assign_folds,
    dense_fold_index,
    group_folds,
    group_leaks,
    random_folds,
    stratified_folds,
)
from .operators.mutual_info import BINS, train_mutual_info
from .operators.rowid import ROW_ID, rank_rows
from .plans import report
from .plans.api import benchmark, plan, prepare, run_experiments
from .plans.dataset import Dataset, spread_arrays
from .plans.experiments import (
    expand,
    plan_summary,
    with_cost,
    with_validity,
    work_list,
)
from .session import scratch_path
from .sources.sinks import FanOutSink, ParquetSink, ReportSink
from .sources.tables import (
    align_folds,
    drop_missing_target,
    project,
    read_folds,
    read_table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- shared pieces -------------------------------------------------------------------

LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]
LINE_KEY = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus",
]
FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CHARGE = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"
MIXED = "l_quantity * 1000 + l_extendedprice * (1 - l_discount)"
K = 5


def hash_sql(seed: int, key: str | list[str], first: int = 1) -> str:
    keys = [key] if isinstance(key, str) else key
    parts = [f"coalesce(length(CAST({k} AS VARCHAR)) || ':' || {k}, '-')" for k in keys]
    return f"substr(md5('{seed}:' || {' || chr(58) || '.join(parts)}), {first}, 15)"


def keyed_fold_sql(keys: list[str], k: int, seed: int = 42, all_columns: list[str] | None = None) -> str:
    """Folds of rows identified by several columns; rows that share those by all columns."""
    order = ", ".join(
        hash_sql(seed, columns, first) for columns in (keys, all_columns) if columns for first in (1, 16)
    )
    return f"CAST(ntile({k}) OVER (ORDER BY {order}) - 1 AS INTEGER)"


def random_fold_sql(key: str, k: int, seed: int = 42) -> str:
    return f"CAST(ntile({k}) OVER (ORDER BY {hash_sql(seed, key)}, {key}) - 1 AS INTEGER)"


def lineitem_dataset(spark: SparkSession, sf_dir: str, target: str = CHARGE) -> Dataset:
    """lineitem with random folds by its key columns and a derived target."""
    lineitem = table(spark, sf_dir, "lineitem")
    folded = random_folds(lineitem, PartitionSpec(n_splits=K), LINE_KEY).withColumn(
        "y", F.expr(target)
    )
    return Dataset.build(folded, FEATURES, "y", "regression", FOLD_ID)


def lineitem_sql(target: str = CHARGE) -> str:
    """CTE ``base(fold, y, x0..x3)``."""
    columns = ", ".join(f"{c} AS x{i}" for i, c in enumerate(FEATURES))
    fold = keyed_fold_sql(LINE_KEY, K)
    return f"""
    base AS (SELECT {fold} AS fold, {target} AS y, {columns} FROM lineitem)"""


def models_sql(k: int = K) -> str:
    return f"models AS (SELECT CAST(range AS INTEGER) AS m FROM range({k}))"


# -- sources, projection, filters ----------------------------------------------------


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def csv_scan(spark, sf_dir):
    path = f"{scratch_path(spark)}/part.csv"
    table(spark, sf_dir, "part").write.csv(path, header=True)
    read = read_table(spark, path)
    return read.withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def parquet_scan(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/nation.parquet")


@query(
    """SELECT o_orderkey, CAST(o_orderkey % 7 AS INTEGER) AS fold_id FROM orders"""
)
def fold_file_scan(spark, sf_dir):
    """A fold file in any row order, with gaps in row_id: rows go by its order."""
    path = f"{scratch_path(spark)}/folds.csv"
    orders = table(spark, sf_dir, "orders")
    orders.select(
        (F.col("o_orderkey") * 3 + 5).alias("row_id"), (F.col("o_orderkey") % 7).alias(FOLD_ID)
    ).orderBy(F.desc("row_id")).write.csv(path, header=True)
    folds = read_folds(spark, path, orders.count())
    return folds.select(F.col(ROW_ID).alias("o_orderkey"), FOLD_ID)


@query(
    "SELECT l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem"
)
def feature_projection(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    skip = [c for c in LINEITEM if c not in FEATURES]
    features = project(lineitem, "l_extendedprice", None, skip)
    return lineitem.select(*features, "l_extendedprice")


@query(
    """SELECT doc_id, quality, n_chars FROM documents JOIN labels USING (doc_id)
    WHERE quality IS NOT NULL"""
)
def hook_dropna(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    params = {"drop_na_target": True, "target_column": "quality"}
    joined = documents.join(labels, "doc_id", "left").transform(drop_missing_target, params)
    return joined.select("doc_id", "quality", "n_chars")


@query(
    """SELECT 'embeddings' AS source, bool_or(list_min(embedding) < 0) AS negative FROM embeddings
    UNION ALL SELECT 'lineitem', bool_or(least(l_quantity, l_extendedprice, l_discount, l_tax) < 0)
    FROM lineitem"""
)
def any_negative_feature(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(
        F.array_min("embedding").alias("low"), F.lit(0.0).alias("y"), F.lit(0).alias("fold")
    )
    lineitem = table(spark, sf_dir, "lineitem").withColumns({"y": F.lit(0.0), "fold": F.lit(0)})
    found = []
    for source, rows, features in (("embeddings", vectors, ["low"]), ("lineitem", lineitem, FEATURES)):
        data = Dataset.build(rows, features, "y", "regression", "fold")
        found.append((source, data.profile.any_negative))
        data.release()
    return spark.createDataFrame(found, "source string, negative boolean")


# -- row ids and folds ---------------------------------------------------------------


@query(
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    row_number() OVER (ORDER BY {", ".join(LINEITEM)}) - 1 AS row_rank FROM lineitem"""
)
def rowid_rank(spark, sf_dir):
    ranked = rank_rows(table(spark, sf_dir, "lineitem"), LINEITEM, "row_rank", LINEITEM[:4])
    return ranked


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn(ROW_ID, F.col("o_orderkey"))


@query(f"SELECT o_orderkey, {random_fold_sql('o_orderkey', 10)} AS fold_id FROM orders")
def folds_random(spark, sf_dir):
    return random_folds(_orders(spark, sf_dir), PartitionSpec()).select("o_orderkey", FOLD_ID)


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus"]


@query(
    f"""SELECT o_orderkey, {keyed_fold_sql(["o_orderstatus"], K, all_columns=ORDER_COLUMNS)} AS fold_id
    FROM orders"""
)
def folds_random_duplicate_keys(spark, sf_dir):
    """Three key values for all rows: still five folds of even size."""
    orders = table(spark, sf_dir, "orders").select(*ORDER_COLUMNS)
    folded = random_folds(orders, PartitionSpec(n_splits=K), ["o_orderstatus"])
    return folded.select("o_orderkey", FOLD_ID)


@query(
    f"""SELECT doc_id, {keyed_fold_sql(["quality", "lang", "toxic"], K, all_columns=["doc_id", "lang", "quality", "toxic"])}
    AS fold_id FROM documents LEFT JOIN labels USING (doc_id)"""
)
def folds_null_keys(spark, sf_dir):
    """Key columns with nulls in different places."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    keyed = documents.join(labels, "doc_id", "left").select("doc_id", "lang", "quality", "toxic")
    folded = random_folds(keyed, PartitionSpec(n_splits=K), ["quality", "lang", "toxic"])
    return folded.select("doc_id", FOLD_ID)


@query(
    """SELECT p_partkey, CAST(ntile(7) OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS fold_id
    FROM part"""
)
def folds_contiguous(spark, sf_dir):
    spec = PartitionSpec(n_splits=7, shuffle=False)
    folded = random_folds(table(spark, sf_dir, "part"), spec, "p_partkey")
    return folded.select("p_partkey", FOLD_ID)


def stratified_sql(relation: str, key: str, label: str, k: int, order: str) -> str:
    """Fold of every row when each class fills its dealt share of the folds in order."""
    return f"""
    WITH classes AS (
      SELECT {label} AS label, count(*) AS n, min({key}) AS first FROM {relation} GROUP BY 1),
    placed AS (SELECT *, coalesce(sum(n) OVER (ORDER BY first
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM classes),
    shares AS (SELECT label, fold,
        (off + n - fold + {k} - 1) // {k} - (off - fold + {k} - 1) // {k} AS share
      FROM placed, (SELECT range AS fold FROM range({k}))),
    cuts AS (SELECT label, fold, sum(share) OVER w AS hi, share FROM shares
      WINDOW w AS (PARTITION BY label ORDER BY fold)),
    ranked AS (SELECT {key} AS k, {label} AS label,
        row_number() OVER (PARTITION BY {label} ORDER BY {order}) - 1 AS r FROM {relation})
    SELECT k AS {key}, ranked.label AS {label}, CAST(fold AS INTEGER) AS fold_id
    FROM ranked JOIN cuts ON ranked.label = cuts.label AND r < hi AND r >= hi - share"""


@query(
    stratified_sql("events", "event_id", "event_type", 7, hash_sql(42, "event_id") + ", event_id")
)
def folds_stratified(spark, sf_dir):
    folded = stratified_folds(
        table(spark, sf_dir, "events"), PartitionSpec(n_splits=7), "event_type", "event_id"
    )
    return folded.select("event_id", "event_type", FOLD_ID)


@query(
    f"""SELECT label, fold_id, count(*) AS n_rows
    FROM ({stratified_sql("embeddings", "vec_id", "label", K, "vec_id")}) GROUP BY 1, 2"""
)
def folds_stratified_counts(spark, sf_dir):
    spec = PartitionSpec(n_splits=K, shuffle=False)
    folded = stratified_folds(table(spark, sf_dir, "embeddings"), spec, "label", "vec_id")
    return folded.groupBy("label", FOLD_ID).agg(F.count("*").alias("n_rows"))


def greedy_sql(relation: str, group: str, k: int) -> str:
    """CTEs that place groups one by one, largest first, on the lightest fold."""
    return f"""
    sizes AS (SELECT {group} AS g, count(*) AS n FROM {relation} GROUP BY 1),
    queue AS (SELECT n, row_number() OVER (ORDER BY n DESC, g) AS i FROM sizes),
    step AS (
      SELECT CAST(0 AS BIGINT) AS i, CAST({[0] * k} AS BIGINT[]) AS loads,
        CAST(NULL AS BIGINT) AS fold, CAST(NULL AS BIGINT) AS n
      UNION ALL
      SELECT queue.i, list_transform(range(1, {k + 1}), lambda j:
          CASE WHEN j = list_position(loads, list_min(loads)) THEN loads[j] + queue.n
          ELSE loads[j] END), list_position(loads, list_min(loads)) - 1, queue.n
      FROM step JOIN queue ON queue.i = step.i + 1)"""


@query(
    f"""WITH RECURSIVE {greedy_sql("events", "user_id", K)}
    SELECT CAST(fold AS INTEGER) AS fold_id, CAST(sum(n) AS BIGINT) AS n_rows,
      count(*) AS n_groups FROM step WHERE i > 0 GROUP BY 1"""
)
def folds_group_loads(spark, sf_dir):
    spec = PartitionSpec("group", n_splits=K, group_column="user_id")
    folded = group_folds(table(spark, sf_dir, "events"), spec)
    return folded.groupBy(FOLD_ID).agg(
        F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("n_groups")
    )


@query(
    f"""WITH RECURSIVE {greedy_sql("orders", "o_custkey", K)},
    quotas AS (SELECT n, fold, count(*) AS c FROM step WHERE i > 0 GROUP BY 1, 2),
    cuts AS (SELECT n, fold, c, sum(c) OVER (PARTITION BY n ORDER BY fold) AS hi FROM quotas),
    ranked AS (SELECT g, n, row_number() OVER (PARTITION BY n
        ORDER BY {hash_sql(0, "g")}, {hash_sql(0, "g", 16)}) - 1 AS r FROM sizes)
    SELECT g AS o_custkey, ranked.n AS n_rows, CAST(fold AS INTEGER) AS fold_id
    FROM ranked JOIN cuts ON ranked.n = cuts.n AND r < hi AND r >= hi - c"""
)
def folds_group(spark, sf_dir):
    spec = PartitionSpec("group", n_splits=K, group_column="o_custkey")
    folded = group_folds(table(spark, sf_dir, "orders"), spec)
    return folded.groupBy("o_custkey", FOLD_ID).agg(F.count("*").alias("n_rows"))


@query(
    """SELECT count(DISTINCT user_id) AS n_groups, CAST(0 AS BIGINT) AS n_leaks FROM events"""
)
def folds_group_leakage(spark, sf_dir):
    spec = PartitionSpec("group", n_splits=K, group_column="user_id")
    events = table(spark, sf_dir, "events")
    leaks = group_leaks(group_folds(events, spec), "user_id")
    return events.agg(F.count_distinct("user_id").alias("n_groups")).withColumn(
        "n_leaks", F.lit(leaks.count()).cast("long")
    )


def _labelled(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    return table(spark, sf_dir, "labels").join(documents, "doc_id")


@query(
    """SELECT source, CAST(1 AS BIGINT) AS n_folds, count(*) AS n_rows,
    CAST(sum(quality) AS BIGINT) AS n_good FROM labels JOIN documents USING (doc_id) GROUP BY 1"""
)
def folds_sgk_leakage(spark, sf_dir):
    spec = PartitionSpec("group", n_splits=3, group_column="source")
    folded = assign_folds(_labelled(spark, sf_dir), "classification", spec, "quality")
    return folded.groupBy("source").agg(
        F.count_distinct(FOLD_ID).alias("n_folds"),
        F.count("*").alias("n_rows"),
        F.sum("quality").alias("n_good"),
    )


def _stratified_group_sql(rows: str, group: str) -> str:
    """Greedy placement of groups by their class counts, each place offered and sorted one
    by one.

    ``rows``: g, y. A cell holds the groups of equal class counts.
    """
    return f"""WITH RECURSIVE src AS ({rows}),
    cells AS (SELECT g, y, count(*) AS n FROM src GROUP BY ALL),
    classes AS (SELECT y, row_number() OVER (ORDER BY y) AS c, CAST(sum(n) AS HUGEINT) AS t
      FROM cells GROUP BY y),
    facts AS (SELECT list(1000000000000000000000000000::HUGEINT // (t * t) ORDER BY c) AS w,
      count(*) AS nc FROM classes),
    vectors AS (SELECT g, list({{'c': c, 'n': n}} ORDER BY c) AS v
      FROM cells JOIN classes USING (y) GROUP BY g),
    keyed AS (SELECT g, v, v::VARCHAR AS cell FROM vectors),
    kinds AS (SELECT cell, count(*) AS m FROM keyed GROUP BY cell),
    means AS (SELECT cell, u.c AS c, u.n AS x
      FROM (SELECT cell, unnest(any_value(v)) AS u FROM keyed GROUP BY cell)),
    dense AS (SELECT k.cell, k.m, list(coalesce(x, 0)::HUGEINT ORDER BY classes.c) AS v,
        list({{'c': classes.c, 'x': x}} ORDER BY classes.c) FILTER (WHERE x IS NOT NULL) AS sparse
      FROM kinds k CROSS JOIN classes LEFT JOIN means ON means.cell = k.cell AND means.c = classes.c
      GROUP BY ALL),
    queue AS (SELECT cell, m, v, row_number() OVER (ORDER BY
        nc * list_sum(list_transform(v, lambda x: x * x)) - list_sum(v) * list_sum(v) DESC,
        sparse, cell) AS i FROM dense, facts),
    step AS (
      SELECT CAST(0 AS BIGINT) AS i, list_transform(range({K}),
          lambda f: list_transform(w, lambda x: CAST(0 AS HUGEINT))) AS loads,
        CAST(NULL AS VARCHAR) AS cell, CAST(NULL AS BIGINT[]) AS taken FROM facts
      UNION ALL
      SELECT i, list_transform(loads, lambda row, f:
          list_transform(row, lambda x, c: x + taken[f] * v[c])), cell, taken
      FROM (SELECT *, list_transform(range({K}),
              lambda f: len(list_filter(won, lambda o: o.f = f))) AS taken
        FROM (SELECT queue.i, queue.cell, queue.v, loads,
            list_slice(list_sort(flatten(list_transform(range({K}), lambda f:
              list_transform(range(m), lambda nth: {{
                'price': list_sum(list_transform(v, lambda x, c: (loads[f + 1][c] + nth * x) * x * w[c])),
                'rows': list_sum(loads[f + 1]) + nth * list_sum(v), 'f': f}})))), 1, m) AS won
          FROM step JOIN queue ON queue.i = step.i + 1 CROSS JOIN facts))),
    placed AS (SELECT cell, list_transform(range(1, {K + 1}), lambda f: list_sum(taken[1:f])) AS ends
      FROM step WHERE i > 0),
    ranked AS (SELECT g, cell, row_number() OVER (PARTITION BY cell ORDER BY {hash_sql(42, "g")}) - 1 AS rnk
      FROM keyed)
    SELECT g AS {group}, CAST(len(list_filter(ends, lambda e: e <= rnk)) AS INTEGER) AS fold_id
    FROM ranked JOIN placed USING (cell)"""


@query(
    f"""WITH RECURSIVE cells AS (
      SELECT user_id AS g, event_type AS y, count(*) AS n FROM events GROUP BY ALL),
    classes AS (SELECT y, CAST(sum(n) AS DOUBLE) AS n FROM cells GROUP BY y),
    totals AS (SELECT list(n ORDER BY y) AS t FROM classes),
    vectors AS (SELECT u.g, list(coalesce(cells.n, 0)::DOUBLE ORDER BY classes.y) AS v
      FROM (SELECT DISTINCT g FROM cells) u CROSS JOIN classes
      LEFT JOIN cells ON cells.g IS NOT DISTINCT FROM u.g AND cells.y = classes.y GROUP BY u.g),
    queue AS (SELECT g, v, row_number() OVER (ORDER BY
        len(v) * list_sum(list_transform(v, lambda x: x * x)) - list_sum(v) ** 2 DESC,
        {hash_sql(42, "g")}) AS i FROM vectors),
    step AS (
      SELECT CAST(0 AS BIGINT) AS i, list_transform(range({K}),
          lambda f: list_transform(t, lambda x: CAST(0 AS DOUBLE))) AS loads,
        CAST(NULL AS BIGINT) AS fold, CAST(NULL AS BIGINT) AS g FROM totals
      UNION ALL
      SELECT i, list_transform(loads, lambda row, f: CASE WHEN f = best.f
          THEN list_transform(row, lambda x, c: x + v[c]) ELSE row END), best.f - 1, g
      FROM (SELECT queue.i, queue.g, queue.v, loads, list_reduce(
          list_transform(range(1, {K + 1}), lambda f: {{'f': f,
            'cost': list_avg(list_transform(t, lambda total, c: list_stddev_pop(list_transform(
              loads, lambda row, j: (row[c] + CASE WHEN j = f THEN v[c] ELSE 0 END) / total)))),
            'weight': list_sum(loads[f]) + list_sum(v)}}),
          lambda a, b: CASE WHEN (CASE WHEN abs(b.cost - a.cost) <= 1e-8 + 1e-5 * abs(a.cost)
            THEN b.weight < a.weight ELSE b.cost < a.cost END) THEN b ELSE a END) AS best
        FROM step JOIN queue ON queue.i = step.i + 1 CROSS JOIN totals))
    SELECT g AS user_id, CAST(fold AS INTEGER) AS fold_id FROM step WHERE i > 0"""
)
def folds_stratified_group(spark, sf_dir):
    """Whole users per fold, the deviation of class shares kept small."""
    spec = PartitionSpec("group", n_splits=K, group_column="user_id", spread="deviation")
    folded = assign_folds(table(spark, sf_dir, "events"), "classification", spec, "event_type")
    return folded.select("user_id", FOLD_ID).distinct()


@query(
    _stratified_group_sql(
        "SELECT l_orderkey || '-' || l_partkey AS g, l_returnflag AS y FROM lineitem", "item"
    )
)
def folds_stratified_group_many(spark, sf_dir):
    """Almost as many groups as rows: orders of a part, by return flag."""
    items = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey").alias("item"), "l_returnflag"
    )
    spec = PartitionSpec("group", n_splits=K, group_column="item")
    return assign_folds(items, "classification", spec, "l_returnflag").select("item", FOLD_ID).distinct()


@query(
    """SELECT o_orderkey, CAST((o_custkey % 7) * 10 + 3 AS INTEGER) AS fold_id,
    CAST(dense_rank() OVER (ORDER BY o_custkey % 7) - 1 AS INTEGER) AS fold FROM orders"""
)
def folds_external_dense(spark, sf_dir):
    external = table(spark, sf_dir, "orders").select(
        "o_orderkey", ((F.col("o_custkey") % 7) * 10 + 3).cast("int").alias(FOLD_ID)
    )
    return dense_fold_index(external)


@query(
    f"SELECT o_orderkey, o_totalprice, {random_fold_sql('o_orderkey', K)} AS fold_id FROM orders"
)
def folds_join(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    folds = random_folds(orders, PartitionSpec(n_splits=K)).select(ROW_ID, FOLD_ID)
    joined = align_folds(orders, folds)
    return joined.select("o_orderkey", "o_totalprice", F.col("fold").alias(FOLD_ID))


@query(
    f"""WITH f AS (SELECT {random_fold_sql("o_orderkey", 7)} AS fold FROM orders)
    SELECT fold, count(*) AS n_test, CAST(sum(count(*)) OVER () - count(*) AS BIGINT) AS n_train
    FROM f GROUP BY fold"""
)
def fold_train_test_counts(spark, sf_dir):
    folded = dense_fold_index(random_folds(_orders(spark, sf_dir), PartitionSpec(n_splits=7)))
    return Dataset.build(folded, ["o_custkey"], "o_totalprice", "regression", "fold").fold_sizes()


@query(
    """SELECT DISTINCT CAST(dense_rank() OVER (ORDER BY user_id % 9 * 5) - 1 AS INTEGER) AS fold
    FROM events"""
)
def distinct_folds(spark, sf_dir):
    """The folds a run would use, of a given fold column with gaps."""
    events = table(spark, sf_dir, "events").withColumn(FOLD_ID, F.col("user_id") % 9 * 5)
    data = Dataset.build(dense_fold_index(events), ["value"], "value", "regression", "fold")
    return data.fold_sizes().select("fold")


# -- feature steps -------------------------------------------------------------------


def _part_dataset(spark, sf_dir):
    """part with its key, random folds and two features on different scales."""
    part = table(spark, sf_dir, "part").withColumn(ROW_ID, F.col("p_partkey"))
    folded = random_folds(part, PartitionSpec(n_splits=K))
    keyed = folded.withColumn("x0", F.col("p_size").cast("double")).withColumn(
        "x1", F.col("p_retailprice")
    )
    return keyed.withColumn("fold", F.col(FOLD_ID)).withColumn("y", F.col("x0") + F.col("x1"))


PART_SQL = f"""
    base AS (SELECT p_partkey, {random_fold_sql("p_partkey", K)} AS fold,
      CAST(p_size AS DOUBLE) AS x0, p_retailprice AS x1 FROM part),
    {models_sql()},
    st AS (SELECT m, avg(x0) AS m0, avg(x1) AS m1, stddev_pop(x0) AS s0, stddev_pop(x1) AS s1,
      var_samp(x0) AS a, covar_samp(x0, x1) AS b, var_samp(x1) AS c
      FROM models JOIN base ON fold <> m GROUP BY m)"""


def _part_moments(df):
    from .operators.moments import fold_moments_columns, train_moments

    return train_moments(fold_moments_columns(df, ["x0", "x1"], "y", K))


@query(
    f"""WITH {PART_SQL}
    SELECT p_partkey, fold, round((x0 - m0) / s0, 6) AS z0, round((x1 - m1) / s1, 6) AS z1
    FROM base JOIN st ON fold = m"""
)
def scale_std_per_fold(spark, sf_dir):
    df = _part_dataset(spark, sf_dir)
    maps = [standardise(m) for m in _part_moments(df)]
    z = own_fold_columns(maps, ["x0", "x1"])
    return df.select("p_partkey", "fold", *[F.round(c, 6).alias(f"z{i}") for i, c in enumerate(z)])


@query(
    f"""WITH {PART_SQL},
    axes AS (SELECT *, (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b * b) AS top FROM st),
    unit AS (SELECT *, b / sqrt(b * b + (top - a) ** 2) AS u0,
      (top - a) / sqrt(b * b + (top - a) ** 2) AS u1 FROM axes),
    signed AS (SELECT *, CASE WHEN (CASE WHEN abs(u0) > abs(u1) THEN u0 ELSE u1 END) < 0
      THEN -1 ELSE 1 END AS sign FROM unit)
    SELECT p_partkey, fold, round(sign * ((x0 - m0) * u0 + (x1 - m1) * u1), 6) AS score
    FROM base JOIN signed ON fold = m"""
)
def pca_k1(spark, sf_dir):
    df = _part_dataset(spark, sf_dir)
    maps = [principal_axes(m, 1) for m in _part_moments(df)]
    score = own_fold_columns(maps, ["x0", "x1"])[0]
    return df.select("p_partkey", "fold", F.round(score, 6).alias("score"))


def _norm_query(norm: str, length: str):
    parts = ", ".join(
        f"round({c} / (CASE WHEN {length} = 0 THEN 1 ELSE {length} END), 6) AS z{i}"
        for i, c in enumerate(FEATURES)
    )

    def run(spark, sf_dir):
        columns = row_norm([F.col(c) for c in FEATURES], norm)
        return table(spark, sf_dir, "lineitem").select(
            *[F.round(c, 6).alias(f"z{i}") for i, c in enumerate(columns)]
        )

    run.__name__ = f"scale_norm_{norm}"
    query(f"SELECT {parts} FROM lineitem")(run)


_norm_query("l1", "(" + " + ".join(f"abs({c})" for c in FEATURES) + ")")
_norm_query("l2", "sqrt(" + " + ".join(f"{c} * {c}" for c in FEATURES) + ")")
_norm_query("max", "greatest(" + ", ".join(f"abs({c})" for c in FEATURES) + ")")


def _long(spark, values, name: str, decimals: int):
    rows = [
        (m, i, round(float(v), decimals)) for m, row in enumerate(values) for i, v in enumerate(row)
    ]
    return spark.createDataFrame(rows, f"model int, feature int, {name} double")


@query(
    f"""WITH {lineitem_sql(MIXED)}, {models_sql()},
    r AS (SELECT m, count(*) AS n, {", ".join(f"corr(x{i}, y) AS r{i}" for i in range(4))}
      FROM models JOIN base ON fold <> m GROUP BY m)
    {" UNION ALL ".join(
        f"SELECT m AS model, {i} AS feature, round(r{i} * r{i} / (1 - r{i} * r{i}) * (n - 2), 4)"
        f" AS f_score FROM r" for i in range(4))}"""
)
def fscore_reg(spark, sf_dir):
    data = lineitem_dataset(spark, sf_dir, MIXED)
    scores = [f_scores_regression(m) for m in data.train_moments]
    return _long(spark, scores, "f_score", 4)


def _embedding_dataset(spark, sf_dir, target: str = "label"):
    vectors = table(spark, sf_dir, "embeddings").withColumn(ROW_ID, F.col("vec_id"))
    folded = stratified_folds(vectors, PartitionSpec(n_splits=K), "label")
    wide, features = spread_arrays(folded.withColumn("label", F.expr(target)), ["embedding"])
    return Dataset.build(wide, features, "label", "classification", FOLD_ID)


@query(
    f"""WITH base AS (SELECT {random_fold_sql("vec_id", K)} AS fold, CAST(label AS DOUBLE) AS y, embedding
      FROM embeddings), {models_sql()},
    long AS (SELECT fold, y, i AS feature, CAST(embedding[i + 1] AS DOUBLE) AS x FROM base, range(64) t(i)),
    r AS (SELECT m, feature, count(*) AS n, corr(x, y) AS r FROM models JOIN long ON fold <> m GROUP BY ALL)
    SELECT m AS model, CAST(feature AS INTEGER) AS feature, round(r * r / (1 - r * r) * (n - 2), 4) AS f_score FROM r"""
)
def fscore_array(spark, sf_dir):
    """Scores of the places of an array column, given as one feature."""
    vectors = table(spark, sf_dir, "embeddings").withColumn(ROW_ID, F.col("vec_id"))
    folded, features = spread_arrays(random_folds(vectors, PartitionSpec(n_splits=K)), ["embedding"])
    data = Dataset.build(folded, features, "label", "regression", FOLD_ID)
    return _long(spark, [f_scores_regression(m) for m in data.train_moments], "f_score", 4)


def _class_scores(data: Dataset):
    from .plans.engine import Engine

    return Engine(data, "classification", ["accuracy"]).filter_scores(data, "fscore")


EMBEDDING_SQL = f"""
    f AS ({stratified_sql("embeddings", "vec_id", "label", K, hash_sql(42, "vec_id") + ", vec_id")}),
    long AS (SELECT fold_id AS fold, f.label, i AS feature,
      CAST(embedding[i + 1] AS DOUBLE) AS x
      FROM f JOIN embeddings USING (vec_id), (SELECT CAST(range AS INTEGER) AS i FROM range(64))),
    {models_sql()},
    cells AS (SELECT m, feature, label, count(*) AS n, avg(x) AS mu, var_pop(x) * count(*) AS within
      FROM models JOIN long ON fold <> m GROUP BY ALL),
    grand AS (SELECT m, feature, sum(n * mu) / sum(n) AS mu, sum(n) AS n, count(*) AS classes,
      sum(within) AS within FROM cells GROUP BY ALL),
    scores AS (SELECT m AS model, feature,
      (SELECT sum(c.n * (c.mu - g.mu) ** 2) FROM cells c WHERE c.m = g.m AND c.feature = g.feature)
      / (classes - 1) / (within / (n - classes)) AS f FROM grand g)"""


@query(f"WITH {EMBEDDING_SQL} SELECT model, feature, round(f, 5) AS f_score FROM scores")
def fscore_cls(spark, sf_dir):
    return _long(spark, _class_scores(_embedding_dataset(spark, sf_dir)), "f_score", 5)


@query(
    f"""WITH {EMBEDDING_SQL},
    cut AS (SELECT model, quantile_cont(f, 0.75) AS q FROM scores GROUP BY model)
    SELECT model, feature FROM scores JOIN cut USING (model) WHERE f > q"""
)
def select_percentile(spark, sf_dir):
    scores = _class_scores(_embedding_dataset(spark, sf_dir))
    kept = [(m, int(i)) for m, row in enumerate(scores) for i in keep_percentile(row, 25)]
    return spark.createDataFrame(kept, "model int, feature int")


@query(
    f"""WITH {lineitem_sql(MIXED)}, {models_sql()},
    long AS (SELECT fold, y, unnest([x0, x1, x2, x3, y]) AS v, unnest([0, 1, 2, 3, 4]) AS c,
      row_number() OVER () AS rid FROM base),
    ranked AS (SELECT m, c, v, row_number() OVER (PARTITION BY m, c ORDER BY v) - 1 AS r,
      count(*) OVER (PARTITION BY m, c) AS n FROM models JOIN long ON fold <> m),
    edges AS (SELECT DISTINCT m, c, v AS e FROM ranked
      WHERE r IN (SELECT DISTINCT i * ranked.n // {BINS} FROM range(1, {BINS}) t(i))),
    edge_lists AS (SELECT m, c, list(e) AS es FROM edges GROUP BY m, c),
    ey AS (SELECT m, es FROM edge_lists WHERE c = 4),
    binned AS (SELECT ex.m, ex.c, len(list_filter(ex.es, lambda e: e <= v)) AS bin_x,
        len(list_filter(ey.es, lambda e: e <= y)) AS bin_y
      FROM long JOIN edge_lists ex ON long.c = ex.c AND ex.m <> long.fold
      JOIN ey ON ey.m = ex.m WHERE long.c < 4),
    cells AS (SELECT m, c, bin_x, bin_y, CAST(count(*) AS DOUBLE) AS n FROM binned GROUP BY ALL),
    margins AS (SELECT *, sum(n) OVER (PARTITION BY m, c, bin_x) AS nx,
      sum(n) OVER (PARTITION BY m, c, bin_y) AS ny, sum(n) OVER (PARTITION BY m, c) AS total FROM cells)
    SELECT m AS model, CAST(c AS INTEGER) AS feature,
      round(sum(n / total * ln(n * total / (nx * ny))), 6) AS mi FROM margins GROUP BY ALL"""
)
def mi_binned(spark, sf_dir):
    data = lineitem_dataset(spark, sf_dir, MIXED)
    return _long(spark, train_mutual_info(data.df, data.names, "y", K), "mi", 6)


# -- models with a closed form -------------------------------------------------------


def pls1_sql(target: str = CHARGE) -> str:
    """CTE ``scores(m, variant, rmse, r2)``: one-component PLS per fold, on all four
    features (variant 0) or on the two with the highest F (variant 1)."""
    d = range(4)
    return f"""{lineitem_sql(target)}, {models_sql()},
    st AS (SELECT m, avg(y) AS my, stddev_samp(y) AS sy,
      {", ".join(f"avg(x{i}) AS m{i}, stddev_samp(x{i}) AS s{i}, corr(x{i}, y) AS r{i}" for i in d)}
      FROM models JOIN base ON fold <> m GROUP BY m),
    masks AS (SELECT *, 0 AS variant, {", ".join(f"1 AS k{i}" for i in d)} FROM st
      UNION ALL SELECT *, 1, {", ".join(
        f"CASE WHEN {' + '.join(f'CAST(r{j} * r{j} > r{i} * r{i} AS INTEGER)' for j in d)} < 2"
        f" THEN 1 ELSE 0 END" for i in d)} FROM st),
    w AS (SELECT *, {", ".join(
        f"k{i} * r{i} / sqrt({' + '.join(f'k{j} * r{j} * r{j}' for j in d)}) AS w{i}" for i in d)}
      FROM masks),
    t AS (SELECT w.*, fold, y, {" + ".join(f"w{i} * (x{i} - m{i}) / s{i}" for i in d)} AS t
      FROM w CROSS JOIN base),
    coef AS (SELECT m, variant, sum(t * (y - my) / sy) / sum(t * t) AS q FROM t
      WHERE fold <> m GROUP BY m, variant),
    pred AS (SELECT t.m, t.variant, y, my + sy * q * t AS p
      FROM t JOIN coef USING (m, variant) WHERE fold = t.m),
    scores AS (SELECT m, variant, -sqrt(avg((y - p) ** 2)) AS rmse,
      1 - avg((y - p) ** 2) / var_pop(y) AS r2 FROM pred GROUP BY m, variant)"""


def _search(scale=("none",), filters=("none",), reduction=("none",), model=("pls",), **params):
    """A [search] section; ``params`` are grids per technique."""
    chosen = dict(scale=scale, filter=filters, reduction=reduction, model=model)
    return {
        step: {"enabled": list(keys), "params": {k: params[k] for k in keys if k in params}}
        for step, keys in chosen.items()
    }


PLS_SEARCH = _search(
    scale=("none", "std"), filters=("none", "fscore"),
    fscore={"percentile": 50}, pls={"n_components": 1},
)
METRICS = ["neg_root_mean_squared_error", "r2"]
PLS_COMBOS = """
    combos(experiment_id, scale, filter, filter_params, variant) AS (VALUES
      (1, 'none', 'none', '{}', 0), (2, 'none', 'fscore', '{''percentile'': 50}', 1),
      (3, 'std', 'none', '{}', 0), (4, 'std', 'fscore', '{''percentile'': 50}', 1))"""
COMBO_SQL = """experiment_id, scale, '{}' AS scale_params, filter, filter_params,
    'none' AS reduction, '{}' AS reduction_params, 'pls' AS model,
    '{''n_components'': 1}' AS model_params"""


def _pls_results(spark, sf_dir):
    data = lineitem_dataset(spark, sf_dir)
    experiments = expand("regression", {"search": PLS_SEARCH})
    return run_experiments(spark, data, "regression", experiments, METRICS, METRICS[0])


@query(
    f"""WITH {pls1_sql()}, {PLS_COMBOS}
    SELECT experiment_id, m AS fold, round(rmse, 4) AS neg_root_mean_squared_error,
      round(r2, 6) AS r2 FROM combos JOIN scores USING (variant)"""
)
def pls1_cv_scores(spark, sf_dir):
    detailed = _pls_results(spark, sf_dir).detailed
    return detailed.select(
        "experiment_id", "fold",
        F.round(METRICS[0], 4).alias(METRICS[0]), F.round("r2", 6).alias("r2"),
    )


@query(
    f"""WITH {pls1_sql()}, {PLS_COMBOS}
    SELECT {COMBO_SQL}, round(avg(rmse), 4) AS neg_root_mean_squared_error_mean,
      round(stddev_samp(rmse), 4) AS neg_root_mean_squared_error_std,
      round(avg(r2), 6) AS r2_mean, round(stddev_samp(r2), 6) AS r2_std
    FROM combos JOIN scores USING (variant) GROUP BY ALL"""
)
def summary_mean_std(spark, sf_dir):
    summary = _pls_results(spark, sf_dir).summary
    rounded = [
        F.round(f"{m}_{s}", 4 if m == METRICS[0] else 6).alias(f"{m}_{s}")
        for m in METRICS for s in ("mean", "std")
    ]
    return summary.select(*report.COMBO_COLUMNS, *rounded)


@query(
    f"""WITH {pls1_sql()}, {PLS_COMBOS}
    SELECT {COMBO_SQL}, round(avg(rmse), 4) AS neg_root_mean_squared_error
    FROM combos JOIN scores USING (variant) GROUP BY ALL"""
)
def ranking(spark, sf_dir):
    ranked = _pls_results(spark, sf_dir).ranking.drop("rank")
    return ranked.withColumn(METRICS[0], F.round(METRICS[0], 4))


@query(
    f"""WITH {pls1_sql()}, {PLS_COMBOS},
    means AS (SELECT {COMBO_SQL}, round(avg(rmse), 4) AS neg_root_mean_squared_error
      FROM combos JOIN scores USING (variant) GROUP BY ALL)
    SELECT *, CAST(row_number() OVER (ORDER BY neg_root_mean_squared_error DESC, experiment_id)
      AS INTEGER) AS rank FROM means"""
)
def flagship_ranking(spark, sf_dir):
    """Scaling and selection variants of one-component PLS, best first."""
    return _pls_results(spark, sf_dir).ranking.withColumn(METRICS[0], F.round(METRICS[0], 4))


@query(
    f"""WITH {pls1_sql()}, {PLS_COMBOS}
    SELECT {COMBO_SQL},
      format('{{:.2f}} +- {{:.2f}}', avg(rmse), stddev_samp(rmse)) AS neg_root_mean_squared_error,
      format('{{:.4f}} +- {{:.4f}}', avg(r2), stddev_samp(r2)) AS r2
    FROM combos JOIN scores USING (variant) GROUP BY ALL"""
)
def report_mean_std(spark, sf_dir):
    summary = _pls_results(spark, sf_dir).summary
    # Two decimals are enough for a metric in the thousands.
    return report.format_summary(summary, METRICS, {METRICS[0]: 2})


@query(
    f"""WITH {pls1_sql()}, {PLS_COMBOS},
    counts AS (SELECT count(DISTINCT experiment_id) AS n FROM combos JOIN scores USING (variant))
    SELECT * FROM (VALUES ('task', 'regression'),
      ('primary_metric', 'neg_root_mean_squared_error'),
      ('metrics', 'neg_root_mean_squared_error,r2'), ('spark_parallelism', '4'),
      ('n_experiments', '4'), ('n_failed_or_skipped', '0')) v(key, value)
    UNION ALL SELECT 'n_success', CAST(n AS VARCHAR) FROM counts"""
)
def run_metadata(spark, sf_dir):
    return _pls_results(spark, sf_dir).metadata


@query(
    f"""WITH {lineitem_sql()}, {models_sql()},
    line AS (SELECT m, regr_slope(y, x1) AS b, regr_intercept(y, x1) AS a
      FROM models JOIN base ON fold <> m GROUP BY m)
    SELECT m AS fold, round(-sqrt(avg((y - a - b * x1) ** 2)), 4) AS neg_root_mean_squared_error,
      round(1 - avg((y - a - b * x1) ** 2) / var_pop(y), 6) AS r2
    FROM base JOIN line ON fold = m GROUP BY m"""
)
def linreg1_cv_scores(spark, sf_dir):
    data = lineitem_dataset(spark, sf_dir)
    single = Dataset(data.df.select("fold", "y", F.col("x1").alias("x0")), 1)
    search = _search(model=("sgd",), sgd={"penalty": None})
    experiments = expand("regression", {"search": search})
    results = run_experiments(spark, single, "regression", experiments, METRICS, METRICS[0])
    return results.detailed.select(
        "fold", F.round(METRICS[0], 4).alias(METRICS[0]), F.round("r2", 6).alias("r2")
    )


# -- metrics -------------------------------------------------------------------------


@query(
    f"""WITH p AS (SELECT {random_fold_sql("o_orderkey", K)} AS fold, o_totalprice AS y,
      o_totalprice * (0.8 + 0.01 * (o_custkey % 40)) AS p FROM orders)
    SELECT 1 AS experiment_id, fold,
      round(-sqrt(avg((y - p) ** 2)), 4) AS neg_root_mean_squared_error,
      round(-avg((y - p) ** 2), 1) AS neg_mean_squared_error,
      round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2,
      round(-avg(abs(y - p)), 4) AS neg_mean_absolute_error,
      round(-median(abs(y - p)), 6) AS neg_median_absolute_error,
      round(1 - var_pop(y - p) / var_pop(y), 8) AS explained_variance,
      round(-max(abs(y - p)), 4) AS max_error, round(-max(abs(y - p)), 4) AS neg_max_error,
      round(-avg(abs(y - p) / abs(y)), 8) AS neg_mean_absolute_percentage_error,
      round(-avg((ln(1 + y) - ln(1 + p)) ** 2), 8) AS neg_mean_squared_log_error,
      round(-sqrt(avg((ln(1 + y) - ln(1 + p)) ** 2)), 8) AS neg_root_mean_squared_log_error
    FROM p GROUP BY fold"""
)
def metric_reg_all(spark, sf_dir):
    folded = random_folds(_orders(spark, sf_dir), PartitionSpec(n_splits=K))
    predictions = folded.select(
        F.lit(1).alias("experiment_id"),
        F.col(FOLD_ID).alias("fold"),
        F.col("o_totalprice").alias("y"),
        F.expr("o_totalprice * (0.8D + 0.01D * (o_custkey % 40))").alias("p"),
    )
    decimals = {
        "neg_root_mean_squared_error": 4, "neg_mean_squared_error": 1,
        "neg_mean_absolute_error": 4, "neg_median_absolute_error": 6,
        "max_error": 4, "neg_max_error": 4,
    }
    scored = M.regression_scores(predictions, list(M.REGRESSION_METRICS))
    return scored.select(
        *M.KEYS, *[F.round(m, decimals.get(m, 8)).alias(m) for m in M.REGRESSION_METRICS]
    )


CLASS_SQL = f"""
    p AS (SELECT {random_fold_sql("o_orderkey", K)} AS fold,
      CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) AS y,
      CAST(CASE WHEN o_custkey % 3 = 0 THEN CAST(substr(o_orderpriority, 1, 1) AS BIGINT)
        ELSE 1 + o_custkey % 5 END AS DOUBLE) AS p FROM orders)"""
LABEL_SQL = f"""{CLASS_SQL},
    lab AS (SELECT fold, label, sum(tp) AS tp, sum(s) AS s, sum(q) AS q FROM (
      SELECT fold, y AS label, CAST(y = p AS INTEGER) AS tp, 1 AS s, 0 AS q FROM p
      UNION ALL SELECT fold, p, 0, 0, 1 FROM p) GROUP BY ALL)"""


def _class_predictions(spark, sf_dir):
    folded = random_folds(_orders(spark, sf_dir), PartitionSpec(n_splits=K))
    priority = F.substring("o_orderpriority", 1, 1)
    guess = F.when(F.col("o_custkey") % 3 == 0, priority.cast("long")).otherwise(
        1 + F.col("o_custkey") % 5
    )
    return folded.select(
        F.lit(1).alias("experiment_id"),
        F.col(FOLD_ID).alias("fold"),
        priority.cast("double").alias("y"),
        guess.cast("double").alias("p"),
    )


@query(f"WITH {CLASS_SQL} SELECT 1 AS experiment_id, fold, y, p, count(*) AS n FROM p GROUP BY ALL")
def metric_cls_confusion(spark, sf_dir):
    return M.confusion(_class_predictions(spark, sf_dir))


@query(
    f"""WITH {LABEL_SQL}
    SELECT 1 AS experiment_id, fold, round(avg(2 * tp / (s + q)), 8) AS f1_macro,
      round(sum(tp) / sum(s), 8) AS accuracy FROM lab GROUP BY fold"""
)
def metric_f1_macro(spark, sf_dir):
    scored = M.classification_scores(_class_predictions(spark, sf_dir), ["f1_macro", "accuracy"])
    return scored.select(*M.KEYS, *[F.round(m, 8).alias(m) for m in ("f1_macro", "accuracy")])


_RATIOS = {
    "precision": ("tp", "q"), "recall": ("tp", "s"), "f1": ("2 * tp", "(s + q)"),
    "jaccard": ("tp", "(s + q - tp)"),
}


def _ratio_sql(base: str, average: str) -> str:
    top, bottom = _RATIOS[base]
    ratio = f"CASE WHEN {bottom} = 0 THEN 0 ELSE {top} / {bottom} END"
    if average == "micro":
        totals = {"tp": "sum(tp)", "s": "sum(s)", "q": "sum(q)"}
        value = re.sub(r"\b(tp|s|q)\b", lambda name: totals[name[0]], f"{top} / {bottom}")
    elif average == "weighted":
        value = f"sum(({ratio}) * s) / sum(s)"
    else:
        value = f"avg({ratio})"
    return f"round({value}, 8) AS {base}_{average}"


MULTI = [
    "accuracy", "balanced_accuracy", "matthews_corrcoef",
    *(f"{b}_{a}" for b in _RATIOS for a in ("macro", "micro", "weighted")),
]


@query(
    f"""WITH {LABEL_SQL}
    SELECT 1 AS experiment_id, fold, round(sum(tp) / sum(s), 8) AS accuracy,
      round(avg(CASE WHEN s > 0 THEN tp / s END), 8) AS balanced_accuracy,
      round((sum(tp) * sum(s) - sum(s * q)) / (sqrt(CAST(sum(s) * sum(s) - sum(q * q) AS DOUBLE))
        * sqrt(CAST(sum(s) * sum(s) - sum(s * s) AS DOUBLE))), 8) AS matthews_corrcoef,
      {", ".join(_ratio_sql(b, a) for b in _RATIOS for a in ("macro", "micro", "weighted"))}
    FROM lab GROUP BY fold"""
)
def metric_cls_all(spark, sf_dir):
    scored = M.classification_scores(_class_predictions(spark, sf_dir), MULTI)
    return scored.select(*M.KEYS, *[F.round(m, 8).alias(m) for m in MULTI])


BINARY_SQL = """
    b AS (SELECT CAST(doc_id % 4 AS INTEGER) AS fold, CAST(quality AS DOUBLE) AS y,
      CAST(n_chars > 2000 AS INTEGER)::DOUBLE AS p, CAST(n_chars // 50 AS DOUBLE) AS score,
      (CASE WHEN quality = 1 THEN 1 + n_chars % 98 ELSE 99 - n_chars % 98 END) / 100 AS p_true
      FROM labels JOIN documents USING (doc_id))"""


def _binary_predictions(spark, sf_dir):
    share = F.when(F.col("quality") == 1, 1 + F.col("n_chars") % 98).otherwise(
        99 - F.col("n_chars") % 98
    )
    return _labelled(spark, sf_dir).select(
        F.lit(1).alias("experiment_id"),
        (F.col("doc_id") % 4).cast("int").alias("fold"),
        F.col("quality").cast("double").alias("y"),
        (F.col("n_chars") > 2000).cast("int").cast("double").alias("p"),
        F.floor(F.col("n_chars") / 50).cast("double").alias("score"),
        (share / 100).alias("p_true"),
    )


BINARY = ["precision", "recall", "f1", "jaccard", "neg_log_loss"]


@query(
    f"""WITH {BINARY_SQL},
    c AS (SELECT fold, count_if(y = 1 AND p = 1) AS tp, count_if(y = 1) AS s,
      count_if(p = 1) AS q, avg(ln(p_true)) AS ll FROM b GROUP BY fold)
    SELECT 1 AS experiment_id, fold, round(CASE WHEN q = 0 THEN 0 ELSE tp / q END, 8) AS precision,
      round(tp / s, 8) AS recall, round(2 * tp / (s + q), 8) AS f1,
      round(tp / (s + q - tp), 8) AS jaccard, round(ll, 8) AS neg_log_loss FROM c"""
)
def metric_cls_binary(spark, sf_dir):
    scored = M.classification_scores(_binary_predictions(spark, sf_dir), BINARY)
    return scored.select(*M.KEYS, *[F.round(m, 8).alias(m) for m in BINARY])


@query(
    f"""WITH {BINARY_SQL},
    points AS (SELECT fold, score, CAST(count_if(y = 1) AS DOUBLE) AS pos,
      CAST(count_if(y <> 1) AS DOUBLE) AS neg FROM b GROUP BY ALL),
    run AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn,
      sum(pos) OVER (PARTITION BY fold) AS np, sum(neg) OVER (PARTITION BY fold) AS nn
      FROM points WINDOW w AS (PARTITION BY fold ORDER BY score DESC))
    SELECT 1 AS experiment_id, fold,
      round(sum(pos * (nn - cn + neg / 2)) / nullif(max(np * nn), 0), 8) AS roc_auc,
      round(sum(pos * cp / (cp + cn)) / max(np), 8) AS average_precision FROM run GROUP BY fold"""
)
def metric_roc_auc(spark, sf_dir):
    wanted = ["roc_auc", "average_precision"]
    scored = M.classification_scores(_binary_predictions(spark, sf_dir), wanted)
    return scored.select(*M.KEYS, *[F.round(m, 8).alias(m) for m in wanted])


PROBABILITIES = ["neg_brier_score", "top_k_accuracy", *M.PAIR_METRICS]


def _four_probabilities() -> str:
    """Odds of four classes, the true one raised for most rows; many ties."""
    odds = [f"(1 + (o_orderkey * {c + 3}) % 7 + CASE WHEN o_custkey % 4 = {c} THEN o_orderkey % 5 ELSE 0 END)" for c in range(4)]
    total = " + ".join(odds)
    return ", ".join(f"CAST({o} AS DOUBLE) / ({total})" for o in odds)


@query(
    f"""WITH p AS (SELECT {random_fold_sql("o_orderkey", K)} AS fold, o_custkey % 4 AS y,
      [{_four_probabilities()}] AS probs FROM orders),
    long AS (SELECT fold, y, c, probs[c + 1] AS score FROM p, range(4) t(c)),
    against AS (SELECT fold, 'r' AS form, c AS ca, c AS cb, c AS ranker, score, (y = c)::INT AS hit FROM long
      UNION ALL SELECT fold, 'o', least(l.c, o.c), greatest(l.c, o.c), l.c, score, (y = l.c)::INT
      FROM long l JOIN range(4) o(c) ON l.c <> o.c AND (l.y = l.c OR l.y = o.c)),
    points AS (SELECT fold, form, ca, cb, ranker, score, sum(hit)::DOUBLE AS pos, sum(1 - hit)::DOUBLE AS neg
      FROM against GROUP BY ALL),
    run AS (SELECT *, sum(neg) OVER (w ORDER BY score) AS below, sum(pos) OVER w AS np, sum(neg) OVER w AS nn
      FROM points WINDOW w AS (PARTITION BY fold, form, ca, cb, ranker)),
    areas AS (SELECT fold, form, ca, cb, ranker, sum(pos * (below - neg / 2)) / max(np * nn) AS auc,
      max(np) AS own, max(np) + max(nn) AS n FROM run GROUP BY ALL),
    pairs AS (SELECT fold, form, avg(auc) AS auc, max(CASE WHEN form = 'r' THEN own ELSE n END) AS w
      FROM areas GROUP BY fold, form, ca, cb),
    means AS (SELECT fold, avg(auc) FILTER (WHERE form = 'r') AS ovr,
      sum(auc * w) FILTER (WHERE form = 'r') / sum(w) FILTER (WHERE form = 'r') AS ovr_w,
      avg(auc) FILTER (WHERE form = 'o') AS ovo,
      sum(auc * w) FILTER (WHERE form = 'o') / sum(w) FILTER (WHERE form = 'o') AS ovo_w
      FROM pairs GROUP BY fold),
    plain AS (SELECT fold, -avg(list_sum(list_transform(probs, lambda v, i: (v - (i = y + 1)::INT) ** 2))) AS brier,
      avg((len(list_filter(list_transform(probs, lambda v, i: v > probs[y + 1] OR (v = probs[y + 1] AND i > y + 1)),
        lambda b: b)) < 2)::INT) AS top FROM p GROUP BY fold)
    SELECT 1 AS experiment_id, fold, round(brier, 8) AS neg_brier_score, round(top, 8) AS top_k_accuracy,
      round(ovr, 8) AS roc_auc_ovr, round(ovr_w, 8) AS roc_auc_ovr_weighted,
      round(ovo, 8) AS roc_auc_ovo, round(ovo_w, 8) AS roc_auc_ovo_weighted
    FROM means JOIN plain USING (fold)"""
)
def metric_cls_probabilities(spark, sf_dir):
    """Metrics of the probabilities of four classes."""
    folded = random_folds(_orders(spark, sf_dir), PartitionSpec(n_splits=K))
    predictions = folded.select(
        F.lit(1).alias("experiment_id"),
        F.col(FOLD_ID).alias("fold"),
        (F.col("o_custkey") % 4).cast("double").alias("y"),
        F.expr(f"array({_four_probabilities()})").alias("probs"),
    )
    scored = M.classification_scores(predictions, PROBABILITIES)
    return scored.select(*M.KEYS, *[F.round(m, 8).alias(m) for m in PROBABILITIES])


# -- parameters, experiments, plan ---------------------------------------------------


def _sizes(spark, sf_dir) -> list[int]:
    """Part sizes: a small domain of whole numbers, as a user would list in a search."""
    return [r[0] for r in table(spark, sf_dir, "part").select("p_size").distinct().collect()]


@query(
    """WITH sizes AS (SELECT DISTINCT p_size FROM part)
    SELECT p_size, CAST(p_size + i * (CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE -0.25 END) AS DOUBLE) AS value
    FROM sizes, range(5) t(i) WHERE i <= (CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END)"""
)
def range_expand(spark, sf_dir):
    specs = {n: f"{n}:0.5:{n + 2}" if n % 2 == 0 else f"{n}:-0.25:{n - 0.75}" for n in _sizes(spark, sf_dir)}
    rows = [(n, value) for n, spec in specs.items() for value in range_list(spec)]
    return spark.createDataFrame(rows, "p_size int, value double")


@query(
    """WITH sizes AS (SELECT DISTINCT p_size FROM part)
    SELECT p_size, '{''a'': ' || a || ', ''b'': ' || (CASE WHEN b % 2 = 0 THEN CAST(b // 2 AS VARCHAR)
        ELSE CAST(b // 2 AS VARCHAR) || '.5' END) || ', ''c'': ' || c || '}' AS params
    FROM sizes, range(1, 4) t(a), range(0, 3) u(b), (VALUES (4), (9)) v(c)
    WHERE a <= 1 + p_size % 3"""
)
def grid_expand(spark, sf_dir):
    """Products of two ranges and a list, as the engine expands and renders them."""
    rows = [
        (n, str(params))
        for n in _sizes(spark, sf_dir)
        for params in grid_list({"a": f"1:1:{1 + n % 3}", "b": "0:0.5:1", "c": [4, 9]})
    ]
    return spark.createDataFrame(rows, "p_size int, params string")


PLAN_SEARCH = _search(
    scale=("none", "std", "norm"), reduction=("none", "nmf"), model=("pls", "rf"),
    nmf={"n_components": "1:1:2"}, pls={"n_components": 1}, rf={"n_estimators": [50, 100]},
)
PLAN_SQL = """
    scales(s, scale, ws) AS (VALUES (0, 'none', 1.0), (1, 'std', 1.04), (2, 'norm', 1.02)),
    reductions(r, reduction, reduction_params, wr) AS (VALUES (0, 'none', '{}', 1.0),
      (1, 'nmf', '{''n_components'': 1}', 1.4), (2, 'nmf', '{''n_components'': 2}', 1.4)),
    mods(mo, model, model_params, wm) AS (VALUES (0, 'pls', '{''n_components'': 1}', 1.0),
      (1, 'rf', '{''n_estimators'': 50}', 2.4), (2, 'rf', '{''n_estimators'': 100}', 2.4)),
    combos AS (SELECT CAST(row_number() OVER (ORDER BY s, r, mo) AS INTEGER) AS experiment_id,
      scale, '{}' AS scale_params, 'none' AS filter, '{}' AS filter_params,
      reduction, reduction_params, model, model_params, CAST(ws AS DOUBLE) * wr * wm AS cost
      FROM scales, reductions, mods)"""
PLAN_COLUMNS = """experiment_id, scale, scale_params, filter, filter_params, reduction,
    reduction_params, model, model_params"""


def _plan_experiments():
    return expand("regression", {"search": PLAN_SEARCH})


@query(
    f"""WITH {PLAN_SQL}, f AS (SELECT {random_fold_sql("o_orderkey", K)} AS fold FROM orders),
    folds AS (SELECT fold, count(*) AS n_test FROM f GROUP BY fold)
    SELECT fold, n_test, {PLAN_COLUMNS},
      scale || '->none->' || reduction || '->' || model || ' (' || experiment_id || '/27)' AS label
    FROM combos, folds"""
)
def experiments_product(spark, sf_dir):
    """Every combination on every fold of orders, with the size of its test set."""
    folded = random_folds(_orders(spark, sf_dir), PartitionSpec(n_splits=K))
    data = Dataset.build(folded, ["o_custkey"], "o_totalprice", "regression", FOLD_ID)
    return work_list(_plan_experiments(), data.fold_sizes()).drop("n_train")


VALID_SQL = f"""{PLAN_SQL},
    neg AS (SELECT 'embeddings' AS source, bool_or(list_min(embedding) < 0) AS n FROM embeddings
      UNION ALL SELECT 'lineitem', bool_or(least(l_quantity, l_extendedprice, l_discount, l_tax) < 0)
      FROM lineitem),
    valid AS (SELECT source, combos.*, CASE WHEN reduction = 'nmf' AND scale = 'std'
        THEN 'NMF skipped: standardization can create negative values'
        WHEN reduction = 'nmf' AND n THEN 'NMF skipped: input data contains negative values'
        END AS reason FROM combos, neg)"""


def _validated(spark, sf_dir):
    found = any_negative_feature(spark, sf_dir)
    return with_validity(work_list(_plan_experiments(), found).drop("label"), F.col("negative"))


@query(
    f"""WITH {VALID_SQL} SELECT source, {PLAN_COLUMNS}, reason,
    CASE WHEN reason IS NULL THEN 'runnable' ELSE 'skipped' END AS status FROM valid"""
)
def experiments_validity(spark, sf_dir):
    return _validated(spark, sf_dir).drop("negative")


@query(
    f"""WITH {VALID_SQL} SELECT source, experiment_id, round(cost, 6) AS relative_cost FROM valid"""
)
def plan_cost(spark, sf_dir):
    costed = with_cost(_validated(spark, sf_dir))
    return costed.select("source", "experiment_id", F.round("relative_cost", 6).alias("relative_cost"))


@query(
    f"""WITH {PLAN_SQL}, n AS (SELECT count(*) AS rows FROM lineitem),
    valid AS (SELECT *, NOT (reduction = 'nmf' AND (scale = 'std' OR (SELECT bool_or(
      least(l_quantity, l_extendedprice, l_discount, l_tax) < 0) FROM lineitem))) AS ok FROM combos)
    SELECT 'regression' AS task, (SELECT rows FROM n) AS data_rows, 4 AS data_features,
      {K} AS n_folds, 3 AS n_variants_scale, 1 AS n_variants_filter, 3 AS n_variants_reduction,
      3 AS n_variants_model, count(*) AS combinations_total,
      count_if(NOT ok)::BIGINT AS combinations_skipped,
      count_if(ok)::BIGINT AS combinations_runnable,
      round(sum(CASE WHEN ok THEN cost ELSE 0 END), 6) AS relative_cost,
      CAST(count_if(ok) * {K} AS BIGINT) AS fold_evaluations FROM valid"""
)
def plan_counts(spark, sf_dir):
    config = {
        "input": {"target": "charge", "features": FEATURES, "row_key": LINE_KEY},
        "partition": {"n_splits": K},
        "search": PLAN_SEARCH,
        "output": {},
    }
    data = table(spark, sf_dir, "lineitem").withColumn("charge", F.expr(CHARGE))
    found = plan(spark, config, "regression", data)
    return found.withColumn("relative_cost", F.round("relative_cost", 6))


@query(
    """SELECT o_orderkey, lower(CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'Skipped'
        ELSE 'other' END) AS status,
      CASE WHEN o_orderkey % 3 = 0 THEN 'given' WHEN o_orderstatus = 'O' THEN 'incompatible_combo'
        WHEN o_orderstatus = 'F' THEN 'model_execution' ELSE 'internal' END AS error_type
    FROM orders"""
)
def failed_normalised(spark, sf_dir):
    status = (
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "O", "Skipped")
        .otherwise("other")
    )
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        status.alias("status"),
        F.when(F.col("o_orderkey") % 3 == 0, "given").alias("error_type"),
    )
    return report.normalise_failed(rows).withColumn("status", F.lower("status"))


# -- whole runs ----------------------------------------------------------------------


@query(
    f"""WITH f AS (SELECT *, {random_fold_sql("o_orderkey", K)} AS fold_id FROM orders)
    SELECT o_orderkey AS row_id, o_totalprice, fold_id FROM f"""
)
def prepare_roundtrip(spark, sf_dir):
    """Artifacts written by prepare and read back, folds matched by row id."""
    config = {
        "input": {"path": f"{sf_dir}/orders.parquet", "row_key": "o_orderkey"},
        "dataset": {"task": "regression", "target": "o_totalprice"},
        "partition": {"n_splits": K},
        "output": {"dir": scratch_path(spark)},
    }
    prepared = prepare(spark, config)
    data = read_table(spark, prepared.paths["data"]).drop(FOLD_ID)
    folds = read_folds(spark, prepared.paths["folds"], prepared.metadata["rows"])
    joined = align_folds(data, folds)
    return joined.select(F.col(ROW_ID).alias("row_id"), "o_totalprice", F.col("fold").alias(FOLD_ID))


@query(
    f"""WITH {pls1_sql()}, {PLS_COMBOS}
    SELECT experiment_id, m AS fold, round(r2, 6) AS r2 FROM combos JOIN scores USING (variant)"""
)
def result_sinks(spark, sf_dir):
    """The detailed table read back from a fan-out of sinks."""
    folder = scratch_path(spark)
    results = _pls_results(spark, sf_dir)
    paths = FanOutSink((ParquetSink(folder), ReportSink(folder))).write(results)
    return spark.read.parquet(paths[0]).select(
        "experiment_id", "fold", F.round("r2", 6).alias("r2")
    )


@query(
    f"""WITH {pls1_sql()}, {PLS_COMBOS}
    SELECT experiment_id, round(avg(r2), 6) AS r2 FROM combos JOIN scores USING (variant)
    GROUP BY 1"""
)
def benchmark_api(spark, sf_dir):
    """The public entry point on lineitem, rows identified by key columns."""
    config = {
        "input": {"target": "charge", "features": FEATURES, "row_key": LINE_KEY},
        "partition": {"n_splits": K},
        "evaluation": {"primary_metric": "r2", "metrics": ["r2"]},
        "search": PLS_SEARCH,
        "output": {},
    }
    data = table(spark, sf_dir, "lineitem").withColumn("charge", F.expr(CHARGE))
    found = benchmark(spark, config, "regression", data)
    return found.ranking.select("experiment_id", F.round("r2", 6).alias("r2"))


def _compare(spark, data: Dataset, task: str, search, metrics, parallelism=4):
    experiments = expand(task, {"search": search})
    results = run_experiments(spark, data, task, experiments, metrics, metrics[0], parallelism)
    return results


# -- tree models, checked as stumps --------------------------------------------------

SIZE = "CASE WHEN l_quantity > 6 * l_linenumber THEN 'many' WHEN l_quantity > 12 THEN 'some' ELSE 'few' END"
STUMP = {"n_estimators": 1, "max_depth": 1}
STUMP_MODELS = """models_of(experiment_id) AS (SELECT CAST(range AS INTEGER) FROM range(1, {n} + 1))"""


def _stump_data(spark, sf_dir, target: str, task: str) -> Dataset:
    """One feature of seven values, so that a stump has six candidate cuts."""
    lineitem = table(spark, sf_dir, "lineitem")
    folded = random_folds(lineitem, PartitionSpec(n_splits=K), LINE_KEY).withColumn("y", F.expr(target))
    return Dataset.build(folded, ["l_linenumber"], "y", task, FOLD_ID)


@query(
    f"""WITH {lineitem_sql(MIXED).replace("SELECT", "SELECT l_linenumber AS x,", 1)}, {models_sql()},
    {STUMP_MODELS.format(n=3)},
    sums AS (SELECT m, x, count(*) AS n, sum(y) AS s FROM models JOIN base ON fold <> m GROUP BY m, x),
    halves AS (SELECT m, x AS cut, sum(n) OVER w AS nl, sum(s) OVER w AS sl,
        sum(n) OVER (PARTITION BY m) AS n, sum(s) OVER (PARTITION BY m) AS s
      FROM sums WINDOW w AS (PARTITION BY m ORDER BY x)),
    best AS (SELECT m, arg_max({{'cut': cut, 'low': sl / nl, 'high': (s - sl) / (n - nl)}},
        sl * sl / nl + (s - sl) * (s - sl) / (n - nl)) AS b FROM halves WHERE nl < n GROUP BY m),
    p AS (SELECT m, y, CASE WHEN x <= b.cut THEN b.low ELSE b.high END AS p FROM base JOIN best ON fold = m)
    SELECT experiment_id, m AS fold, round(-sqrt(avg((y - p) ** 2)), 4) AS neg_root_mean_squared_error,
      round(1 - avg((y - p) ** 2) / var_pop(y), 6) AS r2 FROM p, models_of GROUP BY ALL"""
)
def stump_regressors(spark, sf_dir):
    """Forest, bagging and boosting of one stump each have one answer: the best cut."""
    whole = {**STUMP, "bootstrap": False, "max_features": None}
    search = _search(
        model=("rf", "bag", "gbr"), rf=whole, bag={**STUMP, "bootstrap": False},
        gbr={**STUMP, "learning_rate": 1.0},
    )
    data = _stump_data(spark, sf_dir, MIXED, "regression")
    detailed = _compare(spark, data, "regression", search, METRICS).detailed
    return detailed.select(
        "experiment_id", "fold", F.round(METRICS[0], 4).alias(METRICS[0]), F.round("r2", 6).alias("r2")
    )


@query(
    f"""WITH {lineitem_sql(SIZE).replace("SELECT", "SELECT l_linenumber AS x,", 1)}, {models_sql()},
    {STUMP_MODELS.format(n=2)},
    labels AS (SELECT DISTINCT y FROM base), places AS (SELECT DISTINCT x FROM base),
    counts AS (SELECT m, x, y, count(*) AS n FROM models JOIN base ON fold <> m GROUP BY ALL),
    full_counts AS (SELECT models.m, places.x, labels.y, coalesce(n, 0) AS n
      FROM models CROSS JOIN places CROSS JOIN labels LEFT JOIN counts USING (m, x, y)),
    halves AS (SELECT m, x AS cut, y, sum(n) OVER (PARTITION BY m, y ORDER BY x) AS nl,
        sum(n) OVER (PARTITION BY m, y) AS n FROM full_counts),
    cuts AS (SELECT m, cut, arg_max(y, nl) AS low, arg_max(y, n - nl) AS high,
        sum(nl * nl) / sum(nl) + sum((n - nl) * (n - nl)) / nullif(sum(n - nl), 0) AS purity
      FROM halves GROUP BY m, cut),
    best AS (SELECT m, arg_max({{'cut': cut, 'low': low, 'high': high}}, purity) AS b
      FROM cuts WHERE purity IS NOT NULL GROUP BY m)
    SELECT experiment_id, m AS fold, round(avg((y = CASE WHEN x <= b.cut THEN b.low ELSE b.high END)::INT), 8)
      AS accuracy FROM base JOIN best ON fold = m, models_of GROUP BY ALL"""
)
def stump_classifiers(spark, sf_dir):
    """Forest and bagging of one stump: the cut of least Gini impurity."""
    whole = {**STUMP, "bootstrap": False, "max_features": None}
    search = _search(model=("rfc", "bagc"), rfc=whole, bagc={**STUMP, "bootstrap": False})
    data = _stump_data(spark, sf_dir, SIZE, "classification")
    detailed = _compare(spark, data, "classification", search, ["accuracy"]).detailed
    return detailed.select("experiment_id", "fold", F.round("accuracy", 8).alias("accuracy"))


@query()
def regression_models(spark, sf_dir):
    """Every regression model on standardised lineitem features."""
    search = _search(
        scale=("std",), model=("pls", "sgd", "svm", "bag", "gbr", "rf", "mlp"),
        svm={"C": 1000.0},
    )
    return _compare(spark, lineitem_dataset(spark, sf_dir), "regression", search, METRICS).detailed


@query()
def classification_models(spark, sf_dir):
    """Every classification model on embeddings, for a two-class target."""
    search = _search(
        scale=("std",), model=("logreg", "svc", "rfc", "bagc"),
        logreg={"max_iter": 30}, svc={"kernel": "linear", "max_iter": 10},
        rfc={"n_estimators": 5, "max_depth": 5}, bagc={"n_estimators": 3, "max_depth": 5},
    )
    data = _embedding_dataset(spark, sf_dir, "label % 2")
    metrics = ["f1_macro", "accuracy", "roc_auc"]
    return _compare(spark, data, "classification", search, metrics).detailed


@query()
def reduction_steps(spark, sf_dir):
    """Selection and reduction steps in front of a linear model, and a skipped NMF."""
    search = _search(
        scale=("none", "std"), filters=("none", "mi"), reduction=("none", "pca", "ica", "nmf"),
        mi={"percentile": 50}, pca={"n_components": 0.9}, ica={"n_components": 2},
        nmf={"n_components": 2, "max_iter": 10}, pls={"n_components": 1},
    )
    return _compare(spark, lineitem_dataset(spark, sf_dir), "regression", search, METRICS).detailed
