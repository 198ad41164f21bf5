import numpy as np
import pytest

from foldyard.operators import order_stats
from foldyard.operators.order_stats import rank_thresholds
from foldyard.operators.rowid import ingest_row_ids, rank_rows


@pytest.fixture(autouse=True)
def narrow(monkeypatch):
    """Small limits, so that several rounds of narrowing happen on small data."""
    monkeypatch.setattr(order_stats, "FETCH_ROWS", 5)
    monkeypatch.setattr(order_stats, "BUCKETS", 16)


def test_plain_ranks_with_heavy_ties(spark):
    rng = np.random.default_rng(0)
    values = np.where(rng.random(900) < 0.4, 7, rng.integers(-1000, 1000, 900))
    rows = sorted(zip(values.tolist(), range(900)))
    frame = spark.createDataFrame(rows, "v long, id long").repartition(5)
    ranks = [0, 1, 250, 449, 500, 899]
    found = rank_thresholds(frame, ["v", "id"], {(): ranks})[()]
    assert {r: v for r, (v, _) in found.items()} == {r: rows[r][0] for r in ranks}
    # the second column is given where the first does not tell the row from the next
    tied = {r for r in ranks if found[r][1] is not None}
    assert tied == {r for r in ranks if any(rows[r][0] == rows[i][0] for i in (r - 1, r + 1) if 0 <= i < 900)}
    assert {r: found[r] for r in tied} == {r: rows[r] for r in tied}


def test_doubles_by_stratum_with_null_stratum(spark):
    rng = np.random.default_rng(1)
    rows = [(s, float(v)) for s in ("a", "b", None) for v in rng.lognormal(sigma=4, size=200)]
    frame = spark.createDataFrame(rows, "s string, v double").repartition(4)
    wanted = {(s,): [0, 57, 100, 199] for s in ("a", "b", None)}
    found = rank_thresholds(frame, ["v"], wanted, ["s"])
    for (s,), at in found.items():
        ordered = sorted(v for t, v in rows if t == s)
        assert at == {r: (ordered[r],) for r in wanted[(s,)]}


def test_leaving_one_part_out(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 4, float(np.round(v, 2))) for i, v in enumerate(rng.normal(size=600))]
    frame = spark.createDataFrame(rows, "fold int, v double").repartition(3)
    wanted = {(m,): [0, 100, 224, 449] for m in range(4)}
    found = rank_thresholds(frame, ["v"], wanted, leave_out="fold")
    for m in range(4):
        ordered = sorted(v for f, v in rows if f != m)
        assert found[(m,)] == {r: (ordered[r],) for r in wanted[(m,)]}


def test_rank_rows_is_dense_and_ordered(spark):
    rng = np.random.default_rng(3)
    rows = [(int(a), float(b)) for a, b in zip(rng.integers(0, 3, 500), rng.random(500))]
    frame = spark.createDataFrame(rows, "a int, b double").repartition(7)
    ranked = rank_rows(frame, ["a", "b"]).orderBy("_row_id").collect()
    assert [r["_row_id"] for r in ranked] == list(range(500))
    assert [(r["a"], r["b"]) for r in ranked] == sorted(rows)


def test_ingest_ids_follow_file_order(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    expected = []
    for part, size in enumerate([300, 5, 120]):
        lines = [f"{part},{i}" for i in range(size)]
        (folder / f"part-{part}.csv").write_text("p,i\n" + "\n".join(lines) + "\n")
        expected += [(part, i) for i in range(size)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        frame = spark.read.csv(str(folder), header=True, inferSchema=True)
        rows = ingest_row_ids(frame).orderBy("_row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["_row_id"] for r in rows] == list(range(len(expected)))
    assert [(r["p"], r["i"]) for r in rows] == expected


def test_ingest_ids_of_parquet_use_file_positions(spark, tmp_path):
    expected = []
    for part, size in enumerate([40, 1, 25]):
        frame = spark.createDataFrame([(part, i) for i in range(size)], "p int, i int")
        frame.coalesce(1).write.parquet(str(tmp_path / "t.parquet" / f"part={part}"))
        expected += [(part, i) for i in range(size)]
    frame = spark.read.parquet(str(tmp_path / "t.parquet"))
    rows = ingest_row_ids(frame).orderBy("_row_id").collect()
    assert [r["_row_id"] for r in rows] == list(range(66))
    assert [(r["p"], r["i"]) for r in rows] == expected
    kept = ingest_row_ids(frame).where("i >= 20").select("_row_id").collect()
    assert len(kept) == 25


def test_thresholds_of_an_even_hash_in_one_pass(spark, monkeypatch):
    rng = np.random.default_rng(3)
    top = 16**15 - 1
    for n in (1, 3, 50, 5000):
        values = sorted(rng.integers(0, top, n, endpoint=True).tolist())
        frame = spark.createDataFrame([(v, 0) for v in values], "h long, i long").repartition(3)
        ranks = sorted({0, n // 5, n // 2, n - 1})
        found = order_stats.uniform_thresholds(frame, ["h", "i"], ranks, n, (0, top))
        assert found == {r: (values[r], None) for r in ranks}
    crowded = spark.createDataFrame([(v // 10**15, 0) for v in values], "h long, i long")
    assert order_stats.uniform_thresholds(crowded, ["h", "i"], ranks, n, (0, top)) is None
    equal = spark.createDataFrame([(top // 2, 0)] * 9, "h long, i long")
    assert order_stats.uniform_thresholds(equal, ["h", "i"], [4], 9, (0, top)) is None
    monkeypatch.setattr(order_stats, "HISTOGRAM_ROWS", 3)
    assert order_stats.uniform_thresholds(frame, ["h", "i"], ranks, n, (0, top)) is None
