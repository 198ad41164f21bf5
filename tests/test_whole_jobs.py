"""Registered queries run the library's whole job."""

import numpy as np
import pytest

from foldyard import queries as q
from foldyard.errors import ConfigDataError
from foldyard.operators import folds as FO


def test_regression_models_cuts_no_model_short(monkeypatch):
    """Trees, rounds, depths, passes, features and layers are those of the library."""
    seen = {}
    monkeypatch.setattr(q, "lineitem_dataset", lambda *a: None)

    def compare(spark, data, task, search, metrics):
        seen.update(search)
        return type("Results", (), {"detailed": None})

    monkeypatch.setattr(q, "_compare", compare)
    q.regression_models(None, "")
    assert seen["model"]["enabled"] == ["pls", "sgd", "svm", "bag", "gbr", "rf", "mlp"]
    assert seen["model"]["params"] == {"svm": {"C": 1000.0}}  # the weight of the loss, not the work


def _by_deviation(counts, totals, k):
    """Each trial of a group on a fold written out: mean over classes of the standard
    deviation of shares; the lighter fold where two are close."""
    state, found = np.zeros((k, len(totals))), []
    for v in counts:
        best = None
        for f in range(k):
            state[f] += v
            cost, weight = np.std(state / totals, axis=0).mean(), state[f].sum()
            state[f] -= v
            if best is None or (weight < best[1] if np.isclose(cost, best[0]) else cost < best[0]):
                best = (cost, weight, f)
        state[best[2]] += v
        found.append(best[2])
    return found


@pytest.mark.parametrize("batch", [7, 10_000])
def test_users_are_placed_one_by_one_by_the_deviation_of_class_shares(spark, tmp_path, batch):
    """Not by the sum of squared shares, which places users of equal counts at once."""
    rng = np.random.default_rng(5)
    kinds = ["view", "click", "cart", "buy"]
    rows = [
        (None if u == 11 else u, kinds[min(int(k), 3)])
        for u in range(90) for k in rng.geometric(0.3 + 0.4 * (u % 3) / 2, 1 + u % 9) - 1
    ]
    spark.createDataFrame(rows, "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r["user_id"]: r["fold_id"] for r in q.folds_stratified_group(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = sorted({y for _, y in rows})
    table = {g: np.array([sum(r == (g, y) for r in rows) for y in names]) for g, _ in rows}
    shown = [(g,) for g in table]
    hashed = spark.createDataFrame(shown, "g long").withColumn("h", FO.hash_key(42, FO.F.col("g"))).collect()
    hashes = {r["g"]: r["h"] for r in hashed}
    order = sorted(table, key=lambda g: (table[g].sum() ** 2 - len(names) * (table[g] ** 2).sum(), hashes[g]))
    wanted = _by_deviation([table[g] for g in order], sum(table.values()), q.K)
    assert got == dict(zip(order, wanted))


def test_deviations_of_many_classes_and_large_groups():
    rng = np.random.default_rng(1)
    counts = [np.where(rng.random(40) < 0.1, rng.integers(1, 10 ** int(e), 40), 0) for e in rng.integers(1, 9, 300)]
    counts = [v for v in counts if v.any()]
    totals = sum(counts)
    kept = totals > 0
    groups = [([int(c) for c in np.flatnonzero(v[kept])], [int(n) for n in v[kept] if n], int(v.sum())) for v in counts]
    got = list(FO.place_by_deviation(iter(groups), [int(n) for n in totals[kept]], 7))
    assert got == _by_deviation([v[kept] for v in counts], totals[kept], 7)


def test_the_spread_of_groups_is_named():
    assert FO.PartitionSpec.from_config({"mode": "group", "spread": "deviation"}).spread == "deviation"
    with pytest.raises(ConfigDataError, match="spread"):
        FO.PartitionSpec.from_config({"spread": "other"})
