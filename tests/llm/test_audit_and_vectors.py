import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cases import prose, words
from foldyard.llm.filter_diagrams import AuditRules, Diagram, audit_filters, audit_masks, audit_part, failed_bits, plain_changes
from foldyard.llm.prefix_forest import SYMBOL, ForestParams, enough, hash_strings, lifted, prefix_slices, rotations, search_rows
from foldyard.llm.zone_clusters import ClusterParams, candidates, cluster_vectors, hilbert_keys, nearest

# -- filter audit -------------------------------------------------------------------


@pytest.mark.parametrize("n", range(1, 6))
def test_plain_changes_reach_every_order_once(n):
    order = list(range(n))
    seen = [tuple(order)]
    for i in plain_changes(n):
        order[i], order[i + 1] = order[i + 1], order[i]
        seen.append(tuple(order))
    assert len(seen) == len(set(seen)) == math.factorial(n)


def replay(masks, filters):
    """Apply each order to each mask, one document group at a time."""
    rows, total = {}, Counter()
    for order in itertools.permutations(range(len(filters))):
        left = dict(masks)
        for step, f in enumerate(order, 1):
            gone = {m: w for m, w in left.items() if m >> f & 1}
            left = {m: w for m, w in left.items() if not m >> f & 1}
            removed = sum(w[0] for w in gone.values())
            total[f] += removed
            rows["".join(filters[i] for i in order), step] = [
                f, sum(w[0] for w in left.values()), removed,
                sum(w[0] for m, w in masks.items() if m >> f & 1) - removed,
                masks.get(1 << f, (0,))[0], sum(w[1] for w in gone.values()), sum(w[2] for w in gone.values()),
            ]
    return {k: (*v[1:], total[v[0]]) for k, v in rows.items()}


@pytest.mark.parametrize("k", (1, 2, 3, 5))
def test_all_pass_paths_equal_a_replay(k):
    rng = random.Random(k)
    for share in (0.0, 0.3, 1.0):
        masks = {}
        for mask in range(1 << k):
            if rng.random() < share:
                n = rng.randint(1, 9)
                masks[mask] = (n, rng.randint(0, n), rng.randint(0, n))
        got = audit_part(masks, "ABCDE"[:k])
        assert {r[:2]: r[2:] for r in got} == replay(masks, "ABCDE"[:k]) and len(got) == k * math.factorial(k)


def test_swaps_share_equal_nodes_and_keep_the_counts():
    masks = {m: (1, 0, 0) for m in range(32)}
    diagram = Diagram(masks, 5, 3)
    assert [len(level) for level in diagram.levels] == [1] * 5  # all sub-diagrams are equal
    for i in (0, 3, 1, 2, 3, 0):
        diagram.swap(i)
        assert [len(level) for level in diagram.levels] == [1] * 5
        assert diagram.weights[diagram.root] == (32, 0, 0)


def test_bits_follow_the_rules():
    rules = AuditRules()
    assert failed_bits(b"", rules) == 1
    assert failed_bits(" ".join(f"w{i}" for i in range(100)).encode(), rules) == 0
    assert failed_bits(b"same " * 100, rules) == 2
    assert failed_bits("ABécdefghi".encode(), rules) == 5  # 2 of 10 code points
    assert failed_bits("Aééééééééé".encode(), rules) == 1  # exactly a tenth
    assert failed_bits("a b | c".encode(), rules) == 9
    assert failed_bits(("x%d " * 99 % tuple(range(99)) + "\x0by").encode(), rules) == 0


def brute_audit(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    parts = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for i, text, lang in docs:
        text = text or ""
        ws = words(text)
        mask = (
            (len(ws) < 100)
            | (100 * len(set(ws)) < 80 * len(ws)) << 1
            | (100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)) << 2
            | any(c in "#$%&*|" for c in text) << 3
            | (i is not None and i > least[text]) << 4
        )
        weight = parts[lang or ""][mask]
        weight[0] += 1
        weight[1] += i is not None and i in good
        weight[2] += i is not None and i in toxic
    return {(p, *key): row for p, masks in parts.items() for key, row in replay({m: tuple(w) for m, w in masks.items()}, "ABCDE").items()}


DOC_SCHEMA = "doc_id long, text string, lang string, mask int, key string, part string, `x.y` int, n long"


def audit_docs():
    long = " ".join(prose(9, 120))
    loud = " ".join(w.upper() for w in prose(10, 130))
    texts = [long, long + " #", loud, "a " * 200, "", None, " \t", "short", " ".join(prose(4, 30_000)), "café \U0001f600 |"]
    rng = random.Random(1)
    rows = [(i, texts[rng.randrange(len(texts))], rng.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(3, long, "en"), (3, long, "en"), (None, long, "de"), (None, "only here", "fr"), (None, "only here", "fr")]
    return rows


def test_audit_equals_a_replay_over_all_rows(spark):
    docs = audit_docs()
    labels = [(0, 1, 0), (1, 0, 1), (1, 1, None), (2, None, 1), (None, 1, 1), (3, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 7, "k", "p", 1, 2) for d in docs], DOC_SCHEMA).repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = audit_filters(frame, marks).collect()
    assert {tuple(r[:3]): tuple(r[3:]) for r in got} == brute_audit(docs, labels)
    assert len(got) == 600 * 4
    assert got[0].__fields__ == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    ]


def test_audit_of_nothing_and_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], DOC_SCHEMA)
    assert audit_filters(none, labels).collect() == []
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    rows = audit_filters(one, labels).collect()
    assert {r["part"] for r in rows} == {""} and len(rows) == 600
    assert {r["shapley"] for r in rows if r["filter_order"][r["step"] - 1] == "A"} == {120}


def test_masks_of_other_filters(spark):
    masks = spark.createDataFrame([("p", 1, 3, 1, 0), ("p", 3, 2, 0, 2)], "part string, mask int, docs long, good long, toxic long")
    rows = {(r["filter_order"], r["step"]): r for r in audit_masks(masks, "XY").collect()}
    assert len(rows) == 4
    assert rows["YX", 1]["removed"] == 2 and rows["YX", 2]["removed"] == 3 and rows["XY", 2]["redundant"] == 2


# -- clusters -----------------------------------------------------------------------


@pytest.mark.parametrize("dims, bits", ((2, 1), (2, 3), (3, 2), (4, 2)))
def test_hilbert_curve_visits_each_cell_by_unit_steps(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)), np.uint64)
    keys = hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    path = cells[np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(2)
    pruned = 0
    for _ in range(200):
        centroids = rng.integers(-50, 50, (6, 5))
        centroids[3] = centroids[1]  # a tie everywhere
        x = rng.integers(-60, 60, 5) + rng.integers(0, 12, (9, 5))
        among = candidates(x.min(0), x.max(0), centroids)
        every = np.arange(6)
        assert (nearest(x, centroids, among)[0] == nearest(x, centroids, every)[0]).all()
        assert 3 not in among
        pruned += 6 - len(among)
    assert pruned > 600


def brute_clusters(rows, params):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == params.n_components and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(params.scale * x) for x in v]))
    rank = lambda r: (r[0] is None, hashlib.sha256(f"{params.salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=rank)[: params.n_clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(params.rounds):
        own = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, o) in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    own = assign()
    inertia = Counter()
    for d, j in own:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(
        ((i, j, d, inertia[j], sum(inertia.values()), sha[j]) for (i, _), (d, j) in zip(kept, own)), key=repr
    )


def clustered_rows(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    rows = [(i, [float(x) for x in np.float32(centres[i % 5] + rng.normal(size=d) * (0.05 if i % 3 else 0.4))]) for i in range(n)]
    return rows + [(n + i, rows[0][1]) for i in range(n // 3)]  # a third are equal


VECTOR_SCHEMA = "vec_id long, embedding array<float>, place int, v string, ids int, `x.y` int, cluster int"


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, 3, 4) for i, v in rows], VECTOR_SCHEMA).repartition(4)


ODD_VECTORS = [
    (900, None), (901, []), (902, [1.0] * 5), (903, [float("nan")] + [0.0] * 5), (904, [float("inf")] * 6),
    (905, [None, *[1.0] * 5]), (906, [0.0] * 6), (907, [-0.0] * 6), (None, [0.5] * 6), (None, None), (908, [0.25] * 6), (908, [0.25] * 6),
]


def as_tuples(frame, columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


CLUSTER_COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


@pytest.mark.parametrize("block_rows", (1, 7, 128))
def test_clusters_equal_plain_rounds(spark, block_rows):
    params = ClusterParams(n_components=6, n_clusters=4, rounds=5, block_rows=block_rows, curve_dims=3, curve_bits=4)
    rows = clustered_rows(90, 6, 3) + ODD_VECTORS
    found = cluster_vectors(vector_frame(spark, rows), params=params)
    assert found.rows.columns == CLUSTER_COLUMNS
    assert as_tuples(found.rows, CLUSTER_COLUMNS) == brute_clusters(rows, params)


def test_clusters_of_few_vectors_and_none(spark):
    params = ClusterParams(n_components=6, n_clusters=4, rounds=2)
    for rows in ([(1, [0.5] * 6)], [(1, [0.5] * 6), (1, [0.5] * 6), (None, [0.1] * 6)]):
        assert as_tuples(cluster_vectors(vector_frame(spark, rows), params=params).rows, CLUSTER_COLUMNS) == brute_clusters(rows, params)
    for rows in ([], ODD_VECTORS[:6]):
        found = cluster_vectors(vector_frame(spark, rows), params=params)
        assert found.rows.collect() == [] and found.rows.columns == CLUSTER_COLUMNS


def test_components_too_large_for_whole_distances_are_left_out(spark):
    rows = [(1, [1e30] * 6), (2, [0.5] * 6), (3, [131071.0] * 6)]
    found = cluster_vectors(vector_frame(spark, rows), params=ClusterParams(n_components=6, n_clusters=1, rounds=1))
    assert sorted(r["vec_id"] for r in found.rows.collect()) == [2, 3]


def test_tight_clusters_leave_most_blocks_one_candidate(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(4, 64)) * 3
    rows = [(i, [float(x) for x in centres[i % 4] + rng.normal(size=64) * 0.05]) for i in range(800)]
    params = ClusterParams(n_clusters=4, block_rows=20, curve_dims=6)
    found = cluster_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), params=params)
    boxes = [(np.frombuffer(r["low"], np.int64), np.frombuffer(r["high"], np.int64)) for r in found.blocks.collect()]
    alone = sum(len(candidates(low, high, found.centroids)) == 1 for low, high in boxes)
    assert alone >= 0.5 * len(boxes)


# -- nearest neighbours ---------------------------------------------------------------


def brute_neighbours(rows, every, top, d):
    single = {}
    for i, v in rows:
        ok = i is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)
        if ok and any(v):
            v = tuple(float(np.float32(x)) for x in v)
            single[i] = min(single.get(i, v), v)
    out = {}
    for q in single:
        if q % every == 0:
            scores = [(-math.fsum(a * b for a, b in zip(single[q], v)), i) for i, v in single.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:top]]
    return out


def searched(frame, **kwargs):
    got = defaultdict(list)
    for r in sorted(search_rows(frame, **kwargs).collect(), key=lambda r: (r["query_id"], r["rank"])):
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def recall(got, wanted):
    assert set(got) == {q for q, found in wanted.items() if found}
    assert all(len(got[q]) == len(wanted[q]) for q in got)
    same = sum(len({i for i, _ in got[q]} & {i for i, _ in found}) for q, found in wanted.items())
    return same / sum(map(len, wanted.values()))


def test_prefix_slices_equal_a_scan():
    rng = np.random.default_rng(5)
    strings = rng.integers(0, 4, (300, 4)).astype(SYMBOL)
    ordered = np.array(sorted(strings.tolist())).astype(SYMBOL)
    asked, depth = strings[:80], rng.integers(0, 5, 80)
    start, end = prefix_slices(ordered, asked, depth)
    for q, k, a, b in zip(asked, depth, start, end):
        hit = (ordered[:, :k] == q[:k]).all(1)
        assert hit.sum() == b - a and hit[a:b].all()


def test_equal_directions_have_equal_strings_and_near_ones_long_prefixes():
    params = ForestParams(n_components=16, trees=8)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 16))
    turned = rotations(params)
    far = hash_strings(lifted(x, None), turned).reshape(200, 8, 5)
    near = hash_strings(lifted(3 * x + rng.normal(size=x.shape) * 0.02, None), turned).reshape(200, 8, 5)
    assert (hash_strings(lifted(2 * x, None), turned).reshape(200, 8, 5) == far).mean() > 0.999
    length = lambda a, b: np.cumprod(a == b, axis=2).sum(2).mean()
    assert length(far, near) > 3 > 0.5 > length(far, np.roll(far, 1, axis=0))


def test_enough_candidates_reach_the_target():
    reach = np.array([[100, 10], [80, 20], [60, 5]])
    share = np.array([[0.9, 0.2], [1.0, 0.95], [0.8, 0.1]])
    assert enough(reach, share, 0.0, 3) == 3
    assert enough(reach, share, 0.55, 3) == 6  # the third query ascends to depth 1 first
    assert enough(reach, share, 0.9, 3) == 21
    assert enough(reach, share, 1.0, 3) == 101  # all at the root but for the exact one


@pytest.mark.parametrize("pieces", (25, 8192))
def test_search_equals_brute_force_where_the_target_is_all(spark, pieces):
    rows = clustered_rows(120, 6, 8) + ODD_VECTORS + [(0, [9.0] * 6), (20, [0.1] * 6)]
    wanted = brute_neighbours(rows, 4, 7, 6)
    params = ForestParams(n_components=6, trees=4, symbols=3, piece_rows=pieces, target=1.0, sample_queries=200, block_scores=50)
    got = searched(vector_frame(spark, rows), every=4, top=7, params=params)
    assert recall(got, wanted) == 1.0
    for q, found in wanted.items():
        assert [i for i, _ in got[q]] == [i for i, _ in found]
        assert np.allclose([s for _, s in got[q]], [s for _, s in found], rtol=0, atol=1e-12)


def test_forest_finds_clustered_neighbours_below_the_root(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 32))
    rows = [(i, [float(x) for x in np.float32(centres[i % 40] * (1 + i % 3) + rng.normal(size=32) * 0.3)]) for i in range(2000)]
    params = ForestParams(n_components=32, trees=16, piece_rows=500, sample_queries=40)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(searched(frame, every=10, top=10, params=params), brute_neighbours(rows, 10, 10, 32)) >= 0.9


def test_search_of_few_rows_and_none(spark):
    params = ForestParams(n_components=6, trees=4)
    assert searched(vector_frame(spark, []), params=params) == {}
    assert searched(vector_frame(spark, ODD_VECTORS[:8]), every=1, params=params) == {}
    two = [(0, [1.0] * 6), (7, [-0.5] * 6), (None, [1.0] * 6)]
    assert searched(vector_frame(spark, two), params=params) == {0: [(7, -3.0)]}
