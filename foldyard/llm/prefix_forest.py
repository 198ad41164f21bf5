"""Nearest neighbours by inner product with a forest of hash prefixes.

A vector's hash in a tree is a string of symbols; each symbol names the axis (and its
sign) that lies closest to the vector after a random rotation of its own. A tree is the
sorted array of its strings, kept as range partitions split into pieces of bounded size.
A query descends to the longest prefix it shares with some vector and ascends in all trees
at once, symbol by symbol, until enough vectors share its prefix; all of those are compared
with it in double precision, piece by piece, and only the best leave a piece.

How many are enough is measured, not assumed: for a bounded sample of the queries the true
neighbours are found by comparing with every vector, and the smallest number is taken at
which the forest finds the wanted share of them. A query that has fewer at one symbol
ascends to the root, which is a comparison with all vectors.

Vectors of unequal length are lifted to one length first by an extra component that
queries have as zero, so that the largest product is the smallest angle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .hashing import ship, shipped

SYMBOL = np.dtype(">u2")  # big-endian, so that bytes compare as symbols do


@dataclass(frozen=True)
class ForestParams:
    """n_components: vectors of another length take no part. trees: hash strings a vector
    has. symbols: length of a string. piece_rows: vectors or queries of a tree that are
    compared in one task at most. sample_queries: queries whose true neighbours set the
    number of candidates. target: share of true neighbours to find in that sample.
    block_scores: scores held at a time."""

    n_components: int = 64
    trees: int = 48
    symbols: int = 5
    piece_rows: int = 8192
    sample_queries: int = 64
    target: float = 0.95
    seed: int = 13
    block_scores: int = 2_000_000


# -- hash strings -----------------------------------------------------------------------


def rotations(params: ForestParams) -> np.ndarray:
    """(trees * symbols, d + 1, d + 1) random rotations, float32."""
    d = params.n_components + 1
    rng = np.random.default_rng(params.seed)
    return np.linalg.qr(rng.standard_normal((params.trees * params.symbols, d, d)))[0].astype(np.float32)


def lifted(x: np.ndarray, longest: float | None) -> np.ndarray:
    """Unit directions with the extra component; None: zero there, as for queries."""
    norms = np.linalg.norm(x, axis=1)
    extra = np.zeros(len(x)) if longest is None else np.sqrt(np.maximum(longest**2 - norms**2, 0))
    wide = np.concatenate([x, extra[:, None]], 1)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def hash_strings(directions: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """(rows, trees * symbols) symbols: twice the closest axis, one more if it is negative."""
    out = np.empty((len(directions), len(turned)), SYMBOL)
    for start in range(0, len(directions), 2048):
        block = directions[start : start + 2048]
        for s, rotation in enumerate(turned):
            at = block @ rotation
            axis = np.abs(at).argmax(1)
            out[start : start + 2048, s] = 2 * axis + (at[np.arange(len(at)), axis] < 0)
    return out


def prefix_slices(ordered: np.ndarray, strings: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the rows of a sorted (n, symbols) array that share with each string
    its first ``depth`` symbols."""
    text = f"S{strings.shape[1] * SYMBOL.itemsize}"
    rest = np.arange(strings.shape[1])[None, :] >= depth[:, None]

    def places(filler: int, side: str) -> np.ndarray:
        ends = np.ascontiguousarray(np.where(rest, SYMBOL.type(filler), strings).astype(SYMBOL))
        array = np.ascontiguousarray(ordered).view(text).ravel()
        return np.searchsorted(array, ends.view(text).ravel(), side)

    return places(0, "left"), places(0xFFFF, "right")


def enough(reach: np.ndarray, recall: np.ndarray, target: float, least: int) -> int:
    """The smallest number of candidates at which the mean recall is the target.

    reach: candidates of each sampled query at depths 1, 2, ...; recall: share of its true
    neighbours there. Below the number at depth 1 a query goes to the root, recall 1.
    """
    for number in sorted({least, *(int(n) + 1 for n in reach.ravel() if n >= least)}):
        depth = (reach >= number).sum(1)  # reach falls with depth
        found = np.where(depth > 0, recall[np.arange(len(recall)), np.maximum(depth, 1) - 1], 1.0)
        if not len(found) or found.mean() >= target:
            return number
    return least


# -- tables -----------------------------------------------------------------------------


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, params: ForestParams) -> DataFrame:
    """vec_id, key, vector (packed doubles): one row an id; key is equal for equal vectors."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < math.inf))
    usable = (F.size(v) == params.n_components) & finite & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.coalesce(usable, F.lit(False)).alias("ok"))
    single = rows.where("ok AND vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _doubles(batch.column("v"), params.n_components) + 0.0  # no negative zeros
            packed = pa.array([row.tobytes() for row in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed], ["vec_id", "vector"])

    packed = single.mapInArrow(pack, "vec_id long, vector binary")
    return packed.select("vec_id", F.unhex(F.md5("vector")).alias("key"), "vector")


def _doubles(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _matrix(values: Iterable[bytes], dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype).reshape(-1, width)


def with_strings(vectors: DataFrame, longest: float | None, params: ForestParams) -> DataFrame:
    """``vectors`` (with a packed column ``vector``) and their hash strings, all trees'
    in one binary, written once."""
    shared = ship(vectors.sparkSession, rotations(params))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turned = shipped(shared)
        for batch in batches:
            x = _matrix(batch.column("vector").to_pylist(), np.float64, params.n_components)
            strings = hash_strings(lifted(x, longest), turned)
            packed = pa.array([row.tobytes() for row in strings], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, packed], [*batch.schema.names, "strings"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return materialize(vectors.mapInArrow(hashed, f"{schema}, strings binary"))


class Ranges:
    """How each tree's sorted array is dealt: ranges of first symbols, each in as many
    pieces as its rows need. ``rows`` and ``queries``: (tree, range) -> count; tree -1 is
    the root, one range that holds everything."""

    def __init__(self, params: ForestParams, n_rows: int):
        self.params, self.alphabet = params, 2 * (params.n_components + 1)
        self.n = min(max(1, math.ceil(n_rows / params.piece_rows)), self.alphabet)
        self.rows: dict[tuple[int, int], int] = {}
        self.queries: dict[tuple[int, int], int] = {}

    def of(self, first: np.ndarray) -> np.ndarray:
        return first.astype(np.int64) * self.n // self.alphabet

    def pieces(self, counts: dict, tree: int, at: int) -> int:
        return max(1, math.ceil(counts.get((tree, at), 0) / self.params.piece_rows))


def tree_counts(table: DataFrame, ranges: Ranges) -> dict[tuple[int, int], int]:
    """Rows of each tree's range: at most trees * ranges numbers."""
    params, n = ranges.params, ranges.n

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((params.trees, n), np.int64)
        for batch in batches:
            strings = _matrix(batch.column("strings").to_pylist(), SYMBOL, params.trees * params.symbols)
            for t in range(params.trees):
                total[t] += np.bincount(ranges.of(strings[:, t * params.symbols]), minlength=n)
        tree, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(tree, pa.int32()), pa.array(at, pa.int32()), pa.array(total[tree, at])], ["tree", "at", "n"]
        )

    rows = table.select("strings").mapInArrow(count, "tree int, at int, n long").groupBy("tree", "at").agg(F.sum("n").alias("n"))
    return {(r["tree"], r["at"]): r["n"] for r in rows.collect()}


GROUP = ["tree", "at", "piece", "query_piece"]


def dealt(table: DataFrame, ranges: Ranges, roots: bool, as_queries: bool, carried: list[str]) -> DataFrame:
    """One row for each tree, range and pieces a batch of rows reaches, its rows packed:
    strings of that tree and the ``carried`` binary columns of fixed width. Rows go to the
    piece of their key's hash and meet every piece of the other side."""
    params = ranges.params
    own, other = (ranges.queries, ranges.rows) if as_queries else (ranges.rows, ranges.queries)
    width = params.trees * params.symbols

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            strings = _matrix(batch.column("strings").to_pylist(), SYMBOL, width)
            keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint64).reshape(-1, 2)[:, 0]
            values = [batch.column(c).to_pylist() for c in carried]
            for tree in [-1] if roots else range(params.trees):
                first = strings[:, max(tree, 0) * params.symbols]
                at = np.zeros(len(first), np.int64) if roots else ranges.of(first)
                split = np.array([ranges.pieces(own, tree, i) for i in range(1 if roots else ranges.n)], np.uint64)
                piece = (keys % split[at]).astype(np.int64)
                place = at * (int(split.max()) + 1) + piece
                order = np.argsort(place, kind="stable")
                cuts = np.flatnonzero(np.diff(place[order])) + 1
                out = []
                for run in np.split(order, cuts):
                    a, p = int(at[run[0]]), int(piece[run[0]])
                    text = strings[run, max(tree, 0) * params.symbols : (max(tree, 0) + 1) * params.symbols].tobytes()
                    packed = [b"".join(v[i] for i in run) for v in values]
                    for o in range(ranges.pieces(other, tree, a)):
                        out.append((tree, a, o if as_queries else p, p if as_queries else o, text, *packed))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int32()] * 4, *[pa.binary()] * (1 + len(carried))])],
                    [*GROUP, "strings", *carried],
                )

    binaries = ", ".join(f"{c} binary" for c in ["strings", *carried])
    return table.select("key", "strings", *[c for c in carried if c != "key"]).mapInArrow(
        deal, f"tree int, at int, piece int, query_piece int, {binaries}"
    )


def _joined(table: pa.Table, column: str, dtype, width: int) -> np.ndarray:
    return _matrix(table.column(column).to_pylist(), dtype, width)


def reach(rows: DataFrame, queries: DataFrame, ranges: Ranges) -> DataFrame:
    """key, n: vectors that share the first 1, 2, ... symbols with a query, over all trees."""
    params = ranges.params
    s = params.symbols

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        ordered = np.sort(np.ascontiguousarray(_joined(left, "strings", SYMBOL, s)).view(f"S{2 * s}").ravel()) if left.num_rows else np.zeros(0, f"S{2 * s}")
        ordered = ordered.view(SYMBOL).reshape(-1, s)
        strings = _joined(right, "strings", SYMBOL, s)
        keys = _joined(right, "key", "V16", 1).ravel()
        found = np.empty((len(strings), s), np.int64)
        for depth in range(1, s + 1):
            a, b = prefix_slices(ordered, strings, np.full(len(strings), depth))
            found[:, depth - 1] = b - a
        some = np.flatnonzero(found[:, 0])
        return pa.table(
            {"key": pa.array([keys[i].tobytes() for i in some], pa.binary()), **{f"n{d}": pa.array(found[some, d]) for d in range(s)}}
        )

    schema = "key binary, " + ", ".join(f"n{d} long" for d in range(s))
    pairs = dealt(rows, ranges, False, False, []).groupBy(*GROUP).cogroup(dealt(queries, ranges, False, True, ["key"]).groupBy(*GROUP))
    sums = pairs.applyInArrow(count, schema).groupBy("key").agg(*(F.sum(f"n{d}").alias(f"n{d}") for d in range(s)))
    return sums.select("key", F.array(*(f"n{d}" for d in range(s))).alias("n"))


def best_in_pieces(rows: DataFrame, queries: DataFrame, ranges: Ranges, roots: bool, keep: int) -> DataFrame:
    """key, vec_id, score: the best ``keep`` ids of each query in each piece.
    ``queries`` carry ``depth``, two bytes: symbols that a candidate has to share."""
    params = ranges.params
    s, d = params.symbols, params.n_components

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[bytes, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            strings = _joined(left, "strings", SYMBOL, s)
            order = np.argsort(np.ascontiguousarray(strings).view(f"S{2 * s}").ravel(), kind="stable")
            x, ids = _joined(left, "vector", np.float64, d)[order], _joined(left, "ids", np.int64, keep)[order]
            q, keys = _joined(right, "vector", np.float64, d), _joined(right, "key", "V16", 1).ravel()
            depth = _joined(right, "depth", SYMBOL, 1).ravel().astype(np.int64)
            start, end = prefix_slices(strings[order], _joined(right, "strings", SYMBOL, s), depth)
            for a, b in {*zip(start.tolist(), end.tolist())}:
                if a == b:
                    continue
                mine = np.flatnonzero((start == a) & (end == b))
                step = max(1, params.block_scores // (b - a))
                for block in (mine[i : i + step] for i in range(0, len(mine), step)):
                    scores = q[block] @ x[a:b].T
                    for i, row in zip(block, scores):
                        out.append((keys[i].tobytes(), *_best(q[i], x[a:b], ids[a:b], row, keep)))
        return pa.table(
            {
                "key": pa.array([k for k, i, _ in out for _ in range(len(i))], pa.binary()),
                "vec_id": pa.array(np.concatenate([np.zeros(0, np.int64), *(i for _, i, _ in out)])),
                "score": pa.array(np.concatenate([np.zeros(0), *(v for _, _, v in out)])),
            }
        )

    left = dealt(rows, ranges, roots, False, ["vector", "ids"])
    right = dealt(queries, ranges, roots, True, ["key", "vector", "depth"])
    return left.groupBy(*GROUP).cogroup(right.groupBy(*GROUP)).applyInArrow(compare, "key binary, vec_id long, score double")


#: Marks the unused places of a vector's packed ids.
NO_ID = np.iinfo(np.int64).min


def _best(q: np.ndarray, x: np.ndarray, ids: np.ndarray, rough: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best ``keep``, smaller ids first among equal scores.

    The matrix product only narrows the choice; the score is summed pair by pair in one
    fixed order, so equal vectors have equal scores in every piece.
    """
    if len(rough) > keep:
        cut = np.partition(rough, len(rough) - keep)[len(rough) - keep]
        near = np.flatnonzero(rough >= cut - 1e-9 * (abs(cut) + np.abs(q).max()))
    else:
        near = np.arange(len(rough))
    exact = (x[near] * q).sum(1)
    owners = np.repeat(exact, ids.shape[1])
    flat = ids[near].ravel()
    used = flat != NO_ID
    flat, owners = flat[used], owners[used]
    order = np.lexsort((flat, -owners))[:keep]
    return flat[order], owners[order]


# -- search -----------------------------------------------------------------------------


def true_neighbours(rows: DataFrame, sample: list, top: int, params: ForestParams) -> DataFrame:
    """query (number in the sample), key, strings of its nearest vectors, by comparing the
    sample with every vector."""
    own = [bytes(r["key"]) for r in sample]
    q = _matrix([bytes(r["vector"]) for r in sample], np.float64, params.n_components)

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, bytes]]] = [[] for _ in own]
        for batch in batches:
            keys = batch.column("key").to_pylist()
            scores = q @ _matrix(batch.column("vector").to_pylist(), np.float64, params.n_components).T
            for i, row in enumerate(scores):
                near = np.argpartition(-row, top)[: top + 1] if len(row) > top + 1 else range(len(row))
                best[i] = sorted([*best[i], *((-row[j], keys[j]) for j in near if keys[j] != own[i])])[:top]
        flat = [(i, k, -s) for i, found in enumerate(best) for s, k in found]
        columns = zip(*flat) if flat else ([], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.binary(), pa.float64()])], ["query", "key", "score"]
        )

    found = rows.select("key", "vector").mapInArrow(compare, "query int, key binary, score double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= top).select("query", "key")


def measured_number(rows: DataFrame, queries: DataFrame, reached: DataFrame, top: int, params: ForestParams) -> int:
    """Candidates that a query needs, from the true neighbours of a bounded sample."""
    least = params.trees * (top + 1)  # so many, over all trees, are top + 1 different ones
    sample = queries.orderBy("key").limit(params.sample_queries).collect()
    if not sample:
        return least
    near = materialize(true_neighbours(rows, sample, top, params))
    numbers = {bytes(r["key"]): i for i, r in enumerate(sample)}
    chosen = near.select("key").distinct()  # at most sample_queries * top rows
    strings = rows.select("key", "strings").join(F.broadcast(chosen), "key").collect()
    shape = (params.trees, params.symbols)
    of = {bytes(r["key"]): np.frombuffer(bytes(r["strings"]), SYMBOL).reshape(shape) for r in strings}
    shared: list[list[int]] = [[] for _ in sample]
    for r in near.collect():
        own = np.frombuffer(bytes(sample[r["query"]]["strings"]), SYMBOL).reshape(shape)
        equal = np.cumprod(own == of[bytes(r["key"])], axis=1).sum(1)
        shared[r["query"]].append(int(equal.max()))
    depths = np.arange(1, params.symbols + 1)
    recall = np.array([[np.mean(np.array(s) >= d) if s else 1.0 for d in depths] for s in shared])
    keys = [F.lit(bytearray(k)) for k in numbers]
    n = np.zeros((len(sample), params.symbols), np.int64)
    for r in reached.where(F.col("key").isin(*keys)).collect():
        n[numbers[bytes(r["key"])]] = r["n"]
    return enough(n, recall, params.target, least)


def search_rows(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 20,
    top: int = 20,
    params: ForestParams = ForestParams(),
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``every`` the
    ``top`` rows of largest inner product that the forest finds, itself left out.

    Ties go to the smaller id. Each query has ``top`` rows, or all others if there are
    fewer. Vectors that are null, zero, of another length than ``n_components`` or that
    hold null or non-finite components take no part, nor do null ids. Rows that repeat an
    id count once, with the smallest of its vectors. Equal vectors are one entry of the
    forest with their ``top + 1`` smallest ids; no longer list could show more of them.
    An empty table, or one without queries, gives no rows. Other columns, of any name, are
    not read.
    """
    keep = top + 1
    usable = materialize(usable_vectors(df, id_col, vector_col, params))
    place = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = usable.withColumn("place", place).where(F.col("place") <= keep)  # limited before the shuffle
    padded = F.array_sort(F.collect_list("vec_id"))
    entries = few.groupBy("key", "vector").agg(padded.alias("ids"))
    packed_ids = materialize(_packed_ids(entries, keep))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x, F.sqrt)
    longest = df.select(F.col(vector_col).cast("array<double>").alias("v")).where(
        (F.size("v") == params.n_components) & F.forall("v", lambda x: F.coalesce(F.abs(x) < math.inf, F.lit(False)))
    ).agg(F.max(norm)).first()[0]
    asking = usable.where(F.col("vec_id") % every == 0)
    rows = with_strings(packed_ids, longest or 1.0, params)
    queries = with_strings(asking.select("key", "vector").dropDuplicates(["key"]), None, params)
    ranges = Ranges(params, rows.count())
    ranges.rows, ranges.queries = tree_counts(rows, ranges), tree_counts(queries, ranges)
    reached = materialize(reach(rows, queries, ranges))
    number = measured_number(rows, queries, reached, top, params)
    depth = F.size(F.filter("n", lambda c: c >= number))
    asked = materialize(queries.join(reached, "key", "left").withColumn("depth", F.coalesce(F.when(F.col("n").isNotNull(), depth), F.lit(0))).drop("n"))
    two_bytes = F.unhex(F.lpad(F.hex("depth"), 4, "0"))
    in_trees = asked.where("depth > 0").withColumn("depth", two_bytes)
    found = best_in_pieces(rows, in_trees, ranges, False, keep)
    at_root = asked.where("depth = 0").withColumn("depth", two_bytes)
    n_root = at_root.count()
    if n_root:
        whole = Ranges(params, 1)
        whole.rows, whole.queries = {(-1, 0): rows.count()}, {(-1, 0): n_root}
        found = found.unionByName(best_in_pieces(rows, at_root, whole, True, keep))
    best = found.groupBy("key", "vec_id").agg(F.max("score").alias("score"))
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    best = best.withColumn("place", order).where(F.col("place") <= keep)
    entry = F.struct((-F.col("score")).alias("minus"), F.col("vec_id"), F.col("score"))
    lists = best.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("found"))
    answers = asking.select(F.col("vec_id").alias("query_id"), "key").join(lists, "key")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, top)
    listed = answers.select("query_id", F.posexplode(others).alias("at", "hit"))
    return listed.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def _packed_ids(entries: DataFrame, keep: int) -> DataFrame:
    """key, vector, ids: a vector's ids, padded to ``keep`` and packed."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.full((batch.num_rows, keep), NO_ID)
            for row, own in zip(ids, batch.column("ids").to_pylist()):
                row[: len(own)] = own
            packed = pa.array([row.tobytes() for row in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("vector"), packed], ["key", "vector", "ids"])

    return entries.mapInArrow(pack, "key binary, vector binary, ids binary")
