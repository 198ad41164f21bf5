"""Centroid clustering over Hilbert-ordered zone maps, in whole numbers.

Vectors are put in the order of a Hilbert curve through their widest dimensions and cut
into blocks. A block's zone map is the smallest box around its vectors. For two centroids
the difference of a vector's squared distances is linear in the vector, so its least value
over a box is known at once; where it is positive the farther centroid cannot be nearest
to any vector of the block. What remains are the block's candidate centroids. A block with
one candidate adds its stored sum and count; the others compare their vectors with the
candidates only, exactly.

Blocks are rows of a table in the shared folder. Each round reads them, sends the
centroids along (a few kilobytes) and brings back one sum a centroid and component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Largest magnitude of a whole component: squared distances of 64 components fit 63 bits.
LIMIT = 1 << 27


@dataclass(frozen=True)
class ClusterParams:
    """n_components: vectors of another length are left out. scale: a component x becomes
    floor(scale * x). n_clusters, rounds: centroids, and times they move. salt: begins the
    hashed text that chooses the first centroids. block_rows: vectors a block.
    curve_dims, curve_bits: dimensions of the Hilbert curve (the widest ones) and bits of
    each; their product is at most 63."""

    n_components: int = 64
    scale: int = 1024
    n_clusters: int = 8
    rounds: int = 10
    salt: str = "3:"
    block_rows: int = 128
    curve_dims: int = 10
    curve_bits: int = 6


# -- pieces that tests call on their own ----------------------------------------------


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole coordinates below 2**bits.

    From the highest bit down, each dimension that is in the upper half reflects the lower
    bits of the first dimension, else the two exchange theirs; a Gray code over the
    dimensions then numbers the cells.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            upper = (x[i] & q) != 0
            exchange = np.where(upper, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(upper, low, exchange)
            x[i] ^= exchange
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint64(b)) & one, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some vector of the box, ascending.

    Centroid j goes if another k is nearer everywhere in the box, or as near everywhere
    and has the smaller number.
    """
    norms = (centroids * centroids).sum(1)
    k = len(centroids)
    if k == 1:
        return np.zeros(1, np.int64)
    slope = -2 * (centroids[:, None, :] - centroids[None, :, :])
    least = np.minimum(slope * low, slope * high).sum(2) + norms[:, None] - norms[None, :]
    smaller = np.arange(k)[None, :] < np.arange(k)[:, None]
    beaten = (least > 0) | ((least == 0) & smaller)
    return np.flatnonzero(~beaten.any(1))


def nearest(vectors: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance); ties go to the smaller number."""
    distances = np.empty((len(among), len(vectors)), np.int64)
    for row, j in enumerate(among):
        gap = vectors - centroids[j]
        distances[row] = np.einsum("ij,ij->i", gap, gap)
    best = distances.argmin(0)
    return among[best], distances[best, np.arange(len(vectors))]


# -- blocks ---------------------------------------------------------------------------


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, params: ClusterParams) -> DataFrame:
    """vec_id, v (array of ints) of the vectors that are kept."""
    v = F.col(vector_col)
    fits = (F.size(v) == params.n_components) & F.forall(
        v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) * params.scale < LIMIT)
    )  # NaN compares as larger than any number, so it is left out with infinities
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * params.scale).cast("int"))
    return df.where(F.coalesce(fits, F.lit(False))).select(F.col(id_col).alias("vec_id"), whole.alias("v"))


def first_centroids(kept: DataFrame, params: ClusterParams) -> np.ndarray:
    """The vectors whose salted id hashes lowest, a bounded top-k."""
    rank = F.sha2(F.concat(F.lit(params.salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    chosen = kept.select(F.col("vec_id").isNull().alias("no_id"), rank.alias("rank"), "v").orderBy("no_id", "rank", "v")
    return np.array([r["v"] for r in chosen.limit(params.n_clusters).collect()], np.int64)


def curve_axes(kept: DataFrame, params: ClusterParams) -> list[tuple[int, float, float]]:
    """(dimension, centre, half width) of the dimensions with the largest variance."""
    fields = range(params.n_components)
    row = kept.select(
        F.array(*(F.avg(F.col("v")[i]) for i in fields)).alias("mean"),
        F.array(*(F.stddev_pop(F.col("v")[i]) for i in fields)).alias("spread"),
    ).first()
    widest = sorted(fields, key=lambda i: (-row["spread"][i], i))[: params.curve_dims]
    return [(i, row["mean"][i], max(2.5 * row["spread"][i], 0.5)) for i in widest]


def _stacked(column: pa.Array, n_components: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n_components)


def _packed(rows: list[np.ndarray]) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def block_table(kept: DataFrame, params: ClusterParams) -> DataFrame:
    """ids, n, vectors, low, high, total: one row a block, written once.

    Range partitions split by curve place and then by id hash, so equal vectors, however
    many, spread over tasks; a block never holds more than ``block_rows``.
    """
    axes = curve_axes(kept, params)
    d = params.n_components
    kind = kept.schema["vec_id"].dataType.simpleString()
    dims = [i for i, _, _ in axes]
    lowest = np.array([c - w for _, c, w in axes])
    cells = 1 << params.curve_bits
    scale = cells / np.array([2 * w for _, _, w in axes])

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _stacked(batch.column("v"), d)
                at = np.clip(np.floor((x[:, dims] - lowest) * scale), 0, cells - 1)
                place = pa.array(hilbert_keys(at.astype(np.uint64), params.curve_bits))
                yield pa.RecordBatch.from_arrays([*batch.columns, place], ["vec_id", "v", "place"])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = range(0, batch.num_rows, params.block_rows)
            if not blocks:
                continue
            x = _stacked(batch.column("v"), d)
            parts = [x[i : i + params.block_rows] for i in blocks]
            columns = [
                pa.array([batch.column("vec_id").slice(i, params.block_rows).to_pylist() for i in blocks], pa.list_(batch.schema.field("vec_id").type)),
                _packed([p.astype(np.int32) for p in parts]),
                _packed([p.min(0) for p in parts]),
                _packed([p.max(0) for p in parts]),
                _packed([p.sum(0) for p in parts]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["ids", "vectors", "low", "high", "total"])

    placed = kept.mapInArrow(keys, f"vec_id {kind}, v array<int>, place long")
    spread = F.xxhash64(F.col("vec_id"))
    ordered = placed.withColumn("spread", spread).repartitionByRange("place", "spread").sortWithinPartitions("place", "spread")
    schema = f"ids array<{kind}>, vectors binary, low binary, high binary, total binary"
    return materialize(ordered.select("vec_id", "v").mapInArrow(cut, schema))


def _zones(batch: pa.RecordBatch, centroids: np.ndarray):
    """(row, candidate centroids) of each block."""
    for row, (low, high) in enumerate(zip(batch.column("low").to_pylist(), batch.column("high").to_pylist())):
        yield row, candidates(np.frombuffer(low, np.int64), np.frombuffer(high, np.int64), centroids)


def _vectors(value: pa.Scalar, n_components: int) -> np.ndarray:
    return np.frombuffer(value.as_py(), np.int32).astype(np.int64).reshape(-1, n_components)


def moved(blocks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floored mean of its vectors; one without vectors stays."""
    d = centroids.shape[1]

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            for row, among in _zones(batch, centroids):
                if len(among) == 1:
                    count[among[0]] += len(batch.column("ids")[row])
                    total[among[0]] += np.frombuffer(batch.column("total")[row].as_py(), np.int64)
                    continue
                x = _vectors(batch.column("vectors")[row], d)
                own, _ = nearest(x, centroids, among)
                for j in np.unique(own):
                    total[j] += x[own == j].sum(0)
                    count[j] += (own == j).sum()
        wide = np.concatenate([total, count[:, None]], 1)[count > 0]
        number = np.repeat(np.flatnonzero(count), d + 1)
        place = np.tile(np.arange(d + 1), int((count > 0).sum()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int32()), pa.array(place, pa.int32()), pa.array(wide.ravel(), pa.int64())],
            ["cluster", "place", "total"],
        )

    parts = blocks.mapInArrow(sums, "cluster int, place int, total long")
    rows = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums_of = {(r["cluster"], r["place"]): int(r["total"]) for r in rows}
    out = centroids.copy()
    for j in range(len(centroids)):
        if (j, d) in sums_of:
            out[j] = [sums_of[j, i] // sums_of[j, d] for i in range(d)]
    return out


def assigned(blocks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of each vector."""
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    d = centroids.shape[1]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, among in _zones(batch, centroids):
                own, distance = nearest(_vectors(batch.column("vectors")[row], d), centroids, among)
                ids = batch.column("ids")[row].values
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(own, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"]
                )

    return blocks.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long")


@dataclass(frozen=True)
class Clusters:
    """centroids: whole components, one row each. rows: vec_id, cluster, distance,
    cluster_inertia, inertia, centroid_sha256. blocks: the table of zone maps (None without vectors)."""

    centroids: np.ndarray
    rows: DataFrame
    blocks: DataFrame | None


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", params: ClusterParams = ClusterParams()
) -> Clusters:
    """Cluster the vectors of ``df`` and assign each to its nearest centroid.

    Left out: null vectors, those of another length, with null or non-finite components,
    or with a scaled component of 2**27 or more, whose squared distances would not fit 63
    bits. Each row counts, so repeated rows weigh and come out more than once; rows of one
    id stay apart. Null ids take part, but are first centroids only where others are too
    few; first centroids tied by id go by their components. Fewer vectors than clusters
    give that many centroids, none (an empty table) no rows. A centroid without vectors
    stays where it is. Inertias beyond 63 bits are null. Other columns, of any name, are
    not read.
    """
    kept = whole_vectors(df, id_col, vector_col, params)
    centroids = first_centroids(kept, params)
    facts = "cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        kind = kept.schema["vec_id"].dataType.simpleString()
        rows = df.sparkSession.createDataFrame([], f"vec_id {kind}, cluster int, distance long, {facts}")
        return Clusters(centroids, rows, None)
    blocks = block_table(kept, params)
    for _ in range(params.rounds):
        last, centroids = centroids, moved(blocks, centroids)
        if (last == centroids).all():
            break  # further rounds would change nothing
    found = materialize(assigned(blocks, centroids))
    exact = F.col("distance").cast("decimal(38,0)")
    sums = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(F.sum(exact).alias("inertia")).collect()}
    fits = lambda x: int(x) if x < 1 << 63 else None
    everything = fits(sum(sums.values()))
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    per_cluster = df.sparkSession.createDataFrame(
        [(j, fits(x), everything, digest(centroids[j])) for j, x in sums.items()], f"cluster int, {facts}"
    )
    joined = found.join(F.broadcast(per_cluster), "cluster")  # one row a centroid
    return Clusters(centroids, joined.select("vec_id", "cluster", "distance", *per_cluster.columns[1:]), blocks)
