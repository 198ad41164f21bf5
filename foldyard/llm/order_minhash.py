"""Near-duplicate classes by Order MinHash and banded alignment.

A k-mer is a run of five words with its occurrence number in the text, so k-mers of one
text are distinct. A sketch keeps, for one hash function, the two smallest k-mers in
text order; two texts agree on it if they share both in the same order, which follows
their edit similarity. Three sketches make a band and texts that agree on a band are
candidates. A candidate pair is verified by aligning its k-mers: an order-preserving
one-to-one matching of equal k-mers inside the diagonal band that the similarity leaves
open. Similarity is matched / (n1 + n2 - matched), at least 0.8.

Equal texts are one node throughout. In each band bucket texts are first verified
against the bucket's leader; most of a bucket then is one component. In buckets that
hold several components, k-mers that no other text there has are counted: a text with
too many of them links to nothing, and two texts cannot have more in common than either
shares with any other. A few rounds follow with other leaders, one pair a member. What
is left, texts of one bucket in different components that may still link, is compared
last, in blocks of a bounded size, so no candidate link is lost, and pairs inside a
group of copies are never expanded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import labels, stars
from .hashing import BASES, mixed, rolling, text_blocks, text_key, text_words, word_hashes


@dataclass(frozen=True)
class SketchParams:
    """words: of a k-mer. similarity: of a link. bands x sketches: 20 bands of three
    sketches of two k-mers find a pair at 0.8 with probability 0.997. rounds: with other
    leaders (a first one per bucket comes before), before the rest in blocks of ``block_texts`` texts. seed: of the hash functions."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    sketches: int = 3
    rounds: int = 1
    block_texts: int = 400
    seed: int = 11


#: K-mers of a text that are hashed at once.
CHUNK = 8192


def kmers(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of occurrence-labelled runs of ``k`` words; a shorter text is one run."""
    if not len(hashes):
        return hashes
    grams = rolling(hashes, min(k, len(hashes)))
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    if len(ranked) > 1 and (ranked[1:] == ranked[:-1]).any():
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        starts = np.flatnonzero(first)
        occurrence = np.empty(len(grams), np.uint64)
        occurrence[order] = np.arange(len(grams)) - np.repeat(starts, np.diff(np.append(starts, len(grams))))
        grams = np.where(occurrence > 0, mixed(grams + occurrence * np.uint64(BASES[1])), grams)
    return grams


def _two_smallest(grams: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each seed the places of the two smallest k-mers, the first in text order first."""
    best = np.full((len(seeds), 2), np.iinfo(np.uint64).max, np.uint64)
    place = np.zeros((len(seeds), 2), np.int64)
    rows = np.arange(len(seeds))
    for start in range(0, len(grams), CHUNK):
        x = (grams[None, start : start + CHUNK] ^ seeds[:, None]) * np.uint64(BASES[0])
        x ^= x >> np.uint64(32)
        for _ in range(min(2, x.shape[1])):
            at = x.argmin(axis=1)
            value = x[rows, at]
            x[rows, at] = np.iinfo(np.uint64).max
            first, second = value < best[:, 0], value < best[:, 1]
            moved = first[:, None]
            best = np.where(moved, np.stack([value, best[:, 0]], 1), np.stack([best[:, 0], np.where(second, value, best[:, 1])], 1))
            place = np.where(moved, np.stack([start + at, place[:, 0]], 1), np.stack([place[:, 0], np.where(second, start + at, place[:, 1])], 1))
    if len(grams) == 1:
        place[:, 1] = place[:, 0]
    place.sort(axis=1)
    return place[:, 0], place[:, 1]


def bands_of(grams: np.ndarray, params: SketchParams) -> np.ndarray:
    """One hash for each band, of its sketches and its number."""
    n = params.bands * params.sketches
    seeds = mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASES[1]) + np.uint64(params.seed))
    a, b = _two_smallest(grams, seeds)
    sketch = mixed(grams[a] * np.uint64(BASES[0]) + grams[b] + seeds).reshape(params.bands, params.sketches)
    band = np.zeros(params.bands, np.uint64)
    for j in range(params.sketches):
        band = mixed(band * np.uint64(BASES[1]) + sketch[:, j])
    return band


def _grams(texts: list[str], params: SketchParams) -> Iterator[np.ndarray]:
    """K-mers of each text; words are held for a few texts at a time."""
    for s in text_blocks(texts):
        words, counts = text_words(texts[s])
        hashes, start = word_hashes(words), 0
        for n in counts:
            yield kmers(hashes[start : start + n], params.words)
            start += n


def _sketch(params: SketchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            sizes, bands = [], []
            for grams in _grams(texts, params):
                sizes.append(len(grams))
                bands.append(bands_of(grams, params).view(np.int64) if len(grams) else [])
            keys = pa.array(map(text_key, texts), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["text_key", "n", "bands"],
            )

    return run


def _encode(params: SketchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [grams.tobytes() for grams in _grams(batch.column(1).to_pylist(), params)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["text_key", "grams"])

    return run


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> int:
    """Matched k-mers of an order-preserving alignment inside the diagonal band.

    A matching that reaches ``similarity`` leaves at most ``width`` k-mers of either
    text out before any match, so the band loses none. Sparse dynamic programming over
    the matches: the longest rising run of places.
    """
    least = int(np.ceil(similarity * (len(a) + len(b)) / (1 + similarity) - 1e-9))
    width = max(len(a), len(b)) - least
    if width < 0:
        return 0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(at_a)
    at_b = at_b[order]
    at_b = at_b[np.abs(at_b - at_a[order]) <= width]
    if len(at_b) < least:
        return len(at_b)
    if (np.diff(at_b) > 0).all():
        return len(at_b)
    tails = np.empty(len(at_b), np.int64)
    n = 0
    for x in at_b:
        i = int(np.searchsorted(tails[:n], x))
        tails[i] = x
        n = max(n, i + 1)
    return n


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_key, b_key, a_grams, b_grams = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(a_grams, b_grams):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                m = aligned(a, b, similarity)
                keep.append(m >= similarity * (len(a) + len(b) - m))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a_key.filter(mask), b_key.filter(mask)], ["a", "b"])

    return run


def _links(pairs: DataFrame, grams: DataFrame, params: SketchParams) -> DataFrame:
    """The pairs (a, b) of text keys whose alignment is similar enough."""
    second = pairs.join(grams.select(F.col("text_key").alias("b"), F.col("grams").alias("b_grams")), "b")
    both = second.join(grams.select(F.col("text_key").alias("a"), F.col("grams").alias("a_grams")), "a")
    return both.select("a", "b", "a_grams", "b_grams").mapInArrow(_verify(params.similarity), "a binary, b binary")


def near_duplicate_classes(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SketchParams = SketchParams()
) -> DataFrame:
    """One row per input row: doc_id, class_id (smallest id of the class), copies (rows
    in the class), keeps (true for one row of each class, one with the smallest id).

    Equal texts are one class; null counts as the empty text, and texts without a word
    have no k-mer, so only equal ones join. A text of fewer than five words is one
    k-mer. Null ids take part, come last, and a class of them alone has a null id.
    Repeated rows are copies of one another. Other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    keys = materialize(docs.select("doc_id", F.unhex(F.md5("text")).alias("text_key")))
    return _classes(docs, keys, params).select("doc_id", "class_id", "copies", "keeps")


def text_classes(docs: DataFrame, params: SketchParams) -> DataFrame:
    """text_key, component: for texts linked to a different text. ``docs`` has text."""
    with_key = docs.select("text", F.unhex(F.md5("text")).alias("text_key"))
    sketches = docs.select("text").mapInArrow(_sketch(params), "text_key binary, n long, bands array<long>")
    rows = materialize(sketches.select("text_key", "n", F.explode("bands").alias("band")).distinct())
    leaders = (
        rows.groupBy("band")
        .agg(F.count("*").alias("size"), F.min(F.struct("n", "text_key")).alias("leader"))
        .where(F.col("size") > 1)
        .select("band", F.col("leader.text_key").alias("leader"), F.col("leader.n").alias("leader_n"))
    )
    members = materialize(rows.join(leaders, "band"))
    involved = members.select("text_key").distinct()
    texts = with_key.join(involved, "text_key", "left_semi").dropDuplicates(["text_key"])
    grams = materialize(texts.select("text_key", "text").mapInArrow(_encode(params), "text_key binary, grams binary"))

    def close(x: str, y: str):
        return F.least(x, y) >= params.similarity * F.greatest(x, y)

    led = members.where((F.col("text_key") != F.col("leader")) & close("n", "leader_n"))
    tried = materialize(_pairs(led.select("leader", "text_key")))
    known = stars(_links(tried, grams, params))
    table = materialize(_mixed_buckets(members.select("band", "text_key", "n"), labels(known)))
    shared = _shared(table, grams).where(F.col("shared") >= params.similarity * F.col("n"))
    table = materialize(table.join(shared.drop("n"), "text_key"))
    for round_ in range(1, params.rounds + 1):
        if round_ > 1:
            table = materialize(_mixed_buckets(table.drop("component"), labels(known)))
        # first the text with the fewest k-mers of its own, then others by a hash
        alone = F.col("shared") / F.col("n") if round_ == 1 else F.lit(0.0)
        rank = F.struct(-alone, F.xxhash64("band", "text_key", F.lit(round_)))
        leaders = table.groupBy("band").agg(
            F.min(F.struct(rank.alias("rank"), "text_key", "n", "shared", "component")).alias("l")
        )
        led = table.join(leaders, "band").where(
            (F.col("component") != F.col("l.component"))
            & _may_link(params, "n", "shared", "l.n", "l.shared")
        )
        pairs = _pairs(led.select("l.text_key", F.col("text_key").alias("member")))
        fresh = materialize(pairs.join(tried, ["a", "b"], "left_anti"))
        tried = tried.union(fresh)
        known = stars(known.toDF("a", "b").union(_links(fresh, grams, params)))
    rest = materialize(_mixed_buckets(table.drop("component"), labels(known)))
    return labels(stars(known.toDF("a", "b").union(_rest_links(rest, grams, params))))


def _rest_links(rest: DataFrame, grams: DataFrame, params: SketchParams) -> DataFrame:
    """Links between texts of one bucket in different components, found block by block.

    A bucket is dealt into blocks of about ``block_texts`` texts; a task holds two blocks
    (or one) and compares what may link across their components. So a task's memory is
    bounded, pairs are never rows, and a text travels once for each block of its bucket.
    """
    sizes = rest.groupBy("band").agg(F.ceil(F.count("*") / params.block_texts).cast("int").alias("blocks"))
    placed = rest.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
    partners = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = placed.select("band", "text_key", "n", "shared", "component", "block", F.explode(partners).alias("other"))
    met = met.select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        "text_key", "n", "shared", "component", "block",
    )
    spelled = met.join(grams, "text_key")
    return spelled.groupBy("band", "low", "high").applyInArrow(_compare_blocks(params), "a binary, b binary")


def common_counts(texts: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """K-mers that each two texts have in common."""
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    _, place, times = np.unique(np.concatenate(texts), return_inverse=True, return_counts=True)
    several = times > 1
    number = np.cumsum(several) - 1
    keep = several[place]
    owner, place = owner[keep], number[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    out = np.zeros((len(texts), len(texts)), np.float32)
    for start in range(0, int(several.sum()), columns):
        s, e = np.searchsorted(place, [start, start + columns])
        marks = np.zeros((len(texts), columns), np.float32)
        marks[owner[s:e], place[s:e] - start] = 1
        out += marks @ marks.T
    return out


def _compare_blocks(params: SketchParams):
    def run(key, table):
        names, parts = table["text_key"].to_pylist(), table["component"].to_pylist()
        block, n = (np.array(table[c].to_pylist()) for c in ("block", "n"))
        shared = np.array(table["shared"].to_pylist())
        label = {c: i for i, c in enumerate(dict.fromkeys(parts))}
        group = np.array([label[c] for c in parts], np.int64)
        texts = [np.frombuffer(g, np.uint64) for g in table["grams"].to_pylist()]
        a, b = [], []
        if len(label) > 1:
            most = np.minimum.outer(shared, shared)
            total = np.add.outer(n, n)
            may = (most >= params.similarity * (total - most)) & (group[:, None] != group[None, :])
            may &= np.tri(len(n), k=-1, dtype=bool)
            if key[1].as_py() != key[2].as_py():
                may &= block[:, None] != block[None, :]
            if may.any():
                common = common_counts(texts)
                may &= common >= params.similarity * (total - common)
            for i, j in zip(*np.nonzero(may)):
                if group[i] != group[j]:  # unless joined by a link found before
                    m = aligned(texts[i], texts[j], params.similarity)
                    if m >= params.similarity * (total[i, j] - m):
                        a.append(names[i])
                        b.append(names[j])
                        group[group == group[i]] = group[j]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return run


def _shared(table: DataFrame, grams: DataFrame) -> DataFrame:
    """text_key, n, shared: of each text's k-mers those that another text of ``table``
    has too. No pair can have more in common than the smaller of its two numbers."""
    texts = table.select("text_key", "n").distinct()
    spelled = grams.join(texts, "text_key").select("text_key", "grams").mapInArrow(
        _spell, "text_key binary, grams array<long>"
    )
    each = spelled.select("text_key", F.explode("grams").alias("gram"))
    alone = each.groupBy("gram").agg(F.count("*").alias("texts"), F.min("text_key").alias("text_key"))
    own = alone.where("texts = 1").groupBy("text_key").agg(F.count("*").alias("own"))
    return texts.join(own, "text_key", "left").select(
        "text_key", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared")
    )


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [np.frombuffer(x.as_py(), np.int64) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int64()))], ["text_key", "grams"])


def _may_link(params: SketchParams, n: str, shared: str, n_2: str, shared_2: str):
    common = F.least(shared, shared_2)
    return common >= params.similarity * (F.col(n) + F.col(n_2) - common)


def _pairs(found: DataFrame) -> DataFrame:
    """The two columns of ``found`` as a and b in order, each pair once."""
    x, y = (F.col(c) for c in found.columns)
    return found.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _mixed_buckets(table: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the buckets that hold texts of several components, with the component."""
    labelled = table.join(found, table.text_key == found.node, "left").select(
        *table.columns, F.coalesce("component", "text_key").alias("component")
    )
    ends = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y"))
    return labelled.join(ends.where("x != y").select("band"), "band", "left_semi")


def _classes(docs: DataFrame, keys: DataFrame, params: SketchParams) -> DataFrame:
    found = text_classes(docs, params)
    classed = keys.join(found, keys.text_key == found.node, "left").select(
        "doc_id", "text_key", F.coalesce("component", "text_key").alias("component")
    )
    classes = classed.groupBy("component").agg(
        F.min("doc_id").alias("class_id"),
        F.count("*").alias("copies"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("first"),
    )
    joined = classed.join(classes, "component")
    keeps = joined.doc_id.eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return joined.select("doc_id", "text_key", "class_id", "copies", keeps.alias("keeps"))


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SketchParams = SketchParams()
) -> DataFrame:
    """The rows of ``df`` that stay: one of each class (smallest id, see
    ``near_duplicate_classes``); of equal such rows one. All columns pass through."""
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    rows = df.select(F.struct("*").alias("row")).select(
        "row", F.col(f"row.{id_col}").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key")
    )
    keys = materialize(rows.select("doc_id", "text_key"))
    kept = (
        _classes(rows.select("doc_id", "text"), keys, params)
        .where("keeps")
        .select(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"))
        .distinct()
    )
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_key") == F.col("kept_key"))
    matched = rows.select("row", "doc_id", "text_key").join(kept, same, "left_semi")
    return matched.dropDuplicates(["doc_id", "text_key"]).select("row.*")
