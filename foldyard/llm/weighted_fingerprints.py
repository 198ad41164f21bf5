"""Document fingerprints by consistent weighted sampling.

Terms are words, weighted by how often they stand in the text. Each of ``samples``
samples takes, for every term, r and c from Gamma(2, 1) and b from a uniform (all
derived from a hash of term and sample), t = floor(ln w / r + b) and the value
ln c - r * (t - b + 1); the term with the least value, together with its t, is the
sample. Two texts agree on a sample with probability equal to their generalised
Jaccard similarity. A fingerprint keeps 16 bits of each sample.

Texts are handled in blocks of bounded words: each distinct word of a block is drawn
once, so tasks need a bounded amount of memory for texts of any number; one text is one
unit, whose memory grows with its distinct words only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import materialize
from .hashing import BASES, mixed, text_blocks

SAMPLES = 64
#: Distinct words of a block whose draws are kept at once.
TERM_CHUNK = 100_000
#: Words, or (text, word) pairs, worked on at once: arrays that fit a core's cache.
STEP = 1024


def _uniform(bits: np.ndarray) -> np.ndarray:
    """In (0, 1), from the upper 24 of 32 bits."""
    return ((bits >> np.uint64(8)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def _draw(terms: np.ndarray, samples: int):
    """r, ln c and b for each term and sample."""
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    seeds = mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(BASES[0]))
    x = mixed(terms[:, None] ^ seeds[None, :])
    r = -np.log(_uniform(x >> half) * _uniform(x & low))
    x = mixed(x + np.uint64(BASES[1]))
    c = np.log(-np.log(_uniform(x >> half) * _uniform(x & low)))
    b = _uniform(mixed(x + np.uint64(BASES[0])) >> half)
    return r, c, b


def _packed(value: np.ndarray, terms: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A number that sorts by value and carries 16 bits of (term, t), never 0."""
    bits = value.view(np.int32)
    rank = (bits ^ ((bits >> 31) & np.int32(0x7FFFFFFF))).astype(np.int64) + (1 << 31)
    payload = mixed(terms + t.astype(np.int64).view(np.uint64) * np.uint64(BASES[1])) >> np.uint64(48)
    return (rank.astype(np.uint64) << np.uint64(32)) | np.maximum(payload, np.uint64(1))


def _samples(r, c, b, log_weight, terms) -> np.ndarray:
    t = np.floor(log_weight / r + b)
    return _packed(c - r * (t - b + np.float32(1)), terms, t)


def signatures(texts: list[str], samples: int = SAMPLES) -> np.ndarray:
    """A row of ``samples`` 16-bit values for each text; zeros for a text without words."""
    split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    vocabulary = {w: i for i, w in enumerate({w for ws in split for w in ws})}
    if not vocabulary:
        return np.zeros((len(texts), samples), np.uint16)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, vocabulary), np.uint64, len(vocabulary))
    place = vocabulary.__getitem__
    ids = np.fromiter((place(w) for ws in split for w in ws), np.int64, int(counts.sum()))
    pairs, weights = np.unique(np.repeat(np.arange(len(texts)), counts) * len(hashes) + ids, return_counts=True)
    docs, terms = pairs // len(hashes), pairs % len(hashes)
    out = np.full((len(texts), samples), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), TERM_CHUNK):
        chunk = hashes[start : start + TERM_CHUNK]
        here = slice(None)
        if len(hashes) > TERM_CHUNK:
            here = np.flatnonzero((terms >= start) & (terms < start + len(chunk)))
        _lower(out, docs[here], terms[here] - start, weights[here], chunk, samples)
    out[counts == 0] = 0
    return (out & np.uint64(0xFFFF)).astype(np.uint16)


def _lower(out, docs, at, weights, terms, samples: int) -> None:
    """Lower ``out`` to the least packed sample of each document; pairs come by document.

    The sample of a word that stands once depends on the word alone and is made once.
    """
    several = np.unique(at[weights > 1])
    kept = np.full(len(terms), -1)
    kept[several] = np.arange(len(several))
    draws = [np.empty((len(several), samples), np.float32) for _ in range(3)]
    once = np.empty((len(terms), samples), np.uint64)
    for s in range(0, len(terms), STEP):
        part = slice(s, s + STEP)
        found = _draw(terms[part], samples)
        once[part] = _samples(*found, np.float32(0), terms[part, None])
        own = np.flatnonzero(kept[part] >= 0)
        for kind, values in zip(draws, found):
            kind[kept[part][own]] = values[own]
    logs = np.log(weights.astype(np.float32))
    for s in range(0, len(docs), STEP):
        part = slice(s, s + STEP)
        d, a = docs[part], at[part]
        values = once[a]
        many = np.flatnonzero(weights[part] > 1)
        if len(many):
            x = kept[a[many]]
            values[many] = _samples(*(kind[x] for kind in draws), logs[part][many, None], terms[a[many], None])
        first = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        out[d[first]] = np.minimum(out[d[first]], np.minimum.reduceat(values, first, axis=0))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """One row per input row: doc_id, fingerprint (hex, four digits a sample).

    Null and empty texts, and those without a word, have a fingerprint of zeros. Equal
    texts have equal fingerprints. Null ids and repeated rows are kept as they are;
    other columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    out = StructType([docs.schema["doc_id"]]).add("fingerprint", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for s in text_blocks(texts):
                found = [row.byteswap().tobytes().hex() for row in signatures(texts[s], samples)]
                ids = batch.column(0).slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.mapInArrow(run, out)


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by as many from the following text."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


COMPARED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(texts: list[str], samples: int) -> list[list]:
    """Columns of COMPARED for all texts but the last, each against its next."""
    edited = [edited_text(a, b) for a, b in zip(texts, texts[1:])]
    n = len(edited)
    both = signatures([*texts, *edited], samples)
    own, changed = both[: n + 1], both[n + 1 :]
    return [
        [len(t) for t in texts[:n]],
        [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
        [row.byteswap().tobytes().hex() for row in own[:n]],
        [row.byteswap().tobytes().hex() for row in changed],
        (own[:n] == changed).mean(axis=1).tolist() if n else [],
        (own[:n] == own[1:]).mean(axis=1).tolist() if n else [],
    ]


def compare_with_next(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES
) -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next (see ``edited_text``; the next document
    by descending id, after the last the first).

    Rows of equal id are ordered by a hash of their text, null ids come last; a single
    row is its own next. Null texts count as empty. Rows are shuffled once, into sorted
    ranges; each task reads its range as a stream and the two ends of the ranges, one
    row each, are put together afterwards.
    """
    docs = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(text_col, F.lit("")).alias("text"),
        F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("tie"),
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    ranges = docs.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    result = StructType([docs.schema["doc_id"], *StructType.fromDDL(COMPARED)])
    out = StructType([*result, *StructType.fromDDL("edge string, task int, edge_text string")])
    names = out.fieldNames()
    types = [f.type for f in _arrow(result)] + [pa.string(), pa.int32(), pa.string()]

    def row(edge: str, doc_id: pa.Array, text: str, task: int) -> pa.RecordBatch:
        values = [doc_id.cast(types[0])] + [pa.nulls(1, t) for t in types[1:-3]]
        values += [pa.array([edge]), pa.array([task], pa.int32()), pa.array([text])]
        return pa.RecordBatch.from_arrays(values, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            if not texts:
                continue
            if last is None:
                yield row("head", ids.slice(0, 1), texts[0], task)
            else:
                ids, texts = pa.concat_arrays([last[0], ids]), [last[1], *texts]
            for s in text_blocks(texts[:-1]):
                columns = _compare(texts[s.start : s.stop + 1], samples)
                n = s.stop - s.start
                values = [ids.slice(s.start, n)] + [pa.array(c, t) for c, t in zip(columns, types[1:-3])]
                values += [pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())]
                yield pa.RecordBatch.from_arrays(values, names)
            last = ids.slice(len(texts) - 1, 1), texts[-1]
        if last is not None:
            yield row("tail", *last, task)

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, pair in enumerate(zip(a, b)):
                columns = [pa.array(c, t) for c, t in zip(_compare(list(pair), samples), types[1:-3])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *columns], names[:-3])

    found = materialize(ranges.mapInArrow(run, out))
    tails = found.where("edge = 'tail'").select("doc_id", "task", F.col("edge_text").alias("text"))
    heads = found.where("edge = 'head'").select(F.col("task").alias("head_task"), F.col("edge_text").alias("following"))
    tasks = heads.select("head_task")  # one row for each task that had rows
    following = tasks.select(
        F.col("head_task").alias("task"), F.lead("head_task").over(Window.orderBy("head_task")).alias("after")
    )
    first = tasks.agg(F.min("head_task")).first()[0]
    linked = following.select("task", F.coalesce("after", F.lit(first)).cast("int").alias("head_task"))
    ends = tails.join(linked, "task").join(heads, "head_task").select("doc_id", "text", "following")
    whole = found.where("edge is null").select(*result.fieldNames())
    return whole.unionByName(ends.mapInArrow(join_ends, result))


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
