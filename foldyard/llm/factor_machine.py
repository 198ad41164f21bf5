"""Quality classifier: a factorisation machine over words, structure and metadata.

Inputs of a document: its words, lower-cased (A-Z) and hashed, weighted by how often
they stand there and scaled to length 1; structure statistics and metadata, each cut
into levels with one input a level. Every input has a weight and a vector of
``factors``; pairs of inputs interact by the product of their vectors, which the
sum-of-squares identity sums in time linear in the inputs:
1/2 * sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

The model is fitted on a bounded sample of labelled rows (``max_rows``, by a hash of the
id, none of them held out) in one task, and scores every document in Arrow batches. It
is small (under 3 MB), which bounds its broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .hashing import ship, shipped, text_blocks


@dataclass(frozen=True)
class FmParams:
    """max_rows: labelled rows to fit on at most. folds, held_fold: rows with
    crc32(id) mod folds = held_fold are held out. threshold: score of a predicted 1.
    steps: gradient steps in all, whatever the number of rows."""

    max_rows: int = 20_000
    folds: int = 5
    held_fold: int = 0
    threshold: float = 0.3
    factors: int = 8
    steps: int = 3000
    batch: int = 32
    rate: float = 0.1
    shrink: float = 1e-4
    seed: int = 5


WORD_INPUTS = 1 << 16
LEVELS = 16
#: Structure statistics in order; the last two are metadata.
STATISTICS = (
    "words", "word_length", "upper", "digits", "symbols", "marks", "spaces", "distinct", "repeats",
    "lines", "line_words", "repeated_lines", "ended_lines", "given_chars", "missing",
)
INPUTS = WORD_INPUTS + LEVELS * len(STATISTICS)

#: Kinds of bytes: 1 capital, 2 digit, 3 symbol, 4 mark, 5 white space.
KINDS = np.zeros(256, np.uint8)
for _kind, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&|<>{}[]\\^~=_@+", b".,;:!?", b" \t\n\x0b\x0c\r"), 1):
    KINDS[list(_chars)] = _kind


def _log_level(x: np.ndarray) -> np.ndarray:
    """0 for 0, then one level for each doubling."""
    return np.minimum(np.ceil(np.log2(x + 1)), LEVELS - 1).astype(np.int64)


def _share_level(x: np.ndarray) -> np.ndarray:
    """Levels of a share, finer near 0."""
    return np.minimum(np.ceil(np.sqrt(np.clip(x, 0, 1)) * (LEVELS - 1)), LEVELS - 1).astype(np.int64)


def features(texts: list[str | None], given_chars: list[int | None]):
    """(inputs, values, first) of all texts, one after another: ``first`` is where each
    text's inputs begin. Every text has its level inputs, the empty one too."""
    n = len(texts)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, n)
    data = KINDS[np.frombuffer(b"".join(raw), np.uint8)]
    owner = np.repeat(np.arange(n), sizes)
    kinds = np.bincount(owner * 6 + data, minlength=6 * n).reshape(n, 6)
    split = [x.lower().split() for x in raw]
    counts = np.fromiter(map(len, split), np.int64, n)
    table = {w: zlib.crc32(w) % WORD_INPUTS for w in {w for ws in split for w in ws}}
    ids = np.fromiter((table[w] for ws in split for w in ws), np.int64, int(counts.sum()))
    word_owner = np.repeat(np.arange(n), counts)
    repeats = np.bincount(word_owner[1:][(ids[1:] == ids[:-1]) & (word_owner[1:] == word_owner[:-1])], minlength=n)
    pairs, times = np.unique(word_owner * WORD_INPUTS + ids, return_counts=True)
    pair_owner = pairs // WORD_INPUTS
    squares = np.bincount(pair_owner, weights=times.astype(np.float64) ** 2, minlength=n)
    distinct = np.bincount(pair_owner, minlength=n)
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in raw]
    n_lines = np.fromiter(map(len, lines), np.int64, n)
    unlike = np.fromiter((len(set(x)) for x in lines), np.int64, n)
    ended = np.fromiter((sum(x.rstrip()[-1:] in b".!?\"')" for x in ls) for ls in lines), np.int64, n)
    chars, some_words, some_lines = np.maximum(sizes, 1), np.maximum(counts, 1), np.maximum(n_lines, 1)
    given = np.array([-1 if c is None else max(0, c) for c in given_chars], np.int64)
    levels = [
        _log_level(counts),
        np.minimum((sizes - kinds[:, 5]) / some_words, LEVELS - 1).astype(np.int64),
        _share_level(kinds[:, 1] / chars),
        _share_level(kinds[:, 2] / chars),
        _share_level(kinds[:, 3] / chars),
        _share_level(kinds[:, 4] / chars),
        _share_level(kinds[:, 5] / chars),
        _share_level(distinct / some_words),
        _share_level(repeats / some_words),
        _log_level(n_lines),
        _log_level(counts / some_lines),
        _share_level(1 - unlike / some_lines),
        _share_level(ended / some_lines),
        _log_level(np.maximum(given, 0)),
        (given < 0).astype(np.int64),
    ]
    level_inputs = np.stack([WORD_INPUTS + i * LEVELS + x for i, x in enumerate(levels)], 1)
    owners = np.concatenate([np.repeat(np.arange(n), len(levels)), pair_owner])
    inputs = np.concatenate([level_inputs.ravel(), pairs % WORD_INPUTS])
    values = np.concatenate(
        [np.full(n * len(levels), len(levels) ** -0.5), times / np.sqrt(np.maximum(squares, 1))[pair_owner]]
    ).astype(np.float32)
    order = np.argsort(owners, kind="stable")
    per_text = len(levels) + distinct
    return inputs[order], values[order], np.cumsum(per_text) - per_text


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def parts(self, inputs: np.ndarray, values: np.ndarray, first: np.ndarray):
        """Raw scores, and the factor sums that the gradient needs."""
        vx = self.factors[inputs] * values[:, None]
        sums = np.add.reduceat(vx, first, axis=0)
        squares = np.add.reduceat(vx * vx, first, axis=0)
        linear = np.add.reduceat(self.weights[inputs] * values, first)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums, vx

    def scores(self, inputs: np.ndarray, values: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(first):
            return np.zeros(0)
        raw = self.parts(inputs, values, first)[0].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def _batches(rng, rows: int, params: FmParams):
    """Batches of shuffled passes over the rows, ``steps`` of them in all."""
    left = params.steps
    while left > 0 and rows:
        order = rng.permutation(rows)
        cuts = [order[s : s + params.batch] for s in range(0, rows, params.batch)][:left]
        left -= len(cuts)
        yield cuts


def fit(examples: list, labels: np.ndarray, params: FmParams) -> Machine:
    """Adaptive stochastic gradient on the log loss; examples are (inputs, values)."""
    rng = np.random.default_rng(params.seed)
    share = (labels.sum() + 1) / (len(labels) + 2)
    machine = Machine(
        float(np.log(share / (1 - share))),
        np.zeros(INPUTS, np.float32),
        (rng.standard_normal((INPUTS, params.factors)) * 0.05).astype(np.float32),
    )
    seen_w, seen_v, seen_b = np.full(INPUTS, 1e-3, np.float32), np.full(machine.factors.shape, 1e-3, np.float32), 1e-3
    for order in _batches(rng, len(labels), params):
        for at in order:
            inputs = np.concatenate([examples[i][0] for i in at])
            values = np.concatenate([examples[i][1] for i in at])
            sizes = np.array([len(examples[i][0]) for i in at])
            raw, sums, vx = machine.parts(inputs, values, np.cumsum(sizes) - sizes)
            slope = ((1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[at]) / len(at)).astype(np.float32)
            own, where = np.unique(inputs, return_inverse=True)
            each = np.repeat(slope, sizes) * values
            g = np.bincount(where, each, len(own)).astype(np.float32) + params.shrink * machine.weights[own]
            gv = each[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
            by_input = np.argsort(where, kind="stable")
            first = np.flatnonzero(np.diff(where[by_input], prepend=-1))
            gv = np.add.reduceat(gv[by_input], first, axis=0) + params.shrink * machine.factors[own]
            seen_w[own] += g * g
            seen_v[own] += gv * gv
            machine.weights[own] -= params.rate * g / np.sqrt(seen_w[own])
            machine.factors[own] -= params.rate * gv / np.sqrt(seen_v[own])
            seen_b += float(slope.sum()) ** 2
            machine.bias -= params.rate * float(slope.sum()) / seen_b**0.5
    return machine


SAMPLE = "one int, doc string, tie long, quality double, inputs binary, amounts binary"


def _sample_inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of the sample to their inputs, a few at a time."""
    for batch in batches:
        texts, given = batch.column("text").to_pylist(), batch.column("given").to_pylist()
        for s in text_blocks([t or "" for t in texts]):
            inputs, values, first = features(texts[s], given[s])
            ends = np.append(first[1:], len(inputs))
            own = batch.slice(s.start, s.stop - s.start)
            packed = [
                pa.array([x[a:b].tobytes() for a, b in zip(first, ends)], pa.binary())
                for x in (inputs.astype(np.int32), values)
            ]
            kept = [own.column(c) for c in ("one", "doc", "tie", "quality")]
            yield pa.RecordBatch.from_arrays([*kept, *packed], ["one", "doc", "tie", "quality", "inputs", "amounts"])


def _fit_rows(params: FmParams):
    def run(key, table):
        """The whole bounded sample in one task, in the order of its hashes."""
        table = table.sort_by([("tie", "ascending"), ("doc", "ascending")])
        examples = [
            (np.frombuffer(i.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32))
            for i, v in zip(table["inputs"], table["amounts"])
        ]
        machine = fit(examples, table["quality"].to_numpy().astype(np.float32), params)
        return pa.table(
            {
                "bias": [machine.bias],
                "weights": [machine.weights.tobytes()],
                "factors": [machine.factors.tobytes()],
            }
        )

    return run


def train(
    df: DataFrame, labels: DataFrame, params: FmParams = FmParams(), id_col: str = "doc_id", text_col: str = "text"
) -> Machine:
    """A machine from at most ``max_rows`` labelled rows; of several labels of one id
    the mean, rounded up from a half. Without a labelled row all scores are one half."""
    as_text = F.col(id_col).cast("string")
    sample = (
        labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg((F.avg("quality") >= 0.5).cast("double").alias("quality"))
        .withColumn("hash", F.crc32(F.col("label_id").cast("string").cast("binary")))
        .where(F.col("hash") % params.folds != params.held_fold)
        .withColumn("tie", F.xxhash64("label_id"))
        .orderBy("tie", "label_id")
        .limit(params.max_rows)
    )
    rows = (
        df.select(id_col, F.col(text_col).alias("text"), given_chars(df).alias("given"), as_text.alias("doc"))
        .join(F.broadcast(sample), F.col(id_col) == F.col("label_id"))
        .dropDuplicates(["label_id"])
        .select(F.lit(0).alias("one"), "doc", "tie", "text", "given", "quality")
    )
    inputs = rows.mapInArrow(_sample_inputs, SAMPLE)
    found = inputs.groupBy("one").applyInArrow(_fit_rows(params), "bias double, weights binary, factors binary").collect()
    if not found:
        return Machine(0.0, np.zeros(INPUTS, np.float32), np.zeros((INPUTS, params.factors), np.float32))
    row = found[0]
    return Machine(
        row["bias"],
        np.frombuffer(row["weights"], np.float32),
        np.frombuffer(row["factors"], np.float32).reshape(INPUTS, -1),
    )


def given_chars(df: DataFrame):
    return F.col("n_chars").cast("long") if "n_chars" in df.columns else F.lit(None).cast("long")


def score(
    df: DataFrame, machine: Machine, params: FmParams = FmParams(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null texts count as empty; empty texts are scored by their levels. The metadata
    input is the column n_chars, where there is one and it is not null. Null ids are
    held out or not by the hash of no text. Equal rows have equal scores.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), given_chars(df).alias("given"))
    scored = StructType([docs.schema["doc_id"]]).add("score", "double")
    arrow = to_arrow_schema(scored)
    shared = ship(df.sparkSession, machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shipped(shared)
        for batch in batches:
            texts, given = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for s in text_blocks([t or "" for t in texts]):
                found = machine.scores(*features(texts[s], given[s]))
                ids = batch.column(0).slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found)], arrow.names)

    hash_ = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.mapInArrow(run, scored).select(
        "doc_id",
        (hash_ % params.folds == params.held_fold).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )
