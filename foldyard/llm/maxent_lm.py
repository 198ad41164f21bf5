"""Hashed maximum-entropy language model with a class-factored softmax.

P(token | history) = P(class | history) * P(member | class, history) * P(token | cell).
There are 32 classes of 32 members, so 1,024 cells. Half are one frequent word each;
in the others words share a cell by their ending, and inside a cell a word has its
smoothed share of the cell's training tokens, with one place for all unseen words. The
first two factors are softmaxes over hashed feature weights: the previous word, the
words two and three back (skips) and the previous two words together.

These tables have one size for any corpus. What grows with it are the word pairs: every
pair of neighbouring training words is counted in a hashed slot, about a thousand slots a
token, and with n tokens after the word before and c of them this token
    P = (c + g * P(token | history)) / (n + g),  g = pair_scale * (n + 1) ** pair_power,
so a context that the corpus shows often speaks for itself and a rare or new one leaves
the word to the features. Pairs are never on the driver or in a broadcast: they travel by
hash range as word counts do, and each block gets back the counts of its own pairs.

Training: weights start at 0 over unigram biases. Each round takes the training
documents of one slice, sums observed and expected feature counts over all tokens (their
difference is the gradient of the log-likelihood) and steps every weight by the scaled
log ratio of the two, which has the gradient's sign and its zeros. Counts are integers or
sums over all tokens of a slice, so neither the layout nor the number of tasks matters
but for rounding.

Work is done on blocks: a task turns about 1.5 million words into small local numbers.
Word counts travel as packed arrays, by hash range, and come back to the blocks that hold
the words, so no task or driver holds the vocabulary. The model itself has a fixed size
(6 MB) and is the only broadcast. Counts of words cover all training documents; the
driver sees the model, its sums and the 511 most frequent words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import ArrayType, StructField, StructType

from ..session import discard, materialize, scratch_path
from .hashing import BASES, by_range, mixed, ship, shipped

CLASSES = MEMBERS = 32
CELLS = CLASSES * MEMBERS
HEAD = CELLS // 2
FEATURES = 4
#: Words of a history.
BACK = 3
#: Before the first word of a document.
START = CELLS
BLOCK_WORDS = 1_500_000
#: Text that is split into words at once, about.
PIECE_BYTES = 1 << 20
#: Words for each hash range of the vocabulary, about.
RANGE_WORDS = 4_000_000
#: Training tokens for each task of a round, about: every task sends sums as large as
#: the model, so they must stay small against the tokens.
TASK_TOKENS = 24_000_000
#: Tokens whose places are in memory at once, about; whose distinct cases are counted
#: together, about; cases whose scores are made at once; cases whose shares are summed in
#: single precision before they join the others.
STEP_TOKENS = 100_000
COUNT_TOKENS = 500_000
SCORE_TOKENS = 4_096
SUM_TOKENS = 4 * SCORE_TOKENS
#: Products of exponentials below this are worked out as sums of logs instead.
TINY = 1e-30


@dataclass(frozen=True)
class LmParams:
    """folds, held_fold: documents with crc32(id) mod folds = held_fold do not train.
    rounds: of training, each on its own slice. class_rows, member_rows: of the hashed
    weight tables (powers of two up to 65,536). smoothing: added to both counts, times
    the unigram share. rate: of a step, over the number of features. pair_scale,
    pair_power: how much weight the features keep beside the counted pairs."""

    folds: int = 7
    held_fold: int = 2
    rounds: int = 3
    class_rows: int = 1 << 14
    member_rows: int = 1 << 15
    smoothing: float = 8.0
    rate: float = 1.3
    pair_scale: float = 3.0
    pair_power: float = 0.85


#: The number of the end-of-text token.
END = xxhash.xxh64_intdigest(b"\x00end")
#: What stands before the first word of a document, in pairs.
BEFORE = xxhash.xxh64_intdigest(b"\x00start")


def id_hash(doc_id) -> int:
    """crc32 of the id as text; of a null id, of no text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode())


def ending(word: bytes) -> int:
    """A number below HEAD, equal for words with the same last three bytes."""
    return (zlib.crc32(word[-3:]) * 0x9E3779B1 & 0xFFFFFFFF) % HEAD


# -- blocks of tokens ---------------------------------------------------------------

BLOCK = "block long, part int, words long, keys binary, counts binary, endings binary, tokens binary, lengths binary"


def _packed(values: np.ndarray) -> bytes:
    """Byte planes of whole numbers, as many as the largest needs; upper ones compress well."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    size = 4 if width <= 4 else 8
    return bytes([width]) + values.astype(f"<u{size}").view(np.uint8).reshape(-1, size)[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    values = planes[0].astype(np.int32 if data[0] < 4 else np.int64)
    for k in range(1, data[0]):
        values |= planes[k].astype(values.dtype) << 8 * k
    return values


def neighbours(tokens: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The token before each token; ``first`` before a document."""
    before = np.empty(len(tokens), np.int32)
    before[1:] = tokens[:-1]
    before[np.cumsum(lengths) - lengths] = first
    return before


def pair_hashes(keys: np.ndarray, tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """An even hash of each token's pair (token before, token); ``tokens`` are places in
    ``keys``."""
    named = np.append(keys, np.uint64(BEFORE))
    hashes = named[neighbours(tokens, lengths, len(keys))]
    hashes *= np.uint64(BASES[0])
    hashes += named[tokens]
    for part in (hashes[i : i + STEP_TOKENS] for i in range(0, len(hashes), STEP_TOKENS)):
        part[:] = mixed(part) & ~np.uint64(1)
    return hashes


def pair_slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits behind the range number: a pair's slot in its range."""
    return (hashes << np.uint64(bits)) >> np.uint64(32)


def _block_schema(id_type) -> StructType:
    return StructType([StructField("doc_ids", ArrayType(id_type)), *StructType.fromDDL(BLOCK)])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, A-Z lowered, one after the other, and how many each text has."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data[int(bounds[0]) : int(bounds[-1])].to_pybytes().lower() if data else b"", np.uint8)
    bounds = bounds - bounds[0]
    inside = (data != 32) & (data - np.uint8(9) > 4)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[(bounds > 0) & (bounds < len(data))]  # a word ends with its text
    first[edges], last[edges - 1] = inside[edges], inside[edges - 1]
    first, last = np.flatnonzero(first), np.flatnonzero(last)
    ends = np.zeros(len(first) + 1, np.int32)
    np.cumsum(last - first + 1, out=ends[1:])
    words = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(first, bounds))


def _bytes_of(words: pa.Array) -> Iterator[bytes]:
    """As ``to_pylist`` gives them, but sooner."""
    _, offsets, data = words.buffers()
    data = data.to_pybytes() if data else b""
    cuts = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else []
    return (data[a:b] for a, b in pairwise(cuts))


def _pieces_of(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of PIECE_BYTES after their first text at most."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(size // PIECE_BYTES)) + 1
    return pairwise([0, *cuts.tolist(), len(texts)])


class _Block:
    """Ids of documents, tokens of each, and all words as numbers of each piece's own words."""

    def __init__(self) -> None:
        self.ids: list = []
        self.lengths: list[np.ndarray] = []
        self.words: list[pa.Array] = []
        self.size = 0

    def add(self, ids: list, words: pa.Array, counts: np.ndarray) -> None:
        self.ids += ids
        self.lengths.append(counts + 1)
        self.words.append(words.dictionary_encode())
        self.size += len(words) + len(ids)

    def numbered(self) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words, each token's place among them (the end comes last), and
        the documents' lengths."""
        lengths = np.concatenate(self.lengths).astype(np.int64)
        words = pa.chunked_array(self.words).unify_dictionaries().combine_chunks()
        names = words.dictionary
        tokens = np.full(self.size, len(names), np.int32)
        word = np.ones(self.size, bool)
        word[np.cumsum(lengths) - 1] = False
        tokens[word] = words.indices.to_numpy()
        return names, tokens, lengths


def _make_blocks(params: LmParams, schema: StructType, bits: int):
    arrow = to_arrow_schema(schema)

    def flush(block: _Block, number: int) -> pa.RecordBatch:
        names, tokens, lengths = block.numbered()
        hashes = np.fromiter([*map(xxhash.xxh64_intdigest, _bytes_of(names)), END], np.uint64, len(names) + 1)
        keys, at = np.unique(hashes, return_inverse=True)
        endings = np.zeros(len(keys), np.uint16)
        tails = pc.binary_slice(names, -3).dictionary_encode()
        of_tail = np.fromiter(map(ending, tails.dictionary.to_pylist()), np.uint16, len(tails.dictionary))
        endings[at[:-1]] = of_tail[tails.indices.to_numpy()]
        tokens = at[tokens]
        held = np.fromiter((id_hash(d) % params.folds == params.held_fold for d in block.ids), bool, len(lengths))
        counts = np.bincount(tokens[np.repeat(~held, lengths)], minlength=len(keys)).astype(np.uint32)
        rank = np.empty(len(keys), np.int32)
        rank[np.argsort(-np.bincount(tokens, minlength=len(keys)), kind="stable")] = np.arange(len(keys))
        rows = [(block.ids, number, -1, len(keys), rank.tobytes(), None, None, _packed(rank[tokens]), lengths.tobytes())]
        rows += [
            (None, number, p, s.stop - s.start, keys[s].tobytes(), counts[s].tobytes(), endings[s].tobytes(), None, None)
            for p, s in by_range(keys, bits)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], arrow.names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        block = _Block()
        for batch in batches:
            for a, b in _pieces_of(batch.column(1)):
                block.add(batch.column(0)[a:b].to_pylist(), *split_words(batch.column(1)[a:b]))
                if block.size >= BLOCK_WORDS:
                    yield flush(block, number)
                    block, number = _Block(), number + 1
        if block.ids:
            yield flush(block, number)

    return run


# -- counts of words ----------------------------------------------------------------

TOP = pa.struct([("key", pa.int64()), ("tokens", pa.int64()), ("ending", pa.int32())])
COUNTED_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("part", pa.int32()),
        ("counts", pa.binary()),
        ("total", pa.int64()),
        ("kinds", pa.int64()),
        ("ends", pa.int64()),
        ("top", pa.list_(TOP)),
        ("ending_sums", pa.list_(pa.float64())),
    ]
)
COUNTED = from_arrow_schema(COUNTED_ARROW)


def _count_range(key, table):
    """Training counts of one hash range: an array back to each block, and its sums.

    The sums stand in a row of block -1: the range's most frequent words, tokens,
    distinct words, and (count + 1) summed by ending.
    """
    part = key[0].as_py()
    sizes = table["words"].to_pylist()
    keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
    counts = np.frombuffer(b"".join(table["counts"].to_pylist()), np.uint32).astype(np.int64)
    endings = np.frombuffer(b"".join(table["endings"].to_pylist()), np.uint16)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    sums = np.add.reduceat(counts[order], first)
    all_counts = np.empty(len(keys), np.int64)
    all_counts[order] = np.repeat(sums, np.diff(np.append(first, len(keys))))
    names, own = ranked[first], endings[order][first]
    known = sums > 0
    top = np.lexsort((names, -sums))[:HEAD]
    top = top[known[top] & (names[top] != np.uint64(END))]
    frequent = [
        {"key": k, "tokens": n, "ending": e}
        for k, n, e in zip(names[top].view(np.int64).tolist(), sums[top].tolist(), own[top].tolist())
    ]
    word = known & (names != np.uint64(END))
    by_ending = np.bincount(own[word], weights=sums[word] + 1, minlength=HEAD)
    ends = int(sums[names == np.uint64(END)].sum())
    rows = [(-1, part, None, int(sums.sum()), int(known.sum()), ends, frequent, by_ending.tolist())]
    start = 0
    for block, n in zip(table["block"].to_pylist(), sizes):
        rows.append((block, part, all_counts[start : start + n].tobytes(), None, None, None, None, None))
        start += n
    return pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(COUNTED_ARROW)], schema=COUNTED_ARROW)


@dataclass
class Vocabulary:
    """What the model knows of the words: totals, the words with a cell of their own
    (by hash, sorted), and for the other cells the smoothed tokens in them."""

    tokens: int
    kinds: int
    head_keys: np.ndarray
    head_cells: np.ndarray
    cell_tokens: np.ndarray

    @property
    def documents(self) -> int:
        """Training documents: each has one end, in the first cell."""
        return int(self.cell_tokens[0])

    def inside(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log of a word's share of its cell."""
        return np.where(cells < HEAD, 0.0, np.log((counts + 1) / (self.cell_tokens[cells] + 1)))


def _vocabulary(counted: DataFrame) -> Vocabulary:
    """Totals, and a bounded number of words and endings, whatever the corpus."""
    stats = counted.where("block = -1")
    total = stats.agg(F.sum("total"), F.sum("kinds"), F.sum("ends")).first()
    tokens, kinds, ends = (int(x or 0) for x in total)
    frequent = stats.select(F.explode("top").alias("w")).select("w.*")
    top = frequent.orderBy(F.col("tokens").desc(), "key").limit(HEAD - 1).collect()
    endings = stats.select(F.posexplode("ending_sums").alias("ending", "n")).groupBy("ending").agg(F.sum("n")).collect()
    sums = np.zeros(CELLS)
    for ending_, n in endings:
        sums[HEAD + ending_] = n
    sums[0] = ends  # the end has the first cell, in any corpus
    for i, (_, n, ending_) in enumerate(top):
        sums[1 + i] = n
        sums[HEAD + ending_] -= n + 1
    keys = np.array([np.uint64(END), *(np.uint64(k % (1 << 64)) for k, _, _ in top)], np.uint64)
    by_key = np.argsort(keys)
    return Vocabulary(tokens, kinds, keys[by_key], by_key, sums)


ENCODED = (
    "block long, keys binary, tokens binary, cells binary, counts binary, lengths binary, known binary, base binary"
)


def _encoded_schema(id_type, rounds: int) -> StructType:
    slices = ", ".join(f"cells_{r} binary, lengths_{r} binary" for r in range(rounds))
    return StructType([StructField("doc_ids", ArrayType(id_type)), *StructType.fromDDL(f"{ENCODED}, {slices}")])


def _encode_blocks(words: Vocabulary, params: LmParams, schema: StructType):
    """Keys, cells and corpus counts of a block's words by their local numbers, the base
    scores, and for each round the cells and lengths of the documents that train in it."""
    arrow = to_arrow_schema(schema)
    unseen = 1.0 / (words.tokens + words.kinds + 1)

    def run(key, table, answers):
        rows = table.filter(pc.equal(table["part"], -1))
        if not rows.num_rows:
            return arrow.empty_table()
        vocab = table.select(["part", "keys", "endings"]).filter(pc.greater_equal(table["part"], 0)).sort_by("part")
        got = answers.sort_by("part")
        keys = np.frombuffer(b"".join(vocab["keys"].to_pylist()), np.uint64)
        endings = np.frombuffer(b"".join(vocab["endings"].to_pylist()), np.uint16)
        counts = np.frombuffer(b"".join(got["counts"].to_pylist()), np.int64)
        cells = HEAD + endings.astype(np.int64)
        at = np.minimum(np.searchsorted(words.head_keys, keys), len(words.head_keys) - 1)
        head = words.head_keys[at] == keys
        cells[head] = words.head_cells[at[head]]
        base = np.log10((counts + 1) * unseen)
        row = rows.to_pylist()[0]
        rank = np.frombuffer(row["keys"], np.int32)
        by_rank = np.empty(len(rank), np.int32)
        by_rank[rank] = np.arange(len(rank))
        tokens = by_rank[_unpacked(row["tokens"])]
        lengths = np.frombuffer(row["lengths"], np.int64)
        starts = np.cumsum(lengths) - lengths
        hashes = np.fromiter(map(id_hash, row["doc_ids"]), np.int64, len(lengths))
        round_of = np.where(hashes % params.folds == params.held_fold, -1, hashes // params.folds % params.rounds)
        of_token, cells_of = np.repeat(round_of.astype(np.int8), lengths), cells.astype(np.uint16)[tokens]
        slices = []
        for r in range(params.rounds):
            slices.append(pa.array([cells_of[of_token == r].tobytes()]))
            slices.append(pa.array([lengths[round_of == r].tobytes()]))
        return pa.table(
            [
                pa.array([row["doc_ids"]], arrow.field("doc_ids").type),
                pa.array([row["block"]]),
                pa.array([keys[by_rank].tobytes()]),
                pa.array([row["tokens"]]),
                pa.array([cells[by_rank].astype(np.uint16).tobytes()]),
                pa.array([counts[by_rank].tobytes()]),
                pa.array([row["lengths"]]),
                pa.array([np.add.reduceat((counts > 0)[tokens], starts, dtype=np.int64).tobytes()]),
                pa.array([np.add.reduceat(base[tokens], starts).tobytes()]),
                *slices,
            ],
            schema=arrow,
        )

    return run


# -- counts of pairs ----------------------------------------------------------------

PAIRS = "block long, part int, slots binary, counts binary"
ANSWERS = "block long, part int, counts binary"


def _block_pairs(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each token's pair, and the documents' lengths."""
    lengths = np.frombuffer(row["lengths"], np.int64)
    hashes = pair_hashes(np.frombuffer(row["keys"], np.uint64), _unpacked(row["tokens"]), lengths)
    return hashes, lengths


def _send_pairs(params: LmParams, bits: int):
    """The distinct pairs of each block with their training counts, by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                hashes, lengths = _block_pairs(row)
                train = np.fromiter((id_hash(d) % params.folds != params.held_fold for d in row["doc_ids"]), bool, len(lengths))
                hashes |= np.repeat(train, lengths).astype(np.uint64)  # the bit that hashes leave free
                hashes.sort()
                pairs, counts, _ = _runs(hashes >> np.uint64(1), (hashes & np.uint64(1)).astype(np.int64))
                pairs <<= np.uint64(1)
                slots = pair_slots(pairs, bits)
                cuts = list(by_range(pairs, bits))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]] * len(cuts), pa.int64()),
                        pa.array([p for p, _ in cuts], pa.int32()),
                        pa.array([_packed(np.diff(slots[s], prepend=np.uint64(0))) for _, s in cuts]),
                        pa.array([_packed(counts[s]) for _, s in cuts]),
                    ],
                    ["block", "part", "slots", "counts"],
                )

    return run


def _count_pairs(key, table):
    """Training counts of the pairs of one hash range, sent back to each block."""
    slots = [np.cumsum(_unpacked(x), dtype=np.int64) for x in table["slots"].to_pylist()]
    ends = np.cumsum([len(x) for x in slots])
    slots = np.concatenate(slots)
    counts = np.concatenate([_unpacked(x) for x in table["counts"].to_pylist()])
    order = np.argsort(slots)
    _, sums, place = _runs(slots[order], counts[order].astype(np.int64))
    counts = np.empty(len(order), np.int64)
    counts[order] = sums[place]
    rows = [_packed(x) for x in np.split(counts, ends[:-1])]
    return pa.table(
        {
            "block": table["block"],
            "part": pa.array([key[0].as_py()] * len(rows), pa.int32()),
            "counts": pa.array(rows, pa.binary()),
        }
    )


def _found_pairs(row: dict, answers: pa.Table) -> np.ndarray:
    """The corpus count of each token's pair."""
    hashes, _ = _block_pairs(row)
    order = np.argsort(hashes)
    hashes = hashes[order]
    place = np.cumsum(np.append(False, hashes[1:] != hashes[:-1]), dtype=np.int32)
    del hashes
    sums = np.concatenate([_unpacked(x) for x in answers.sort_by("part")["counts"].to_pylist()])
    found = np.empty(len(order), sums.dtype)
    found[order] = sums[place]
    return found


# -- the model ----------------------------------------------------------------------


@dataclass
class Model:
    params: LmParams
    class_bias: np.ndarray  # log share of each class
    member_bias: np.ndarray  # log share of each member in its class
    class_weights: np.ndarray
    member_weights: np.ndarray

    @staticmethod
    def start(words: Vocabulary, params: LmParams) -> "Model":
        shares = (words.cell_tokens + 1).reshape(CLASSES, MEMBERS)
        classes = shares.sum(axis=1)
        return Model(
            params,
            np.log(classes / classes.sum()).astype(np.float32),
            np.log(shares / classes[:, None]).astype(np.float32),
            np.zeros((params.class_rows, CLASSES), np.float32),
            np.zeros((params.member_rows, MEMBERS), np.float32),
        )

    def class_places(self, one: np.ndarray, two: np.ndarray, three: np.ndarray | None = None) -> list[np.ndarray]:
        """Rows of the class weights for each feature, of the cells one, two and three
        back (START if not given); the skip of three comes last."""
        both = one.astype(np.uint64) << np.uint64(24)
        both += two.astype(np.uint64)
        both += np.uint64(2 << 12)
        first, second, third = self.lone_places()
        three = third[START : START + 1].repeat(len(one)) if three is None else third[three]
        return [first[one], second[two], self._class_place(both), three]

    def lone_places(self) -> list[np.ndarray]:
        """Rows of the class weights for each cell (or START) one, two and three back alone."""
        cells = np.arange(CELLS + 1, dtype=np.uint64)
        return [self._class_place(cells + np.uint64(kind << 12)) for kind in (0, 1, 3)]

    def _class_place(self, kinds: np.ndarray) -> np.ndarray:
        return (mixed(kinds + np.uint64(BASES[0])) & np.uint64(self.params.class_rows - 1)).astype(np.uint16)

    def member_place(self, place: np.ndarray, classes: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.params.member_rows - 1)
        return (mixed(place.astype(np.uint64) * np.uint64(CLASSES) + classes.astype(np.uint64)) & mask).astype(np.uint16)

    def scores(self, places: list[np.ndarray], classes: np.ndarray):
        """Raw scores of classes, and of the members of each token's class, with the
        places of the member weights: the logs of what ``Powers`` multiplies."""
        z = self.class_bias + sum_rows(self.class_weights, places)
        inner = [self.member_place(p, classes) for p in places]
        y = self.member_bias[classes] + sum_rows(self.member_weights, inner)
        return z, y, inner


@dataclass
class Powers:
    """e to the power of biases and weights, each row less its largest. Softmaxes of summed
    rows are products of these over their sum; ``logs`` are for the rare ones too small."""

    bias: np.ndarray
    rows: np.ndarray
    logs: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(bias: np.ndarray, weights: np.ndarray) -> "Powers":
        logs = tuple(x - row_max(x) for x in (bias, weights))
        return Powers(*map(np.exp, logs), logs)

    def product(self, own: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
        """Of the bias row ``own`` and a row from each place."""
        out = self.rows.take(places[0], axis=0, mode="clip")
        for p in places[1:]:
            out *= self.rows.take(p, axis=0, mode="clip")
        out *= self.bias if len(self.bias) == 1 else self.bias.take(own, axis=0, mode="clip")
        return out

    def log_sums(self, own: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
        """The logs of ``product``, but for rounding."""
        bias, rows = self.logs
        return sum_rows(rows, places) + (bias if len(bias) == 1 else bias[own])

    def chosen(self, own: np.ndarray, places: list[np.ndarray], column: np.ndarray) -> np.ndarray:
        """The softmax at one column of each row."""
        x = self.product(own, places)
        value = x.reshape(-1).take(np.arange(0, x.size, x.shape[1]) + column)
        share = value.astype(np.float64) / np.maximum(row_sums(x), np.float32(TINY))
        low = np.flatnonzero(~(value > TINY))
        if len(low):
            share[low] = np.exp(log_chosen(self.log_sums(own[low], [p[low] for p in places]), column[low]))
        return share


def row_sums(x: np.ndarray) -> np.ndarray:
    return x @ np.ones(x.shape[1], x.dtype)


def histories(cells: np.ndarray, starts: np.ndarray, lengths: np.ndarray, far: int = 2) -> list[np.ndarray]:
    """The cells one to ``far`` back of each token; START before a document."""
    back = []
    for k in range(1, far + 1):
        past = np.empty(len(cells), np.uint16)
        past[k:] = cells[:-k]
        past[:k] = START
        for i in range(k):
            past[starts[lengths > i] + i] = START
        back.append(past)
    return back


def sum_rows(weights: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    out = weights[places[0]]
    for p in places[1:]:
        out += weights[p]
    return out


def row_max(x: np.ndarray) -> np.ndarray:
    """The largest of each row, as a column: halves against each other, as rows are short."""
    while x.shape[1] % 2 == 0:
        half = x.shape[1] // 2
        x = np.maximum(x[:, :half], x[:, half:])
    return x if x.shape[1] == 1 else x.max(axis=1, keepdims=True)


def softmax(x: np.ndarray) -> np.ndarray:
    """In place."""
    x -= row_max(x)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def log_chosen(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the softmax at one column of each row."""
    top = row_max(x)
    value = x[np.arange(len(x)), chosen] - top[:, 0]
    x -= top
    np.exp(x, out=x)
    return value.astype(np.float64) - np.log(x.sum(axis=1).astype(np.float64))


def _add_rows(total: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
    """total[place] += row, for many tokens: single floats two by two, as complex numbers."""
    half = total.shape[1] // 2
    at = places.astype(np.int64)[:, None] * half + np.arange(half)
    np.add.at(total.view(np.complex64).reshape(-1), at.reshape(-1), rows.view(np.complex64).reshape(-1))


def _steps(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Document ranges of about STEP_TOKENS tokens."""
    first, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        size += n
        if size >= STEP_TOKENS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(lengths):
        yield first, len(lengths)


def _pieces(cells: np.ndarray, lengths: np.ndarray):
    """(document range, cells, lengths, starts) of steps; a long document is one step."""
    ends = np.cumsum(lengths)
    for a, b in _steps(lengths):
        start = int(ends[a] - lengths[a])
        own = lengths[a:b]
        yield a, b, cells[start : int(ends[b - 1])], own, np.cumsum(own) - own


SUMS = "kind string, chunk int, observed binary, expected binary"
CHUNKS = 64


def _sum_counts(model_of):
    """Observed and expected feature counts of a slice's training tokens, by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped(model_of)
        shapes = {"class": model.class_weights.shape, "member": model.member_weights.shape}
        expected = {k: np.zeros(v) for k, v in shapes.items()}
        observed = {k: np.zeros(v, np.int64) for k, v in shapes.items()}
        held: list[np.ndarray] = []
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                own = np.frombuffer(row["lengths"], np.int64)
                cells = np.frombuffer(row["cells"], np.uint16)
                held.append(case_keys(cells, *histories(cells, np.cumsum(own) - own, own, BACK)))
                if sum(map(len, held)) >= COUNT_TOKENS:
                    _count(model, np.concatenate(held), observed, expected)
                    held = []
        if held:
            _count(model, np.concatenate(held), observed, expected)
        for kind in observed:
            size = len(observed[kind]) // CHUNKS
            for c in range(CHUNKS):
                part = slice(c * size, (c + 1) * size)
                if observed[kind][part].any():
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([kind]),
                            pa.array([c], pa.int32()),
                            pa.array([_packed(observed[kind][part].ravel())]),
                            pa.array([expected[kind][part].astype(np.float32).tobytes()]),
                        ],
                        ["kind", "chunk", "observed", "expected"],
                    )

    return run


def _runs(values: np.ndarray, counts: np.ndarray):
    """Distinct values of a sorted array, their summed counts, and each entry's place."""
    new = np.concatenate([[True], values[1:] != values[:-1]])
    first = np.flatnonzero(new)
    return values[first], np.add.reduceat(counts, first), np.cumsum(new) - 1


def case_keys(cells: np.ndarray, one: np.ndarray, two: np.ndarray, three: np.ndarray) -> np.ndarray:
    """(three back, one back, two back, cell) as one number; START three back adds nothing."""
    keys = START - three.astype(np.int64)
    for base, digit in ((CELLS + 1, one), (CELLS + 1, two), (CELLS, cells)):
        keys *= base
        keys += digit
    return keys


def _count(model: Model, keys: np.ndarray, observed, expected) -> None:
    """Add tokens up, given as the numbers of ``case_keys``.

    The class softmax depends on the three cells back alone, the member softmax on these
    and the class, so each distinct case is worked out once and counts as often as it
    stands there. Cases are sorted with the word three back behind the other parts: what
    the other features give and get is made once for all its values. The class comes
    first, as its member rows are then few and near.
    """
    if not len(keys):
        return
    cells, rest = keys % CELLS, keys // CELLS
    pairs, threes = rest % (CELLS + 1) ** 2, rest // (CELLS + 1) ** 2
    _count_cases(model, pairs * (CELLS + 1) + threes, None, observed, expected)
    inner = (cells // MEMBERS * (CELLS + 1) ** 2 + pairs) * (CELLS + 1) + threes
    _count_cases(model, inner, cells % MEMBERS, observed, expected)


def _count_cases(model: Model, keys: np.ndarray, members: np.ndarray | None, observed, expected) -> None:
    """Classes of (one back, two back, three back) cases, or with ``members`` the members
    of (class, one back, two back, three back) cases and what was observed of both."""
    if members is None:
        keys.sort()
        cases, n, _ = _runs(keys, np.ones(len(keys), np.int64))
        kind, powers = "class", Powers.of(model.class_bias[None, :], model.class_weights)
    else:
        keys = keys * MEMBERS + members
        keys.sort()
        whole, counts, _ = _runs(keys, np.ones(len(keys), np.int64))
        cases, n, of_whole = _runs(whole // MEMBERS, counts)
        members = whole % MEMBERS
        kind, powers = "member", Powers.of(model.member_bias, model.member_weights)
    heads, _, of_case = _runs(cases // (CELLS + 1), n)
    threes = START - cases % (CELLS + 1)
    classes, pairs = np.divmod(heads, (CELLS + 1) ** 2)  # class 0 without members
    *near, _ = model.class_places(pairs // (CELLS + 1), pairs % (CELLS + 1))
    skip = model.lone_places()[-1][threes]
    if members is not None:
        own = classes[of_case]
        for p in [*(p[of_case] for p in near), skip]:
            np.add.at(observed["class"].reshape(-1), p.astype(np.int64) * CLASSES + own, n)
        near = [model.member_place(p, classes) for p in near]
        skip = model.member_place(skip, own)
        for p in [*(p[of_case] for p in near), skip]:
            np.add.at(observed["member"].reshape(-1), p[of_whole].astype(np.int64) * MEMBERS + members, counts)
    sums = np.zeros(powers.rows.shape, np.float32)
    for s in range(0, len(cases), SCORE_TOKENS):
        part = slice(s, s + SCORE_TOKENS)
        at = of_case[part]
        here = slice(at[0], at[-1] + 1)
        at = at - at[0]
        places = [p[here] for p in near]
        share = powers.product(classes[here], places).take(at, axis=0, mode="clip")
        share *= powers.rows.take(skip[part], axis=0, mode="clip")
        whole_share = row_sums(share)
        low = np.flatnonzero(~(whole_share > TINY))
        if len(low):
            case = at[low]
            logs = powers.log_sums(classes[here][case], [*(p[case] for p in places), skip[part][low]])
            share[low], whole_share[low] = softmax(logs), 1
        share *= (n[part] / whole_share).astype(np.float32)[:, None]
        _add_rows(sums, skip[part], share)
        new = np.diff(at, prepend=-1) > 0
        of_head = share[new]
        _add_rows(of_head, at[~new], share[~new])
        for p in places:
            _add_rows(sums, p, of_head)
        if part.stop % SUM_TOKENS == 0 or part.stop >= len(cases):
            expected[kind] += sums
            sums[:] = 0


def _add_chunks(key, table):
    observed = sum(_unpacked(x).astype(np.int64) for x in table["observed"].to_pylist())
    expected = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table["expected"].to_pylist())
    return pa.table(
        {
            "kind": [key[0].as_py()],
            "chunk": pa.array([key[1].as_py()], pa.int32()),
            "observed": [_packed(observed)],
            "expected": [expected.astype(np.float32).tobytes()],
        }
    )


def _step(model: Model, sums: list) -> Model:
    """Weights after one round; ``sums`` has a bounded number of rows, as the model has."""
    p = model.params
    shares = {"class": np.exp(model.class_bias)[None, :], "member": np.full((1, MEMBERS), 1 / MEMBERS, np.float32)}
    weights = {"class": model.class_weights.copy(), "member": model.member_weights.copy()}
    for row in sums:
        w = weights[row["kind"]]
        size = len(w) // CHUNKS
        part = slice(row["chunk"] * size, (row["chunk"] + 1) * size)
        observed = _unpacked(row["observed"]).reshape(size, -1)
        expected = np.frombuffer(row["expected"], np.float32).reshape(size, -1)
        prior = np.float32(p.smoothing) * shares[row["kind"]]
        w[part] += np.float32(p.rate / FEATURES) * np.log((observed + prior) / (expected + prior))
    return Model(p, model.class_bias, model.member_bias, weights["class"], weights["member"])


def pair_weight(n: np.ndarray, params: LmParams) -> np.ndarray:
    """What the features weigh beside n counted tokens after a word."""
    return params.pair_scale * (n + 1.0) ** params.pair_power


def _score(model_of, params: LmParams, words: Vocabulary, schema: StructType):
    arrow = to_arrow_schema(schema)

    def run(key, table, answers):
        model = shipped(model_of)
        row = table.to_pylist()[0]
        lengths = np.frombuffer(row["lengths"], np.int64)
        cells = np.frombuffer(row["cells"], np.uint16)
        counts = np.frombuffer(row["counts"], np.int64)
        inside = np.exp(words.inside(cells, counts))
        after = np.append(counts, words.documents)
        weights = pair_weight(after, params)
        outer = Powers.of(model.class_bias[None, :], model.class_weights)
        inner = Powers.of(model.member_bias, model.member_weights)
        found = _found_pairs(row, answers)
        total = np.zeros(len(lengths))
        done = 0
        for a, b, ranks, own, starts in _pieces(_unpacked(row["tokens"]), lengths):
            x = cells[ranks]
            value = inside[ranks]
            places = model.class_places(*histories(x, starts, own, BACK))
            for s in range(0, len(x), SCORE_TOKENS):
                part = slice(s, s + SCORE_TOKENS)
                classes, members = x[part] // MEMBERS, x[part] % MEMBERS
                rows = [p[part] for p in places]
                value[part] *= outer.chosen(classes, rows, classes)
                value[part] *= inner.chosen(classes, [model.member_place(p, classes) for p in rows], members)
            before = neighbours(ranks, own, len(counts))
            n, weight = after[before], weights[before]
            value = np.log10((found[done : done + len(x)] + weight * value) / (n + weight))
            total[a:b] = np.add.reduceat(value, starts)
            done += len(x)
        ids = row["doc_ids"]
        held = [id_hash(d) % params.folds == params.held_fold for d in ids]
        return pa.table(
            [
                pa.array(ids, arrow.field("doc_id").type),
                pa.array(held, pa.bool_()),
                pa.array(lengths),
                pa.array(np.frombuffer(row["known"], np.int64)),
                pa.array(np.full(len(ids), words.tokens, np.int64)),
                pa.array(np.frombuffer(row["base"], np.float64)),
                pa.array(total),
            ],
            schema=arrow,
        )

    return run


RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def train_and_score(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LmParams = LmParams()
) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed unigrams) and score (the model), both log10 of the text's
    probability with its end token.

    Words keep their case except A-Z, which are lowered. Null and empty texts are an
    end token alone. Null ids hash as no text. Repeated rows train and are scored as
    often as they stand there. Without a training row every word is unseen. Other
    columns are not read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(3, ceil(log2(max(1, chars / 6 / RANGE_WORDS))))
    id_type = docs.schema["doc_id"].dataType
    schema = _block_schema(id_type)
    paths = [scratch_path(spark) for _ in range(2)]
    blocks = materialize(docs.mapInArrow(_make_blocks(params, schema, bits), schema), paths[0], "zstd")
    vocab = blocks.where("part >= 0").select("block", "part", "words", "keys", "counts", "endings")
    counted = materialize(vocab.groupBy("part").applyInArrow(_count_range, COUNTED), paths[1], "zstd")
    words = _vocabulary(counted)
    answers = counted.where("block >= 0").select("block", "part", "counts")
    encoded_schema = _encoded_schema(id_type, params.rounds)
    encoded = materialize(
        blocks.drop("counts")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInArrow(_encode_blocks(words, params, encoded_schema), encoded_schema),
        codec="zstd",
    )
    for path in paths:  # all that is still needed is in the encoded blocks
        discard(spark, path)
    model = Model.start(words, params)
    tasks = max(1, ceil(words.tokens / TASK_TOKENS))
    for round_ in range(params.rounds):
        shared = ship(spark, model)
        sums = (
            encoded.select(F.col(f"cells_{round_}").alias("cells"), F.col(f"lengths_{round_}").alias("lengths"))
            .coalesce(tasks)
            .mapInArrow(_sum_counts(shared), SUMS)
            .groupBy("kind", "chunk")
            .applyInArrow(_add_chunks, SUMS)
            .collect()  # as large as the model
        )
        model = _step(model, sums)
        shared.destroy()
    result = StructType([docs.schema["doc_id"], *StructType.fromDDL(RESULT)])
    pairs = encoded.select("doc_ids", "block", "keys", "tokens", "lengths").mapInArrow(_send_pairs(params, bits), PAIRS)
    found = pairs.groupBy("part").applyInArrow(_count_pairs, ANSWERS)
    score = _score(ship(spark, model), params, words, result)
    scored = encoded.select("doc_ids", *StructType.fromDDL(ENCODED).names)
    return scored.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(score, result)
