"""Exact substring dedup with fixed-block anchors.

A window of ``window`` words holds at least one whole aligned block of
``block = (window + 1) // 2`` words of its own document. So:

1. index: the non-overlapping blocks of every document; probe: every rolling window of
   ``block`` words of every document. A block that some other place repeats is a hit.
2. extend: around each hit, at every start whose window holds it, the whole
   ``window``-word sequence is looked up among the extensions of all other hits. Runs of
   confirmed windows are the maximal exact repeats, and the words they cover go.

Documents are dealt into batches of bounded size, shuffled once; all three passes read
that shuffle. Hashes travel as packed arrays (see ``hashing``), each distinct hash once
a batch, so a passage shared by a third of all rows loads no task more than any other.
First-pass hashes are 40 bits beyond the range number and only choose candidates; the
second pass compares 96 bits of two independent hashes.
"""

from __future__ import annotations

import re
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .text import quoted
from .hashing import BASES, by_range, rolling, starts_inside, text_words, word_hashes

WINDOW = 35
BATCH_CHARS = 6_000_000
#: Hashes of a range at most, on average.
RANGE_HASHES = 2_000_000
PACKED = "batch int, part int, n long, keys binary, flags binary"
RESULT = "n_words long, n_removed long, kept_text string, spans array<struct<first:int,end:int>>"


def _packed(rows: list) -> pa.Table:
    names = ("batch", "part", "n", "keys", "flags")
    types = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})


def _short(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 40 bits after the range number, as five bytes each."""
    rest = (hashes << np.uint64(bits)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(rest[:, :5])


def _read_short(keys: bytes) -> np.ndarray:
    raw = np.frombuffer(keys, np.uint8).reshape(-1, 5)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, 3:] = raw
    return wide.view(">u8").ravel().astype(np.uint64)


def _batch_words(table: pa.Table):
    words, counts = text_words(table["text"].to_pylist())
    return words, word_hashes(words), counts


def _block_starts(counts: np.ndarray, block: int) -> np.ndarray:
    first = np.repeat(np.cumsum(counts) - counts, counts)
    inside = starts_inside(counts, block)
    return inside[(inside - first[inside]) % block == 0]


def _probe(block: int, bits: int):
    def run(key, table):
        _, hashes, counts = _batch_words(table)
        grams = rolling(hashes, block)
        inside = starts_inside(counts, block)
        anchors = np.unique(grams[_block_starts(counts, block)])
        found, times = np.unique(grams[inside], return_counts=True)
        flags = np.isin(found, anchors, assume_unique=True).astype(np.uint8) | ((times > 1).astype(np.uint8) << 1)
        batch = key[0].as_py()
        short = _short(found, bits)
        return _packed(
            [(batch, p, s.stop - s.start, short[s].tobytes(), flags[s].tobytes()) for p, s in by_range(found, bits)]
        )

    return run


def _match_blocks(key, table):
    """Of one hash range: the hashes that are an anchor and stand in two places or more."""
    sizes = np.array(table["n"].to_pylist(), np.int64)
    keys = np.concatenate([_read_short(k) for k in table["keys"].to_pylist()])
    flags = np.frombuffer(b"".join(table["flags"].to_pylist()), np.uint8)
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    anchor = np.maximum.reduceat(flags[order] & 1, first)
    places = np.add.reduceat((1 + (flags[order] >> 1)).astype(np.int64), first)
    hit = np.zeros(len(keys), bool)
    hit[order] = np.repeat((anchor > 0) & (places > 1), np.diff(np.append(first, len(keys))))
    return _answer(key, table, sizes, hit, lambda at: _short(keys[at] << np.uint64(24), 0).tobytes())


def _answer(key, table, sizes, hit, encode) -> pa.Table:
    rows, start = [], 0
    for batch, n in zip(table["batch"].to_pylist(), sizes):
        at = start + np.flatnonzero(hit[start : start + n])
        start += n
        if len(at):
            rows.append((batch, key[0].as_py(), len(at), encode(at), None))
    return _packed(rows)


def _long_hashes(hashes: np.ndarray, window: int):
    second = rolling(hashes ^ (hashes << np.uint64(13)) ^ (hashes >> np.uint64(7)), window, BASES[1])
    return rolling(hashes, window), (second >> np.uint64(32)).astype(np.uint32)


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), np.dtype([("a", np.uint64), ("b", np.uint32)]))
    out["a"], out["b"] = a, b
    return out


def _candidates(table: pa.Table, hits: pa.Table, hashes, counts, window: int, block: int, bits: int) -> np.ndarray:
    """Starts of windows that hold a hit."""
    known = [
        _read_short(k) | np.uint64(p) << np.uint64(40) for p, k in zip(hits["part"].to_pylist(), hits["keys"].to_pylist())
    ]
    if not known:
        return np.zeros(0, np.int64)
    known = np.sort(np.concatenate(known))
    inside = starts_inside(counts, block)
    grams = rolling(hashes, block)[inside] >> np.uint64(24 - bits)
    at = np.searchsorted(known, grams)
    at[at == len(known)] = 0
    marks = np.zeros(len(hashes) + 1, np.int32)
    hit = inside[known[at] == grams]
    reach = window - block
    np.add.at(marks, np.maximum(hit - reach, 0), 1)
    np.add.at(marks, hit + 1, -1)
    starts = starts_inside(counts, window)
    return starts[np.cumsum(marks)[starts] > 0]


def _extend(window: int, block: int, bits: int):
    def run(key, table, hits):
        if not table.num_rows or not hits.num_rows:
            return _packed([])
        _, hashes, counts = _batch_words(table)
        starts = _candidates(table, hits, hashes, counts, window, block, bits)
        if not len(starts):
            return _packed([])
        a, b = _long_hashes(hashes, window)
        pairs = _pairs(a[starts], b[starts])
        pairs = pairs[np.lexsort((pairs["b"], pairs["a"]))]
        new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        first = np.flatnonzero(new)
        found, times = pairs[first], np.diff(np.append(first, len(pairs)))
        flags = (times > 1).astype(np.uint8)
        batch = key[0].as_py()
        return _packed(
            [
                (batch, p, s.stop - s.start, found[s].tobytes(), flags[s].tobytes())
                for p, s in by_range(found["a"], bits)
            ]
        )

    return run


PAIR = np.dtype([("a", np.uint64), ("b", np.uint32)])


def _match_windows(key, table):
    """Of one hash range: the windows that start in two places or more."""
    sizes = np.array(table["n"].to_pylist(), np.int64)
    pairs = np.frombuffer(b"".join(table["keys"].to_pylist()), PAIR)
    flags = np.frombuffer(b"".join(table["flags"].to_pylist()), np.uint8)
    order = np.lexsort((pairs["b"], pairs["a"]))
    ranked = pairs[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    places = np.add.reduceat((1 + flags[order]).astype(np.int64), first)
    hit = np.zeros(len(pairs), bool)
    hit[order] = np.repeat(places > 1, np.diff(np.append(first, len(pairs))))
    return _answer(key, table, sizes, hit, lambda at: pairs[at].tobytes())


#: Words with their places in a text.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_spans(text: str, spans: list[dict]) -> str:
    """The text without the words of the spans; what is between other words stays."""
    starts = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for span in spans:
        out.append(text[at : starts[span["first"]]])
        at = starts[span["end"]]
    return "".join(out) + text[at:]


def _remove(window: int, schema: pa.Schema, keep_layout: bool):
    def run(key, table, hits):
        if not table.num_rows:
            return schema.empty_table()
        words, hashes, counts = _batch_words(table)
        cover = np.zeros(len(words) + 1, np.int32)
        if hits.num_rows:
            known = np.frombuffer(b"".join(hits["keys"].to_pylist()), PAIR)
            known = known[np.lexsort((known["b"], known["a"]))]
            starts = starts_inside(counts, window)
            a, b = _long_hashes(hashes, window)
            pairs = _pairs(a[starts], b[starts])
            # equal first halves are rare; step through them until the second agrees
            at = np.searchsorted(known["a"], pairs["a"])
            hit = np.zeros(len(pairs), bool)
            open_ = np.flatnonzero(at < len(known))
            while len(open_):
                same = known["a"][at[open_]] == pairs["a"][open_]
                open_ = open_[same]
                hit[open_] |= known["b"][at[open_]] == pairs["b"][open_]
                at[open_] += 1
                open_ = open_[(at[open_] < len(known)) & ~hit[open_]]
            np.add.at(cover, starts[hit], 1)
            np.add.at(cover, starts[hit] + window, -1)
        gone = np.cumsum(cover)[:-1] > 0
        ends = np.cumsum(counts)
        kept, removed, spans = [], [], []
        texts = table["text"].to_pylist() if keep_layout else None
        for i, (end, n) in enumerate(zip(ends, counts)):
            own = gone[end - n : end]
            m = int(own.sum())
            removed.append(m)
            ws = words[end - n : end]
            if m:
                edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                spans.append([{"first": int(f), "end": int(e)} for f, e in zip(edges[::2], edges[1::2])])
                ws = [w for w, g in zip(ws, own) if not g]
            else:
                spans.append([])
            if keep_layout:
                kept.append(cut_spans(texts[i] or "", spans[-1]))
            else:
                kept.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
        return pa.table(
            [
                table["doc_id"],
                table["extra"],
                pa.array(counts, pa.int64()),
                pa.array(removed, pa.int64()),
                pa.array(kept, pa.string()),
                pa.array(spans, schema.field("spans").type),
            ],
            schema=schema,
        )

    return run


def remove_repeats(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    keep_layout: bool = False,
) -> DataFrame:
    """One row per input row: doc_id, extra, n_words, n_removed, kept_text (kept words
    joined by one blank; with ``keep_layout`` the text with the spans cut out), spans
    (removed word ranges).

    Every word covered by a ``window``-word sequence that also starts elsewhere, in the
    same document or another, is removed, in all its places. Null and empty texts have
    no words and keep the text ''. Repeated rows repeat each other's windows. ``window``
    must be 2 or more. ``extra`` holds the other columns, of any name, as a struct (null
    if there are none); ids may be null. Texts of any length are one row of work; ties do
    not arise, since every place of a repeat goes. An empty table gives no rows.
    """
    block = (window + 1) // 2
    others = [c for c in df.columns if c not in (id_col, text_col)]
    extra = F.struct(*(F.col(quoted(c)) for c in others)) if others else F.lit(None).cast("int")
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), extra.alias("extra"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    batches = max(1, ceil(chars / BATCH_CHARS))
    bits = max(0, ceil(log2(max(1, chars / 6 / RANGE_HASHES))))
    batch = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(batches)).cast("int")
    dealt = docs.withColumn("batch", batch).repartition("batch")
    probes = dealt.groupBy("batch").applyInArrow(_probe(block, bits), PACKED)
    hits = probes.groupBy("part").applyInArrow(_match_blocks, PACKED)
    windows = dealt.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(_extend(window, block, bits), PACKED)
    repeats = windows.groupBy("part").applyInArrow(_match_windows, PACKED)
    result = StructType([docs.schema["doc_id"], docs.schema["extra"], *StructType.fromDDL(RESULT)])
    return (
        dealt.groupBy("batch")
        .cogroup(repeats.groupBy("batch"))
        .applyInArrow(_remove(window, to_arrow_schema(result), keep_layout), result)
    )
