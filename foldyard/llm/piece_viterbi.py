"""SentencePiece encoding and decoding by one Viterbi pass over an Aho-Corasick automaton.

The automaton holds all pieces. It reads a text once; at each end position it reports,
along its output links from the longest, every piece that ends there, and each relaxes
the best score of that position. No piece joins two words (checked when the vocabulary
is read; else a text is one unit), so the best path of a text is the best paths of its
words put together, and a task keeps the paths of words it has met, up to a bound.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SPACE = "▁"
#: Below the lowest score: what an unknown character costs.
UNKNOWN_PENALTY = 10.0
#: Words whose paths a task keeps; then it starts anew.
KNOWN_WORDS = 400_000


@dataclass
class Pieces:
    """A vocabulary: texts and scores by id, byte pieces, and the unknown piece."""

    texts: list[str]
    scores: list[float]
    normal: list[bool]
    bytes_: dict[int, int]  # byte value to id
    unknown: int
    unit: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        joins = any(SPACE in t.lstrip(SPACE) for t, n in zip(self.texts, self.normal) if n)
        self.unit = re.compile("(?s).+" if joins else f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    @staticmethod
    def read(path: str) -> "Pieces":
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        special = [
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)
        ]
        texts = [model.id_to_piece(i) for i in range(n)]
        return Pieces(
            texts,
            [model.get_score(i) for i in range(n)],
            [not s for s in special],
            {int(texts[i][1:-1], 16): i for i in range(n) if model.is_byte(i)},
            model.unk_id(),
        )


class Encoder:
    """Built once in a task; see ``Pieces`` for what it reads."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for i, (text, score, normal) in enumerate(zip(pieces.texts, pieces.scores, pieces.normal)):
            if normal and text:
                self.automaton.add_word(text, (len(text), score, i))
        self.automaton.make_automaton()
        lowest = min((s for s, n in zip(pieces.scores, pieces.normal) if n), default=0.0)
        self.unknown_score = lowest - UNKNOWN_PENALTY
        self.known: dict[str, list[int]] = {}

    def best_path(self, unit: str) -> list[int]:
        """Ids of the best segmentation; of equal scores the longer last piece wins."""
        n = len(unit)
        best = [0.0] + [float("-inf")] * n
        back = [(0, -1)] * (n + 1)
        at = 0
        single = False

        def close(end: int) -> None:
            """An unknown character where no piece is that character."""
            if not single and best[end - 1] + self.unknown_score > best[end]:
                best[end] = best[end - 1] + self.unknown_score
                back[end] = (end - 1, -1)

        for end, (size, score, piece) in self.automaton.iter(unit):
            while at < end:
                at += 1
                close(at)
                single = False
            single = single or size == 1
            value = best[end + 1 - size] + score
            if value > best[end + 1]:
                best[end + 1] = value
                back[end + 1] = (end + 1 - size, piece)
        while at < n:
            at += 1
            close(at)
            single = False
        out: list[int] = []
        while n:
            start, piece = back[n]
            if piece >= 0:
                out.append(piece)
            else:
                raw = unit[start:n].encode("utf-8", "surrogatepass")
                out.extend(self.pieces.bytes_.get(b, self.pieces.unknown) for b in reversed(raw)) if (
                    self.pieces.bytes_
                ) else out.append(self.pieces.unknown)
            n = start
        return out[::-1]

    def encode(self, text: str) -> list[list[int]]:
        """Id lists of the text's units, in order."""
        if not text:
            return []
        known, out = self.known, []
        for unit in self.pieces.unit.findall(SPACE + text.replace(" ", SPACE)):
            path = known.get(unit)
            if path is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                path = known[unit] = self.best_path(unit)
            out.append(path)
        return out


class Decoder:
    def __init__(self, pieces: Pieces) -> None:
        raw = {i: bytes([b]) for b, i in pieces.bytes_.items()}
        self.parts = [
            raw.get(i, t.replace(SPACE, " ").encode() if n else b"")
            for i, (t, n) in enumerate(zip(pieces.texts, pieces.normal))
        ]
        self.parts[pieces.unknown] = " ⁇ ".encode()

    def decode(self, ids) -> str:
        parts = self.parts
        data = b"".join([parts[i] for i in ids])
        return data.decode("utf-8", "replace").removeprefix(" ")


def encode(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array), n_pieces, round_trip (whether
    decoding the ids gives the text back).

    ``model_path`` is a vocabulary file that every executor can open. Null and empty
    texts have no pieces and do round-trip, null as the empty text. A text that holds
    the piece alphabet's own space mark, or characters without piece or byte, does not.
    Null ids, repeated rows and ties (see ``Encoder.best_path``) need no care; other
    columns are not read.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    out = StructType([docs.schema["doc_id"], *StructType.fromDDL("ids array<int>, n_pieces long, round_trip boolean")])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.read(model_path)
        encoder, decoder = Encoder(pieces), Decoder(pieces)
        for whole in batches:
            for s in range(0, whole.num_rows, 500):
                batch = whole.slice(s, 500)
                flat, sizes, same = [], [], []
                for text in batch.column(1).to_pylist():
                    ids = np.fromiter(chain.from_iterable(encoder.encode(text)), np.int32)
                    flat.append(ids)
                    sizes.append(len(ids))
                    same.append(decoder.decode(ids.tolist()) == text)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), lists.cast(arrow.field("ids").type), pa.array(sizes, pa.int64()), pa.array(same)], arrow.names
                )

    return docs.mapInArrow(run, out)


def decode(df: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id, text. Null or empty lists decode to ''; an id
    outside the vocabulary raises."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    out = StructType([rows.schema["doc_id"]]).add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Pieces.read(model_path))
        for batch in batches:
            texts = [decoder.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, out)
