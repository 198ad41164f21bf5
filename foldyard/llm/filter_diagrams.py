"""Filter interaction audit with count-weighted decision diagrams.

Each document has a mask of the filters it fails. The masks of a part, with their counts,
make a decision diagram: one level a filter, a node's two branches for pass and fail, equal
sub-diagrams shared, and each node weighted by the documents below it. Two neighbouring
levels are swapped in place, so all orders of the filters follow from one diagram by one
swap each (plain changes). The all-pass path of an order visits the documents that every
filter so far has kept: at each level the weight of its fail branch is what that filter
removes there, the weight of its pass branch what it keeps.

Spark reads the texts, finds repeats and counts masks; a diagram sees at most 2**k counts
of one part, whatever the number of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UPPER = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes of UTF-8 that do not start a code point.
INNER = bytes(range(0x80, 0xC0))

Weight = tuple[int, ...]


@dataclass(frozen=True)
class AuditRules:
    """Failure conditions of the filters A to D; E fails repeats of a text.
    least_words: A fails texts with fewer. least_distinct: B fails a smaller percentage of
    distinct words. most_upper: C fails a larger percentage of capitals among code points.
    symbols: D fails texts that hold any."""

    least_words: int = 100
    least_distinct: int = 80
    most_upper: int = 10
    symbols: str = "#$%&*|"


FILTERS = "ABCDE"


# -- one part's diagram -------------------------------------------------------------


def plain_changes(n: int) -> Iterator[int]:
    """Places ``i`` whose swaps with ``i + 1`` lead through all orders of ``n`` things."""
    if n < 2:
        return
    down = True
    inner = plain_changes(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        # the moving thing is at the front after a walk down, so the others are one further
        yield step + 1 if down else step
        down = not down


class Diagram:
    """Weighted decision diagram over masks; level ``i`` decides ``order[i]``."""

    def __init__(self, masks: dict[int, Weight], n_filters: int, n_weights: int):
        self.order = list(range(n_filters))
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(n_filters)]
        self.unique: list[dict[tuple[int, int], int]] = [{} for _ in range(n_filters)]
        self.weights: dict[int, Weight] = {}
        self.leaves: dict[Weight, int] = {}
        self.ids = 0
        zero = (0,) * n_weights
        below = [self._leaf(masks.get(mask, zero)) for mask in range(1 << n_filters)]
        for level in range(n_filters - 1, -1, -1):
            half = 1 << level
            below = [self._node(level, below[mask], below[mask + half]) for mask in range(half)]
        self.root = below[0]

    def _new(self, weight: Weight) -> int:
        self.ids += 1
        self.weights[self.ids] = weight
        return self.ids

    def _leaf(self, weight: Weight) -> int:
        if weight not in self.leaves:
            self.leaves[weight] = self._new(weight)
        return self.leaves[weight]

    def _node(self, level: int, passed: int, failed: int) -> int:
        """The node with these branches, shared where it exists."""
        found = self.unique[level].get((passed, failed))
        if found is None:
            found = self._new(tuple(map(sum, zip(self.weights[passed], self.weights[failed]))))
            self.unique[level][passed, failed] = found
            self.levels[level][found] = (passed, failed)
        return found

    def swap(self, level: int) -> None:
        """Exchange a level with the next. Nodes of the upper keep name and weight, since
        each still stands for the same documents; the lower level is built anew."""
        upper, lower = self.levels[level], self.levels[level + 1]
        for gone in lower:
            del self.weights[gone]
        self.levels[level + 1], self.unique[level + 1] = {}, {}
        turned = {}
        for node, (passed, failed) in upper.items():
            (pp, pf), (fp, ff) = lower[passed], lower[failed]
            turned[node] = (self._node(level + 1, pp, fp), self._node(level + 1, pf, ff))
        self.levels[level] = turned
        self.unique[level] = {branches: node for node, branches in turned.items()}
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """(filter, weight kept, weight removed) along the all-pass path."""
        node = self.root
        for name, level in zip(self.order, self.levels):
            passed, failed = level[node]
            yield name, self.weights[passed], self.weights[failed]
            node = passed


def audit_part(masks: dict[int, Weight], filters: str) -> list[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)
    of all orders; a mask's weight is (documents, good ones, toxic ones)."""
    k = len(filters)
    diagram = Diagram(masks, k, 3)
    rows, fails, alone, total = [], [0] * k, [0] * k, [0] * k
    changes = plain_changes(k)
    while True:
        order = "".join(filters[i] for i in diagram.order)
        for step, (name, kept, removed) in enumerate(diagram.steps(), 1):
            rows.append((order, step, name, kept[0], *removed))
            total[name] += removed[0]
            if step == 1:
                fails[name] = removed[0]
            if step == k:
                alone[name] = removed[0]
        place = next(changes, None)
        if place is None:
            break
        diagram.swap(place)
    return [
        (order, step, kept, removed, fails[name] - removed, alone[name], good, toxic, total[name])
        for order, step, name, kept, removed, good, toxic in rows
    ]


# -- over all documents -------------------------------------------------------------


def failed_bits(raw: bytes, rules: AuditRules) -> int:
    """Filters A to D that a UTF-8 text fails, A as the lowest bit."""
    words = raw.split()  # blanks, \t, \n, \v, \f, \r: the white space of the word rule
    n_words, n_points = len(words), len(raw.translate(None, INNER))
    capitals = len(raw) - len(raw.translate(None, UPPER))
    return (
        (n_words < rules.least_words)
        | (100 * len(set(words)) < rules.least_distinct * n_words) << 1
        | (100 * capitals > rules.most_upper * n_points) << 2
        | (len(raw.translate(None, rules.symbols.encode())) < len(raw)) << 3
    )


def text_masks(docs: DataFrame, rules: AuditRules) -> DataFrame:
    """doc_id, part, mask (A to D), key (equal for equal texts)."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, keys = [], []
            for value in batch.column("text"):
                raw = value.as_py()
                masks.append(failed_bits(raw, rules))
                keys.append(hashlib.md5(raw, usedforsecurity=False).digest())
            columns = [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(judge, f"doc_id {kind}, part string, mask int, key binary")


def mask_counts(facts: DataFrame, labels: DataFrame, repeat_bit: int) -> DataFrame:
    """part, mask, docs, good, toxic, with the bit of repeats set.

    Rows of one text, part and label are counted before they meet the others of that
    text, so a text that stands in a third of all rows is a few rows there.
    """
    flag = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(flag("quality"), flag("toxic"))
    rows = facts.groupBy("doc_id", "part", "mask", "key").agg(F.count("*").alias("n")).join(marks, "doc_id", "left")
    known = F.col("doc_id").isNotNull()
    kinds = rows.groupBy(
        "key", "part", "mask", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    ).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("key"))
    at_least = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = kinds.withColumn("least", least).withColumn("originals", F.col("n_null") + F.coalesce(at_least, F.lit(0)))
    either = F.array(
        F.struct(F.col("mask"), F.col("originals").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << repeat_bit)).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
    )
    counted = split.select("part", "good", "toxic", F.inline(either)).where("n > 0")

    def sum_where(c: str) -> Column:
        return F.sum(F.col("n") * F.col(c)).alias(c)

    return counted.groupBy("part", "mask").agg(F.sum("n").alias("docs"), sum_where("good"), sum_where("toxic"))


def audit_masks(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Steps of all filter orders for each part, from its counted failure masks.

    ``counts``: part, mask (bit ``i``: fails ``filters[i]``), docs, good, toxic, one row a
    mask and part. A part gives len(filters)! * len(filters) rows, zeros included; no
    rows give none.
    """

    def diagrams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
                rows = audit_part({m["mask"]: (m["docs"], m["good"], m["toxic"]) for m in masks}, filters)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), [pa.string(), pa.int32(), *[pa.int64()] * 7])]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.string()), *columns], NAMES)

    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "docs", "good", "toxic")).alias("masks"))
    return parts.mapInArrow(
        diagrams,
        "part string, filter_order string, step int, kept long, removed long, redundant long, "
        "unique_fails long, good_lost long, toxic_lost long, shapley long",
    )


NAMES = [
    "part", "filter_order", "step", "kept", "removed", "redundant",
    "unique_fails", "good_lost", "toxic_lost", "shapley",
]


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    rules: AuditRules = AuditRules(),
) -> DataFrame:
    """How filters A to E overlap in each part of ``docs``, for all 120 orders.

    ``labels``: doc_id, quality, toxic. Columns as ``audit_masks`` gives them. Null texts
    count as empty (which fail A alone, and E where they repeat), null parts as the part
    ''. E fails a row where a row of equal text has a smaller id, in any part; rows that
    tie for the smallest id pass, so equal rows fail or pass together. Null ids are neither
    smaller nor larger than others: they pass E, make no row fail and have no label. An id
    with several labels is good or toxic where one of them says so; null labels say
    nothing. Texts of any length are read whole, one at a time. Other columns, of any
    name, are not read. An empty table has no parts and gives no rows.
    """
    own = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )
    return audit_masks(mask_counts(text_masks(own, rules), labels.select("doc_id", "quality", "toxic"), 4))
