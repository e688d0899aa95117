"""Filter interaction audit (operator 12): what each filter removes in every order, from diagrams of failure masks.

Each document fails some of the filters; that set is its mask. A part's documents are first counted by mask, which leaves at most
2**m rows a part, and a diagram is built over these counts: a level for each filter, a node's two ways for passing and failing it,
equal nodes shared, and at each node the counts of all that lies below it. Two neighbouring levels can be swapped by rebuilding
these two alone. Going through the orders by swaps of neighbours ("plain changes") visits all m! of them with one swap each, and
the path on which everything passes gives an order's steps: the counts at its nodes are what is kept, those beside it what goes.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ALL_WHITE = " \t\n\x0b\x0c\r"


class Diagram:
    """Counts by mask as a shared diagram, one level for each filter in ``order``; weights are tuples that add up."""

    def __init__(self, counts: Mapping[int, tuple[int, ...]], m: int):
        self.order = list(range(m))
        zero = (0,) * len(next(iter(counts.values())))
        self._weight: list[tuple[int, ...]] = []
        self._ways: dict[int, tuple[int, int]] = {}
        self._level: list[list[int]] = [[] for _ in range(m)]
        leaves: dict[tuple[int, ...], int] = {}
        row = []
        for path in range(1 << m):  # the first filter is the highest bit of a path
            mask = sum(1 << f for f in range(m) if path >> (m - 1 - f) & 1)
            w = counts.get(mask, zero)
            if w not in leaves:
                leaves[w] = len(self._weight)
                self._weight.append(w)
            row.append(leaves[w])
        for level in reversed(range(m)):
            made: dict[tuple[int, int], int] = {}
            row = [self._node(level, made, row[k], row[k + 1]) for k in range(0, len(row), 2)]
        self.root = row[0]

    def _node(self, level: int, made: dict[tuple[int, int], int], passing: int, failing: int) -> int:
        if (ways := (passing, failing)) not in made:
            made[ways] = len(self._weight)
            self._weight.append(tuple(a + b for a, b in zip(self._weight[passing], self._weight[failing])))
            self._ways[made[ways]] = ways
            self._level[level].append(made[ways])
        return made[ways]

    def size(self) -> int:
        return sum(map(len, self._level))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the one below; nodes above keep their ways, those below stay as they are."""
        old, self._level[level + 1] = self._level[level + 1], []
        made: dict[tuple[int, int], int] = {}
        for node in self._level[level]:
            (pp, pf), (fp, ff) = (self._ways[x] for x in self._ways[node])
            self._ways[node] = self._node(level + 1, made, pp, fp), self._node(level + 1, made, pf, ff)
        for node in old:
            del self._ways[node]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """For each filter of the order: itself, the weight kept after it, and the weight that it removes."""
        node = self.root
        for f in self.order:
            node, gone = self._ways[node]
            yield f, self._weight[node], self._weight[gone]

    def alone(self) -> dict[int, tuple[int, ...]]:
        """The weight that fails a filter and no other."""
        out, node = {}, self.root
        for level, f in enumerate(self.order):
            node, other = self._ways[node]
            for _ in range(level + 1, len(self.order)):
                other = self._ways[other][0]
            out[f] = self._weight[other]
        return out


def plain_changes(m: int) -> Iterator[int]:
    """Levels to swap, one after another, so that m! orders are visited once each."""
    if m < 2:
        return
    down, up = list(range(m - 2, -1, -1)), list(range(m - 1))
    inner, k = plain_changes(m - 1), 0
    while True:
        yield from down if k % 2 == 0 else up
        if (step := next(inner, None)) is None:
            return
        yield step + (1 if k % 2 == 0 else 0)
        k += 1


def _steps_of(counts: Mapping[int, tuple[int, int, int]], letters: str) -> list[tuple]:
    m = len(letters)
    diagram = Diagram(counts, m)
    failing = [sum(w[0] for mask, w in counts.items() if mask >> f & 1) for f in range(m)]
    alone, shapley, rows = {f: w[0] for f, w in diagram.alone().items()}, [0] * m, []
    changes = plain_changes(m)
    while True:
        name = "".join(letters[f] for f in diagram.order)
        for step, (f, kept, gone) in enumerate(diagram.steps(), 1):
            rows.append((f, name, step, kept[0], gone[0], failing[f] - gone[0], alone[f], gone[1], gone[2]))
            shapley[f] += gone[0]
        if (level := next(changes, None)) is None:
            return [(*r[1:], shapley[r[0]]) for r in rows]
        diagram.swap(level)


_COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(masks: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, with its counts.

    ``masks``: part, mask (bit k for the k-th letter), good, toxic (booleans), one row per document. Reduced to a row per part and
    mask before any part is gathered, so a part has at most 2**m rows, however many documents it holds. No rows give no rows.
    """
    counted = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("filter_order", T.StringType()), T.StructField("step", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in _COUNTS]])

    def steps(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {int(mask): (int(n), int(g), int(t)) for mask, n, g, t in rows[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        return pd.DataFrame([(key[0], *r) for r in _steps_of(counts, letters)], columns=schema.names)

    return counted.groupBy("part").applyInPandas(steps, schema)


def text_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions A to D over a text that isn't null: short, repetitive, loud, with marks of markup."""
    trimmed = F.btrim(F.col(text), F.lit(_ALL_WHITE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    n = F.size(words)
    return {
        "A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * F.regexp_count(F.col(text), F.lit("[A-Z]")) > 3 * F.char_length(text), "D": F.col(text).rlike("[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per document its part, the mask of the filters that it fails, and whether labels call it good or toxic.

    The last bit is the copy filter: a text equal to that of any smaller key, in the whole table. Null texts count as empty and null
    parts as the empty string; a null key is no one's original and no copy; rows that repeat key and text fail alike. Several labels
    of a document count as one that has what any of them has. A text leaves its row as a digest of 256 bits; each distinct one's
    smallest key is met again by key and digest, so no group of copies comes together.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    filters = text_filters("_text") if filters is None else filters
    mask = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    small = rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("_text", 256)).alias("digest"))
    firsts = small.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    called = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.bool_or(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    out = small.join(firsts, ["doc_id", "digest"], "left").join(called, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    return out.select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << len(filters)).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over all documents, by language."""
    return audit(failure_masks(docs, labels), "ABCDE")
