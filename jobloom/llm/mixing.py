"""Mixing sources to target weights (operator 4): budgets down a tree, token-prefixes of seeded epochs at its leaves.

The budget is divided among the children of each node by their weights. What a subtree can't give (its tokens times the
most epochs) is shared out among its siblings by their weights, again and again until none is short; only what all of
them together can't give is left to the level above, because a node never gets more than its subtree can give.

A leaf with tokens S and budget T gives T div S whole epochs and of the next the longest prefix that fits into the rest.
An epoch's order is a seeded hash of its documents. To find a prefix no leaf is ever sorted: hashes are cut into equal
ranges, ranges are summed, the one in which the budget ends is cut and summed again, and only what is left of it (one
part in 16 million) is walked, so a source that holds a third of all rows is no longer a task than another. A prefix is
then a border that lies below it or a greatest hash within it, and taking it is a filter.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.sources.tables import materialise

#: Equal ranges that a leaf's hashes are cut into, as a power of two, and how often the range of the border is cut anew.
RANGE_BITS = 12
RANGE_LEVELS = 2
#: Leaves are a catalogue of sources: their budgets are planned on the driver, and more than this are refused.
MAX_LEAVES = 50_000
MISSING = "(none)"


@dataclass(frozen=True)
class Mixture:
    """Weights by path from the root ("domain",), ("domain", "lang"), ...; siblings without one weigh 1."""

    weights: Mapping[tuple[str, ...], float]
    budget_share: float = 0.8
    max_epochs: float = 3.0
    seed: int = 23


def fill(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Shares of a budget for children (weight, capacity): by weight, what one can't take by weight among the others."""
    out, open_, left = [0.0] * len(children), [k for k, (w, c) in enumerate(children) if w > 0 and c > 0], budget
    while open_ and left > 1e-9:
        total = sum(children[k][0] for k in open_)
        full = [k for k in open_ if left * children[k][0] / total >= children[k][1]]
        if not full:
            for k in open_:
                out[k] = left * children[k][0] / total
            break
        for k in full:
            out[k] = children[k][1]
        left -= sum(children[k][1] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return out


def leaf_budgets(supply: Mapping[tuple[str, ...], int], mixture: Mixture) -> dict[tuple[str, ...], int]:
    """Tokens that each leaf (path from the root) shall give."""
    def divide(path: tuple[str, ...], leaves: dict[tuple[str, ...], int], budget: float) -> dict[tuple[str, ...], int]:
        depth = len(path)
        if len(leaves) == 1 and path in leaves:
            return {path: int(budget + 1e-6)}
        below: dict[str, dict[tuple[str, ...], int]] = {}
        for leaf, n in leaves.items():
            below.setdefault(leaf[depth], {})[leaf] = n
        names = sorted(below)
        shares = fill(budget, [(mixture.weights.get((*path, c), 1.0), sum(below[c].values()) * mixture.max_epochs) for c in names])
        out: dict[tuple[str, ...], int] = {}
        for c, share in zip(names, shares):
            out |= divide((*path, c), below[c], share)
        return out

    total = sum(supply.values())
    return divide((), dict(supply), min(mixture.budget_share, mixture.max_epochs) * total) if total else {}


def word_tokens(text: str = "text") -> Column:
    """White-space delimited words of a text; null and blank texts have none."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("\\S+")).cast("long")


def _key(seed: int, *columns: str) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def plan(stats: DataFrame, levels: list[str], mixture: Mixture) -> DataFrame:
    """One row per leaf: the level columns, whole_epochs, and of the epoch after them ``below`` and ``upto``.

    Of that epoch the hashes less than ``below`` are taken, and those not greater than ``upto``; both are null where the
    budget is whole epochs. ``stats`` has the level columns, ``key`` and ``tokens``.
    """
    spark = stats.sparkSession
    supply = stats.groupBy(*levels).agg(F.sum("tokens").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(supply) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves: choose coarser levels")
    own = {tuple(r[c] for c in levels): r.n for r in supply}
    budgets = leaf_budgets(own, mixture)
    rows = [(*leaf, t // own[leaf] if own[leaf] else 0, t % own[leaf] if own[leaf] else 0) for leaf, t in budgets.items()]
    leaves = F.broadcast(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in levels) + ", whole_epochs long, rest long"))
    # the order of the epoch that is cut
    inside = stats.join(leaves, levels).where("rest > 0").select(*levels, "rest", F.lit(0).cast("long").alias("before"), "tokens", F.xxhash64("key", "whole_epochs").alias("h"))
    for level in range(1, RANGE_LEVELS + 1):
        inside = inside.withColumn("range", F.shiftright("h", 64 - level * RANGE_BITS))
        ranges = inside.groupBy(*levels, "rest", "before", "range").agg(F.sum("tokens").alias("n"))
        upto = Window.partitionBy(*levels).orderBy("range")
        ranges = ranges.withColumn("before", F.col("before") + F.sum("n").over(upto) - F.col("n"))
        # the rest is less than the leaf has, so exactly one range doesn't fit
        cut = materialise(ranges.where("before <= rest and before + n > rest").select(*levels, "range", "before"))
        # one row per leaf, at most MAX_LEAVES
        inside = inside.drop("before").join(F.broadcast(cut), [*levels, "range"])
    places = inside.groupBy(*levels, "rest", "before", "h").agg(F.sum("tokens").alias("tokens"))
    fitting = places.withColumn("total", F.col("before") + F.sum("tokens").over(Window.partitionBy(*levels).orderBy("h"))).where("total <= rest")
    last = fitting.groupBy(*levels).agg(F.max("h").alias("upto"))
    # the least hash of the cut range is the border, and not itself taken with what is below it
    border = cut.select(*levels, F.shiftleft("range", 64 - RANGE_LEVELS * RANGE_BITS).alias("below"))
    return leaves.join(border, levels, "left").join(last, levels, "left").select(*levels, "whole_epochs", "below", "upto")


def with_leaf(docs: DataFrame, levels: Mapping[str, Column | str], seed: int, doc_id: str, text: str) -> DataFrame:
    """Each row as the struct ``_row``, with the level columns as ``_level_n`` (null as "(none)"), ``_key`` and ``_tokens``."""
    named = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(MISSING)).alias(f"_level_{k}") for k, c in enumerate(levels.values())]
    return docs.select(F.struct("*").alias("_row"), *named, _key(seed, doc_id, text).alias("_key"), word_tokens(text).alias("_tokens"))


def mix(docs: DataFrame, levels: Mapping[str, Column | str], mixture: Mixture, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The selected rows, one per epoch that takes them: the ``keep`` columns (all by default), the levels, tokens, epoch.

    ``levels`` names the tree from the root down, each by a column or an expression. Null levels are a sibling of their
    own. Texts without words cost nothing and are taken with the whole epochs of their leaf, or if their hash lies in the
    prefix. Repeated rows share a hash and are taken or left together. A leaf of weight 0 gives nothing. An empty table
    gives an empty result. Columns of the input that are named tokens or epoch are replaced, others may have any name.
    """
    names = [f"_level_{k}" for k in range(len(levels))]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("tokens", "epoch")]
    rows = with_leaf(docs, levels, mixture.seed, doc_id, text)
    stats = materialise(rows.select(*names, F.col("_key").alias("key"), F.col("_tokens").alias("tokens")))
    leaves = materialise(plan(stats, names, mixture))
    h = F.xxhash64("_key", "whole_epochs")
    epochs = F.when((h < F.col("below")) | (h <= F.col("upto")), F.col("whole_epochs") + 1).otherwise(F.col("whole_epochs"))
    # one row per leaf, at most MAX_LEAVES
    taken = rows.join(F.broadcast(leaves), names).withColumn("_epochs", epochs).where("_epochs > 0")
    own = [F.col(f"_row.`{c}`").alias(c) for c in keep]
    out = [F.col(n).alias(c) for n, c in zip(names, levels) if c not in keep]
    return taken.select(*own, *out, F.col("_tokens").alias("tokens"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_epochs") - 1)).alias("epoch"))
