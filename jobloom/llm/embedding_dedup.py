"""Embedding near-dedup (operator 3): spherical k-means cells, blocked cosine products within them.

Equal vectors are one row with a weight. The centres are fitted on a bounded sample; every vector is then assigned to the
cell of its nearest centre, its home, and visits the cells whose border it lies near: no vector within the threshold's
angle of it can lie beyond a border that it is further from than the sine of that angle. No link is lost, whatever the
number of cells; vectors without clusters visit nearly all cells, and then nearly all pairs are compared.
Cells are few and large, since each visit is a row. A vector's links are counted in its home cell against all that live
there or visit it. Cells are cut into blocks of rows, and each pair of blocks is a task of its own, so that no cell's size
bounds anything; a task returns counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm.components import connected_components
from jobloom.llm.simhash import _forest
from jobloom.sources.tables import materialise


def unit(vectors: list) -> np.ndarray:
    """Rows of length 1 in double precision; first scaled by the largest component, so that squares don't overflow."""
    x = np.asarray([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres; a centre that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(rounds):
        nearest = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centres = np.where(norms > 1e-9, sums / np.maximum(norms, 1e-9), centres)
    return centres


def _cells(reps: DataFrame, centres: np.ndarray, threshold: float) -> DataFrame:
    """Rows (cell, home, id, weight, v): each vector once at home and once in every cell that it visits."""
    dimension = centres.shape[1]
    apart = np.stack([np.sqrt(((centres - c) ** 2).sum(axis=1)) for c in centres])
    # a linked vector's angle to this one is at most the threshold's; beyond a right angle nothing is spared
    furthest = float(np.sqrt(1 - threshold * threshold)) if threshold > 0 else np.inf

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len).to_numpy()
            other = batch[sizes != dimension]
            if len(other):  # no centres of that dimension: one cell for it
                yield other.assign(cell=-sizes[sizes != dimension], home=True)[["cell", "home", "id", "weight", "v"]]
            own = batch[sizes == dimension].reset_index(drop=True)
            for i in range(0, len(own), 2048):
                part = own[i : i + 2048].reset_index(drop=True)
                near = unit(list(part["v"])) @ centres.T
                home = near.argmax(axis=1)
                # the distance from the border, times that of the centres; the last term is far above rounding
                row, cell = np.nonzero(near.max(axis=1, keepdims=True) - near <= furthest * apart[home] + 1e-9)
                out = part.iloc[row].reset_index(drop=True)
                yield out.assign(cell=cell, home=cell == home[row])[["cell", "home", "id", "weight", "v"]]

    return reps.select("id", "weight", "v").mapInPandas(assign, f"cell long, home boolean, id long, weight long, v {reps.schema['v'].dataType.simpleString()}")


def _compare(cells: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """Compare the cells by blocks. Per block pair: (a, null, n) the weight linked to home vector a; (a, b, null) links that keep all components."""
    sizes = cells.groupBy("cell").agg(F.ceil(F.count_if("home") / block_rows).cast("int").alias("homes"), F.ceil(F.count("*") / block_rows).cast("int").alias("alls"))
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_left = F.when(F.col("home"), F.transform(upto("alls"), lambda j: F.struct(salt("homes").alias("i"), j.alias("j"), F.lit(True).alias("left")))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>"))
    as_right = F.transform(upto("homes"), lambda i: F.struct(i.alias("i"), salt("alls").alias("j"), F.lit(False).alias("left")))
    # one row per cell, and the number of cells is bounded: broadcast
    dealt = cells.join(F.broadcast(sizes.where("homes > 0")), "cell").select("cell", "id", "weight", "v", F.explode(F.concat(as_left, as_right)).alias("p")).select("cell", "id", "weight", "v", "p.*")

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["left"]], rows[~rows["left"]]
        if not len(left) or not len(right):
            return pd.DataFrame({"a": [], "b": [], "n": []})
        x, y, weight = unit(list(left["v"])), unit(list(right["v"])).T, right["weight"].to_numpy()
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        counts, rest, least = np.zeros(len(a), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k in range(0, len(a), 256):
            linked = x[k : k + 256] @ y >= threshold
            linked &= a[k : k + 256, None] != b[None, :]
            counts[k : k + 256] = linked @ weight
            i, j = np.nonzero(linked)
            rest, least = _forest(len(ids), np.concatenate([rest, at[k + i]]), np.concatenate([least, at[len(a) + j]]))
        some = counts > 0
        return pd.concat([pd.DataFrame({"a": a[some], "b": None, "n": counts[some]}), pd.DataFrame({"a": ids[rest], "b": ids[least], "n": None})])

    return dealt.groupBy("cell", "i", "j").applyInPandas(block, "a long, b long, n long")


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, cell_rows: int = 8192, max_cells: int = 2048, sample_rows: int = 20_000, block_bytes: int = 6 << 20, seed: int = 5, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (the least vec_id reachable), kept (vec_id = component_id).

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: n_links 0, their own
    component, kept; so do rows without vec_id, whose component is null and which are not kept. Vectors of other
    dimensions than the usual one are compared among themselves. Rows that share a vec_id are one node. The centres are
    fitted on ``sample_rows`` vectors (the first by hash) and their number is the number of distinct vectors over
    ``cell_rows``, at most ``max_cells``. An empty table gives an empty result. Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("v"))
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    keys = {"k": F.xxhash64("v"), "k2": F.xxhash64(F.reverse("v"), F.size("v"))}
    valid = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    reps = materialise(valid.groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")).withColumns(keys))
    info = reps.select("k", "k2", "id", "weight")
    found = reps.agg(F.count("*").alias("n"), F.mode(F.size("v")).alias("d")).first()
    if found.n:
        sample = reps.where(F.size("v") == found.d).orderBy(F.xxhash64(F.lit(seed), "id")).limit(sample_rows).select("v").toPandas()
        centres = spherical_kmeans(unit(list(sample["v"])), min(max_cells, -(-found.n // cell_rows)), seed=seed)
        cells = materialise(_cells(reps, centres, threshold))
        # larger blocks, fewer copies of each vector: as many rows as fit the bytes, whatever their dimension
        out = materialise(_compare(cells, threshold, max(16, block_bytes // (8 * max(1, found.d)))))
        counts = out.where("n is not null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
        member = connected_components(out.where("b is not null")).select(F.col("node").alias("id"), "component")
        info = info.join(counts, "id", "left").join(member, "id", "left")
    else:
        info = info.withColumns({"n": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    info = info.select("k", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    keyed = rows.withColumn("ok", F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))).withColumns(keys).drop("v")
    # rows that link with nothing go around the join: all null vectors have one key
    linked = keyed.where("ok").join(info, ["k", "k2"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    alone = keyed.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
