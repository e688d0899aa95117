"""SimHash near-dedup (operator 9): fingerprints, and their self-join by walking pairs of binary-trie nodes.

Distribution. Fingerprints within ``errors`` bits of each other that are cut into parts agree in all but ``errors`` of them.
One row per fingerprint and choice of that many parts brings each linked pair together under one key at least (15 keys for
6 parts and 4 errors, each of some 21 bits), and few others; there are more parts, and so longer keys, the more
fingerprints there are. Equal fingerprints are one row.

Within a key the rows form a binary trie. Starting from (root, root), pairs of nodes are walked down together, one bit a
step; a pair that takes different branches spends one error, and a pair over its budget is dropped with all below it. The
walk handles many pairs at once in NumPy, and only a spanning forest of the links of each key leaves the task. Keys with
more rows than a block are cut into salted blocks; each pair of blocks is a group of its own.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobloom.llm.components import connected_components
from jobloom.sources.tables import materialise

BITS = 64
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_fingerprint(text: str | None, shingle: int = 4, seed: int = 42, distinct: bool = False) -> int:
    """64 bits; bit i is 1 if it is set in over half of the hashes of the text's word shingles. No words: 0.

    ``distinct`` counts a shingle that repeats in the text once.
    """
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    shingles = map(b" ".join, zip(*(itertools.islice(words, j, n + j) for j in range(shingle))))
    if distinct:
        n = len(shingles := set(shingles))
    shingles = iter(shingles)
    count = np.zeros(BITS, np.int64)
    for _ in range(0, n, 1 << 16):
        hashes = np.fromiter((digest(x, seed) for x in itertools.islice(shingles, 1 << 16)), ">u8")
        count += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, seed: int = 42, out: str = "fp", distinct: bool = False) -> DataFrame:
    """Every row with its fingerprint as a signed long in ``out``, without the text."""

    @F.pandas_udf("long")
    def fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([text_fingerprint(t, shingle, seed, distinct) for t in batch], np.uint64).view(np.int64))

    return docs.withColumn(out, fingerprint(F.col(text))).drop(text)


class Forest:
    """Trees over rows 0 to n - 1, each row with the least row of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        rest, least = _forest(len(self.root), self.root[i], self.root[j])
        if len(rest):
            to = np.arange(len(self.root))
            to[rest] = least
            self.root = to[self.root]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows that aren't the least of their tree, and the least."""
        rest = np.flatnonzero(self.root != np.arange(len(self.root)))
        return rest, self.root[rest]


def trie_join(values: np.ndarray, left: np.ndarray, right: np.ndarray, errors: int, forest: Forest, most_pairs: int = 2048, leaf: int = 64) -> None:
    """Join in ``forest`` the rows of ``values`` (uint64) that differ in at most ``errors`` bits, one of ``left``, one of ``right``.

    The trie is implicit: rows are sorted, and a node is a range of them that shares its first bits. A pair of nodes is two
    ranges and the bits they differ in so far. Pairs are walked depth first in portions of ``most_pairs``, equal branches
    before unequal ones, so that memory is bounded however many rows are linked; a pair of nodes whose rows are in one tree
    already is dropped with all below it.
    """
    if not len(left) or not len(right):
        return
    own = left is right
    left = left[np.argsort(values[left], kind="stable")]
    right = left if own else right[np.argsort(values[right], kind="stable")]
    x, y = values[left], values[right]
    todo = [(0, tuple(np.array([k]) for k in (0, len(left), 0, len(right), 0)))]
    while todo:
        depth, pairs = todo.pop()
        a0, a1, b0, b1, spent = pairs
        tree_a, tree_b = forest.root[left], forest.root[right]
        turns_a, turns_b = (np.r_[0, np.cumsum(t[1:] != t[:-1])] for t in (tree_a, tree_b))
        joined = (turns_a[a1 - 1] == turns_a[a0]) & (turns_b[b1 - 1] == turns_b[b0]) & (tree_a[a0] == tree_b[b0])
        a0, a1, b0, b1, spent = (p[~joined] for p in (a0, a1, b0, b1, spent))
        small = (a1 - a0) * (b1 - b0) <= leaf  # few enough to count the bits of each
        if depth == BITS:
            small[:] = True
        for k in range(0, int(small.sum()), most_pairs):
            some = np.flatnonzero(small)[k : k + most_pairs]
            if depth == BITS:  # all rows of the two are alike
                i, j = _products(a0[some], a0[some] + 1, b0[some], b1[some])
                forest.join(left[i], right[j])
                i, j = _products(a0[some], a1[some], b0[some], b0[some] + 1)
            else:
                i, j = _products(a0[some], a1[some], b0[some], b1[some])
                near = np.bitwise_count(x[i] ^ y[j]) <= errors
                i, j = i[near], j[near]
            forest.join(left[i], right[j])
        a0, a1, b0, b1, spent = (p[~small] for p in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        bit = np.uint64(BITS - 1 - depth)
        a, b = _first_one(x, a0, a1, bit), _first_one(y, b0, b1, bit)
        kids = [(a0, a, b0, b, spent), (a, a1, b, b1, spent), (a0, a, b, b1, spent + 1), (a, a1, b0, b, spent + 1)]
        a0, a1, b0, b1, spent = (np.concatenate(k) for k in zip(*kids))
        keep = (a1 > a0) & (b1 > b0) & (spent <= errors)
        if own:
            keep &= a0 <= b0  # the other order is the same pair
        pairs = tuple(p[keep] for p in (a0, a1, b0, b1, spent))
        cuts = range(0, len(pairs[0]), most_pairs)
        todo.extend((depth + 1, tuple(p[k : k + most_pairs] for p in pairs)) for k in reversed(cuts))


def _first_one(values: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the bit becomes 1 in each range; below the node all earlier bits are equal, so its rows are sorted by it."""
    ones = np.concatenate([[0], np.cumsum((values >> bit) & np.uint64(1), dtype=np.int64)])
    return end - (ones[end] - ones[start])


def _products(a0, a1, b0, b1) -> tuple[np.ndarray, np.ndarray]:
    width, size = b1 - b0, (a1 - a0) * (b1 - b0)
    of = np.repeat(np.arange(len(size)), size)
    k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    return a0[of] + k // width[of], b0[of] + k % width[of]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A node and the least node of its component, for nodes that aren't the least."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    rest = np.flatnonzero(root != np.arange(n))
    return rest, root[rest]


def pigeonhole_blocks(n: int, errors: int) -> int:
    """The fewest parts of which those left equal by ``errors`` changed ones have log2(n) bits, so that keys stay rare."""
    blocks = errors + 1
    while BITS * (blocks - errors) / blocks < math.log2(max(2, n)) and blocks < 2 * errors:
        blocks += 1
    return blocks


def pigeonhole_keys(fp: str, errors: int, blocks: int) -> Column:
    """(choice, part): each choice of ``blocks - errors`` parts of the fingerprint."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    masks = [((1 << edges[k + 1]) - (1 << edges[k])) for k in range(blocks)]
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(blocks), blocks - errors)):
        mask = sum(masks[k] for k in chosen)
        keys.append(F.struct(F.lit(n).cast("int").alias("choice"), F.col(fp).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("part")))
    return F.array(*keys)


def fingerprint_links(prints: DataFrame, keys: Column, errors: int = 4, block_rows: int = 1024) -> DataFrame:
    """Links (a, b) that keep all components of the rows (id, fp) that have a key in common and differ in ``errors`` bits or fewer.

    ``keys`` is an array of (choice, part). Ids are distinct longs.
    """
    keyed = prints.select("id", "fp", F.explode(keys).alias("k")).select("id", "fp", "k.*")
    sized = keyed.groupBy("choice", "part").agg(F.count("*").alias("n")).where("n > 1")
    # a row of a large key goes to every pair of blocks that its own salt takes part in; rows alone under a key go nowhere
    with_salts = keyed.join(sized, ["choice", "part"]).withColumn("salts", F.ceil(F.col("n") / block_rows).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(F.least(s, own).alias("s"), F.greatest(s, own).alias("t")))
    dealt = with_salts.select("id", "fp", "choice", "part", own.alias("own"), F.explode(pairs).alias("p")).select("id", "fp", "choice", "part", "own", "p.*")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, ["choice", "part", "s", "t"]):
            yield _links_of(rows, errors)

    ordered = dealt.repartition("choice", "part", "s", "t").sortWithinPartitions("choice", "part", "s", "t", "fp")
    return ordered.mapInPandas(walk, "a long, b long")


def _whole_groups(batches: Iterator[pd.DataFrame], cols: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of batches sorted by ``cols``, cut between groups only."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[cols].iloc[-1]
        open_ = (batch[cols] == last).all(axis=1).to_numpy()
        if open_.all() and held and (held[-1][cols].iloc[-1] == last).all():
            held.append(batch)
            continue
        cut = int(np.argmax(open_))
        yield pd.concat([*held, batch[:cut]])
        held = [batch[cut:]]
    if held:
        yield pd.concat(held)


def _links_of(rows: pd.DataFrame, errors: int) -> pd.DataFrame:
    """Forest links of complete (choice, part, s, t) groups that lie one after another, each sorted by fingerprint."""
    keys = rows[["choice", "part", "s", "t"]].to_numpy()
    ids, own = rows["id"].to_numpy(), rows["own"].to_numpy()
    fp = rows["fp"].to_numpy().view(np.int64).view(np.uint64)
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, int)
    ends = np.r_[starts[1:], len(rows)] if len(rows) else starts
    out_a, out_b = [], []
    sizes = ends - starts
    # groups of two to eight rows, the usual kind, together
    few = (sizes > 1) & (sizes <= 8)
    if few.any():
        i, j = _products(starts[few], ends[few], starts[few], ends[few])
        near = (i < j) & (np.bitwise_count(fp[i] ^ fp[j]) <= errors)
        out_a.append(ids[i[near]])
        out_b.append(ids[j[near]])
    for a, b in zip(starts[sizes > 8], ends[sizes > 8]):
        s, t = keys[a, 2], keys[a, 3]
        left = np.flatnonzero(own[a:b] == s)
        right = left if s == t else np.flatnonzero(own[a:b] == t)
        if len(left) and len(right):
            forest = Forest(b - a)
            trie_join(fp[a:b], left, right, errors, forest)
            rest, least = forest.links()
            out_a.append(ids[a + rest])
            out_b.append(ids[a + least])
    none = np.zeros(0, np.int64)
    return pd.DataFrame({"a": np.concatenate([none, *out_a]), "b": np.concatenate([none, *out_b])})


#: Keys that the rows of one very common fingerprint are dealt over.
SALTS = 64


def near_duplicates(docs: DataFrame, errors: int = 4, shingle: int = 4, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links.

    Null and empty texts have the fingerprint 0, which links like any other. Rows with one doc_id several times stay, each
    with its own fingerprint. A row without doc_id never gives a component its id; a component of such rows only has a
    null id. An empty table gives an empty result. Other columns are ignored.
    """
    prints = materialise(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle, seed))
    # a node is named by its least doc_id, so that a component's name is its least document; those without one come last
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", F.struct(F.col("least").isNull().alias("unnamed"), "least", "fp").alias("node")))
    keys = pigeonhole_keys("fp", errors, pigeonhole_blocks(distinct.count(), errors))
    links = materialise(fingerprint_links(distinct.select(F.col("fp").alias("id"), "fp"), keys, errors).distinct())
    ends = [distinct.select(F.col("fp").alias(c), F.col("node").alias(f"node_{c}")) for c in ("a", "b")]
    named = links.join(ends[0], "a").join(ends[1], "b")
    member = connected_components(named, "node_a", "node_b").select(F.col("node.fp").alias("fp"), F.col("component.least").alias("component_id"), F.lit(True).alias("linked"))
    every = distinct.join(member, "fp", "left").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("node.least")).alias("component_id"))
    # all empty texts have the fingerprint 0: its rows are dealt over so many keys
    salted = prints.withColumn("salt", F.when(F.col("fp") == 0, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).otherwise(0))
    every = every.withColumn("salt", F.explode(F.when(F.col("fp") == 0, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).withColumn("salt", F.col("salt").cast("long"))
    return salted.join(every, ["fp", "salt"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, shingle: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; a shorter text is one shingle, no words are none."""
    import xxhash

    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    n, digest = max(1, len(words) - shingle + 1), xxhash.xxh64_intdigest
    shingles = {b" ".join(words)} if n == 1 else set(map(b" ".join, zip(*(itertools.islice(words, j, n + j) for j in range(shingle)))))
    return np.unique(np.fromiter((digest(x, seed) for x in shingles), np.uint64, len(shingles)))


def _majority(hashes: np.ndarray) -> int:
    """The fingerprint of distinct shingles from their hashes."""
    count = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        count += np.unpackbits(hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes)).tobytes(), "big")


def _set_key(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), 0)


def _constants(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def bands_of(hashes: np.ndarray, bands: int, rows: int, seed: int) -> np.ndarray:
    """A hash of each band of ``rows`` MinHash values; two sets agree in a band with the power ``rows`` of their similarity."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    n = bands * rows
    factor, add = _constants(seed, n), _constants(seed + 1, n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[k : k + 1024, None] * factor + add).min(axis=0))
    return (least * _constants(seed + 2, n)).reshape(bands, rows).sum(axis=1, dtype=np.uint64)


def _sketches(docs: DataFrame, shingle: int, seed: int, bands: int, band_rows: int) -> DataFrame:
    """``docs`` with fp (fingerprint of distinct shingles), key (hash of their set) and bands, without the text."""

    @F.pandas_udf("fp long, key long, bands array<long>")
    def sketch(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            sets = [shingle_set(t, shingle, seed) for t in batch]
            out = {"fp": np.array([_majority(x) for x in sets], np.uint64).view(np.int64), "key": np.array([_set_key(x) for x in sets], np.uint64).view(np.int64)}
            yield pd.DataFrame(out | {"bands": [bands_of(x, bands, band_rows, seed).view(np.int64) for x in sets]})

    return docs.withColumn("_s", sketch("text")).select(*[c for c in docs.columns if c != "text"], "_s.*")


def _set_links(ids: np.ndarray, sets: list[np.ndarray], similarity: float, trees: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep all components of the sets whose Jaccard similarity is at least ``similarity``.

    A set that has been reached is compared with those that haven't; what is linked already needs no more comparisons.
    Sets of one of ``trees`` are linked beforehand.
    """
    some = np.array([k for k, x in enumerate(sets) if len(x)], np.int64)
    none = np.zeros(0, np.int64)
    if len(some) < 2:
        return none, none
    tree = np.arange(len(some)) if trees is None else trees[some]
    size = np.array([len(sets[k]) for k in some])
    values, codes = np.unique(np.concatenate([sets[k] for k in some]), return_inverse=True)
    ends = np.cumsum(size)
    mark = np.zeros(len(values), bool)
    left, left_codes, left_size = np.arange(len(some)), codes, size
    reached: list[int] = []
    out_a, out_b = [], []
    while len(left):
        if not reached:
            with_it = tree[left] == tree[left[0]]
        else:
            u = reached.pop()
            own = codes[ends[u] - size[u] : ends[u]]
            mark[own] = True
            both = np.add.reduceat(mark[left_codes], np.cumsum(left_size) - left_size, dtype=np.int64)
            mark[own] = False
            near = both / (size[u] + left_size - both) >= similarity
            if not near.any():
                continue
            out_a.append(np.full(near.sum(), ids[some[u]]))
            out_b.append(ids[some[left[near]]])
            with_it = np.isin(tree[left], tree[left[near]])
        reached.extend(left[with_it])
        left, left_codes, left_size = left[~with_it], left_codes[np.repeat(~with_it, left_size)], left_size[~with_it]
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _compared(dealt: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of rows (component, s, t, key, tree, shingles) within each (component, s, t)."""
    cols = ["component", "s", "t"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _whole_groups(batches, cols):
            groups = rows[cols].to_numpy()
            starts = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]).any(axis=1)]) if len(rows) else np.zeros(0, int)
            ids, trees, sets = rows["key"].to_numpy(), rows["tree"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
            for a, b in zip(starts, np.r_[starts[1:], len(rows)]):
                i, j = _set_links(ids[a:b], sets[a:b], similarity, trees[a:b])
                if len(i):
                    yield pd.DataFrame({"a": i, "b": j})

    return dealt.select("key", "tree", "shingles", *cols).repartition(*cols).sortWithinPartitions(*cols).mapInPandas(compare, "a long, b long")


def _centre_links(large: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) of the rows (component, key, fp, shingles) to the one nearest to the majority fingerprint of their component.

    Copies of one text with edits of their own are all near to it and less so to each other.
    """
    bit = lambda k: F.shiftrightunsigned("fp", k).bitwiseAND(F.lit(1))
    majority = F.lit(0).cast("long")
    for k in range(BITS):
        majority = majority.bitwiseOR(F.when(2 * F.col(f"b{k}") > F.col("n"), F.lit((1 << k) - (1 << 64) if k == 63 else 1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    centre = materialise(large.groupBy("component").agg(F.count("*").alias("n"), *[F.sum(bit(k)).alias(f"b{k}") for k in range(BITS)]).select("component", majority.alias("centre")))
    far = F.struct(F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))), F.col("key"))
    nearest = materialise(large.select("component", "key", "fp").join(centre, "component").groupBy("component").agg(F.min_by("key", far).alias("pivot")))
    pivots = materialise(nearest.join(large.select(F.col("key").alias("pivot"), F.col("shingles").alias("other")), "pivot"))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
            out.append(both / max(1, (len(x) + len(y)) // 8 - both) >= similarity)
        return pd.Series(out, dtype=bool)

    return large.join(pivots, "component").where("key <> pivot").where(alike("shingles", "other")).select(F.col("key").alias("a"), F.col("pivot").alias("b"))


def _similar_links(texts: DataFrame, shingle: int, similarity: float, seed: int, block_rows: int, block_bytes: int) -> DataFrame:
    """Links (a, b) of the rows (key, text, component, fp) that keep all components of texts alike within their ``component``.

    A row counts only if ``key`` is its text's own. Every two texts of a component are compared by their sets of shingles.
    A component of more than ``block_rows`` rows or ``block_bytes`` bytes of hashes is first linked to its centre. Of what
    isn't linked by then to its largest tree, the others, blocks are made, and each pair of two such blocks, or of one and
    a block of the largest tree, is a group of its own; rows of one tree aren't compared again.
    """

    def with_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, shingle, seed) for t in batch["text"]]
            own = np.array([_set_key(x) for x in sets], np.uint64).view(np.int64) == batch["key"].to_numpy()
            if own.any():
                yield batch.drop(columns="text").assign(shingles=[x.tobytes() for x in sets])[own]

    sets = materialise(texts.select("key", "component", "fp", "text").mapInPandas(with_set, "key long, component long, fp long, shingles binary").dropDuplicates(["key"]))
    sizes = sets.groupBy("component").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.octet_length("shingles")) / block_bytes)).cast("int").alias("parts"))
    sized = sets.join(materialise(sizes), "component")
    at = [F.lit(0).alias("s"), F.lit(0).alias("t")]
    links = materialise(_compared(sized.where("parts = 1").select("key", "component", "shingles", F.col("key").alias("tree"), *at), similarity))
    large = materialise(sized.where("parts > 1").drop("parts"))
    if large.isEmpty():
        return links
    star = materialise(_centre_links(large, similarity))
    member = materialise(connected_components(star).select(F.col("node").alias("key"), F.col("component").alias("tree")))
    trees = large.join(member, "key", "left").withColumn("tree", F.coalesce("tree", "key"))
    weight = F.struct(F.count("*").alias("n"), F.sum(F.octet_length("shingles")).alias("bytes"))
    by_tree = materialise(trees.groupBy("component", "tree").agg(weight.alias("w")))
    parts = lambda n, size: F.greatest(F.ceil(n / block_rows), F.ceil(size / block_bytes)).cast("int")
    largest = by_tree.groupBy("component").agg(F.max_by("tree", F.struct("w.n", "tree")).alias("most"), F.max(F.struct("w.n", "tree", "w.bytes")).alias("top"), F.sum("w.n").alias("n"), F.sum("w.bytes").alias("bytes"))
    plan = materialise(largest.select("component", "most", parts(F.col("top.n"), F.col("top.bytes")).alias("mosts"), parts(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("others")).where("others > 0"))
    salt = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pair = lambda s, t: F.struct(s.cast("int").alias("s"), t.cast("int").alias("t"))
    of_most = F.transform(upto("others"), lambda o: pair(-1 - salt("mosts"), o))
    of_other = F.concat(F.transform(upto("others"), lambda o: pair(F.least(o, salt("others")), F.greatest(o, salt("others")))), F.transform(upto("mosts"), lambda m: pair(-1 - m, salt("others"))))
    dealt = trees.join(plan, "component").select("key", "component", "shingles", "tree", F.explode(F.when(F.col("tree") == F.col("most"), of_most).otherwise(of_other)).alias("p"))
    return links.unionByName(star).unionByName(_compared(dealt.select("key", "component", "shingles", "tree", "p.*"), similarity))


def one_of_each(
    docs: DataFrame, shingle: int = 5, similarity: float = 0.8, errors: int = 22, bands: int = 24, band_rows: int = 5, seed: int = 42, doc_id: str = "doc_id", text: str = "text", block_rows: int = 512, block_bytes: int = 8 << 20
) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the least doc_id stays.

    Two texts are linked if they share ``similarity`` of their distinct ``shingle``-word shingles (Jaccard). Fingerprints
    only search. Rows meet under the bands of MinHash values that they have in common (texts that share 0.8 miss each
    other in all 24 bands of 5 once in 14,000 times, and unrelated ones hardly meet, at any number of rows); of those that
    meet, the trie join leaves pairs whose SimHash fingerprints differ in ``errors`` bits or fewer (10 on average at 0.8, 22
    are four standard deviations off, unrelated ones 32). Within each component of candidates all texts are compared by
    their shingles; a group is a component of these exact links, so that its ends may share less.

    Null and empty texts are copies of each other. Texts are told apart by doc_id and hashes, so that different texts of
    one doc_id are documents of their own; of repeated rows one stays, the first by the hash of all columns. Rows without
    doc_id are no copies of anything and stay. An empty table gives an empty result. Columns may have any name.
    """
    rows = docs.select(F.struct("*").alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumns({"k": F.xxhash64(F.coalesce("text", F.lit(""))), "k2": F.xxhash64(F.lit(1), F.coalesce("text", F.lit("")))})
    node = ["doc_id", "k", "k2"]
    own = rows.where("doc_id is not null").select(*node, "text")
    prints = _sketches(own, shingle, seed, bands, band_rows)
    # texts of equal shingles are one node
    nodes = materialise(prints.groupBy("key").agg(F.min(F.struct(*node)).alias("id"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    keys = F.transform("bands", lambda x, i: F.struct(i.alias("choice"), x.alias("part")))
    found = materialise(connected_components(fingerprint_links(nodes.select(F.col("key").alias("id"), "fp", "bands"), keys, errors)))
    suspects = found.join(nodes.select(F.col("key").alias("node"), "fp", "id.*"), "node").withColumnRenamed("node", "key")
    member = connected_components(_similar_links(own.join(suspects, node), shingle, similarity, seed, block_rows, block_bytes)).select(F.col("node").alias("key"), "component")
    named = nodes.select("id", "key").join(materialise(member), "key", "left")
    best = named.where("component is not null").groupBy("component").agg(F.min("id").alias("id"))
    kept = named.where("component is null").select("id.*").unionByName(best.select("id.*"))
    whole = rows.where("doc_id is not null").join(kept, node, "left_semi")
    first = whole.withColumn("_place", F.row_number().over(Window.partitionBy(*node).orderBy(F.xxhash64("_row")))).where("_place = 1")
    return first.select("_row.*").unionByName(rows.where("doc_id is null").select("_row.*"))
