"""Document fingerprints (operator 2): one-permutation MinHash in DataFrame functions.

Every shingle of five words is hashed once. The first bits of a hash choose its bin, and each bin keeps its least hash:
the hashes are sorted together with one sentinel per bin, so the first of each bin's run is its least hash, or the
sentinel where the bin is empty. An empty bin borrows from a bin that a fixed random sequence of its own finds first
(optimal densification), the same for every document. The low-order bits of all bins are packed into longs; likeness is
the share of equal bins, corrected for those that agree by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.functions.ordering import with_position
from jobloom.sources.tables import materialise

BIN_BITS = 8
BINS = 1 << BIN_BITS
#: Low-order bits kept of each bin.
KEPT_BITS = 4
#: Bins that an empty bin tries first; after these the filled bin that comes first in a random order of its own.
TRIES = 8
#: Places among the low-order bits that bins take theirs from.
PLACES = 10
SHINGLE = 5
BLANK = " \t\n\r\x0b\x0c"

_LOW = 64 - BIN_BITS


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _donors(seed: int) -> list[int]:
    rng = random.Random(seed)
    return [rng.randrange(BINS) for _ in range(BINS * TRIES)]


def shingle_hashes(words: Column) -> Column:
    """Hashes of all shingles of a column of word hashes; of fewer words, one of the whole sequence; of none, none."""
    rest = F.transform(F.slice(words, 1, F.size(words) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *(F.get(words, i + k) for k in range(1, SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, rest).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def with_signature(df: DataFrame, text: str, out: str, seed: int = 7) -> DataFrame:
    """``df`` with the packed signature of a text column: 16 longs of 16 bins each; null for a text without words.

    The steps are columns of their own, since each refers to the one before many times.
    """
    words, hashes, runs, least = (f"_{out}_{x}" for x in ("words", "hashes", "runs", "least"))
    blank = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANK))
    sentinels = F.lit([_signed((b << _LOW) | ((1 << _LOW) - 1)) for b in range(BINS)])
    is_empty = lambda x: x.bitwiseAND(F.lit((1 << _LOW) - 1)) == F.lit((1 << _LOW) - 1)
    bin_of = lambda x: F.shiftrightunsigned(x, _LOW)
    donors = F.lit(_donors(seed))
    df = df.withColumn(words, F.when(blank == "", F.array().cast("array<bigint>")).otherwise(F.transform(F.split(blank, "[ \\t\\n\\r\\x0b\\x0c]+"), lambda w: F.xxhash64(w))))
    df = df.withColumn(hashes, shingle_hashes(F.col(words)))
    df = df.withColumn(runs, F.sort_array(F.concat(F.col(hashes), sentinels)))
    df = df.withColumn(least, F.filter(runs, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(F.col(runs), i - 1)))))
    mins = F.col(least)

    def borrow(i: Column) -> Column:
        tried = F.get(F.filter(F.transform(F.slice(donors, i * TRIES + 1, TRIES), lambda j: F.get(mins, j)), lambda x: ~is_empty(x)), F.lit(0))
        last = F.array_min(F.transform(F.filter(mins, lambda x: ~is_empty(x)), lambda x: F.struct(F.xxhash64(i, bin_of(x)).alias("h"), x.alias("x"))))
        return F.coalesce(tried, last["x"])

    # each bin keeps other bits than its neighbours, so bins that borrow from one donor don't agree by chance together
    shift = lambda x, i: F.call_function("shiftrightunsigned", x, (i % PLACES) * KEPT_BITS)
    filled = F.transform(mins, lambda x, i: shift(F.when(is_empty(x), borrow(i)).otherwise(x), i))
    full = f"_{out}_full"
    df = df.withColumn(full, F.when(F.size(words) > 0, filled))
    per_long = 64 // KEPT_BITS
    packed = F.transform(F.sequence(F.lit(0), F.lit(BINS // per_long - 1)), lambda w: F.aggregate(F.slice(F.col(full), w * per_long + 1, per_long), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, KEPT_BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << KEPT_BITS) - 1)))))
    return df.withColumn(out, F.when(F.col(full).isNotNull(), packed)).drop(words, hashes, runs, least, full)


def as_hex(signature: Column) -> Column:
    """The packed bins as hex digits; empty for a text without words."""
    return F.coalesce(F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1. Two texts without words are alike, one with and one without are not."""
    low = int("1" * (64 // KEPT_BITS), 16)
    differing = lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(low)))
    missed = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    chance = 1.0 / (1 << KEPT_BITS)
    estimate = F.greatest(F.lit(0.0), ((F.lit(1.0) - missed / F.lit(float(BINS))) - chance) / (1.0 - chance))
    return F.when(a.isNull() & b.isNull(), F.lit(1.0)).when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise(estimate)


def with_next(docs: DataFrame, share: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document once, with its key, the key of the one before in ascending doc_id, and its edited text.

    Documents are the distinct pairs of doc_id and text (null text: empty), nulls first, one doc_id's texts by their hash.
    The edited text has the last floor(n_chars / ``share``) code points replaced by as many first ones of the next
    document, or all it has; after the last comes the first. Only positions and lengths are ordered; a text moves once,
    and the part of it that the document before takes once more.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = docs.withColumns({"k": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", "doc_id")})
    sizes = keyed.select("k", "k2", "doc_id", F.char_length("text").alias("n")).distinct()
    placed = materialise(with_position(sizes, "doc_id", "k", "k2"))
    count = placed.count()
    before = placed.select(F.pmod(F.col("position") + 1, F.lit(max(1, count))).alias("position"), F.col("k").alias("before_k"), F.col("k2").alias("before_k2"), F.col("n").alias("before_n"))
    order = materialise(placed.select("position", "k", "k2").join(before, "position").drop("position"))
    from pyspark.sql import Window

    once = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("k", "k2").orderBy("k"))).where("_r = 1").drop("_r")
    linked = once.join(order, ["k", "k2"])
    # the same columns as the other side of the join below, so that the texts are shuffled once for both
    heads = linked.select(F.col("before_k").alias("k"), F.col("before_k2").alias("k2"), F.col("doc_id").alias("next_doc_id"), F.expr(f"substring(text, 1, int(before_n div {share}))").alias("head"))
    cut = F.expr(f"substring(text, 1, char_length(text) - int(char_length(text) div {share}))")
    return linked.drop("before_n").join(heads, ["k", "k2"]).withColumn("edited", F.concat(cut, "head")).drop("head")


def fingerprint_edits(docs: DataFrame, share: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to each other and to the next document.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_doc_id. A row that repeats
    another's doc_id and text is the same document. Texts without words have the empty fingerprint. An empty table gives
    an empty result; other columns are ignored.
    """
    rows = with_next(docs, share, doc_id, text)
    rows = with_signature(with_signature(rows, "text", "own"), "edited", "changed")
    rows = materialise(rows.select("k", "k2", "before_k", "before_k2", "doc_id", "next_doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "own", "changed"))
    after = rows.select(F.col("before_k").alias("k"), F.col("before_k2").alias("k2"), F.col("own").alias("next"))
    return rows.join(after, ["k", "k2"]).select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("own")).alias("fingerprint"), as_hex(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"), "next_doc_id",
    )
