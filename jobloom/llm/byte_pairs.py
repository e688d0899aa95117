"""Byte-level BPE (operator 13): long texts encoded in overlapping chunks that are stitched where their pre-tokens agree.

Texts of at most ``chunk`` characters are pre-tokenised and encoded where they lie. Longer ones become rows of chunks, each with
the first ``overlap`` characters of the next. Both ends of every chunk are pre-tokenised on their own, the first from the chunk's
start, the last from ``overlap`` characters before its end, so they may begin inside a word and begin wrongly; they tell which
places between pre-tokens they see where chunks overlap, and a border is stitched at the first place that both of its chunks see. What lies between stitches is a piece; pieces are dealt over all tasks, encoded, and the
ids of a text are put together in their order. A border without such a place (a word longer than the overlap) isn't stitched: its
chunks are one piece.

The pre-tokenizer takes runs of letters, of digits or of other marks, perhaps with one space before, contractions, and white
space. So the end of a run, which is no apostrophe, no white space and no contraction, is such a place whatever was read before
it, and only those are told for a chunk's end; what its last three characters could still change isn't.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from jobloom.llm.packing import _BLANKS, _LATIN, _LETTERS, _NUMBERS
from jobloom.llm.token_counts import LONGEST_REMEMBERED, forget
from jobloom.sources.tables import materialise

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 8192, 256
#: Rows that a task encodes or decodes at once.
SLICE = 128
#: What a chunk's end could change in the pre-tokens before it.
_UNSURE = 3


def _latin(pattern: str) -> re.Pattern | None:
    """The pre-tokenizer for texts of the first 256 characters, in the faster module, if its classes are the usual ones."""
    own = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{_BLANKS}{_LETTERS}{_NUMBERS}]")
    for name, chars in ((r"\p{L}", f"[{_LETTERS}]"), (r"\p{N}", f"[{_NUMBERS}]"), (r"\s", f"[{_BLANKS}]"), (r"\S", f"[^{_BLANKS}]")):
        own = own.replace(name, chars)
    return None if r"\p" in own else re.compile(own)


class BytePairs:
    """Ids of texts by a file of ranks, pre-token by pre-token; short pre-tokens are remembered, within a bound."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self._bytes = {rank: token for token, rank in ranks.items()}
        self._merges = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._any, self._latin = regex.compile(pattern), _latin(pattern)
        self._known: dict[str, bytes] = {}

    def pre_tokens(self, text: str) -> list[str]:
        pattern = self._latin if self._latin is not None and _LATIN.fullmatch(text) else self._any
        return pattern.findall(text)

    def places(self, text: str) -> Iterator[tuple[int, str]]:
        """Where pre-tokens end, and what each is."""
        words = self.pre_tokens(text)
        return zip(itertools.accumulate(map(len, words)), words)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian integers of 32 bits."""
        words, known = self.pre_tokens(text), self._known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            forget(known)
            # a pre-token alone is one pre-token, so the library only merges
            new = {w: np.asarray(self._merges(w), "<i4").tobytes() for w in set(words).difference(known)}
            out = b"".join([known[w] if w in known else new[w] for w in words])
            known.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST_REMEMBERED)
            return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids; they needn't be whole characters."""
        return b"".join(map(self._bytes.__getitem__, ids))

    def decode_all(self, ids: list[int], ends: list[int]) -> list[bytes]:
        """The bytes of the ids between each end and the next."""
        tokens = list(map(self._bytes.__getitem__, ids))
        return [b"".join(tokens[a:b]) for a, b in zip(ends, ends[1:])]


_CODERS: dict[tuple[str, str], BytePairs] = {}


def coder(path: str, pattern: str) -> BytePairs:
    """One per file, pattern and Python process."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = BytePairs(path, pattern)
    return _CODERS[path, pattern]


def border_places(own: BytePairs, text: str, body: int, overlap: int) -> tuple[list[int], list[int]]:
    """Places that a chunk sees from its start (its own head) and from the end of its body (the head of the next chunk)."""
    head = [0, *(p for p, _ in own.places(text[: overlap + _UNSURE]) if p <= overlap)]
    lead = min(body, overlap)
    seen = own.places(text[body - lead :]) if len(text) > body else ()
    tail = [p - lead for p, word in seen if lead <= p <= len(text) - body + lead - _UNSURE and word[0] != "'" and word[-1] != "'" and not word[-1].isspace()]
    return head, tail


def _chunks(docs: DataFrame, text: str, chunk: int, overlap: int) -> DataFrame:
    """Rows (_id, _k, _n, _body, _chunk, _row): the chunks of every text; the row's other columns go with the first."""
    parts = F.col("_parts")
    cut = F.transform(parts, lambda x, k: F.concat(x, F.coalesce(F.substring(F.get(parts, k + 1), 1, overlap), F.lit(""))))
    rows = docs.select(F.monotonically_increasing_id().alias("_id"), "_row", F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)).alias("_parts"))
    rows = rows.select("_id", "_row", F.size("_parts").alias("_n"), F.posexplode(cut).alias("_k", "_chunk"))
    last = F.col("_k") == F.col("_n") - 1
    return rows.select("_id", "_k", "_n", F.when(last, F.char_length("_chunk")).otherwise(chunk).alias("_body"), "_chunk", F.when(F.col("_k") == 0, F.col("_row")).alias("_row"))


def _pieces(chunks: DataFrame, path: str, pattern: str, overlap: int) -> DataFrame:
    """Rows (_id, _run, _piece, _row): the texts between stitches, in the order of ``_run``."""

    @F.pandas_udf("head array<int>, tail array<int>")
    def seen(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = coder(path, pattern)
        for texts, bodies in batches:
            yield pd.DataFrame([border_places(own, t, b, overlap) for t, b in zip(texts, bodies)], columns=["head", "tail"])

    told = chunks.select("_id", "_k", "_n", seen("_chunk", "_body").alias("_s"))
    sides = F.array(
        F.struct(F.col("_k").alias("_k"), F.col("_s.head").alias("head"), F.lit(None).cast("array<int>").alias("tail"), F.col("_n").alias("_n")),
        F.struct((F.col("_k") + 1).alias("_k"), F.lit(None).cast("array<int>").alias("head"), F.col("_s.tail").alias("tail"), F.col("_n").alias("_n")),
    )
    borders = told.select("_id", F.explode(sides).alias("_b")).select("_id", "_b.*").where("_k < _n")
    borders = borders.groupBy("_id", "_k").agg(F.max("_n").alias("_n"), F.array_min(F.array_intersect(F.max("head"), F.max("tail"))).alias("_at"))
    # a text's borders, a few numbers each: places of its stitches, and the piece that each chunk belongs to
    order = Window.partitionBy("_id").orderBy("_k")
    stitched = (F.col("_k") == 0) | F.col("_at").isNotNull()
    spans = borders.withColumns({"_run": F.sum(stitched.cast("int")).over(order), "_next": F.lead("_at").over(order)})
    spans = spans.select("_id", "_k", "_run", F.coalesce("_at", F.lit(0)).alias("_from"), F.coalesce("_next", F.lit(0)).alias("_over"), (stitched & (F.col("_next").isNotNull() | (F.col("_k") == F.col("_n") - 1))).alias("_alone"))
    held = chunks.join(spans, ["_id", "_k"]).withColumn("_piece", F.substring("_chunk", F.col("_from") + 1, F.col("_body") + F.col("_over") - F.col("_from")))
    many = held.where("not _alone").groupBy("_id", "_run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_piece"))), lambda x: x["_piece"]), "").alias("_piece"), F.first("_row", ignorenulls=True).alias("_row"))
    return held.where("_alone").select("_id", "_run", "_piece", "_row").unionByName(many)


def _slices(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The same rows a few at a time, so that what is made of them stays small."""
    for batch in batches:
        for k in range(0, len(batch), SLICE):
            yield batch.slice(k, SLICE)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Every row, without its text, with ``ids`` (array of int), as the library gives them without special tokens.

    ``path`` is a file of base64 tokens and ranks, ``pattern`` its pre-tokenizer. Null and empty texts have no ids; repeated rows stay;
    a column named ids that the input has is replaced. Only texts longer than a chunk are shuffled; a task holds chunks and pieces, and
    at last the ids of a text, but never a group of texts.
    """

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path, pattern)
        for texts in _slices(batches):
            found = [own.encode(t) for t in texts.to_pylist()]
            offsets = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))

    if not 0 < overlap <= chunk:
        raise ValueError("the overlap is at least one character and at most a chunk")
    kept = [c for c in docs.columns if c not in (text, "ids")]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in kept]).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    long = F.char_length("_text") > chunk
    short = rows.where(~long).select("_row", ids("_text").alias("ids"))
    pieces = _pieces(materialise(_chunks(rows.where(long), "_text", chunk, overlap), "zstd"), path, pattern, overlap)
    parts = pieces.select("_id", "_run", ids("_piece").alias("_ids"), "_row").groupBy("_id")
    whole = parts.agg(F.first("_row", ignorenulls=True).alias("_row"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_run", "_ids"))), lambda x: x["_ids"])).alias("ids")).drop("_id")
    return short.unionByName(whole).select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "ids")


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Every row with ``bytes``: its ids' bytes one after another; null ids have none. An id that the file lacks is an error."""

    @F.arrow_udf("binary")
    def joined(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = coder(path, pattern)
        for part in _slices(batches):
            ends = np.cumsum([0, *pc.fill_null(part.value_lengths(), 0).to_pylist()]).tolist()
            yield pa.array(own.decode_all(part.flatten().to_numpy().tolist(), ends), pa.binary())

    return rows.withColumn("bytes", joined(F.col(ids)))
