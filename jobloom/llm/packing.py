"""Packing (operator 6): first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Documents are encoded where they lie and leave Python only as pieces (offset, length, checksum), never as token ids or
text. The pieces are written, counted, and dealt at random into groups of about ``group_pieces``, whatever the documents
they come from. Each group packs itself: pieces by falling length, full ones first, each into the first open sequence that
has room, found by walking down a tree whose inner nodes hold the largest room below them. The number of groups follows
the number of pieces, so a group stays as large as it is at any size of the input and of its documents.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.llm.token_counts import LONGEST_REMEMBERED, forget
from jobloom.sources.tables import materialise

_WORD, _LATIN = re.compile(r"[^ \t\n\r]+"), re.compile(r"[\x00-\xff]*")

# fixed values: white space, letters and numbers of Unicode among the first 256 characters
_BLANKS, _LETTERS, _NUMBERS = r"\t\n\x0b\x0c\r \x85\xa0", "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"


class WordEncoder:
    """Token ids of texts under a ``tokenizers`` file whose words never reach over white space.

    The ids of a text are those of its words one after another, so words are encoded once per worker and, if they are
    short, remembered as bytes of little-endian unsigned 32-bit ids; the oldest half is forgotten at a bound. A text of the first 256 characters only, without the start of a special
    token, is lowered and cut by the file's own pattern here, and its new words go straight to the file's merges.
    Otherwise the library normalises and cuts the white-space delimited parts that are new, joined by a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = {t.content: i for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self._known: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self._own = self._pattern(parts)
        alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in alphabet} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(alphabet)))}
        self._shown = str.maketrans({chr(b): c for b, c in shown.items()})

    @staticmethod
    def _pattern(parts: dict) -> re.Pattern | None:
        """The file's pattern for the first 256 characters, if the file lowers, composes and cuts in the usual way."""
        kinds = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]
        cuts = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if kinds != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"] or not cuts[0].get("invert") or cuts[1]["add_prefix_space"] or cuts[1]["use_regex"]:
            return None
        pattern = cuts[0]["pattern"]["Regex"]
        for name, chars in ((r"\p{L}", _LETTERS), (r"\p{N}", _NUMBERS), (r"\s", _BLANKS)):
            pattern = pattern.replace(f"[{name}]", f"[{chars}]").replace(name, chars)
        return re.compile(pattern)

    def _alone(self, text: str) -> bytes:
        return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of white-space delimited parts, by the library."""
        border, border_id = next(iter(self._special.items()), (None, None))
        joint = [w for w in words if not any(s in w for s in self._special)] if border else []
        out = {w: self._alone(w) for w in words.difference(joint)}
        for i in range(0, len(joint), 4096):
            part = joint[i : i + 4096]
            ids = np.asarray(self._tokenizer.encode_batch_fast([border.join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == border_id)
            starts, ends = [0, *(cuts + 1).tolist()], [*cuts.tolist(), len(ids)]
            assert len(starts) == len(part)
            raw = ids.tobytes()
            out.update(zip(part, (raw[4 * a : 4 * b] for a, b in zip(starts, ends))))
        return out

    def _merged(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that the file's own pattern cut, by its merges."""
        merge, out = self._tokenizer.model.tokenize, {}
        for w in words:
            shown = w if w.isascii() and w.isalnum() else w.encode().decode("latin-1").translate(self._shown)
            out[w] = b"".join(t.id.to_bytes(4, "little") for t in merge(shown))
        return out

    @staticmethod
    def _ids(words: list[str], known: dict[str, bytes], learn: Callable[[set[str]], dict[str, bytes]]) -> bytes:
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            forget(known)
            new = learn(set(words).difference(known))
            out = b"".join([known[w] if w in known else new[w] for w in words])
            known.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST_REMEMBERED)
            return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as bytes."""
        if self._own is not None and "<|" not in text and _LATIN.fullmatch(text):
            return self._ids(self._own.findall(text.lower()), self._words, self._merged)
        return self._ids(_WORD.findall(text), self._known, self._learn)


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One per file and Python process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class TournamentTree:
    """Open bins in the order of their opening, with the largest room of each subtree at its root."""

    def __init__(self, most: int, capacity: int):
        self._leaves = 1 << max(0, most - 1).bit_length()
        self._room = [capacity] * (2 * self._leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room; the bin and the room it had."""
        room, node = self._room, 1
        while node < self._leaves:
            node *= 2
            if room[node] < size:
                node += 1
        had = room[node]
        room[node] = had - size
        bin_ = node - self._leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_, had


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length its bin and its offset there; ties in the given order."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree = TournamentTree(len(lengths), capacity)
    for i in np.argsort(-lengths, kind="stable"):
        bins[i], had = tree.place(int(lengths[i]))
        offsets[i] = capacity - had
    return bins, offsets


_PIECE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
])


def pieces(docs: DataFrame, path: str, length: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and piece of at most ``length`` ids: full pieces from the front, then the rest."""

    @F.pandas_udf(T.ArrayType(_PIECE))
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, tail = encoder(path), np.asarray([end_id], "<u4").tobytes()
        for batch in texts:
            out = []
            for t in batch:
                ids = own.encode(t or "") + tail
                n = len(ids) // 4
                out.append([(i, min(length, n - i), zlib.crc32(ids[4 * i : 4 * (i + length)]), n) for i in range(0, n, length)])
            yield pd.Series(out)

    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(cut(F.col(text))).alias("p")).select("doc_id", "p.*")


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, group_pieces: int = 8192, seed: int = 17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with the sequence and the offset they lie at.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is a document of its
    end id alone. Repeated rows are packed as often as they come. Within a sequence pieces lie without a gap from 0. An
    empty table gives an empty result. Other columns of the input are ignored, whatever their names. doc_id may be null and
    of any type that text can be cast back to.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType
    # ids go through Python as text, so that those of any type come back as they were
    cut = materialise(pieces(docs, path, length, end_id).withColumn("doc_id", F.col("doc_id").cast("string")))
    groups = max(1, -(-cut.count() // group_pieces))
    # with the place of a row in what was written, repeated rows are dealt apart
    dealt = cut.withColumn("row", F.monotonically_increasing_id()).withColumn("group", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)))
    out = T.StructType([T.StructField(n, T.StringType() if n == "doc_id" else T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def pack_group(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("row", ignore_index=True)
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), length)
        rows["sequence_id"], rows["offset"] = rows["group"].to_numpy() * (1 << 32) + bins, offsets
        return rows[[f.name for f in out]]

    return dealt.groupBy("group").applyInPandas(pack_group, out).withColumn("doc_id", F.col("doc_id").cast(kind))
