"""Token counts (operator 7): exact counts at every prefix by dynamic programming over byte-pair tokens.

Byte-pair encoding has the property that cutting the encoding of a word after any token leaves the encoding of that
prefix, and that a sequence of tokens is the encoding of its text exactly if each pair of neighbours encodes to itself.
So for every prefix of a word exactly one token ends it: the vocabulary entry that ends there and forms a valid pair with
the last token of what stands before. One pass from left to right stores, at every prefix, the last token and the count;
truncation and budget questions are then look-ups, without encoding again.

Words are those of the tokenizer's own pre-tokenizer, taken over white-space delimited pieces of the text. Counts of short
pieces are remembered per Python worker, because natural text repeats them; the number and the length of what is remembered
are bounded, and the oldest half is forgotten at once. The new pieces of many texts are sorted, so that a word goes on from
the prefix that it shares with the word before.
"""

from __future__ import annotations

import bisect
import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A piece: white space and the word after it, or white space at the end. Only characters that every definition of white
#: space has end a piece; others stay inside, where the tokenizer's own pre-tokenizer sees them.
_PIECE = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")
#: A piece of one word and perhaps a mark of punctuation, with letters of the first 256 characters only.
_SIMPLE = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)")
# fixed values: the white space and the contractions of the pre-tokenizer's pattern
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
#: Entries of each dictionary that a worker keeps, and characters of a piece that is remembered: some 60 MB each at most.
MAX_REMEMBERED, LONGEST_REMEMBERED = 400_000, 32
#: Characters of texts whose new pieces are sorted together.
PORTION = 1 << 20
_NEVER = float("inf")


def forget(known: dict, most: int = MAX_REMEMBERED) -> None:
    """Drop the older half of a dictionary that has reached its bound."""
    if len(known) >= most:
        for key in list(itertools.islice(known, most // 2)):
            del known[key]


class PrefixCounter:
    """Token counts of texts and of all their prefixes under one byte-level BPE file of the ``tokenizers`` library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
        self._rank = {pair: i for i, pair in enumerate(merges)}
        self._spines: dict[tuple[str, bool], list[tuple[str, float, float]]] = {}
        alphabet = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self._byte = {chr(b): b for b in alphabet} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(alphabet)))}
        self._names = [t for t in model["model"]["vocab"] if len(t) == 1 or self._merge(t, True)]
        self._ids = {bytes(self._byte[c] for c in name): k for k, name in enumerate(self._names)}
        self._longest = [0] * 256  # of the tokens that end with a byte
        for token in self._ids:
            self._longest[token[-1]] = max(self._longest[token[-1]], len(token))
        self._special = [t["content"] for t in model["added_tokens"]]
        self._cut = re.compile("|".join(map(re.escape, self._special))) if self._special else None
        self._valid: dict[int, bool] = {}
        self._pieces: dict[str, int] = {}

    def _merge(self, token: str, right: bool) -> list[tuple[str, float, float]]:
        """The parts at one end of a token while it is merged: each with the ranks at which it arises and is merged on."""
        parts = list(token)
        ends = [(parts[-right], -1.0)]
        while len(parts) > 1:
            ranks = [self._rank.get(p, _NEVER) for p in zip(parts, parts[1:])]
            if (best := min(ranks)) == _NEVER:
                return []  # merging never yields this entry of the vocabulary
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            if parts[-right] != ends[-1][0]:
                ends.append((parts[-right], best))
        return [(part, made, after) for (part, made), (_, after) in zip(ends, [*ends[1:], ("", _NEVER)])]

    def _spine(self, token: str, right: bool) -> list[tuple[str, float, float]]:
        known = self._spines.get((token, right))
        if known is None:
            forget(self._spines, MAX_REMEMBERED // 4)
            known = self._spines[token, right] = self._merge(token, right)
        return known

    def _pair(self, before: str, token: str) -> bool:
        """Whether a merge ever crosses the border of two tokens: none does if they are neighbours in an encoding.

        A merge of two end parts crosses it if both exist at one time and its rank comes before either is merged on; of
        equal ranks the left one is merged first.
        """
        rank, left = self._rank, self._spine(before, True)
        for y, y_made, y_gone in self._spine(token, False):
            for x, x_made, x_gone in left:
                if y_made < x_gone and x_made <= y_gone and (r := rank.get((x, y), _NEVER)) < x_gone and r <= y_gone and r < _NEVER:
                    return False
        return True

    def _extend(self, word: bytes, last: list[int], count: list[int]) -> None:
        """Go on with the last tokens and the counts of all prefixes, from where the lists end to the end of the word."""
        ids, valid, names, longest = self._ids.get, self._valid, len(self._names), self._longest
        for end in range(len(count), len(word) + 1):
            for start in range(max(0, end - longest[word[end - 1]]), end):
                if (token := ids(word[start:end])) is not None:
                    if start:
                        known = valid.get(key := last[start] * names + token)
                        if known is None:
                            forget(valid)
                            known = valid[key] = self._pair(self._names[last[start]], self._names[token])
                        if not known:
                            continue
                    last.append(token)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends {word[:end]!r}")

    def byte_prefixes(self, word: bytes) -> list[int]:
        """Counts of the first 0, 1, 2, ... bytes of a word."""
        count = [0]
        self._extend(word, [-1], count)
        return count

    def word_prefixes(self, word: str) -> list[int]:
        """The same for a word in the vocabulary's byte alphabet."""
        return self.byte_prefixes(bytes(map(self._byte.__getitem__, word)))

    def _word(self, word: str) -> int:
        return self.word_prefixes(word)[-1]

    def _piece(self, piece: str) -> int:
        simple = _SIMPLE.fullmatch(piece)
        n = self.byte_prefixes(simple[1].encode())[-1] + bool(simple[2]) if simple else sum(self._word(w) for w, _ in self._split(piece))
        if len(piece) <= LONGEST_REMEMBERED:
            forget(self._pieces)
            self._pieces[piece] = n
        return n

    def learn(self, texts: list[list[str]]) -> None:
        """Remember the new short pieces of texts, each word in the order of all."""
        known = self._pieces
        new = {p for p in set(itertools.chain.from_iterable(texts)) if p not in known and len(p) <= LONGEST_REMEMBERED}
        words: dict[bytes, list[tuple[str, int]]] = {}
        for piece in new:
            if simple := _SIMPLE.fullmatch(piece):
                words.setdefault(simple[1].encode(), []).append((piece, len(simple[2])))
        before, last, count = b"", [-1], [0]
        for word in sorted(words):
            same = next((k for k, (a, b) in enumerate(zip(before, word)) if a != b), min(len(before), len(word)))
            del last[same + 1 :], count[same + 1 :]
            self._extend(word, last, count)
            before = word
            forget(known)
            for piece, marks in words[word]:
                known[piece] = count[-1] + marks

    def _cut_pieces(self, pieces: list[str], limit: int) -> tuple[int, int]:
        """``cut_at`` for the pieces of a text without special strings."""
        known = self._pieces
        try:
            counts = [known[p] for p in pieces]
        except KeyError:
            counts = [self._count(p) for p in pieces]
        ends = list(itertools.accumulate(counts))
        if not pieces or ends[-1] <= limit:
            return (ends[-1] if pieces else 0), sum(map(len, pieces))
        k = bisect.bisect_right(ends, limit)
        base, at = ends[k] - counts[k], sum(map(len, pieces[:k]))
        return ends[-1], at + max(i for i, c in enumerate(self._inside(False, pieces[k], "")) if base + c <= limit)

    def cut_all(self, texts: list[str], limit: int) -> list[tuple[int, int]]:
        """``cut_at`` for many texts, whose new words are learnt together."""
        special = [self._cut is not None and any(s in t for s in self._special) for t in texts]
        pieces = [[] if own else _PIECE.findall(t) for t, own in zip(texts, special)]
        self.learn(pieces)
        return [self.cut_at(t, limit) if own else self._cut_pieces(p, limit) for t, own, p in zip(texts, special, pieces)]

    def _segments(self, text: str) -> list[str]:
        return self._cut.split(text) if self._cut and any(s in text for s in self._special) else [text]

    def _split_count(self, text: str) -> int:
        return sum(self._word(w) for w, _ in self._split(text))

    def _piece_prefixes(self, piece: str, before: str = "") -> list[int]:
        """Counts of a piece's first 0, 1, 2, ... characters, in one pass over its words.

        A prefix that ends in white space has all white space at its end as one word; one that ends inside a word has the
        word's own prefix count, but for contractions, which are split anew. After ``before``, the text in front of the
        string of a special token (``piece``) that is not yet whole, all is split anew.
        """
        if before:
            known = self._split_count(before)
            return [0, *(self._split_count(before + piece[:end]) - known for end in range(1, len(piece) + 1))]
        out, base = [0], 0
        blank_start, blank_base, blanks = 0, 0, [0]  # the white space at the end so far, and the count before it
        for word, (start, end) in self._split(piece):
            inside, at, contraction = self.word_prefixes(word), 0, piece[start:end] in _CONTRACTIONS
            for k in range(start, end):
                at += len(piece[k].encode())
                if piece[k] in _WHITE:
                    if k == 0 or piece[k - 1] not in _WHITE:
                        run = k
                        while run < len(piece) and piece[run] in _WHITE:
                            run += 1
                        blank_start, blank_base, blanks = k, out[-1], self.byte_prefixes(piece[k:run].encode())
                    out.append(blank_base + blanks[len(piece[blank_start : k + 1].encode())])
                elif contraction:
                    out.append(base + self._split_count(piece[start : k + 1]))
                else:
                    out.append(base + inside[at])
            base += inside[-1]
        return out

    def _walk(self, text: str) -> Iterator[tuple[int, bool, str, str]]:
        """The text's pieces in order: count, then for the strings of special tokens True, the piece, the piece before."""
        at, before = 0, ""
        for k, segment in enumerate(self._segments(text)):
            if k:
                special = self._cut.match(text, at).group()
                yield 1, True, special, before
                at, before = at + len(special), ""
            for piece in _PIECE.findall(segment):
                yield self._count(piece), False, piece, before
                before = piece
            at += len(segment)

    def _count(self, piece: str) -> int:
        known = self._pieces.get(piece)
        return self._piece(piece) if known is None else known

    def _inside(self, special: bool, piece: str, before: str) -> list[int]:
        return [*self._piece_prefixes(piece, before)[:-1], 1] if special else self._piece_prefixes(piece)

    def prefix_counts(self, text: str) -> list[int]:
        """At index i the token count of the first i characters, for i from 0 to the length of the text."""
        out, base = [0], 0
        for n, *piece in self._walk(text):
            out += [base + c for c in self._inside(*piece)[1:]]
            base += n
        return out

    def count(self, text: str) -> int:
        """Tokens of a whole text; the strings of special tokens inside it are one token each, as the library has it."""
        segments = self._segments(text)
        return len(segments) - 1 + sum(sum(map(self._count, _PIECE.findall(s))) for s in segments)

    def cut_at(self, text: str, limit: int) -> tuple[int, int]:
        """The token count, and the characters of the longest prefix with at most ``limit`` tokens."""
        if (total := self.count(text)) <= limit:
            return total, len(text)
        base, at = 0, 0
        for n, *piece in self._walk(text):
            if base + n > limit:
                return total, at + max(i for i, c in enumerate(self._inside(*piece)) if base + c <= limit)
            base, at = base + n, at + len(piece[1])
        return total, at


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per file and Python process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """Every row with ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` and ``limit_chars``.

    ``limit_chars`` is the length of the longest prefix with at most ``limit`` tokens. A null text counts as empty: no
    bytes, no tokens. Repeated rows stay, each with its counts; columns of these names that the input has are replaced.
    A map over rows without any shuffle: only the text goes to Python, in Arrow batches.
    """

    @F.pandas_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("cut", T.LongType())]))
    def counts(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for batch in texts:
            out, portion, size = [], [], 0
            for k, t in enumerate(batch):
                portion.append(t or "")
                size += len(portion[-1])
                if size >= PORTION or k == len(batch) - 1:
                    out += own.cut_all(portion, limit)
                    portion, size = [], 0
            yield pd.DataFrame(out, columns=["n", "cut"])

    out = docs.withColumn("_counts", counts(F.col(text)))
    return out.withColumns({
        "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": F.col("_counts.n"),
        "over_limit": F.col("_counts.n") > limit, "limit_chars": F.col("_counts.cut"),
    }).drop("_counts")


def truncate(docs: DataFrame, path: str, limit: int, text: str = "text") -> DataFrame:
    """Every row with its text cut to the longest prefix of at most ``limit`` tokens; null stays null."""
    counted = count_tokens(docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text")), path, limit, "_text")
    cut = counted.withColumn("_cut", F.expr("substring(_text, 1, int(limit_chars))"))
    return cut.select(*[F.col("_cut").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
