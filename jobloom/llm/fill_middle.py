"""Fill-in-the-middle (operator 11): texts cut at seeded tokens, counted by content-defined chunks that are remembered.

A rolling hash over the last 32 bytes cuts a text into chunks where the bytes themselves say so, so that texts that share a
passage share its chunks, wherever it stands. A chunk's summary (runs of word characters, code points, and whether its first
and last byte belong to a run) is kept by the chunk's content, and a hit is compared with that content. Summaries combine from
left to right: a run that goes on over a border is counted once. So a text's token count, and the chunk that a token ends in,
come from its chunks' counts; only that chunk, and what the run still holds after it, is looked at for the cut itself.

A token is white space and the run of other characters after it, or white space at the end. The rest (the draw by document,
the output's form and the way back from it) is column functions.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobloom.llm.token_counts import forget

_RUN, _WHITE = re.compile(rb"[^ \t-\r]+"), re.compile(rb"[ \t-\r]")
_SPACES, _CONTINUED = frozenset(b" \t\n\x0b\x0c\r"), bytes(range(0x80, 0xC0))
#: Bytes of a chunk: at least, 1 / 2**BITS of the places after that, at most; bytes hashed at once; chunks that a worker keeps.
LEAST, BITS, MOST = 64, 9, 4096
BLOCK, WINDOW, MAX_CHUNKS = 1 << 20, 32, 50_000
_GEAR = np.random.default_rng(11).integers(0, 1 << 32, 256, dtype=np.uint32)


def chunk_ends(data: bytes) -> list[int]:
    """Where the content-defined chunks of a text end; the last is the text's end."""
    ends, at, whole = [], 0, np.frombuffer(data, np.uint8)
    for start in range(0, len(data), BLOCK):
        lead = min(start, WINDOW - 1)
        h = _GEAR[whole[start - lead : start + BLOCK]]
        for shift in (1, 2, 4, 8, 16):  # after them the sum over the last 32 bytes, each moved by its distance
            h[shift:] = h[shift:] + (h[:-shift] << np.uint32(shift))
        for place in (np.flatnonzero(h[lead:] >> np.uint32(32 - BITS) == 0) + start + 1).tolist():
            while place - at > MOST:
                at += MOST
                ends.append(at)
            if place - at >= LEAST:
                at = place
                ends.append(at)
    while len(data) - at > MOST:
        at += MOST
        ends.append(at)
    if at < len(data):
        ends.append(len(data))
    return ends


def _points(data: bytes) -> int:
    return len(data.translate(None, _CONTINUED))


def summary(chunk: bytes) -> tuple[int, int, bool, bool]:
    """Runs, code points, whether the first byte is of a run, whether the last is."""
    return len(chunk.split()), _points(chunk), chunk[0] not in _SPACES, chunk[-1] not in _SPACES


class TokenCuts:
    """Token counts of texts and the places where tokens end, from remembered chunks."""

    def __init__(self):
        self._known: dict[bytes, tuple[int, int, bool, bool]] = {}

    def cuts(self, data: bytes, first: int | None, second: int | None) -> tuple[int, int, int]:
        """Tokens n, and the code points before the smaller and the larger of ``first % (n + 1)`` and ``second % (n + 1)``."""
        if not data:
            return 0, 0, 0
        known = self._known
        ends, runs, points, joined, last = chunk_ends(data), [0], [0], [], False
        start = 0
        for end in ends:
            chunk = data[start:end]
            if (s := known.get(chunk)) is None:
                forget(known, MAX_CHUNKS)
                s = known[chunk] = summary(chunk)
            joined.append(last and s[2])
            runs.append(runs[-1] + s[0] - joined[-1])
            points.append(points[-1] + s[1])
            start, last = end, s[3]
        n = runs[-1] + (not last)

        def before(tokens: int) -> int:
            if tokens == 0 or tokens == n:
                return points[-1] if tokens else 0
            j = bisect.bisect_left(runs, tokens) - 1  # the chunk in which that run begins
            start, nth = (ends[j - 1] if j else 0), tokens - runs[j] + joined[j]
            place = next(m for k, m in enumerate(_RUN.finditer(data, start, ends[j]), 1) if k == nth).end()
            if place == ends[j]:
                place = m.start() if (m := _WHITE.search(data, place)) else len(data)
            return points[j] + _points(data[start:place])

        a, b = sorted((x or 0) % (n + 1) for x in (first, second))
        return n, before(a), before(b)


def _draws(seed: int, key: str) -> list[Column]:
    """Four numbers of a document: the first groups of eight digits of its seeded hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", seed: int = 42, rate: int = 50, spm_rate: int = 80, text: str = "text", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """Every row, without its text, with ``n`` (tokens), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` of a hundred documents are cut, of which ``spm_rate`` of a hundred begin with their suffix (spm), the others with
    their prefix (psm); the rest, empty texts and those that hold a mark are plain: their output is the text and both lengths are
    null. Null texts count as empty, a null key as the empty string; rows that repeat a key are cut alike. Columns of the output's
    names that the input has are replaced. A map over rows without any shuffle.
    """

    @F.pandas_udf(T.StructType([T.StructField(c, T.LongType()) for c in ("n", "a", "b")]))
    def cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = TokenCuts()
        for data, first, second in batches:
            yield pd.DataFrame([own.cuts(d, x, y) for d, x, y in zip(data, first.tolist(), second.tolist())], columns=["n", "a", "b"])

    p, s, m = marks
    draws = _draws(seed, key)
    out = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (text, "n", "form", "prefix_chars", "middle_chars", "output")], F.coalesce(F.col(text), F.lit("")).alias("_text"), *[d.alias(f"_h{k}") for k, d in enumerate(draws)])
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains("_text", F.lit(mark))
    plain = (F.col("_text") == "") | marked | (F.col("_h2") % 100 >= rate)
    out = out.withColumn("_cut", cut(F.col("_text").cast("binary"), "_h0", "_h1")).withColumn("form", F.when(plain, "plain").when(F.col("_h3") % 100 < spm_rate, "spm").otherwise("psm"))
    a, b = F.col("_cut.a").cast("int"), F.col("_cut.b").cast("int")
    prefix, middle, suffix = F.substring("_text", F.lit(1), a), F.substring("_text", a + 1, b - a), F.substring("_text", b + 1, F.char_length("_text"))
    return out.withColumns({
        "n": F.col("_cut.n"),
        "prefix_chars": F.when(F.col("form") != "plain", F.col("_cut.a")),
        "middle_chars": F.when(F.col("form") != "plain", F.col("_cut.b") - F.col("_cut.a")),
        "output": F.when(F.col("form") == "plain", F.col("_text")).when(F.col("form") == "psm", F.concat(F.lit(p), prefix, F.lit(s), suffix, F.lit(m), middle)).otherwise(F.concat(F.lit(s), suffix, F.lit(p), prefix, F.lit(m), middle)),
    }).drop("_text", "_cut", "_h0", "_h1", "_h2", "_h3")


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The text that an output was made of, from the output and its form alone."""
    body = lambda mark: F.substring(F.col(output), F.lit(len(mark) + 1), F.char_length(output))
    p, s, m = marks
    quoted = lambda *ms: "|".join("\\Q" + x + "\\E" for x in ms)
    psm, spm = F.split(body(p), quoted(s, m)), F.split(body(s), quoted(p, m))
    return F.when(F.col(form) == "plain", F.col(output)).when(F.col(form) == "psm", F.concat(psm[0], psm[2], psm[1])).otherwise(F.concat(spm[1], spm[2], spm[0]))
