"""Fill-in-middle, the filter audit and byte-level BPE, held against plain Python, DuckDB and the tokenizer library."""

import base64
import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.llm import byte_pairs, fill_middle, filter_audit, registry, vocab

RANKS, PATTERN = vocab.vocabulary_path("byte_bpe_multi_50k.tiktoken"), vocab.pre_token_pattern()
PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "'", "é", "\xa0", "1", "23", "!", "...", "the", " the", "漢", "字", "。", "\x1c", "\x85", "　", "\t", "Ing", "tion", "İ", "²", "_", "😀", "é"]
texts = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "src1", 0), (2, "", "en", "src1", 0), (3, "word", None, None, 4), (3, "word", None, None, 4), (4, "long " * 30000, "de", "src2", 150000), (5, "x" * 20000, "", "src2", 1), (None, "no id here", "en", "src3", 10), (6, " \t\n", "en", "s", 3), (7, "<P> inside", "en", "s", 3)]
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_filter_audit"])
def test_query_equals_its_sql(name, spark, sf_dir, duck):
    got, want = registry.queries()[name](spark, sf_dir), duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# fill-in-middle


def plain_middle(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n, digest = len(units), sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\t", "a", "bc", "é", "漢字", "\x85", "\n\n", "word " * 40, "x" * 300, " " * 200]), max_size=25).map("".join), st.integers(0, 10**9), st.integers(0, 10**9))
def test_cuts_from_chunk_counts(text, x, y):
    units = UNIT.findall(text)
    a, b = sorted((x % (len(units) + 1), y % (len(units) + 1)))
    own = fill_middle.TokenCuts()
    for _ in range(2):  # the second time from what is remembered
        assert own.cuts(text.encode(), x, y) == (len(units), len("".join(units[:a])), len("".join(units[:b])))


def test_chunks_follow_the_content():
    rng = random.Random(3)
    shared = bytes(rng.randrange(256) for _ in range(60_000))

    def chunks(data):
        ends = fill_middle.chunk_ends(data)
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    one, two = chunks(b"before" * 100 + shared), chunks(shared + b"after")
    assert b"".join(one) == b"before" * 100 + shared and max(map(len, one)) <= fill_middle.MOST
    assert len(set(one) & set(two)) >= 0.9 * len(two)
    assert chunks(b"") == [] and chunks(b"a" * 9000) == [b"a" * 4096, b"a" * 4096, b"a" * 808]
    large = shared * 40  # longer than what is hashed at once
    assert b"".join(chunks(large)) == large and len(set(chunks(large))) <= 2 * len(two)


def test_fill_in_middle_odd_rows(spark):
    docs = spark.createDataFrame([*ODD, *[(k, f"{'ab ' * (k % 7)}tail {k} é" + "\n" * (k % 2), "en", "s", 1) for k in range(10, 60)]], DOCS).withColumn("form", F.lit("clash"))
    rows = fill_middle.fill_in_middle(docs).withColumn("restored", fill_middle.restored()).join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "doc_id", "left").collect()
    assert len(rows) == len(ODD) + 50
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        if r.doc_id is not None:
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_middle(r.doc_id, r.text)
            assert r.restored == r.text
    none = next(r for r in rows if r.doc_id is None)
    assert (none.n, none.form, none.prefix_chars, none.middle_chars, none.output) == plain_middle(None, "no id here")
    assert fill_middle.fill_in_middle(docs.where("false")).count() == 0


# filter audit


def test_plain_changes_visit_every_order():
    for m in range(6):
        order, seen = list(range(m)), []
        seen.append(tuple(order))
        for k in filter_audit.plain_changes(m):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append(tuple(order))
        assert sorted(seen) == list(itertools.permutations(range(m)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.tuples(st.integers(0, 4), st.integers(0, 3), st.integers(0, 3)), min_size=1), st.lists(st.integers(0, 3), max_size=12))
def test_diagram_keeps_its_function(counts, swaps):
    diagram = filter_audit.Diagram(counts, 5)
    for level in swaps:
        diagram.swap(level)
        assert diagram.size() == filter_audit.Diagram({sum(1 << k for k, f in enumerate(diagram.order) if mask >> f & 1): w for mask, w in counts.items()}, 5).size()  # as small as if built so
    gone = 0
    for f, kept, removed in diagram.steps():
        was, gone = gone, gone | 1 << f
        total = lambda ok: tuple(sum(w[i] for mask, w in counts.items() if ok(mask)) for i in range(3))
        assert kept == total(lambda mask: not mask & gone)
        assert removed == total(lambda mask: not mask & was and mask >> f & 1)
    assert diagram.alone() == {f: counts.get(1 << f, (0, 0, 0)) for f in range(5)}


def plain_audit(docs, labels):
    first, called, masks = {}, defaultdict(lambda: [False, False]), defaultdict(list)
    for doc_id, text, *_ in docs:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, quality, toxic in labels:
        if doc_id is not None:
            called[doc_id] = [called[doc_id][0] or quality == 1, called[doc_id][1] or toxic == 1]
    for doc_id, text, lang, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc_id is not None and doc_id > first[t]}
        masks[lang or ""].append(({x for x in fails if fails[x]}, *called.get(doc_id, [False, False])))
    out = []
    for part, rows in masks.items():
        mine, shapley = [], defaultdict(int)
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, x in enumerate(order, 1):
                gone, kept = [r for r in left if x in r[0]], [r for r in left if x not in r[0]]
                mine.append((part, "".join(order), step, len(kept), len(gone), sum(x in r[0] for r in rows) - len(gone), sum(r[0] == {x} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone), x))
                shapley[x] += len(gone)
                left = kept
        out += [(*r[:-1], shapley[r[-1]]) for r in mine]
    return sorted(out)


def test_audit_odd_rows(spark):
    docs = [*ODD, (8, "no id here", "fr", "s", 1), (9, "word", "fr", "s", 1), (10, "LOUD $", "fr", "s", 1), (10, " ".join(map(str, range(300))), "fr", "s", 1), (None, "word", "fr", "s", 1)]
    labels = [(3, 1, None), (3, 0, 1), (9, None, 1), (10, 1, 0), (None, 1, 1), (77, 1, 1)]
    df, lf = spark.createDataFrame(docs, DOCS).withColumns({"mask": F.lit("clash"), "part": F.lit(1)}), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audit_filters(df, lf).collect())) == plain_audit(docs, labels)
    assert filter_audit.audit_filters(df.where("false"), lf).count() == 0
    assert filter_audit.audit_filters(df, lf.where("false")).agg(F.sum("good_lost")).first()[0] == 0


# byte-level BPE


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


OWN = byte_pairs.coder(RANKS, PATTERN)


def test_encoder_is_the_library(library):
    @settings(max_examples=400, deadline=None)
    @given(st.one_of(texts, st.text(max_size=40)))
    def same(text):
        text = text.encode("utf-8", "ignore").decode()
        ids = np.frombuffer(OWN.encode(text), "<i4").tolist()
        assert ids == library.encode_ordinary(text)
        assert OWN.decode(ids) == text.encode()
        assert "".join(OWN.pre_tokens(text)) == text

    same()
    assert OWN._latin is not None


def test_told_places_hold_whatever_comes_before():
    @settings(max_examples=400, deadline=None)
    @given(texts, texts, texts)
    def holds(before, body, after):
        _, tail = byte_pairs.border_places(OWN, "x" + body, 1, 1) if body else ([], [])
        whole = {p - len(before) for p, _ in OWN.places(before + body + after)}
        assert whole.issuperset(p for p in tail if p)  # the letter before stands for any other

    holds()


@pytest.mark.parametrize("chunk,overlap", [(1, 1), (5, 4), (16, 8), (40, 10)])
def test_stitched_texts_are_the_librarys(spark, library, chunk, overlap):
    rng = random.Random(chunk)
    made = ["".join(rng.choices(PARTS, k=rng.randrange(60))) for _ in range(80)]
    made += ["a" * 100, "ab " * 40, "word" + " " * 90 + "end", "漢字" * 60, "it's we're 'tis " * 9, None, "", "x" * chunk, "x" * (chunk + 1), made[0], made[0]]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "_chunk": F.lit(1)})
    rows = byte_pairs.decode(byte_pairs.encode(docs, RANKS, PATTERN, chunk=chunk, overlap=overlap), RANKS, PATTERN).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(made)))
    for r in rows:
        assert r.ids == library.encode_ordinary(made[r.doc_id] or "") and bytes(r.bytes) == (made[r.doc_id] or "").encode() and r._chunk == 1


def test_most_borders_are_stitched(spark):
    text = " ".join(f"word{k}, it's" for k in range(500))
    chunks = byte_pairs._chunks(spark.createDataFrame([(text,)], "t string").select(F.struct("t").alias("_row"), F.col("t").alias("_text")), "_text", 256, 64)
    assert byte_pairs._pieces(chunks, RANKS, PATTERN, 64).count() == chunks.count() == -(-len(text) // 256)


def test_query_13_is_the_library(spark, sf_dir, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.queries()["op13_byte_pairs"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r.doc_id]))


def test_byte_pairs_odd_rows(spark, library):
    docs = spark.createDataFrame(ODD, DOCS)
    rows = byte_pairs.encode(docs, RANKS, PATTERN).collect()
    assert sorted((len(r.ids), r.doc_id or 0) for r in rows) == sorted((len(library.encode_ordinary(t or "")), i or 0) for i, t, *_ in ODD)
    assert byte_pairs.decode(byte_pairs.encode(docs.where("false"), RANKS, PATTERN), RANKS, PATTERN).count() == 0
    assert byte_pairs.decode(spark.createDataFrame([(None,), ([],)], "ids array<int>"), RANKS, PATTERN).collect()[0].bytes == b""


def largest_task(spark, df):
    """Rows of the largest partition that a result's last join has written."""
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rows_that_share_a_key_for_nothing_are_spread(spark):
    from jobloom.llm import embedding_dedup, simhash

    rng = random.Random(2)
    vectors = [(k, None if k % 10 else [rng.gauss(0, 1) for _ in range(4)]) for k in range(2000)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(8)
    out = embedding_dedup.near_duplicates(df)
    assert out.count() == 2000 and out.where("vec_id % 10 <> 0 and (n_links <> 0 or component_id <> vec_id or not kept)").count() == 0
    assert largest_task(spark, out) < 900
    docs = spark.createDataFrame([(k, "" if k % 10 else f"some words of text {k} and {k * k}") for k in range(2000)], "doc_id long, text string").repartition(8)
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        out = simhash.near_duplicates(docs)
        assert out.where("doc_id % 10 <> 0 and (fingerprint <> '0000000000000000' or component_id <> 1)").count() == 0
        assert out.count() == 2000 and largest_task(spark, out) < 900
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


# secrets: candidates and features, one by one


def plain_findings(text):
    """Candidates of a text with their start, neighbourhood and features, in plain Python."""
    import math

    from jobloom.llm import secrets

    flags, text, out = re.ASCII, text or "", []
    matches = list(re.finditer(secrets.CANDIDATE, text, flags))
    ends = [0, *(m.end() for m in matches)]
    starts = [*(m.start() for m in matches), len(text)]
    for k, m in enumerate(matches):
        found = re.match(secrets._VALUE, m.group(), flags)
        name = found.group() if found else ""
        value, before, after = m.group()[len(name) :], text[ends[k] : starts[k]][-48:] + name, text[ends[k + 1] : starts[k + 1]][:24]
        n, low = len(value), value.lower()
        share = lambda pattern, v=value, n=n: len(re.findall(pattern, v, flags)) / n
        own = [value.count(chr(c)) for c in range(33, 127)]
        counts = [c for c in [*own, n - sum(own)] if c]
        seen = lambda pattern, x: float(bool(re.search(pattern, x, flags)))
        features = {
            "length": math.log2(max(n, 1)), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "marks": share("[^A-Za-z0-9]"), "transitions": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"), "case_switches": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
            "pairs": sum((a in "aeiouy") != (b in "aeiouy") for a, b in zip(low, low[1:]) if a in "abcdefghijklmnopqrstuvwxyz" and b in "abcdefghijklmnopqrstuvwxyz") / n, "distinct": len(counts) / n,
            "entropy": -sum(c / n * math.log2(c / n) for c in counts), "coverage": 1 - len(re.sub(secrets.COMMON, "", low)) / n, "named": seen(f"(?i)(?:{secrets.NAMES})(?![a-z])[^\\n]{{0,12}}$", before), "assigned": seen("[:=]\\s{0,3}[\"']?$", before),
            "quoted": float(bool(re.search("[\"'`]$", before) and re.search("^[\"'`]", after))), "in_path": float(bool(re.search(r"(?:/|\\|www\.|\w\.)$", before, flags) or re.search(r"^(?:/|\\|\.\w)", after, flags))),
            "example_near": seen("example|placeholder|dummy", before.lower()), "format": seen(secrets.FORMATS, value), "placeholder": seen(secrets.PLACEHOLDER, low), "is_number": seen("^[0-9+=/_-]+$", value), "is_uuid": seen("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$", low),
        }
        out.append((k, m.start() + len(name), value, before, after, features))
    return out


def test_candidates_and_features_are_the_plain_ones(spark, sf_dir):
    from jobloom.llm import secrets

    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text").collect()]
    texts += [(10**6 + k, t) for k, t in enumerate(["", None, "api_key = 'Zk3v9Qx71pLmN0' and token: ${HOME}_1", "see www.a.b/abcDEF1234567890abcd.png", "PASSWORD=äöü€123x", "x" * 40 + "1", "-----BEGIN RSA PRIVATE KEY-----\nab+/\n-----END RSA PRIVATE KEY-----", "the token := \"a1b2c3d4e5f6\"; id 0123456789abcdef0123"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.finding): r for r in secrets.with_features(secrets.candidates(docs)).collect()}
    want = {(doc_id, f[0]): f for doc_id, text in texts for f in plain_findings(text)}
    assert got.keys() == want.keys() and len(want) > 40
    for key, (_, start, value, before, after, features) in want.items():
        r = got[key]
        assert (r.start, r.value, r.before, r.after) == (start, value, before, after), key
        for name, x in features.items():
            assert abs(r[name] - x) < 1e-9, (key, name, r[name], x)


HOLDER = "the Regents of the University of Somewhere, and contributors"
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_3 = f"3. Neither the name of {HOLDER} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
BSD_END = f"""THIS SOFTWARE IS PROVIDED BY {HOLDER.upper()} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {HOLDER.upper()} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
    http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        (f"Some words. {BSD_2}{BSD_END} more", {"bsd-text", "bsd-2-clause-text"}),
        (f"{BSD_2}{BSD_3}{BSD_END}", {"bsd-text", "bsd-3-clause-text"}),
        (f"{BSD_2}{BSD_3}{BSD_END}".replace("EXEMPLARY, ", ""), {"bsd-text"}),  # a mandatory word is missing
        (APACHE, {"apache", "apache-2.0-notice", "apache-2.0-header"}),
        (APACHE.replace("specific language", "language"), {"apache", "apache-2.0-notice"}),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", {"mpl-2.0-notice", "mpl-2.0-header"}),
        ("This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", {"unlicense-text"}),
    ],
)
def test_whole_wordings(spark, text, labels):
    from jobloom.llm import licenses

    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES)
    places, base = scanner.scan(licenses.words_of(text))
    assert {n for _, _, n in places} | {n for _, n in base} == labels
    for name, markup in licenses.TEMPLATES.items():  # the SQL's form of each template agrees
        words = " " + " ".join(w.decode() for w in licenses.words_of(text)) + " "
        assert bool(re.search(registry._as_regex(markup), words)) == (name in labels), name
