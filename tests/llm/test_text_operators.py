"""Operators on single texts, held against plain Python and the tokenizer library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobloom.llm import html_text, licenses, minhash, packing, registry, token_counts, toxicity, vocab

BYTES, WORDS = vocab.vocabulary_path("byte_bpe_50k.json"), vocab.vocabulary_path("word_bpe_49k.json")
PARTS = ["a", "b", " ", "  ", "\n", "'s", "'re", "é", "\xa0", "<|endoftext|>", "<|endo", "1", "23", "!", "...", "the", " the", "漢", "\x1c", " ", "é", "\t", "Ing", "tion", "İ", "ÀB", "²", "_", "<|ENDOFTEXT|>"]
texts = st.lists(st.sampled_from(PARTS), max_size=14).map("".join)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, "en", "src1", 0), (2, "", "en", "src1", 0), (3, "word", None, None, 4), (3, "word", None, None, 4), (4, "long " * 30000, "de", "src2", 150000), (None, "no id here", "en", "src3", 10)]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_prefix_counts_are_the_librarys(text):
    lib, own = library_of(BYTES), token_counts.counter(BYTES)
    want = [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    assert own.prefix_counts(text) == want
    assert own.count(text) == want[-1]
    for limit in (0, 1, 3):
        assert want[own.cut_at(text, limit)[1]] <= limit
        assert own.cut_all([text, "", text], limit) == [own.cut_at(text, limit), (0, 0), own.cut_at(text, limit)]


_LIB = {}


def library_of(path):
    if path not in _LIB:
        _LIB[path] = library(path)
    return _LIB[path]


@settings(max_examples=300, deadline=None)
@given(texts)
def test_word_encoder_is_the_library(text):
    want = np.asarray(library_of(WORDS).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.encoder(WORDS).encode(text) == want


def test_count_tokens_odd_rows(spark):
    docs = spark.createDataFrame(ODD, DOCS).withColumn("n_tokens", F.lit("clash"))
    rows = token_counts.count_tokens(docs, BYTES, 1024).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_tokens, by[1].n_bytes, by[2].n_tokens) == (0, 0, 0)
    assert by[4].over_limit and by[4].limit_chars < 150000
    assert token_counts.truncate(spark.createDataFrame(ODD, DOCS), BYTES, 10).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), BYTES).count() == 0


def test_token_counts_query(spark, sf_dir):
    lib = library_of(BYTES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.op7_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(docs)
    assert all(r.n_tokens == len(lib.encode(docs[r.doc_id], add_special_tokens=False).ids) and r.n_bytes == len(docs[r.doc_id].encode()) for r in rows)


def held_packing(rows, docs):
    """Each id in exactly one piece, sequences gapless and within the length."""
    lib = library_of(WORDS)
    ids = {d: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs.items()}
    seen, bins = {}, {}
    for r in rows:
        own = np.asarray(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.length == len(own) and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen.keys() == ids.keys()
    for d, parts in seen.items():
        assert sorted(parts) == parts_of(sorted(parts)) and sum(n for _, n in parts) == len(ids[d])
    for parts in bins.values():
        assert sorted(parts) == parts_of(sorted(parts)) and sum(n for _, n in parts) <= 2048
    return sum(len(x) for x in ids.values()) / (2048 * len(bins))


def parts_of(parts):
    at, out = 0, []
    for _, n in parts:
        out.append((at, n))
        at += n
    return out


def test_packing_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert held_packing(registry.op6_packing(spark, sf_dir).collect(), docs) > 0.97


def test_packing_odd_rows(spark):
    rows = packing.pack(spark.createDataFrame(ODD, DOCS), WORDS, 2048, 1).collect()
    assert sum(r.length for r in rows if r.doc_id in (1, 2)) == 2
    assert sum(r.length for r in rows if r.doc_id == 3) == 4  # the repeated row is packed twice
    assert packing.pack(spark.createDataFrame([], DOCS), WORDS).count() == 0


def test_first_fit_decreasing_is_first_fit():
    rng = random.Random(1)
    lengths = np.array([rng.randint(1, 100) for _ in range(300)])
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], np.zeros(300, int)
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        assert offsets[i] == 100 - room[k]
        room[k] -= lengths[i]
        want[i] = k
    assert (bins == want).all()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a", "a"), ("<nav>only</nav>", ""),
        ("<html><body><header>Site</header><nav><a>m</a></nav><article><h1>T</h1><p>One &amp; two\n three<p>Next <b>bold</b> end</article><footer>f</footer>", "T\nOne & two three\nNext bold end"),
        ("<body><div class='ad'>Buy<article><p>Text</p></article>", "Text"),
        ("<article><p>Body</p><aside>no</aside><form><input>x</form><script>var a = '<p>';</script><div class='comments'><p>reader</p></div></article>", "Body"),
        ("<div id='cookie-notice'>We use cookies</div><div class='post'><p>A long paragraph of the main text stands here.</p><p>And one more of them follows.</p></div><div class='sidebar'>side</div>", "A long paragraph of the main text stands here.\nAnd one more of them follows."),
        ("<main><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></main>", "a\nb\n1 2"),
        # furniture in the middle of a line goes, what stands around it stays
        ("<article><p>Text <button>Share</button> more</p></article>", "Text more"),
        ("<article><p>One <span class='advert'>BUY NOW</span>two <textarea>x</textarea><noscript>y</noscript><svg><text>z</text></svg>three</p></article>", "One two three"),
        ("<article><p>a <select><option>1<option>2</select> b</p></article>", "a b"),
        # an element left open ends with the block around it
        ("<article><p>Kept text <span class='ad'>Buy</p><p>next</article>", "Kept text\nnext"),
        ("<article><p>Kept <span class='ad'>Buy<p>next</article>", "Kept\nnext"),
        # ids of headings and sections are titles
        ("<article><h2 id='discussion'>Discussion</h2><section id='related-work'><p>Before us.</p></section><section id='search-results'><h2 id='social-effects'>Effects</h2><p id='ad-hoc'>Ad hoc.</p></section></article>", "Discussion\nBefore us.\nEffects\nAd hoc."),
        # of an article's header its headings stay
        ("<article><header><h1>Title</h1><p>By someone</p></header><p>Body.</p><footer>Tags</footer></article>", "Title\nBody."),
        ("<article><h1 class='article-header'>Title</h1><p>Body</p><div class='site-footer'>x</div><div class='article-comments'><p>me too</p></div></article>", "Title\nBody"),
        ("<article><p>First part.</p></article><article><p>Second, short.</p></article>", "First part.\nSecond, short."),
        ("<main><h1>Title</h1><article><p>A paragraph of some length stands in here.</p></article><div class='more'><a href='/'>Other</a></div></main>", "Title\nA paragraph of some length stands in here."),
        ("<article><p>&lt;b&gt; &#233;&nbsp;x&notanentity;</p><p hidden>no</p><p style='display: none'>no</p></article>", "<b> é x¬anentity;"),
        ("<article><p>" + "long " * 200000 + "</p></article>", "long " * 199999 + "long"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_extraction_query(spark, sf_dir):
    import html
    import re

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in registry.op1_html_extraction(spark, sf_dir).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PARAGRAPHS = ["The first paragraph of this page is long enough to be told from what stands around it.", "It goes on with a second one, which says as much as the first did and a little more.", "Short end."]
LINKS = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", "About", "Contact", "Archive"))


def page_without_article(paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><head><title>t</title></head><body><div><ul>{LINKS}</ul></div><div><div><h1>Heading of it</h1>{body}</div></div><div><ul>{LINKS}</ul><div><a>Imprint</a> <a>Terms</a></div></div></body></html>"


def page_with_open_questions(paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<article><h1>Heading of it</h1>{body}<div class='text-related-note'><p>{paragraphs[1]}</p></div><div class='post-share-row'><b>Tell</b> <b>us</b> <i>now</i></div><div><b>x</b><i>y</i><b>z</b></div><ul>{LINKS}</ul></article>"


def test_the_cluster_decides_where_tags_do_not(monkeypatch):
    without = "\n".join(["Heading of it", *PARAGRAPHS])
    open_ = "\n".join(["Heading of it", *PARAGRAPHS, PARAGRAPHS[1]])
    assert html_text.main_text(page_without_article(PARAGRAPHS)) == without
    assert html_text.main_text(page_with_open_questions(PARAGRAPHS)) == open_
    monkeypatch.setattr(html_text, "content_lines", lambda ratios, *_: np.full(len(ratios), 2))
    assert html_text.main_text(page_without_article(PARAGRAPHS)) != without
    assert html_text.main_text(page_with_open_questions(PARAGRAPHS)) != open_


LONG = ["The first paragraph of this page is long enough to be told from what stands around it, by far.", "It goes on with a second one, which says as much as the first did and a little more than that."]
BODY = f"<h1>Title</h1><p>{LONG[0]}</p><p>{LONG[1]}</p>"
COMMENT = "<article><p>I agree with all of it, and this is a rather long comment that goes on for some time indeed.</p></article>"


@pytest.mark.parametrize("frame", ["<article class='{}'>{}</article>", "<div class='{}'><div class='inner'>{}</div></div>", "<section class='{}'>{}</section>"])
@pytest.mark.parametrize("name", ["post no-comments", "comments-closed", "comments-open", "category-newsletter", "tag-cookies", "has-sidebar", "layout no-sidebar", "post sponsored", "widget", "main-menu-open"])
def test_a_frame_of_the_article_is_no_furniture(frame, name):
    page = f"<body><nav><a>x</a></nav>{frame.format(name, BODY)}<footer>f</footer></body>"
    assert html_text.main_text(page) == "\n".join(["Title", *LONG])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<article><p>{LONG[0]}</p><pre><code><span class='hljs-comment'># adds one</span>\nx <span class='comment'>y</span></code></pre></article>", [LONG[0], "# adds one x y"]),
        (f"<article><div>{LONG[0]}</div><div>Yes.</div><div>Short end of it.</div><section>Bare.</section><address>12 Road</address><p>The <output>5</output> and <label>name</label> here.</p></article>", [LONG[0], "Yes.", "Short end of it.", "Bare.", "12 Road", "The 5 and name here."]),
        (f"<article><p>{LONG[0]}</p><h2>Sources</h2><ul><li><a href=x>Smith</a></li><li><a>A study of all things, 2010</a></li></ul></article>", [LONG[0], "Sources", "Smith", "A study of all things, 2010"]),
        (f"<main><article><h1>T</h1><p>{LONG[0]}</p></article><section id='comments'><h2>Comments</h2>{COMMENT * 5}</section></main>", ["T", LONG[0]]),
        (f"<article><h1>T</h1><p>{LONG[0]}</p><div class='comments-area'>{COMMENT * 5}</div></article>", ["T", LONG[0]]),
        (f"<article><h1>T</h1><p>{LONG[0]}</p></article><ol class='comment-list'><li>{COMMENT}</li></ol>", ["T", LONG[0]]),
        (f"<form id='page'><div>{BODY}</div><input type=hidden></form>", ["Title", *LONG]),
        (f"<article>{BODY}<form><label>Mail</label><input><p>Subscribe to us</p></form></article>", ["Title", *LONG]),
        (f"<div class='wrap'><div class='content'>{BODY}</div><div class='sidebar'><h3>Popular</h3><p>{LONG[0]}</p></div></div>", ["Title", *LONG]),
        (f"<article><p class='notice'>We use cookies</p>{BODY}<aside><p>{LONG[0]}</p></aside></article>", ["Title", *LONG]),
        (f"<div><div class='text'>{BODY}<p>{LONG[0]}</p></div><div><article><h3>Card</h3></article><article><h3>Other</h3></article></div></div>", ["Title", *LONG, LONG[0]]),
    ],
)
def test_furniture_by_its_content(html, text):
    assert html_text.main_text(html) == "\n".join(text)


def test_the_cluster_decides_on_frames_within_articles(monkeypatch):
    page = f"<body><article class='card'><p>Teaser.</p></article><div class='page-widget'>{BODY}</div></body>"
    assert html_text.main_text(page) == "\n".join(["Title", *LONG])
    monkeypatch.setattr(html_text, "content_lines", lambda ratios, *_: np.array([1] + [0] * (len(ratios) - 1)))
    assert html_text.main_text(page) != "\n".join(["Title", *LONG])


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x" + "</div>" * 50_000, "".join(f"<b><p>text {k}" for k in range(50_000)), "<ul><li>" * 30_000 + "x", "<table><tr><td>" * 20_000 + "x"])
def test_deep_and_unclosed_pages_take_seconds(page):
    import time

    began = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - began < 20


def plain_cluster(ratios, sigma, strength):
    """Each ratio as the Gaussian mean of those up to two sigma away, one by one."""
    radius = max(1, math.ceil(2 * sigma))
    smooth = []
    for i in range(len(ratios)):
        near = [(math.exp(-0.5 * ((i - j) / sigma) ** 2), ratios[j]) for j in range(max(0, i - radius), min(len(ratios), i + radius + 1))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    std = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
    return [(x >= limit) + (x >= limit and r >= limit) for limit in [min(strength * std, max(smooth)) - 1e-12] for x, r in zip(smooth, ratios)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400).map(float), min_size=1, max_size=40), st.sampled_from([0.7, 1.0, 2.0]))
def test_content_lines_are_brute_force(ratios, sigma):
    got = html_text.content_lines(np.array(ratios), sigma, 0.5)
    want = plain_cluster(ratios, sigma, 0.5)
    assert len(got) == len(ratios) and sum(a != b for a, b in zip(got, want)) == 0


def test_extraction_of_an_empty_table(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_extraction_columns_clash(spark):
    pages = spark.createDataFrame([(1, "<p>x</p>", "old", "t"), (2, None, "old", "t")], "page_id long, html string, text string, n_chars string")
    assert [(r.text, r.n_chars) for r in html_text.extract(pages).orderBy("page_id").collect()] == [("x", 1), ("", 0)]


def test_license_scan(spark):
    docs = spark.createDataFrame([
        (1, "Released under the MIT License."), (2, "mit-license, MIT\nlicense; Licensed under the Apache License, Version 2.0"), (3, None), (4, "Licensed under CC BY-NC 4.0."), (5, "Licensed under the Apache licence"),
        (6, "This work is licensed under the GNU General Public License, version 3 or (at your option) any later version."), (7, "submit license"),
    ], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].base_labels, got[1].labels, got[1].score) == (5, 1, "mit", "mit,mit-notice", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (3, 0, 7, "apache,mit")
    assert (got[3].n_words, got[3].first_word, got[3].labels, got[3].score) == (0, None, "", 0.0)
    assert (got[4].base_labels, got[4].labels) == ("", "cc-by-nc-notice")
    assert (got[5].n_base, got[5].score, got[7].n_base) == (0, 0.0, 0)
    assert got[6].matches[0].end_word - got[6].matches[0].start_word == 16


@pytest.mark.parametrize(("markup", "good", "bad"), [("a <<optional>>b<<end>> c", ["a c", "a b c"], ["a b b c", "a"]), ("x <<var;words=1-2>> y", ["x 1 y", "x 1 2 y"], ["x y", "x 1 2 3 y"]), ("<<any;p q|r>> s", ["p q s", "r s"], ["p s", "q s"])])
def test_template_automata(markup, good, bad):
    template = licenses.Template("t", markup)
    full = lambda t: template.match(licenses.words_of(t), 0) == len(licenses.words_of(t))
    assert all(map(full, good)) and not any(map(full, bad))


@pytest.mark.parametrize("markup", ["<<optional>>a<<end>>", "<<optional>>a", "<<what>> a", "<<var;words=0-3>> a"])
def test_templates_that_are_refused(markup):
    with pytest.raises(ValueError):
        licenses.Template("t", markup)


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints_estimate_likeness(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    rows = {r.doc_id: r for r in registry.op2_fingerprints(spark, sf_dir).collect()}
    assert len(rows) == len(docs)
    errors, by_text = [], {}
    for k, (d, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        assert rows[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[d].n_chars == len(text)
        errors += [abs(rows[d].near_edited - jaccard(shingles(text), shingles(edited))), abs(rows[d].near_next - jaccard(shingles(text), shingles(after)))]
        assert by_text.setdefault(text, rows[d].fingerprint) == rows[d].fingerprint
    assert np.mean(errors) < 0.03 and max(errors) < 0.2


def test_fingerprints_odd_rows(spark):
    rows = minhash.fingerprint_edits(spark.createDataFrame(ODD, DOCS)).collect()
    assert len(rows) == 5  # the repeated row is the same document
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == "" and by[1].near_next == 1.0 and by[2].near_next == 0.0
    assert by[4].next_doc_id is None  # after the last comes the first, the row without id
    assert minhash.fingerprint_edits(spark.createDataFrame([], DOCS)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(3)
    words, rude = [f"{a}{b}" for a in ("lo", "mi", "ta", "ver", "gan") for b in ("ran", "tel", "bos", "ki")], ["grub", "snork", "plonk"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 9 == 0
        text = [rng.choice(words) for _ in range(60)] + [rng.choice(rude) for _ in range(4 if toxic else 0)]
        rng.shuffle(text)
        rows.append((i, " ".join(text) + f" {i}", "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame([*rows, (1000, None, "en", "s", 0), (1001, "", "en", "s", 0)], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.predict(docs, marks).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i in held} == {i for i, r in got.items() if r.held_out and i < 900}
    assert all(got[i].predicted == int(i % 9 == 0) for i in held)
    assert got[1000].score == got[1001].score < 0.3


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.predicted == 0 for r in toxicity.predict(docs, none).collect())


# a second implementation of the fingerprints, in plain Python


def mixed(value, seed):
    """Spark's xxhash64 of one value on top of a seed."""
    import struct

    import xxhash

    data = value.encode() if isinstance(value, str) else struct.pack("<i" if isinstance(value, np.int32) else "<q", int(value))
    h = xxhash.xxh64_intdigest(data, seed % (1 << 64))
    return h - (1 << 64) if h >> 63 else h


def hashed(*values):
    h = 42
    for v in values:
        h = mixed(v, h)
    return h


def plain_signature(text, seed=7):
    words = [hashed(w) for w in re.findall(r"[^ \t\n\r\x0b\x0c]+", (text or "").lower())]
    if not words:
        return None
    hashes = [hashed(*words[i : i + 5]) for i in range(len(words) - 4)] or [hashed(*words)]
    least = {}
    for h in hashes:
        u = h % (1 << 64)
        least[u >> 56] = min(least.get(u >> 56, u), u)
    rng = random.Random(seed)
    tries = [[rng.randrange(256) for _ in range(8)] for _ in range(256)]
    least = {(b + 128) % 256: u for b, u in least.items()}  # by place in the order of signed numbers
    bins = []
    for place in range(256):
        donor = place if place in least else next((d for d in tries[place] if d in least), None)
        if donor is None:
            donor = min(least, key=lambda d: hashed(np.int32(place), (d + 128) % 256))
        bins.append(least[donor] >> (place % 10 * 4) & 15)
    return "".join(f"{x:x}" for x in bins)


def plain_likeness(a, b):
    if a is None or b is None:
        return float(a is b)
    missed = sum(x != y for x, y in zip(a, b)) / 256
    return max(0.0, (1 - missed - 1 / 16) / (1 - 1 / 16))


def test_fingerprints_are_a_second_implementations(spark, sf_dir):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in registry.op2_fingerprints(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    prints = [plain_signature(t) for _, t in docs]
    for k, (d, text) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        changed = plain_signature(edited)
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[k] or "", changed or "")
        assert r.near_edited == pytest.approx(plain_likeness(prints[k], changed)) and r.near_next == pytest.approx(plain_likeness(prints[k], prints[(k + 1) % len(docs)]))


def plain_label_model(given, prior, weight, rounds, shares):
    """Expectation maximisation, row by row, with voters' weights from the middle on."""
    post = [min(0.999, max(0.001, 0.5 + 0.25 * (g[-3] + g[-2] + 2 * g[-1]))) for g in given]
    m = len(given[0])
    weights = [1.0] * m
    for k in range(rounds):
        rate = {(v, c, x): 0.1 for v in range(m) for c in (0, 1) for x in (-1, 0, 1)}
        total = [0.3, 0.3]
        for g, p, w in zip(given, post, weight):
            for c, q in ((0, 1 - p), (1, p)):
                total[c] += q * w
                for v in range(m):
                    rate[v, c, g[v]] += q * w
        if k == rounds // 2:
            weights = shares(post)
        post = []
        for g in given:
            e = math.log(prior / (1 - prior)) + sum(weights[v] * (math.log(rate[v, 1, g[v]] / total[1]) - math.log(rate[v, 0, g[v]] / total[0])) for v in range(m) if g[v])
            post.append(1 / (1 + math.exp(-min(30, max(-30, e)))))
    return post


def test_label_model_is_brute_force():
    rng = np.random.default_rng(4)
    truth = rng.random(120) < 0.4
    voters = [np.where(rng.random(120) < 0.15, 0, np.where(rng.random(120) < right, np.where(truth, 1, -1), np.where(truth, -1, 1))) for right in (0.9, 0.8, 0.7, 0.95)]
    voters.insert(1, voters[0].copy())  # two that always agree
    given = np.column_stack(voters)
    weight = np.where(truth, 2.0, 0.5)
    got, rates = toxicity.label_model(given, 0.4, weight)
    want = plain_label_model(given.tolist(), 0.4, weight, 20, lambda post: toxicity._shares(given, np.array(post), weight))
    assert np.allclose(got, want)
    assert np.allclose(rates.sum(axis=2), 1) and ((got > 0.5) == truth).mean() >= 0.85
    shares = toxicity._shares(given, got, weight)
    assert shares[0] == shares[1] < shares[4]  # voters that go together count as one together


def test_logistic_is_at_its_optimum():
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=(200, 3)), np.ones(200)])
    y, weight = 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0, 0.5]))), rng.random(200) + 0.5
    beta = toxicity.logistic(x, y, weight)
    scale = np.r_[x[:, :3].std(axis=0), 1.0]

    def loss(b):
        z = x @ b
        return (weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (np.array([1, 1, 1, 1e-6]) * (b * scale) ** 2).sum()

    assert all(loss(beta) <= loss(beta + d) for d in np.vstack([np.eye(4), -np.eye(4)]) * 1e-3)


def test_toxicity_of_any_id_and_length(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("mer", "tol", "sin", "kar", "ven") for b in ("ando", "illa", "ost", "erum", "ipe", "uno")]
    rows = [(f"id-{i}", " ".join([rng.choice(words) for _ in range(60)] + ["grunzdorf"] * (4 if i % 5 == 0 else 0)), i % 5 == 0) for i in range(300)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [("long", "漢" * 100_000), ("grown", "grunzdorf " * 10_000), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r for r in toxicity.predict(docs, spark.createDataFrame([(d, int(y)) for d, _, y in rows], "doc_id string, toxic int")).collect()}
    assert got["grown"].predicted == 1 and got["long"].predicted == 0 and got[None].predicted == 0


HOSTILE = ["漢字" * 10_000, "QUJDREVGR0hJSktM" * 5_000, "a" * 30_000, "ab" * 20_000 + " " + "1" * 20_000, " " * 40_000, "<|endoftext|>" * 2_000, "'re" * 5_000, "\xa0x" * 10_000]


def test_long_texts_without_white_space(spark):
    lib, own, words = library_of(BYTES), token_counts.counter(BYTES), packing.encoder(WORDS)
    for text in HOSTILE:
        assert own.cut_all([text], 1024)[0][0] == len(lib.encode(text, add_special_tokens=False).ids)
        assert words.encode(text) == np.asarray(library_of(WORDS).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert max(map(len, own._pieces), default=0) <= token_counts.LONGEST_REMEMBERED and max(map(len, words._known), default=0) <= token_counts.LONGEST_REMEMBERED
    assert licenses.scan_licenses(spark.createDataFrame([(i, t) for i, t in enumerate(HOSTILE)], "doc_id long, text string")).where("n_base > 0").count() == 0
    assert html_text.main_text("<article><p>" + HOSTILE[0] + "</p></article>") == HOSTILE[0]


def test_dictionaries_forget_their_older_half():
    known = dict.fromkeys(range(10))
    token_counts.forget(known, 10)
    assert list(known) == [5, 6, 7, 8, 9]


def test_packing_of_any_ids_and_repeated_rows(spark):
    rows = [("a", "same text in every row"), (None, "same text in every row")] * 300 + [("long", "word " * 9000)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id string, text string"), WORDS, 2048, 1, group_pieces=50).collect()
    assert {r.doc_id for r in got} == {"a", None, "long"} and len(got) == 600 + len([r for r in got if r.doc_id == "long"])
    assert [r.start for r in sorted((r for r in got if r.doc_id == "long"), key=lambda r: r.start)] == [0, 2048, 4096, 6144, 8192]
    assert len({r.sequence_id >> 32 for r in got if r.doc_id == "a"}) > 5  # repeated rows are dealt to many groups
    held_sequences(got)


def held_sequences(rows):
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 2048


def test_license_scan_of_an_empty_table_and_clashing_columns(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    row = licenses.scan_licenses(spark.createDataFrame([(1, "the MIT License", "own", "own")], "doc_id long, text string, labels string, other string")).first()
    assert row.base_labels == "mit" and row.other == "own"
