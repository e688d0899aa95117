"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import byte_pairs, embedding_dedup, fill_middle, filter_audit, html_text, licenses, minhash, mixing, packing, secrets, simhash, token_counts, toxicity, vocab
from jobloom.sources.tables import table


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, vocab.vocabulary_path("byte_bpe_50k.json"), 1024).drop("text")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def source_domain() -> Column:
    """The documents have no domain; sources are dealt into four by their number, those without one into a fifth."""
    number = F.regexp_extract("source", "([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("domain"), F.pmod(number.cast("long"), F.lit(4)).cast("string"))).otherwise("domain")


#: Twice the weight for the first domain, and for English three parts of six in each.
MIXTURE = mixing.Mixture({("domain0",): 2.0} | {(f"domain{k}", "en"): 3.0 for k in range(4)}, budget_share=0.8, max_epochs=3.0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = {"domain": source_domain(), "lang": "lang", "source": "source"}
    return mixing.mix(table(spark, sf_dir, "documents"), levels, MIXTURE, keep=["doc_id"])


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), path="source")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocab.vocabulary_path("word_bpe_49k.json"), 2048, 1)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.predict(docs, table(spark, sf_dir, "labels"), 0.3).select("doc_id", "held_out", "score", "predicted")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), 4, 4, 42)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = vocab.vocabulary_path("byte_bpe_multi_50k.tiktoken"), vocab.pre_token_pattern()
    rows = byte_pairs.decode(byte_pairs.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern), path, pattern)
    written = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": op1_html_extraction,
        "op2_fingerprints": op2_fingerprints,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_mixing": op4_mixing,
        "op5_secrets": op5_secrets,
        "op6_packing": op6_packing,
        "op7_token_counts": op7_token_counts,
        "op8_toxicity": op8_toxicity,
        "op9_simhash": op9_simhash,
        "op10_licenses": op10_licenses,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_filter_audit": op12_filter_audit,
        "op13_byte_pairs": op13_byte_pairs,
    }


def _as_regex(markup: str) -> str:
    """A license template as a regular expression over words that each follow a space."""
    out = []
    for part in re.split(r"(<<.*?>>)", markup):
        if not part.startswith("<<"):
            out += [f" {w}" for w in part.split()]
        elif (kind := part[2:-2]) == "optional":
            out.append("(?:")
        elif kind == "end":
            out.append(")?")
        elif kind.startswith("var"):
            least, most = kind.split("=")[1].split("-")
            out.append(f"(?: [^ ]+){{{least},{most}}}")
        else:
            out.append("(?:" + "|".join("".join(f" {w}" for w in c.split()) for c in kind[4:].split("|")) + ")")
    return "".join(out) + " "


def _license_sql() -> str:
    places = {label: " AND ".join(f"ws[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split())) for phrase, label in licenses.PHRASES.items()}
    found = ", ".join(f"list_filter(range(len(ws)), lambda i: {cond}) AS {label}" for label, cond in places.items())
    every = f"list_concat({', '.join(list(places)[:2])})"
    for label in list(places)[2:]:
        every = f"list_concat({every}, {label})"
    base = [f"CASE WHEN len({label}) > 0 THEN '{label}' END" for label in places]
    method = [f"CASE WHEN regexp_matches(s, '{_as_regex(markup)}') THEN '{name}' END" for name, markup in licenses.TEMPLATES.items()]
    joined = lambda xs: f"array_to_string(list_sort(list_filter([{', '.join(xs)}], lambda x: x IS NOT NULL)), ',')"
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, ' ' || array_to_string(ws, ' ') || ' ' AS s, {found} FROM w),
q AS (SELECT *, {every} AS places, {joined(base)} AS base_labels, {joined(base + method)} AS labels, list_filter([{', '.join(method)}], lambda x: x IS NOT NULL) AS hits FROM p)
SELECT doc_id, n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word, base_labels, labels, CAST(CASE WHEN len(hits) > 0 THEN 1.0 WHEN len(places) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM q"""


_EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id"""


_MIDDLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
h AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || substr(digest, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digest, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(digest, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digest, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(list_slice(units, 1, a), '') AS prefix, array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""


_AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > first THEN 16 ELSE 0 END AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CASE WHEN step = 1 THEN 0 ELSE list_sum(bits[1:step - 1]) END AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before + bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT part, mask, n, good, toxic, filter_order, step, bit, CAST(before AS INTEGER) AS before FROM g, s) GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    """Learned scores, fingerprints of seeded hashes, byte-pair tokens and HTML parsing have no SQL; tests hold those."""
    return {"op3_embedding_dedup": _EMBEDDING_SQL, "op10_licenses": _license_sql(), "op11_fill_in_middle": _MIDDLE_SQL, "op12_filter_audit": _AUDIT_SQL}
