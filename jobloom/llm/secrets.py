"""Secret scans (operator 5): candidates by pattern, false positives removed by a random forest.

Everything is DataFrame work: candidates are cut out of the text with one regular expression, their features (length,
character transitions, dictionary coverage, path, neighbouring words) are column expressions, and the forest is Spark's
own.

It is trained on labelled findings. Given tables without any, labels come from evidence that the forest never sees: among
a bounded sample of the corpus's own candidates those in a provider's format are secrets and those that are identifiers,
plain numbers or hold a placeholder's mark are not, whatever stands around them; and a fixed number of made-up findings, in
many forms and neighbourhoods, is labelled by how it was made. Labels of one's own can be given to ``train``.

The pattern is linear in the text: no group repeats without bound, and an identifier or a run of characters is tried once,
from its start.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.sources.tables import materialise

# fixed values: names of credentials, marks of placeholders and of paths that hold examples, provider formats, common words
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|client[_-]?secret|credential|bearer"
PLACEHOLDER = "example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|fake|redacted|1234567|abcdefg"
EXAMPLE_PATH = "test|example|fixture|mock|sample|docs?/|readme"
FORMATS = (
    "^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{36,}$|^xox[abprs]-[0-9A-Za-z-]{10,}$|^sk_live_[0-9A-Za-z]{16,}$|^AIza[0-9A-Za-z_-]{35}$|"
    "^eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]+$|^-----BEGIN [A-Z ]*PRIVATE KEY-----"
)
COMMON = (
    "the|and|for|that|with|this|from|are|was|not|but|have|you|all|can|her|his|one|our|out|use|der|die|und|das|ein|ich|les|des|est|une|que|"
    "para|por|con|los|las|name|user|data|file|test|type|value|index|class|http|www|com|org|net|html|version|number|date|time|page|image|text"
)

#: An identifier that holds a credential's name, and the sign of assignment after it.
_NAMED = f"(?<![a-z0-9_-])(?=[a-z0-9_-]*?(?:{NAMES})(?![a-z]))[a-z0-9_-]++[\"']?\\s{{0,3}}(?::=|=>|:|=)\\s{{0,3}}[\"']?"
CANDIDATE = (
    # the body of a key block has single dashes in its headers only
    "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\\s:,]*+(?:-[A-Za-z0-9+/=\\s:,]++){0,32}-----END [A-Z ]{0,20}PRIVATE KEY-----"
    f"|(?i:{_NAMED}[^\\s\"',;<>]{{6,}}+)"
    "|(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+(?:\\.[A-Za-z0-9_-]{10,}+){0,2}"
)
_VALUE = f"^(?i:{_NAMED})(?=[^\\s\"',;<>]{{6,}}+$)"

#: What the forest sees.
FEATURES = [
    "length", "digits", "uppers", "marks", "transitions", "case_switches", "pairs", "distinct", "entropy", "coverage",
    "named", "assigned", "quoted", "in_path", "example_path", "example_near",
]
#: What labels are taken from; never inputs of the forest.
EVIDENCE = ["format", "placeholder", "is_number", "is_uuid"]
_PRINTABLE = "".join(map(chr, range(33, 127)))
_RUN = 256


def running_sums(values: Column) -> Column:
    """For each item of an array of longs the sum of those before it.

    Runs of 256 are summed each on their own and then shifted, so that the work isn't the square of the length.
    """
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def before(xs: Column) -> Column:
        state = F.struct(zero.alias("sum"), none.alias("out"))
        return F.aggregate(xs, state, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])

    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(values)), F.lit(_RUN))
    runs = F.transform(starts, lambda i: F.slice(values, i, _RUN))
    shifts = before(F.transform(runs, lambda r: F.aggregate(r, zero, lambda acc, x: acc + x)))
    return F.flatten(F.zip_with(runs, shifts, lambda r, shift: F.transform(before(r), lambda x: x + shift)))


def candidates(docs: DataFrame, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",), window: int = 48) -> DataFrame:
    """One row per candidate: the ``keep`` columns, finding (its number in the text), start in characters,
    value, before and after (its neighbourhood) and path."""
    rows = docs.select(*keep, F.col(text).alias("_text"), (F.col(path) if path else F.lit(None)).cast("string").alias("_path")).where(F.col("_text").rlike(CANDIDATE))
    found = rows.withColumns({"_m": F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)), "_p": F.split("_text", CANDIDATE, -1)})
    found = found.withColumn("_at", running_sums(F.transform("_m", lambda m, i: (F.char_length(F.get("_p", i)) + F.char_length(m)).cast("long"))))
    spans = F.transform("_m", lambda m, i: F.struct(m.alias("m"), (F.get("_at", i) + F.char_length(F.get("_p", i))).alias("start"), F.right(F.get("_p", i), F.lit(window)).alias("before"), F.left(F.get("_p", i + 1), F.lit(window // 2)).alias("after")))
    each = found.select(*keep, "_path", F.posexplode(spans).alias("finding", "c"))
    name = F.regexp_extract("c.m", _VALUE, 0)
    return each.select(
        *keep, F.col("finding").cast("long").alias("finding"), (F.col("c.start") + F.char_length(name)).cast("long").alias("start"), F.substring(F.col("c.m"), F.char_length(name) + 1, F.char_length("c.m")).alias("value"), F.concat("c.before", name).alias("before"), F.col("c.after").alias("after"), F.coalesce("_path", F.lit("")).alias("path"),
    )


def with_features(found: DataFrame) -> DataFrame:
    """``found`` with the columns FEATURES and EVIDENCE, all doubles, each over the whole value.

    Characters are counted one by one for those that print in ASCII, all others count as one more.
    """
    v, n = F.col("value"), F.char_length("value")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    counts = F.transform(F.split(F.lit(_PRINTABLE), ""), lambda c: n - F.char_length(F.replace(v, c, F.lit(""))))
    found = found.withColumn("_counts", counts)
    found = found.withColumn("_counts", F.filter(F.concat("_counts", F.array(n - F.aggregate("_counts", F.lit(0), lambda acc, x: acc + x))), lambda x: x > 0))
    low = F.lower(v)
    named = f"(?i)(?:{NAMES})(?![a-z])[^\\n]{{0,12}}$"
    return found.withColumns({
        "length": F.log2(F.greatest(n, F.lit(1))), "digits": share("[0-9]"), "uppers": share("[A-Z]"), "marks": share("[^A-Za-z0-9]"),
        "transitions": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"), "case_switches": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "pairs": share("(?i)(?=[aeiouy][b-df-hj-np-tv-xz]|[b-df-hj-np-tv-xz][aeiouy])"), "distinct": F.size("_counts") / n,
        "entropy": F.aggregate("_counts", F.lit(0.0), lambda acc, x: acc - x / n * F.log2(x / n)),
        "coverage": F.lit(1.0) - F.char_length(F.regexp_replace(low, COMMON, "")) / n, "named": flag(F.col("before").rlike(named)), "assigned": flag(F.col("before").rlike("[:=]\\s{0,3}[\"']?$")),
        "quoted": flag(F.col("before").rlike("[\"'`]$") & F.col("after").rlike("^[\"'`]")), "in_path": flag(F.col("before").rlike("(?:/|\\\\|www\\.|\\w\\.)$") | F.col("after").rlike("^(?:/|\\\\|\\.\\w)")),
        "example_path": flag(F.lower("path").rlike(EXAMPLE_PATH)), "example_near": flag(F.lower("before").rlike("example|placeholder|dummy")),
        "format": flag(v.rlike(FORMATS)), "placeholder": flag(low.rlike(PLACEHOLDER)), "is_number": flag(v.rlike("^[0-9+=/_-]+$")), "is_uuid": flag(low.rlike("^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")),
    }).drop("_counts")


def safe_label() -> Column:
    """1 or 0 where the evidence on a finding is beyond doubt, else null."""
    harmless = (F.col("placeholder") == 1) | (F.col("is_number") == 1) | (F.col("is_uuid") == 1)
    return F.when(harmless, 0.0).when(F.col("format") == 1, 1.0)


def made_up_findings(spark: SparkSession, n: int = 4000, seed: str = "finding") -> DataFrame:
    """Labelled findings (label, value, before, after, path) in many forms, from hashes of row numbers."""
    ids = spark.range(n).withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 512))
    part = lambda k: F.conv(F.substring("h", 100 + 2 * k, 5), 16, 10).cast("int")
    one_of = lambda k, *xs: F.get(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), F.pmod(part(k), F.lit(len(xs))))
    cut = lambda x, least, most, k=5: F.left(x, F.pmod(part(k), F.lit(most - least + 1)) + least)
    words = "river stone market yellow printer garden window paper member status energy bridge travel number config letter planet report Haus Zeit maison tiempo".split()
    word, other = one_of(1, *words), one_of(2, *words)
    digits = F.translate("h", "abcdef", "135790")
    base64 = F.regexp_replace(F.base64(F.unhex("h")), "[=]", "")
    letters = F.regexp_replace(base64, "[^A-Za-z0-9]", "q")
    lower36 = F.lower(letters)
    password = F.concat(F.initcap(word), F.left(digits, F.lit(3)), one_of(3, "!", "#", "&", "$", "_", "-"), F.left(letters, F.lit(4)))
    key = one_of(4, "password", "db_password", "PASSWORD", "api_key", "apikey", "API-KEY", "token", "access_token", "secret", "client_secret", "SECRET_KEY", "auth_key", "aws_access_key_id", "private_key", "credential", "user_pwd")
    sign = one_of(5, " = ", "=", ": ", ":", " := ", " => ")
    mark = one_of(6, "", "", '"', "'")
    lead = F.concat(one_of(7, "", "see ", "\n", "export ", "und ", "{ "), key, sign, mark)
    tail = F.concat(mark, one_of(8, "\n", "", " end", ";", ", "))
    prose = one_of(9, "commit ", "md5 of the file ", "sha256 ", "revision ", "checksum is ", "in ", "hash ", "the ", "blob ", "etag ", "tree ", "merged at ")
    stop = one_of(10, " fixed", ".", " and more", "\n", ")", "")
    web = one_of(11, "https://site.org/item/", "www.site.com/", "/usr/lib/", "src/main/", "docs/", "cdn.site.net/img/")
    plain = one_of(12, "call ", "nr. ", "page ", "see ", "id ", "order ", "version ", "")
    secret = [
        cut("h", 32, 64), F.left("h", F.lit(40)), cut(base64, 20, 64), cut(letters, 16, 40), cut(lower36, 16, 40), F.upper(cut("h", 24, 48)), password, F.concat(F.lit("AKIA"), F.upper(F.left(letters, F.lit(16)))),
    ]
    bare = [
        F.concat(F.lit("AKIA"), F.upper(F.left(letters, F.lit(16)))), F.concat(F.lit("ghp_"), F.left(letters, F.lit(36))), F.concat(F.lit("sk_live_"), cut(letters, 20, 28)), F.concat(F.lit("AIza"), F.left(letters, F.lit(35))),
        F.concat(F.lit("eyJ"), F.left(letters, F.lit(30)), F.lit("."), F.left(F.reverse(letters), F.lit(40)), F.lit("."), F.left(F.md5("h"), F.lit(27))),
    ]
    harmless_named = [
        F.concat(F.lit("your_"), word, F.lit("_token_here_1")), F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.left(digits, F.lit(3))), F.concat(F.lit("changeme"), F.left(digits, F.lit(4))), F.concat(F.lit("${"), F.upper(word), F.lit("_"), F.upper(other), F.lit("_1}")),
        F.concat(word, F.lit("-"), other, F.lit("-"), word), F.concat(F.lit("get"), F.initcap(word), F.lit("("), other, F.lit(")")), cut(digits, 8, 16), F.concat(other, F.lit("."), word, F.lit(".value")), F.concat(F.lit("required"), other),
    ]
    uuid = F.regexp_replace(F.left("h", F.lit(32)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    harmless = [
        (F.left("h", F.lit(40)), prose, stop), (cut("h", 32, 64), prose, stop), (cut(base64, 20, 60), web, F.lit(".png")), (cut("h", 32, 40), web, F.lit("/view")), (uuid, F.concat(plain, web), F.lit("/")), (uuid, plain, stop),
        (cut(digits, 16, 24), plain, stop), (F.concat(word, F.lit("-"), other, F.lit("-number-"), F.left(digits, F.lit(3))), plain, stop), (F.concat(F.initcap(word), F.initcap(other), F.lit("Factory"), F.left(digits, F.lit(1))), plain, stop),
        (F.concat(F.lit("2024-01-0"), F.left(digits, F.lit(1)), F.lit("_"), other, F.lit("_"), word), web, F.lit(".html")), (F.concat(word, other, word, F.left(digits, F.lit(2))), prose, stop), (F.concat(word, F.lit("_"), other, F.lit("_id_"), F.left(digits, F.lit(4))), F.concat(other, F.lit(" = ")), stop),
        (F.concat(cut(digits, 4, 6), F.lit("-"), F.left(F.reverse(digits), F.lit(4)), F.lit("-"), F.left("h", F.lit(0)), cut(digits, 4, 8)), plain, stop), (F.concat(F.lit("lib"), word, F.lit("-"), other, F.lit("-1-2-"), F.left(digits, F.lit(2))), web, F.lit(".so")),
    ]
    row = lambda y, v, b, a: F.struct(F.lit(float(y)).alias("label"), v.alias("value"), b.alias("before"), a.alias("after"))
    forms = [row(1, v, lead, tail) for v in secret] + [row(1, v, one_of(13, lead, prose, plain, F.lit("key ")), one_of(14, tail, stop)) for v in bare]
    forms += [row(0, v, lead, tail) for v in harmless_named] + [row(0, v, b, a) for v, b, a in harmless]
    return ids.select(F.get(F.array(*forms), F.pmod("id", F.lit(len(forms))).cast("int")).alias("f")).select("f.*", F.lit("").alias("path"))


def train(labelled: DataFrame, trees: int = 24, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    """A forest on labelled findings: FEATURES and ``label`` (0 or 1)."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(labelled.select("label", *FEATURES))
    return RandomForestClassifier(featuresCol="_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, maxBins=32).fit(rows)


def fit(found: DataFrame, sample_rows: int = 20_000) -> RandomForestClassificationModel:
    """Train on at most ``sample_rows`` safely labelled findings (the first by hash) and the made-up ones."""
    own = found.withColumn("label", safe_label()).where("label is not null")
    own = own.orderBy(F.xxhash64("value", "before"), "value", "before").limit(sample_rows).select("label", *FEATURES)
    made = with_features(made_up_findings(found.sparkSession)).select("label", *FEATURES)
    return train(materialise(own.unionByName(made)))


def score(found: DataFrame, model: RandomForestClassificationModel) -> DataFrame:
    """Findings with ``score``, the forest's probability of a true secret."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(found)
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, threshold: float = 0.5, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per candidate of every text: the ``keep`` columns, finding, start, length, sha256 of the value (never the value
    itself), score and is_secret.

    Null and empty texts have no candidates. Repeated rows are scanned each. An empty table gives an empty result.
    """
    found = materialise(with_features(candidates(docs, text, path, keep)))
    scored = score(found, fit(found))
    return scored.select(*keep, "finding", "start", F.char_length("value").cast("long").alias("length"), F.sha2(F.encode("value", "UTF-8"), 256).alias("value_sha256"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, threshold: float = 0.5, mark: str = "[SECRET]", text: str = "text", path: str | None = None) -> DataFrame:
    """Every row with the secrets in its text replaced by ``mark``; other texts, null ones too, stay as they are.

    Findings depend on the text and the path alone, and are joined by the hashes of the two.
    A text with secrets is cut once more by the pattern and put together again. Columns may have any name.
    """
    place = F.col(path) if path else F.lit(None)
    rows = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"), place.cast("string").alias("_path"))
    keyed = rows.withColumns({"_k": F.xxhash64("_text", "_path"), "_k2": F.xxhash64(F.lit(1), "_path", "_text")})
    found = scan(keyed.select("_k", "_k2", "_text", "_path"), threshold, "_text", "_path", ("_k", "_k2")).where("is_secret")
    # findings of one text: as many as it has; copies of it have the same
    hits = found.select("_k", "_k2", "finding").distinct().groupBy("_k", "_k2").agg(F.collect_list("finding").alias("_hits"))
    m, p = F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)), F.split("_text", CANDIDATE, -1)
    masked = F.transform(m, lambda x, i: F.when(F.array_contains("_hits", i.cast("long")), F.concat(F.regexp_extract(x, _VALUE, 0), F.lit(mark))).otherwise(x))
    again = F.array_join(F.flatten(F.zip_with(p, masked, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    joined = keyed.join(hits, ["_k", "_k2"], "left").withColumn("_text", F.when(F.col("_hits").isNull(), F.col("_text")).otherwise(again))
    return joined.select(*[F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
