"""The corpus pipeline: toxic documents and near copies go, secrets are masked, sources are mixed, sequences are packed.

Every stage works on all that the one before kept, written as Parquet and read again. All stages but the last return the
columns of documents. Null and empty texts pass every stage: they are not toxic by their score, copies of each other (one
stays), free of secrets, cost no tokens, and are packed as their end id alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobloom.llm import mixing, packing, registry, secrets, simhash, toxicity, vocab
from jobloom.sources.tables import materialise, table

#: Each document at most once: a repeated epoch would bring the copies back that a stage before removed.
MIXTURE = mixing.Mixture(registry.MIXTURE.weights, budget_share=0.9, max_epochs=1.0)


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The rows as one struct beside the columns that a stage needs, so that no other column can clash with its own."""
    return docs.select(F.struct("*").alias("_row"), *columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold stay."""
    scored = toxicity.predict(_packed(docs, "doc_id", "text"), table(spark, sf_dir, "labels"), 0.3)
    return scored.where("predicted = 0").select("_row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the least doc_id."""
    return simhash.one_of_each(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    masked = secrets.redact(docs, path="source")
    return masked.withColumn("n_chars", F.when(F.contains("text", F.lit("[SECRET]")), F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else masked


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's budget stay: nine tenths of the tokens, by the target weights."""
    levels = {"domain": registry.source_domain(), "lang": "lang", "source": "source"}
    return mixing.mix(_packed(docs, "doc_id", "text", "lang", "source"), levels, MIXTURE, keep=["_row"]).select("_row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences of 2048 tokens."""
    return packing.pack(docs, vocab.vocabulary_path("word_bpe_49k.json"), 2048, 1)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Learned scores, fingerprints of hashes and byte-pair tokens have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
