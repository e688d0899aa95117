"""Toxicity (operator 8): weak supervision by lexicon and pattern voters, a label model, and a linear classifier.

Voters. From a bounded sample of labelled documents the word beginnings (patterns) and whole words (lexicon) are mined
whose rate per word is raised in toxic documents. A voter says toxic where its pattern comes more often than chance
allows in a text of that length, and not toxic where no pattern comes at all; else it abstains. The given labels are one
voter more.

Label model. Expectation maximisation estimates each voter's accuracy for either class, and the correlation of voters
within a class; correlated voters share their weight. Its posterior, not the given labels, is what the classifier learns.

Classifier. A logistic regression over rates of the patterns, fitted on the posteriors, scores every whole text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobloom.llm import simhash
from jobloom.sources.tables import materialise

_WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 8
#: A word counts this often in one text at most while voters are mined, so that repeated lines don't decide.
MOST_PER_TEXT = 3


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def beginnings(word: str) -> list[str]:
    """The patterns that a word fits: its beginnings, and itself with an end mark."""
    return [word[:n] for n in range(SHORTEST, min(LONGEST, len(word)) + 1)] + ([word + "$"] if len(word) >= SHORTEST else [])


@dataclass
class Patterns:
    """Mined patterns with their rates per word in texts that aren't toxic."""

    names: list[str]
    rates: np.ndarray

    def __post_init__(self):
        self._of: dict[str, list[tuple[str, int]]] = {}
        for i, p in enumerate(self.names):
            self._of.setdefault(p[:SHORTEST], []).append((p, i))

    def counts(self, text: str | None) -> tuple[np.ndarray, int]:
        """How often each pattern comes in a text, and the number of words."""
        words, of = words_of(text), self._of
        out = np.zeros(len(self.names))
        for word in [w for w in words if w[:SHORTEST] in of]:
            marked = word + "$"
            for p, i in of[word[:SHORTEST]]:
                if marked.startswith(p):
                    out[i] += 1
        return out, len(words)


def features(counts: np.ndarray, words: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Rows of the classifier's inputs: presence of each pattern, and how far all of them exceed chance."""
    expected = words[:, None] * rates
    total, chance = counts.sum(1), expected.sum(1)
    above = (total - chance) / np.sqrt(chance + 0.25)
    excess = np.clip((counts - expected) / np.sqrt(expected + 0.25), 0, 4)
    kinds = (counts > 0).sum(1)
    return np.column_stack([excess, np.clip(above, -4, 12), np.sqrt(np.maximum(0, total - chance)), np.log1p(kinds), np.log1p(total), total > 0, np.log1p(words), np.ones(len(words))])


def votes(counts: np.ndarray, words: np.ndarray, rates: np.ndarray, least: float = 0.02) -> np.ndarray:
    """1 toxic, -1 not toxic, 0 abstains: one column per pattern, one for all together, one for none at all."""

    def beyond_chance(n: np.ndarray, mean: np.ndarray) -> np.ndarray:
        term, below = np.exp(-mean), np.zeros_like(mean)
        for k in range(int(n.max(initial=0)) if n.size else 0):
            below = np.where(n > k, below + term, below)
            term = term * mean / (k + 1)
        return (n > 0) & (1 - below < least)

    counts = np.minimum(counts, 30)
    total, chance = np.minimum(counts.sum(1), 60), words * rates.sum()
    single = beyond_chance(counts, words[:, None] * rates).astype(int)
    every = np.where(beyond_chance(total, chance), 1, np.where(total <= chance + np.sqrt(chance), -1, 0))
    none = np.where(total == 0, -1, 0)
    return np.column_stack([single, every, none])


def _shares(given: np.ndarray, post: np.ndarray, weight: np.ndarray, least: float = 0.2) -> np.ndarray:
    """Each voter's weight: voters whose votes go together within a class count as one together."""
    shares = np.ones(given.shape[1])
    for p in (1 - post, post):
        w = p * weight / max(1e-9, (p * weight).sum())
        centred = given - w @ given
        cov = (centred * w[:, None]).T @ centred
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        corr = np.clip(cov / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(corr, 0)
        shares = np.minimum(shares, 1 / (1 + np.where(corr > least, corr, 0).sum(1)))
    return shares


def label_model(given: np.ndarray, prior: float, weight: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of toxic for each row of votes (the last three columns as ``votes`` has them, then the label), and each voter's accuracies P(vote | class) with shape (voter, class, 3)."""
    n, m = given.shape
    one_hot = np.stack([given == v for v in (-1, 0, 1)], axis=2).astype(float)
    post = np.clip(0.5 + 0.25 * (given[:, -3:] @ [1, 1, 2]), 0.001, 0.999)  # all patterns together, none, and the label
    rates, shares = np.zeros((m, 2, 3)), np.ones(m)
    for k in range(rounds):
        for c, p in ((0, 1 - post), (1, post)):
            w = p * weight
            rates[:, c] = (np.einsum("n,nmv->mv", w, one_hot) + 0.1) / (w.sum() + 0.3)
        if k == rounds // 2:  # the classes are told apart by now; correlations within them are estimated once
            shares = _shares(given, post, weight)
        gain = np.log(rates[:, 1]) - np.log(rates[:, 0])
        gain[:, 1] = 0  # abstaining says nothing
        evidence = np.einsum("nmv,mv,m->n", one_hot, gain, shares)
        post = 1 / (1 + np.exp(-np.clip(evidence + math.log(prior / (1 - prior)), -30, 30)))
    return post, rates


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression on soft labels, by Newton's method; the last column is the intercept."""
    scale = np.maximum(x.std(axis=0), 1e-6)
    scale[-1] = 1.0
    z, beta = x / scale, np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + ridge * beta
        hessian = (z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        beta -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta / scale


@dataclass
class ToxicityModel:
    patterns: Patterns
    beta: np.ndarray

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        rows = [self.patterns.counts(t) for t in texts]
        x = features(np.array([r[0] for r in rows]).reshape(len(rows), -1), np.array([r[1] for r in rows], float), self.patterns.rates)
        return 1 / (1 + np.exp(-np.clip(x @ self.beta, -30, 30)))


def _tally(sample: DataFrame) -> DataFrame:
    """(pattern, n): pattern counts over the sample, each text's capped; tasks add up before anything is shuffled."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally: Counter[str] = Counter()
        for batch in batches:
            for text in batch["text"]:
                own = Counter(p for w in words_of(text) for p in beginnings(w))
                tally.update({p: min(n, MOST_PER_TEXT) for p, n in own.items()})
        if tally:  # an empty column of strings has no Arrow form of its own
            yield pd.DataFrame({"pattern": list(tally.keys()), "n": list(tally.values())}, columns=["pattern", "n"]).astype({"n": "int64"})

    return sample.select("text").mapInPandas(count, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


def mine_patterns(toxic: DataFrame, other: DataFrame, most: int = 64, least_count: int = 8, least_ratio: float = 4.0) -> Patterns:
    """The patterns whose rate per word is raised most surely in toxic texts; of nested ones the surest, ``most`` in all.

    Every pattern with ``least_count`` occurrences in toxic texts is tested; only those that pass reach the driver.
    """
    words = F.size(F.split("text", r"\s+"))
    n1, n0 = (max(1, df.agg(F.sum(words)).first()[0] or 0) for df in (toxic, other))
    both = _tally(toxic).where(F.col("n") >= least_count).join(_tally(other).withColumnRenamed("n", "k"), "pattern", "left").na.fill(0, ["k"])
    a, b = F.col("n") + 0.5, F.col("k") + 0.5
    surely = F.log(a / n1) - F.log(b / n0) - 2 * F.sqrt(1 / a + 1 / b) >= math.log(least_ratio) - 1e-9
    seen = both.where(surely).collect()
    return choose_patterns({r.pattern: r.n for r in seen}, {r.pattern: r.k for r in seen}, n1, n0, most, least_ratio)


def choose_patterns(a: dict[str, int], b: dict[str, int], n1: int, n0: int, most: int, least_ratio: float = 4.0) -> Patterns:
    """By falling likelihood ratio, those whose rate is surely raised ``least_ratio`` times; of nested ones the first."""
    scored = []
    for p, n in a.items():
        k = b.get(p, 0)
        ratio = math.log((n + 0.5) / n1) - math.log((k + 0.5) / n0)
        if ratio - 2 * math.sqrt(1 / (n + 0.5) + 1 / (k + 0.5)) >= math.log(least_ratio):
            both = (n + k) / (n1 + n0)
            gain = n * math.log(n / (n1 * both)) + (k * math.log(k / (n0 * both)) if k else 0)
            scored.append((gain, p, (k + 0.25) / n0))
    names: list[str] = []
    rates: list[float] = []
    for _, p, rate in sorted(scored, key=lambda s: (-s[0], s[1][-1] == "$", -len(s[1]), s[1])):
        bare = p.rstrip("$")
        if len(names) < most and not any(bare.startswith(q.rstrip("$")) or q.startswith(bare) for q in names):
            names.append(p)
            rates.append(rate)
    return Patterns(names, np.array(rates))


def _without_copies(sample: DataFrame) -> DataFrame:
    """One document of each group of near copies in the bounded sample: copied words are no evidence of their own."""
    prints = np.sort(sample.select("fp").distinct().toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
    forest, every = simhash.Forest(len(prints)), np.arange(len(prints))
    simhash.trie_join(prints, every, every, 4, forest)
    kept = np.delete(prints, forest.links()[0]).view(np.int64).tolist()
    # as many as the sample has rows at most: broadcast
    rows = sample.join(F.broadcast(sample.sparkSession.createDataFrame([(f,) for f in kept], "fp long")), "fp")
    return rows.groupBy("fp").agg(F.min_by(F.struct("doc_id", "toxic", "text"), "doc_id").alias("r")).select("r.*")


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 3000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on at most ``sample_rows`` labelled documents of either class, the first by hash of doc_id.

    ``labels`` are the rows to learn from; those without doc_id or label are ignored, of several labels of a document the
    greatest counts. With no toxic label the model's score is near 0 for every text.
    """
    spark = docs.sparkSession
    own = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("toxic"))
    known = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r.toxic in (0, 1)}
    pick = lambda c: own.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # at most twice sample_rows ids: broadcast
    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(pick(0).unionByName(pick(1))), "doc_id")
    sample = _without_copies(materialise(simhash.fingerprints(chosen.withColumn("t", F.col("text")), "t").repartition(max(1, spark.sparkContext.defaultParallelism))))
    patterns = mine_patterns(sample.where("toxic = 1"), sample.where("toxic = 0"))
    names, rates = patterns.names, patterns.rates

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = Patterns(names, rates)
        for batch in batches:
            rows = [seen.counts(t) for t in batch["text"]]
            yield pd.DataFrame({"toxic": batch["toxic"], "words": [r[1] for r in rows], "counts": [r[0] for r in rows]})

    rows = sample.mapInPandas(tally, "toxic int, words long, counts array<double>").toPandas()
    n = {c: int((rows["toxic"] == c).sum()) for c in (0, 1)}
    if not n[0] or not n[1] or not names:
        size = features(np.zeros((1, len(names))), np.zeros(1), rates).shape[1]
        return ToxicityModel(patterns, np.r_[np.zeros(size - 1), -6.0])
    counts, words, toxic = np.array(list(rows["counts"])), rows["words"].to_numpy(float), rows["toxic"].to_numpy()
    weight = np.where(toxic == 1, known[1] / n[1], known[0] / n[0])
    weight = weight / weight.mean()
    given = np.column_stack([votes(counts, words, rates), np.where(toxic == 1, 1, -1)])
    posterior, _ = label_model(given, known[1] / (known[0] + known[1]), weight)
    return ToxicityModel(patterns, logistic(features(counts, words, rates), posterior, weight))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """Every row with its score from 0 to 1. Null and empty texts are scored as texts without words; rows are kept as they are."""

    @F.pandas_udf("double")
    def own(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.score(list(batch)))

    return docs.withColumn(out, own(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **columns: str) -> DataFrame:
    """Every row with held_out, score and predicted (1 from ``threshold`` on); learned from labels that aren't held out."""
    doc_id, text = columns.get("doc_id", "doc_id"), columns.get("text", "text")
    model = fit(docs, labels.where(~held_out(doc_id)), doc_id=doc_id, text=text, label=columns.get("label", "toxic"))
    scored = score(docs, model, text).withColumn("held_out", held_out(doc_id))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
