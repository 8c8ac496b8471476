"""Soft-membership mixing to target weights, with DataFrame functions and Spark's JVM learners only.

A sparse multinomial logistic regression, fitted to a bounded sample of the labelled table, gives each
document a posterior over the domains `good`, `poor` (quality 0) and `toxic` (toxic 1).  Its words count
in each domain by that posterior.  Rates r_d >= 0, the copies of a document in the mixture, minimise

    (A r - t)' M (A r - t),   (A r)_k = sum_d r_d n_d p_dk / N,   M = (sum_d n_d p_d p_d' / N)^-1

by projected gradient from r = 1, t being the target share of each domain's words.  A step changes a
rate by a product of its posterior and K numbers, the same for all, so a rate is a function of the
posterior and the steps so far: each round is one pass that sums some numbers and nothing else moves.  The
gradient is scaled by the same M over the documents whose rate isn't zero, so without any at zero a step is exact,
and a few rounds do; each PLAIN-th round takes the M above, as rates at zero must be able to rise again.  Rounds go
on until the totals stand still; what is left between totals and targets, where no rates can meet them, is
reported.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bnspark.llm.common import drop, materialize

DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.90, 0.06, 0.04)
SAMPLE = 4_000  # labelled documents, at most, that are fitted on
VOCABULARY, LEAST_DOCS = 20_000, 5
CLOSE, MOST_ROUNDS, PLAIN, STALL = 1e-6, 60, 6, 8
SHARES = 16
PARTING, MARKS = "\n\r\t.,", "!?%#*&$|"
SHARE = "\x01"  # starts the features that are no words


def words(text: Column) -> Column:
    """Words as they are written, parted by white space, full stops and commas; each of MARKS is a word.
    Null has none.  Plain replacements and one split by a blank: no step works row by row on words."""
    flat = F.coalesce(text, F.lit(""))
    for c in PARTING:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    for c in MARKS:
        flat = F.replace(flat, F.lit(c), F.lit(f" {c} "))
    return F.array_remove(F.split(flat, " "), "")


def with_features(rows: DataFrame) -> DataFrame:
    """rows (text and others) with n_tokens and features, the different words of the whole text and the
    share of different ones among all in steps, in place of the text."""
    rest = [c for c in rows.columns if c != "text"]
    split = rows.select(*rest, words(F.col("text")).alias("_w"))
    split = split.select(*rest, F.size("_w").cast("long").alias("n_tokens"), F.array_distinct("_w").alias("_d"))
    share = F.floor(F.size("_d") / F.greatest(F.col("n_tokens"), F.lit(1)) * (SHARES - 1))
    return split.select(*rest, "n_tokens", F.array_append("_d", F.concat(F.lit(SHARE), share)).alias("features"))


@dataclass(frozen=True)
class Posterior:
    """The fitted models, or, where there is nothing to tell apart, the domains that may be."""

    words: CountVectorizerModel | None
    domains: LogisticRegressionModel | None
    possible: list[bool]

    def of(self, rows: DataFrame) -> DataFrame:
        """rows with p, the array of the domains' posteriors, in place of features."""
        rest = [F.col(f"`{c}`") for c in rows.columns if c != "features"]
        if self.words is None or self.domains is None:
            share = 1.0 / sum(self.possible)
            return rows.select(*rest, F.array(*[F.lit(share if x else 0.0) for x in self.possible]).alias("p"))
        scored = self.domains.transform(self.words.transform(rows))
        p = vector_to_array("_probability")
        known = [F.get(p, F.lit(k)) if x else F.lit(0.0) for k, x in enumerate(self.possible)]
        total = sum(known[1:], known[0])
        return scored.select(*rest, F.array(*[x / total for x in known]).alias("p"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Posterior:
    """Fit to the labelled documents with the smallest hashes of their ids, at most `sample`; of labels that
    differ for a document the worse counts, and of texts that share an id the least.  A domain without any label
    is not possible, and without labels all domains are as likely."""
    named = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id")
    label = F.when(F.max("toxic") == 1, 2.0).when(F.min("quality") == 0, 1.0).otherwise(0.0)
    some = materialize(named.agg(label.alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labels")
    rows = docs.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most `sample` labels
    rows = materialize(with_features(rows.select("label", "text")), "fit")
    seen = {int(r[0]): r[1] for r in rows.groupBy("label").count().collect()}
    possible = [not seen or k in seen for k in range(len(DOMAINS))]
    if len(seen) < 2:
        drop(rows)
        drop(some)
        return Posterior(None, None, possible)
    least = min(LEAST_DOCS, max(1, sum(seen.values()) // 50))  # fewer in small samples
    counted = CountVectorizer(inputCol="features", outputCol="_x", minDF=least, vocabSize=VOCABULARY, binary=True).fit(rows)
    learner = LogisticRegression(
        featuresCol="_x", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_domain", family="multinomial",
        regParam=2e-3, elasticNetParam=1.0, maxIter=80,
    )
    fitted = learner.fit(counted.transform(rows.coalesce(1)).select("label", "_x"))  # at most `sample` rows
    drop(rows)
    drop(some)
    return Posterior(counted, fitted, possible)


def rate_of(p: Column, steps: Sequence[Sequence[float]], most_rate: float | None = None) -> Column:
    """The rate of a document with posteriors p after the steps so far."""
    if not steps:
        return F.lit(1.0)
    given = F.array(*[F.array(*[F.lit(float(x)) for x in s]) for s in steps])  # the optimizer makes one literal of it
    move = lambda g: sum((p[k] * g[k] for k in range(1, len(steps[0]))), p[0] * g[0])
    bound = (lambda r: r) if most_rate is None else lambda r: F.least(F.lit(float(most_rate)), r)
    return F.aggregate(given, F.lit(1.0), lambda r, g: bound(F.greatest(F.lit(0.0), r - move(g))))


def fit_rates(members: DataFrame, targets: Sequence[float], most_rate: float | None = None) -> tuple[list[list[float]], list[float]]:
    """Steps of the projected gradient over members (n_tokens, p), and the gaps that are left: for each domain its
    share of all words less its target.  Targets need not sum to one.  Rounds end when the shares meet the targets
    to CLOSE, or STALL rounds have not lessened the squares by a hundredth, or after MOST_ROUNDS; the steps to the
    best round are returned, and the gaps say what it leaves.  Without words there are no steps."""
    k = len(targets)
    square = [(a, b) for a in range(k) for b in range(a, k)]
    p, n = [F.col("p")[a] for a in range(k)], F.col("n_tokens").cast("double")
    steps: list[list[float]] = []
    best: tuple[float, int, list[float]] | None = None
    scale, since = np.zeros((k, k)), 0
    for rounds in range(MOST_ROUNDS):
        rated = members.withColumn("_rate", rate_of(F.col("p"), steps, most_rate))
        free = F.when(F.col("_rate") > 0, n).otherwise(F.lit(0.0))
        row = rated.agg(F.sum(n), *[F.sum(n * F.col("_rate") * x) for x in p], *[F.sum(free * p[a] * p[b]) for a, b in square]).first()
        if not row[0]:
            return [], [-float(t) for t in targets]
        got = np.array(row[1 : k + 1], float) / row[0]
        h = np.zeros((k, k))
        for (a, b), x in zip(square, row[k + 1 :], strict=True):
            h[a, b] = h[b, a] = x / row[0]
        m = np.linalg.inv(h + 1e-9 * np.eye(k))
        scale = scale if rounds else m
        gap = got - np.array(targets)
        value = float(gap @ scale @ gap)
        since = 0 if best is None or value < 0.99 * best[0] else since + 1
        if best is None or value < best[0]:
            best = value, len(steps), [float(x) for x in gap]
        if np.abs(gap).max() < CLOSE or since >= STALL:
            break
        steps.append([float(x) for x in (scale if rounds % PLAIN == 0 else m) @ gap])
    return steps[: best[1]], best[2]


def _members_of(rows: DataFrame, posterior: Posterior) -> DataFrame:
    return materialize(posterior.of(with_features(rows)), "members")


def mixing_rates(
    docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, id_col: str = "doc_id", text_col: str = "text",
    most_rate: float | None = None,
) -> DataFrame:
    """One row for each row of docs, repeats included: doc_id, n_tokens, the posteriors p_good, p_poor and
    p_toxic, rate, its copies in the mixture, and gaps, what each domain's share misses its target by, the same
    in all rows.  Rates have no bound but most_rate, if given.  Null and blank texts have no words and take part
    in no total, but get the rate of their posterior.  A null doc_id has no label and stays null.  An empty
    table gives no rows; other columns are not read."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    members = _members_of(rows, train(rows, labels))
    steps, gaps = fit_rates(members, targets, most_rate)
    return members.select(
        "doc_id", "n_tokens", *[F.col("p")[k].alias("p_" + name) for k, name in enumerate(DOMAINS)],
        rate_of(F.col("p"), steps, most_rate).alias("rate"), F.array(*map(F.lit, gaps)).alias("gaps"),
    )


def mixed(docs: DataFrame, labels: DataFrame, targets: Sequence[float] = TARGETS, most_rate: float | None = None) -> DataFrame:
    """The rows of docs, with all their columns, each as often as its rate says: its whole part, and once
    more where a hash of doc_id and text falls below the rest.  Posteriors are worked out once and written with
    the rows; the rounds read nothing but them.  Null texts have the rate of a text without words, rows with a
    null doc_id have no label, rows that repeat are mixed each for itself and alike, an empty table gives no
    rows, and no name of another column matters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    members = _members_of(whole, train(rows, labels))
    steps, _ = fit_rates(members.select("n_tokens", "p"), targets, most_rate)
    own = members.select("row", rate_of(F.col("p"), steps, most_rate).alias("_r"))
    part = F.pmod(F.xxhash64(F.lit(8), F.col("row.doc_id"), F.col("row.text")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor(F.col("_r") + part).cast("int")
    copies = own.select("row", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    return copies.select(*[F.col("row")[c].alias(c) for c in docs.columns])
