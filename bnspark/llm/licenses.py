"""Licence families of paragraphs, with DataFrame functions and Spark's JVM learners only.

A paragraph is a line; a notice that is wrapped is found line by line.  A sparse multinomial logistic
regression over word 1- and 2-grams is fitted to the texts and phrases of license_texts, whole and in pieces,
against paragraphs of a bounded sample of the corpus and sentences with licence words as the class `unknown`.
Only n-grams with a word that is rare in the whole corpus are features, so a paragraph without any such word has
no feature and a constant score; the others are scored inside their row, and no text is shuffled.  A family
is predicted if the probability that it is not `unknown` reaches a threshold calibrated on all background paragraphs that were not fitted
on.  It counts if templates confirm it: the paragraph holds CONTAINED of the word pairs of one of the family's
phrases, or the family's texts hold CONTAINED of the paragraph's, which has LEAST_PAIRS of them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bnspark.llm.common import drop, materialize
from bnspark.llm.license_texts import NAMES, OTHER, phrases

BACKGROUND_DOCS = 400  # documents, at most, whose paragraphs are fitted on
RARE = 0.01  # share of background paragraphs below which a word is rare
CONTAINED = 0.7
LEAST_PAIRS = 4
LICENCE_LIKE = 0.5  # share of a paragraph's word pairs in templates from which it is no background
LEAST_PROBABILITY = 0.5
FALSE_RATE = 0.001  # of background paragraphs
STEPS = 10_000  # of probabilities, when they are counted
WINDOWS, STRIDE = (10, 5), 3  # words of the pieces of texts that are fitted on
UNKNOWN = "unknown"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs(tokens: Column) -> Column:
    """Neighbouring words; of a single word, that word."""
    n = F.size(tokens) - 1
    both = F.zip_with(F.slice(tokens, 1, F.greatest(n, F.lit(0))), F.slice(tokens, 2, F.greatest(n, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 0, both).otherwise(tokens)


def grams(tokens: Column) -> Column:
    """Words and neighbouring pairs."""
    return F.array_distinct(F.concat(tokens, pairs(tokens)))


def _literal(values: list, kind: str) -> Column:
    """A constant array that the optimizer folds into one literal; values hold no line feed."""
    return F.split(F.lit("\n".join(map(str, values))), "\n").cast(f"array<{kind}>")


def _in(known: list[str]) -> Callable[[Column], Column]:
    """Whether a word is one of many: a look into a hash set that is made once, where functions of arrays make one
    for each row."""
    return lambda w: w.isin(known)


def _json(value: object, kind: str) -> Column:
    """A nested constant, parsed again for each paragraph that is likely enough to be confirmed."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(phrases(), "family string, text string").coalesce(1)


@dataclass(frozen=True)
class Scanner:
    families: list[str]  # by class; UNKNOWN is one of them
    vocabulary: list[str]
    rare: list[str]
    weights: list[float]  # class after class
    bias: list[float]
    threshold: float
    held: dict[str, list[list[str]]]  # word pairs of the phrases, by family

    def classify(self, scored: Column) -> Column:
        """Of structs with `tokens`, structs with the best family but UNKNOWN and the probability of all
        families, that is, of anything but UNKNOWN.

        Each step is a transform of its own: what a step uses twice is then computed once."""
        size, known = len(self.vocabulary), self.families.index(UNKNOWN)
        vocabulary, weights = _literal(self.vocabulary, "string"), _literal(self.weights, "double")
        bias = _literal(self.bias, "double")
        at = F.transform(
            scored,
            lambda s: F.struct(
                s["line"].alias("line"), s["tokens"].alias("tokens"),
                F.transform(F.filter(grams(s["tokens"]), _in(self.vocabulary)), lambda g: F.array_position(vocabulary, g)).alias("at"),
            ),
        )
        classes = F.sequence(F.lit(0), F.lit(len(self.families) - 1))
        logits = F.transform(
            at,
            lambda s: F.struct(
                s["line"].alias("line"), s["tokens"].alias("tokens"),
                F.transform(
                    classes,
                    lambda k: F.aggregate(
                        s["at"], F.element_at(bias, k + 1), lambda a, i: a + F.element_at(weights, (k * size + i).cast("int"))
                    ),
                ).alias("z"),
            ),
        )
        shares = F.transform(
            logits,
            lambda s: F.struct(
                s["line"].alias("line"), s["tokens"].alias("tokens"),
                F.transform(s["z"], lambda z: F.exp(z - F.array_max(s["z"]))).alias("e"),
            ),
        )
        known_at = lambda e: F.transform(e, lambda x, i: F.when(i == known, F.lit(-1.0)).otherwise(x))
        return F.transform(
            shares,
            lambda s: F.struct(
                s["line"].alias("line"), s["tokens"].alias("tokens"),
                F.element_at(
                    _literal(self.families, "string"), F.array_position(known_at(s["e"]), F.array_max(known_at(s["e"]))).cast("int")
                ).alias("family"),
                (F.lit(1.0) - F.element_at(s["e"], known + 1) / F.aggregate(s["e"], F.lit(0.0), lambda a, x: a + x)).alias("probability"),
            ),
        )

    def contained(self, family: Column, tokens: Column) -> Column:
        """The larger of two shares: of a phrase's word pairs that tokens hold, the best of the family's
        phrases; and of the pairs of tokens, LEAST_PAIRS of them at least, that the family's phrases hold."""
        own = F.array_distinct(pairs(tokens))
        kind = "array<struct<f:string,p:array<array<string>>,all:array<string>>>"
        known = _json([{"f": f, "p": p, "all": sorted({x for y in p for x in y})} for f, p in self.held.items()], kind)
        mine = F.filter(known, lambda t: t["f"] == family)[0]
        whole = F.array_max(F.transform(mine["p"], lambda p: F.size(F.array_intersect(p, own)) / F.size(p)))
        part = F.when(F.size(own) >= LEAST_PAIRS, F.size(F.array_intersect(own, mine["all"])) / F.size(own)).otherwise(F.lit(0.0))
        return F.greatest(whole, part)

    def candidates(self, text: Column) -> Column:
        """Paragraphs with a rare word, as (line, tokens); all others have no feature."""
        lines = F.transform(F.split(text, "\n"), lambda p, i: F.struct(i.alias("line"), words(p).alias("tokens")))
        return F.filter(lines, lambda s: F.exists(s["tokens"], _in(self.rare)))


def _held(spark: SparkSession) -> dict[str, list[list[str]]]:
    rows = _templates(spark).select("family", F.array_distinct(pairs(words(F.col("text")))).alias("p")).distinct().collect()
    return {f: sorted(r["p"] for r in rows if r["family"] == f) for f in sorted({r["family"] for r in rows})}


@dataclass(frozen=True)
class Marks:
    """Word pairs of all phrases, and those of the names of licences."""

    known: list[str]
    names: list[str]

    @staticmethod
    def of(spark: SparkSession, held: dict[str, list[list[str]]]) -> Marks:
        named = spark.createDataFrame([(n,) for names in NAMES.values() for n in names if len(n.split()) > 1], "text string").coalesce(1)
        rows = named.select(F.explode(pairs(words(F.col("text")))).alias("p")).distinct().collect()
        return Marks(sorted({x for ps in held.values() for p in ps for x in p}), sorted(r["p"] for r in rows if " " in r["p"]))

    def found(self, tokens: Column) -> Column:
        """Whether a paragraph is like a licence or names one, and so is no background."""

        def marked(own: Column) -> Column:
            shared = F.size(F.array_distinct(F.filter(own, _in(self.known))))
            return (shared >= LICENCE_LIKE * F.size(own)) & (shared > 0) | F.exists(own, _in(self.names))

        return F.transform(F.array(pairs(tokens)), marked)[0]  # so pairs are made once


def _sampled(docs: DataFrame, bound: int) -> DataFrame:
    return docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def _background(docs: DataFrame, bound: int) -> DataFrame:
    """Different paragraphs of at most `bound` documents (those with the smallest hash of their id)."""
    some = docs.join(F.broadcast(_sampled(docs, bound)), "doc_id", "left_semi")
    lines = some.select(F.explode(F.split("text", "\n")).alias("text")).where("trim(text) <> ''").distinct()
    return lines.withColumn("tokens", words(F.col("text")))


def _paragraphs(docs: DataFrame) -> DataFrame:
    """Every paragraph of every document, repeats included: doc_id, text, tokens."""
    each = F.transform(F.split("text", "\n"), lambda p: F.struct(p.alias("text"), words(p).alias("tokens")))
    # Words are made before rows are: a filter over them would else make them again for each place that uses them.
    lines = docs.select("doc_id", F.explode(each).alias("p")).select("doc_id", "p.text", "p.tokens")
    return lines.where("trim(text) <> ''")


def rare_words(docs: DataFrame, marks: Marks) -> list[str]:
    """Words of the templates that less than RARE of all background paragraphs hold.  What leaves a task is
    a count for each word of a template, and one of its paragraphs."""
    mine = _templates(docs.sparkSession).select(F.explode(words(F.col("text"))).alias("w")).distinct()
    used = sorted(r[0] for r in mine.collect())  # of the templates alone
    seen = _paragraphs(docs).select("tokens", F.array_distinct(F.filter("tokens", _in(used))).alias("w"))
    background = seen.where((F.size("w") < 2) | ~marks.found(F.col("tokens")))
    often = {r["w"]: r["count"] for r in background.select(F.explode(F.array_append("w", "\n")).alias("w")).groupBy("w").count().collect()}
    n = max(often.get("\n", 0), 1)  # the line feed stands for the paragraph
    return [w for w in used if often.get(w, 0) < RARE * n]


def calibrated(docs: DataFrame, fitted: Scanner, marks: Marks, sampled: list[int]) -> float:
    """The probability that FALSE_RATE of all background paragraphs reach, but those that were fitted on
    (half of the sampled documents').  Scores are counted in steps; paragraphs without a feature are scored once."""
    split = F.pmod(F.xxhash64(F.lit(7), F.col("text")), F.lit(2))
    was_fitted = F.coalesce(F.col("doc_id").isin(sampled), F.lit(False)) & (split == 0)
    lines = _paragraphs(docs).where(~was_fitted)
    none = F.array().cast("array<string>")
    tokens = F.when(F.exists("tokens", _in(fitted.rare)), F.col("tokens")).otherwise(none)
    counted = lines.select(tokens.alias("tokens"))
    total = counted.groupBy((F.size("tokens") > 0).alias("scored")).count().collect()
    plain = sum(r["count"] for r in total if not r["scored"])
    some = counted.where((F.size("tokens") > 0) & ~marks.found(F.col("tokens")))
    one = docs.sparkSession.range(1).select(none.alias("tokens"))
    score = lambda df: df.select(fitted.classify(F.array(F.struct(F.lit(0).alias("line"), "tokens")))[0]["probability"].alias("p"))
    steps = {r["s"]: r["count"] for r in score(some).groupBy(F.floor(F.col("p") * STEPS).alias("s")).count().collect()}
    flat = int(score(one).first()["p"] * STEPS)
    steps[flat] = steps.get(flat, 0) + plain
    over = FALSE_RATE * sum(steps.values())
    above = 0
    for s in sorted(steps, reverse=True):
        above += steps[s]
        if above > over:
            return s / STEPS
    return 0.0


def train(docs: DataFrame, bound: int = BACKGROUND_DOCS) -> Scanner:
    spark = docs.sparkSession
    held = _held(spark)
    marks = Marks.of(spark, held)
    families = [*held, UNKNOWN]
    paragraphs = materialize(_background(docs, bound).where(~marks.found(F.col("tokens"))).select("text", "tokens"), "background")
    rare = rare_words(docs, marks)
    mine = _templates(spark).select(words(F.col("text")).alias("tokens"))
    every = [r[0] for r in mine.select(F.explode(grams(F.col("tokens")))).distinct().collect()]  # of the templates alone
    vocabulary = sorted(g for g in every if set(g.split(" ")) & set(rare))
    # Phrases whole, between other words, without one of their words, and in pieces.
    whole = _templates(spark).select("family", words(F.col("text")).alias("t"))
    place = whole.where(F.size("t") > 6).select("family", "t", F.explode(F.sequence(F.lit(1), F.size("t"), F.lit(STRIDE))).alias("i"))
    dropped = place.select("family", F.concat(F.slice("t", 1, F.col("i") - 1), F.slice("t", F.col("i") + 1, F.size("t"))).alias("tokens"))
    sizes = F.explode(F.array(*map(F.lit, WINDOWS)))
    pieces = place.where(F.size("t") >= F.col("i") + 4).withColumn("n", sizes).select("family", F.slice("t", F.col("i"), F.col("n")).alias("tokens"))
    inside = whole.select("family", F.concat(F.array(*map(F.lit, ("see", "here"))), "t", F.array(F.lit("more"))).alias("tokens"))
    good = dropped.unionByName(pieces).unionByName(inside).unionByName(whole.select("family", F.col("t").alias("tokens")))
    others = spark.createDataFrame([(t,) for t in OTHER], "text string").coalesce(1).select(words(F.col("text")).alias("tokens"))
    split = F.pmod(F.xxhash64(F.lit(7), F.col("text")), F.lit(2))
    bad = paragraphs.where(split == 0).select("tokens").unionByName(others).withColumn("family", F.lit(UNKNOWN))
    label = F.array_position(_literal(families, "string"), F.col("family")).cast("double") - 1
    rows = good.unionByName(bad.select("family", "tokens")).select(label.alias("label"), grams(F.col("tokens")).alias("grams"))
    model_rows = materialize(rows, "fit")
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    model = LogisticRegression(family="multinomial", regParam=5e-5, elasticNetParam=0.5, maxIter=100).fit(
        counter.transform(model_rows.coalesce(1)).select("label", "features")  # a few thousand rows
    )
    weights = [float(x) for x in model.coefficientMatrix.toArray().ravel()]
    fitted = Scanner(families, vocabulary, rare, weights, [float(b) for b in model.interceptVector.toArray()], 1.0, held)
    edge = calibrated(docs, fitted, marks, [r[0] for r in _sampled(docs, bound).collect()])  # at most `bound` ids
    drop(paragraphs)
    drop(model_rows)
    return Scanner(families, vocabulary, rare, weights, fitted.bias, max(LEAST_PROBABILITY, edge), held)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = BACKGROUND_DOCS) -> DataFrame:
    """One row for each row of docs, repeats included: doc_id, n_paragraphs (lines that are not blank),
    n_licenses (paragraphs with a confirmed family), families (sorted, distinct), license (that with the
    highest probability, the first in case of ties; null if there is none), probability (its) and
    found (array of line, family, probability).  Null texts count as empty and have no paragraph; a null
    doc_id stays null.  An empty table gives no rows; other columns are not read."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    return scan(rows, train(rows, bound))


def scan(rows: DataFrame, scanner: Scanner) -> DataFrame:
    """What license_scan() gives for rows (doc_id, text), by a scanner that was fitted before."""
    seen = rows.select(
        "doc_id",
        F.size(F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")).cast("long").alias("n_paragraphs"),
        scanner.candidates(F.col("text")).alias("c"),
    )
    scored = seen.select("doc_id", "n_paragraphs", scanner.classify(F.col("c")).alias("s"))
    likely = scored.withColumn("s", F.filter("s", lambda x: x["probability"] >= scanner.threshold))
    sure = F.filter(F.col("s"), lambda x: scanner.contained(x["family"], x["tokens"]) >= CONTAINED)
    kept = likely.select(
        "doc_id", "n_paragraphs", F.transform(sure, lambda x: F.struct(x["line"].alias("line"), x["family"].alias("family"), x["probability"].alias("probability"))).alias("found"),
    )
    best = F.array_sort(F.transform("found", lambda x: F.struct((-x["probability"]).alias("p"), x["line"].alias("l"), x["family"].alias("f"))))
    first = F.get(best, F.lit(0))
    return kept.select(
        "doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_licenses"),
        F.array_sort(F.array_distinct(F.col("found")["family"])).alias("families"),
        first["f"].alias("license"), (-first["p"]).alias("probability"), "found",
    )
