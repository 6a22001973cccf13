"""Quality classifier: a sparse ensemble of rules.

Statistics of a text are Spark columns. A forest of shallow trees is fitted to labelled rows, every path from a root to a
node is a rule, a conjunction of bounds on statistics, and a logistic model with a lasso penalty weighs the rules; most
get no weight. The rules that are left are compiled into one column expression, which scores a text without Python.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.llm.common import WORD, packed, unpacked
from gridlore.session import materialise

SAMPLE_ROWS = 20_000  # labelled rows that the model is fitted to at most
FOLDS, HELD_OUT = 3, 1
TREES, DEPTH, SEED = 24, 3, 7
PENALTY = 0.002

# what is counted, as classes of characters
UPPER = "[A-Z]"
SYMBOLS = r"[!#$%&*+/<=>@^_|~{}\[\]\\]"
DIGITS = "[0-9]"
STOPS = "[.,;:?]"


def statistics(text: Column) -> dict[str, Column]:
    """Numbers from 0 on that describe a text; null counts as empty. Each is linear in the length of the text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.lit(1), F.length(text)).cast("double")
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n_words = F.greatest(F.lit(1), F.size(words)).cast("double")

    def share(kind: str) -> Column:
        return F.regexp_count(text, F.lit(kind)) / chars

    return {
        "upper": share(UPPER),
        "symbols": share(SYMBOLS),
        "digits": share(DIGITS),
        "stops": share(STOPS),
        "lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))) / chars,
        "word_length": chars / n_words,
        "words": F.log1p(n_words),
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
    }


def _measured(rows: DataFrame, text: Column) -> DataFrame:
    """Adds the statistics. They are made by a generator of one row, so that no filter or rule computes them again."""
    made = F.struct(*(c.alias(f"_s_{n}") for n, c in statistics(text).items()))
    return rows.select("*", F.explode(F.array(made)).alias("_stats")).select(*rows.columns, "_stats.*")


@dataclass(frozen=True)
class Rule:
    """Bounds on statistics: (name, above, up to), all of which hold."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        holds = F.lit(True)
        for name, low, high in self.bounds:
            c = F.col(f"_s_{name}")
            holds = holds & (c > low if low > -math.inf else F.lit(True)) & (c <= high if high < math.inf else F.lit(True))
        return holds


def rules_of(forest: RandomForestClassificationModel, names: list[str]) -> list[Rule]:
    """Every path from a root to a node, the root left out, read from the nodes of the trees."""
    found: dict[Rule, None] = {}

    def walk(node, path: dict[str, tuple[float, float]]) -> None:
        if path:
            found[Rule(tuple((n, lo, hi) for n, (lo, hi) in sorted(path.items())))] = None
        if node.getClass().getSimpleName() != "InternalNode":
            return
        split = node.split()
        name, at = names[split.featureIndex()], float(split.threshold())
        low, high = path.get(name, (-math.inf, math.inf))
        walk(node.leftChild(), {**path, name: (low, min(high, at))})
        walk(node.rightChild(), {**path, name: (max(low, at), high)})

    for tree in forest.trees:
        walk(tree._call_java("rootNode"), {})
    return list(found)


@dataclass(frozen=True)
class Model:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        """The probability of label 1, from the statistics of a row."""
        z = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit to the labelled rows that are not held out, at most ``sample_rows`` of them, chosen by a hash of the id.

    Rows without id or label are left out; of several labels of an id the larger counts. With labels of one kind only, or
    none, the model has no rule and scores every text by the share of label 1.
    """
    learn = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    learn = learn.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").cast("double").alias("_label"))
    learn = materialise(learn.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows), "labels")
    # the sample has a fixed bound, so that it can be sent to every task
    rows = docs.select("doc_id", "text").join(F.broadcast(learn), F.col("doc_id") == F.col("_id"))
    names = list(statistics(F.lit("")))
    known = materialise(_measured(rows.select("text", "_label"), F.col("text")).drop("text"), "statistics")
    n, ones = known.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0.0))).first()
    if ones in (0, n):
        share = (ones + 1) / (n + 2)
        return Model((), (), math.log(share / (1 - share)))
    columns = [f"_s_{x}" for x in names]
    table = VectorAssembler(inputCols=columns, outputCol="x").transform(known)
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="_label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=5, seed=SEED, featureSubsetStrategy="onethird"
    ).fit(table)
    rules = rules_of(forest, names)
    if not rules:
        return Model((), (), math.log(ones / (n - ones)))
    held = known.select("_label", *(r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="r").transform(held).select("_label", "r")
    lasso = LogisticRegression(featuresCol="r", labelCol="_label", regParam=PENALTY, elasticNetParam=1.0, standardization=False, maxIter=60)
    fitted = lasso.fit(matrix)
    chosen = [(r, float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w]
    return Model(tuple(r for r, _ in chosen), tuple(w for _, w in chosen), float(fitted.intercept))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for every row of ``docs``; empty, null and very long texts are scored too.

    Rows that repeat an id are scored each for itself, and a row without id is not held out. An empty table gives an empty result.
    Other columns are not read.
    """
    rows = _measured(docs.select("doc_id", "text"), F.col("text"))
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model scores at least so high, with all their columns."""
    rows = _measured(packed(docs), F.col("_row.text"))
    return unpacked(rows.filter(model.score() >= least).select("_row"))
