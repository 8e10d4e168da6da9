"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics are computed once per text. On a bounded sample of labelled rows a small random forest
of shallow trees is grown; every path from a root is a conjunction of threshold tests, hence a
candidate rule. A logistic regression with an L1 penalty over the rules' indicators weighs them,
most to zero. The rules that keep a weight are compiled into one Spark column expression over
the statistics, so scoring is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import staged, text_slices
from tapeloom.llm.features import Text

#: Statistics, all from the text alone.
STATISTICS = {
    "words": lambda t: math.log1p(t.n_words),
    "word_length": lambda t: t.word_chars / max(1, t.n_words),
    "symbols": lambda t: t.n_symbols / max(1, t.n_words),
    "shouts": lambda t: t.n_shouts / max(1, t.n_words),
    "capitals": lambda t: t.n_capitals / max(1, t.n_words),
    "lettered": lambda t: t.n_lettered / max(1, t.n_words),
    "stutters": lambda t: t.n_stutters / max(1, t.n_words),
    "repeats": lambda t: t.n_repeat_words / max(1, t.n_words),
    "distinct": lambda t: t.n_distinct_words / math.sqrt(max(1, t.n_words)),
    "digits": lambda t: t.n_digits / max(1, t.n_words),
    "dup_lines": lambda t: t.n_dup_lines / max(1, len(t.lines)),
    "ended_lines": lambda t: t.n_stops / max(1, len(t.lines)),
    "line_words": lambda t: math.log1p(t.n_words / max(1, len(t.lines))),
}


def text_statistics(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``docs``, by default without its text, with a double per statistic (named s_..)."""
    others = [c for c in docs.columns if keep_text or c != "text"]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            texts = [Text(t) for t in batch.column("text").to_pylist()]
            values = [pa.array([float(f(t)) for t in texts], pa.float64()) for f in STATISTICS.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), *values], [*others, *(f"s_{s}" for s in STATISTICS)])

    kinds = [f"{c} {docs.schema[c].dataType.simpleString()}" for c in others] + [f"s_{s} double" for s in STATISTICS]
    return docs.mapInArrow(measured, ", ".join(kinds))


class Test(NamedTuple):
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(f"s_{self.statistic}")
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Test, ...]


def rule_column(rule: Rule) -> Column:
    out = rule[0].column()
    for test in rule[1:]:
        out = out & test.column()
    return out


def tree_rules(forest) -> list[Rule]:
    """Every path from a root to a node below it as a rule; tests on one side of one statistic merge
    into the tightest."""
    names, found = list(STATISTICS), {}

    def walk(node, path: dict) -> None:
        if path:
            rule = tuple(sorted(Test(names[f], above, t) for (f, above), t in path.items()))
            found.setdefault(rule)
        if node.numDescendants() == 0:
            return
        split = node.split()
        f, t = split.featureIndex(), float(split.threshold())
        for child, above in ((node.leftChild(), False), (node.rightChild(), True)):
            old = path.get((f, above), t)
            walk(child, {**path, (f, above): max(old, t) if above else min(old, t)})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


class RuleEnsemble(NamedTuple):
    intercept: float
    rules: list[tuple[float, Rule]]

    def score(self) -> Column:
        """Probability of label 1 as an expression over the statistics."""
        total = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            total = total + F.when(rule_column(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit_rules(labelled: DataFrame, trees: int = 16, depth: int = 3, penalty: float = 0.002, seed: int = 11) -> RuleEnsemble:
    """An ensemble from rows with statistics and ``label`` (0 or 1). Without both labels: their share
    (a half without rows) as a constant."""
    told = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    if told.ones in (0, told.n):
        share = (told.ones + 1) / (told.n + 2)
        return RuleEnsemble(math.log(share / (1 - share)), [])
    rows = labelled.select("label", array_to_vector(F.array(*[f"s_{s}" for s in STATISTICS])).alias("features"), *[f"s_{s}" for s in STATISTICS])
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="onethird").fit(rows.select("label", "features"))
    rules = tree_rules(forest)
    fired = rows.select("label", array_to_vector(F.array(*[rule_column(r).cast("double") for r in rules])).alias("features"))
    lasso = LogisticRegression(regParam=penalty, elasticNetParam=1.0, standardization=False, maxIter=60).fit(fired)
    weights = lasso.coefficients.toArray()
    return RuleEnsemble(float(lasso.intercept), [(float(w), r) for w, r in zip(weights, rules) if w != 0.0])


def learn_quality(measured: DataFrame, labels: DataFrame, held_out: Column, most_rows: int = 20_000, **fit) -> RuleEnsemble:
    """Fit on at most ``most_rows`` labelled rows of ``measured`` (doc_id, statistics) outside the held-out
    fold, chosen by a hash of doc_id; labels is (doc_id, quality), nulls are left out."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").alias("label")).filter("label in (0, 1)")
    rows = measured.filter(~held_out).join(known, "doc_id")
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).drop("doc_id")
    return fit_rules(staged(sample, "labelled"), **fit)


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, most_rows: int = 20_000, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs`` (doc_id, text).

    ``held_out`` is an expression over doc_id. A null or empty text is scored by its statistics, all of
    them 0; a null doc_id has no label but a score; documents with contradicting labels teach
    nothing; repeated rows give repeated results, an empty table an empty one. Texts of any length are measured
    whole, one at a time. Columns other than the text never enter a score.
    """
    measured = staged(text_statistics(docs.select("doc_id", "text")), "statistics")
    model = learn_quality(measured, labels, held_out, most_rows, **fit)
    scored = measured.select("doc_id", held_out.alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_predicted(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, most_rows: int = 20_000, **fit) -> DataFrame:
    """The rows of ``docs``, all columns, whose score reaches ``threshold``: texts are measured on the way
    through, so none is shuffled. Columns may have any name: they are renamed on the way."""
    known = labels.select("doc_id").distinct()
    taught = docs.select("doc_id", "text").join(known, "doc_id", "left_semi").filter(~held_out)
    model = learn_quality(staged(text_statistics(taught), "statistics"), labels, held_out, most_rows, **fit)
    names = ["text" if c == "text" else f"d{k}" for k, c in enumerate(docs.columns)]
    measured = text_statistics(docs.toDF(*names), keep_text=True)
    return measured.filter(model.score() >= threshold).select(*names).toDF(*docs.columns)
