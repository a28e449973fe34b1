"""Quality scores from a sparse ensemble of rules.

Statistics of every whole text are Spark columns. A forest of shallow trees is fitted on labelled rows; every path
from a root to a node below it becomes a rule, a conjunction of thresholds. A logistic model with lasso
penalty weighs the rules, most of which drop out, and what remains is compiled into one column expression
over the statistics: scoring runs where the data is, without a model object.

Learning reads at most about ``SAMPLE`` labelled rows, chosen by a hash of their id; rows of the held-out fold teach
nothing. Labels, language, source and id are never inputs of a score.

Cases: null and empty texts have statistics of zero and get a score like any other. Labels without quality, and
documents without label, are left out of learning. Repeated rows are scored once each. With labels of one class
the score is that class; without any it is 0.5. Extra columns are dropped.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import held_out
from quirelake.plans.lineage import cut_lineage

#: Labelled rows to learn from; trees and their depth; weight of the lasso penalty; score from which a text is good.
SAMPLE, TREES, DEPTH, LASSO, GOOD = 20_000, 12, 3, 0.001, 0.7

#: (statistic, less or equal, threshold)
Condition = tuple[str, bool, float]
Rule = tuple[Condition, ...]

_WORDS = "__words"


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and one double per statistic."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("t")).withColumn(
        _WORDS, F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    )
    n, words = F.length("t"), F.size(_WORDS)
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    return rows.select(
        "doc_id",
        F.log1p(n.cast("double")).alias("log_chars"),
        F.log1p(words.cast("double")).alias("log_words"),
        _share(F.size(F.array_distinct(_WORDS)), words).alias("distinct_words"),
        _share(F.length(F.array_join(_WORDS, "")), words).alias("word_length"),
        _share(count(r"[^\p{L}\p{N}\s.,]"), n).alias("marks"),
        _share(count(r"\p{Lu}"), n).alias("upper"),
        _share(count(r"[.,]"), words).alias("stops"),
        _share(count(r"\p{N}"), n).alias("digits"),
        _share(count(r"\s"), n).alias("spaces"),
        _share(F.size(F.array_distinct(F.split("t", "\n"))), F.size(F.split("t", "\n"))).alias("distinct_lines"),
    )


def _names(stats: DataFrame) -> list[str]:
    return [c for c in stats.columns if c != "doc_id"]


def sample(stats: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """Statistics and ``label`` of about ``limit`` labelled rows outside the held-out fold, by hash of their id."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("label")).where(
        F.col("label").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    n = known.count()
    share = int(min(1.0, limit / max(1, n)) * (1 << 20))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share)
    return stats.join(chosen, "doc_id").drop("doc_id")


def rules_of(model, names: list[str]) -> list[Rule]:
    """Every path of a fitted forest, as conditions simplified to one bound per statistic and side."""
    found: dict[Rule, None] = {}

    def walk(node, path: tuple[Condition, ...]) -> None:
        if path:
            found[_tight(path)] = None
        if node.subtreeDepth():
            split = node.split()
            name, bound = names[split.featureIndex()], float(split.threshold())
            walk(node.leftChild(), (*path, (name, True, bound)))
            walk(node.rightChild(), (*path, (name, False, bound)))

    for tree in model.trees:
        walk(tree._call_java("rootNode"), ())
    return list(found)


def _tight(path: tuple[Condition, ...]) -> Rule:
    bounds: dict[tuple[str, bool], float] = {}
    for name, below, bound in path:
        old = bounds.get((name, below), bound)
        bounds[name, below] = min(old, bound) if below else max(old, bound)
    return tuple(sorted((name, below, bound) for (name, below), bound in bounds.items()))


def holds(rule: Rule) -> Column:
    tests = [F.col(c) <= b if below else F.col(c) > b for c, below, b in rule]
    test = tests[0]
    for t in tests[1:]:
        test = test & t
    return test


class Ensemble:
    """Weighted rules and a constant, compiled to a column by ``score``."""

    def __init__(self, weights: list[tuple[float, Rule]], constant: float = 0.0, fixed: float | None = None):
        self.weights, self.constant, self.fixed = weights, constant, fixed

    def score(self) -> Column:
        if self.fixed is not None:
            return F.lit(self.fixed)
        total = F.lit(self.constant)
        for weight, rule in self.weights:
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> Ensemble:
    """Rules and weights from rows of statistics with ``label``."""
    names = [c for c in rows.columns if c != "label"]
    rows = cut_lineage(rows)
    seen = [r["label"] for r in rows.select("label").distinct().collect()]
    if len(seen) < 2:
        return Ensemble([], fixed=float(seen[0]) if seen else 0.5)
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("label", "features", *names)
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", subsamplingRate=0.5, minInstancesPerNode=5, seed=7
    ).fit(data)
    rules = rules_of(forest, names)
    if not rules:
        return Ensemble([], fixed=float(rows.agg(F.avg("label")).first()[0]))
    ones = [holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)]
    matrix = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(
        rows.select("label", *ones)
    )
    lasso_model = LogisticRegression(
        elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False
    ).fit(matrix.select("label", "features"))
    weights = [(float(w), r) for w, r in zip(lasso_model.coefficients, rules, strict=True) if w]
    return Ensemble(weights, float(lasso_model.intercept))


def scored(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document, learned from ``labels``."""
    stats = cut_lineage(statistics(docs))
    score = fit(sample(stats, labels, limit)).score()
    return stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= GOOD).cast("int")
    )
