"""Sparse rule ensemble for text quality.

Trees are grown on text statistics; every path from a root becomes a
conjunctive rule.  Logistic regression with an L1 penalty chooses and weighs
the rules, and the few that keep a weight are compiled into one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import repeated_words, text_statistics
from .scratch import arrow_batches, stored
from .textkit import blocks, span_hashes, utf8, word_bounds

STATISTICS = (
    "n_words", "mean_word", "upper", "digit", "symbol", "pipe", "bang", "stop", "comma", "wide", "repeated", "distinct", "dup_lines", "words_per_line",
)


@dataclass
class Rule:
    """A conjunction of (statistic, greater than?, bound)."""

    tests: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, bound in self.tests:
            out = out & ((F.col(name) > bound) if above else (F.col(name) <= bound))
        return out


@dataclass
class RuleModel:
    intercept: float
    rules: list[Rule] = field(default_factory=list)

    def score(self) -> Column:
        """The probability of label 1 as a column expression over the statistics."""
        total = F.lit(float(self.intercept))
        for rule in self.rules:
            total = total + F.when(rule.column(), float(rule.weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _share(flags: np.ndarray, offsets: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(of, 1)


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    stats, row, _, _ = text_statistics(data, offsets)
    n_words, chars, symbols, dup, repeated = stats
    starts, ends, where = word_bounds(data, offsets)
    rows = len(offsets) - 1
    owner = np.repeat(np.arange(rows), np.diff(where)).astype(np.uint64)
    words = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    first = np.unique(words ^ (owner * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    distinct = np.bincount(owner[first].astype(np.int64), minlength=rows)
    lines = np.bincount(row, minlength=rows)
    is_ = lambda *b: np.isin(data, b)
    return np.stack([
        n_words, chars / np.maximum(n_words, 1), _share((data >= 65) & (data <= 90), offsets, chars), _share((data >= 48) & (data <= 57), offsets, chars),
        symbols / np.maximum(n_words, 1), _share(is_(124), offsets, n_words), _share(is_(33), offsets, n_words), _share(is_(46), offsets, n_words), _share(is_(44), offsets, n_words),
        _share(data >= 0xC0, offsets, chars), repeated / np.maximum(n_words, 1), distinct / np.maximum(n_words, 1), dup / np.maximum(lines, 1), n_words / np.maximum(lines, 1),
    ]).astype(np.float64)


def _batches(batches):
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        parts = [np.zeros((len(STATISTICS), 0))]
        for first, last in blocks(offsets):
            parts.append(_statistics(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in np.concatenate(parts, axis=1))], names=["id", *STATISTICS])


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the statistics of every row; a null text has those of the empty one."""
    arrow_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(_batches, "id long, " + ", ".join(f"{x} double" for x in STATISTICS))


def held_out(id_col: Column) -> Column:
    """Whether the CRC-32 of the id as text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _paths(node, tests=()):
    """All conjunctions on the way to the nodes below a tree's root."""
    if node.getClass().getSimpleName() != "InternalNode":
        return
    split = node.split()
    name, bound = STATISTICS[split.featureIndex()], float(split.threshold())
    for below, above in ((node.leftChild(), False), (node.rightChild(), True)):
        path = (*tests, (name, above, bound))
        yield path
        yield from _paths(below, path)


def fit_rules(stats: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.003, seed: int = 7) -> RuleModel:
    """Fit on rows with the statistics and ``label`` (0 or 1).

    With no row the score is 0.5 everywhere, with one label only it is near that label.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    n, ones = stats.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if ones in (0, n):
        return RuleModel(float(np.log((ones + 0.5) / (n - ones + 0.5))))
    table = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(stats.withColumn("label", F.col("label").cast("double"))).select("features", "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="onethird").fit(table)
    paths = dict.fromkeys(p for tree in forest.trees for p in _paths(tree._call_java("rootNode")))
    rules = [Rule(p) for p in paths]
    held = stats.select(F.col("label").cast("double").alias("label"), *(r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
    table = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held).select("features", "label")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=40, standardization=False).fit(table)
    for rule, weight in zip(rules, lasso.coefficients.toArray(), strict=True):
        rule.weight = float(weight)
    return RuleModel(float(lasso.intercept), [r for r in rules if r.weight != 0.0])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> RuleModel:
    """Learn from at most ``max_rows`` labelled rows that are not held out.

    The sample takes the smallest hashes of the id, whatever the order of
    the rows.  Null ids and labels are not used.
    """
    spark: SparkSession = docs.sparkSession
    usable = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    sample = stored(usable.orderBy(F.xxhash64("id"), "id", "label").limit(max_rows), "labelled")
    # The sample has max_rows short rows at most: a broadcast of bounded size.
    texts = docs.join(F.broadcast(sample.select(F.col("id").alias(id_col)).distinct()), id_col, "left_semi")
    stats = text_features(texts, id_col, text_col).join(F.broadcast(sample), "id")
    return fit_rules(stored(stats.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")) // 4 or 1), "sample").coalesce(4))


def score_documents(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id (long), ``held_out``, ``score`` and ``predicted`` of every row; null and empty texts are scored too."""
    scored = text_features(docs, id_col, text_col).select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
