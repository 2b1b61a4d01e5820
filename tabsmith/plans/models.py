"""Candidate models on ``pyspark.ml`` (M1-M10, E7 in ML form).

Tabular models read the vectors of ``preprocess``: the linear ones the scaled and one-hot form, the
boosted trees the form with ordinal codes.  The reference's boosted-tree libraries are replaced by ``pyspark.ml``
trees with the same budget (trees, learning rate, depth, column sampling) under the names they are asked for
by; scores are not expected to equal those libraries'.  With ``growth="family"`` lightgbm's trees grow leaf-wise and
catboost's symmetrically (``boosting``).  Budgets are parameters with fixed defaults: no
parameter follows the size of the data.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import text as tx
from ..session import ship_package
from . import boosting as bo
from .preprocess import LINEAR, TREE

log = logging.getLogger(__name__)

# Preset budgets of the reference.
TREES = 120
LEARNING_RATE = 0.07
COLSAMPLE = "0.8"
LOGREG_MAX_ITER = 250
TFIDF_LOGREG_MAX_ITER = 500
VOCABULARY = 5_000
DEPTH = {"lightgbm": 5, "xgboost": 4, "catboost": 5}
ROW_SAMPLE = {"xgboost": 0.8}
SEED = 42
# Histogram memory of one pass over the data: a tree level of these depths fits in one job.
HISTOGRAM_MB = 512

MAX_BINS = 64
# Up to this many rows pyspark.ml takes the bounds of its bins from every row, beyond it from a sample of this size.  Larger
# training sides are binned by bounds from all rows and merged (``MergedTrees``).
MERGE_ROWS = 10_000
# Merged rows of a task.
MERGED_MIN, MERGED_MAX = 20_000, 100_000

# Tree growth: level by level in pyspark.ml (faster: its job per level is the cheaper one), or as the family defines it.
LEVEL, FAMILY = "level", "family"
# The families' public defaults beside the presets' budgets.
FAMILY_GROWTH = {
    "lightgbm": bo.Boosting(growth=bo.LEAF, leaves=31, min_rows=20, min_hessian=1e-3, l2=0.0, columns=0.8),
    "catboost": bo.Boosting(growth=bo.SYMMETRIC, depth=5, min_rows=1, l2=3.0),
}

TEXT = "tfidf_linear"
KNOWN = {"logistic_regression", "linear_regression", TEXT} | {f"{f}_{kind}" for f in DEPTH for kind in ("classifier", "regressor")}

FEATURES = "features"
LABEL = "label"
BINS, ROWS = "_bins", "_rows"


def check_candidate(name: str) -> None:
    """Unknown names fail before any job starts."""
    if name not in KNOWN:
        raise ValueError(f"Unsupported candidate: {name}")


@dataclass
class FamilyTrees:
    """Leaf-wise or symmetric boosted trees with an estimator's ``fit``; more than two classes are fitted one against the rest."""

    params: bo.Boosting
    n_classes: int = 2

    def fit(self, df: DataFrame):
        if self.n_classes <= 2:
            return bo.fit(df, self.params, TREE, LABEL)
        return OneAgainstRest([bo.fit(df.withColumn(LABEL, (F.col(LABEL) == c).cast("double")), self.params, TREE, LABEL) for c in range(self.n_classes)])


@dataclass
class OneAgainstRest:
    models: list[bo.BoostedModel]

    def transform(self, df: DataFrame) -> DataFrame:
        """The class of the highest probability, the first one on ties."""
        names = [f"_p{c}" for c in range(len(self.models))]
        for name, model in zip(names, self.models):
            df = model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("probability", "prediction")
        scores = F.array(*names)
        return df.withColumn("prediction", (F.array_position(scores, F.array_max(scores)) - 1).cast("double")).drop(*names)


@dataclass
class MergedTrees:
    """``pyspark.ml`` boosted trees fitted on the distinct binned rows, each weighted by the rows it stands for.

    A histogram tree sees nothing of a row but its bins: rows of equal bins share every leaf and every score, and a split's
    sums need only their number and mean target (for classes: their number by class).  So rows are binned by bounds from all rows
    and merged once, and the passes of the trees, one a level, go over the merged rows.
    """

    trees: GBTRegressor | GBTClassifier | OneVsRest
    classification: bool

    def merged(self, df: DataFrame, edges: list[np.ndarray]) -> DataFrame:
        rows = df.select(bo.bin_column(TREE, edges).alias(BINS), F.col(LABEL).cast("double").alias(LABEL))
        n = F.count(F.lit(1)).cast("double").alias(ROWS)
        if self.classification:
            return rows.groupBy(BINS, LABEL).agg(n).select(array_to_vector(BINS).alias(BINS), LABEL, ROWS)
        return rows.groupBy(BINS).agg(n, F.avg(LABEL).alias(LABEL)).select(array_to_vector(BINS).alias(BINS), LABEL, ROWS)

    def fit(self, df: DataFrame) -> BinnedModel:
        ship_package(df.sparkSession)
        edges = bo.tree_edges(df, TREE, MAX_BINS)
        found = self.merged(df, edges).persist(StorageLevel.MEMORY_AND_DISK)
        n = found.count()
        log.info("%d merged rows, %s bins", n, [len(e) + 1 for e in edges])
        # a job a level: few rows in few tasks, many in tasks of a stated size
        parts = max(min(df.sparkSession.sparkContext.defaultParallelism, -(-n // MERGED_MIN)), -(-n // MERGED_MAX))
        packed = found.repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
        inner = self.trees.getClassifier() if isinstance(self.trees, OneVsRest) else self.trees
        # no feature has more than MAX_BINS bins; the square of this one is how many rows are looked at for their bounds: all
        inner.setMaxBins(max(MAX_BINS, math.isqrt(n) + 1))
        try:
            return BinnedModel(self.trees.fit(packed), edges)
        finally:
            packed.unpersist()
            found.unpersist()


@dataclass
class BinnedModel:
    """A model of ``MergedTrees``: rows are binned by its bounds before they are scored."""

    model: Any
    edges: list[np.ndarray]

    def transform(self, df: DataFrame) -> DataFrame:
        ship_package(df.sparkSession)
        return self.model.transform(df.withColumn(BINS, array_to_vector(bo.bin_column(TREE, self.edges)))).drop(BINS)


def estimator(name: str, task_type: str, *, n_train: int, n_classes: int = 2, trees: int = TREES, growth: str = LEVEL):
    """The unfitted model of a candidate; it reads ``label`` (class index or target value) and its own features column.

    ``growth="family"`` grows the trees of lightgbm leaf-wise and those of catboost symmetrically.
    """
    check_candidate(name)
    if growth not in (LEVEL, FAMILY):
        raise ValueError(f"unsupported growth {growth!r}")
    classification = task_type != "regression"
    family = name.split("_")[0]
    if family not in DEPTH:
        features = FEATURES if name == TEXT else LINEAR
        if name == "linear_regression" or not classification:
            return LinearRegression(featuresCol=features, labelCol=LABEL, regParam=0.0, solver="auto")
        # C = 1 in the reference's objective == regParam 1/n in Spark's averaged loss
        rounds = TFIDF_LOGREG_MAX_ITER if name == TEXT else LOGREG_MAX_ITER
        return LogisticRegression(
            featuresCol=features, labelCol=LABEL, maxIter=rounds, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False
        )
    if growth == FAMILY and family in FAMILY_GROWTH:
        return FamilyTrees(replace(FAMILY_GROWTH[family], trees=trees, rate=LEARNING_RATE, seed=SEED, logistic=classification), n_classes if classification else 0)
    # trees that draw rows of their own (ROW_SAMPLE) need the rows one by one
    merge = n_train > MERGE_ROWS and family not in ROW_SAMPLE
    columns = dict(featuresCol=BINS, labelCol=LABEL, weightCol=ROWS) if merge else dict(featuresCol=TREE, labelCol=LABEL)
    budget = dict(
        **columns, maxIter=trees, stepSize=LEARNING_RATE, maxDepth=DEPTH[family], subsamplingRate=ROW_SAMPLE.get(family, 1.0),
        featureSubsetStrategy=COLSAMPLE, seed=SEED, maxBins=MAX_BINS, cacheNodeIds=False, maxMemoryInMB=HISTOGRAM_MB,
    )
    boosted = GBTClassifier(**budget) if classification else GBTRegressor(**budget)
    if classification and n_classes > 2:
        boosted = OneVsRest(classifier=boosted, **columns)
    return MergedTrees(boosted, classification) if merge else boosted


def fit_text(train: DataFrame, text_col: str | None, vocabulary: int = VOCABULARY) -> Callable[[DataFrame], DataFrame]:
    """E7 in ML form: tokens -> unigrams and bigrams -> counts of the top terms (ties by term) -> smoothed idf + 1 -> L2 length 1.

    The terms and their document counts come from one pass of ``term_statistics``: no term is exploded, and idf needs no pass of its own.
    """
    if text_col is None:
        raise ValueError("tfidf_linear requires a text column")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    n = train.count()
    top = tx.term_statistics(train.select(text.alias("_text")), "_text", vocabulary).orderBy(F.desc("corpus_tf"), "term").limit(vocabulary).collect()
    if not top:
        raise ValueError("tfidf_linear found no term in the training texts")
    counted = CountVectorizerModel.from_vocabulary([r["term"] for r in top], inputCol="_terms", outputCol="_tf")
    # Spark's idf is ln((n + 1) / (df + 1)): the same smoothing without the + 1, which joins it here.
    idf = np.log((n + 1.0) / (np.array([r["doc_freq"] for r in top]) + 1.0))
    weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf + 1.0), inputCol="_tf", outputCol="_idf")
    unit = Normalizer(inputCol="_idf", outputCol=FEATURES, p=2.0)

    def vectors(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_uni", tx.tokens(text)).withColumn("_terms", tx.terms("_uni"))
        return unit.transform(weigh.transform(counted.transform(rows)))

    return vectors
