"""Out-of-fold evaluation and ranking of candidate models.

Shape of the job: feature plan -> fold column over all rows -> persist once -> for each fold
one preprocessing fit, shared by all candidates, whose vectors are cached while the fold's
candidates are fitted side by side -> out-of-fold rows in one Parquet table per candidate ->
one aggregation of fold metrics -> leaderboard.  Every row gets a fold and an out-of-fold prediction (but for the
first rows of a time split) and the final model sees every row.  ``fit_rows`` is an explicit bound on the rows a
*classifier* is fitted on, for training sides only; nothing else depends on the size of the data.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aliases import candidate_name
from ..functions.exprs import lenient_timestamp, threshold_label
from ..operators import sampling as sm
from ..operators import schema as sc
from ..operators import splits as sp
from ..operators.features import FeaturePlan, apply_feature_plan
from ..operators.profile import feature_summary
from ..operators.quality import q
from ..session import scratch_path
from . import models as md
from . import preprocess as pp
from . import task as tk

log = logging.getLogger(__name__)

ROWS_PER_FIT_PARTITION = 100_000
MAX_BROADCAST_CLASSES = 100_000
METRICS = ("accuracy", "neg_rmse")
# Accepted spellings of a scheme; the recommended grouping needs a group column to become one.
SCHEMES = {s: s for s in ("time_split", "group_kfold", "stratified_kfold", "kfold", "grouped_kfold_recommended")} | {"grouped_kfold": "group_kfold"}
REFIT = "refit"


@dataclass
class EvaluationResult:
    task_type: str
    validation_scheme: str
    metric_family: str
    prediction_mode: str
    leaderboard: DataFrame
    best: dict | None
    oof: DataFrame | None
    test_predictions: DataFrame | None
    eval_rows: int
    text_heavy: bool = False
    datetime_heavy: bool = False
    fit_notes: list[str] = field(default_factory=list)
    feature_plan: dict = field(default_factory=dict)
    artifact_path: str | None = None


def fold_metric(oof: DataFrame, task_type: str, metric: str | None = None) -> DataFrame:
    """One score per (candidate, fold): -RMSE or accuracy; by default the task's own."""
    metric = metric or tk.metric_family(tk.REGRESSION if task_type == tk.REGRESSION else tk.BINARY)
    if metric not in METRICS:
        raise ValueError(f"unsupported metric_family {metric!r}")
    if metric == "neg_rmse":
        score = -F.sqrt(F.avg(F.pow(F.col("label") - F.col("prediction"), 2)))
    else:
        score = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    return oof.groupBy("candidate", "fold").agg(score.alias("score"))


def leaderboard_from_folds(fold_scores: DataFrame, positions: DataFrame) -> DataFrame:
    """A14 + L3: unweighted mean over folds, the scores in fold order, sorted by score and then position."""
    in_order = F.array_sort(F.collect_list(F.struct("fold", "score")))  # k entries a candidate
    agg = fold_scores.groupBy("candidate").agg(F.avg("score").alias("score"), F.transform(in_order, lambda s: s["score"]).alias("fold_scores"))
    return positions.join(agg, "candidate").select("position", F.col("candidate").alias("name"), "score", "fold_scores").orderBy(
        F.desc("score"), "position"
    )


def best_candidate(board: DataFrame) -> DataFrame:
    """The highest score that is a number; the earlier position wins ties."""
    scored = board.where(F.col("score").isNotNull() & ~F.isnan("score"))
    best = F.max(F.struct(F.col("score"), (-F.col("position")).alias("neg_pos"), F.col("name")))
    return scored.agg(best.alias("b")).where("b is not null").select(
        F.col("b.name").alias("name"), F.col("b.score").alias("score"), (-F.col("b.neg_pos")).alias("position")
    )


def _label_frame(df: DataFrame, target: str, task_type: str) -> tuple[DataFrame, DataFrame | None, int]:
    """Add ``label``: the value for regression, else the class index (V10); rows without a target teach and score nothing."""
    if task_type == tk.REGRESSION:
        return df.withColumn("label", q(target).cast("double")).where("label is not null"), None, 0
    classes = tk.label_index(df, target).select(F.col("label").alias("_cls"), F.col("label_index").cast("double").alias("label"))
    n_classes = classes.count()
    # one row per class: broadcast only behind the measured class count
    right = F.broadcast(classes) if n_classes <= MAX_BROADCAST_CLASSES else classes
    return df.join(right, q(target) == F.col("_cls"), "inner").drop("_cls"), classes, n_classes


def resolve_scheme(name: str, task_type: str, group_column: str | None) -> str:
    """The scheme that runs: unknown names are refused, the recommended grouping falls back to plain folds without a group."""
    if name not in SCHEMES:
        raise ValueError(f"unsupported validation_scheme {name!r}")
    scheme = SCHEMES[name]
    if scheme == "grouped_kfold_recommended":
        scheme = "group_kfold" if group_column else "kfold" if task_type == tk.REGRESSION else "stratified_kfold"
    if scheme == "group_kfold" and not group_column:
        raise ValueError("group_kfold needs group_column")
    if scheme == "stratified_kfold" and task_type == tk.REGRESSION:
        raise ValueError("stratified_kfold needs classes")
    return scheme


def _folded(df: DataFrame, scheme: str, key: str, target: str, group_column: str | None, datetime_columns: Sequence[str], n_splits: int, seed: int):
    if scheme == "time_split":
        order = [F.col(key)]
        if datetime_columns:  # D3: time order (parsed, unparseable first), not file order; ties by key
            first = datetime_columns[0]
            order.insert(0, lenient_timestamp(q(first), df.schema[first].dataType).asc_nulls_first())
        return sp.time_split(df, order, n_splits)
    if scheme == "group_kfold":
        return sp.group_kfold(df, group_column, n_splits, seed)
    if scheme == "stratified_kfold":
        return sp.stratified_kfold(df, target, [key], n_splits, seed)
    return sp.kfold(df, [key], n_splits, seed)


def evaluate_candidates(
    train: DataFrame,
    test: DataFrame | None = None,
    template: DataFrame | None = None,
    *,
    target: str | None = None,
    key: str | None = None,
    task_type: str | None = None,
    validation_scheme: str | None = None,
    metric_family: str | None = None,
    feature_plan: Mapping[str, Any] | None = None,
    candidates: Sequence[Any] | None = None,
    n_splits: int = 3,
    group_column: str | None = None,
    fit_rows: int | None = None,
    trees: int = md.TREES,
    growth: str = md.LEVEL,
    one_hot: bool = True,
    vocabulary: int = md.VOCABULARY,
    parallelism: int = 4,
    seed: int = 42,
) -> EvaluationResult:
    """V6: evaluate candidates out of fold and rank them.

    ``key`` identifies rows (default: the first id candidate); it drives the hash-based folds and
    keys the prediction tables.  ``fit_rows`` bounds the rows a classifier is fitted on (those of the least
    key hash, stratified by class); regressions always use all rows.  ``growth`` says how boosted trees grow: ``level``, or as
    their ``family`` defines it (leaf-wise, symmetric).
    """
    spark: SparkSession = train.sparkSession
    test_cols = test.columns if test is not None else None
    tmpl_cols = template.columns if template is not None else None
    target = target or sc.target_candidates(train.columns, test_cols, tmpl_cols)[0]
    if target not in train.columns:
        target = sc.target_candidates(train.columns, test_cols, None)[0]
    ids = sc.id_candidates(train.columns, test_cols, tmpl_cols)
    key = key or (ids[0] if ids else None)
    if key is None or key not in train.columns:
        raise ValueError("evaluation needs a row key column (pass key=...)")
    ttype = task_type or tk.infer_task_type(train, target)
    if fit_rows is not None and ttype == tk.REGRESSION:
        raise ValueError("fit_rows bounds the rows of classifiers only")
    feats = feature_summary(train, list(dict.fromkeys([*ids, target])), [key])
    names = list(dict.fromkeys(candidate_name(c, ttype) for c in (candidates or tk.default_candidates(ttype, feats.text_heavy))))
    for n in names:
        md.check_candidate(n)
    metric = metric_family or tk.metric_family(ttype)
    if metric not in METRICS:
        raise ValueError(f"unsupported metric_family {metric!r}")
    scheme = resolve_scheme(validation_scheme or tk.recommended_validation(ttype, feats.datetime_heavy, ids), ttype, group_column)
    plan = FeaturePlan.from_spec(feature_plan)
    tr_feat, te_feat = apply_feature_plan(train, test, plan, target)
    text_columns = [c for c in feats.text_columns if c not in feats.datetime_columns]  # D19
    kept_out = list(dict.fromkeys([*ids, key, target, *([group_column] if group_column else [])]))
    cols = pp.split_columns(tr_feat.schema.fields, kept_out, text_columns)
    cols.text = text_columns[0] if text_columns else None
    notes = [f"rows of a fit bounded by fit_rows={fit_rows}"] if fit_rows is not None else []

    labelled, classes, n_classes = _label_frame(tr_feat, target, ttype)
    folded = _folded(labelled, scheme, key, target, group_column, feats.datetime_columns, n_splits, seed)
    # Iterative fits run many small jobs whose cost grows with the task count: pack the rows into partitions of a stated size.
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["fold"]: r["count"] for r in folded.groupBy("fold").count().collect()}  # k + 1 rows
    eval_rows = sum(sizes.values())
    folds = sorted(f for f in sizes if f is not None)
    pmode = "numeric" if ttype == tk.REGRESSION else ("proba" if ttype == tk.BINARY else "label")
    artifact = scratch_path(spark, "evaluation")
    errors: dict[str, str] = {}

    def predict(model, df: DataFrame, name: str) -> DataFrame:
        out = model.transform(df)
        prediction, probability = F.col("prediction").cast("double"), F.lit(None).cast("double")
        if ttype == tk.BINARY and "probability" in out.columns:
            probability = vector_to_array("probability")[1]
            prediction = threshold_label(probability).cast("double")  # inclusive threshold
        extra = [c for c in ("fold", "label") if c in df.columns]
        return out.select(q(key), F.lit(name).alias("candidate"), prediction.alias("prediction"), probability.alias("probability"), *extra)

    def run_side(fit_on: DataFrame, n_fit: int, apply_to: DataFrame, side: str) -> None:
        """Fit every candidate on one side and store its predictions of the other."""
        if fit_rows is not None and fit_rows < n_fit:
            fit_on, n_fit = sm.stratified_subsample(fit_on, target, [key], fit_rows, seed), fit_rows
        parts = max(spark.sparkContext.defaultParallelism, -(-n_fit // ROWS_PER_FIT_PARTITION))
        prep = pp.Preprocessor.fit(fit_on, cols, one_hot=one_hot)
        wanted = [c for c in (key, "label", "fold", cols.text, pp.LINEAR, pp.TREE) if c]
        ready = prep.transform(fit_on)
        ready = ready.select(*[q(c) for c in wanted if c in ready.columns]).repartition(parts).persist(StorageLevel.MEMORY_AND_DISK)
        other = prep.transform(apply_to)
        other = other.select(*[q(c) for c in wanted if c in other.columns])
        if len(names) > 1:  # each candidate predicts it
            other = other.persist(StorageLevel.MEMORY_AND_DISK)

        def run(name: str) -> None:
            started = time.perf_counter()
            left, right = ready, other
            if name == md.TEXT:
                vectors = md.fit_text(ready, cols.text, vocabulary)
                left, right = vectors(ready), vectors(other)
            model = md.estimator(name, ttype, n_train=n_fit, n_classes=n_classes, trees=trees, growth=growth).fit(left)
            predict(model, right, name).write.mode("overwrite").parquet(f"{artifact}/{side}/candidate={name}")
            log.info("%s %s: %.1f s", name, side, time.perf_counter() - started)

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:  # independent Spark jobs
            for name, done in [(n, pool.submit(run, n)) for n in names if n not in errors]:
                try:
                    done.result()
                except Exception as exc:  # D16: one failing candidate does not fail the rest
                    errors.setdefault(name, f"{type(exc).__name__}: {exc}")
                    log.warning("candidate %s failed on %s", name, side, exc_info=exc)
        ready.unpersist()
        other.unpersist()

    for fold in folds:
        mask = sp.time_split_train_mask(fold, eval_rows, n_splits) if scheme == "time_split" else sp.fold_masks(fold)[0]
        before = sum(n for f, n in sizes.items() if f != fold and (scheme != "time_split" or f is None or f < fold))
        run_side(folded.where(mask), before, folded.where(sp.fold_masks(fold)[1]), f"oof/fold={fold}")
    if te_feat is not None:
        run_side(folded, eval_rows, te_feat, "test")
    folded.unpersist()

    ok = [n for n in names if n not in errors]
    oof = test_pred = None
    if ok:
        parts = [spark.read.parquet(*[f"{artifact}/oof/fold={f}/candidate={n}" for f in folds]).withColumn("candidate", F.lit(n)) for n in ok]
        oof = parts[0]
        for part in parts[1:]:
            oof = oof.unionByName(part)
        oof = oof.select(q(key), "candidate", "prediction", "probability", "fold", "label")
    if ok and te_feat is not None:
        test_pred = spark.read.option("basePath", f"{artifact}/test").parquet(*[f"{artifact}/test/candidate={n}" for n in ok])
        test_pred = test_pred.select(q(key), "candidate", "prediction", "probability")
        if classes is not None:
            back = classes.select(F.col("label").alias("prediction"), F.col("_cls").alias("predicted_label"))
            test_pred = test_pred.join(F.broadcast(back) if n_classes <= MAX_BROADCAST_CLASSES else back, "prediction", "left")

    positions = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "position int, candidate string")
    scores = fold_metric(oof, ttype, metric) if oof is not None else spark.createDataFrame([], "candidate string, fold int, score double")
    ranked = [r.asDict() for r in leaderboard_from_folds(scores, positions).collect()]  # one row per candidate
    by_name = {r["name"]: r for r in ranked}
    rows = [
        (i, n, by_name.get(n, {}).get("score"), by_name.get(n, {}).get("fold_scores"), "error" if n in errors else "ok", errors.get(n),
         None if n in errors else artifact_ref(artifact, n))
        for i, n in enumerate(names)
    ]
    board = spark.createDataFrame(
        rows, "position int, name string, score double, fold_scores array<double>, status string, error string, artifact_ref string"
    ).orderBy(F.desc_nulls_last("score"), "position")
    won = best_candidate(board).collect()
    best = None
    if won:
        i = names.index(won[0]["name"])
        best = won[0].asDict() | {"fold_scores": rows[i][3], "artifact_ref": rows[i][6]}
    return EvaluationResult(
        task_type=ttype,
        validation_scheme=scheme,
        metric_family=metric,
        prediction_mode=pmode,
        leaderboard=board,
        best=best,
        oof=oof,
        test_predictions=test_pred,
        eval_rows=eval_rows,
        text_heavy=feats.text_heavy,
        datetime_heavy=feats.datetime_heavy,
        fit_notes=notes,
        feature_plan=dict(feature_plan or {}),
        artifact_path=artifact,
    )


def artifact_ref(path: str, candidate: str) -> str:
    """The name under which a candidate's stored predictions are found again."""
    return f"{path}#{candidate}"


def load_artifact(spark: SparkSession, ref: str) -> dict[str, DataFrame | None]:
    """The stored tables of one candidate: out-of-fold rows with their labels, and test predictions if there were any."""
    path, _, candidate = ref.rpartition("#")

    def side(pattern: str) -> DataFrame | None:
        try:
            return spark.read.parquet(f"{path}/{pattern}/candidate={candidate}")
        except Exception as exc:
            if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
                return None
            raise

    oof = side("oof/fold=*") if path and candidate else None
    if oof is None:
        raise ValueError(f"Unknown artifact_ref: {ref}")
    return {"oof": oof, "test": side("test")}


def store_predictions(df: DataFrame, path: str) -> str:
    """Persist predictions partitioned by candidate."""
    df.write.mode("overwrite").partitionBy("candidate").parquet(path)
    return path


def load_predictions(spark: SparkSession, path: str, candidate: str) -> DataFrame:
    """Read one candidate back; the partition filter prunes the other candidates' files.  An unknown name is an error."""
    found = spark.read.parquet(path).where(F.col("candidate") == F.lit(candidate))
    if found.isEmpty():
        raise ValueError(f"no stored predictions of {candidate!r} in {path}")
    return found
