"""Model comparison, fusion of branches and result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.functions.numeric import blend
from cohortloom.operators.evaluate import (
    aggregate_entities,
    alpha_search,
    best_alpha,
    binary_metrics,
    threshold_grid,
    threshold_observed,
)
from cohortloom.operators.models import DetachedLogistic, Fitted, MAX_ITERATIONS, ModelConfig, fit_model, params_text, predict_prob, whole_fit
from cohortloom.operators.split import stratified_group_folds
from cohortloom.operators.weights import class_weights
from cohortloom.session import materialise


METRICS = ("acc", "bal_acc", "f1", "precision", "recall", "auc_roc", "auc_pr")


def _part(df: DataFrame, split: str) -> DataFrame:
    return df.where(F.col("split") == split)


def _result_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Result rows, one per fitted setting, as a table; absent entries are NULL."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    kinds = {}
    for name in names:
        seen = next((r[name] for r in rows if r.get(name) is not None), None)
        kinds[name] = "string" if isinstance(seen, str) else "int" if isinstance(seen, int) else "double"
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def split_metrics(scored: DataFrame, prob: str = "prob", threshold: float = 0.5, tag: str = "") -> dict[str, float]:
    """`val_<tag><metric>` and `test_<tag><metric>` of scored rows; only one row per split is collected."""
    rows = binary_metrics(scored, "label", prob, threshold, keys=["split"]).collect()
    return {f"{r.split}_{tag}{m}": r[m] for r in sorted(rows, key=lambda r: r.split, reverse=True) for m in METRICS}


def _scored(fitted: Fitted, df: DataFrame, features: Sequence[str], prob: str = "prob") -> DataFrame:
    return predict_prob(fitted.model, df.where(F.col("split") != "train").select("entity_id", "split", "label", *features), prob)


def _settings(configs: Sequence[ModelConfig], strategies: Sequence[str]):
    for config in configs:
        for strategy in strategies:
            if strategy == "standard" or config.takes_weights:
                yield config, strategy


def compare_feature_sets(
    df: DataFrame,
    feature_sets: dict[str, Sequence[str]],
    configs: Sequence[ModelConfig],
    strategies: Sequence[str] = ("standard", "severity_weighted"),
    search: bool = True,
    folds: int = 5,
) -> DataFrame:
    """Feature set x model x weighting to one tidy row each.

    `df` has entity_id, split, label, severity, fold and every feature. The driver only loops over the
    settings; each fit and each scoring is a distributed job.
    """
    rows = []
    for set_name, features in feature_sets.items():
        for config, strategy in _settings(configs, strategies):
            fitted = fit_model(config, _part(df, "train"), features, strategy, search=search, folds=folds)
            rows.append(
                {
                    "feature_set": set_name, "model": config.name, "strategy": strategy,
                    "best_params": params_text(fitted.params), "cv_auc_roc": fitted.cv_auc,
                }
                | split_metrics(_scored(fitted, df, features))
            )
    return _result_table(df.sparkSession, rows)


def refined_search(
    df: DataFrame,
    feature_sets: dict[str, Sequence[str]],
    configs: Sequence[ModelConfig],
    strategies: Sequence[str] = ("standard",),
    metric: str = "f1",
    search: bool = True,
    folds: int = 5,
) -> DataFrame:
    """Nested feature sets with metrics at .5 and at a grid threshold tuned on validation rows."""
    rows = []
    for set_name, features in feature_sets.items():
        for config, strategy in _settings(configs, strategies):
            fitted = fit_model(config, _part(df, "train"), features, strategy, search=search, folds=folds)
            scored = _scored(fitted, df, features)
            tuned = threshold_grid(_part(scored, "val"), "label", "prob", metric).first()
            rows.append(
                {
                    "feature_set": set_name, "feature_count": len(features), "feature_names": ",".join(features),
                    "model": config.name, "strategy": strategy, "best_params": params_text(fitted.params),
                    "cv_auc_roc": fitted.cv_auc, "tuned_threshold": float(tuned.threshold),
                }
                | split_metrics(scored)
                | split_metrics(scored, threshold=float(tuned.threshold), tag="tuned_")
            )
    table = _result_table(df.sparkSession, rows)
    return table.orderBy(F.desc_nulls_last("test_auc_roc"), F.desc_nulls_last("test_tuned_f1"))


def late_fusion(
    df: DataFrame,
    branch_a: tuple[ModelConfig, Sequence[str]],
    branch_b: tuple[ModelConfig, Sequence[str]],
    search: bool = True,
    folds: int = 5,
) -> DataFrame:
    """Two branch models, blend weight tuned on validation, test metrics of both branches and the blend."""
    fits = [fit_model(c, _part(df, "train"), f, search=search, folds=folds) for c, f in (branch_a, branch_b)]
    both = predict_prob(fits[0].model, df.where(F.col("split") != "train"), "prob_a")
    both = predict_prob(fits[1].model, both, "prob_b").select("split", "label", "prob_a", "prob_b")
    both = materialise(both, "branch-probs")
    best = best_alpha(alpha_search(_part(both, "val"), "label", "prob_a", "prob_b")).first()
    blended = both.withColumn("prob_f", blend(F.col("prob_a"), F.col("prob_b"), best.alpha))
    rows = [
        {"method": method, "alpha": float(best.alpha), "cv_auc_roc": cv} | split_metrics(blended, prob)
        for method, prob, cv in (
            ("branch_a", "prob_a", fits[0].cv_auc), ("branch_b", "prob_b", fits[1].cv_auc), ("blend", "prob_f", None),
        )
    ]
    return _result_table(df.sparkSession, rows)


def fit_stack(val: DataFrame, probs: Sequence[str], kind: str = "logistic", label: str = "label"):
    """Meta model on branch probabilities: balanced logistic regression or a tree of depth two.

    It is fitted on the validation rows its threshold is later tuned on, so that estimate is optimistic.
    """
    assembler = VectorAssembler(inputCols=list(probs), outputCol="features")
    rows = val.withColumn(label, F.col(label).cast("double"))
    if kind == "tree":
        return Pipeline(stages=[assembler, DecisionTreeClassifier(maxDepth=2, labelCol=label, seed=42)]).fit(rows)
    cw = class_weights(val, label).first()
    rows = rows.withColumn("weight", F.when(F.col(label) == 1, cw.weight_pos).otherwise(cw.weight_neg))
    # Balanced weights add up to the row count, so C = 1 is a penalty of 1 / rows.
    n = max(cw.n_neg + cw.n_pos, 1)
    lr = DetachedLogistic(maxIter=MAX_ITERATIONS, regParam=1.0 / n, standardization=False, labelCol=label, weightCol="weight")
    return whole_fit(Pipeline(stages=[assembler, lr]).fit(rows))


def stack_metrics(df: DataFrame, probs: Sequence[str], kind: str) -> DataFrame:
    """Meta model from the validation rows, metrics on both parts at .5."""
    model = fit_stack(_part(df, "val"), probs, kind)
    stacked = predict_prob(model, df.where(F.col("split") != "train").select("split", "label", *probs), "stacked")
    row = {"method": f"{kind}_stacking_{len(probs)}way"} | split_metrics(stacked, "stacked")
    return _result_table(df.sparkSession, [row])


def fused_entity_eval(
    samples: DataFrame,
    structured: DataFrame,
    features: Sequence[str],
    config: ModelConfig,
    strategy: str = "year_weighted_mean",
    late_year: int = 2025,
    search: bool = False,
    folds: int = 5,
) -> DataFrame:
    """Sample-level, entity-aggregated and entity plus structured stacking, on one comparable pool.

    `samples` has sample_id, entity_id, year, label, prob, split; `structured` entity_id, severity and the
    features. Thresholds come from validation rows by F1.
    """
    pool = samples.join(structured.select("entity_id"), "entity_id", "left_semi").where(
        F.col("split").isin("train", "val", "test")
    )

    def row(df: DataFrame, prob: str, method: str, level: str) -> dict:
        t = float(threshold_observed(_part(df, "val"), "label", prob).first().threshold)
        parts = df.where(F.col("split") != "train")
        return {"method": method, "level": level, "threshold": t} | split_metrics(parts, prob, t)

    entities = aggregate_entities(pool, strategy, late_year=late_year)
    splits = pool.groupBy("entity_id").agg(F.min("split").alias("split"))
    wide = entities.join(splits, "entity_id").join(structured.select("entity_id", "severity", *features), "entity_id")
    if search:
        wide = stratified_group_folds(wide, folds)
    # Written once: the fit, the stack and three evaluations read it.
    wide = materialise(wide, "entity-probs")
    branch = fit_model(config, _part(wide, "train"), features, search=search, folds=folds)
    both = predict_prob(branch.model, wide.where(F.col("split") != "train"), "prob_b")
    stack = fit_stack(_part(both, "val"), ["prob", "prob_b"])
    stacked = predict_prob(stack, both.select("split", "label", "prob", "prob_b"), "stacked")
    rows = [
        row(pool, "prob", "sample_level", "sample"),
        row(wide, "prob", "entity_fusion", "entity"),
        row(stacked, "stacked", "entity_plus_structured", "entity"),
    ]
    return _result_table(samples.sparkSession, rows)


def best_per_group(results: DataFrame, group: Sequence[str], metric: str, tie: str) -> DataFrame:
    """Highest metric per group, lowest `tie` value on equal scores (max_by: no sort, combines early)."""
    payload = F.struct(*[c for c in results.columns if c not in group])
    lowest = results.groupBy(*group, metric).agg(F.min_by(payload, F.col(tie)).alias("r"))
    return lowest.groupBy(*group).agg(F.max_by("r", F.col(metric)).alias("r")).select(*group, "r.*")


def leaderboard(results: DataFrame, metric: str, tie: str, n: int) -> DataFrame:
    """Top n by a metric with their place; only n rows reach the ranking window."""
    top = results.orderBy(F.desc_nulls_last(metric), tie).limit(n)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(metric), tie))
    return top.withColumn("place", place)


def family_summary(results: DataFrame, family: str, metric: str) -> DataFrame:
    """Mean, best, spread and run count of a metric per family (also multi-seed mean and std)."""
    return results.groupBy(family).agg(
        F.count(metric).alias("runs"),
        F.avg(metric).alias("mean_score"),
        F.max(metric).alias("best_score"),
        F.stddev_pop(metric).alias("std_score"),
    )


def result_summary(results: DataFrame, groups: Sequence[str], auc: str, tuned: str, run: str) -> DataFrame:
    """(kind, name, runs, mean_score, best_score, best_run, best_tuned, best_tuned_run) of all runs and of each group's.

    One scan with grouping sets; `kind` is 'all' or the group's column. Of equal scores the first run by name is best.
    """
    first = lambda c: F.min_by(run, F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("a"), F.col(run).alias("b"))))
    # A NULL group is a group of its own: its place in the grouping is known by the grouping's number alone.
    sets = [[], *[[g] for g in groups]]
    number = F.grouping_id(*groups)
    found = results.groupingSets(sets, *groups).agg(
        number.alias("_set"), F.count(auc).alias("runs"), F.avg(auc).alias("mean_score"), F.max(auc).alias("best_score"), first(auc).alias("best_run"),
        F.max(tuned).alias("best_tuned"), first(tuned).alias("best_tuned_run"),
    )
    kind, name = F.lit("all"), F.lit(None).cast("string")
    for k, g in enumerate(groups):
        here = F.col("_set") == (1 << len(groups)) - 1 - (1 << (len(groups) - 1 - k))
        kind, name = F.when(here, g).otherwise(kind), F.when(here, F.col(g).cast("string")).otherwise(name)
    return found.select(kind.alias("kind"), name.alias("name"), "runs", "mean_score", "best_score", "best_run", "best_tuned", "best_tuned_run")
