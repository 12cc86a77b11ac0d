"""Classification metrics, thresholds, blending and entity-level aggregation of probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.numeric import blend, logit, sigmoid
from cohortloom.operators.ranking import running_totals
from cohortloom.operators.scoring import auc_from_counts
from cohortloom.session import materialise

FUSION_STRATEGIES = ("prob_mean", "prob_max", "logit_mean", "year_weighted_mean")
# 33 even thresholds from .1 to .9, and eleven blend weights.
THRESHOLD_GRID = tuple(0.1 + i * 0.025 for i in range(33))
ALPHA_GRID = tuple(i / 10.0 for i in range(11))


def _group(df: DataFrame, keys: Sequence[str]):
    return df.groupBy(*keys) if keys else df.groupBy()


def _or_zero(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Point metrics from the four cells; 0/0 counts as zero. A class without rows drops out of bal_acc."""
    recall, spec = F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.try_divide(
        tn.cast("double"), (tn + fp).cast("double")
    )
    return {
        "acc": _or_zero(tp + tn, tp + fp + fn + tn),
        "bal_acc": F.coalesce((recall + spec) / 2.0, recall, spec, F.lit(0.0)),
        "f1": _or_zero(2 * tp, 2 * tp + fp + fn),
        "precision": _or_zero(tp, tp + fp),
        "recall": _or_zero(tp, tp + fn),
    }


def confusion_metrics(
    df: DataFrame, label: str, prob: str, threshold: float | Column = 0.5, keys: Sequence[str] = (), prefix: str = ""
) -> DataFrame:
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    y, hit = F.col(label) == 1, F.col(prob) >= t
    cells = _group(df, keys).agg(
        F.count_if(y & hit).alias("tp"),
        F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"),
        F.count_if(~y & ~hit).alias("tn"),
    )
    rates = _rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    return cells.select(*keys, *[c.alias(prefix + n) for n, c in rates.items()])


def score_counts(df: DataFrame, label: str, prob: str, keys: Sequence[str] = ()) -> DataFrame:
    """Class counts per distinct score: the only thing rank metrics need."""
    return df.groupBy(*keys, F.col(prob).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def roc_auc_with_total(df: DataFrame, label: str, prob: str, key: str, total: str = "all") -> DataFrame:
    """ROC AUC per value of a text key and over all rows, from one scan: the counts are few when they are doubled."""
    counts = score_counts(df, label, prob, [key])
    both = counts.select(F.explode(F.array(F.col(key), F.lit(total))).alias(key), "score", "pos", "neg")
    summed = both.groupBy(key, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return auc_from_counts(summed, [key], "score")


def roc_auc(df: DataFrame, label: str, prob: str, keys: Sequence[str] = ()) -> DataFrame:
    return auc_from_counts(score_counts(df, label, prob, keys), keys, "score")


def binary_metrics(
    df: DataFrame, label: str, prob: str, threshold: float | Column = 0.5, keys: Sequence[str] = (), prefix: str = ""
) -> DataFrame:
    """Point metrics at a threshold (a column of the keys where groups have their own), ROC AUC and average precision, all from one pass over score counts.

    Average precision is the step-wise sum of precision times recall gained over distinct scores from the
    top. Both rank metrics are NULL when a class is missing.
    """
    ranked = running_totals(score_counts(df, label, prob, keys), keys, "score", ["pos", "neg"])
    pos, neg, hit = F.col("pos"), F.col("neg"), F.col("score") >= threshold
    above = F.col("pos_total") - F.col("pos_below")
    seen = above + F.col("neg_total") - F.col("neg_below")
    gain = F.try_divide(pos, F.col("pos_total")) * F.try_divide(above, seen)
    m = _group(ranked, keys).agg(
        F.sum(F.when(hit, pos).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, neg).otherwise(0)).alias("fp"),
        F.sum(F.when(hit, 0).otherwise(pos)).alias("fn"),
        F.sum(F.when(hit, 0).otherwise(neg)).alias("tn"),
        F.sum((pos * (F.col("neg_below") + neg / 2.0)).cast("double")).alias("wins"),
        F.sum(gain).alias("gain"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    pairs = (tp + fn).cast("double") * (fp + tn)
    rates = _rates(tp, fp, fn, tn) | {
        "auc_roc": F.when(pairs > 0, F.try_divide(F.col("wins"), pairs)),
        "auc_pr": F.when(pairs > 0, F.col("gain")),
    }
    return m.select(*keys, *[c.alias(prefix + n) for n, c in rates.items()])


def average_precision(df: DataFrame, label: str, prob: str, keys: Sequence[str] = ()) -> DataFrame:
    return binary_metrics(df, label, prob, keys=keys).select(*keys, F.col("auc_pr").alias("average_precision"))


def threshold_observed(
    df: DataFrame, label: str, prob: str, metric: str = "f1", keys: Sequence[str] = ()
) -> DataFrame:
    """Best threshold among 0, .5, 1 and every observed score; ties go to the one nearest .5, then lower."""
    keys = list(keys)
    counts = score_counts(df, label, prob, keys)
    groups = counts.select(*keys).distinct() if keys else df.sparkSession.range(1)
    fixed = groups.select(
        *keys,
        F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))).alias("score"),
        F.lit(0).cast("long").alias("pos"),
        F.lit(0).cast("long").alias("neg"),
    )
    merged = counts.unionByName(fixed).groupBy(*keys, "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    ranked = running_totals(merged, keys, "score", ["pos", "neg"])
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    rates = _rates(tp, fp, F.col("pos_below"), F.col("neg_below"))
    # 12 decimals stand for the reference tolerance of 1e-12 on equal scores.
    order = F.struct(
        F.round(rates[metric], 12).alias("s"), (-F.abs(F.col("score") - 0.5)).alias("d"), (-F.col("score")).alias("t")
    )
    best = _group(ranked, keys).agg(F.max(order).alias("b"))
    return best.select(*keys, (-F.col("b.t")).alias("threshold"), F.col("b.s").alias(metric))


def threshold_grid(
    df: DataFrame, label: str, prob: str, metric: str = "f1", grid: Sequence[float] = THRESHOLD_GRID
) -> DataFrame:
    """Best grid threshold, the first maximum wins.

    Each row is counted once under the number of thresholds it passes; 34 counts then give every cell.
    """
    passed = sum(((F.col(prob) >= F.lit(float(t))).cast("int") for t in grid), F.lit(0))
    counts = df.groupBy(passed.alias("passed")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(grid)]))
    cells = counts.select("*", at.alias("g")).groupBy("g").agg(
        F.sum(F.when(F.col("passed") > F.col("g.i"), F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("passed") > F.col("g.i"), F.col("neg")).otherwise(0)).alias("fp"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    score = _rates(F.col("tp"), F.col("fp"), F.col("p") - F.col("tp"), F.col("n") - F.col("fp"))[metric]
    best = cells.agg(F.max_by(F.struct(F.col("g.threshold").alias("t"), score.alias("s")), F.struct(score, -F.col("g.i"))).alias("b"))
    return best.select(F.coalesce("b.t", F.lit(0.5)).alias("threshold"), F.col("b.s").alias(metric))


def alpha_search(
    df: DataFrame, label: str, prob_a: str, prob_b: str, grid: Sequence[float] = ALPHA_GRID
) -> DataFrame:
    """AUC of the blend for every weight, over class counts per pair of scores.

    The counts are written once and each weight ranks them by itself: a task holds its share of one weight's rows, not
    of all weights'.
    """
    pairs = df.groupBy(prob_a, prob_b).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    pairs = materialise(pairs, "score-pairs")
    found = None
    for i, a in enumerate(grid):
        at = [F.lit(i).alias("pos_in_grid"), F.lit(float(a)).alias("alpha")]
        score = blend(F.col(prob_a), F.col(prob_b), F.lit(float(a))).cast("double").alias("score")
        counts = pairs.select(score, "pos", "neg").groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        one = materialise(auc_from_counts(counts, [], "score").select(*at, "auc"), "alpha")
        found = one if found is None else found.unionByName(one)
    return found


def best_alpha(search: DataFrame) -> DataFrame:
    rank = F.struct(F.coalesce("auc", F.lit(float("-inf"))), -F.col("pos_in_grid"))
    return search.agg(F.max_by("alpha", rank).alias("alpha"), F.max("auc").alias("auc"))


def aggregate_entities(
    df: DataFrame,
    strategy: str,
    entity: str = "entity_id",
    label: str = "label",
    prob: str = "prob",
    year: str = "year",
    late_year: int = 2025,
    late_weight: float = 0.7,
) -> DataFrame:
    """One probability per entity; an entity whose rows disagree on the label is an error."""
    if strategy not in FUSION_STRATEGIES:
        raise ValueError(f"Unsupported strategy: {strategy}")
    p = F.col(prob)
    w = F.when(F.col(year) == late_year, F.lit(late_weight)).otherwise(F.lit(1.0 - late_weight))
    value = {
        "prob_mean": F.avg(p),
        "prob_max": F.max(p),
        "logit_mean": sigmoid(F.avg(logit(p))),
        "year_weighted_mean": F.try_divide(F.sum(p * w), F.sum(w)),
    }[strategy]
    out = df.groupBy(entity).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), value.alias(prob))
    message = F.concat(F.lit("Inconsistent labels found for entity "), F.col(entity).cast("string"))
    checked = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.raise_error(message))
    return out.select(entity, checked.alias(label), prob)


def probability_frame(samples: DataFrame, features: DataFrame, pool: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Sample probabilities of the pool's entities with their entity features."""
    return samples.join(pool.select(entity).distinct(), entity, "left_semi").join(features, entity, "inner")


def probability_frame_three(
    samples: DataFrame, features: DataFrame, third: DataFrame, pool: DataFrame, entity: str = "entity_id"
) -> DataFrame:
    return probability_frame(samples, features, pool, entity).join(third, entity, "inner")
