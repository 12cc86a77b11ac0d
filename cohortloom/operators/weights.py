"""Row weights: class balance, severity emphasis, one unit of weight per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.numeric import TRAINING_MULTIPLIER, severity_multiplier


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """n / (2 * n_class) per class as one row, 1.0 for an empty class; a NULL label counts as 0."""
    y = F.coalesce(F.col(label), F.lit(0))
    n = df.agg(F.count_if(y == 0).alias("n_neg"), F.count_if(y == 1).alias("n_pos"))
    total = (F.col("n_neg") + F.col("n_pos")).cast("double")
    return n.select(
        "n_neg",
        "n_pos",
        F.coalesce(F.try_divide(total, 2 * F.col("n_neg").cast("double")), F.lit(1.0)).alias("weight_neg"),
        F.coalesce(F.try_divide(total, 2 * F.col("n_pos").cast("double")), F.lit(1.0)).alias("weight_pos"),
    )


def pair_class_weights(pair_counts: DataFrame, label: str = "label") -> DataFrame:
    """Class weights over pairs, from pairs-per-entity counts (no pair is built for it)."""
    y, n = F.coalesce(F.col(label), F.lit(0)), F.col("n_pairs")
    sums = pair_counts.agg(
        F.coalesce(F.sum(F.when(y == 0, n)), F.lit(0)).alias("n_neg"),
        F.coalesce(F.sum(F.when(y == 1, n)), F.lit(0)).alias("n_pos"),
    )
    total = (F.col("n_neg") + F.col("n_pos")).cast("double")
    return sums.select(
        "n_neg",
        "n_pos",
        F.coalesce(F.try_divide(total, 2 * F.col("n_neg").cast("double")), F.lit(1.0)).alias("weight_neg"),
        F.coalesce(F.try_divide(total, 2 * F.col("n_pos").cast("double")), F.lit(1.0)).alias("weight_pos"),
    )


def _ratio(df: DataFrame, label: str) -> Column:
    """n_neg / n_pos as a scalar subquery, 1.0 without positives."""
    n = df.agg(
        F.coalesce(
            F.try_divide(F.count_if(F.col(label) == 0).cast("double"), F.count_if(F.col(label) == 1).cast("double")),
            F.lit(1.0),
        ).alias("ratio")
    )
    return n.scalar()


def severity_weights(
    df: DataFrame,
    label: str = "label",
    severity: str = "severity",
    table: dict[int, float] | None = None,
    missing_grade: int = 1,
    name: str = "weight",
) -> DataFrame:
    """Negatives 1.0; positives (n_neg / n_pos) times the multiplier of their grade."""
    scale = severity_multiplier(F.col(severity), table, missing_grade)
    return df.withColumn(name, F.when(F.col(label) == 1, _ratio(df, label) * scale).otherwise(1.0))


def training_weights(
    df: DataFrame, label: str = "label", severity: str = "severity", name: str = "weight"
) -> DataFrame:
    """Trainer variant: class weight, times the milder grade multiplier for positives."""
    cw = class_weights(df, label)
    scale = severity_multiplier(F.col(severity), TRAINING_MULTIPLIER, 0)
    neg, pos = cw.select("weight_neg").scalar(), cw.select("weight_pos").scalar()
    return df.withColumn(
        name, F.when(F.col(label) == 0, neg).when(F.col(label) == 1, pos * scale).otherwise(F.lit(1.0))
    )


def balanced_label_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    cw = class_weights(df, label)
    neg, pos = cw.select("weight_neg").scalar(), cw.select("weight_pos").scalar()
    return df.withColumn(name, F.when(F.col(label) == 1, pos).otherwise(neg))


def balance_weight(df: DataFrame, entity: str = "entity_id", name: str = "weight") -> DataFrame:
    """1 / rows of the same entity.

    Counts are combined map-side and joined back; a window would sort a hot entity in one task, while
    the join lets adaptive execution split it.
    """
    counts = df.groupBy(entity).agg(F.count("*").alias("_n"))
    return df.join(counts, entity).withColumn(name, 1.0 / F.col("_n")).drop("_n")


def sample_counts(entities: DataFrame, samples: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities with the number of their samples, NULL without any."""
    counts = samples.groupBy(entity).agg(F.count("*").alias("sample_count"))
    return entities.join(counts, entity, "left")
