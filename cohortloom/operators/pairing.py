"""Two samples of one entity as one example."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIRING_MODES = ("cross_year_all", "cross_year_first", "within_late_first2")


def _named(df: DataFrame, side: str, entity: str, sample: str) -> DataFrame:
    return df.select(F.col(entity).alias("entity_id"), F.col(sample).alias(f"sample_id_{side}"))


def _with_id(pairs: DataFrame, mode: str) -> DataFrame:
    key = F.concat(
        F.col("entity_id").cast("string"), F.lit("_"), F.col("sample_id_a"), F.lit("__"), F.col("sample_id_b")
    )
    return pairs.select(key.alias("pair_id"), "entity_id", "sample_id_a", "sample_id_b", F.lit(mode).alias("mode"))


def build_pairs(
    samples: DataFrame,
    mode: str = "cross_year_all",
    early: int = 2024,
    late: int = 2025,
    entity: str = "entity_id",
    sample: str = "sample_id",
    year: str = "year",
) -> DataFrame:
    """Pair table of one mode; sample ids compare as text, rows without a year are left out."""
    if mode not in PAIRING_MODES:
        raise ValueError(f"Unsupported pairing mode: {mode}")
    rows = samples.select(entity, F.col(sample).cast("string").alias(sample), year)
    first, second = rows.where(F.col(year) == early), rows.where(F.col(year) == late)
    if mode == "cross_year_all":
        # The pair list itself is the result, so its size is n_early * n_late per entity. A hot entity's
        # partition is split by the adaptive skew join; nothing is copied for the others.
        a, b = _named(first, "a", entity, sample), _named(second, "b", entity, sample)
        return _with_id(a.join(b, "entity_id"), mode)
    if mode == "cross_year_first":
        ids = rows.groupBy(F.col(entity).alias("entity_id")).agg(
            F.min(F.when(F.col(year) == early, F.col(sample))).alias("sample_id_a"),
            F.min(F.when(F.col(year) == late, F.col(sample))).alias("sample_id_b"),
        )
        return _with_id(ids.where(F.col("sample_id_a").isNotNull() & F.col("sample_id_b").isNotNull()), mode)
    # The row_number filter becomes a group limit before the shuffle: two rows per entity and task move.
    order = Window.partitionBy(entity).orderBy(sample)
    top = second.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= 2)
    ids = top.groupBy(F.col(entity).alias("entity_id")).agg(
        F.max(F.when(F.col("_rn") == 1, F.col(sample))).alias("sample_id_a"),
        F.max(F.when(F.col("_rn") == 2, F.col(sample))).alias("sample_id_b"),
    )
    return _with_id(ids.where(F.col("sample_id_b").isNotNull()), mode)


def pair_counts(
    samples: DataFrame, early: int = 2024, late: int = 2025, entity: str = "entity_id", year: str = "year"
) -> DataFrame:
    """Number of cross-year pairs per entity and the weight 1/count of each, without building pairs."""
    n = samples.groupBy(entity).agg(
        (F.count_if(F.col(year) == early) * F.count_if(F.col(year) == late)).alias("n_pairs")
    )
    return n.where(F.col("n_pairs") > 0).withColumn("pair_weight", 1.0 / F.col("n_pairs"))


def pair_mismatches(
    samples: DataFrame,
    early: int = 2024,
    late: int = 2025,
    entity: str = "entity_id",
    year: str = "year",
    label: str = "label",
    severity: str = "severity",
) -> DataFrame:
    """Entities with some pair whose sides differ in label or severity; empty when all is well.

    Some pair differs exactly when the values over both years are not all the same, so min and max per
    entity decide it.
    """
    both = samples.where(F.col(year).isin(early, late)).groupBy(entity).agg(
        F.count_if(F.col(year) == early).alias("n_early"),
        F.count_if(F.col(year) == late).alias("n_late"),
        *[f(c).alias(f"{n}_{c}") for c in (label, severity) for n, f in (("min", F.min), ("max", F.max))],
    )
    differs = [F.col(f"min_{c}") != F.col(f"max_{c}") for c in (label, severity)]
    return both.where((F.col("n_early") > 0) & (F.col("n_late") > 0)).select(
        entity, differs[0].alias("label_differs"), differs[1].alias("severity_differs")
    ).where(F.col("label_differs") | F.col("severity_differs"))
