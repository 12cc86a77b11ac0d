"""Leakage-free splits and folds at entity level, and the preparation fitted on the train part."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.ranking import exact_quantiles, hash_ordinals
from cohortloom.operators.scoring import long_form


def _largest_remainder(counts: dict[int, int], draws: int) -> dict[int, int]:
    total = sum(counts.values())
    exact = {k: n * draws / total for k, n in counts.items()}
    quota = {k: math.floor(v) for k, v in exact.items()}
    left = draws - sum(quota.values())
    for k in sorted(exact, key=lambda k: (-(exact[k] - quota[k]), k))[:left]:
        quota[k] += 1
    return quota


def split_quotas(
    counts: dict[int, int], train_frac: float = 0.8, val_frac: float = 0.1
) -> tuple[dict[int, int], dict[int, int]]:
    """Test and validation sizes per label: both totals round up, test is taken first."""
    n = sum(counts.values())
    test = _largest_remainder(counts, math.ceil((1.0 - train_frac - val_frac) * n))
    rest = {k: counts[k] - test[k] for k in counts}
    val = _largest_remainder(rest, math.ceil(val_frac / (train_frac + val_frac) * sum(rest.values())))
    return test, val


def stratified_entity_split(
    entities: DataFrame,
    label: str = "label",
    entity: str = "entity_id",
    train_frac: float = 0.8,
    val_frac: float = 0.1,
    seed: int = 42,
) -> DataFrame:
    """(entity, split) for one row per entity: exact stratified sizes, order by seeded md5.

    Only one count per label reaches the driver. Positions inside a label come from hash buckets, so no
    task sorts a whole class.
    """
    known = entities.where(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("int"))
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    test, val = split_quotas(counts, train_frac, val_frac) if counts else ({}, {})
    placed = hash_ordinals(known, [label], entity, seed, "_pos")
    name = F.lit("train")
    for k in counts:
        here = F.col(label) == k
        name = (
            F.when(here & (F.col("_pos") < test[k]), "test")
            .when(here & (F.col("_pos") < test[k] + val[k]), "val")
            .otherwise(name)
        )
    rest = entities.where(F.col(label).isNull()).select(entity, F.lit("unlabelled").alias("split"))
    return placed.select(entity, name.alias("split")).unionByName(rest)


def split_summary(entities: DataFrame, splits: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities, samples, classes and positive rate per split; `entities` carries label and sample_count."""
    rows = entities.join(splits, entity)
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return rows.groupBy("split").agg(
        F.count("*").alias("n_entities"),
        F.coalesce(F.sum("sample_count"), F.lit(0)).alias("n_samples"),
        pos.alias("n_positive"),
        neg.alias("n_negative"),
        F.round(F.try_divide(pos.cast("double"), (pos + neg).cast("double")), 4).alias("positive_rate"),
    )


def split_overlaps(splits: DataFrame, entity: str = "entity_id") -> DataFrame:
    """Entities found in more than one split; must be empty."""
    return (
        splits.groupBy(entity)
        .agg(F.min("split").alias("first_split"), F.max("split").alias("last_split"))
        .where(F.col("first_split") != F.col("last_split"))
    )


def apply_split(
    df: DataFrame,
    splits: DataFrame,
    features: Sequence[str],
    label: str = "label",
    severity: str = "severity",
    entity: str = "entity_id",
) -> DataFrame:
    """Labelled rows with their split and a dense 0-based group number per entity and split.

    Group numbers follow md5 order of the entity id: any dense numbering serves grouping, and this one
    needs no global sort.
    """
    rows = df.where(F.col(label).isNotNull()).join(
        splits.where(F.col("split").isin("train", "val", "test")), entity
    )
    groups = hash_ordinals(rows.select(entity, "split").distinct(), ["split"], entity, 0, "group_index")
    return rows.join(groups, [entity, "split"]).select(
        entity, "split", "group_index", F.col(label).cast("int").alias("label"),
        F.col(severity).alias("severity"), *features,
    )


def stratified_folds(
    df: DataFrame, k: int, label: str = "label", id_col: str = "sample_id", seed: int = 42
) -> DataFrame:
    """Add `fold`: rows of a label dealt in turn, in md5 order, over k folds."""
    placed = hash_ordinals(df, [label], id_col, seed, "_pos")
    return placed.withColumn("fold", F.pmod("_pos", F.lit(k)).cast("int")).drop("_pos")


def stratified_group_folds(
    df: DataFrame, k: int, label: str = "label", entity: str = "entity_id", seed: int = 42
) -> DataFrame:
    """Add `fold`: whole entities dealt in turn within their label (the highest one of their rows)."""
    entities = df.groupBy(entity).agg(F.max(label).alias("_label"))
    folds = hash_ordinals(entities, ["_label"], entity, seed, "_pos").select(
        entity, F.pmod("_pos", F.lit(k)).cast("int").alias("fold")
    )
    return df.join(folds, entity)


def train_medians(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Exact median per feature over the given (train) rows."""
    return exact_quantiles(long_form(df, features, []), ["feature_name"], "value", {"median": 0.5})


def train_moments(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population std per feature as one wide row."""
    return df.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in features], *[F.stddev_pop(c).alias(f"{c}__std") for c in features]
    )


def median_impute(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Fill NULLs with train medians (one small row per feature reaches the driver)."""
    medians = {r.feature_name: r["median"] for r in train_medians(train, features).collect()}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c)).cast("double")) for c in features}
    )


def standardise(df: DataFrame, train: DataFrame, features: Sequence[str]) -> DataFrame:
    """(x - mean) / population std of the train rows; a zero std divides by 1."""
    m = train_moments(train, features).first()

    def scaled(c: str):
        std = m[f"{c}__std"]
        return (F.col(c) - F.lit(m[f"{c}__mean"])) / F.lit(std if std else 1.0)

    return df.withColumns({c: scaled(c) for c in features})


def anova_f(df: DataFrame, features: Sequence[str], label: str = "label") -> DataFrame:
    """One-way F statistic of each feature over the label classes."""
    long = long_form(df, features, [label])
    per_class = long.groupBy("feature_name", label).agg(
        F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
    )
    total = per_class.groupBy("feature_name").agg(
        F.sum("n").alias("n_all"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("m_all")
    )
    d = F.col("m") - F.col("m_all")
    sums = (
        per_class.join(total, "feature_name")
        .groupBy("feature_name")
        .agg(
            F.sum(F.col("n") * d * d).alias("between"),
            F.sum(F.col("n") * F.col("v")).alias("within"),
            F.max("n_all").alias("n_all"),
            F.max("k").alias("k"),
        )
    )
    f = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n_all") - F.col("k")))
    return sums.select("feature_name", F.when(F.col("k") > 1, f).alias("f_value"))


def percentile_choice(f_values: Sequence[float | None], percentile: int) -> list[int]:
    """Positions kept by a percentile rule: strictly above the interpolated cut, then ties up to the floor.

    Missing F values rank last. At least one position is kept.
    """
    values = [-math.inf if v is None or math.isnan(v) else v for v in f_values]
    if percentile >= 100:
        return list(range(len(values)))
    ordered = sorted(max(v, -1e308) for v in values)
    at = (len(ordered) - 1) * (100 - percentile) / 100.0
    lo = math.floor(at)
    cut = ordered[lo] + (ordered[min(lo + 1, len(ordered) - 1)] - ordered[lo]) * (at - lo)
    keep = [i for i, v in enumerate(values) if v > cut]
    room = int(len(values) * percentile / 100) - len(keep)
    keep += [i for i, v in enumerate(values) if v == cut][: max(room, 0)]
    return sorted(keep) or [max(range(len(values)), key=lambda i: values[i])]
