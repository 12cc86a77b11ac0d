"""Univariate screening of features against a binary label and an ordinal severity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.functions.distributions import chi2_pvalue, correlation_pvalue
from cohortloom.functions.numeric import coerce_numeric, mean_of_present
from cohortloom.operators.ranking import running_totals
from cohortloom.session import materialise

SCORE_ORDER = ("combined_score", "binary_corr_abs", "severity_spearman_abs")


def best_first(scores: Sequence[str]) -> list[Column]:
    """Sort order by score columns, missing last, then by name.

    Twelve digits decide: the last bits of a distributed sum depend on task order and must not.
    """
    return [*[F.round(F.col(c), 12).desc_nulls_last() for c in scores], F.col("feature_name")]


def long_form(df: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """(ids, feature_name, value) with NULL and NaN values removed."""
    ready = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    out = ready.unpivot(list(ids), list(features), "feature_name", "value")
    return out.where(F.col("value").isNotNull() & ~F.isnan("value"))


def _weighted(rows: DataFrame) -> DataFrame:
    """Long rows as cells with a count `n`: every row counts once unless it says otherwise."""
    return rows if "n" in rows.columns else rows.withColumn("n", F.lit(1).cast("long"))


def score_cells(long: DataFrame, label: str = "label", severity: str = "severity") -> DataFrame:
    """Row counts per distinct (feature, value, label, severity): all that every score needs."""
    return _weighted(long).groupBy("feature_name", "value", label, severity).agg(F.sum("n").alias("n"))


def _class_moments(rows: DataFrame, label: str) -> DataFrame:
    """Counts, class means and centred sums per feature, in two passes that shuffle partial sums only.

    The per-feature means are broadcast: one row per column of the screened table.
    """
    rows = _weighted(rows).where(F.col(label).isNotNull())
    n, v, y = F.col("n"), F.col("value"), F.col(label).cast("double")
    pos, neg = F.col(label) == 1, F.col(label) == 0
    base = rows.groupBy("feature_name").agg(
        F.sum(n).alias("binary_n"),
        F.sum(F.when(pos, n).otherwise(0)).alias("n_pos"),
        F.sum(F.when(neg, n).otherwise(0)).alias("n_neg"),
        (F.min(v) == F.max(v)).alias("constant"),
        (F.sum(n * v) / F.sum(n)).alias("mean"),
        (F.sum(n * y) / F.sum(n)).alias("label_mean"),
        F.try_divide(F.sum(F.when(neg, n * v)), F.sum(F.when(neg, n)).cast("double")).alias("binary_mean_neg"),
        F.try_divide(F.sum(F.when(pos, n * v)), F.sum(F.when(pos, n)).cast("double")).alias("binary_mean_pos"),
    )
    d, e = v - F.col("mean"), y - F.col("label_mean")
    own = v - F.when(pos, F.col("binary_mean_pos")).when(neg, F.col("binary_mean_neg"))
    sums = (
        rows.join(F.broadcast(base), "feature_name")
        .groupBy("feature_name")
        .agg(
            F.sum(n * d * d).alias("sxx"), F.sum(n * e * e).alias("syy"), F.sum(n * d * e).alias("sxy"),
            F.sum(n * own * own).alias("within"),
        )
    )
    return base.join(F.broadcast(sums), "feature_name")


def _usable() -> Column:
    return (F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("binary_n") >= 3) & ~F.col("constant")


def pearson_binary(long: DataFrame, label: str = "label") -> DataFrame:
    """Pearson r with a 0/1 label, its p-value and the class means; r is NULL for unusable features."""
    spread = F.sqrt(F.col("sxx") * F.col("syy"))
    r = F.when(_usable(), F.try_divide(F.col("sxy"), spread))
    return _class_moments(long, label).select(
        "feature_name",
        "binary_n",
        r.alias("binary_corr"),
        correlation_pvalue(r, F.col("binary_n").cast("double")).alias("binary_corr_pvalue"),
        "binary_mean_neg",
        "binary_mean_pos",
    )


def cohens_d(long: DataFrame, label: str = "label") -> DataFrame:
    """Standardised mean difference; NULL below two rows per class or without spread."""
    pooled = F.col("within") / F.greatest(F.col("n_neg") + F.col("n_pos") - 2, F.lit(1))
    ok = _usable() & (F.col("n_neg") >= 2) & (F.col("n_pos") >= 2) & (pooled > 0)
    d = (F.col("binary_mean_pos") - F.col("binary_mean_neg")) / F.when(ok, F.sqrt(pooled))
    return _class_moments(long, label).select("feature_name", d.alias("binary_effect_size_d"))


def feature_auc(long: DataFrame, label: str = "label") -> DataFrame:
    """ROC AUC of each single feature, ties counted half; NULL for one class or a constant feature."""
    counts = (
        _weighted(long)
        .where(F.col(label).isNotNull())
        .groupBy("feature_name", "value")
        .agg(
            F.sum(F.when(F.col(label) == 1, F.col("n")).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col(label) == 0, F.col("n")).otherwise(0)).alias("neg"),
        )
    )
    return auc_from_counts(counts, ["feature_name"], "value").select(
        "feature_name",
        F.when((F.col("n_pos") + F.col("n_neg") >= 3) & (F.col("n_values") > 1), F.col("auc")).alias("binary_auc"),
    )


def auc_from_counts(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """AUC per group from (value, pos, neg) counts: the share of (pos, neg) pairs ranked right."""
    ranked = running_totals(counts, keys, value, ["pos", "neg"])
    wins = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)
    agg = ranked.groupBy(*keys) if keys else ranked.groupBy()
    agg = agg.agg(
        F.sum(wins.cast("double")).alias("wins"),
        F.max("pos_total").alias("n_pos"),
        F.max("neg_total").alias("n_neg"),
        F.count("*").alias("n_values"),
    )
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    return agg.select(*keys, "n_pos", "n_neg", "n_values", F.when(pairs > 0, F.col("wins") / pairs).alias("auc"))


def _severity_cells(long: DataFrame, severity: str) -> DataFrame:
    """Per (feature, value, grade): row count, average rank of the value and of the grade."""
    cells = (
        _weighted(long)
        .where(F.col(severity).isNotNull())
        .groupBy("feature_name", "value", F.col(severity).cast("double").alias("grade"))
        .agg(F.sum("n").alias("n"))
    )
    # The few grades of a value ride along in its row, so its rank needs no join back.
    by_value = cells.groupBy("feature_name", "value").agg(
        F.sum("n").alias("n"), F.collect_list(F.struct("grade", F.col("n").alias("n_grade"))).alias("grades")
    )
    ranked = running_totals(by_value, ["feature_name"], "value", ["n"]).select(
        "feature_name", "n_total", (F.col("n_below") + (F.col("n") + 1) / 2.0).alias("value_rank"), F.explode("grades").alias("g")
    )
    by_grade = cells.groupBy("feature_name", "grade").agg(F.sum("n").alias("n"))
    grade_rank = running_totals(by_grade, ["feature_name"], "grade", ["n"]).select(
        "feature_name", "grade", (F.col("n_below") + (F.col("n") + 1) / 2.0).alias("grade_rank")
    )
    return ranked.select(
        "feature_name", "n_total", "value_rank", "g.grade", F.col("g.n_grade").alias("n")
    ).join(grade_rank, ["feature_name", "grade"])


def _severity_sums(long: DataFrame, severity: str) -> DataFrame:
    """One row per (feature, grade) of centred rank sums; everything below is arithmetic on it."""
    mid = (F.col("n_total") + 1) / 2.0
    a, b, n = F.col("value_rank") - mid, F.col("grade_rank") - mid, F.col("n")
    return (
        _severity_cells(long, severity)
        .groupBy("feature_name", "grade")
        .agg(
            F.sum("n").alias("n"),
            F.sum(n * a).alias("sa"),
            F.sum(n * a * a).alias("saa"),
            F.sum(n * b * b).alias("sbb"),
            F.sum(n * a * b).alias("sab"),
        )
    )


def severity_association(long: DataFrame, severity: str = "severity") -> DataFrame:
    """Spearman rho and Kruskal-Wallis H per feature with their p-values.

    H equals (N - 1) * SSB / SST of the average ranks, which already holds the tie correction.
    """
    per_grade = _severity_sums(long, severity)
    m = per_grade.groupBy("feature_name").agg(
        F.sum("n").alias("severity_n"),
        F.count("*").alias("grades"),
        F.sum("saa").alias("saa"),
        F.sum("sbb").alias("sbb"),
        F.sum("sab").alias("sab"),
        F.sum(F.col("sa") * F.col("sa") / F.col("n")).alias("between"),
    )
    ok = (F.col("grades") >= 2) & (F.col("severity_n") >= 3) & (F.col("saa") > 0)
    rho = F.when(ok, F.try_divide(F.col("sab"), F.sqrt(F.col("saa") * F.col("sbb"))))
    h = F.when(ok, F.try_divide((F.col("severity_n") - 1) * F.col("between"), F.col("saa")))
    return m.select(
        "feature_name",
        "severity_n",
        rho.alias("severity_spearman_rho"),
        correlation_pvalue(rho, F.col("severity_n").cast("double")).alias("severity_spearman_pvalue"),
        h.alias("severity_kruskal_stat"),
        chi2_pvalue(h, (F.col("grades") - 1).cast("double")).alias("severity_kruskal_pvalue"),
    )


def spearman(long: DataFrame, severity: str = "severity") -> DataFrame:
    return severity_association(long, severity).select(
        "feature_name", "severity_n", "severity_spearman_rho", "severity_spearman_pvalue"
    )


def kruskal(long: DataFrame, severity: str = "severity") -> DataFrame:
    return severity_association(long, severity).select(
        "feature_name", "severity_n", "severity_kruskal_stat", "severity_kruskal_pvalue"
    )


def feature_scores(
    df: DataFrame, features: Sequence[str], label: str = "label", severity: str = "severity"
) -> DataFrame:
    """Full screening table: one row per feature, all parts left-joined onto the feature list."""
    data = df.select(F.col(label).alias("label"), F.col(severity).alias("severity"), *features)
    # The table is read once: the counts are written, and every score below reads the small copy.
    cells = materialise(score_cells(long_form(data, features, ["label", "severity"])), "score-cells")
    # Names come from the schema, so the list is as long as the table is wide; it never grows with rows.
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature_name string")
    table = (
        names.join(pearson_binary(cells), "feature_name", "left")
        .join(feature_auc(cells), "feature_name", "left")
        .join(cohens_d(cells), "feature_name", "left")
        .join(severity_association(cells), "feature_name", "left")
    )
    table = table.withColumns(
        {
            "binary_n": F.coalesce("binary_n", F.lit(0)),
            "severity_n": F.coalesce("severity_n", F.lit(0)),
            "binary_corr_abs": F.abs("binary_corr"),
            "severity_spearman_abs": F.abs("severity_spearman_rho"),
            "binary_auc_distance": F.abs(F.col("binary_auc") - 0.5),
            "binary_effect_size_abs": F.abs("binary_effect_size_d"),
        }
    )
    parts = ("binary_corr_abs", "severity_spearman_abs", "binary_auc_distance", "binary_effect_size_abs")
    table = table.withColumn("combined_score", mean_of_present(*[F.col(p) for p in parts]))
    return table.orderBy(*best_first(SCORE_ORDER))


def numeric_features(
    df: DataFrame, prefix: str = "", deny: Sequence[str] = (), parseable: bool = False
) -> list[str]:
    """Feature columns by schema: numeric, with the prefix, not denied.

    With `parseable`, text columns count too when at least one value reads as a number (one pass).
    """
    names = [f for f in df.schema if f.name.startswith(prefix) and f.name not in set(deny)]
    if not parseable:
        return [f.name for f in names if isinstance(f.dataType, T.NumericType)]
    counts = parseable_counts(df, [f.name for f in names]).first()
    return [f.name for f in names if counts and counts[f.name] > 0]


def parseable_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(*[F.count(coerce_numeric(F.col(c).cast("string"))).alias(c) for c in columns])
