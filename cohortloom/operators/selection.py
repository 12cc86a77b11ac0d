"""Ranking, redundancy pruning and export of screened features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.ranking import average_ranks, running_totals
from cohortloom.operators.scoring import SCORE_ORDER, best_first, long_form
from cohortloom.session import materialise


def rank_features(
    scores: DataFrame, available: Sequence[str], data: DataFrame | None = None, order: Sequence[str] = SCORE_ORDER
) -> DataFrame:
    """Score rows of the available features, best first; constants dropped when `data` is given."""
    keys = [c for c in order if c in scores.columns]
    keep = list(available)
    if data is not None:
        # Two distinct values exist exactly when min and max differ: no distinct shuffle needed.
        spread = data.agg(*[(F.min(c) < F.max(c)).alias(c) for c in keep]).first()
        keep = [c for c in keep if spread[c]]
    return scores.where(F.col("feature_name").isin(keep)).orderBy(*best_first(keys))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    """Best k by combined score among the selected rows (all rows when there is no flag)."""
    rows = scores.where(F.col("selected") == 1) if "selected" in scores.columns else scores
    return rows.orderBy(*best_first(["combined_score"])).limit(k)


def nested_sets(ranked: Sequence[str], sizes: Sequence[int | str]) -> dict[str, list[str]]:
    """Nested top-n name lists, clamped to what exists; `all` keeps every name."""
    out: dict[str, list[str]] = {}
    for size in sizes:
        n = len(ranked) if size == "all" else min(int(size), len(ranked))
        out["top_all" if size == "all" else f"top_{n}"] = list(ranked[:n])
    return out


def pair_spearman(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, n, rho): Spearman rho of every feature pair over the rows where both are present.

    Columns without gaps are ranked once and all their pairs come from one pass that adds up products of ranks; only
    pairs with a gap are ranked again, over the rows that they share.
    """
    names = sorted(features)
    spark = df.sparkSession
    numbers = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in names}
    rows = materialise(df.select(F.monotonically_increasing_id().alias("_row"), *[v.alias(c) for c, v in numbers.items()]), "pair-rows")
    seen = rows.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in names]).first()
    whole = [c for c in names if seen[c] == seen["_n"]]
    found = []
    if len(whole) > 1 and seen["_n"]:
        sums = rank_products(rows, whole)
        for i, j in combinations(range(len(whole)), 2):
            spread = float(np.sqrt(sums[i, i] * sums[j, j]))
            found.append((whole[i], whole[j], seen["_n"], float(sums[i, j]) / spread if spread else None))
    out = spark.createDataFrame(found, "feature_a string, feature_b string, n bigint, rho double")
    gaps = [(a, b) for a, b in combinations(names, 2) if not {a, b} <= set(whole) and seen[a] and seen[b]]
    return out.unionByName(_gap_pairs(rows, gaps)) if gaps else out


def rank_products(rows: DataFrame, features: Sequence[str]) -> np.ndarray:
    """Sums of products of centred average ranks of columns without gaps; `rows` has a unique `_row`.

    Each task keeps one matrix of features by features; blocks of rows are ranked columns brought together by row.
    """
    places = {c: k for k, c in enumerate(features)}
    long = long_form(rows, features, ["_row"])
    ranks = average_ranks(long, ["feature_name"], "value")
    ranks = ranks.select("feature_name", "value", (F.col("avg_rank") - (F.col("n_total") + 1) / 2.0).alias("rank"))
    joined = long.join(ranks, ["feature_name", "value"]).groupBy("_row").pivot("feature_name", list(features)).agg(F.first("rank"))
    k = len(places)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    parts = joined.select(F.array(*features)).mapInArrow(add, "part binary").collect()
    return sum((np.frombuffer(r["part"], float).reshape(k, k) for r in parts), np.zeros((k, k)))


def _gap_pairs(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """The same for single pairs: one explode of the pairs per row, reduced at once to distinct (pair, x, y) cells."""
    cells = df.select(
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(a).alias("x"), F.col(b).alias("y"))
                    for a, b in pairs
                ]
            )
        ).alias("p")
    ).select("p.*")
    keys = ["feature_a", "feature_b"]
    present = cells.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    # Written once: the cells and both rank tables below read the counts, not the table again.
    cells = materialise(present.groupBy(*keys, "x", "y").agg(F.count("*").alias("n")), "pair-cells")

    def ranks(axis: str) -> DataFrame:
        sums = cells.groupBy(*keys, axis).agg(F.sum("n").alias("n"))
        return running_totals(sums, keys, axis, ["n"]).select(
            *keys,
            axis,
            (F.col("n_below") + (F.col("n") + 1) / 2.0 - (F.col("n_total") + 1) / 2.0).alias(f"r{axis}"),
        )

    joined = cells.join(ranks("x"), keys + ["x"]).join(ranks("y"), keys + ["y"])
    n, a, b = F.col("n"), F.col("rx"), F.col("ry")
    m = joined.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(n * a * a).alias("saa"),
        F.sum(n * b * b).alias("sbb"),
        F.sum(n * a * b).alias("sab"),
    )
    spread = F.sqrt(F.col("saa") * F.col("sbb"))
    return m.select(*keys, "n", F.try_divide(F.col("sab"), spread).alias("rho"))


def prune_correlated(ranked: Sequence[str], df: DataFrame, threshold: float) -> list[str]:
    """Keep a feature only if it stays below the threshold with every kept one; constants are skipped.

    Spark computes the whole pair matrix; the walk itself is over a handful of names.
    """
    names = [f for f in ranked if f in df.columns]
    if not names:
        return []
    spread = df.agg(*[(F.min(c) < F.max(c)).alias(c) for c in names]).first()
    names = [f for f in names if spread[f]]
    if len(names) < 2:
        return names
    rho = {frozenset((r.feature_a, r.feature_b)): r.rho for r in pair_spearman(df, names).collect()}
    kept: list[str] = []
    for name in names:
        against = [rho.get(frozenset((name, k))) for k in kept]
        if all(r is None or abs(r) < threshold for r in against):
            kept.append(name)
    return kept


def flag_selected(scores: DataFrame, selected: Sequence[str]) -> DataFrame:
    return scores.withColumn("selected", F.col("feature_name").isin(list(selected)).cast("int"))


def modeling_subset(df: DataFrame, meta: Sequence[str], selected: Sequence[str]) -> DataFrame:
    """Metadata columns that exist, then the selected features."""
    return df.select(*[c for c in meta if c in df.columns], *selected)
