"""Exact ranks, running sums and quantiles that never put one whole group into one task.

A plain `rank() over (partition by feature order by value)` sorts all rows of a feature in one task.
Here groups are first reduced to their distinct values; these are range-partitioned by group and value
over sampled splitters, totals per range fit a small window, and ranks inside a range are shifted by the
total of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise


def ordered_ranges(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """`df` with `_range`, the number of its range of (keys, value): larger values never have a smaller one.

    Spark samples the splitters, so ranges are even however the values crowd, and a group is as many
    ranges as its share of the rows. Another run would sample others: the table is written with the
    numbers, and all later steps read that.
    """
    ranged = df.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id())
    return materialise(ranged, "ranges")


def running_totals(df: DataFrame, keys: Sequence[str], value: str, counts: Sequence[str]) -> DataFrame:
    """Add `<count>_below` (sum over smaller values) and `<count>_total` for each count column.

    `df` must hold one row per (keys, value); values must be non-NULL doubles.
    """
    keys = list(keys)
    cells = [*keys, "_range"]
    cut = ordered_ranges(df, keys, value)
    totals = cut.groupBy(*cells).agg(*[F.sum(c).alias(c) for c in counts])
    # Windows over range totals: bounded by the number of ranges, not by rows.
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = totals.select(
        *cells,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_offset") for c in counts],
        *[F.sum(c).over(whole).alias(f"{c}_total") for c in counts],
    )
    inside = Window.partitionBy(*cells).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(offsets, cells)
    return out.select(
        *df.columns,
        *[(F.col(f"_{c}_offset") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_below") for c in counts],
        *[f"{c}_total" for c in counts],
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per (keys, value): its row count `n` and the average rank its rows share."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running_totals(counts, keys, value, ["n"]).select(
        *keys, value, "n", "n_total", (F.col("n_below") + (F.col("n") + 1) / 2.0).alias("avg_rank")
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated exact quantiles per group; `probs` maps output names to fractions."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return quantiles_of_counts(counts, keys, value, probs)


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The same from counts `n` per distinct (keys, value)."""
    ranked = running_totals(counts, keys, value, ["n"])

    def at(position: Column) -> Column:
        here = (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n"))
        return F.max(F.when(here, F.col(value)))

    aggs = []
    for name, q in probs.items():
        position = (F.col("n_total") - 1) * F.lit(float(q))
        aggs += [
            at(F.floor(position)).alias(f"_{name}_lo"),
            at(F.ceil(position)).alias(f"_{name}_hi"),
            F.max(position - F.floor(position)).alias(f"_{name}_t"),
        ]
    picked = ranked.groupBy(*keys).agg(*aggs)
    return picked.select(
        *keys,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_t")).alias(n)
            for n in probs
        ],
    )


def hash_ordinals(df: DataFrame, keys: Sequence[str], id_col: str, seed: int, name: str) -> DataFrame:
    """Add a 0-based position of each row inside its group, in md5(seed:id) order.

    The order is reproducible in any engine and uniform, so its first four hex digits cut each group
    into 65,536 even buckets; `id_col` must be unique inside a group.
    """
    keys = list(keys)
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, 4))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hashed.groupBy(*keys, "_b")
        .agg(F.count("*").alias("_n"))
        .select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    return hashed.join(offsets, keys + ["_b"]).select(
        *df.columns, (F.col("_offset") + F.row_number().over(inside) - 1).cast("long").alias(name)
    )
