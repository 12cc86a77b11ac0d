"""Counters of a run, observed while its tables are written: no table is read again to be counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from cohortloom.functions.text import norm_id
from cohortloom.operators import resolve as R
from cohortloom.session import materialise


def write_counted(df: DataFrame, label: str, **counters: Column) -> tuple[DataFrame, dict[str, int]]:
    """`df` written to the shared folder, and the counters (aggregates over it) of that write.

    The metrics are taken in the last stage of the write, where Spark counts each task once, repeated or not.
    An empty table counts nothing.
    """
    seen = Observation()
    written = materialise(df.observe(seen, *[c.cast("long").alias(n) for n, c in counters.items()]), label)
    found = seen.get
    return written, {n: int(found.get(n) or 0) for n in counters}


def run_counters(
    resolved: DataFrame,
    registry_a: DataFrame,
    registry_b: DataFrame,
    issues: DataFrame,
    columns: tuple[Sequence[str], Sequence[str], Sequence[str]],
    copies: tuple[int, int],
) -> DataFrame:
    """(counter, n) of a dataset build; the resolution is computed once, for the table that all others read.

    `columns` are those of `merge_sources` (preferred, only of A, only of B); `copies` the (copied, skipped) rows.
    A selected entity is a distinct normalised id of the samples, before its resolution; a sample without an id
    selects none.
    """
    hit = F.col("entity_id").isNotNull()
    table, counted = write_counted(
        resolved.withColumn("source_id", norm_id(F.col("raw_id"))), "resolved",
        selected_samples=F.count("*"), included_samples=F.count_if(hit), excluded_samples=F.count_if(~hit),
    )
    registry = registry_a.select("entity_id").distinct()
    sides = F.col("in_samples"), F.col("in_registry")
    chosen = table.select(F.col("source_id").alias("entity_id")).where("entity_id <> ''").distinct().withColumn("in_samples", F.lit(True))
    both = chosen.join(registry.withColumn("in_registry", F.lit(True)), "entity_id", "full")
    _, coverage = write_counted(
        both, "coverage",
        selected_entities=F.count(sides[0]), registry_rows=F.count(sides[1]),
        selected_missing_registry=F.count_if(sides[1].isNull()), registry_missing_sample=F.count_if(sides[0].isNull()),
    )
    entities = R.matched_rows(table).select("entity_id").distinct()
    _, merged = write_counted(
        R.merge_sources(entities, registry_a, registry_b, *columns), "merged",
        included_entities=F.count("*"), with_basic_data=F.count_if("has_basic_data"),
    )
    _, logged = write_counted(issues, "issues", source_issues=F.count("*"))
    every = counted | coverage | merged | logged | {"copied": copies[0], "skipped_existing": copies[1]}
    return resolved.sparkSession.createDataFrame(list(every.items()), "counter string, n long")
