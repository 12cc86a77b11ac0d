"""Row ids and gapless positions inside groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import materialise

BLOCK_BITS = 16


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` does not have yet, one for each of `names`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def with_row_ids(df: DataFrame, name: str, label: str) -> DataFrame:
    """Write `df` once with a unique id per row, so that every later read sees the same ids."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), label)


def block_of(row: str, bits: int = BLOCK_BITS) -> Column:
    """Runs of at most 2^bits consecutive rows of one written partition."""
    return F.shiftright(F.col(row), bits)


def hash_block(hashed: Column, rows: int, bits: int = BLOCK_BITS) -> Column:
    """Range of an even 64-bit hash; ranges grow in number with `rows` and keep about 2^bits rows each."""
    levels = max(0, (max(1, rows) - 1).bit_length() - bits)
    return F.lit(0).cast("long") if levels == 0 else F.shiftright(hashed, 64 - levels)


def gapless(df: DataFrame, keys: Sequence[str], block: str, order: Sequence[str], out: str) -> DataFrame:
    """Position (from 0) of each row in its group of `keys`, by block and then by `order` inside it.

    Keys must not be NULL and `df` must give the same rows when read twice. Only a block is sorted in a
    task; the running totals are over one row for each block of a group.
    """
    (total, before, local) = fresh(df, "_total", "_before", "_local")
    at = [*keys, block]
    counts = df.groupBy(*at).agg(F.count(F.lit(1)).alias(total))
    earlier = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*at, F.coalesce(F.sum(total).over(earlier), F.lit(0)).alias(before))
    inside = F.row_number().over(Window.partitionBy(*at).orderBy(*order)) - 1
    ranked = df.withColumn(local, inside).join(counts, at)
    return ranked.select(*df.columns, (F.col(before) + F.col(local)).cast("long").alias(out))
