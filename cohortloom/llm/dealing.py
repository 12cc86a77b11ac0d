"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

The rows are written once with row ids; a block of consecutive ids of one written partition is a "partition" of the
method. The numbers of rows that each block sends to each shard are multivariate hypergeometric, drawn in two
steps of that law: blocks fall by hash into groups of about GROUP blocks, the driver draws what each group
sends (a thousandth of the blocks times shards numbers, no rows), and a task per group divides its own
row of the matrix among its blocks. Inside each block the rows are permuted by a seeded hash and cut at the drawn
counts, exchanged, and permuted again inside their shard by a second hash. Every assignment of rows to slots is
equally likely up to the quality of the hash, and shard sizes differ by one at most.

Defined cases: NULLs in any column travel with their row; very long texts are only carried; rows with equal
columns are rows of their own, and ties of a hash are broken by the row id; an empty table gives no rows;
columns named like the results are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.ranks import block_of, fresh, gapless, hash_block, with_row_ids
from cohortloom.session import materialise

BLOCK_BITS = 18
SLOT_BITS = 14
#: Blocks whose rows of the matrix one task draws.
GROUP = 1024
#: Populations from which numpy draws by itself.
_NUMPY = 10**9
#: Standard deviations around the mode that a draw can see: beyond them lies less than 2^-53.
_REACH = 12


def exact_sizes(total: int, shards: int) -> list[int]:
    """Shard sizes that differ by one at most."""
    return [total // shards + (s < total % shards) for s in range(shards)]


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among the draws, by numpy or, for larger populations, by inverting the distribution function.

    The probabilities around the mode follow from the ratios of neighbours, so the law is the same at any size,
    up to rounding.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    total = good + bad
    if total < _NUMPY:
        return int(rng.hypergeometric(good, bad, draws))
    p = good / total
    mode = (draws + 1) * (good + 1) // (total + 2)
    reach = 64 + math.ceil(_REACH * math.sqrt(draws * p * (1 - p) * ((total - draws) / (total - 1))))
    low, high = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    upto = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(upto, rng.random() * upto[-1], side="right"))


def communication_matrix(counts: Sequence[int], sizes: Sequence[int], seed: int | Sequence[int]) -> list[list[int]]:
    """Rows that each block (of so many rows) sends to each shard (of such a size)."""
    if sum(counts) != sum(sizes):
        raise ValueError("blocks and shards hold different numbers of rows")
    rng = np.random.default_rng(seed)
    left = list(sizes)
    matrix = []
    for count in counts:
        row, draws, rest = [], count, sum(left)
        for s, room in enumerate(left):
            rest -= room
            sent = _hypergeometric(rng, room, rest, draws)
            row.append(sent)
            draws -= sent
            left[s] -= sent
        matrix.append(row)
    return matrix


def _cuts(counts: DataFrame, block: str, upto: str, shards: int, seed: int) -> tuple[DataFrame, int]:
    """(block, upto): the running totals over shards of the rows that the block sends; and the number of all rows.

    `counts` has a row for each block: the block and `count`.
    """
    spark = counts.sparkSession
    groups = max(1, counts.count() // GROUP)
    grouped = counts.select(F.pmod(F.xxhash64(block), F.lit(groups)).alias("group"), F.col(block).alias("block"), "count")
    totals = sorted((r[0], r[1]) for r in grouped.groupBy("group").agg(F.sum("count")).collect())
    total = sum(n for _, n in totals)
    matrix = communication_matrix([n for _, n in totals], exact_sizes(total, shards), seed)
    sizes = spark.createDataFrame([(g, row) for (g, _), row in zip(totals, matrix)], "`group` bigint, sizes array<bigint>")

    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        own = communication_matrix([int(n) for n in rows["count"]], [int(n) for n in rows["sizes"].iloc[0]], [seed, int(rows["group"].iloc[0])])
        return pd.DataFrame({block: rows["block"].to_numpy(), upto: [np.cumsum(sent).tolist() for sent in own]})

    cuts = grouped.join(sizes, "group").groupBy("group").applyInPandas(divide, f"`{block}` bigint, `{upto}` array<bigint>")
    return cuts, total


def deal(rows: DataFrame, shards: int, seed: int = 42, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """The rows with their shard (int) and their slot in it (long, gapless from 0)."""
    rows = rows.drop(*[c for c in rows.columns if c.lower() in (shard.lower(), slot.lower())])
    (row, block, upto, at, mixed, part) = fresh(rows, "_row", "_block", "_upto", "_at", "_mixed", "_part")
    placed = with_row_ids(rows, row, "deal").withColumn(block, block_of(row, BLOCK_BITS))
    cuts, total = _cuts(materialise(placed.groupBy(block).count(), "blocks"), block, upto, shards, seed)
    first = Window.partitionBy(block).orderBy(F.xxhash64(F.lit(f"first {seed}"), row), row)
    local = placed.withColumn(at, F.row_number().over(first) - 1).join(cuts, block)
    sent = local.withColumn(shard, F.size(F.filter(upto, lambda c: c <= F.col(at))).cast("int")).drop(at, upto, block)
    sent = sent.withColumn(mixed, F.xxhash64(F.lit(f"second {seed}"), row))
    sent = sent.withColumn(part, hash_block(F.col(mixed), math.ceil(total / shards), SLOT_BITS))
    return gapless(sent, [shard], part, [mixed, row], slot).drop(row, mixed, part)
