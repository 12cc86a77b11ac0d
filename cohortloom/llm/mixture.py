"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's target repetition rate is weight * total target / its size in characters. Each document's
count inverts the Poisson distribution of that mean at a uniform number hashed from its key, text and the
seed, so the same document always gets the same count. Documents are repeated by their count and put into
one global random order: a hash gives each copy its place, ranges of the hash are counted, and a row's
position is its range's offset plus its rank inside the range, so no task sorts more than a range.

Defined cases: a NULL source is a source of its own (weights may name it with None), a NULL text counts
no characters. A source without characters, or one the weights leave out, gets rate 0 when weights are
given and `epochs` when they are not. Repeated rows draw the same count, each for itself. Ties of the
order hash are broken by key and copy number.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.ranks import fresh, gapless
from cohortloom.session import materialise

#: More sources than these are joined by a shuffle; each carries one table of 24 deviations of its rate.
BROADCAST_SOURCES = 2000
_DIGITS = 13
_SCALE = float(16**_DIGITS)


def hash_number(*parts: Column) -> Column:
    """Whole number below 16^13 from the parts' text."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, _DIGITS), 16, 10).cast("long")


def poisson_table(rate: Column) -> Column:
    """struct(base, sums): cumulative Poisson probabilities of base, base + 1, ..., twelve deviations around the rate.

    Terms are summed from their logarithms, so a rate of any size keeps its digits.
    """
    base = F.greatest(F.floor(rate - 12 * F.sqrt(rate)), F.lit(0)).cast("int")
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    factorial = F.aggregate(F.sequence(F.lit(0), base), F.lit(0.0), lambda acc, k: acc + F.log(F.greatest(k, F.lit(1)).cast("double")))
    start = F.when(rate > 0, base * F.log(rate) - rate - factorial).otherwise(F.lit(0.0))
    steps = F.aggregate(
        F.sequence(base + 1, last),
        F.struct(start.alias("log"), F.array(F.exp(start)).alias("sums")),
        lambda acc, k: F.struct(
            (acc["log"] + F.log(rate / k)).alias("log"),
            F.concat(
                acc["sums"], F.array(F.element_at(acc["sums"], -1) + F.coalesce(F.exp(acc["log"] + F.log(rate / k)), F.lit(0.0)))
            ).alias("sums"),
        ),
    )
    return F.struct(base.alias("base"), steps["sums"].alias("sums"))


def poisson_count(uniform: Column, table: Column) -> Column:
    """Smallest count whose cumulative probability exceeds the uniform number."""
    return table["base"] + F.size(F.filter(table["sums"], lambda c: c <= uniform))


def source_rates(
    docs: DataFrame, source: str = "source", text: str = "text", weights: Mapping[str | None, float] | None = None,
    epochs: float = 1.0, temperature: float = 2.0,
) -> DataFrame:
    """(source, size, rate) with sum(rate * size) = epochs * all characters.

    Without weights a source's weight is size^(1 / temperature).
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(
        F.coalesce(F.sum(F.length(text)), F.lit(0)).cast("double").alias("size")
    )
    if weights is None:
        weight = F.sqrt("size") if temperature == 2.0 else F.pow("size", F.lit(1.0 / temperature))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    weighted = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(F.lit(0.0)))
    every = Window.partitionBy()  # one row per source
    rate = F.col("weight") / F.sum("weight").over(every) * (F.sum("size").over(every) * F.lit(float(epochs))) / F.col("size")
    empty = F.lit(float(epochs)) if weights is None else F.lit(0.0)
    return weighted.select("source", "size", F.when(F.col("size") > 0, F.coalesce(rate, F.lit(0.0))).otherwise(empty).alias("rate"))


def replicate(
    docs: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42,
    copy: str = "copy",
) -> DataFrame:
    """Each row of `docs` repeated by its Poisson count, with its copy number (from 0)."""
    (cdf, named, known) = fresh(docs, "_cdf", "_source", "_known")
    rates = materialise(rates, "rates")
    tables = rates.select(F.coalesce("source", F.lit("")).alias(named), F.col("source").isNull().alias(known), poisson_table(F.col("rate")).alias(cdf))
    uniform = hash_number(F.lit(f"count {seed}"), F.col(key), F.md5(F.coalesce(F.col(text), F.lit("")))) / F.lit(_SCALE)
    keyed = docs.withColumns({named: F.coalesce(F.col(source), F.lit("")), known: F.col(source).isNull()})
    if rates.count() <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    counted = keyed.join(tables, [named, known]).withColumn(cdf, poisson_count(uniform, F.col(cdf)))
    repeated = counted.where(F.col(cdf) > 0).select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(cdf) - 1)).alias(copy))
    return repeated


def global_order(rows: DataFrame, key: str = "doc_id", copy: str = "copy", seed: int = 42, bits: int = 14, out: str = "position") -> DataFrame:
    """The rows with their position (from 0) in a random order of all of them; `rows` is read three times."""
    (place, block) = fresh(rows, "_place", "_block")
    placed = rows.withColumn(place, hash_number(F.lit(f"order {seed}"), F.col(key), F.col(copy)))
    levels = max(0, (max(1, rows.count()) - 1).bit_length() - bits)
    placed = placed.withColumn(block, F.shiftright(place, 4 * _DIGITS - levels))
    return gapless(placed, [], block, [place, key, copy], out).drop(place, block)


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Mapping[str | None, float] | None = None,
    epochs: float = 1.0, seed: int = 42,
) -> DataFrame:
    """The mixed corpus: columns of `docs`, dealt at random over the partitions and inside them."""
    (place, copy) = fresh(docs, "_place", "_copy")
    repeated = replicate(docs, source_rates(docs, source, text, weights, epochs), key, source, text, seed, copy)
    spread = repeated.withColumn(place, hash_number(F.lit(f"order {seed}"), F.col(key), F.col(copy)))
    return spread.repartition(place).sortWithinPartitions(place, copy).drop(place, copy)


def oracle(epochs: float = 1.0, seed: int = 42) -> str:
    """`replicate` and `global_order` of `documents` in DuckDB SQL."""
    number = f"CAST('0x' || substr(md5(concat_ws('|', {{}})), 1, {_DIGITS}) AS BIGINT)"
    return f"""
    WITH sizes AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS size FROM documents GROUP BY source),
    rates AS (SELECT source, CASE WHEN size > 0 THEN sqrt(size) / sum(sqrt(size)) OVER () * sum(size) OVER () * {epochs} / size
      ELSE {epochs} END AS rate FROM sizes),
    terms AS (SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p FROM rates,
      generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT)) AS g(k)),
    cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
    drawn AS (SELECT doc_id, source, {number.format(f"'count {seed}', CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))")} / {_SCALE} AS u FROM documents),
    counted AS (SELECT d.doc_id, d.source, count(*) FILTER (WHERE c <= u) AS n FROM drawn d JOIN cdf
      ON d.source IS NOT DISTINCT FROM cdf.source GROUP BY d.doc_id, d.source),
    copies AS (SELECT doc_id, source, CAST(unnest(range(n)) AS INTEGER) AS copy FROM counted)
    SELECT doc_id, source, copy, row_number() OVER (ORDER BY {number.format(f"'order {seed}', CAST(doc_id AS VARCHAR), CAST(copy AS VARCHAR)")},
      doc_id, copy) - 1 AS position FROM copies"""
