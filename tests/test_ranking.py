import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators.ranking import average_ranks, exact_quantiles, hash_ordinals, ordered_ranges, running_totals


def test_ranges_keep_the_order(spark):
    rng = random.Random(5)
    values = [0.0, float("inf"), float("-inf"), 5e-324, 1.7e308, 1.0, np.nextafter(1.0, 0), np.nextafter(1.0, 2)]
    for p in range(-60, 60):
        values += [2.0**p, np.nextafter(2.0**p, 0), -(2.0**p)]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(500)]
    values = sorted({float(v) for v in values})
    df = spark.createDataFrame([(v, 1) for v in values], "v double, n long")
    cells = sorted((r["v"], r["_range"]) for r in ordered_ranges(df, [], "v").collect())
    assert all(x[1] <= y[1] for x, y in zip(cells, cells[1:]))
    found = sorted((r["v"], r["n_below"], r["n_total"]) for r in running_totals(df, [], "v", ["n"]).collect())
    assert found == [(v, i, len(values)) for i, v in enumerate(values)]


def test_quantiles_with_one_group_holding_most_rows(spark):
    rng = random.Random(1)
    rows = [("hot", rng.choice([1.5, -2.0, 1e6 * rng.random(), -rng.random()])) for _ in range(900)]
    rows += [(f"g{i % 20}", rng.gauss(0, 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"p5": 0.05, "p50": 0.5, "p95": 0.95}
    for r in exact_quantiles(df, ["k"], "v", probs).collect():
        mine = [v for k, v in rows if k == r.k]
        assert np.allclose([r.p5, r.p50, r.p95], np.percentile(mine, [5, 50, 95]))


def test_average_ranks_share_ties(spark):
    df = spark.createDataFrame([("f", v) for v in (1.0, 2.0, 2.0, 9.0)], "k string, v double")
    got = {r.v: r.avg_rank for r in average_ranks(df, ["k"], "v").collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 9.0: 4.0}


def test_hash_ordinals_are_the_global_order(spark):
    df = spark.range(500).select(F.lit("a").alias("k"), F.col("id"))
    got = {r.id: r.pos for r in hash_ordinals(df, ["k"], "id", 7, "pos").collect()}
    order = sorted(range(500), key=lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest())
    assert got == {i: p for p, i in enumerate(order)}


@pytest.mark.parametrize("step", [7.0, 1e-9], ids=["common offset", "nested cluster"])
def test_crowded_values_spread_over_ranges(spark, step):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        base = F.when(F.col("id") % 100 == 0, F.col("id") * 1e6).otherwise(1.0 + F.col("id") * step / 4000)
        rows = spark.range(4000).select(F.lit("g").alias("k"), base.cast("double").alias("v"), F.lit(1).cast("long").alias("n"))
        sizes = [r["count"] for r in ordered_ranges(rows, ["k"], "v").groupBy("_range").count().collect()]
        found = [(r["v"], r["n_below"]) for r in running_totals(rows, ["k"], "v", ["n"]).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(sizes) <= 2 * 4000 / len(sizes)
    assert [b for _, b in sorted(found)] == list(range(4000))


def test_one_hot_group_among_small_ones(spark):
    key = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    rows = spark.range(6000).select(key.alias("k"), (-F.col("id")).cast("double").alias("v"), F.lit(2).cast("long").alias("n"))
    of_key = {}
    for r in rows.collect():
        of_key.setdefault(r["k"], []).append(r["v"])
    want = {(k, v): (2 * i, 2 * len(vs)) for k, vs in of_key.items() for i, v in enumerate(sorted(vs))}
    found = {(r["k"], r["v"]): (r["n_below"], r["n_total"]) for r in running_totals(rows, ["k"], "v", ["n"]).collect()}
    assert found == want


def test_ranks_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "k string, v double")
    assert average_ranks(empty, ["k"], "v").collect() == []
    assert exact_quantiles(empty, ["k"], "v", {"m": 0.5}).collect() == []
