"""Poisson replication, random order, exact shards and licence notices."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import dealing as D
from cohortloom.llm import licences as L
from cohortloom.llm import mixture as M
from cohortloom.llm import ranks as R

from .conftest import EDGE_TEXTS, rows_of


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.5, 900.0])
def test_poisson_table(spark, rate):
    row = spark.range(1).select(M.poisson_table(F.lit(rate)).alias("t")).collect()[0]["t"]
    sums, total = [], 0.0
    for k in range(row["base"] + len(row["sums"])):
        total += math.exp((k * math.log(rate) if k else 0.0) - rate - math.lgamma(k + 1)) if rate else float(k == 0)
        sums.append(total)
    assert row["sums"] == pytest.approx(sums[row["base"] :], abs=1e-9)
    draws = spark.range(2000).select((F.col("id") / 2000).alias("u")).select(M.poisson_count(F.col("u"), M.poisson_table(F.lit(rate))).alias("n"))
    mean = draws.agg(F.avg("n")).collect()[0][0]
    assert mean == pytest.approx(rate, rel=0.02, abs=0.01)


def test_rates_meet_the_weights(docs_of):
    docs = docs_of([(k, "x" * 100, "hot") for k in range(600)] + [(1000 + k, "y" * 50, "b") for k in range(200)] + [(5000, None, None), (5001, "", "none")])
    rates = {s: (size, rate) for s, size, rate in rows_of(M.source_rates(docs, weights={"hot": 1.0, "b": 3.0}, epochs=2.0))}
    assert rates["hot"][1] * 60000 == pytest.approx(0.25 * 2 * 70000) and rates["b"][1] * 10000 == pytest.approx(0.75 * 2 * 70000)
    assert rates[None] == (0.0, 0.0) and rates["none"] == (0.0, 0.0)
    rates = dict((s, r) for s, _, r in rows_of(M.source_rates(docs)))
    assert rates["hot"] / rates["b"] == pytest.approx(math.sqrt(10000 / 60000)) and rates[None] == rates["none"] == 1.0
    mixed = M.replicate(docs, M.source_rates(docs, weights={"hot": 1.0, "b": 3.0}, epochs=2.0))
    counts = {r["source"]: r["n"] for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert counts["hot"] == pytest.approx(350, rel=0.2) and counts["b"] == pytest.approx(2100, rel=0.1) and None not in counts
    assert mixed.select("fp", "_row", "shard").distinct().count() == 1


def test_mix_keeps_the_columns_and_repeats_whole_rows(docs_of):
    docs = docs_of([(k, t, s) for k, t, s in [(1, "a", "s"), (1, "a", "s"), (None, None, None), (2, "", "s")]])
    mixed = M.mix(docs, epochs=5.0)
    assert mixed.schema == docs.schema
    assert set(rows_of(mixed)) <= set(rows_of(docs)) and mixed.where("doc_id = 1").count() % 2 == 0
    assert M.mix(docs.limit(0)).count() == 0


def test_global_order_is_gapless(spark):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(0).alias("copy"), F.lit(1).alias("position"))
    placed = M.global_order(rows.drop("position"), bits=6).orderBy("doc_id").collect()
    assert sorted(r["position"] for r in placed) == list(range(5000))
    assert abs(np.corrcoef([r["position"] for r in placed], range(5000))[0, 1]) < 0.05


def test_gapless_positions_of_a_hot_group(spark):
    rows = spark.range(3000).select(F.col("id").alias("r"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("g"), F.shiftright("id", 5).alias("b"))
    found = collections.defaultdict(list)
    for r in R.gapless(rows, ["g"], "b", ["r"], "at").orderBy("r").collect():
        found[r["g"]].append(r["at"])
    assert all(x == list(range(len(x))) for x in found.values()) and len(found) == 8


def test_communication_matrix_is_exact_and_unbiased():
    counts = [500, 0, 1200, 3, 800]
    total = np.zeros((5, 7))
    for seed in range(300):
        m = np.array(D.communication_matrix(counts, D.exact_sizes(2503, 7), seed))
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == D.exact_sizes(2503, 7)
        total += m
    assert total / 300 == pytest.approx(np.outer(counts, D.exact_sizes(2503, 7)) / 2503, rel=0.06, abs=0.6)
    big = D.communication_matrix([10**10, 3 * 10**9], D.exact_sizes(13 * 10**9, 4), 1)
    assert [sum(r) for r in big] == [10**10, 3 * 10**9] and [sum(c) for c in zip(*big)] == D.exact_sizes(13 * 10**9, 4)


def test_large_draws_follow_the_law(monkeypatch):
    rng = np.random.default_rng(4)
    good, bad, draws = 3 * 10**9, 7 * 10**9, 200_000
    got = np.array([D._hypergeometric(rng, good, bad, draws) for _ in range(4000)])
    spread = (draws * 0.3 * 0.7 * (good + bad - draws) / (good + bad - 1)) ** 0.5
    assert got.mean() == pytest.approx(draws * 0.3, abs=4 * spread / 4000**0.5) and got.std() == pytest.approx(spread, rel=0.06)
    rare = np.array([D._hypergeometric(rng, 3, 10**10, 10**9) for _ in range(4000)])
    assert set(rare) <= {0, 1, 2, 3} and rare.mean() == pytest.approx(3 * 10**9 / (10**10 + 3), abs=0.04)
    # The inversion on a small population, against numpy's draws of the same law.
    exact = np.bincount(rng.hypergeometric(6, 14, 7, 40000), minlength=7) / 40000
    monkeypatch.setattr(D, "_NUMPY", 0)
    own = np.bincount([D._hypergeometric(rng, 6, 14, 7) for _ in range(40000)], minlength=7) / 40000
    assert own == pytest.approx(exact, abs=0.012)


def test_groups_of_blocks_keep_sizes(spark, docs_of, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_BITS", 3)
    monkeypatch.setattr(D, "GROUP", 4)
    docs = docs_of([(k, f"t{k}") for k in range(700)]).drop("shard")
    dealt = D.deal(docs, 5).collect()
    assert sorted(r["doc_id"] for r in dealt) == list(range(700))
    for s in range(5):
        assert sorted(r["slot"] for r in dealt if r["shard"] == s) == list(range(140))


def test_dealt_rows_are_whole_and_even(docs_of):
    docs = docs_of(EDGE_TEXTS + [(100 + k, f"t{k}") for k in range(500)])
    dealt = D.deal(docs.drop("shard"), 7)
    assert rows_of(dealt.drop("shard", "slot")) == rows_of(docs.drop("shard"))
    slots = collections.defaultdict(list)
    for r in dealt.collect():
        slots[r["shard"]].append(r["slot"])
    assert sorted(map(len, slots.values())) == sorted(D.exact_sizes(512, 7)) and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert D.deal(docs.limit(0), 3).count() == 0 and D.deal(docs, 3).columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]


def brute_notices(text):
    def grams(s):
        return set(L.bigrams(L.normal_words(s)))

    lines = (text or "").split("\n")
    units = [(k + 1, u) for k, u in enumerate(lines)] + ([(0, text)] if len(lines) > 1 else [])
    out = []
    for line, unit in units:
        g = grams(unit)
        hits = []
        for name, notice in L.TEMPLATES.items():
            t = grams(notice)
            if g and 2 * len(g & t) / (len(g) + len(t)) >= L.THRESHOLD:
                hits.append((-2 * len(g & t) / (len(g) + len(t)), name))
        out += [(line, n, -d, (d, n) == min(hits)) for d, n in hits]
    return out


def test_notices_match_brute_force(docs_of):
    notices = [t.upper() if k % 2 else f"{t} Indeed!" for k, t in enumerate(L.TEMPLATES.values())]
    texts = EDGE_TEXTS + [(50, "\n".join(notices)), (51, notices[1] + "\n"), (52, "words " * 9 + notices[3]), (53, "released\tunder--the MIT license\nx")]
    want = sorted((d is not None, d or 0, *m) for d, t in texts for m in brute_notices(t))
    got = sorted((r[0] is not None, r[0] or 0, *tuple(r)[1:]) for r in L.scan(docs_of(texts)).collect())
    assert got == want and len(want) > 12


def test_size_bounds_are_tight():
    for t in (0.5, 0.8, 1.0):
        for a in range(1, 40):
            low, high = L.size_bounds(a, t)
            assert [b for b in range(1, 200) if 2 * min(a, b) >= t * (a + b)] == list(range(low, high + 1))


def test_every_near_notice_holds_a_sure_pair():
    for name, notice in L.TEMPLATES.items():
        grams = L.bigrams(L.normal_words(notice))
        low, high = L.size_bounds(len(grams), 0.8)
        free = len(grams) - len(L.sure_pairs(grams, low, 0.8))
        assert all(2 * min(free, a) < 0.8 * (a + len(grams)) for a in range(low, high + 1)), name
