import random

import pytest
from pyspark.sql import functions as F

from cohortloom.functions.numeric import blend
from cohortloom.operators import evaluate as E
from cohortloom.operators import ranking


@pytest.fixture(scope="module")
def probs(spark):
    rows = [("s1", 1, 2024, 1, 0.2), ("s2", 1, 2025, 1, 0.7), ("s3", 1, 2025, 1, 0.5), ("s4", 2, 2025, 0, 0.4)]
    return spark.createDataFrame(rows, "sample_id string, entity_id int, year int, label int, prob double")


def by_entity(df):
    return {r.entity_id: r.prob for r in df.collect()}


def test_entity_aggregations(probs):
    assert by_entity(E.aggregate_entities(probs, "prob_mean"))[1] == pytest.approx(0.46667, abs=1e-5)
    assert by_entity(E.aggregate_entities(probs, "prob_max")) == {1: 0.7, 2: 0.4}
    assert 0.45 < by_entity(E.aggregate_entities(probs, "logit_mean"))[1] < 0.46
    weighted = (0.2 * 0.3 + 0.7 * 0.7 + 0.5 * 0.7) / 1.7
    assert by_entity(E.aggregate_entities(probs, "year_weighted_mean"))[1] == pytest.approx(weighted)
    with pytest.raises(ValueError):
        E.aggregate_entities(probs, "other")


def test_inconsistent_labels_are_an_error(spark):
    df = spark.createDataFrame([(1, 0, 0.1, 2024), (1, 1, 0.2, 2025)], "entity_id int, label int, prob double, year int")
    with pytest.raises(Exception, match="Inconsistent labels"):
        E.aggregate_entities(df, "prob_mean").collect()


def test_threshold_and_blend(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.4), (1, 0.6), (1, 0.9)], "label int, prob double")
    best = E.threshold_observed(df, "label", "prob").first()
    assert (best.threshold, best.f1) == (0.5, 1.0)
    assert E.threshold_observed(df.limit(0), "label", "prob").first().threshold == 0.5
    two = spark.createDataFrame([(0.2, 0.8), (0.6, 0.4)], "a double, b double")
    assert [round(r.m, 6) for r in two.select(blend(F.col("a"), F.col("b"), 0.25).alias("m")).collect()] == [0.65, 0.45]


def brute_force(rows):
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    ap, last = 0.0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        tp, seen = sum(p >= t for p in pos), sum(p >= t for _, p in rows)
        ap += (tp - last) / len(pos) * tp / seen
        last = tp
    return auc, ap


def test_rank_metrics_with_a_hot_group(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else "cold", int(rng.random() < 0.3), round(rng.random(), 2)) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, label int, prob double")
    for r in E.binary_metrics(df, "label", "prob", 0.6, ["k"]).collect():
        mine = [(y, p) for k, y, p in rows if k == r.k]
        auc, ap = brute_force(mine)
        assert (r.auc_roc, r.auc_pr) == (pytest.approx(auc), pytest.approx(ap))
        tp = sum(y == 1 and p >= 0.6 for y, p in mine)
        fp = sum(y == 0 and p >= 0.6 for y, p in mine)
        assert r.precision == pytest.approx(tp / (tp + fp))
    point = E.confusion_metrics(df, "label", "prob", 0.6).first()
    whole = E.binary_metrics(df, "label", "prob", 0.6).first()
    assert (point.acc, point.f1, point.bal_acc) == (whole.acc, whole.f1, whole.bal_acc)


def test_thresholds_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(int(rng.random() < 0.4), round(rng.random(), 2)) for _ in range(80)]
    df = spark.createDataFrame(rows, "label int, prob double")

    def f1(t):
        tp = sum(y == 1 and p >= t for y, p in rows)
        return 2 * tp / (sum(y for y, _ in rows) + sum(p >= t for _, p in rows))

    grid = max(range(33), key=lambda i: (round(f1(E.THRESHOLD_GRID[i]), 12), -i))
    assert E.threshold_grid(df, "label", "prob").first().threshold == E.THRESHOLD_GRID[grid]
    seen = sorted({0.0, 0.5, 1.0, *[p for _, p in rows]}, key=lambda t: (-round(f1(t), 12), abs(t - 0.5), t))
    assert E.threshold_observed(df, "label", "prob").first().threshold == seen[0]


def test_perfect_and_single_class(spark):
    df = spark.createDataFrame([(0, 0.1), (1, 0.9)], "label int, prob double")
    assert E.roc_auc(df, "label", "prob").first().auc == 1.0
    assert E.roc_auc(df.where("label = 1"), "label", "prob").first().auc is None


def test_alpha_search_ranks_one_weight_at_a_time(spark, monkeypatch):
    written, write = [], ranking.materialise

    def seen(df, label):
        out = write(df, label)
        written.append(out.count())
        return out

    monkeypatch.setattr(ranking, "materialise", seen)
    df = spark.range(60).selectExpr("cast(id % 3 = 0 as int) label", "(id * 7 % 60) / 60 a", "(id * 11 % 60) / 60 b")
    rows = sorted(E.alpha_search(df, "label", "a", "b").collect())
    assert [r.alpha for r in rows] == list(E.ALPHA_GRID) and max(written) <= 60
    for r in rows:
        pairs = [(x.label, r.alpha * x.a + (1.0 - r.alpha) * x.b) for x in df.collect()]
        won = [(p > q) + (p == q) / 2 for y, p in pairs if y for z, q in pairs if not z]
        assert abs(r.auc - sum(won) / len(won)) < 1e-12


def test_alpha_search_takes_the_first_best(spark):
    rows = [(0, 0.1, 0.9), (0, 0.2, 0.8), (1, 0.8, 0.3), (1, 0.9, 0.1)]
    df = spark.createDataFrame(rows, "label int, a double, b double")
    best = E.best_alpha(E.alpha_search(df, "label", "a", "b")).first()
    assert best.auc == 1.0 and best.alpha == 0.6
