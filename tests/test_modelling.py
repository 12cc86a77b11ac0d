import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from cohortloom.functions.distributions import chi2_tail, incomplete_beta
from cohortloom.operators import compare as C
from cohortloom.operators import models as M
from cohortloom.operators import scoring as S
from cohortloom.operators import selection as L
from cohortloom.operators import split as P
from cohortloom.operators import neighbours as N


def test_split_sizes_and_disjointness(spark):
    test, val = P.split_quotas({0: 355, 1: 167})
    assert (sum(test.values()), sum(val.values())) == (53, 53)
    rows = [(i, 1 if i < 60 else 0 if i < 200 else None) for i in range(210)]
    df = spark.createDataFrame(rows, "entity_id int, label int")
    out = P.stratified_entity_split(df)
    assert out.count() == 210 and P.split_overlaps(out).count() == 0
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts["unlabelled"] == 10 and counts["test"] == 20 and counts["train"] + counts["val"] == 180
    again = P.stratified_entity_split(df)
    other = P.stratified_entity_split(df, seed=7)
    assert sorted(out.collect()) == sorted(again.collect()) != sorted(other.collect())


def test_group_folds_keep_entities_whole(spark):
    df = spark.range(400).select((F.col("id") % 57).alias("entity_id"), F.col("id").alias("sample_id"), (F.col("id") % 57 % 2).alias("label"))
    folds = P.stratified_group_folds(df, 5)
    assert folds.groupBy("entity_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0
    assert folds.select("fold").distinct().count() == 5


def test_tails():
    assert chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi2_tail(7.814728, 3) == pytest.approx(0.05, abs=1e-6)
    # Student t, 10 degrees of freedom, t = 2.228139 has a two-sided tail of .05.
    t2 = 2.228139**2
    assert incomplete_beta(5.0, 0.5, 10 / (10 + t2)) == pytest.approx(0.05, abs=1e-6)


def features(spark, n=300):
    rng = np.random.default_rng(8)
    label = rng.integers(0, 2, n)
    severity = label * rng.integers(1, 4, n)
    good = label + rng.normal(0, 1, n)
    rows = [(int(i), int(label[i]), int(severity[i]), float(good[i]), float(good[i]), float(-good[i]), 7.0, float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "entity_id int, label int, severity int, a double, b double, c double, flat double, noise double")
    return df.withColumn("noise", F.when(F.col("entity_id") % 9 == 0, None).otherwise(F.col("noise")))


NAMES = ("a", "b", "c", "flat", "noise")


def test_scores_and_pruning(spark):
    df = features(spark)
    rows = {r.feature_name: r for r in S.feature_scores(df, NAMES).collect()}
    flat, a = rows["flat"], rows["a"]
    assert flat.binary_corr is None and flat.severity_spearman_rho is None and flat.binary_mean_pos == 7.0 and flat.combined_score is None
    pdf = df.toPandas()
    assert a.binary_corr == pytest.approx(pdf.a.corr(pdf.label))
    ranks = pdf.a.rank().corr(pdf.severity.rank())
    assert a.severity_spearman_rho == pytest.approx(ranks) and 0 <= a.severity_kruskal_pvalue <= 1
    assert rows["c"].binary_auc == pytest.approx(1 - a.binary_auc)
    sub = pdf.dropna()
    assert rows["noise"].binary_n == len(sub) and rows["noise"].binary_corr == pytest.approx(sub.noise.corr(sub.label))
    assert L.prune_correlated(["a", "b", "c", "flat", "noise"], df, 0.99) == ["a", "noise"]
    rho = {(r.feature_a, r.feature_b): r.rho for r in L.pair_spearman(df, NAMES).collect()}
    assert rho[("a", "noise")] == pytest.approx(sub.a.rank().corr(sub.noise.rank()))
    assert [r.feature_name for r in L.rank_features(S.feature_scores(df, NAMES), NAMES, df).collect()][-1] == "noise"


def test_score_of_an_all_null_or_one_class_feature(spark):
    df = spark.createDataFrame([(1, 1, None, 2.0), (1, 1, None, 3.0), (1, 1, None, 4.0)], "label int, severity int, empty double, one double")
    rows = {r.feature_name: r for r in S.feature_scores(df, ("empty", "one")).collect()}
    assert rows["empty"].binary_n == 0 and rows["one"].binary_corr is None and rows["one"].binary_mean_pos == 3.0


def test_percentile_choice():
    assert P.percentile_choice([1.0, 4.0, 3.0, 2.0], 50) == [1, 2]
    assert P.percentile_choice([1.0, 4.0, 3.0], 50) == [1]
    assert P.percentile_choice([5.0], 50) == [0]
    assert P.percentile_choice([None, 2.0, 1.0, 0.5], 30) == [1]


def test_preparation_uses_train_rows_only(spark):
    df = spark.createDataFrame([(True, 1.0), (True, 3.0), (True, None), (False, 100.0), (False, None)], "train boolean, x double")
    filled = sorted(r.x for r in P.median_impute(df, df.where("train"), ["x"]).collect())
    assert filled == [1.0, 2.0, 2.0, 3.0, 100.0]
    prepared = M.TablePreparer(["x"]).fit(df.where("train")).transform(df)
    assert sorted(round(float(r.prepared[0]), 4) for r in prepared.where("train").collect()) == [-1.2247, 0.0, 1.2247]


def test_knn_matches_brute_force_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE_ROWS", 90)
    monkeypatch.setattr(N, "BLOCK_ROWS", 25)
    rng = np.random.default_rng(6)
    train = np.vstack([rng.normal(0, 0.01, (300, 3)), rng.normal(0, 5, (200, 3)), np.ones((100, 3))])  # a crowded cell, and ties
    label = rng.integers(0, 2, len(train))
    query = np.vstack([rng.normal(0, 0.01, (30, 3)), rng.normal(0, 6, (30, 3)), np.ones((2, 3))])
    t = spark.createDataFrame([(i, v.tolist(), int(label[i])) for i, v in enumerate(train)], "train_id int, vec array<double>, label int")
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(query)], "query_id int, vec array<double>")
    got = {r.query_id: r for r in N.knn_votes(q, t, [3, 5, 150]).collect()}
    assert len(got) == len(query)
    for i, v in enumerate(query):
        best = np.argsort(np.sqrt(((train - v) ** 2).sum(axis=1)).round(12), kind="stable")
        for k in (3, 5, 150):
            assert got[i][f"prob_{k}"] == pytest.approx(label[best[:k]].mean())
    assert {r.query_id: r.prob for r in N.knn_vote(q, t.limit(2), 5).collect()}.keys() == got.keys()  # fewer train rows than k
    assert N.knn_vote(q, t.limit(0), 5).count() == 0 and N.knn_vote(q.limit(0), t, 5).count() == 0


def test_tiles_are_not_broadcast_through_the_driver(spark):
    rows = spark.range(50).selectExpr("id train_id", "array(cast(id as double), 1D) vec", "cast(id % 2 as double) label")
    found = N.nearest_rows(rows.selectExpr("train_id query_id", "vec"), rows, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pairs_with_and_without_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (200, 5)).astype(float)
    x[:, 1] += x[:, 0]
    x[:, 4] = 3.0
    x[::7, 2], x[::5, 3] = np.nan, np.nan
    names = list("abcde")
    df = spark.createDataFrame([tuple(None if np.isnan(v) and k % 2 else float(v) for v in r) for k, r in enumerate(x)], ", ".join(f"{n} double" for n in names))
    import pandas as pd

    got = {(r.feature_a, r.feature_b): r for r in L.pair_spearman(df, names).collect()}
    assert len(got) == 10
    for (a, b), r in got.items():
        both = pd.DataFrame({"a": x[:, names.index(a)], "b": x[:, names.index(b)]}).dropna()
        assert r.n == len(both)
        assert r.rho is None if "e" in (a, b) else r.rho == pytest.approx(both.a.rank().corr(both.b.rank()), abs=1e-12)
    assert L.pair_spearman(df.limit(0), names).count() == 0


def model_frame(spark):
    df = features(spark, 240).withColumn("split", F.when(F.col("entity_id") % 5 == 0, "val").when(F.col("entity_id") % 5 == 1, "test").otherwise("train"))
    return P.stratified_group_folds(df, 3).persist()


def test_search_and_comparison(spark):
    df = model_frame(spark)
    config = M.ModelConfig("lr", "logistic", {"percentile": [50, 70], "C": [0.1, 1.0]})
    fitted = M.fit_model(config, df.where("split = 'train'"), ("a", "noise", "flat"), folds=3)
    assert set(fitted.params) == {"percentile", "regParam"} and fitted.cv_auc > 0.6
    out = C.compare_feature_sets(df, {"x": ("a", "noise")}, [M.ModelConfig("lr", "logistic", select=False)], search=False).collect()
    assert {r.strategy for r in out} == {"standard", "severity_weighted"} and all(r.test_auc_roc > 0.6 for r in out)
    tree = M.ModelConfig("dt", "tree", select=False, takes_weights=False, balanced=False)
    with pytest.raises(ValueError):
        M.fit_model(tree, df, ("a",), "severity_weighted")


def test_models_score_in_a_session_that_was_observed(spark):
    # An observation puts a part into the session that cannot be serialized; a model must not carry the session.
    seen = Observation("seen")
    spark.range(5).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 5}
    df = spark.range(200).selectExpr("id", "cast(id % 5 < 2 as int) label", "cast(id % 7 + id % 5 as double) a", "0 severity", "if(id % 2 = 0, 'val', 'test') split")
    for config in (M.ModelConfig("lr", "logistic", select=False), M.ModelConfig("rf", "forest", defaults={"numTrees": 3}, scale=False, select=False)):
        model = M.fit_model(config, df, ["a"], search=False).model
        assert not model.stages[-1].hasSummary and M.predict_prob(model, df).where("prob between 0 and 1").count() == 200
    assert C.stack_metrics(df.withColumn("p", F.col("a") / 20), ["p"], "logistic").first()["test_auc_roc"] > 0.5


def test_leaderboard(spark):
    runs = spark.createDataFrame([("r1", "x", 0.70, 0.60), ("r2", "x", 0.75, 0.58), ("r3", "y", 0.72, 0.66)], "run string, family string, auc double, f1 double")
    assert [r.run for r in C.leaderboard(runs, "auc", "run", 2).collect()] == ["r2", "r3"]
    assert C.leaderboard(runs, "f1", "run", 1).first().run == "r3"
    assert {r.family: r.run for r in C.best_per_group(runs, ["family"], "auc", "run").collect()} == {"x": "r2", "y": "r3"}
