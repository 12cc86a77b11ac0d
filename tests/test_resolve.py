import pytest
from pyspark.sql import functions as F

from cohortloom.operators import pairing as P
from cohortloom.operators import resolve as R
from cohortloom.operators import weights as W


@pytest.fixture(scope="module")
def known(spark):
    a = spark.createDataFrame([("QQ005",), ("QQ006",), ("QQ007",)], "entity_id string")
    b = spark.createDataFrame([("QQ006",), ("QQ009",)], "entity_id string")
    return R.known_ids(a, b)


def test_three_step_resolution(spark, known):
    names = R.unique_names(
        spark.createDataFrame([("甲乙", "QQ007"), ("丙丁", "QQ005"), ("丙丁", "QQ006"), ("甲乙", "QQ007")], "name string, entity_id string")
    )
    samples = spark.createDataFrame(
        [(1, "qq006 ", ""), (2, "QQOO5", ""), (3, "folder", "甲乙"), (4, "folder", "丙丁"), (5, "ZZ", "")],
        "sample_id int, raw_id string, candidate_name string",
    )
    resolved = R.resolve_identity(samples, known, names)
    got = {r.sample_id: (r.entity_id, r.matched_by, r.in_a, r.in_b, r.notes) for r in resolved.collect()}
    assert got[1] == ("QQ006", "patient_id", True, True, "")
    assert got[2] == ("QQ005", "patient_id", True, False, "normalized_from:QQOO5")
    assert got[3] == ("QQ007", "name", True, False, "")
    assert got[4][0] is None and got[5][0] is None
    assert R.excluded_rows(resolved).count() == 2


def test_resolution_is_one_pass_and_keeps_repeated_rows(spark, known):
    names = spark.createDataFrame([("甲乙", "QQ007"), ("戊", "QQ999")], "name string, entity_id string")
    rows = [(1, "QQ006", "甲乙"), (1, "QQ006", "甲乙"), (2, None, None), (2, None, None), (2, None, None),
            (3, "QQOO5", "甲乙"), (4, None, "戊"), (5, "", "")]
    samples = spark.createDataFrame(rows, "sample_id int, raw_id string, candidate_name string")
    resolved = R.resolve_identity(samples, known, names)
    got = sorted(((r.sample_id, r.entity_id, r.matched_by, r.matched_name, r.in_a, r.in_b) for r in resolved.collect()), key=str)
    assert got == [
        (1, "QQ006", "patient_id", "", True, True), (1, "QQ006", "patient_id", "", True, True),
        *[(2, None, None, "", False, False)] * 3,
        (3, "QQ005", "patient_id", "", True, False), (4, "QQ999", "name", "戊", False, False), (5, None, None, "", False, False),
    ]
    assert R.resolve_identity(samples.limit(0), known, names).collect() == []
    # The lookup's own join of names and ids, and one join of the samples with it.
    plan = resolved._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2


def test_sources_to_samples_and_issues(spark):
    images = spark.createDataFrame(
        [("A", "A1", "/A/A1.jpg", 1), ("A", "A-1", "/A/A-1.jpg", 1), ("B", "B2", "/B/B2.jpg", 2), ("C", "C1", "/C/C1.jpg", 1)],
        "entity_id string, stem string, path string, sequence int",
    )
    measures = spark.createDataFrame([("A-1", "/A/A-1.csv")], "stem string, path string")
    samples, issues = R.source_samples_flat(images, measures, "2024")
    assert [(r.entity_id, r.measure_path) for r in samples.collect()] == [("A", "/A/A-1.csv")]
    assert {(r.entity_id, r.code) for r in issues.collect()} == {
        ("A", "multiple_sequence_1_images"), ("B", "missing_sequence_1_image"), ("C", "missing_temperature_csv"),
    }


def test_views_gate_and_orphans(spark):
    images = spark.createDataFrame(
        [("a", "A", "正", 1), ("b", "A", "正", 2), ("c", "B", "左", 1), ("d", "C", "正", 2), ("e", None, None, None)],
        "stem string, entity_id string, view string, sequence int",
    ).withColumn("path", F.concat(F.lit("/p/"), "stem"))
    measures = spark.createDataFrame([("a", "/t/a"), ("z", "/t/z")], "stem string, path string")
    samples, issues = R.source_samples_views(images, measures, "2025", "正")
    assert [(r.entity_id, r.sequence) for r in samples.collect()] == [("A", 1)]
    assert sorted(r.code for r in issues.collect()) == [
        "missing_front_image", "missing_front_sequence_1", "missing_temperature_csv", "orphan_temperature_csv", "unparseable_image_name",
    ]


def test_issues_of_a_large_group_are_dealt_by_their_count(spark, monkeypatch):
    monkeypatch.setattr(R, "ISSUE_ROWS", 10)
    log = spark.range(400).selectExpr("'2024' year", "if(id < 300, '', string(id % 7)) entity_id", "'c' code", "concat('/', id) path")
    found = R.issues_per_entity(log)
    assert "_share" in found._jdf.queryExecution().optimizedPlan().toString()
    assert "_share#" in str(found._jdf.queryExecution().executedPlan()) and ", 40)" in str(found._jdf.queryExecution().executedPlan())
    plain = log.groupBy("year", "entity_id", "code").agg(F.count("*").alias("n"), F.min("path").alias("first_path"), F.max("path").alias("last_path"))
    assert sorted(found.collect()) == sorted(plain.collect()) and found.dtypes == plain.dtypes


def test_merge_prefers_primary_and_lists_sources(spark):
    e = spark.createDataFrame([("1",), ("2",), ("3",)], "entity_id string")
    a = spark.createDataFrame([("1", "missing", "x")], "entity_id string, age string, name string")
    b = spark.createDataFrame([("1", "40", "u"), ("2", "50", "v")], "entity_id string, age string, kind string")
    got = {r.entity_id: r for r in R.merge_sources(e, a, b, ["age"], ["name"], ["kind"]).collect()}
    assert (got["1"].age, got["1"].data_sources, got["1"].name) == ("40", "clinical;multimodal", "x")
    assert (got["2"].age, got["2"].data_sources) == ("50", "multimodal")
    assert (got["3"].age, got["3"].has_basic_data) == ("", False)


def test_missing_entity_features_are_an_error(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "sample_id int, entity_id string")
    f = spark.createDataFrame([("a", 1.0)], "entity_id string, x double")
    with pytest.raises(Exception, match="Missing structured features"):
        R.attach_entity_features(s, f, ["x"]).collect()


def pair_samples(spark):
    rows = [("e1", "s1", 2024), ("e1", "s2", 2025), ("e1", "s3", 2025), ("e2", "s4", 2024), ("e3", "s5", 2025), ("e4", "s6", None)]
    return spark.createDataFrame(rows, "entity_id string, sample_id string, year int")


def test_pairing_modes(spark):
    s = pair_samples(spark)
    pairs = P.build_pairs(s)
    assert sorted(r.pair_id for r in pairs.collect()) == ["e1_s1__s2", "e1_s1__s3"]
    assert [(r.sample_id_a, r.sample_id_b) for r in P.build_pairs(s, "cross_year_first").collect()] == [("s1", "s2")]
    assert [(r.sample_id_a, r.sample_id_b) for r in P.build_pairs(s, "within_late_first2").collect()] == [("s2", "s3")]
    counts = P.pair_counts(s).collect()
    assert [(r.entity_id, r.n_pairs, r.pair_weight) for r in counts] == [("e1", 2, 0.5)]


def test_one_entity_with_most_pairs(spark):
    rows = [("hot", f"s{i}", 2024 + i % 2) for i in range(200)] + [(f"e{i}", f"x{i}", 2024) for i in range(50)]
    s = spark.createDataFrame(rows, "entity_id string, sample_id string, year int")
    assert P.build_pairs(s).count() == 100 * 100 == P.pair_counts(s).first().n_pairs


def test_pair_mismatch(spark):
    rows = [("a", 2024, 1, 1), ("a", 2025, 1, 2), ("b", 2024, 0, 0), ("b", 2025, 0, 0), ("c", 2024, 1, 1)]
    s = spark.createDataFrame(rows, "entity_id string, year int, label int, severity int")
    assert [(r.entity_id, r.label_differs, r.severity_differs) for r in P.pair_mismatches(s).collect()] == [("a", False, True)]


def test_weights(spark):
    s = spark.createDataFrame([("a", 0, 0), ("a", 0, 0), ("a", 0, 0), ("b", 1, 3), ("c", 1, None)], "entity_id string, label int, severity int")
    w = sorted((r.entity_id, round(r.weight, 4)) for r in W.balance_weight(s).collect())
    assert w == [("a", 0.3333)] * 3 + [("b", 1.0), ("c", 1.0)]
    cw = W.class_weights(s).first()
    assert (cw.weight_neg, cw.weight_pos) == (5 / 6, 5 / 4)
    sw = sorted((r.entity_id, r.weight) for r in W.severity_weights(s).collect())
    assert sw == [("a", 1.0)] * 3 + [("b", 4.5), ("c", 1.5)]
