import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cohortloom.functions import text as X
from cohortloom.functions.numeric import coerce_numeric, prefer
from cohortloom.functions.text import matched_characters
from cohortloom.operators.transcript import sentence_rows, sentence_stats, transcript_features
from cohortloom.sources.tabular import TRANSCRIPT_SCHEMA


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("r")).first().r


def test_sequence_for_entity(spark):
    e = X.sequence_for_entity(F.col("stem"), F.col("entity"))
    got = [one(spark, e, stem=s, entity="901ZZ") for s in ("901ZZ1", "901ZZ-1", "901ZZ-12", "other-1", "901ZZ-x")]
    assert got == [1, 1, 12, None, None]


def test_parse_stem_shapes(spark):
    cases = {"901ZZ-正-1": ("901ZZ", "正", 1), "ABC123正2": ("ABC123", "正", 2), "某某 左 - 3": ("某某", "左", 3), "nothing": (None,) * 3}
    for stem, want in cases.items():
        assert tuple(one(spark, X.parse_stem(F.col("s")), s=stem)) == want


def test_names(spark):
    assert one(spark, X.clean_name(F.col("t")), t="（有重名）12东村+7 甲乙丙_") == "甲乙丙"
    assert one(spark, X.clean_name(F.col("t")), t="AB123") == ""
    assert one(spark, X.name_candidates(F.col("t")), t="甲乙|丙丁.json;甲乙,x") == ["甲乙", "丙丁"]
    assert one(spark, X.sample_name(F.col("i"), F.col("s")), i="ZZ9", s="甲乙丙-正-1") == "甲乙丙"


def test_ids(spark):
    assert one(spark, X.norm_id(F.col("t")), t=" \tab1　") == "AB1"
    assert one(spark, X.digits_for_lookalikes(F.col("t")), t="QQOO5") == "QQ005"
    assert one(spark, X.id_from_filename(F.col("t")), t="/x/QQ005 _a.b_c.json") == "QQ005"


def test_norm_text_and_profile(spark):
    assert one(spark, X.norm_text(F.col("t")), t="甲， a1!é ") == "甲a1"
    df = spark.createDataFrame([("嗯嗯，好。ab", 2.0, 2000.0), ("", 0.0, 0.0)], "t string, n double, ms double")
    cols = X.text_profile(F.col("t"), F.col("n"), F.col("ms"))
    full, empty = df.select(*[c.alias(k) for k, c in cols.items()]).collect()
    assert (full.char_count, full.norm_char_count, full.unique_char_count, full.token_count) == (7, 5, 4, 3)
    assert (full.filler_count, full.repeat_count, full.chars_per_second, full.chars_per_sentence_overall) == (2, 1, 2.5, 2.5)
    assert empty.norm_char_count == 0 and empty.unique_char_ratio is None and empty.chars_per_second is None


ODD = [
    "", None, " ", "啊啊嗯 hello,, World！！aa\u3000bb\u00a0c", "a" * 700, "😀😀a😀a", "\x1c\x85x\u2028y", "Ａａ１ éé àà __ 99", "\n\na\nb", "呃哦。" * 400, "zz一一Z", "{[`@^~",
] + [f"t{k}" for k in range(600)]


def test_profile_and_kept_text_equal_the_expressions(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(ODD)], "k int, t string").repartition(2)
    raw, body = F.coalesce("t", F.lit("")), X.norm_text(F.col("t"))
    size = F.length(body).cast("double")
    want = {
        "norm_char_count": size, "unique_char_count": F.when(size > 0, F.size(F.array_distinct(F.split(body, "")))).otherwise(0).cast("double"),
        "token_count": F.size(F.filter(F.split(raw, f"[{X.PUNCTUATION}{X._BLANK_CLASS}]+"), lambda x: x != "")).cast("double"),
        "filler_count": size - F.length(F.translate(body, X.FILLERS, "")), "repeat_count": size - F.length(F.regexp_replace(body, r"(.)(?=\1)", "")),
    }
    cols = X.text_profile(F.col("t"), F.lit(1), F.lit(1.0))
    differ = [~cols[n].eqNullSafe(w) for n, w in want.items()] + [~X._kept_text(raw).eqNullSafe(body)]
    profile = df.select(*[c.alias(n) for n, c in cols.items()])
    assert "regexp_replace" not in profile._jdf.queryExecution().optimizedPlan().toString()
    assert df.select("*", F.array(*differ).alias("d")).where(F.array_contains("d", True)).collect() == []


def test_distance_of_texts_without_a_common_character(spark):
    prompt = "啊。阿姨。一二三"
    df = spark.createDataFrame([("",), ("xyz" * 9,), ("xy一z",), (None,), ("三二一",), ("a",)], "t string")
    cols = X.reference_deviation(F.col("t"), F.lit(prompt))
    plain = F.levenshtein(X.norm_text(F.col("t")), X.norm_text(F.lit(prompt))).cast("double")
    assert df.select((cols["edit_distance"] == plain).alias("same")).where("same").count() == 6


def test_coerce_and_prefer(spark):
    texts = ["1.5", " 2 ", "missing", "", "1d", "nan", "0x1p3", "1e3"]
    assert [one(spark, coerce_numeric(F.col("t")), t=t) for t in texts] == [1.5, 2.0, None, None, None, None, None, 1000.0]
    e = prefer(F.col("p"), F.col("f"))
    assert [one(spark, e, p=p, f="b") for p in ("a", "", "missing", None)] == ["a", "b", "b", "b"]


def test_matching_blocks_equal_the_standard_library():
    rng = random.Random(3)
    for trial in range(300):
        letters = "ab" if trial % 2 else "abcdefgh"
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        b = "".join(rng.choice(letters) for _ in range(rng.choice([0, 5, 40, 230])))
        want = sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
        assert matched_characters(a, b) == want


def test_registered_ratio_of_whole_documents(spark, tmp_path):
    from cohortloom.plans import load_catalogue

    rng = random.Random(6)
    prompt = one(spark, X.norm_text(F.col("t")), t=X.READING_PROMPT)
    piece = lambda: X.READING_PROMPT[(k := rng.randrange(200)) : k + rng.randint(1, 90)]
    texts = [*ODD[:12], X.READING_PROMPT, X.READING_PROMPT * 3, "x" * 30_000 + X.READING_PROMPT[40:90]]
    texts += [" ".join(rng.choice([piece(), "some words ", "9"]) for _ in range(rng.randint(1, 12))) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.sequence_ratio for r in load_catalogue()[0]["sequence_ratio"](spark, str(tmp_path)).collect()}
    bodies = [one(spark, X.norm_text(F.col("t")), t=t) if t else "" for t in texts]
    assert got == {k: round(SequenceMatcher(None, t, prompt).ratio(), 6) for k, t in enumerate(bodies)} and sum(v > 0 for v in got.values()) > 30


def test_reference_deviation_of_the_prompt_itself(spark):
    df = spark.createDataFrame([("e", X.READING_PROMPT, [])], f"entity_id string, {TRANSCRIPT_SCHEMA.replace('source_file string,', '')}")
    row = transcript_features(df).first()
    assert (row.edit_distance, row.sequence_ratio, row.length_ratio, row.deletion_proxy) == (0, 1, 1, 0)
    assert row.sentence_count == 0 and row.duration_mean is None and row.duration_total == 0


def test_sentence_stats(spark):
    def s(duration, rate, silence, text):
        return (text, duration, None, None, (rate, silence, None))

    df = spark.createDataFrame(
        [("e", [s("1000", "90", "2", "ab"), s("3000", "120", "8", "!")])],
        "entity_id string, detailed_results array<struct<text: string, duration: string, begin_time: string, end_time: string,"
        " raw_sentence: struct<SpeechRate: string, SilenceDuration: string, EmotionValue: string>>>",
    )
    r = sentence_stats(sentence_rows(df)).first()
    assert (r.sentence_count, r.duration_mean, r.rate_mean, r.rate_median) == (2, 2000, 105, 105)
    assert (r.pause_count, r.long_pause_count, r.silence_total, r.silence_to_duration) == (2, 1, 10, 0.0025)
    assert r.chars_per_sentence_mean == 2 and r.emotion_mean is None
