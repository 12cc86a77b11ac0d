"""Transcript, scoring, ranking and selection queries (inventory 2.5 and 2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import text as X
from cohortloom.operators import compare as C
from cohortloom.operators import scoring as S
from cohortloom.operators import selection as L
from cohortloom.operators.ranking import average_ranks
from cohortloom.operators.transcript import sentence_stats as stats_of
from cohortloom.plans.registry import query, table, wide_table
from cohortloom.plans.scalars import _NORM, _PROFILE, _PROFILE_SQL
from cohortloom.session import materialise

# ---- transcripts: entity = conversation, sentence = turn -------------------------------------------

_SENT = (
    "cast(length(text) * 10 as double) as duration, case when turn % 3 = 0 then cast(60 + length(text) % 90 as double) end as rate,"
    " case when role = 'user' then cast(length(text) % 9 as double) end as silence,"
    " case when turn % 2 = 0 then length(text) % 5 / 4.0 end as emotion"
)
_SENTENCE_COLUMNS = (
    "sentence_count duration_total duration_mean duration_median duration_std duration_min duration_max rate_mean rate_median"
    " rate_std rate_min rate_max silence_total silence_mean silence_max pause_count long_pause_count pause_ratio long_pause_ratio"
    " silence_to_duration emotion_mean emotion_median emotion_std chars_per_sentence_mean chars_per_sentence_std"
)


@query(
    "sentence_stats",
    "SELECT entity_id, CAST(count(*) AS DOUBLE) AS sentence_count, coalesce(sum(duration), 0) AS duration_total, avg(duration) AS duration_mean,"
    " median(duration) AS duration_median, stddev_pop(duration) AS duration_std, min(duration) AS duration_min, max(duration) AS duration_max,"
    " avg(rate) AS rate_mean, median(rate) AS rate_median, stddev_pop(rate) AS rate_std, min(rate) AS rate_min, max(rate) AS rate_max,"
    " coalesce(sum(silence), 0) AS silence_total, avg(silence) AS silence_mean, max(silence) AS silence_max,"
    " CAST(count(*) FILTER (WHERE silence > 0) AS DOUBLE) AS pause_count, CAST(count(*) FILTER (WHERE silence >= 5) AS DOUBLE) AS long_pause_count,"
    " count(*) FILTER (WHERE silence > 0) / count(*) AS pause_ratio, count(*) FILTER (WHERE silence >= 5) / count(*) AS long_pause_ratio,"
    " coalesce(sum(silence), 0) / nullif(coalesce(sum(duration), 0), 0) AS silence_to_duration, avg(emotion) AS emotion_mean,"
    " median(emotion) AS emotion_median, stddev_pop(emotion) AS emotion_std, avg(chars) AS chars_per_sentence_mean,"
    " stddev_pop(chars) AS chars_per_sentence_std FROM (SELECT conv_id AS entity_id, CAST(duration AS DOUBLE) AS duration, CAST(rate AS DOUBLE) AS rate,"
    " CAST(silence AS DOUBLE) AS silence, CAST(emotion AS DOUBLE) AS emotion,"
    f" CAST(nullif(length({_NORM.format(t='text')}), 0) AS DOUBLE) AS chars FROM (SELECT conv_id, text, {_SENT} FROM conversations)) GROUP BY entity_id",
    rounded=_SENTENCE_COLUMNS,
)
def sentence_stats(spark, folder):
    rows = table(spark, folder, "conversations").selectExpr("conv_id as entity_id", "text", *[
        "cast(length(text) * 10 as double) as duration",
        "case when turn % 3 = 0 then cast(60 + length(text) % 90 as double) end as rate",
        "case when role = 'user' then cast(length(text) % 9 as double) end as silence",
        "cast(case when turn % 2 = 0 then length(text) % 5 / 4.0 end as double) as emotion",
    ])
    return stats_of(rows)


# ---- screening: lineitem measures against the return flag ------------------------------------------

_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature_name, CAST({f} AS DOUBLE) AS value, CAST(l_returnflag = 'R' AS INTEGER) AS label,"
    f" CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END + CAST(l_linestatus = 'F' AS INTEGER) AS severity FROM lineitem"
    for f in _FEATURES
) + ")"


def _lines(spark, folder):
    return wide_table(spark, folder, "lineitem", *_FEATURES, "l_returnflag", "l_linestatus").select(
        *_FEATURES, (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0)
         + (F.col("l_linestatus") == "F").cast("int")).alias("severity"),
    )


def _long(spark, folder):
    return S.long_form(_lines(spark, folder), _FEATURES, ["label", "severity"])


# Tail probabilities by Simpson's rule over the density, the oracle's own way to them.
_STEPS = 4000
_SIMPSON = f"CASE WHEN i IN (0, {_STEPS}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


def _t_tail(r: str, n: str) -> str:
    """Two-sided p of a correlation; the density is taken over atan so the range is finite."""
    # With t = sqrt(df) * tan(u) the t density becomes c * cos(u)^(df - 1); |t| corresponds to asin(|r|).
    return (
        f"(1 - 2 * exp(lgamma(({n} - 1) / 2.0) - lgamma(({n} - 2) / 2.0)) / sqrt(pi()) * (SELECT sum({_SIMPSON} *"
        f" power(cos(asin(abs({r})) * i / {_STEPS}.0), {n} - 3)) FROM range({_STEPS} + 1) s(i)) * asin(abs({r})) / {_STEPS}.0 / 3)"
    )


def _chi2_tail(h: str, df: str) -> str:
    """P(chi2 > h); with x = z^2 the integrand 2 z^(df - 1) exp(-z^2 / 2) has no pole at 0."""
    return (
        f"(1 - 2 / (power(2, {df} / 2.0) * gamma({df} / 2.0)) * (SELECT sum({_SIMPSON} * CASE WHEN i = 0 AND {df} > 1 THEN 0 ELSE"
        f" power(sqrt({h}) * i / {_STEPS}.0, {df} - 1) * exp(-power(sqrt({h}) * i / {_STEPS}.0, 2) / 2) END)"
        f" FROM range({_STEPS} + 1) s(i)) * sqrt({h}) / {_STEPS}.0 / 3)"
    )


_PEARSON_SQL = (
    "pear AS (SELECT feature_name, count(*) AS binary_n, CASE WHEN min(value) < max(value) AND min(label) < max(label) AND count(*) >= 3"
    " THEN corr(value, label) END AS binary_corr, avg(value) FILTER (WHERE label = 0) AS binary_mean_neg, avg(value) FILTER (WHERE label = 1)"
    " AS binary_mean_pos FROM long WHERE label IS NOT NULL AND value IS NOT NULL GROUP BY feature_name)"
)
_AUC_SQL = (
    "ranked AS (SELECT feature_name, label, rank() OVER w + (count(*) OVER (PARTITION BY feature_name, value) - 1) / 2.0 AS r FROM long"
    " WHERE label IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY feature_name ORDER BY value)),"
    " aucs AS (SELECT feature_name, (sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / nullif(p * n, 0) AS binary_auc FROM (SELECT *,"
    " CAST(count(*) FILTER (WHERE label = 1) OVER (PARTITION BY feature_name) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE label = 0)"
    " OVER (PARTITION BY feature_name) AS DOUBLE) AS n FROM ranked) GROUP BY feature_name, p, n)"
)
_D_SQL = (
    "effects AS (SELECT feature_name, CASE WHEN n0 >= 2 AND n1 >= 2 AND ((n0 - 1) * v0 + (n1 - 1) * v1) > 0 THEN"
    " (m1 - m0) / sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2)) END AS binary_effect_size_d FROM (SELECT feature_name,"
    " count(*) FILTER (WHERE label = 0) AS n0, count(*) FILTER (WHERE label = 1) AS n1, avg(value) FILTER (WHERE label = 0) AS m0,"
    " avg(value) FILTER (WHERE label = 1) AS m1, var_samp(value) FILTER (WHERE label = 0) AS v0, var_samp(value) FILTER (WHERE label = 1) AS v1"
    " FROM long WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY feature_name))"
)
_SEV_SQL = (
    "sr AS (SELECT feature_name, severity, CAST(rank() OVER (PARTITION BY feature_name ORDER BY value) + (count(*) OVER (PARTITION BY feature_name,"
    " value) - 1) / 2.0 AS DOUBLE) AS rv, CAST(rank() OVER (PARTITION BY feature_name ORDER BY severity) + (count(*) OVER (PARTITION BY feature_name,"
    " severity) - 1) / 2.0 AS DOUBLE) AS rs FROM long WHERE severity IS NOT NULL AND value IS NOT NULL),"
    " sp AS (SELECT feature_name, count(*) AS severity_n, CASE WHEN count(*) >= 3 AND min(rv) < max(rv) AND min(rs) < max(rs) THEN corr(rv, rs) END"
    " AS severity_spearman_rho, var_pop(rv) * count(*) AS sst, avg(rv) AS mid, count(DISTINCT severity) AS g FROM sr GROUP BY feature_name),"
    " kw AS (SELECT s.feature_name, (any_value(sp.severity_n) - 1) * sum(s.c * (s.m - sp.mid) * (s.m - sp.mid)) / nullif(any_value(sp.sst), 0)"
    " AS severity_kruskal_stat FROM (SELECT feature_name, severity, count(*) AS c, avg(rv) AS m FROM sr GROUP BY 1, 2) s JOIN sp USING (feature_name)"
    " GROUP BY s.feature_name)"
)


@query(
    "pearson_binary",
    f"WITH {_LONG_SQL}, {_PEARSON_SQL} SELECT *, {_t_tail('binary_corr', 'binary_n')} AS binary_corr_pvalue FROM pear",
    rounded="binary_corr binary_corr_pvalue binary_mean_neg binary_mean_pos",
)
def pearson_binary(spark, folder):
    return S.pearson_binary(_long(spark, folder))


@query("feature_auc", f"WITH {_LONG_SQL}, {_AUC_SQL} SELECT feature_name, binary_auc FROM aucs", rounded="binary_auc")
def feature_auc(spark, folder):
    return S.feature_auc(_long(spark, folder))


@query("cohens_d", f"WITH {_LONG_SQL}, {_D_SQL} SELECT * FROM effects", rounded="binary_effect_size_d")
def cohens_d(spark, folder):
    return S.cohens_d(_long(spark, folder))


@query(
    "spearman",
    f"WITH {_LONG_SQL}, {_SEV_SQL} SELECT feature_name, severity_n, severity_spearman_rho,"
    f" {_t_tail('severity_spearman_rho', 'severity_n')} AS severity_spearman_pvalue FROM sp",
    rounded="severity_spearman_rho severity_spearman_pvalue",
)
def spearman(spark, folder):
    return S.spearman(_long(spark, folder))


@query(
    "kruskal",
    f"WITH {_LONG_SQL}, {_SEV_SQL} SELECT sp.feature_name, severity_n, severity_kruskal_stat, {_chi2_tail('severity_kruskal_stat', '(g - 1)')}"
    " AS severity_kruskal_pvalue FROM sp JOIN kw USING (feature_name)",
    rounded="severity_kruskal_stat severity_kruskal_pvalue",
)
def kruskal(spark, folder):
    return S.kruskal(_long(spark, folder))


@query(
    "avg_rank",
    f"WITH {_LONG_SQL}, r AS (SELECT feature_name, value, rank() OVER (PARTITION BY feature_name ORDER BY value) AS r FROM long)"
    " SELECT feature_name, value, count(*) AS n, min(r) + (count(*) - 1) / 2.0 AS avg_rank FROM r GROUP BY feature_name, value",
    rounded="avg_rank",
)
def avg_rank(spark, folder):
    return average_ranks(_long(spark, folder), ["feature_name"], "value").select("feature_name", "value", "n", "avg_rank")


# ---- the whole table: document profiles against quality labels --------------------------------------

_DOC_FEATURES = tuple(_PROFILE.split())
_DOC_LONG = (
    f"prof AS ({_PROFILE_SQL}), joined AS (SELECT p.*, l.quality AS label, l.quality + l.toxic AS severity FROM prof p JOIN labels l USING (doc_id)),"
    " long AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature_name, {f} AS value, label, severity FROM joined WHERE {f} IS NOT NULL" for f in _DOC_FEATURES
    ) + ")"
)
_TABLE_SQL = (
    f"{_DOC_LONG}, {_PEARSON_SQL}, {_AUC_SQL}, {_D_SQL}, {_SEV_SQL}, scored AS (SELECT feature_name, binary_n, binary_corr, CASE WHEN binary_corr IS NOT NULL"
    " THEN binary_auc END AS binary_auc, CASE WHEN binary_corr IS NOT NULL THEN binary_effect_size_d END AS binary_effect_size_d,"
    " binary_mean_neg, binary_mean_pos, severity_n, severity_spearman_rho, severity_kruskal_stat, g FROM pear JOIN aucs USING (feature_name)"
    " JOIN effects USING (feature_name) JOIN sp USING (feature_name) JOIN kw USING (feature_name)), scores AS (SELECT *, abs(binary_corr) AS binary_corr_abs,"
    " abs(severity_spearman_rho) AS severity_spearman_abs, abs(binary_auc - 0.5) AS binary_auc_distance, abs(binary_effect_size_d)"
    " AS binary_effect_size_abs, list_avg(list_filter([abs(binary_corr), abs(severity_spearman_rho), abs(binary_auc - 0.5),"
    " abs(binary_effect_size_d)], lambda q: q IS NOT NULL)) AS combined_score FROM scored)"
)
_SCORE_DOUBLES = (
    "binary_corr binary_auc binary_effect_size_d binary_mean_neg binary_mean_pos severity_spearman_rho severity_kruskal_stat"
    " binary_corr_abs severity_spearman_abs binary_auc_distance binary_effect_size_abs combined_score"
)


def _profiles(spark, folder):
    lines = F.size(F.split("text", "\n"))
    cols = X.text_profile(F.col("text"), lines, (F.length("text") * 60).cast("double"))
    docs = wide_table(spark, folder, "documents", "doc_id", "text").select("doc_id", *[cols[f].alias(f) for f in _DOC_FEATURES])
    labels = table(spark, folder, "labels").select(
        "doc_id", F.col("quality").alias("label"), (F.col("quality") + F.col("toxic")).alias("severity")
    )
    # The profile is the costly part; it is written once, as feature tables are, and then only read.
    return materialise(docs.join(labels, "doc_id"), "profiles")


@query(
    "feature_score_table",
    f"WITH {_TABLE_SQL} SELECT feature_name, {_SCORE_DOUBLES.replace(' ', ', ')}, binary_n, severity_n,"
    f" {_t_tail('binary_corr', 'binary_n')} AS binary_corr_pvalue, {_t_tail('severity_spearman_rho', 'severity_n')} AS severity_spearman_pvalue,"
    f" {_chi2_tail('severity_kruskal_stat', '(g - 1)')} AS severity_kruskal_pvalue FROM scores",
    rounded=_SCORE_DOUBLES + " binary_corr_pvalue severity_spearman_pvalue severity_kruskal_pvalue",
)
def feature_score_table(spark, folder):
    return S.feature_scores(_profiles(spark, folder), _DOC_FEATURES)


_RANK_SQL = (
    ", ranked_scores AS (SELECT feature_name, combined_score, row_number() OVER (ORDER BY combined_score DESC NULLS LAST, binary_corr_abs DESC NULLS LAST,"
    " severity_spearman_abs DESC NULLS LAST, feature_name) AS place FROM scores WHERE binary_corr IS NOT NULL)"
)


@query(
    "rank_features",
    f"WITH {_TABLE_SQL}{_RANK_SQL} SELECT place, feature_name, combined_score, CAST(place <= 3 AS INTEGER) AS selected FROM ranked_scores",
    rounded="combined_score",
)
def rank_features(spark, folder):
    data = _profiles(spark, folder)
    ranked = L.rank_features(S.feature_scores(data, _DOC_FEATURES), _DOC_FEATURES, data)
    # One row per feature: the list is as long as the table is wide.
    order = [r.feature_name for r in ranked.select("feature_name").collect()]
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("feature_name"))
    flagged = L.flag_selected(ranked, order[:3])
    return flagged.select(place.alias("place"), "feature_name", "combined_score", "selected")


@query(
    "top_k_features",
    f"WITH {_TABLE_SQL}, s AS (SELECT feature_name, combined_score FROM scores WHERE feature_name <> 'filler_count' ORDER BY combined_score DESC NULLS LAST,"
    " feature_name LIMIT 5) SELECT * FROM s",
    rounded="combined_score",
)
def top_k_features(spark, folder):
    scores = S.feature_scores(_profiles(spark, folder), _DOC_FEATURES)
    flagged = L.flag_selected(scores, [f for f in _DOC_FEATURES if f != "filler_count"])
    return L.top_k(flagged, 5).select("feature_name", "combined_score")


_PAIRS_SQL = "WITH " + _DOC_LONG.split(", long AS (")[0] + ", pr AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, doc_id, {a} AS x, {b} AS y FROM joined WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    for i, a in enumerate(sorted(_DOC_FEATURES)) for b in sorted(_DOC_FEATURES)[i + 1 :]
) + (
    "), rk AS (SELECT feature_a, feature_b, CAST(rank() OVER (PARTITION BY feature_a, feature_b ORDER BY x) + (count(*) OVER (PARTITION BY feature_a,"
    " feature_b, x) - 1) / 2.0 AS DOUBLE) AS rx, CAST(rank() OVER (PARTITION BY feature_a, feature_b ORDER BY y) + (count(*) OVER (PARTITION BY feature_a,"
    " feature_b, y) - 1) / 2.0 AS DOUBLE) AS ry FROM pr) SELECT feature_a, feature_b, count(*) AS n, CASE WHEN min(rx) < max(rx) AND min(ry) < max(ry)"
    " THEN corr(rx, ry) END AS rho FROM rk GROUP BY feature_a, feature_b"
)


@query("pair_spearman", _PAIRS_SQL, rounded="rho")
def pair_spearman(spark, folder):
    return L.pair_spearman(_profiles(spark, folder), _DOC_FEATURES)


# The greedy walk as a recursion over the ranked names; `close` lists the names a name may not stand beside.
_PRUNE_SQL = (
    f"WITH RECURSIVE {_TABLE_SQL}{_RANK_SQL}, rho AS ({_PAIRS_SQL.replace('WITH ' + _DOC_LONG.split(', long AS (')[0] + ', ', 'WITH ')}),"
    " close AS (SELECT a, list(b) AS close FROM (SELECT feature_a AS a, feature_b AS b FROM rho WHERE abs(rho) >= 0.85 UNION ALL"
    " SELECT feature_b, feature_a FROM rho WHERE abs(rho) >= 0.85) GROUP BY a), r AS (SELECT place, feature_name, coalesce(close, []) AS close"
    " FROM ranked_scores LEFT JOIN close ON a = feature_name), walk AS (SELECT CAST(0 AS BIGINT) AS place, CAST([] AS VARCHAR[]) AS kept UNION ALL"
    " SELECT r.place, CASE WHEN len(list_intersect(kept, close)) = 0 THEN list_append(kept, feature_name) ELSE kept END"
    " FROM walk JOIN r ON r.place = walk.place + 1), done AS (SELECT kept FROM walk ORDER BY place DESC LIMIT 1)"
    " SELECT feature_name, CAST(list_contains(kept, feature_name) AS INTEGER) AS selected FROM scores, done"
)


@query("prune_correlated", _PRUNE_SQL)
def prune_correlated(spark, folder):
    data = _profiles(spark, folder)
    scores = S.feature_scores(data, _DOC_FEATURES)
    order = [r.feature_name for r in L.rank_features(scores, _DOC_FEATURES).select("feature_name").collect()]
    return L.flag_selected(scores, L.prune_correlated(order, data, 0.85)).select("feature_name", "selected")


# ---- result tables ---------------------------------------------------------------------------------

_RUNS_SQL = (
    "runs AS (SELECT o_orderpriority AS family, o_orderstatus AS profile, CAST(o_custkey % 5 AS BIGINT) AS seed, avg(o_totalprice) / 500000 AS auc,"
    " o_orderpriority || '/' || o_orderstatus || '/' || (o_custkey % 5) AS run_id FROM orders GROUP BY 1, 2, 3, 5)"
)


def _runs(spark, folder):
    seed = (F.col("o_custkey") % 5).alias("seed")
    rows = table(spark, folder, "orders").groupBy(
        F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("profile"), seed
    ).agg((F.avg("o_totalprice") / 500000).alias("auc"))
    return rows.withColumn("run_id", F.concat_ws("/", "family", "profile", "seed"))


@query(
    "leaderboard",
    f"WITH {_RUNS_SQL}, best AS (SELECT family, arg_max(run_id, auc) AS best_run, count(auc) AS runs, avg(auc) AS mean_score, max(auc) AS best_score,"
    " stddev_pop(auc) AS std_score FROM runs GROUP BY family), top AS (SELECT run_id, auc, CAST(row_number() OVER (ORDER BY auc DESC, run_id) AS INTEGER) AS place FROM runs)"
    " SELECT 'family' AS kind, family AS name, best_run, runs, mean_score, best_score, std_score, CAST(NULL AS INTEGER) AS place FROM best"
    " UNION ALL SELECT 'top', run_id, NULL, NULL, NULL, auc, NULL, place FROM top WHERE place <= 10",
    rounded="mean_score best_score std_score",
)
def leaderboard(spark, folder):
    runs = _runs(spark, folder)
    best = C.best_per_group(runs, ["family"], "auc", "run_id").select("family", F.col("run_id").alias("best_run"))
    families = C.family_summary(runs, "family", "auc").join(best, "family").select(
        F.lit("family").alias("kind"), F.col("family").alias("name"), "best_run", "runs", "mean_score", "best_score", "std_score",
        F.lit(None).cast("int").alias("place"),
    )
    top = C.leaderboard(runs, "auc", "run_id", 10).select(
        F.lit("top").alias("kind"), F.col("run_id").alias("name"), F.col("auc").alias("best_score"), "place"
    )
    return families.unionByName(top, allowMissingColumns=True)


_SUMMARY_SQL = (
    "runs AS (SELECT o_orderpriority AS family, o_orderstatus AS strategy, 'p' || (o_custkey % 5) AS profile, avg(o_totalprice) / 500000 AS auc,"
    " count(*) FILTER (WHERE o_totalprice > 150000) / CAST(count(*) AS DOUBLE) AS f1, o_orderpriority || '/' || o_orderstatus || '/' || (o_custkey % 5) AS run_id"
    " FROM orders GROUP BY 1, 2, 3, 6)"
)


@query(
    "result_summary",
    f"WITH {_SUMMARY_SQL}, g AS (SELECT 'all' AS kind, CAST(NULL AS VARCHAR) AS name, * FROM runs UNION ALL SELECT 'family', family, * FROM runs"
    " UNION ALL SELECT 'strategy', strategy, * FROM runs UNION ALL SELECT 'profile', profile, * FROM runs), r AS (SELECT *,"
    " row_number() OVER (PARTITION BY kind, name ORDER BY auc DESC, run_id) AS a, row_number() OVER (PARTITION BY kind, name ORDER BY f1 DESC, run_id) AS b FROM g)"
    " SELECT kind, name, count(auc) AS runs, avg(auc) AS mean_score, max(auc) AS best_score, max(run_id) FILTER (WHERE a = 1) AS best_run,"
    " max(f1) AS best_tuned, max(run_id) FILTER (WHERE b = 1) AS best_tuned_run FROM r GROUP BY kind, name",
    rounded="mean_score best_score best_tuned",
)
def result_summary(spark, folder):
    profile = F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")).alias("profile")
    rows = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("strategy"), profile).agg(
        (F.avg("o_totalprice") / 500000).alias("auc"), (F.count_if(F.col("o_totalprice") > 150000) / F.count("*")).alias("f1")
    )
    rows = rows.withColumn("run_id", F.concat_ws("/", "family", "strategy", F.expr("substring(profile, 2)")))
    return C.result_summary(rows, ["family", "strategy", "profile"], "auc", "f1", "run_id")
