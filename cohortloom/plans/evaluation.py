"""Metrics, thresholds, blending and entity aggregation queries (inventory 2.4, 2.5, 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.numeric import blend as blend_of
from cohortloom.operators import evaluate as E
from cohortloom.plans import views as V
from cohortloom.plans.registry import query, table

_LAB = "WITH " + V.CTE["samples"] + ", " + V.CTE["outcomes"] + ", " + V.CTE["labelled"]
# The late year of the stand-in data.
_LATE = 2000
_CLIPPED = "greatest(1e-6, least(1.0 - 1e-6, prob))"


def _by_entity(value: str) -> str:
    return f"{_LAB} SELECT entity_id, min(label) AS label, {value} AS prob FROM labelled GROUP BY entity_id"


def _aggregate(spark, folder, strategy):
    return E.aggregate_entities(V.labelled(spark, folder), strategy, late_year=_LATE)


@query("patient_prob_mean", _by_entity("avg(prob)"), rounded="prob")
def patient_prob_mean(spark, folder):
    return _aggregate(spark, folder, "prob_mean")


@query("patient_prob_max", _by_entity("max(prob)"), rounded="prob", digits=9)
def patient_prob_max(spark, folder):
    return _aggregate(spark, folder, "prob_max")


@query(
    "patient_logit_mean", _by_entity(f"1 / (1 + exp(-avg(ln({_CLIPPED} / (1 - {_CLIPPED})))))"), rounded="prob", digits=9
)
def patient_logit_mean(spark, folder):
    return _aggregate(spark, folder, "logit_mean")


@query(
    "patient_year_weighted",
    _by_entity(f"sum(prob * CASE WHEN year = {_LATE} THEN 0.7::DOUBLE ELSE 1 - 0.7::DOUBLE END) / sum(CASE WHEN year = {_LATE} THEN 0.7::DOUBLE"
               " ELSE 1 - 0.7::DOUBLE END)"),
    rounded="prob",
    digits=9,
)
def patient_year_weighted(spark, folder):
    return _aggregate(spark, folder, "year_weighted_mean")


def _rates_sql(prefix: str = "") -> str:
    return (
        f"(tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS {prefix}acc,"
        f" (tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2 AS {prefix}bal_acc,"
        f" coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS {prefix}f1, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS {prefix}precision,"
        f" coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS {prefix}recall"
    )


_RATES = "acc bal_acc f1 precision recall"


@query(
    "confusion_metrics",
    f"{_LAB} SELECT priority, {_rates_sql()} FROM (SELECT priority, count(*) FILTER (WHERE label = 1 AND prob >= 0.5) AS tp, count(*) FILTER"
    " (WHERE label = 0 AND prob >= 0.5) AS fp, count(*) FILTER (WHERE label = 1 AND prob < 0.5) AS fn, count(*) FILTER (WHERE label = 0 AND prob < 0.5)"
    " AS tn FROM labelled GROUP BY priority)",
    rounded=_RATES,
)
def confusion_metrics(spark, folder):
    return E.confusion_metrics(V.labelled(spark, folder), "label", "prob", 0.5, ["priority"])


_AUC_OF = (
    "(sum(r) FILTER (WHERE label = 1) - p * (p + 1) / 2.0) / nullif(p * n, 0)"
)
_RANKED = (
    "SELECT {keys}label, rank() OVER (PARTITION BY {part} ORDER BY {score}) + (count(*) OVER (PARTITION BY {part}, {score}) - 1) / 2.0 AS r,"
    " CAST(count(*) FILTER (WHERE label = 1) OVER (PARTITION BY {part}) AS DOUBLE) AS p, CAST(count(*) FILTER (WHERE label = 0)"
    " OVER (PARTITION BY {part}) AS DOUBLE) AS n FROM {src}"
)


@query(
    "roc_auc",
    f"{_LAB} SELECT priority, {_AUC_OF} AS auc FROM ({_RANKED.format(keys='priority, ', part='priority', score='prob', src='labelled')}) GROUP BY priority, p, n"
    f" UNION ALL SELECT 'all', {_AUC_OF} FROM ({_RANKED.format(keys='', part='1', score='prob', src='labelled')}) GROUP BY p, n",
    rounded="auc",
)
def roc_auc(spark, folder):
    return E.roc_auc_with_total(V.labelled(spark, folder), "label", "prob", "priority").select("priority", "auc")


@query(
    "average_precision",
    f"{_LAB}, s AS (SELECT priority, prob, count(*) FILTER (WHERE label = 1) AS pos, count(*) AS n FROM labelled GROUP BY 1, 2), c AS (SELECT priority, pos,"
    " sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY priority) AS total FROM s WINDOW w AS (PARTITION BY priority ORDER BY prob DESC))"
    " SELECT priority, sum(pos::DOUBLE / total * tp / seen) AS average_precision FROM c GROUP BY priority",
    rounded="average_precision",
)
def average_precision(spark, folder):
    return E.average_precision(V.labelled(spark, folder), "label", "prob", ["priority"])


@query(
    "threshold_observed",
    f"{_LAB}, t AS (SELECT DISTINCT priority, prob AS t FROM labelled UNION SELECT DISTINCT priority, v::DOUBLE FROM labelled, (VALUES (0.0), (0.5), (1.0)) x(v)),"
    " ev AS (SELECT priority, t AS s, 0 AS pos, 0 AS neg, 1 AS cand FROM t UNION ALL SELECT priority, prob, CAST(label = 1 AS INTEGER), CAST(label = 0 AS INTEGER), 0"
    " FROM labelled), g AS (SELECT priority, s, sum(pos) AS pos, sum(neg) AS neg FROM ev GROUP BY 1, 2), c AS (SELECT priority, s,"
    " sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY priority) AS p FROM g WINDOW w AS (PARTITION BY priority ORDER BY s DESC)),"
    " f AS (SELECT priority, s, round(coalesce(2.0 * tp / nullif(tp + fp + p, 0), 0), 12) AS f1 FROM c) SELECT priority, s AS threshold, f1 FROM (SELECT *,"
    " row_number() OVER (PARTITION BY priority ORDER BY f1 DESC, abs(s - 0.5), s) AS r FROM f) WHERE r = 1",
    rounded="threshold f1",
    digits=9,
)
def threshold_observed(spark, folder):
    return E.threshold_observed(V.labelled(spark, folder), "label", "prob", "f1", ["priority"])


@query(
    "threshold_grid",
    f"{_LAB}, c AS (SELECT i, 0.1::DOUBLE + i * 0.025::DOUBLE AS t, count(*) FILTER (WHERE label = 1 AND prob >= 0.1::DOUBLE + i * 0.025::DOUBLE) AS tp,"
    " count(*) FILTER (WHERE label = 0 AND prob >= 0.1::DOUBLE + i * 0.025::DOUBLE) AS fp, count(*) FILTER (WHERE label = 1) AS p FROM labelled, range(33) g(i)"
    " GROUP BY i) SELECT t AS threshold, 2.0 * tp / (tp + fp + p) AS f1 FROM c ORDER BY 2.0 * tp / (tp + fp + p) DESC, i LIMIT 1",
    rounded="threshold f1",
)
def threshold_grid(spark, folder):
    return E.threshold_grid(V.labelled(spark, folder), "label", "prob")


# ---- two and three branches -------------------------------------------------------------------------

_SECOND = "CAST(abs(balance) / 10000.0 AS DOUBLE)"


def _structured(spark, folder):
    return V.outcomes(spark, folder).select(
        "entity_id", F.expr("cast(abs(balance) / 10000.0 as double)").alias("prob_b"), "nation"
    )


def _pool(spark, folder):
    return V.splits(spark, folder).where(F.col("split") != "unlabelled")


_POOL_SQL = ", pool AS (SELECT entity_id FROM splits WHERE split <> 'unlabelled'), st AS (SELECT entity_id, " + _SECOND + " AS prob_b, nation FROM outcomes)"


@query(
    "prob_frame_2way",
    _LAB + ", " + V.CTE["splits"] + _POOL_SQL + " SELECT sample_id, entity_id, label, prob, prob_b, nation FROM labelled JOIN st USING (entity_id)"
    " WHERE entity_id IN (SELECT entity_id FROM pool)",
    rounded="prob prob_b",
    digits=9,
)
def prob_frame_2way(spark, folder):
    out = E.probability_frame(V.labelled(spark, folder), _structured(spark, folder), _pool(spark, folder))
    return out.select("sample_id", "entity_id", "label", "prob", "prob_b", "nation")


@query(
    "prob_frame_3way",
    _LAB + ", " + V.CTE["splits"] + _POOL_SQL + ", third AS (SELECT user_id AS entity_id, least(1.0, max(value) / 500) AS prob_c FROM events GROUP BY 1)"
    " SELECT sample_id, entity_id, label, prob, prob_b, CAST(prob_c AS DOUBLE) AS prob_c FROM labelled JOIN st USING (entity_id) JOIN third USING (entity_id)"
    " WHERE entity_id IN (SELECT entity_id FROM pool)",
    rounded="prob prob_b prob_c",
    digits=9,
)
def prob_frame_3way(spark, folder):
    third = table(spark, folder, "events").groupBy(F.col("user_id").alias("entity_id")).agg(
        F.least(F.lit(1.0), F.max("value") / 500).alias("prob_c")
    )
    out = E.probability_frame_three(V.labelled(spark, folder), _structured(spark, folder), third, _pool(spark, folder))
    return out.select("sample_id", "entity_id", "label", "prob", "prob_b", "prob_c")


_TWO_SQL = _LAB + f", two AS (SELECT l.*, {_SECOND} AS prob_b FROM labelled l JOIN outcomes USING (entity_id))"


def _two(spark, folder):
    second = V.outcomes(spark, folder).select("entity_id", F.expr("cast(abs(balance) / 10000.0 as double)").alias("prob_b"))
    return V.labelled(spark, folder).join(second, "entity_id")


@query(
    "blend",
    _TWO_SQL.replace("labelled l JOIN outcomes USING (entity_id)", "labelled l JOIN outcomes USING (entity_id)")
    + " SELECT sample_id, 0.25 * prob + 0.75 * prob_b AS blended FROM two",
    rounded="blended",
    digits=9,
)
def blend(spark, folder):
    return _two(spark, folder).select("sample_id", blend_of(F.col("prob"), F.col("prob_b"), 0.25).alias("blended"))


@query(
    "alpha_search",
    _TWO_SQL + ", b AS (SELECT i, i / 10.0 AS alpha, label, (i / 10.0) * prob + (1.0 - i / 10.0) * prob_b AS s FROM two, range(11) g(i)),"
    f" a AS (SELECT i, alpha, {_AUC_OF} AS auc FROM ({_RANKED.format(keys='i, alpha, ', part='i', score='s', src='b')}) GROUP BY i, alpha, p, n)"
    " SELECT CAST(alpha AS DOUBLE) AS alpha, auc, row_number() OVER (ORDER BY auc DESC, i) = 1 AS best FROM a",
    rounded="alpha auc",
)
def alpha_search(spark, folder):
    search = E.alpha_search(_two(spark, folder), "label", "prob", "prob_b")
    top = E.best_alpha(search)
    return search.select("alpha", "auc", (F.col("alpha") == top.select("alpha").scalar()).alias("best"))
