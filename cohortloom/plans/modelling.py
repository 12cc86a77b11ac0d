"""Split, preparation, neighbour and model queries (inventory 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import boosting as B
from cohortloom.operators import compare as C
from cohortloom.operators import linear
from cohortloom.operators import models as M
from cohortloom.operators import search as G
from cohortloom.operators import split as S
from cohortloom.operators.neighbours import knn_vote, knn_votes
from cohortloom.operators.selection import nested_sets
from cohortloom.operators.weights import sample_counts
from cohortloom.plans import views as V
from cohortloom.plans.registry import query, table
from cohortloom.plans.views import with_
from cohortloom.session import materialise, scratch_path

# ---- splits ----------------------------------------------------------------------------------------

# Positions inside each label by seeded md5; quotas by largest remainder of rounded-up totals.
_QUOTA_SQL = (
    "known AS (SELECT entity_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || entity_id)) - 1 AS pos FROM outcomes"
    " WHERE label IS NOT NULL), c AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM known GROUP BY label),"
    " d1 AS (SELECT *, ceil((1.0::DOUBLE - 0.8::DOUBLE - 0.1::DOUBLE) * total) AS draws, n * ceil((1.0::DOUBLE - 0.8::DOUBLE - 0.1::DOUBLE) * total) / total::DOUBLE AS x FROM c),"
    " q1 AS (SELECT label, n, total, draws, floor(x) + CASE WHEN row_number() OVER (ORDER BY x - floor(x) DESC, label) <= draws - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS test FROM d1),"
    " d2 AS (SELECT *, ceil(0.1::DOUBLE / (0.8::DOUBLE + 0.1::DOUBLE) * (total - draws)) AS draws2, (n - test) * ceil(0.1::DOUBLE / (0.8::DOUBLE + 0.1::DOUBLE) * (total - draws))"
    " / (total - draws)::DOUBLE AS y FROM q1), q2 AS (SELECT label, test, floor(y) + CASE WHEN row_number() OVER (ORDER BY y - floor(y) DESC, label)"
    " <= draws2 - sum(floor(y)) OVER () THEN 1 ELSE 0 END AS val FROM d2), made AS (SELECT entity_id, CASE WHEN pos < test THEN 'test' WHEN pos < test + val THEN 'val'"
    " ELSE 'train' END AS split FROM known JOIN q2 USING (label) UNION ALL SELECT entity_id, 'unlabelled' FROM outcomes WHERE label IS NULL)"
)


@query("stratified_entity_split", with_("outcomes") + f", {_QUOTA_SQL} SELECT entity_id, split FROM made")
def stratified_entity_split(spark, folder):
    return S.stratified_entity_split(V.outcomes(spark, folder))


@query(
    "split_summary",
    with_("samples", "outcomes") + f", {_QUOTA_SQL} SELECT split, count(*) AS n_entities, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_samples,"
    " count(*) FILTER (WHERE label = 1) AS n_positive, count(*) FILTER (WHERE label = 0) AS n_negative,"
    " round(count(*) FILTER (WHERE label = 1)::DOUBLE / nullif(count(*) FILTER (WHERE label IS NOT NULL), 0), 4) AS positive_rate FROM made"
    " JOIN outcomes USING (entity_id) LEFT JOIN (SELECT entity_id, count(*) AS k FROM samples GROUP BY 1) USING (entity_id) GROUP BY split",
    rounded="positive_rate",
)
def split_summary(spark, folder):
    entities = V.outcomes(spark, folder)
    splits = S.stratified_entity_split(entities)
    return S.split_summary(sample_counts(entities, V.samples(spark, folder)), splits)


@query(
    "apply_split",
    with_("samples", "outcomes", "splits") + "SELECT entity_id, split, dense_rank() OVER (PARTITION BY split ORDER BY md5('0:' || entity_id)) - 1 AS group_index,"
    " label, severity, price FROM samples JOIN outcomes USING (entity_id) JOIN splits USING (entity_id) WHERE label IS NOT NULL AND split <> 'unlabelled'",
)
def apply_split(spark, folder):
    rows = V.samples(spark, folder).join(V.outcomes(spark, folder), "entity_id")
    return S.apply_split(rows, V.splits(spark, folder), ["price"])


_LAB = "WITH " + V.CTE["samples"] + ", " + V.CTE["outcomes"] + ", " + V.CTE["labelled"]


@query(
    "stratified_group_folds",
    f"{_LAB}, e AS (SELECT entity_id, max(label) AS label FROM labelled GROUP BY 1), f AS (SELECT entity_id, CAST((row_number() OVER (PARTITION BY label"
    " ORDER BY md5('42:' || entity_id)) - 1) % 5 AS INTEGER) AS fold FROM e) SELECT sample_id, entity_id, label, fold FROM labelled JOIN f USING (entity_id)",
)
def stratified_group_folds(spark, folder):
    return S.stratified_group_folds(V.labelled(spark, folder), 5).select("sample_id", "entity_id", "label", "fold")


@query(
    "stratified_folds",
    f"{_LAB} SELECT sample_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('42:' || sample_id)) - 1) % 5 AS INTEGER) AS fold FROM labelled",
)
def stratified_folds(spark, folder):
    return S.stratified_folds(V.labelled(spark, folder), 5).select("sample_id", "label", "fold")


# ---- preparation: lineitem measures with holes -----------------------------------------------------

_HOLES = {
    "quantity": "case when l_linenumber = 3 then null else l_quantity end",
    "price": "case when l_returnflag = 'A' and l_linenumber = 5 then null else l_extendedprice end",
    "discount": "l_discount",
}
_HOLE_SQL = (
    "m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate < TIMESTAMP '2000-01-01' AS train, CAST(l_returnflag = 'R' AS INTEGER) AS label, "
    + ", ".join(f"{e} AS {n}" for n, e in _HOLES.items()) + " FROM lineitem)"
)
_COLS = tuple(_HOLES)


def _measures(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("l_shipdate") < "2000-01-01").alias("train"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"), *[F.expr(e).alias(n) for n, e in _HOLES.items()],
    )


@query(
    "median_impute",
    f"WITH {_HOLE_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(
        f"coalesce({c}, (SELECT median({c}) FROM m WHERE train)) AS {c}" for c in _COLS) + " FROM m",
)
def median_impute(spark, folder):
    rows = _measures(spark, folder)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    return S.median_impute(rows, rows.where("train"), _COLS).select(*keys, *_COLS)


@query(
    "standardize",
    f"WITH {_HOLE_SQL} SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(
        f"({c} - (SELECT avg({c}) FROM m WHERE train)) / (SELECT stddev_pop({c}) FROM m WHERE train) AS {c}" for c in _COLS) + " FROM m",
    rounded=" ".join(_COLS),
)
def standardize(spark, folder):
    rows = _measures(spark, folder)
    return S.standardise(rows, rows.where("train"), _COLS).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *_COLS)


@query(
    "anova_select",
    f"WITH {_HOLE_SQL}, long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature_name, label, {c} AS v FROM m WHERE {c} IS NOT NULL" for c in _COLS)
    + "), g AS (SELECT feature_name, label, count(*) AS n, avg(v) AS mu, var_pop(v) AS s FROM long GROUP BY 1, 2), t AS (SELECT feature_name, avg(v) AS mu, count(*) AS n"
    " FROM long GROUP BY 1), f AS (SELECT g.feature_name, (sum(g.n * (g.mu - t.mu) * (g.mu - t.mu)) / (count(*) - 1)) / (sum(g.n * g.s) / (any_value(t.n) - count(*)))"
    " AS f_value FROM g JOIN t USING (feature_name) GROUP BY g.feature_name) SELECT feature_name, f_value, f_value > (SELECT quantile_cont(f_value, 0.5) FROM f) AS kept FROM f",
    rounded="f_value",
)
def anova_select(spark, folder):
    table_f = S.anova_f(_measures(spark, folder), _COLS)
    rows = {r.feature_name: r.f_value for r in table_f.collect()}
    keep = [_COLS[i] for i in S.percentile_choice([rows.get(c) for c in _COLS], 50)]
    return table_f.withColumn("kept", F.col("feature_name").isin(keep))


# ---- neighbours: vectors ---------------------------------------------------------------------------


def _vectors(rows, name):
    return rows.select(
        F.col("vec_id").alias(name), F.transform("embedding", lambda v: v.cast("double")).alias("vec"),
        (F.col("label") < 3).cast("int").alias("label"),
    )


_NEAR_SQL = (
    "WITH v AS (SELECT vec_id, list_transform(embedding, lambda z: z::DOUBLE) AS e, CAST(label < 3 AS INTEGER) AS label FROM embeddings),"
    f" part AS (SELECT *, {V.split_expr('vec_id')} AS split FROM v),"
    " d AS (SELECT q.vec_id AS query_id, t.vec_id, t.label, list_distance(q.e, t.e) AS dist FROM part q, part t WHERE q.split = 'test' AND t.split = 'train'),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 12), vec_id) AS r FROM d)"
)


def _neighbour_parts(spark, folder):
    rows = table(spark, folder, "embeddings").withColumn("split", F.expr(V.split_expr("vec_id")))
    queries = _vectors(rows.where("split = 'test'"), "query_id").drop("label")
    return queries, _vectors(rows.where("split = 'train'"), "train_id")


@query("knn_classify", f"{_NEAR_SQL} SELECT query_id, avg(label) AS prob FROM r WHERE r <= 9 GROUP BY query_id", rounded="prob")
def knn_classify(spark, folder):
    return knn_vote(*_neighbour_parts(spark, folder), 9)


_KS = (3, 5, 9, 15)


@query(
    "knn_grid", f"{_NEAR_SQL} SELECT query_id, " + ", ".join(f"avg(label) FILTER (WHERE r <= {k}) AS prob_{k}" for k in _KS) + " FROM r GROUP BY query_id",
    rounded=" ".join(f"prob_{k}" for k in _KS),
)
def knn_grid(spark, folder):
    return knn_votes(*_neighbour_parts(spark, folder), _KS)


_WIDTH = 64


@query(
    "vector_to_columns",
    "SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS dino_{i:03d}" for i in range(_WIDTH)) + " FROM embeddings",
)
def vector_to_columns(spark, folder):
    rows = table(spark, folder, "embeddings")
    wide = M.vector_columns(rows, "embedding", _WIDTH, "dino")
    back = M.columns_vector(wide, "dino", "embedding")
    return M.vector_columns(back, "embedding", _WIDTH, "dino")


# ---- models: entity table with outcome, split and folds --------------------------------------------

_A = ("balance", "nation")
_B = ("n_orders", "mean_price", "max_price")
FOLDS = 5


def _model_table(spark, folder, name):
    """Entities with two feature branches, split and folds, written once per query."""
    orders = V.samples(spark, folder).groupBy("entity_id").agg(
        F.count("*").cast("double").alias("n_orders"), F.avg("price").alias("mean_price"), F.max("price").alias("max_price")
    )
    rows = V.outcomes(spark, folder).where(F.col("label").isNotNull()).join(orders, "entity_id", "left")
    # The balance decides the label, so the branch sees it blurred by the nation.
    rows = rows.withColumn("balance", F.col("balance") + (F.col("nation") % 5) * 3000)
    rows = rows.join(S.stratified_entity_split(V.outcomes(spark, folder)), "entity_id")
    return materialise(S.stratified_group_folds(rows, FOLDS), name)


def _train(df):
    return df.where(F.col("split") == "train")


def _scores(fitted, df, features):
    rows = M.predict_prob(fitted.model, df.where(F.col("split") != "train").select("entity_id", "split", "label", *features))
    return rows.select("entity_id", "split", "label", "prob")


def _fit_and_score(spark, folder, config, strategy="standard", search=False, features=_A + _B):
    df = _model_table(spark, folder, config.name)
    return _scores(M.fit_model(config, _train(df), features, strategy, search=search, folds=FOLDS), df, features)


def _search_and_score(spark, folder, family, strategy="standard"):
    """Probabilities of val and test entities by the best setting of the family's grid over the folds."""
    df, features = _model_table(spark, folder, family.name), _A + _B
    blocks = G.train_blocks(_train(df), features, strategy)
    _, model = G.fit_best(blocks, family, G.search(blocks, [family], strategy))
    return G.score(df.where(F.col("split") != "train"), model, features).select("entity_id", "split", "label", "prob")


_FAMILY = {f.name: f for f in G.FAMILIES}


@query("logistic_l2", rounded="prob")
def logistic_l2(spark, folder):
    return _search_and_score(spark, folder, _FAMILY["LogisticRegression_L2"], "severity_weighted")


@query("logistic_elasticnet", rounded="prob")
def logistic_elasticnet(spark, folder):
    return _search_and_score(spark, folder, _FAMILY["LogisticRegression_EN"])


@query("hist_gradient_boosting", rounded="prob")
def hist_gradient_boosting(spark, folder):
    df, features = _model_table(spark, folder, "histograms"), _A + _B
    setting = B.Setting(rate=0.1, depth=3, leaves=15)
    model = B.fit(G.train_blocks(_train(df), features), [setting], [G.WHOLE])[setting.text(), G.WHOLE]
    return G.score(df.where(F.col("split") != "train"), model, features).select("entity_id", "split", "label", "prob")


@query("random_forest", rounded="prob")
def random_forest(spark, folder):
    config = M.ModelConfig("forest", "forest", defaults={"numTrees": 100, "maxDepth": 10}, scale=False, select=False)
    return _fit_and_score(spark, folder, config)


@query("gradient_boosting", rounded="prob")
def gradient_boosting(spark, folder):
    config = M.ModelConfig("boosting", "boosting", defaults={"maxIter": 100}, scale=False, select=False, balanced=False)
    return _fit_and_score(spark, folder, config)


# Closed form: class shares, class means and population variances of the train part after median imputation, each
# variance raised by 1e-9 of the largest variance of any feature.
_FEATURES = _A + _B
_NB_SQL = (
    with_("samples", "outcomes") + f", {_QUOTA_SQL}, o AS (SELECT entity_id, CAST(count(*) AS DOUBLE) AS n_orders, avg(price) AS mean_price, max(price) AS max_price FROM samples GROUP BY 1),"
    " raw AS (SELECT entity_id, split, label, CAST(balance + (nation % 5) * 3000 AS DOUBLE) AS balance, CAST(nation AS DOUBLE) AS nation, n_orders, mean_price, max_price"
    " FROM outcomes JOIN made USING (entity_id) LEFT JOIN o USING (entity_id) WHERE label IS NOT NULL),"
    " x AS (SELECT entity_id, split, label, " + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM raw WHERE split = 'train')) AS {c}" for c in _FEATURES) + " FROM raw),"
    " eps AS (SELECT 1e-9::DOUBLE * greatest(" + ", ".join(f"var_pop({c})" for c in _FEATURES) + ") AS e FROM x WHERE split = 'train'),"
    " k AS (SELECT label AS class, count(*) / sum(count(*)) OVER () AS share, " + ", ".join(f"avg({c}) AS m_{c}, var_pop({c}) + any_value(e) AS v_{c}" for c in _FEATURES)
    + " FROM x, eps WHERE split = 'train' GROUP BY label),"
    " s AS (SELECT entity_id, split, label, class, ln(share) - 0.5 * (" + " + ".join(f"ln(v_{c}) + ({c} - m_{c}) * ({c} - m_{c}) / v_{c}" for c in _FEATURES)
    + ") AS score FROM x, k WHERE split <> 'train')"
    " SELECT a.entity_id, a.split, a.label, 1.0 / (1.0 + exp(a.score - b.score)) AS prob FROM s a JOIN s b ON a.entity_id = b.entity_id AND a.class = 0 AND b.class = 1"
)


@query("gaussian_nb", _NB_SQL, rounded="prob")
def gaussian_nb(spark, folder):
    config = M.ModelConfig("bayes", "bayes", scale=False, select=False, takes_weights=False, balanced=False)
    return _fit_and_score(spark, folder, config)


@query("grid_search_cv", rounded="cv_auc_roc")
def grid_search_cv(spark, folder):
    df = _train(_model_table(spark, folder, "grid"))
    plain = G.search(G.train_blocks(df, _A + _B))
    weighted = G.search(G.train_blocks(df, _A + _B, "severity_weighted"), [f for f in G.FAMILIES if f.takes_weights], "severity_weighted")
    return plain.unionByName(weighted)


@query("predict_prob", rounded="prob")
def predict_prob(spark, folder):
    df = _model_table(spark, folder, "predict")
    fitted = M.fit_model(M.ModelConfig("tree", "tree", select=False), _train(df), _A, search=False)
    return _scores(fitted, df, _A)


@query("saved_model_prob", rounded="prob")
def saved_model_prob(spark, folder):
    df, features = _model_table(spark, folder, "saved"), _A + _B
    found = linear.path(G.train_blocks(_train(df), features), [1.0])
    place = scratch_path(spark, "model")
    G.save_model(spark, found[G.WHOLE, 1.0, 0.0, 0], features, place)
    model, names = G.load_model(spark, place)
    return G.score(df.where(F.col("split") != "train"), model, names).select("entity_id", "split", "label", "prob")


_PLAIN = M.ModelConfig("LogisticRegression", "logistic", select=False)
_TREES = M.ModelConfig("RandomForest", "forest", defaults={"numTrees": 100, "maxDepth": 5}, scale=False, select=False)


@query("late_fusion")
def late_fusion(spark, folder):
    return C.late_fusion(_model_table(spark, folder, "late"), (_TREES, _B), (_PLAIN, _A), search=False)


def _branch_probs(spark, folder, name):
    df = _model_table(spark, folder, name)
    out = df.where(F.col("split") != "train")
    for tag, config, features in (("a", _PLAIN, _A), ("b", _TREES, _B), ("c", _PLAIN, ("nation", "n_orders"))):
        out = M.predict_prob(M.fit_model(config, _train(df), features, search=False).model, out, f"prob_{tag}")
    return out.select("entity_id", "split", "label", "prob_a", "prob_b", "prob_c")


@query("stack_logistic")
def stack_logistic(spark, folder):
    probs = materialise(_branch_probs(spark, folder, "stack"), "branch-probs")
    two = C.stack_metrics(probs, ["prob_a", "prob_b"], "logistic")
    return two.unionByName(C.stack_metrics(probs, ["prob_a", "prob_b", "prob_c"], "logistic"))


@query("stack_tree")
def stack_tree(spark, folder):
    probs = materialise(_branch_probs(spark, folder, "stack"), "branch-probs")
    return C.stack_metrics(probs, ["prob_a", "prob_b"], "tree")


@query("fused_patient_eval")
def fused_patient_eval(spark, folder):
    splits = S.stratified_entity_split(V.outcomes(spark, folder))
    samples = V.labelled(spark, folder).join(splits, "entity_id")
    structured = V.outcomes(spark, folder).select("entity_id", "severity", *_A)
    return C.fused_entity_eval(samples, structured, list(_A), _PLAIN, late_year=2000)


_GRIDS = [_FAMILY[n] for n in ("LogisticRegression_L2", "LogisticRegression_EN", "GaussianNB")]


@query("compare_feature_sets")
def compare_feature_sets(spark, folder):
    df = _model_table(spark, folder, "compare")
    return G.compare_sets(df, {"a_only": _A, "b_only": _B, "fusion": _A + _B}, _GRIDS)


@query("refined_search")
def refined_search(spark, folder):
    df = _model_table(spark, folder, "refined")
    sets = nested_sets(["balance", "mean_price", "nation", "n_orders", "max_price"], [2, 3, "all"])
    rows = G.compare_sets(df, sets, _GRIDS[:2], ["standard"], tune="f1")
    return rows.orderBy(F.desc_nulls_last("test_auc_roc"), F.desc_nulls_last("test_tuned_f1"))
