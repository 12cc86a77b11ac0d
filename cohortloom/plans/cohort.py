"""Entity resolution, joins, roll-ups, windows and set queries (inventory 2.2, 2.4, 2.5, 2.6, 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions.text import name_candidates, norm_id
from cohortloom.operators import pairing as P
from cohortloom.operators import resolve as R
from cohortloom.operators import weights as W
from cohortloom.operators.counters import run_counters
from cohortloom.operators.selection import modeling_subset
from cohortloom.operators.split import split_overlaps
from cohortloom.plans import views as V
from cohortloom.plans.jobs import missing_folders
from cohortloom.plans.registry import query, table
from cohortloom.plans.scalars import CJK_NAME, CJK_TYPE, clean_sql
from cohortloom.plans.views import RESOLVED, with_
from cohortloom.session import materialise, scratch_path
from cohortloom.sources.tabular import append_new

# ---- registries and lookups ---------------------------------------------------------------------


@query(
    "src_projected_rename",
    "SELECT upper(trim(CAST(user_id AS VARCHAR))) AS entity_id, arg_max(event_type, event_id) AS kind,"
    " CAST(arg_max(value, event_id) AS VARCHAR) AS reading, arg_max(props, event_id) AS detail FROM events GROUP BY 1",
)
def src_projected_rename(spark, folder):
    columns = {"event_type": "kind", "value": "reading", "props": "detail"}
    return R.registry_last_wins(table(spark, folder, "events"), "user_id", "event_id", columns)


_FREE_TEXT = f"concat({CJK_TYPE}, '|', {CJK_NAME})"


@query(
    "src_name_lookup",
    "SELECT name, entity_id, count(*) OVER (PARTITION BY name) AS n_ids FROM (SELECT regexp_replace(p_name, '\\s+', '', 'g')"
    " AS name, upper(trim(p_brand)) AS entity_id FROM part UNION SELECT name, entity_id FROM (SELECT"
    f" {clean_sql('piece')} AS name, upper(trim(p_type)) AS entity_id FROM (SELECT p_type,"
    f" unnest(string_split({_FREE_TEXT}, '|')) AS piece FROM part)) WHERE name <> '')",
)
def src_name_lookup(spark, folder):
    part = table(spark, folder, "part")
    return R.name_lookup(
        R.name_rows(part, "p_brand", "p_name"), R.listed_name_rows(part, "p_type", name_candidates(F.expr(_FREE_TEXT)))
    )


def _known(spark, folder):
    return R.known_ids(V.registry_a(spark, folder), V.registry_b(spark, folder))


def _names(spark, folder):
    return R.unique_names(V.name_pairs(spark, folder))


def _resolved(spark, folder):
    return R.resolve_identity(V.raw_samples(spark, folder), _known(spark, folder), _names(spark, folder))


@query(
    "match_id",
    with_("raw", "reg_a", "reg_b", "known", "tried")
    + "SELECT t.sample_id, t.norm_id, k.entity_id IS NOT NULL AS hit, coalesce(k.in_a, false) AS in_a,"
    " coalesce(k.in_b, false) AS in_b FROM tried t LEFT JOIN known k ON k.entity_id = t.norm_id",
)
def match_id(spark, folder):
    out = R.match_id(V.raw_samples(spark, folder), _known(spark, folder))
    no = F.lit(False)
    return out.select(
        "sample_id", "norm_id", F.coalesce("id_hit", no).alias("hit"), F.coalesce("id_in_a", no).alias("in_a"),
        F.coalesce("id_in_b", no).alias("in_b"),
    )


@query(
    "match_ocr",
    with_("raw", "reg_a", "reg_b", "known", "tried")
    + "SELECT t.sample_id, f.entity_id AS corrected_id, CASE WHEN f.entity_id IS NOT NULL THEN 'normalized_from:' || t.norm_id"
    " END AS notes FROM tried t LEFT JOIN known f ON f.entity_id = t.fixed_id AND t.fixed_id <> t.norm_id"
    " LEFT JOIN known k ON k.entity_id = t.norm_id WHERE k.entity_id IS NULL",
)
def match_ocr(spark, folder):
    known = _known(spark, folder)
    left = R.match_id(V.raw_samples(spark, folder), known).where(F.col("id_hit").isNull())
    out = R.match_ocr(left, known)
    return out.select(
        "sample_id", F.when(F.col("ocr_hit"), F.col("ocr_id")).alias("corrected_id"),
        F.when(F.col("ocr_hit"), F.concat(F.lit("normalized_from:"), "norm_id")).alias("notes"),
    )


@query(
    "match_unique_name",
    with_("raw", "names") + "SELECT r.sample_id, r.candidate_name, n.entity_id AS name_id FROM raw r LEFT JOIN names n"
    " ON n.name = r.candidate_name",
)
def match_unique_name(spark, folder):
    out = R.match_unique_name(V.raw_samples(spark, folder), _names(spark, folder), _known(spark, folder))
    return out.select("sample_id", "candidate_name", "name_id")


@query(
    "resolve_identity",
    with_(*RESOLVED) + "SELECT sample_id, raw_id, entity_id, matched_by, matched_name, in_a, in_b, notes,"
    " CASE WHEN entity_id IS NULL THEN 'no_patient_info_match' END AS reason_code FROM resolved",
)
def resolve_identity(spark, folder):
    resolved = _resolved(spark, folder)
    out = R.matched_rows(resolved).unionByName(R.excluded_rows(resolved), allowMissingColumns=True)
    return out.select(
        "sample_id", "raw_id", "entity_id", "matched_by", F.coalesce("matched_name", F.lit("")).alias("matched_name"),
        F.coalesce("in_a", F.lit(False)).alias("in_a"), F.coalesce("in_b", F.lit(False)).alias("in_b"),
        F.coalesce("notes", F.lit("")).alias("notes"), "reason_code",
    )


# ---- artefacts and issues -----------------------------------------------------------------------

# Images: one per order, in the folder of its customer; stem carries view and sequence.
_IMAGES_SQL = (
    "images AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS entity_id, CAST(o_orderkey AS VARCHAR) AS stem,"
    " '/p/' || o_custkey || '/' || o_orderkey || '.jpg' AS path, CASE o_orderstatus WHEN 'F' THEN '左' ELSE '正' END AS view,"
    " CAST(1 + o_orderkey % 3 AS INTEGER) AS sequence FROM orders),"
    " measures AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS stem, '/t/' || l_orderkey || '.csv' AS path FROM lineitem"
    " UNION ALL SELECT 'event' || event_id, '/t/event' || event_id || '.csv' FROM events)"
)


def _images(spark, folder):
    return table(spark, folder, "orders").select(
        F.col("o_custkey").cast("string").alias("entity_id"),
        F.col("o_orderkey").cast("string").alias("stem"),
        F.concat(F.lit("/p/"), "o_custkey", F.lit("/"), "o_orderkey", F.lit(".jpg")).alias("path"),
        F.when(F.col("o_orderstatus") == "F", "左").otherwise("正").alias("view"),
        (1 + F.col("o_orderkey") % 3).cast("int").alias("sequence"),
    )


def _measures(spark, folder):
    a = table(spark, folder, "lineitem").select(F.col("l_orderkey").cast("string").alias("stem")).distinct()
    b = table(spark, folder, "events").select(F.concat(F.lit("event"), "event_id").alias("stem"))
    return a.unionByName(b).withColumn("path", F.concat(F.lit("/t/"), "stem", F.lit(".csv")))


@query(
    "pair_artifacts",
    f"WITH {_IMAGES_SQL} SELECT i.stem, i.entity_id, m.path AS measure_path,"
    " CASE WHEN m.path IS NULL THEN 'missing_temperature_csv' END AS code FROM images i LEFT JOIN measures m USING (stem)",
)
def pair_artifacts(spark, folder):
    paired, unpaired = R.pair_artifacts(_images(spark, folder), _measures(spark, folder))
    none = F.lit(None).cast("string")
    return paired.select("stem", "entity_id", "measure_path", none.alias("code")).unionByName(
        unpaired.select("stem", "entity_id", none.alias("measure_path"), F.lit("missing_temperature_csv").alias("code"))
    )


@query(
    "orphan_artifacts",
    f"WITH {_IMAGES_SQL} SELECT m.stem, m.path FROM measures m WHERE m.stem NOT IN (SELECT stem FROM images)",
)
def orphan_artifacts(spark, folder):
    return R.orphan_artifacts(_measures(spark, folder), _images(spark, folder)).select("stem", "path")


@query(
    "first_in_sorted",
    f"WITH {_IMAGES_SQL} SELECT entity_id, min(path) AS path, count(*) > 1 AS several FROM images WHERE sequence = 1 GROUP BY entity_id",
)
def first_in_sorted(spark, folder):
    return R.first_in_sorted(_images(spark, folder).where(F.col("sequence") == 1))


_GATE = (
    " gate AS (SELECT entity_id, bool_or(view = '正') AS fr, bool_or(view = '正' AND sequence = 1) AS fi FROM images"
    " GROUP BY entity_id)"
)


@query(
    "front_view_gate",
    f"WITH {_IMAGES_SQL},{_GATE} SELECT i.entity_id, i.stem, i.sequence, CAST(NULL AS VARCHAR) AS code FROM images i"
    " JOIN gate g USING (entity_id) WHERE i.view = '正' AND g.fi UNION ALL SELECT entity_id, NULL, NULL,"
    " CASE WHEN fr THEN 'missing_front_sequence_1' ELSE 'missing_front_image' END FROM gate WHERE NOT fi",
)
def front_view_gate(spark, folder):
    passed, rejected = R.front_view_gate(_images(spark, folder), "正")
    return passed.select("entity_id", "stem", "sequence", F.lit(None).cast("string").alias("code")).unionByName(
        rejected, allowMissingColumns=True
    )


# Folders that a build expects under the data folder; the first is there.
_FOLDERS = (
    ("missing_photo_dir", "2024", "orders.parquet"), ("missing_year_dir", "2023", "2023"),
    ("missing_photo_dir", "2025", "2025/photos"), ("missing_temperature_dir", "2025", "2025/measures"),
)
# In the layout with views, every thirteenth picture has a name that cannot be read.
_LOGGED_SQL = (
    f"WITH {_IMAGES_SQL}, first AS (SELECT entity_id, min(path) AS path, count(*) > 1 AS several FROM images"
    " WHERE sequence = 1 GROUP BY entity_id), readable AS (SELECT * FROM images WHERE o_orderkey % 13 <> 0),"
    " gate AS (SELECT entity_id, bool_or(view = '正') AS fr, bool_or(view = '正' AND sequence = 1) AS fi FROM readable GROUP BY entity_id), logged AS ("
    " SELECT 'missing_sequence_1_image' AS code, '2024' AS year, entity_id, '' AS path FROM (SELECT entity_id FROM images GROUP BY 1 HAVING NOT bool_or(sequence = 1))"
    " UNION ALL SELECT 'multiple_sequence_1_images', '2024', entity_id, path FROM first WHERE several"
    " UNION ALL SELECT 'missing_temperature_csv', '2024', entity_id, path FROM first f JOIN images i USING (entity_id, path) WHERE i.stem NOT IN (SELECT stem FROM measures)"
    " UNION ALL SELECT 'unparseable_image_name', '2025', '', path FROM images WHERE o_orderkey % 13 = 0"
    " UNION ALL SELECT CASE WHEN fr THEN 'missing_front_sequence_1' ELSE 'missing_front_image' END, '2025', entity_id, '' FROM gate WHERE NOT fi"
    " UNION ALL SELECT 'missing_temperature_csv', '2025', i.entity_id, i.path FROM readable i JOIN gate g USING (entity_id) WHERE i.view = '正' AND g.fi"
    " AND i.stem NOT IN (SELECT stem FROM measures)"
    " UNION ALL SELECT 'orphan_temperature_csv', '2025', '', path FROM measures WHERE stem NOT IN (SELECT stem FROM images)"
    + "".join(f" UNION ALL SELECT '{code}', '{year}', '', '{path}'" for code, year, path in _FOLDERS[1:])
    + ")"
)


def _issues(spark, folder):
    images, measures = _images(spark, folder), _measures(spark, folder)
    _, flat = R.source_samples_flat(images, measures, "2024")
    named = images.withColumn("view", F.when(F.col("stem").try_cast("bigint") % 13 != 0, F.col("view")))
    _, views = R.source_samples_views(named, measures, "2025", "正")
    absent = missing_folders(spark, [(code, year, f"{folder}/{path}") for code, year, path in _FOLDERS])
    absent = absent.withColumn("path", F.substr("path", F.lit(len(folder) + 2)))
    return flat.unionByName(views).unionByName(absent)


@query("issue_log", f"{_LOGGED_SQL} SELECT code, year, entity_id, path FROM logged")
def issue_log(spark, folder):
    """Every issue with its year, entity and path; a row each, nothing is counted away."""
    return _issues(spark, folder).select("code", "year", "entity_id", "path")


@query("issue_counts", f"{_LOGGED_SQL} SELECT code, count(*) AS n FROM logged GROUP BY code")
def issue_counts(spark, folder):
    return R.issue_counts(_issues(spark, folder))


@query(
    "issues_per_entity",
    f"{_LOGGED_SQL} SELECT year, entity_id, code, count(*) AS n, min(path) AS first_path, max(path) AS last_path FROM logged GROUP BY ALL",
)
def issues_per_entity(spark, folder):
    return R.issues_per_entity(_issues(spark, folder))


# ---- roll-ups -----------------------------------------------------------------------------------

_YEARS = (1999, 2000)
_SUMMARY_SQL = (
    "SELECT entity_id, count(*) AS sample_count, count(*) FILTER (WHERE year = 1999) AS n_1999,"
    " count(*) FILTER (WHERE year = 2000) AS n_2000, string_agg(DISTINCT matched_by, ';' ORDER BY matched_by) AS matched_by_values,"
    " string_agg(DISTINCT source_id, ';' ORDER BY source_id) AS source_ids FROM (SELECT *, upper(trim(raw_id, ' ' || chr(9)))"
    " AS source_id FROM resolved WHERE entity_id IS NOT NULL) GROUP BY entity_id"
)


def _included(spark, folder):
    rows = R.matched_rows(_resolved(spark, folder))
    return rows.withColumn("source_id", norm_id(F.col("raw_id")))


@query("entity_summary", with_(*RESOLVED) + _SUMMARY_SQL)
def entity_summary(spark, folder):
    return R.entity_summary(_included(spark, folder), _YEARS)


@query(
    "quality_distributions",
    with_(*RESOLVED) + f", summary AS ({_SUMMARY_SQL}) SELECT 'samples_per_entity' AS kind, CAST(sample_count AS VARCHAR) AS value,"
    " count(*) AS n FROM summary GROUP BY 2 UNION ALL SELECT 'year_pattern', '1999=' || n_1999 || ',2000=' || n_2000, count(*)"
    " FROM summary GROUP BY 2 UNION ALL SELECT 'matched_by', matched_by, count(*) FROM resolved WHERE entity_id IS NOT NULL"
    " GROUP BY 2 UNION ALL SELECT 'reason_code', 'no_patient_info_match', count(*) FROM resolved WHERE entity_id IS NULL"
    " HAVING count(*) > 0",
)
def quality_distributions(spark, folder):
    resolved = materialise(_resolved(spark, folder), "resolved")
    included = R.matched_rows(resolved).withColumn("source_id", norm_id(F.col("raw_id")))
    return R.quality_distributions(included, R.excluded_rows(resolved), R.entity_summary(included, _YEARS), _YEARS)


@query(
    "excluded_rollup",
    with_(*RESOLVED) + "SELECT raw_id, count(*) AS n, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years,"
    " 'no_patient_info_match' AS reasons, max(CASE WHEN candidate_name <> '' THEN candidate_name END) AS candidate_name FROM resolved"
    " WHERE entity_id IS NULL GROUP BY raw_id",
)
def excluded_rollup(spark, folder):
    return R.excluded_rollup(R.excluded_rows(_resolved(spark, folder)))


_PREFERRED_A = {"balance": "case c_nationkey % 5 when 0 then '' when 1 then 'missing' else cast(c_acctbal as string) end"}


def _registry_rows(spark, folder):
    a = table(spark, folder, "customer").select(
        F.expr(V.CUSTOMER_KEY).alias("entity_id"), F.expr(_PREFERRED_A["balance"]).alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    b = table(spark, folder, "events").groupBy(
        F.expr("concat('C', lpad(cast(user_id as string), 6, '0'))").alias("entity_id")
    ).agg(F.max("value").cast("string").alias("balance"), F.min("event_type").alias("kind"))
    return a, b


_MERGE_SQL = (
    ", a AS (SELECT "
    + V.CUSTOMER_KEY
    + f" AS entity_id, {_PREFERRED_A['balance']} AS balance, c_mktsegment AS segment FROM customer),"
    " b AS (SELECT concat('C', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS entity_id, CAST(max(value) AS VARCHAR) AS balance,"
    " min(event_type) AS kind FROM events GROUP BY 1), ents AS (SELECT DISTINCT entity_id FROM resolved WHERE entity_id IS NOT NULL),"
    " merged AS (SELECT e.entity_id, a.entity_id IS NOT NULL OR b.entity_id IS NOT NULL AS has_basic_data,"
    " concat_ws(';', CASE WHEN a.entity_id IS NOT NULL THEN 'clinical' END, CASE WHEN b.entity_id IS NOT NULL THEN 'multimodal' END)"
    " AS data_sources, a.entity_id IS NOT NULL AS in_a, b.entity_id IS NOT NULL AS in_b,"
    " coalesce(CASE WHEN a.balance NOT IN ('', 'missing') THEN a.balance END, b.balance, '') AS balance,"
    " coalesce(a.segment, '') AS segment, coalesce(b.kind, '') AS kind FROM ents e LEFT JOIN a USING (entity_id)"
    " LEFT JOIN b ON b.entity_id = e.entity_id)"
)


def _merged(spark, folder):
    entities = R.matched_rows(_resolved(spark, folder)).select("entity_id").distinct()
    a, b = _registry_rows(spark, folder)
    return R.merge_sources(entities, a, b, ["balance"], ["segment"], ["kind"])


@query("merge_sources", with_(*RESOLVED) + _MERGE_SQL + " SELECT * FROM merged")
def merge_sources(spark, folder):
    return _merged(spark, folder)


@query(
    "build_counters",
    with_(*RESOLVED)
    + _MERGE_SQL
    + _LOGGED_SQL.replace("WITH ", ", ", 1)
    + ", chosen AS (SELECT DISTINCT norm_id AS entity_id FROM tried)"
    " SELECT 'selected_samples' AS counter, (SELECT count(*) FROM resolved) AS n"
    " UNION ALL SELECT 'included_samples', (SELECT count(*) FROM resolved WHERE entity_id IS NOT NULL)"
    " UNION ALL SELECT 'excluded_samples', (SELECT count(*) FROM resolved WHERE entity_id IS NULL)"
    " UNION ALL SELECT 'selected_entities', (SELECT count(*) FROM chosen)"
    " UNION ALL SELECT 'registry_rows', (SELECT count(*) FROM reg_a)"
    " UNION ALL SELECT 'selected_missing_registry', (SELECT count(*) FROM chosen WHERE entity_id NOT IN (SELECT entity_id FROM reg_a))"
    " UNION ALL SELECT 'registry_missing_sample', (SELECT count(*) FROM reg_a WHERE entity_id NOT IN (SELECT entity_id FROM chosen))"
    " UNION ALL SELECT 'included_entities', (SELECT count(*) FROM merged)"
    " UNION ALL SELECT 'with_basic_data', (SELECT count(*) FROM merged WHERE has_basic_data)"
    " UNION ALL SELECT 'source_issues', (SELECT count(*) FROM logged)"
    " UNION ALL SELECT 'copied', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F')"
    " UNION ALL SELECT 'skipped_existing', (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')",
)
def build_counters(spark, folder):
    """Every counter of a build whose finished orders had been copied by a run before."""
    rows = V.samples(spark, folder).select("sample_id", "entity_id", "year", "status")
    path = scratch_path(spark, "copies")
    append_new(rows.where(F.col("status") == "F"), path, "sample_id")
    copies = append_new(rows, path, "sample_id").first()
    a, b = _registry_rows(spark, folder)
    columns = (["balance"], ["segment"], ["kind"])
    return run_counters(_resolved(spark, folder), a, b, _issues(spark, folder), columns, (copies.copied, copies.skipped))


@query(
    "coverage_diff",
    with_("reg_a", "reg_b") + "SELECT 'missing_registry' AS side, entity_id FROM reg_b WHERE entity_id NOT IN (SELECT entity_id FROM reg_a)"
    " UNION ALL SELECT 'missing_sample', entity_id FROM reg_a WHERE entity_id NOT IN (SELECT entity_id FROM reg_b)",
)
def coverage_diff(spark, folder):
    return R.coverage_diff(V.registry_b(spark, folder), V.registry_a(spark, folder))


@query(
    "enrich_with_status",
    "SELECT d.doc_id, d.lang, l.quality, l.toxic, CASE WHEN l.doc_id IS NULL THEN 'unmatched' ELSE 'matched' END AS match_status"
    " FROM documents d LEFT JOIN labels l USING (doc_id)",
)
def enrich_with_status(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("entity_id"), "lang")
    labels = table(spark, folder, "labels").withColumnRenamed("doc_id", "entity_id")
    return R.enrich_with_status(docs, labels).withColumnRenamed("entity_id", "doc_id")


@query("filter_matched", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def filter_matched(spark, folder):
    return R.filter_matched(enrich_with_status(spark, folder)).select("doc_id", "lang", "quality")


def _exclusions(spark, folder):
    return table(spark, folder, "events").select(F.col("event_id").alias("sample_id")).where(F.col("event_type") == "error")


def _annotation_states(spark, folder):
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("sample_id")).agg(
        F.when(F.max("l_returnflag") == "R", "ok").otherwise("no_face").alias("status")
    )


_ELIGIBLE_SQL = (
    ", excluded AS (SELECT event_id AS sample_id FROM events WHERE event_type = 'error'), annotated AS (SELECT l_orderkey AS sample_id,"
    " CASE WHEN max(l_returnflag) = 'R' THEN 'ok' ELSE 'no_face' END AS status FROM lineitem GROUP BY 1)"
)


@query(
    "filter_eligible",
    with_("samples", "splits") + _ELIGIBLE_SQL + " SELECT s.sample_id, s.entity_id, s.year, p.split FROM samples s JOIN splits p"
    " USING (entity_id) JOIN annotated a ON a.sample_id = s.sample_id AND a.status = 'ok' WHERE p.split <> 'unlabelled'"
    " AND s.sample_id NOT IN (SELECT sample_id FROM excluded)",
)
def filter_eligible(spark, folder):
    return R.filter_eligible(
        V.samples(spark, folder), V.splits(spark, folder), _exclusions(spark, folder), _annotation_states(spark, folder)
    ).select("sample_id", "entity_id", "year", "split")


@query(
    "attrition_funnel",
    with_("samples", "splits") + _ELIGIBLE_SQL + ", f AS (SELECT s.sample_id NOT IN (SELECT sample_id FROM excluded) AS a,"
    " p.split <> 'unlabelled' AS b, x.status IS NOT NULL AS c, coalesce(x.status = 'ok', false) AS d FROM samples s JOIN splits p"
    " USING (entity_id) LEFT JOIN annotated x ON x.sample_id = s.sample_id) SELECT CAST(0 AS INTEGER) AS step, 'all' AS stage, count(*) AS n FROM f"
    " UNION ALL SELECT 1, 'not_excluded', count(*) FILTER (WHERE a) FROM f"
    " UNION ALL SELECT 2, 'in_split', count(*) FILTER (WHERE a AND b) FROM f"
    " UNION ALL SELECT 3, 'annotated', count(*) FILTER (WHERE a AND b AND c) FROM f"
    " UNION ALL SELECT 4, 'status_ok', count(*) FILTER (WHERE a AND b AND c AND d) FROM f",
)
def attrition_funnel(spark, folder):
    return R.attrition_funnel(
        V.samples(spark, folder), V.splits(spark, folder), _exclusions(spark, folder), _annotation_states(spark, folder)
    )


# ---- feature joins ------------------------------------------------------------------------------


@query(
    "fusion_left",
    with_("samples", "outcomes") + "SELECT s.sample_id, s.entity_id, s.prob, o.balance, o.nation FROM samples s LEFT JOIN outcomes o USING (entity_id)",
)
def fusion_left(spark, folder):
    entities = V.outcomes(spark, folder).withColumnRenamed("entity_id", "key")
    out = R.fusion_left(V.samples(spark, folder), entities, "entity_id", "key", ["balance", "nation"])
    return out.select("sample_id", "entity_id", "prob", "balance", "nation")


def _events_by_user(spark, folder):
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("entity_id")).agg(
        F.count("*").alias("n_events"), F.max("value").alias("top_value")
    )


_USERS_SQL = ", users AS (SELECT user_id AS entity_id, count(*) AS n_events, max(value) AS top_value FROM events GROUP BY 1)"


@query(
    "fusion_inner",
    with_("outcomes") + _USERS_SQL + " SELECT o.entity_id, o.label, o.balance, u.n_events, u.top_value FROM outcomes o JOIN users u USING (entity_id)",
)
def fusion_inner(spark, folder):
    out = R.fusion_inner(V.outcomes(spark, folder), _events_by_user(spark, folder), "entity_id", ["n_events", "top_value"])
    return out.select("entity_id", "label", "balance", "n_events", "top_value")


def _structured(spark, folder):
    a = V.outcomes(spark, folder).select(
        "entity_id", "label", "severity", "balance",
        F.when(F.col("nation") % 7 == 3, "unmatched").otherwise("matched").alias("match_status"),
    )
    return R.structured_table(a, _events_by_user(spark, folder), ["balance"], ["n_events", "top_value"])


@query(
    "structured_table",
    with_("outcomes") + _USERS_SQL + " SELECT entity_id, CAST(label AS DOUBLE) AS label, CAST(severity AS DOUBLE) AS severity, balance,"
    " CAST(n_events AS DOUBLE) AS n_events, top_value FROM outcomes JOIN users USING (entity_id) WHERE nation % 7 <> 3 AND label IS NOT NULL"
    " AND balance IS NOT NULL AND top_value IS NOT NULL",
)
def structured_table(spark, folder):
    return _structured(spark, folder)


@query(
    "broadcast_entity_features",
    with_("samples", "outcomes") + "SELECT sample_id, entity_id, balance, nation FROM samples JOIN outcomes USING (entity_id)",
)
def broadcast_entity_features(spark, folder):
    out = R.attach_entity_features(V.samples(spark, folder), V.outcomes(spark, folder), ["balance", "nation"])
    return out.select("sample_id", "entity_id", "balance", "nation")


@query(
    "complete_case",
    with_("samples", "outcomes") + _USERS_SQL + " SELECT s.sample_id, s.entity_id FROM samples s WHERE s.entity_id IN (SELECT entity_id"
    " FROM outcomes WHERE label IS NOT NULL INTERSECT SELECT entity_id FROM users)",
)
def complete_case(spark, folder):
    pool = R.complete_case(V.outcomes(spark, folder).where(F.col("label").isNotNull()), _events_by_user(spark, folder))
    return V.samples(spark, folder).join(pool, "entity_id", "left_semi").select("sample_id", "entity_id")


@query(
    "sample_metadata_lookup",
    "SELECT l_orderkey AS sample_id, max(l_suppkey) FILTER (WHERE r = 1) AS entity_id, CAST(max(year(l_shipdate)) FILTER (WHERE r = 1)"
    " AS INTEGER) AS year FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey DESC,"
    " l_suppkey DESC) AS r FROM lineitem) GROUP BY l_orderkey",
)
def sample_metadata_lookup(spark, folder):
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_suppkey").alias("entity_id"), F.year("l_shipdate").alias("year"),
        F.struct("l_extendedprice", "l_partkey", "l_suppkey").alias("place"),
    )
    return R.sample_metadata(rows, "place")


# ---- pairs and weights --------------------------------------------------------------------------

_PAIR = (
    "SELECT CAST(entity_id AS VARCHAR) || '_' || a || '__' || b AS pair_id, entity_id, a AS sample_id_a, b AS sample_id_b,"
    " '{mode}' AS mode FROM ({rows})"
)


@query(
    "pair_cross_all",
    with_("samples")
    + _PAIR.format(
        mode="cross_year_all",
        rows="SELECT x.entity_id, CAST(x.sample_id AS VARCHAR) AS a, CAST(y.sample_id AS VARCHAR) AS b FROM samples x JOIN samples y"
        " USING (entity_id) WHERE x.year = 1999 AND y.year = 2000",
    ),
)
def pair_cross_all(spark, folder):
    return P.build_pairs(V.samples(spark, folder), "cross_year_all", *_YEARS)


@query(
    "pair_cross_first",
    with_("samples")
    + _PAIR.format(
        mode="cross_year_first",
        rows="SELECT entity_id, min(CAST(sample_id AS VARCHAR)) FILTER (WHERE year = 1999) AS a, min(CAST(sample_id AS VARCHAR))"
        " FILTER (WHERE year = 2000) AS b FROM samples GROUP BY entity_id",
    )
    + " WHERE a IS NOT NULL AND b IS NOT NULL",
)
def pair_cross_first(spark, folder):
    return P.build_pairs(V.samples(spark, folder), "cross_year_first", *_YEARS)


@query(
    "pair_within_first2",
    with_("samples")
    + _PAIR.format(
        mode="within_late_first2",
        rows="SELECT entity_id, max(s) FILTER (WHERE r = 1) AS a, max(s) FILTER (WHERE r = 2) AS b FROM (SELECT entity_id,"
        " CAST(sample_id AS VARCHAR) AS s, row_number() OVER (PARTITION BY entity_id ORDER BY CAST(sample_id AS VARCHAR)) AS r"
        " FROM samples WHERE year = 2000) GROUP BY entity_id",
    )
    + " WHERE b IS NOT NULL",
)
def pair_within_first2(spark, folder):
    return P.build_pairs(V.samples(spark, folder), "within_late_first2", *_YEARS)


_SIDE_LABEL = "CAST(CASE WHEN price > 250000 THEN 1 ELSE 0 END AS INTEGER)"


@query(
    "pair_label_check",
    with_("samples") + ", rows AS (SELECT entity_id, year, " + _SIDE_LABEL + " AS label, sample_id % 2 AS severity FROM samples)"
    " SELECT entity_id, bool_or(x.label <> y.label) AS label_differs, bool_or(x.severity <> y.severity) AS severity_differs"
    " FROM rows x JOIN rows y USING (entity_id) WHERE x.year = 1999 AND y.year = 2000 GROUP BY entity_id"
    " HAVING bool_or(x.label <> y.label) OR bool_or(x.severity <> y.severity)",
)
def pair_label_check(spark, folder):
    rows = V.samples(spark, folder).select(
        "entity_id", "year", F.expr("case when price > 250000 then 1 else 0 end").alias("label"),
        (F.col("sample_id") % 2).alias("severity"),
    )
    return P.pair_mismatches(rows, *_YEARS)


@query(
    "balance_weight",
    with_("samples") + "SELECT sample_id, entity_id, 1.0 / count(*) OVER (PARTITION BY entity_id) AS weight FROM samples",
    rounded="weight",
)
def balance_weight(spark, folder):
    return W.balance_weight(V.samples(spark, folder)).select("sample_id", "entity_id", "weight")


@query(
    "pair_weights",
    with_("samples") + "SELECT entity_id, a * b AS n_pairs, 1.0 / (a * b) AS pair_weight FROM (SELECT entity_id, count(*) FILTER (WHERE year = 1999) AS a,"
    " count(*) FILTER (WHERE year = 2000) AS b FROM samples GROUP BY 1) WHERE a * b > 0",
    rounded="pair_weight",
)
def pair_weights(spark, folder):
    return P.pair_counts(V.samples(spark, folder), *_YEARS).select("entity_id", "n_pairs", "pair_weight")


@query(
    "sample_counts",
    with_("outcomes") + "SELECT entity_id, label, severity, sample_count FROM outcomes LEFT JOIN (SELECT o_custkey AS entity_id,"
    " count(*) AS sample_count FROM orders GROUP BY 1) USING (entity_id)",
)
def sample_counts(spark, folder):
    out = W.sample_counts(V.outcomes(spark, folder), V.samples(spark, folder))
    return out.select("entity_id", "label", "severity", "sample_count")


@query(
    "class_weights",
    with_("labelled") .replace("labelled AS", V.CTE["samples"] + ", " + V.CTE["outcomes"] + ", labelled AS")
    + ", pairs AS (SELECT entity_id, max(label) AS label, count(*) FILTER (WHERE year = 1999) * count(*) FILTER (WHERE year = 2000) AS n"
    " FROM labelled GROUP BY 1), both_levels AS (SELECT 'samples' AS level, count(*) FILTER (WHERE label = 0) AS n_neg,"
    " count(*) FILTER (WHERE label = 1) AS n_pos FROM labelled UNION ALL SELECT 'pairs', CAST(coalesce(sum(n) FILTER (WHERE label = 0), 0) AS BIGINT),"
    " CAST(coalesce(sum(n) FILTER (WHERE label = 1), 0) AS BIGINT) FROM pairs) SELECT level, n_neg, n_pos,"
    " coalesce((n_neg + n_pos) / nullif(2.0 * n_neg, 0), 1.0) AS weight_neg, coalesce((n_neg + n_pos) / nullif(2.0 * n_pos, 0), 1.0) AS weight_pos"
    " FROM both_levels",
    rounded="weight_neg weight_pos",
)
def class_weights(spark, folder):
    rows = V.labelled(spark, folder)
    pairs = P.pair_counts(rows, *_YEARS).join(
        V.outcomes(spark, folder).select("entity_id", "label"), "entity_id"
    )
    a = W.class_weights(rows).withColumn("level", F.lit("samples"))
    return a.unionByName(W.pair_class_weights(pairs).withColumn("level", F.lit("pairs")))


_LAB = V.CTE["samples"] + ", " + V.CTE["outcomes"] + ", " + V.CTE["labelled"]


@query(
    "severity_weights",
    f"WITH {_LAB}, n AS (SELECT count(*) FILTER (WHERE label = 0) AS neg, count(*) FILTER (WHERE label = 1) AS pos FROM labelled)"
    " SELECT sample_id, CASE WHEN label = 1 THEN (neg::DOUBLE / pos) * CASE severity WHEN 2 THEN 2.0 WHEN 3 THEN 3.0 ELSE 1.0 END ELSE 1.0 END AS weight,"
    " CASE WHEN label = 1 THEN (neg + pos) / (2.0 * pos) * CASE severity WHEN 2 THEN 1.5 WHEN 3 THEN 2.0 ELSE 1.0 END"
    " ELSE (neg + pos) / (2.0 * neg) END AS training_weight FROM labelled, n",
    rounded="weight training_weight",
)
def severity_weights(spark, folder):
    rows = W.severity_weights(V.labelled(spark, folder))
    return W.training_weights(rows, name="training_weight").select("sample_id", "weight", "training_weight")


# ---- projections, limits, sets ------------------------------------------------------------------


@query(
    "project_modeling_subset",
    "SELECT doc_id, quality AS label, n_chars FROM documents JOIN labels USING (doc_id)",
)
def project_modeling_subset(spark, folder):
    rows = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").withColumnRenamed("quality", "label")
    return modeling_subset(rows, ["doc_id", "match_status", "label", "severity"], ["n_chars"])


@query("limit_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def limit_rows(spark, folder):
    return table(spark, folder, "orders").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("union_ids", with_("reg_a", "reg_b") + "SELECT entity_id FROM reg_a UNION SELECT entity_id FROM reg_b")
def union_ids(spark, folder):
    return V.registry_a(spark, folder).union(V.registry_b(spark, folder)).distinct()


@query("intersect_pools", with_("reg_a", "reg_b") + "SELECT entity_id FROM reg_a INTERSECT SELECT entity_id FROM reg_b")
def intersect_pools(spark, folder):
    return R.complete_case(V.registry_a(spark, folder), V.registry_b(spark, folder))


@query("except_ids", with_("reg_a", "reg_b") + "SELECT entity_id FROM reg_a EXCEPT SELECT entity_id FROM reg_b")
def except_ids(spark, folder):
    return V.registry_a(spark, folder).subtract(V.registry_b(spark, folder))


_DOUBLE_SPLIT = (
    "SELECT o_custkey AS entity_id, CASE WHEN o_totalprice > 495000 THEN 'test' ELSE 'train' END AS split FROM orders"
)


@query(
    "disjointness_check",
    f"SELECT entity_id, min(split) AS first_split, max(split) AS last_split FROM ({_DOUBLE_SPLIT}) GROUP BY 1"
    " HAVING count(DISTINCT split) > 1",
)
def disjointness_check(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("entity_id"),
        F.when(F.col("o_totalprice") > 495000, "test").otherwise("train").alias("split"),
    )
    return split_overlaps(rows)
