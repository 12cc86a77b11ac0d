"""Column-expression queries (inventory 2.2 and 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.functions import geometry as G
from cohortloom.functions import numeric as N
from cohortloom.functions import text as X
from cohortloom.operators.scoring import numeric_features, parseable_counts
from cohortloom.operators.raster import minmax_uint8
from cohortloom.plans.registry import query, table, wide_table
from cohortloom.plans.views import CUSTOMER_KEY, outcomes, with_
from cohortloom.sources.rasters import range_normalised

# Test derivation only: ASCII letters to ideographs, so that name rules have something to find.
LATIN = "abcdefghijklmnopqrstuvwxyz"
IDEOGRAPHS = "".join(chr(0x4E00 + 37 * i) for i in range(26))
NOISY_ID = "concat('  ', lower(c_name), chr(9))"
CJK_NAME = f"translate(lower(p_name), '{LATIN}', '{IDEOGRAPHS}')"
CJK_TYPE = f"translate(lower(p_type), '{LATIN}', '{IDEOGRAPHS}')"
NAME_TEXT = f"""concat(
  case p_size % 4 when 0 then '(有重名)' when 1 then '12' when 2 then 'AB123' else '村+7' end,
  {CJK_NAME}, case when p_size % 3 = 0 then '_' else ' ' end)"""
NAME_LIST = f"concat({CJK_NAME}, '|', {CJK_TYPE}, ';', p_brand, ',', {CJK_NAME})"
STEM = """concat(case c_custkey % 4 when 0 then concat('AB', lpad(cast(c_custkey % 1000 as string), 3, '0'))
  when 1 then concat(lpad(cast(c_custkey % 1000 as string), 3, '0'), 'XY') when 2 then 'NOID ' else '' end,
  case when c_custkey % 2 = 0 then '-' else '' end,
  case c_nationkey % 4 when 0 then '正' when 1 then '左' when 2 then '右' else '?' end,
  case when c_custkey % 3 = 0 then ' - ' else '' end, cast(c_custkey % 7 as string))"""
SEQ_STEM = f"""concat(case when o_orderkey % 5 = 4 then 'other' else concat('C', cast(o_custkey as string)) end,
  case when o_orderkey % 2 = 0 then '-' else '' end,
  case when o_orderkey % 7 = 6 then 'x' else cast(o_orderkey % 13 as string) end)"""
_CLEAN_SQL = (
    "coalesce((regexp_extract_all(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    "regexp_replace({t}, '[（(]有重名[）)]', '', 'g'), '\\s+', '', 'g'), '^.*?\\+\\d*', ''), '^\\d+', ''),"
    " '^[A-Za-z]{{1,3}}\\d{{3}}', ''), '_-'), '[\\x{{4e00}}-\\x{{9fff}}]{{2,5}}'))[-1], '')"
)


def clean_sql(text: str) -> str:
    return _CLEAN_SQL.format(t=text)


@query("norm_id", f"SELECT c_custkey, upper(trim({NOISY_ID}, ' ' || chr(9))) AS entity_id FROM customer")
def norm_id(spark, folder):
    return table(spark, folder, "customer").select("c_custkey", X.norm_id(F.expr(NOISY_ID)).alias("entity_id"))


@query(
    "sample_key",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '_' || o_custkey || '_' || (o_orderkey % 9) AS sample_id"
    " FROM orders",
)
def sample_key(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey", F.concat_ws("_", F.year("o_orderdate"), "o_custkey", F.col("o_orderkey") % 9).alias("sample_id")
    )


_PRICE_TEXT = (
    "case o_orderstatus when 'P' then 'missing' when 'O' then concat(cast(o_totalprice as string), 'x')"
    " else concat(' ', cast(o_totalprice as string)) end"
)


@query(
    "coerce_numeric",
    f"SELECT o_orderkey, TRY_CAST({_PRICE_TEXT} AS DOUBLE) AS price FROM orders",
)
def coerce_numeric(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", N.coerce_numeric(F.expr(_PRICE_TEXT)).alias("price"))


_PRIMARY = "case c_nationkey % 4 when 0 then '' when 1 then 'missing' when 2 then null else c_mktsegment end"


@query(
    "prefer_fallback",
    f"SELECT c_custkey, coalesce(CASE WHEN p NOT IN ('', 'missing') THEN p END, s, '') AS preferred FROM"
    f" (SELECT c_custkey, {_PRIMARY} AS p, s FROM customer LEFT JOIN (SELECT s_nationkey, min(s_name) AS s"
    " FROM supplier GROUP BY 1) f ON f.s_nationkey = c_nationkey)",
)
def prefer_fallback(spark, folder):
    first = (
        table(spark, folder, "supplier")
        .groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("s"))
    )
    rows = table(spark, folder, "customer").join(first, "c_nationkey", "left")
    return rows.select("c_custkey", N.prefer(F.expr(_PRIMARY), F.col("s")).alias("preferred"))


@query(
    "select_numeric_features",
    "SELECT column_name AS feature, CAST(n AS BIGINT) AS n_parseable, column_type NOT IN ('VARCHAR', 'DATE', 'TIMESTAMP') AS is_numeric"
    " FROM (DESCRIBE lineitem) JOIN (UNPIVOT (SELECT count(TRY_CAST(CAST(COLUMNS(*) AS VARCHAR) AS DOUBLE)) FROM lineitem)"
    " ON COLUMNS(*) INTO NAME feature VALUE n) USING (feature)".replace(" USING (feature)", " u ON u.feature = column_name"),
)
def select_numeric_features(spark, folder):
    lines = table(spark, folder, "lineitem")
    numeric = set(numeric_features(lines, prefix="l_"))
    wide = parseable_counts(lines, lines.columns)
    return wide.unpivot([], lines.columns, "feature", "n_parseable").withColumn(
        "is_numeric", F.col("feature").isin(*sorted(numeric))
    )


@query(
    "parse_seq_for_entity",
    f"SELECT o_orderkey, CASE WHEN starts_with(stem, entity) THEN TRY_CAST(nullif(regexp_extract(substr(stem,"
    " length(entity) + 1), '^-?(\\d+)$', 1), '') AS INTEGER) END AS sequence FROM (SELECT o_orderkey,"
    f" {SEQ_STEM} AS stem, concat('C', cast(o_custkey as string)) AS entity FROM orders)",
)
def parse_seq_for_entity(spark, folder):
    entity = F.expr("concat('C', cast(o_custkey as string))")
    return table(spark, folder, "orders").select(
        "o_orderkey", X.sequence_for_entity(F.expr(SEQ_STEM), entity).alias("sequence")
    )


@query(
    "parse_stem",
    "SELECT c_custkey, CASE WHEN ok THEN coalesce(nullif(regexp_extract(raw, '^(\\d{3}[A-Z]{2}|[A-Z]{1,3}\\d{3})', 1), ''), raw) END"
    " AS entity_id, CASE WHEN ok THEN regexp_extract(stem, p, 2) END AS view,"
    " CASE WHEN ok THEN TRY_CAST(regexp_extract(stem, p, 3) AS INTEGER) END AS sequence FROM (SELECT *,"
    " regexp_matches(stem, p) AS ok, trim(regexp_extract(stem, p, 1)) AS raw FROM (SELECT c_custkey,"
    f" {STEM} AS stem, '^(.+?)-?(正|仰|左|右)\\s*-?\\s*(\\d+)$' AS p FROM customer))".replace("regexp_extract(stem, p,", "regexp_extract(stem, '^(.+?)-?(正|仰|左|右)\\s*-?\\s*(\\d+)$',").replace("regexp_matches(stem, p)", "regexp_matches(stem, '^(.+?)-?(正|仰|左|右)\\s*-?\\s*(\\d+)$')"),
)
def parse_stem(spark, folder):
    parsed = table(spark, folder, "customer").select("c_custkey", X.parse_stem(F.expr(STEM)).alias("s"))
    return parsed.select("c_custkey", "s.*")


@query("norm_name", f"SELECT p_partkey, regexp_replace({CJK_NAME}, '\\s+', '', 'g') AS name FROM part")
def norm_name(spark, folder):
    return table(spark, folder, "part").select("p_partkey", X.norm_name(F.expr(CJK_NAME)).alias("name"))


@query("clean_name", f"SELECT p_partkey, {clean_sql(NAME_TEXT)} AS name FROM part")
def clean_name(spark, folder):
    return table(spark, folder, "part").select("p_partkey", X.clean_name(F.expr(NAME_TEXT)).alias("name"))


@query(
    "name_candidates",
    "SELECT p_partkey, count(name) AS n_names, coalesce(string_agg(name, '|' ORDER BY pos), '') AS names FROM"
    " (SELECT p_partkey, name, min(pos) AS pos FROM (SELECT p_partkey, pos,"
    f" nullif({clean_sql('piece')}, '') AS name FROM (SELECT p_partkey, unnest(parts) AS piece,"
    " generate_subscripts(parts, 1) AS pos FROM (SELECT p_partkey,"
    f" string_split(replace(replace({NAME_LIST}, ';', '|'), ',', '|'), '|') AS parts FROM part)))"
    " GROUP BY p_partkey, name) GROUP BY p_partkey",
)
def name_candidates(spark, folder):
    found = table(spark, folder, "part").select("p_partkey", X.name_candidates(F.expr(NAME_LIST)).alias("c"))
    return found.select("p_partkey", F.size("c").cast("long").alias("n_names"), F.array_join("c", "|").alias("names"))


_TYPED = f"translate({CUSTOMER_KEY}, '0158', 'OISB')"


@query(
    "ocr_variant",
    f"SELECT c_custkey, raw, CASE WHEN translate(raw, 'OILSB', '01158') <> raw THEN translate(raw, 'OILSB', '01158') END"
    f" AS fixed FROM (SELECT c_custkey, {_TYPED} AS raw FROM customer)",
)
def ocr_variant(spark, folder):
    raw = table(spark, folder, "customer").select("c_custkey", F.expr(_TYPED).alias("raw"))
    fixed = X.digits_for_lookalikes(F.col("raw"))
    return raw.withColumn("fixed", F.when(fixed != F.col("raw"), fixed))


_FILE = "concat(' ', url, '/', cast(page_id as string), ' _asr_v1.json')"


@query(
    "id_from_filename",
    f"SELECT page_id, trim(string_split(regexp_replace(string_split({_FILE}, '/')[-1], '\\.[^.]*$', ''), '_')[1]) AS entity_id FROM pages",
)
def id_from_filename(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.id_from_filename(F.expr(_FILE)).alias("entity_id"))


_NORM = "regexp_replace(coalesce({t}, ''), '[^\\x{{4e00}}-\\x{{9fff}}A-Za-z0-9]+', '', 'g')"


@query("norm_text", f"SELECT conv_id, turn, role, {_NORM.format(t='text')} AS body FROM conversations")
def norm_text(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", X.norm_text(F.col("text")).alias("body")
    )


# Fillers of the test prose: the oracle counts the same characters as the operator.
_PROFILE_SQL = (
    "SELECT doc_id, CAST(length(text) AS DOUBLE) AS char_count, CAST(n AS DOUBLE) AS norm_char_count,"
    " CAST(u AS DOUBLE) AS unique_char_count, u / nullif(n, 0) AS unique_char_ratio, CAST(t AS DOUBLE) AS token_count,"
    " CAST(f AS DOUBLE) AS filler_count, f / nullif(n, 0) AS filler_ratio, CAST(r AS DOUBLE) AS repeat_count,"
    " r / nullif(n, 0) AS repeat_ratio, CASE WHEN ms > 0 THEN n / (ms / 1000.0) END AS chars_per_second,"
    " n / nullif(lines, 0) AS chars_per_sentence_overall FROM (SELECT doc_id, text, CAST(length(body) AS DOUBLE) AS n,"
    " CAST(list_unique(string_split(body, '')) AS DOUBLE) * sign(length(body)) AS u,"
    " CAST(len(list_filter(string_split_regex(text, '[，。！？；：、,.!?;:\\s\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda x: x <> '')) AS DOUBLE) AS t,"
    " CAST(length(body) - length(translate(body, '啊嗯呃哦', '')) AS DOUBLE) AS f,"
    " CAST(len(list_filter(list_zip(string_split(body, '')[:-2], string_split(body, '')[2:]), lambda p: p[1] = p[2])) AS DOUBLE) AS r,"
    " CAST(length(text) * 60 AS DOUBLE) AS ms, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS lines"
    f" FROM (SELECT doc_id, text, {_NORM.format(t='text')} AS body FROM documents))"
)
_PROFILE = (
    "char_count norm_char_count unique_char_count unique_char_ratio token_count filler_count filler_ratio repeat_count"
    " repeat_ratio chars_per_second chars_per_sentence_overall"
)


@query("text_profile", _PROFILE_SQL, rounded=_PROFILE)
def text_profile(spark, folder):
    lines = F.size(F.split("text", "\n"))
    cols = X.text_profile(F.col("text"), lines, (F.length("text") * 60).cast("double"))
    return wide_table(spark, folder, "documents", "doc_id", "text").select("doc_id", *[c.alias(n) for n, c in cols.items()])


@query(
    "edit_distance",
    "SELECT p_partkey, CAST(levenshtein(lower(p_name), lower(p_type)) AS INTEGER) AS distance FROM part",
)
def edit_distance(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", F.levenshtein(F.lower("p_name"), F.lower("p_type")).alias("distance")
    )


_DEVIATION = (
    "reference_length observed_length edit_distance char_error_rate length_ratio deletion_proxy insertion_proxy"
)


# The SQL engine's distance counts bytes. No document holds a character of the prompt, so one ASCII sign that none
# holds either stands for each of its characters and every distance stays the same.
_PROMPT_SQL = "'" + X.READING_PROMPT.replace("'", "''") + "'"


@query(
    "reference_deviation",
    "SELECT doc_id, CAST(m AS DOUBLE) AS reference_length, CAST(n AS DOUBLE) AS observed_length,"
    " CAST(d AS DOUBLE) AS edit_distance, d / greatest(m, 1.0) AS char_error_rate, n / greatest(m, 1.0) AS length_ratio,"
    " greatest(m - n, 0.0) / greatest(m, 1.0) AS deletion_proxy, greatest(n - m, 0.0) / greatest(n, 1.0) AS insertion_proxy"
    " FROM (SELECT doc_id, CAST(length(a) AS DOUBLE) AS n, CAST(length(b) AS DOUBLE) AS m, CAST(levenshtein(a, b) AS DOUBLE) AS d"
    f" FROM (SELECT doc_id, {_NORM.format(t='text')} AS a, repeat('#', length({_NORM.format(t=_PROMPT_SQL)})) AS b FROM documents))",
    rounded=_DEVIATION,
)
def reference_deviation(spark, folder):
    cols = X.reference_deviation(F.col("text"), F.lit(X.READING_PROMPT))
    return wide_table(spark, folder, "documents", "doc_id", "text").select("doc_id", *[c.alias(n) for n, c in cols.items()])


# The eighth feature; SQL has no block matching, so it stands beside the seven and tests hold it against the standard library.
@query("sequence_ratio", rounded="sequence_ratio")
def sequence_ratio(spark, folder):
    ratio = X.sequence_ratio(F.col("text"), F.lit(X.READING_PROMPT))
    return wide_table(spark, folder, "documents", "doc_id", "text").select("doc_id", ratio.alias("sequence_ratio"))


@query(
    "logit_sigmoid",
    with_("samples") + "SELECT sample_id, ln(p / (1 - p)) AS logit, 1 / (1 + exp(-ln(p / (1 - p)))) AS back FROM"
    " (SELECT sample_id, greatest(1e-6, least(1.0 - 1e-6, CAST(prob AS DOUBLE))) AS p FROM samples)",
    rounded="logit back",
    digits=9,
)
def logit_sigmoid(spark, folder):
    from cohortloom.plans.views import samples

    value = N.logit(F.col("prob"))
    return samples(spark, folder).select("sample_id", value.alias("logit"), N.sigmoid(value).alias("back"))


@query(
    "severity_maps",
    with_("outcomes") + "SELECT entity_id, CASE coalesce(severity, 1) WHEN 2 THEN 2.0::DOUBLE WHEN 3 THEN 3.0 ELSE 1.0 END AS comparison,"
    " CASE coalesce(severity, 0) WHEN 2 THEN 1.5::DOUBLE WHEN 3 THEN 2.0 ELSE 1.0 END AS training,"
    " CASE severity WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 ELSE 1.0 END AS soft,"
    " CASE WHEN severity >= 3 THEN 1.0::DOUBLE WHEN severity >= 2 THEN 0.5 ELSE 0.0 END AS target FROM outcomes",
)
def severity_maps(spark, folder):
    s = F.col("severity")
    return outcomes(spark, folder).select(
        "entity_id",
        N.severity_multiplier(s).alias("comparison"),
        N.severity_multiplier(s, N.TRAINING_MULTIPLIER, 0).alias("training"),
        N.soft_label(s).alias("soft"),
        N.regression_target(s).alias("target"),
    )


def _cells(lines, column):
    return lines.select("sample_id", "y", F.posexplode(column).alias("x", "v"))


_GRID_SQL = (
    "SELECT vec_id AS sample_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,"
    " CAST(embedding[i + 1] AS DOUBLE) AS e FROM embeddings, range(64) r(i)"
)


def embedding_lines(spark, folder, value=None):
    """Each 64-float vector as an 8 x 8 raster of scan lines."""
    rows = wide_table(spark, folder, "embeddings", "vec_id", "embedding").select(
        F.col("vec_id").alias("sample_id"), "embedding",
        F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"),
    )
    temps = F.transform(F.slice("embedding", F.col("y") * 8 + 1, 8), lambda v: v.cast("double"))
    temps = F.transform(temps, value) if value else temps
    return rows.select("sample_id", "y", temps.alias("temps"))


@query(
    "range_normalize",
    f"SELECT sample_id, y, x, greatest(0.0, least(1.0, (30 + 40 * e - 15) / 25.0)) AS v FROM ({_GRID_SQL})",
    rounded="v",
)
def range_normalize(spark, folder):
    lines = embedding_lines(spark, folder, lambda v: v * 40 + 30)
    return _cells(range_normalised(lines), "temps")


@query(
    "minmax_uint8",
    "SELECT sample_id, y, x, CAST(round_even(CASE WHEN hi <= lo THEN 0 ELSE (e - lo) / (hi - lo) END * 255, 0) AS SMALLINT) AS v"
    f" FROM (SELECT *, min(e) OVER (PARTITION BY sample_id) AS lo, max(e) OVER (PARTITION BY sample_id) AS hi FROM ({_GRID_SQL}))",
)
def minmax(spark, folder):
    return _cells(minmax_uint8(embedding_lines(spark, folder)), "levels")


# Boxes drawn from the data: the first four vector entries place a slanted four-point polygon.
_POLY = "array(array(e1 * 40, e2 * 40), array(e1 * 40 + 9, e2 * 40 + 1), array(e1 * 40 + 8, e2 * 40 + 7), array(e1 * 40 - 1, e2 * 40 + 5 + e3))"
_GEOMETRY_SQL = """
WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS e1, embedding[2]::DOUBLE AS e2, embedding[3]::DOUBLE AS e3,
    abs(embedding[4]::DOUBLE) + 0.5 AS s FROM embeddings),
pts AS (SELECT vec_id, i, s, CASE i WHEN 0 THEN e1 * 40 WHEN 1 THEN e1 * 40 + 9 WHEN 2 THEN e1 * 40 + 8 ELSE e1 * 40 - 1 END AS x0,
    CASE i WHEN 0 THEN e2 * 40 WHEN 1 THEN e2 * 40 + 1 WHEN 2 THEN e2 * 40 + 7 ELSE e2 * 40 + 5 + e3 END AS y0
    FROM p, range(4) r(i)),
img AS (SELECT vec_id, i, (x0 - 3) / s + 10 AS x, (y0 - 4) / s + 20 AS y FROM pts),
ras AS (SELECT vec_id, i, x, y, x * 2 AS rx, y * 0.5 AS ry FROM img),
e AS (SELECT a.vec_id, a.rx AS x1, a.ry AS y1, b.rx AS x2, b.ry AS y2 FROM ras a JOIN ras b ON a.vec_id = b.vec_id
    AND b.i = (a.i + 1) % 4),
m AS (SELECT vec_id, sum(x1 * y2 - x2 * y1) AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx,
    sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM e GROUP BY vec_id),
b AS (SELECT vec_id, min(rx) AS bx1, min(ry) AS by1, max(rx) AS bx2, max(ry) AS by2, max(CASE WHEN i = 0 THEN rx END) AS first_x,
    max(CASE WHEN i = 0 THEN ry END) AS first_y FROM ras GROUP BY vec_id)
SELECT vec_id, first_x, first_y, abs(a) / 2 AS area, mx / (3 * a) AS cx, my / (3 * a) AS cy, bx2 - bx1 AS box_width,
  by2 - by1 AS box_height, (bx2 - bx1) * (by2 - by1) AS box_area FROM m JOIN b USING (vec_id)"""


@query("region_geometry", _GEOMETRY_SQL, rounded="first_x first_y area cx cy box_width box_height box_area")
def region_geometry(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i + 1}") for i in range(4)]
    )
    undo = F.struct(
        F.lit(10.0).alias("crop_x"), F.lit(20.0).alias("crop_y"), (F.abs("e4") + 0.5).alias("scale"),
        F.lit(3).alias("pad_x"), F.lit(4).alias("pad_y"),
    )
    rows = rows.select("vec_id", F.expr(_POLY).alias("poly"), undo.alias("undo"))
    rows = rows.select("vec_id", G.inverse_polygon(F.col("poly"), F.col("undo")).alias("poly"))
    # Image 100 x 100, raster 200 wide and 50 high.
    moved = G.to_raster_space(F.col("poly"), F.lit(100), F.lit(100), F.lit(200), F.lit(50))
    rows = rows.select("vec_id", moved.alias("poly"))
    xs, ys = F.transform("poly", lambda p: p[0]), F.transform("poly", lambda p: p[1])
    rows = rows.withColumn("box", F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))
    centre = G.centroid(F.col("poly"), F.col("box"))
    return rows.select(
        "vec_id", F.col("poly")[0][0].alias("first_x"), F.col("poly")[0][1].alias("first_y"),
        G.area(F.col("poly")).alias("area"), centre[0].alias("cx"), centre[1].alias("cy"),
        *[c.alias(n) for n, c in G.box_size(F.col("box")).items()],
    )
