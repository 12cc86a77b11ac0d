"""Raster, region and detection queries (inventory 2.4 to 2.5); vectors serve as 8 x 8 rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortloom.operators import raster as R
from cohortloom.plans.registry import query, table
from cohortloom.plans.scalars import _GRID_SQL, embedding_lines

# Region boxes in raster cells (x1, y1, x2, y2); the face is the whole raster, the forehead a flat line.
BOXES = {
    "face": (0, 0, 7, 7),
    "forehead": (1, 0, 6, 0),
    "left_eye": (1, 1, 2, 2),
    "right_eye": (5, 1, 6, 2),
    "nose": (3, 3, 4, 5),
    "left_cheek": (0, 4, 2, 6),
    "right_cheek": (5, 4, 7, 6),
}
SLANTED = ((0, 3), (4, 0), (7, 4), (3, 7))


def region_polygons(spark, folder):
    """Annotated polygons per vector: label 9 has no face, every third label no nose; even labels are
    annotated on an image twice the raster size."""
    scale = F.when(F.col("label") % 2 == 0, 2.0).otherwise(1.0)
    boxes = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("region"), *[F.lit(v).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), b)])
                for n, b in BOXES.items()
            ]
        )
    )
    rows = table(spark, folder, "embeddings").where(F.col("label") != 9).select(
        F.col("vec_id").alias("sample_id"), "label", scale.alias("s"), boxes.alias("b")
    )
    rows = rows.where(~((F.col("b.region") == "nose") & (F.col("label") % 3 == 0)))

    def point(x, y):
        return F.array(F.col(f"b.{x}") * F.col("s"), F.col(f"b.{y}") * F.col("s"))

    polygon = F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2"))
    size = (8 * F.col("s")).cast("int")
    return rows.select(
        "sample_id", F.col("b.region").alias("region"), polygon.alias("polygon"), size.alias("image_w"), size.alias("image_h")
    )


def _lines(spark, folder):
    return embedding_lines(spark, folder, lambda v: v * 10 + 30)


def _scaled(spark, folder, lines):
    return R.scale_polygons(region_polygons(spark, folder), R.raster_shape(lines))


def _cells(spark, folder):
    lines = _lines(spark, folder)
    return R.pixel_in_polygon(lines, _scaled(spark, folder, lines))


_REGIONS_SQL = (
    "cells AS (SELECT g.sample_id, b.region, g.y, g.x, 30 + 10 * g.e AS v FROM (" + _GRID_SQL + ") g"
    " JOIN embeddings m ON m.vec_id = g.sample_id JOIN (VALUES "
    + ", ".join(f"('{n}', {b[0]}, {b[1]}, {b[2]}, {b[3]})" for n, b in BOXES.items())
    + ") b(region, x1, y1, x2, y2) ON g.x BETWEEN b.x1 AND b.x2 AND g.y BETWEEN b.y1 AND b.y2"
    " WHERE m.label <> 9 AND NOT (b.region = 'nose' AND m.label % 3 = 0))"
)
_MOMENTS = (
    "m AS (SELECT *, avg(v) OVER w AS mu FROM cells WINDOW w AS (PARTITION BY sample_id, region)),"
    " stats AS (SELECT sample_id, region, avg(v) AS mean, stddev_pop(v) AS std, quantile_cont(v, 0.5) AS median, min(v) AS min,"
    " max(v) AS max, max(v) - min(v) AS range, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25,"
    " quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr,"
    " CASE WHEN abs(avg(v)) > 1e-9 THEN stddev_pop(v) / avg(v) END AS cv,"
    " CASE WHEN stddev_pop(v) < 1e-9 THEN 0 ELSE avg(power(v - mu, 3)) / power(stddev_pop(v), 3) END AS skew,"
    " CASE WHEN stddev_pop(v) < 1e-9 THEN 0 ELSE avg(power(v - mu, 4)) / power(stddev_pop(v), 4) - 3 END AS kurtosis"
    " FROM m GROUP BY sample_id, region)"
)
_WIDE = "wide AS (SELECT sample_id, " + ", ".join(
    f"max(CASE WHEN region = '{r}' THEN {s} END) AS {r}_{s}" for r in BOXES for s in R.STATS
) + " FROM stats GROUP BY sample_id)"
_STATS_SQL = f"WITH {_REGIONS_SQL}, {_MOMENTS}"


@query(
    "pixel_in_polygon",
    f"WITH {_REGIONS_SQL} SELECT sample_id, region, count(*) AS n_cells, CAST(sum(x) AS BIGINT) AS sum_x,"
    " CAST(sum(y) AS BIGINT) AS sum_y, sum(v) AS sum_v FROM cells GROUP BY sample_id, region",
    rounded="sum_v",
)
def pixel_in_polygon(spark, folder):
    return _cells(spark, folder).groupBy("sample_id", "region").agg(
        F.count("*").alias("n_cells"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.sum("v").alias("sum_v")
    )


@query("region_stats", f"{_STATS_SQL} SELECT * FROM stats", rounded=" ".join(R.STATS))
def region_stats(spark, folder):
    return R.region_stats(_cells(spark, folder))


_WIDE_COLUMNS = " ".join(f"{r}_{s}" for r in BOXES for s in R.STATS)


@query("region_features_wide", f"{_STATS_SQL}, {_WIDE} SELECT * FROM wide", rounded=_WIDE_COLUMNS)
def region_features_wide(spark, folder):
    return R.region_wide(R.region_stats(_cells(spark, folder)))


def _asym_sql(p: str) -> str:
    lm, rm = f"left_{p}_mean", f"right_{p}_mean"
    mid = f"((abs({lm}) + abs({rm})) / 2)"
    parts = [
        f"{lm} - {rm} AS {p}_diff_mean", f"abs({lm} - {rm}) AS {p}_abs_diff_mean", f"{lm} / nullif({rm}, 0) AS {p}_ratio_mean",
        f"CASE WHEN {mid} > 1e-9 THEN abs({lm} - {rm}) / {mid} END AS {p}_asymmetry_index",
    ]
    parts += [f"left_{p}_{s} - right_{p}_{s} AS {p}_diff_{s}" for s in ("std", "median", "p25", "p75", "iqr")]
    return ", ".join(parts)


_ASYM = [
    f"{p}_{s}" for p in ("eye", "cheek")
    for s in ("diff_mean", "abs_diff_mean", "ratio_mean", "asymmetry_index", "diff_std", "diff_median", "diff_p25", "diff_p75", "diff_iqr")
]


@query(
    "bilateral_asymmetry",
    f"{_STATS_SQL}, {_WIDE} SELECT sample_id, {_asym_sql('eye')}, {_asym_sql('cheek')} FROM wide",
    rounded=" ".join(_ASYM),
)
def bilateral_asymmetry(spark, folder):
    wide = region_features_wide(spark, folder)
    cols = {**R.asymmetry(wide, "eye"), **R.asymmetry(wide, "cheek")}
    return wide.select("sample_id", *[c.alias(n) for n, c in cols.items()])


_CONTRASTS = (
    [f"{r}_minus_face_mean" for r in R.REGIONS] + [f"{r}_zscore_mean" for r in R.REGIONS]
    + ["nose_minus_forehead_mean", "nose_minus_cheeks_mean", "forehead_minus_eyes_mean", "eyes_minus_cheeks_mean",
       "forehead_minus_cheeks_mean", "nose_minus_eyes_mean", "eyes_mean", "cheeks_mean"]
)


@query(
    "region_contrasts",
    f"{_STATS_SQL}, {_WIDE}, c AS (SELECT *, list_avg(list_filter([left_eye_mean, right_eye_mean], lambda q: q IS NOT NULL)) AS eyes_mean,"
    " list_avg(list_filter([left_cheek_mean, right_cheek_mean], lambda q: q IS NOT NULL)) AS cheeks_mean FROM wide) SELECT sample_id, "
    + ", ".join(f"{r}_mean - face_mean AS {r}_minus_face_mean" for r in R.REGIONS) + ", "
    + ", ".join(f"({r}_mean - face_mean) / CASE WHEN face_std > 1e-9 THEN face_std END AS {r}_zscore_mean" for r in R.REGIONS)
    + ", nose_mean - forehead_mean AS nose_minus_forehead_mean, nose_mean - cheeks_mean AS nose_minus_cheeks_mean,"
    " forehead_mean - eyes_mean AS forehead_minus_eyes_mean, eyes_mean - cheeks_mean AS eyes_minus_cheeks_mean,"
    " forehead_mean - cheeks_mean AS forehead_minus_cheeks_mean, nose_mean - eyes_mean AS nose_minus_eyes_mean, eyes_mean, cheeks_mean FROM c",
    rounded=" ".join(_CONTRASTS),
)
def region_contrasts(spark, folder):
    wide = region_features_wide(spark, folder)
    return wide.select("sample_id", *[c.alias(n) for n, c in R.contrasts().items()])


def _face_boxes(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.array(*[F.lit(float(v)) for v in BOXES["face"]]).alias("box")
    )


def _spot_sql(kind: str, order: str) -> str:
    return (
        f"WITH {_REGIONS_SQL} SELECT sample_id, x / 7.0 AS face_{kind}_x_rel, y / 7.0 AS face_{kind}_y_rel FROM (SELECT *,"
        f" row_number() OVER (PARTITION BY sample_id ORDER BY v {order}, y, x) AS r FROM cells WHERE region = 'face') WHERE r = 1"
    )


@query("hotspot", _spot_sql("hotspot", "DESC"), rounded="face_hotspot_x_rel face_hotspot_y_rel")
def hotspot(spark, folder):
    out = R.extreme_spots(_cells(spark, folder), _face_boxes(spark, folder))
    return out.select("sample_id", "face_hotspot_x_rel", "face_hotspot_y_rel")


@query("coldspot", _spot_sql("coldspot", "ASC"), rounded="face_coldspot_x_rel face_coldspot_y_rel")
def coldspot(spark, folder):
    out = R.extreme_spots(_cells(spark, folder), _face_boxes(spark, folder))
    return out.select("sample_id", "face_coldspot_x_rel", "face_coldspot_y_rel")


def _at(dx: int, dy: int) -> str:
    x = f"abs(7 - abs(7 - (x + ({dx}))))"
    y = f"abs(7 - abs(7 - (y + ({dy}))))"
    return f"(30 + 10 * CAST(embedding[{y} * 8 + {x} + 1] AS DOUBLE))"


_GX = f"({_at(1, -1)} - {_at(-1, -1)} + 2 * ({_at(1, 0)} - {_at(-1, 0)}) + {_at(1, 1)} - {_at(-1, 1)})"
_GY = f"({_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(0, -1)} - {_at(1, -1)})"


@query(
    "gradient_stats",
    "SELECT sample_id, avg(g) AS face_gradient_mean, stddev_pop(g) AS face_gradient_std FROM (SELECT vec_id AS sample_id,"
    f" sqrt({_GX} * {_GX} + {_GY} * {_GY}) AS g FROM (SELECT vec_id, embedding, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y"
    " FROM embeddings, range(64) r(i) WHERE label <> 9)) GROUP BY sample_id",
    rounded="face_gradient_mean face_gradient_std",
)
def gradient_stats(spark, folder):
    lines = _lines(spark, folder)
    return R.gradient_stats(lines, _scaled(spark, folder, lines))


_ATTENTION_CASE = (
    "coalesce((SELECT max(CASE b.region WHEN 'face' THEN 0.2 WHEN 'nose' THEN 0.3 WHEN 'left_eye' THEN 0.5 WHEN 'right_eye' THEN 0.5"
    " ELSE 1.0 END) FROM (VALUES " + ", ".join(f"('{n}', {b[0]}, {b[1]}, {b[2]}, {b[3]})" for n, b in BOXES.items())
    + ") b(region, x1, y1, x2, y2) WHERE g.x BETWEEN b.x1 AND b.x2 AND g.y BETWEEN b.y1 AND b.y2"
    " AND NOT (b.region = 'nose' AND m.label % 3 = 0) AND m.label <> 9), 0.0)"
)


@query(
    "attention_overlay",
    f"SELECT g.sample_id, g.y, g.x, CAST({_ATTENTION_CASE} AS DOUBLE) AS weight FROM ({_GRID_SQL}) g JOIN embeddings m ON m.vec_id = g.sample_id",
)
def attention_overlay(spark, folder):
    lines = _lines(spark, folder)
    out = R.attention_overlay(lines, _scaled(spark, folder, lines))
    return out.select("sample_id", "y", F.posexplode("weights").alias("x", "weight"))


@query(
    "extraction_status",
    "SELECT vec_id AS sample_id, CASE WHEN label = 9 THEN 'no_face' WHEN label = 8 THEN 'missing_temperature_csv' WHEN label = 7 THEN"
    " 'temperature_parse_error: inconsistent row widths' WHEN label = 6 THEN 'empty_face_mask' ELSE 'ok' END AS status FROM embeddings",
)
def extraction_status(spark, folder):
    rows = table(spark, folder, "embeddings").withColumnRenamed("vec_id", "sample_id")
    notes = rows.select(
        "sample_id", F.when(F.col("label") == 9, "no_face").otherwise("ok").alias("status"), (F.col("label") != 9).alias("has_face")
    )
    files = rows.where(F.col("label") != 8)
    broken = rows.where(F.col("label") == 7).select("sample_id", F.lit("inconsistent row widths").alias("error"))
    # A face that lies beyond the raster leaves no cell.
    polygons = region_polygons(spark, folder).where(F.col("region") == "face")
    shifted = polygons.join(rows.select("sample_id", "label"), "sample_id").withColumn(
        "polygon", F.when(F.col("label") == 6, F.transform("polygon", lambda p: F.array(p[0] + 99, p[1]))).otherwise(F.col("polygon"))
    )
    lines = _lines(spark, folder)
    cells = R.pixel_in_polygon(lines, R.scale_polygons(shifted.drop("label"), R.raster_shape(lines)))
    return R.extraction_status(notes, files, broken, cells)


# ---- detections: sample = user, class = event type ------------------------------------------------

_CLASS = "case event_type when 'click' then 'Eye' when 'view' then 'Cheek' when 'purchase' then 'Nose' when 'signup' then 'Forehead' else 'Other' end"
_CENTRE = "cast(get_json_object(props, '$.k') as double)"
_CENTRE_SQL = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
_DET_SQL = (
    f"det AS (SELECT user_id AS sample_id, event_id AS pos, {_CLASS} AS class, value AS confidence, {_CENTRE_SQL} AS centroid_x FROM events),"
    " face AS (SELECT DISTINCT user_id AS sample_id, 20.0 + user_id % 50 AS centre FROM events)"
)
_ASSIGN_SQL = (
    "sides AS (SELECT sample_id, class, count(*) OVER (PARTITION BY sample_id, class) AS n, pos, confidence, centroid_x,"
    " row_number() OVER (PARTITION BY sample_id, class ORDER BY centroid_x, pos) AS lo,"
    " row_number() OVER (PARTITION BY sample_id, class ORDER BY centroid_x DESC, pos DESC) AS hi FROM det WHERE class IN ('Eye', 'Cheek')),"
    " named AS (SELECT sample_id, 'left_' || lower(class) AS region, pos, confidence, centroid_x FROM sides WHERE n >= 2 AND lo = 1"
    " UNION ALL SELECT sample_id, 'right_' || lower(class), pos, confidence, centroid_x FROM sides WHERE n >= 2 AND hi = 1"
    " UNION ALL SELECT sample_id, CASE WHEN centroid_x < centre THEN 'left_' ELSE 'right_' END || lower(class), pos, confidence, centroid_x"
    " FROM sides JOIN face USING (sample_id) WHERE n = 1"
    " UNION ALL SELECT sample_id, lower(class), pos, confidence, centroid_x FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, class"
    " ORDER BY confidence DESC, pos) AS r FROM det WHERE class IN ('Nose', 'Forehead')) WHERE r = 1)"
)


def _detections(spark, folder):
    return table(spark, folder, "events").select(
        F.col("user_id").alias("sample_id"), F.col("event_id").alias("pos"), F.expr(_CLASS).alias("class"),
        F.col("value").alias("confidence"), F.expr(_CENTRE).alias("centroid_x"),
    )


def _det_boxes(spark, folder):
    users = table(spark, folder, "events").select(F.col("user_id").alias("sample_id")).distinct()
    centre = (20 + F.col("sample_id") % 50).cast("double")
    return users.select("sample_id", F.array(centre - 5, F.lit(0.0), centre + 5, F.lit(9.0)).alias("box"))


@query(
    "best_detection",
    f"WITH {_DET_SQL} SELECT sample_id, class, pos, confidence, centroid_x FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, class"
    " ORDER BY confidence DESC, pos) AS r FROM det) WHERE r = 1",
)
def best_detection(spark, folder):
    return R.best_detection(_detections(spark, folder))


@query("bilateral_assign", f"WITH {_DET_SQL}, {_ASSIGN_SQL} SELECT * FROM named")
def bilateral_assign(spark, folder):
    return R.bilateral_assign(_detections(spark, folder), _det_boxes(spark, folder))


_REGIONS = ("left_eye", "right_eye", "left_cheek", "right_cheek", "nose", "forehead")
_MISSING_SQL = (
    f"WITH {_DET_SQL}, {_ASSIGN_SQL}, found AS (SELECT sample_id, list(region) AS regions FROM named GROUP BY sample_id),"
    " st AS (SELECT sample_id, CASE WHEN sample_id % 10 = 3 THEN 'no_face' ELSE 'ok' END AS status FROM face)"
    " SELECT sample_id, status, CASE WHEN status = 'ok' THEN concat_ws(',', "
    + ", ".join(f"CASE WHEN NOT list_contains(coalesce(regions, []), '{r}') THEN '{r}' END" for r in _REGIONS)
    + ") ELSE '' END AS missing_regions FROM st LEFT JOIN found USING (sample_id)"
)


def _missing(spark, folder):
    boxes = _det_boxes(spark, folder)
    found = R.bilateral_assign(_detections(spark, folder), boxes).select("sample_id", "region")
    states = boxes.select("sample_id", F.when(F.col("sample_id") % 10 == 3, "no_face").otherwise("ok").alias("status"))
    return R.missing_regions(states, found, _REGIONS)


@query("missing_regions", _MISSING_SQL)
def missing_regions(spark, folder):
    return _missing(spark, folder)


@query(
    "status_counts",
    f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'ok' AND missing_regions = '') AS ok_complete,"
    f" count(*) FILTER (WHERE status = 'ok' AND missing_regions <> '') AS ok_missing, count(*) FILTER (WHERE status <> 'ok') AS errors FROM ({_MISSING_SQL})",
)
def status_counts(spark, folder):
    return R.status_counts(_missing(spark, folder))
