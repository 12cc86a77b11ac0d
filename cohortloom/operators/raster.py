"""Region statistics over rasters stored as scan lines (sample_id, y, temps array<double>)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.functions import geometry as G
from cohortloom.functions.numeric import mean_of_present
from cohortloom.operators.ranking import quantiles_of_counts

# Region and statistic names in output order.
REGIONS = ("forehead", "left_eye", "right_eye", "nose", "left_cheek", "right_cheek")
STATS = (
    "mean", "std", "median", "min", "max", "range", "p5", "p25", "p75", "p95", "iqr", "cv", "skew", "kurtosis",
)
# Attention weight of each region, and of the face outside every region.
ATTENTION = {
    "forehead": 1.0, "left_cheek": 1.0, "right_cheek": 1.0, "left_eye": 0.5, "right_eye": 0.5, "nose": 0.3,
}
FACE_ATTENTION = 0.2
_TILE = 256


def raster_shape(lines: DataFrame) -> DataFrame:
    """(sample_id, raster_w, raster_h); one width per raster is checked where rasters are read."""
    return lines.groupBy("sample_id").agg(
        F.max(F.size("temps")).alias("raster_w"), (F.max("y") + 1).alias("raster_h")
    )


def scale_polygons(polygons: DataFrame, shapes: DataFrame) -> DataFrame:
    """Polygons (sample_id, region, polygon, image_w, image_h) brought to raster coordinates."""
    moved = G.to_raster_space(
        F.col("polygon"), F.col("image_w"), F.col("image_h"), F.col("raster_w"), F.col("raster_h")
    )
    return polygons.join(shapes, "sample_id").select("sample_id", "region", moved.alias("polygon"))


def pixel_in_polygon(lines: DataFrame, polygons: DataFrame, truncate: bool = False) -> DataFrame:
    """(sample_id, region, y, x, v) for every cell a region covers, border cells included.

    Scan lines outside a region's box are dropped by the join itself; on the others only the covered
    cells are listed and exploded. A sample has a handful of regions, so the join grows by that factor
    at most, and the line side of a hot sample can be split.
    """
    prepared = polygons.where(F.size("polygon") > 0).select(
        "sample_id", "region", G.snap(F.col("polygon"), truncate).alias("_poly")
    )
    prepared = prepared.select(
        "sample_id", "region", G.edges(F.col("_poly")).alias("_edges"), G.outline(F.col("_poly")).alias("_box")
    )
    hit = lines.join(prepared, "sample_id").where(F.col("y").between(F.col("_box.y1"), F.col("_box.y2")))
    inside = G.columns_of(G.spans(F.col("_edges"), F.col("y")), F.size("temps"))
    cells = F.transform(inside, lambda x: F.struct(x.alias("x"), F.get("temps", x).cast("double").alias("v")))
    return hit.select("sample_id", "region", "y", F.explode(cells).alias("c")).select(
        "sample_id", "region", "y", "c.x", "c.v"
    )


def region_stats(cells: DataFrame) -> DataFrame:
    """Fourteen statistics per (sample_id, region); spread-based ones are 0 on a flat region."""
    keys = ["sample_id", "region"]
    v, n = F.col("v"), F.col("n")
    # Sensor values repeat, so counts per distinct value are a small stand-in for the cells: combined
    # where the cells are, shuffled once, and every statistic below reads that one exchange.
    counts = cells.groupBy(*keys, "v").agg(F.count("*").alias("n")).repartition(*keys, "v")
    base = counts.groupBy(*keys).agg(
        F.sum("n").alias("size"), (F.sum(n * v) / F.sum("n")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    d = v - F.col("mean")
    central = counts.join(base, keys).groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in ("size", "mean", "min", "max")],
        *[F.sum(n * F.pow(d, F.lit(k))).alias(f"_m{k}") for k in (2, 3, 4)],
    )
    size, var = F.col("size"), F.col("_m2") / F.col("size")
    flat = F.sqrt(var) < 1e-9
    quantiles = quantiles_of_counts(
        counts, keys, "v", {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    )
    both = central.join(quantiles, keys).withColumns(
        {
            "std": F.sqrt(var),
            "range": F.col("max") - F.col("min"),
            "iqr": F.col("p75") - F.col("p25"),
            "cv": F.when(F.abs("mean") > 1e-9, F.sqrt(var) / F.col("mean")),
            "skew": F.when(flat, 0.0).otherwise(F.col("_m3") / size / F.pow(F.when(~flat, var), F.lit(1.5))),
            "kurtosis": F.when(flat, 0.0).otherwise(F.col("_m4") / size / F.pow(F.when(~flat, var), F.lit(2.0)) - 3.0),
        }
    )
    return both.select(*keys, *STATS)


def region_wide(stats: DataFrame) -> DataFrame:
    """One row per sample with `<region>_<stat>`; absent regions are NULL."""
    row = F.struct(*STATS)
    regions = ("face", *REGIONS)
    wide = stats.groupBy("sample_id").agg(
        *[F.max(F.when(F.col("region") == r, row)).alias(r) for r in regions]
    )
    return wide.select("sample_id", *[F.col(f"{r}.{s}").alias(f"{r}_{s}") for r in regions for s in STATS])


def asymmetry(wide: DataFrame, prefix: str) -> dict[str, Column]:
    """Nine left/right features of one paired region (`eye` or `cheek`)."""

    def side(name: str) -> tuple[Column, Column]:
        return F.col(f"left_{prefix}_{name}"), F.col(f"right_{prefix}_{name}")

    lm, rm = side("mean")
    middle = (F.abs(lm) + F.abs(rm)) / 2.0
    out = {
        f"{prefix}_diff_mean": lm - rm,
        f"{prefix}_abs_diff_mean": F.abs(lm - rm),
        f"{prefix}_ratio_mean": F.try_divide(lm, rm),
        f"{prefix}_asymmetry_index": F.when(middle > 1e-9, F.abs(lm - rm) / middle),
    }
    for stat in ("std", "median", "p25", "p75", "iqr"):
        left, right = side(stat)
        out[f"{prefix}_diff_{stat}"] = left - right
    return out


def contrasts() -> dict[str, Column]:
    """Six differences to the face mean, six z-scores, eight contrasts between regions."""
    mean = {r: F.col(f"{r}_mean") for r in (*REGIONS, "face")}
    out = {f"{r}_minus_face_mean": mean[r] - mean["face"] for r in REGIONS}
    std = F.when(F.col("face_std") > 1e-9, F.col("face_std"))
    out |= {f"{r}_zscore_mean": (mean[r] - mean["face"]) / std for r in REGIONS}
    mean["eyes"] = mean_of_present(mean["left_eye"], mean["right_eye"])
    mean["cheeks"] = mean_of_present(mean["left_cheek"], mean["right_cheek"])
    for a, b in (
        ("nose", "forehead"), ("nose", "cheeks"), ("forehead", "eyes"), ("eyes", "cheeks"), ("forehead", "cheeks"),
        ("nose", "eyes"),
    ):
        out[f"{a}_minus_{b}_mean"] = mean[a] - mean[b]
    return out | {"eyes_mean": mean["eyes"], "cheeks_mean": mean["cheeks"]}


def extreme_spots(cells: DataFrame, boxes: DataFrame, region: str = "face") -> DataFrame:
    """Hottest and coldest cell of a region, relative to the region box; ties go to the first in reading order."""
    place = F.struct("x", "y")
    spots = (
        cells.where(F.col("region") == region)
        .groupBy("sample_id")
        .agg(
            F.max_by(place, F.struct(F.col("v"), -F.col("y"), -F.col("x"))).alias("hot"),
            F.min_by(place, F.struct("v", "y", "x")).alias("cold"),
        )
    )
    b = F.col("box")
    w, h = F.greatest(b[2] - b[0], F.lit(1.0)), F.greatest(b[3] - b[1], F.lit(1.0))
    return spots.join(boxes.select("sample_id", "box"), "sample_id").select(
        "sample_id",
        ((F.col("hot.x") - b[0]) / w).alias(f"{region}_hotspot_x_rel"),
        ((F.col("hot.y") - b[1]) / h).alias(f"{region}_hotspot_y_rel"),
        ((F.col("cold.x") - b[0]) / w).alias(f"{region}_coldspot_x_rel"),
        ((F.col("cold.y") - b[1]) / h).alias(f"{region}_coldspot_y_rel"),
    )


def gradient_lines(lines: DataFrame) -> DataFrame:
    """(sample_id, y, grads): 3x3 Sobel magnitude per cell, borders mirrored without the edge cell.

    Windows run over tiles of 256 lines that carry one line of each neighbour tile, so one tall raster
    is not one task.
    """
    y = F.col("y")
    tiles = F.array_distinct(F.transform(F.array(y - 1, y, y + 1), lambda c: F.floor(c / _TILE)))
    tiled = lines.select("sample_id", "y", "temps", F.explode(tiles).alias("_tile"))
    order = Window.partitionBy("sample_id", "_tile").orderBy("y")
    near = tiled.select(
        "*", F.lag("temps").over(order).alias("_up"), F.lead("temps").over(order).alias("_down")
    ).where(F.floor(y / _TILE) == F.col("_tile"))
    up = F.coalesce("_up", "_down", "temps")
    down = F.coalesce("_down", "_up", "temps")
    n = F.size("temps")

    def mirrored(i: Column) -> Column:
        return F.when(n == 1, 0).when(i < 0, 1).when(i >= n, n - 2).otherwise(i)

    def at(row: Column, i: Column) -> Column:
        return F.get(row, mirrored(i)).cast("double")

    near = near.select("sample_id", "y", "temps", up.alias("_u"), down.alias("_d"))
    u, m, d = F.col("_u"), F.col("temps"), F.col("_d")

    def magnitude(i: Column) -> Column:
        gx = (at(u, i + 1) - at(u, i - 1)) + 2 * (at(m, i + 1) - at(m, i - 1)) + (at(d, i + 1) - at(d, i - 1))
        gy = (at(d, i - 1) + 2 * at(d, i) + at(d, i + 1)) - (at(u, i - 1) + 2 * at(u, i) + at(u, i + 1))
        return F.sqrt(gx * gx + gy * gy)

    return near.select(
        "sample_id", "y", F.transform(F.sequence(F.lit(0), n - 1), lambda i: magnitude(i)).alias("temps")
    )


def gradient_stats(lines: DataFrame, polygons: DataFrame, region: str = "face") -> DataFrame:
    """Mean and population std of the gradient magnitude inside a region."""
    cells = pixel_in_polygon(gradient_lines(lines), polygons.where(F.col("region") == region))
    return cells.groupBy("sample_id").agg(
        F.avg("v").alias(f"{region}_gradient_mean"), F.stddev_pop("v").alias(f"{region}_gradient_std")
    )


def attention_overlay(
    lines: DataFrame, polygons: DataFrame, weights: dict[str, float] | None = None, truncate: bool = True
) -> DataFrame:
    """(sample_id, y, weights): per cell the highest weight of the regions that cover it, 0 outside.

    A sample's outlines travel with each of its lines (a handful of polygons), so no cell is exploded
    and nothing is grouped again.
    """
    weights = {"face": FACE_ATTENTION, **(weights or ATTENTION)}
    shapes = polygons.where(F.col("region").isin(*weights) & (F.size("polygon") > 0)).groupBy("sample_id").agg(
        *[
            F.max(F.when(F.col("region") == r, G.edges(G.snap(F.col("polygon"), truncate)))).alias(f"_{r}")
            for r in weights
        ]
    )
    rows = lines.join(shapes, "sample_id", "left")
    covered = F.struct(*[G.spans(F.col(f"_{r}"), F.col("y")).alias(r) for r in weights])

    def weight(on_line: Column, x: Column) -> Column:
        parts = [
            F.when(F.coalesce(F.exists(on_line[r], lambda s: x.between(s["l"], s["r"])), F.lit(False)), F.lit(w)).otherwise(0.0)
            for r, w in weights.items()
        ]
        return F.greatest(*parts)

    cols = F.sequence(F.lit(0), F.size("temps") - 1)
    values = G.bind(covered, lambda on_line: F.transform(cols, lambda x: weight(on_line, x)))
    return rows.select("sample_id", "y", values.alias("weights"))


def minmax_uint8(lines: DataFrame) -> DataFrame:
    """Per-raster 0-255 scale: as is when already in [0, 1], zeros when flat or never finite."""

    def finite(v: Column) -> Column:
        return v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))

    values = F.filter("temps", finite)
    span = lines.groupBy("sample_id").agg(
        F.min(F.array_min(values)).cast("double").alias("_lo"), F.max(F.array_max(values)).cast("double").alias("_hi")
    )
    lo, hi = F.col("_lo"), F.col("_hi")

    def scaled(v: Column) -> Column:
        v = v.cast("double")
        unit = (lo >= 0) & (hi <= 1)
        s = F.when(unit, v).when(hi <= lo, 0.0).otherwise((v - lo) / F.when(hi > lo, hi - lo))
        s = F.when(F.isnan(s), 0.0).otherwise(s)
        byte = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.bround(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), s)) * 255.0)))
        return F.coalesce(byte, F.lit(0.0)).cast("smallint")

    return lines.join(span, "sample_id", "left").select(
        "sample_id", "y", F.transform("temps", scaled).alias("levels")
    )


def best_detection(detections: DataFrame, keys: Sequence[str] = ("sample_id", "class")) -> DataFrame:
    """Highest-confidence detection per group, the first one on ties."""
    payload = [c for c in detections.columns if c not in keys]
    rank = F.struct(F.col("confidence"), -F.col("pos"))
    return (
        detections.groupBy(*keys).agg(F.max_by(F.struct(*payload), rank).alias("d")).select(*keys, "d.*")
    )


def bilateral_assign(
    detections: DataFrame, boxes: DataFrame, paired: Sequence[str] = ("Eye", "Cheek"),
    single: Sequence[str] = ("Nose", "Forehead"),
) -> DataFrame:
    """Named regions (sample_id, region, pos, confidence, centroid_x) from class detections.

    Two or more of a paired class give the leftmost and rightmost; one goes to the side of the box
    centre it lies on; single classes keep the most confident.
    """
    pick = F.struct("pos", "confidence", "centroid_x")
    both = (
        detections.where(F.col("class").isin(*paired))
        .groupBy("sample_id", "class")
        .agg(
            F.count("*").alias("n"),
            F.min_by(pick, F.struct("centroid_x", "pos")).alias("first"),
            F.max_by(pick, F.struct("centroid_x", "pos")).alias("last"),
        )
        .join(boxes.select("sample_id", "box"), "sample_id")
    )
    centre = (F.col("box")[0] + F.col("box")[2]) / 2.0
    lone = F.when(F.col("first.centroid_x") < centre, "left_").otherwise("right_")
    name = F.lower("class")
    two = F.array(
        F.struct(F.concat(F.lit("left_"), name).alias("region"), F.col("first").alias("d")),
        F.struct(F.concat(F.lit("right_"), name).alias("region"), F.col("last").alias("d")),
    )
    one = F.array(F.struct(F.concat(lone, name).alias("region"), F.col("first").alias("d")))
    sided = both.select("sample_id", F.explode(F.when(F.col("n") >= 2, two).otherwise(one)).alias("r")).select(
        "sample_id", "r.region", "r.d.*"
    )
    best = best_detection(detections.where(F.col("class").isin(*single))).select(
        "sample_id", F.lower("class").alias("region"), "pos", "confidence", "centroid_x"
    )
    return sided.unionByName(best)


def missing_regions(samples: DataFrame, found: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Samples (sample_id, status, ...) with the expected regions not found, in the given order.

    One flag per expected name replaces a collected list, so a sample's state stays fixed size.
    """
    flags = found.groupBy("sample_id").agg(
        *[F.bool_or(F.col("region") == r).alias(f"_has_{r}") for r in expected]
    )
    absent = F.concat_ws(
        ",", *[F.when(~F.coalesce(F.col(f"_has_{r}"), F.lit(False)), F.lit(r)) for r in expected]
    )
    out = samples.join(flags, "sample_id", "left")
    out = out.withColumn("missing_regions", F.when(F.col("status") == "ok", absent).otherwise(""))
    return out.select(*samples.columns, "missing_regions")


def status_counts(annotated: DataFrame) -> DataFrame:
    ok, complete = F.col("status") == "ok", F.col("missing_regions") == ""
    return annotated.agg(
        F.count("*").alias("total"),
        F.count_if(ok & complete).alias("ok_complete"),
        F.count_if(ok & ~complete).alias("ok_missing"),
        F.count_if(~ok).alias("errors"),
    )


def extraction_status(
    annotations: DataFrame, rasters: DataFrame, failures: DataFrame, face_cells: DataFrame
) -> DataFrame:
    """Final status per annotated sample: first reason that stops it, `ok` otherwise.

    `annotations` has sample_id, status, has_face; the others mark samples with a raster file, a parse
    error and at least one face cell.
    """
    marked = (
        annotations.join(rasters.select("sample_id").distinct().withColumn("_file", F.lit(True)), "sample_id", "left")
        .join(failures.select("sample_id", "error"), "sample_id", "left")
        .join(face_cells.select("sample_id").distinct().withColumn("_cells", F.lit(True)), "sample_id", "left")
    )
    status = (
        F.when((F.coalesce("status", F.lit("skipped")) != "ok") | ~F.col("has_face"), F.coalesce("status", F.lit("skipped")))
        .when(F.col("_file").isNull(), "missing_temperature_csv")
        .when(F.col("error").isNotNull(), F.concat(F.lit("temperature_parse_error: "), F.col("error")))
        .when(F.col("_cells").isNull(), "empty_face_mask")
        .otherwise("ok")
    )
    return marked.select("sample_id", status.alias("status"))


def raster_features(lines: DataFrame, polygons: DataFrame, boxes: DataFrame) -> DataFrame:
    """All 142 raster features, one row per sample with a non-empty face."""
    cells = pixel_in_polygon(lines, polygons)
    wide = region_wide(region_stats(cells)).where(F.col("face_mean").isNotNull())
    derived = {**asymmetry(wide, "eye"), **asymmetry(wide, "cheek"), **contrasts()}
    return (
        wide.withColumns(derived)
        .join(extreme_spots(cells, boxes), "sample_id", "left")
        .join(gradient_stats(lines, polygons), "sample_id", "left")
    )
