import numpy as np
from pyspark.sql import functions as F

from cohortloom.functions import geometry as G
from cohortloom.operators import raster as R

SQUARE = [[1.0, 1.0], [4.0, 1.0], [4.0, 4.0], [1.0, 4.0]]


def lines_of(spark, rasters):
    rows = [(k, y, [float(v) for v in row]) for k, m in rasters.items() for y, row in enumerate(m)]
    return spark.createDataFrame(rows, "sample_id string, y int, temps array<double>")


def polygons_of(spark, rows):
    return spark.createDataFrame(rows, "sample_id string, region string, polygon array<array<double>>")


def test_square_covers_sixteen_cells(spark):
    lines = lines_of(spark, {"s": np.zeros((6, 6))})
    assert R.pixel_in_polygon(lines, polygons_of(spark, [("s", "face", SQUARE)])).count() == 16


def brute(poly, w, h):
    pts = [(round(x), round(y)) for x, y in poly]
    edges = list(zip(pts, pts[1:] + pts[:1]))

    def hit(x, y):
        on = any(
            (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
            for (x1, y1), (x2, y2) in edges
        )
        odd = sum((y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) for (x1, y1), (x2, y2) in edges if y1 != y2) % 2
        return on or odd == 1

    return {(x, y) for x in range(w) for y in range(h) if hit(x, y)}


def test_any_polygon_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    shapes = {f"p{i}": rng.uniform(-3, 15, (int(rng.integers(3, 8)), 2)).tolist() for i in range(40)}
    lines = lines_of(spark, {k: np.zeros((12, 13)) for k in shapes})
    cells = R.pixel_in_polygon(lines, polygons_of(spark, [(k, "face", p) for k, p in shapes.items()])).collect()
    got = {}
    for r in cells:
        got.setdefault(r.sample_id, []).append((r.x, r.y))
    for k, p in shapes.items():
        mine = got.get(k, [])
        assert len(mine) == len(set(mine))
        assert set(mine) == brute(p, 13, 12), (k, p)


def test_rescale_area_centroid(spark):
    df = spark.createDataFrame([([[10.0, 20.0]], SQUARE)], "p array<array<double>>, q array<array<double>>")
    box = F.array(*[F.lit(float(v)) for v in (1, 1, 4, 4)])
    r = df.select(
        G.to_raster_space(F.col("p"), F.lit(100), F.lit(100), F.lit(200), F.lit(50)).alias("moved"),
        G.to_raster_space(F.col("p"), F.lit(0), F.lit(0), F.lit(200), F.lit(50)).alias("kept"),
        G.area(F.col("q")).alias("area"), G.centroid(F.col("q"), box).alias("c"),
        G.centroid(F.col("p"), box).alias("flat"),
    ).first()
    assert r.moved == [[20.0, 10.0]] and r.kept == [[10.0, 20.0]]
    assert r.area == 9.0 and r.c == [2.5, 2.5] and r.flat == [2.5, 2.5]


def test_region_stats(spark):
    rows = [("s", "face", 0, i, float(v)) for i, v in enumerate([1, 2, 3, 4, 5])] + [("f", "face", 0, i, 3.0) for i in range(3)]
    cells = spark.createDataFrame(rows, "sample_id string, region string, y int, x int, v double")
    got = {r.sample_id: r for r in R.region_stats(cells).collect()}
    s, f = got["s"], got["f"]
    assert (s.mean, s.median, s.range, s.iqr) == (3, 3, 4, 2) and abs(s.kurtosis + 1.3) < 1e-9
    assert (f.std, f.iqr, f.cv, f.skew, f.kurtosis) == (0, 0, 0, 0, 0)


def test_full_features_and_cold_spot(spark):
    m = np.full((10, 10), 35.0)
    m[6, 7] = 20.0
    lines = lines_of(spark, {"s": m})
    polys = polygons_of(spark, [("s", "face", [[5.0, 5.0], [9.0, 5.0], [9.0, 9.0], [5.0, 9.0]]), ("s", "left_eye", [[5.0, 5.0], [6.0, 5.0], [6.0, 6.0]])])
    boxes = spark.createDataFrame([("s", [5.0, 5.0, 9.0, 9.0])], "sample_id string, box array<double>")
    row = R.raster_features(lines, polys, boxes).first()
    assert len(row) == 1 + 142
    assert (row.face_coldspot_x_rel, row.face_coldspot_y_rel) == (0.5, 0.25)
    assert row.face_hotspot_x_rel == 0.0 and row.right_eye_mean is None and row.eyes_mean == 35.0


def sobel(m):
    p = np.pad(m, 1, mode="reflect")
    gx = p[:-2, 2:] - p[:-2, :-2] + 2 * (p[1:-1, 2:] - p[1:-1, :-2]) + p[2:, 2:] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    return np.sqrt(gx**2 + gy**2)


def test_gradient_across_tiles(spark):
    m = np.random.default_rng(2).uniform(20, 40, (600, 5))
    got = sorted((r.y, r.temps) for r in R.gradient_lines(lines_of(spark, {"s": m})).collect())
    assert np.allclose([t for _, t in got], sobel(m))


def test_attention_and_levels(spark):
    lines = lines_of(spark, {"s": np.arange(16).reshape(4, 4), "u": np.full((1, 3), 7.0)})
    polys = polygons_of(spark, [("s", "face", [[0.0, 0.0], [2.9, 0.0], [2.9, 2.0], [0.0, 2.0]]), ("s", "nose", [[1.0, 1.0], [1.0, 1.0]])])
    got = {(r.sample_id, r.y): r.weights for r in R.attention_overlay(lines, polys).collect()}
    assert got[("s", 1)] == [0.2, 0.3, 0.2, 0.0] and got[("s", 3)] == [0.0] * 4 and got[("u", 0)] == [0.0] * 3
    levels = {(r.sample_id, r.y): r.levels for r in R.minmax_uint8(lines).collect()}
    assert levels[("s", 3)] == [204, 221, 238, 255] and levels[("u", 0)] == [0, 0, 0]


def test_bilateral_assignment(spark):
    det = spark.createDataFrame(
        [("s", 0, "Eye", 0.9, 30.0), ("s", 1, "Eye", 0.5, 10.0), ("s", 2, "Cheek", 0.7, 50.0), ("s", 3, "Nose", 0.4, 1.0), ("s", 4, "Nose", 0.4, 2.0)],
        "sample_id string, pos int, class string, confidence double, centroid_x double",
    )
    boxes = spark.createDataFrame([("s", [0.0, 0.0, 100.0, 9.0])], "sample_id string, box array<double>")
    got = {r.region: r.pos for r in R.bilateral_assign(det, boxes).collect()}
    assert got == {"left_eye": 1, "right_eye": 0, "right_cheek": 2, "nose": 3}
    states = spark.createDataFrame([("s", "ok"), ("t", "no_face")], "sample_id string, status string")
    missing = {r.sample_id: r.missing_regions for r in R.missing_regions(states, R.bilateral_assign(det, boxes), ["left_eye", "left_cheek"]).collect()}
    assert missing == {"s": "left_cheek", "t": ""}
