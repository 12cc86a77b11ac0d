"""Polygon expressions. A polygon is array<array<double>> of [x, y]; a box is [x1, y1, x2, y2]."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with `value` computed once per row, although `use` names it inside a lambda.

    The optimiser puts a computed column back into the lambda that reads it, where it would run again
    for every element; a lambda variable stays put.
    """
    return F.transform(F.array(value), lambda v: use(v))[0]


def inverse_point(point: Column, transform: Column) -> Column:
    """Undo pad, scale and crop of one point; `transform` has crop_x, crop_y, scale, pad_x, pad_y."""
    return F.array(
        (point[0] - transform["pad_x"]) / transform["scale"] + transform["crop_x"],
        (point[1] - transform["pad_y"]) / transform["scale"] + transform["crop_y"],
    )


def inverse_polygon(polygon: Column, transform: Column) -> Column:
    return F.transform(polygon, lambda p: inverse_point(p, transform))


def inverse_box(box: Column, transform: Column) -> Column:
    a = inverse_point(F.array(box[0], box[1]), transform)
    b = inverse_point(F.array(box[2], box[3]), transform)
    return F.concat(a, b)


def _scales(image_w: Column, image_h: Column, raster_w: Column, raster_h: Column) -> tuple[Column, Column, Column]:
    known = (image_w > 0) & (image_h > 0)
    sx = raster_w / F.when(image_w > 0, image_w.cast("double"))
    sy = raster_h / F.when(image_h > 0, image_h.cast("double"))
    same = (F.abs(sx - 1.0) < 1e-6) & (F.abs(sy - 1.0) < 1e-6)
    return sx, sy, F.coalesce(known & ~same, F.lit(False))


def to_raster_space(
    polygon: Column, image_w: Column, image_h: Column, raster_w: Column, raster_h: Column
) -> Column:
    """Scale image coordinates to raster coordinates; unchanged when the image size is unknown or equal."""
    sx, sy, needed = _scales(image_w, image_h, raster_w, raster_h)
    return F.when(needed, F.transform(polygon, lambda p: F.array(p[0] * sx, p[1] * sy))).otherwise(polygon)


def box_to_raster_space(box: Column, image_w: Column, image_h: Column, raster_w: Column, raster_h: Column) -> Column:
    sx, sy, needed = _scales(image_w, image_h, raster_w, raster_h)
    return F.when(needed, F.array(box[0] * sx, box[1] * sy, box[2] * sx, box[3] * sy)).otherwise(box)


def snap(polygon: Column, truncate: bool = False) -> Column:
    """Vertices on the cell grid: rounded half to even, or cut toward zero."""

    def whole(c: Column) -> Column:
        return (c if truncate else F.bround(c)).cast("int")

    return F.transform(polygon, lambda p: F.array(whole(p[0]), whole(p[1])))


def edges(polygon: Column) -> Column:
    """Closed list of edges as struct(x1, y1, x2, y2)."""
    after = F.concat(F.slice(polygon, 2, F.greatest(F.size(polygon) - 1, F.lit(0))), F.slice(polygon, 1, 1))
    return F.zip_with(
        polygon,
        after,
        lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")),
    )


def spans(edge_list: Column, y: Column) -> Column:
    """Column intervals [l, r] a polygon with whole-number vertices covers on line `y`, edges included.

    Edges that cross the line, ordered by where they do, pair up into the inside (even-odd rule); the
    ends are exact integer quotients. Vertices and flat edges on the line are added on their own.
    Work per line grows with the edges, not with edges times cells.
    """

    def cut(e: Column) -> Column:
        run, rise = e.x2 - e.x1, e.y2 - e.y1
        sign = F.when(rise < 0, -1).otherwise(1)
        top = ((e.x1 * rise + (y - e.y1) * run) * sign).cast("long")
        bottom = F.when(rise != 0, (rise * sign).cast("long"))
        rest = F.pmod(top, bottom)
        low = F.floor((top - rest) / bottom).cast("int")
        return F.struct(
            (top / bottom).alias("at"), low.alias("low"), (low + (rest > 0).cast("int")).alias("high")
        )

    def paired(cuts: Column) -> Column:
        seconds = F.transform(
            cuts,
            lambda c, i: F.when(
                i % 2 == 1, F.struct(F.get(cuts, i - 1)["high"].alias("l"), c["low"].alias("r"))
            ),
        )
        return F.filter(seconds, lambda s: s.isNotNull())

    crossing = F.filter(edge_list, lambda e: (e.y1 > y) != (e.y2 > y))
    inside = bind(F.array_sort(F.transform(crossing, cut)), paired)
    touching = F.transform(
        F.filter(edge_list, lambda e: e.y1 == y),
        lambda e: F.when(
            e.y2 == y, F.struct(F.least(e.x1, e.x2).alias("l"), F.greatest(e.x1, e.x2).alias("r"))
        ).otherwise(F.struct(e.x1.alias("l"), e.x1.alias("r"))),
    )
    return F.filter(F.concat(inside, touching), lambda s: s["l"] <= s["r"])


def columns_of(span_list: Column, width: Column) -> Column:
    """Distinct cell columns of a span list inside a line of the given width."""

    def cells(s: Column) -> Column:
        left, right = F.greatest(s["l"], F.lit(0)), F.least(s["r"], width - 1)
        return F.when(left <= right, F.sequence(left, right)).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(span_list, cells)))


def _signed_sums(polygon: Column) -> Column:
    """struct(a, mx, my): doubled signed area and first moments (times six)."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc: Column, e: Column) -> Column:
        cross = e.x1 * e.y2 - e.x2 * e.y1
        return F.struct(
            (acc.a + cross).alias("a"),
            (acc.mx + (e.x1 + e.x2) * cross).alias("mx"),
            (acc.my + (e.y1 + e.y2) * cross).alias("my"),
        )

    return F.aggregate(edges(polygon), zero, add)


def area(polygon: Column) -> Column:
    return F.abs(_signed_sums(polygon)["a"]) / 2.0


def centroid(polygon: Column, box: Column) -> Column:
    """Centre of mass of the polygon; the box centre when its area is zero."""
    s = _signed_sums(polygon)
    flat = s["a"] == 0
    safe = F.when(~flat, s["a"] * 3.0)
    return F.array(
        F.coalesce(s["mx"] / safe, (box[0] + box[2]) / 2.0), F.coalesce(s["my"] / safe, (box[1] + box[3]) / 2.0)
    )


def box_size(box: Column) -> dict[str, Column]:
    w, h = box[2] - box[0], box[3] - box[1]
    return {"box_width": w, "box_height": h, "box_area": w * h}


def outline(polygon: Column) -> Column:
    """Bounding box of a snapped polygon as struct(x1, y1, x2, y2)."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    return F.struct(
        F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2")
    )
