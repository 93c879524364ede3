"""Boxes, crop windows and polygons as expressions. A box is struct(x1, y1, x2, y2)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions.scalars import fixed_of_tag, margin_of_tag


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: nested windows would otherwise repeat it in every branch."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def box(x1: Column, y1: Column, x2: Column, y2: Column, kind: str = "double") -> Column:
    return F.struct(*(v.cast(kind).alias(n) for v, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)))


def box_of_array(a: Column | str) -> Column:
    """From an array of four; null for other lengths."""
    a = _c(a)
    return F.when(F.size(a) == 4, box(a[0], a[1], a[2], a[3]))


def xywh_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    """Corners; null if anything is missing."""
    ok = x.isNotNull() & y.isNotNull() & w.isNotNull() & h.isNotNull()
    return F.when(ok, box(x, y, x + w, y + h))


def numbered_points(m: Column | str) -> Column:
    """map{x1, y1, x2, ...} to points; stops at the first number that is missing; points that are no numbers are left out."""
    m = _c(m)
    upto = F.array_position(F.transform(F.sequence(F.lit(1), F.size(m) + 1), lambda i: ~(F.map_contains_key(m, F.concat(F.lit("x"), i.cast("string"))) & F.map_contains_key(m, F.concat(F.lit("y"), i.cast("string"))))), True)
    pts = F.transform(F.slice(F.sequence(F.lit(1), F.size(m) + 1), 1, (upto - 1).cast("int")), lambda i: F.struct(F.element_at(m, F.concat(F.lit("x"), i.cast("string"))).try_cast("double").alias("x"), F.element_at(m, F.concat(F.lit("y"), i.cast("string"))).try_cast("double").alias("y")))
    return F.filter(pts, lambda p: p["x"].isNotNull() & p["y"].isNotNull())


def box_of_points(pts: Column | str) -> Column:
    xs, ys = F.transform(_c(pts), lambda p: p["x"]), F.transform(_c(pts), lambda p: p["y"])
    return F.when(F.size(_c(pts)) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def shoelace(pts: Column | str) -> Column:
    """A polygon's area; 0 with fewer than 3 points."""
    pts = _c(pts)
    nxt = F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1))
    cross = F.zip_with(pts, nxt, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.when(F.size(pts) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2).otherwise(F.lit(0.0))


def area_ratio(b: Column | str, w: Column | str, h: Column | str) -> Column:
    b, w, h = _c(b), _c(w), _c(h)
    area = F.greatest(F.lit(0.0), (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]))
    return F.when(b.isNotNull() & (w > 0) & (h > 0), F.least(area / (w * h), F.lit(1.0)))


def _inside(low: Column, high: Column, size: Column) -> Column:
    """struct(a, b): an interval moved into [0, size], first off the low edge, then off the high one; cut to whole pixels."""

    def place(i: Column) -> Column:
        return F.struct(F.greatest(i["l"], F.lit(0.0)).alias("l"), F.when(i["l"] < 0, i["h"] - i["l"]).otherwise(i["h"]).alias("h"), i["s"].alias("s"))

    def cut(i: Column) -> Column:
        low = F.when(i["h"] > i["s"], i["l"] - (i["h"] - i["s"])).otherwise(i["l"])
        return F.struct(F.greatest(low.cast("int"), F.lit(0)).alias("a"), F.least(F.bround(F.least(i["h"], i["s"])).cast("int"), i["s"].cast("int")).alias("b"))

    start = F.struct(low.cast("double").alias("l"), high.cast("double").alias("h"), size.cast("double").alias("s"))
    return let(let(start, place), cut)


def _square(cx: Column, cy: Column, side: Column, w: Column, h: Column) -> Column:
    sides = F.struct(cx.alias("x"), cy.alias("y"), (side / 2).alias("r"), w.alias("w"), h.alias("h"))
    ends = lambda s: F.struct(_inside(s["x"] - s["r"], s["x"] + s["r"], s["w"]).alias("x"), _inside(s["y"] - s["r"], s["y"] + s["r"], s["h"]).alias("y"))
    return let(let(sides, ends), lambda e: box(e["x"]["a"], e["y"]["a"], e["x"]["b"], e["y"]["b"], "int"))


def expand_box(b: Column | str, w: Column | str, h: Column | str, margin: Column | float, min_px: int = 64) -> Column:
    """The square of margin times the longer side, at least min_px, moved inside the image."""
    b, w, h = _c(b), _c(w), _c(h)
    m = margin if isinstance(margin, Column) else F.lit(float(margin))
    side = F.greatest(F.greatest(b["x2"] - b["x1"], b["y2"] - b["y1"], F.lit(1.0)) * m, F.lit(float(min_px)))
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    return F.when(b.isNotNull(), _square(cx, cy, side, w, h))


def fixed_box(b: Column | str, w: Column | str, h: Column | str, side: Column | int) -> Column:
    """The square of a fixed side about the box's centre (the image's without a box), moved inside the image."""
    b, w, h = _c(b), _c(w), _c(h)
    s = F.least(side if isinstance(side, Column) else F.lit(side), w, h).cast("double")
    cx, cy = F.coalesce((b["x1"] + b["x2"]) / 2, w / 2), F.coalesce((b["y1"] + b["y2"]) / 2, h / 2)
    return _square(cx, cy, s, w, h)


def crop_window(b: Column | str, w: Column | str, h: Column | str, tag: Column | str, min_px: int = 64) -> Column:
    """The window of a crop tag: 'f320' fixed, 'm1.5' expanded if there is a box, else the central square."""
    b, w, h, tag = _c(b), _c(w), _c(h), _c(tag)
    s = F.least(w, h)
    x, y = F.floor((w - s) / 2), F.floor((h - s) / 2)
    centre = box(x, y, x + s, y + s, "int")
    fixed, margin = fixed_of_tag(tag), margin_of_tag(tag)
    chosen = F.when(fixed > 0, fixed_box(b, w, h, fixed)).when(b.isNotNull() & (margin > 0), expand_box(b, w, h, margin, min_px)).otherwise(centre)
    return F.when((w > 0) & (h > 0), chosen)


def _relative(window: Column) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    def clip(v: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))

    ww, wh = window["x2"] - window["x1"], window["y2"] - window["y1"]
    return lambda x: clip((x - window["x1"]) / ww), lambda y: clip((y - window["y1"]) / wh)


def bbox_in_crop(b: Column | str, window: Column | str) -> Column:
    """The box relative to the window, in [0, 1]; null if nothing of it is left or the window is empty."""
    b = _c(b)

    def relative(win: Column) -> Column:
        fx, fy = _relative(win)
        return F.when((win["x2"] > win["x1"]) & (win["y2"] > win["y1"]) & b.isNotNull(), box(fx(b["x1"]), fy(b["y1"]), fx(b["x2"]), fy(b["y2"])))

    return let(let(_c(window), relative), lambda r: F.when((r["x2"] > r["x1"]) & (r["y2"] > r["y1"]), r))


def box_in_image(b: Column | str, w: Column | str, h: Column | str) -> Column:
    """The box relative to the whole image, in [0, 1]; null without a size or if nothing of it is left."""
    b, w, h = _c(b), _c(w), _c(h)
    return F.when((w > 0) & (h > 0), bbox_in_crop(b, box(F.lit(0), F.lit(0), w, h, "int")))


def polygon_in_crop(pts: Column | str, window: Column | str) -> Column:
    pts = _c(pts)

    def relative(win: Column) -> Column:
        fx, fy = _relative(win)
        ok = (win["x2"] > win["x1"]) & (win["y2"] > win["y1"]) & (F.size(pts) >= 3)
        return F.when(ok, F.transform(pts, lambda p: F.struct(fx(p["x"]).alias("x"), fy(p["y"]).alias("y"))))

    return let(_c(window), relative)


def visibility(b: Column | str, window: Column | str) -> Column:
    """The share of the box that the window shows."""
    b = _c(b)

    def share(win: Column) -> Column:
        w = F.greatest(F.least(b["x2"], win["x2"]) - F.greatest(b["x1"], win["x1"]), F.lit(0.0))
        h = F.greatest(F.least(b["y2"], win["y2"]) - F.greatest(b["y1"], win["y1"]), F.lit(0.0))
        return w * h / F.greatest((b["x2"] - b["x1"]) * (b["y2"] - b["y1"]), F.lit(1e-9))

    return let(_c(window), share)


def overflow(b: Column | str, w: Column | str, h: Column | str) -> Column:
    """By how many pixels the box leaves the image."""
    b, w, h = _c(b), _c(w), _c(h)
    return F.greatest(-b["x1"], -b["y1"], b["x2"] - w, b["y2"] - h, F.lit(0.0))


def out_of_bounds(b: Column | str, w: Column | str, h: Column | str) -> Column:
    b = _c(b)
    return (overflow(b, w, h) > 1) | (b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"])
