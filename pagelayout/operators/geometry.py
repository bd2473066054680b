"""Boxes, quads, oriented bounds, angles and curves as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from pagelayout.functions.exprs import fixed, once
from pagelayout.operators.layout import fold_angle
from pagelayout.operators.scans import group_stats, large_keys, ordered_scan, ranged, unranged

BASELINE_SHIFT = 0.40
ERASE_PAD = 2.0
SMALL_ANGLE = 0.01


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


# ---------------------------------------------------------------- rectangles


def resolve_rect(df: DataFrame) -> DataFrame:
    """Add ``rect`` (l, t, r, b, deg): fractions first, then percents, then pixel bounds; null if none is valid.

    Reads left/top/width/height, *_pct, rotation_css, rotation, l/t/r/b and the base size w/h.
    """
    w, h = F.col("w").cast("double"), F.col("h").cast("double")
    deg = F.coalesce(_finite("rotation_css"), _finite("rotation"), F.lit(0.0))

    def rect(l: Column, t: Column, bw: Column, bh: Column) -> Column:
        def body(v: Column) -> Column:
            ok = v["l"].isNotNull() & v["t"].isNotNull() & (v["w"] > 0) & (v["h"] > 0)
            return F.when(ok, F.struct((v["l"] * w).alias("l"), (v["t"] * h).alias("t"), ((v["l"] + v["w"]) * w).alias("r"), ((v["t"] + v["h"]) * h).alias("b"), deg.alias("deg")))

        return once(F.struct(l.alias("l"), t.alias("t"), bw.alias("w"), bh.alias("h")), body)

    frac = rect(*[_finite(c) for c in ("left", "top", "width", "height")])
    pct = rect(*[_finite(c) / 100.0 for c in ("left_pct", "top_pct", "width_pct", "height_pct")])
    pl, pt, pr, pb = (_finite(c) for c in "ltrb")
    px = F.when((pr > pl) & (pb > pt), F.struct(pl.alias("l"), pt.alias("t"), pr.alias("r"), pb.alias("b"), F.lit(0.0).alias("deg")))
    return df.withColumn("rect", F.coalesce(frac, pct, px))


# ---------------------------------------------------------------- quads


_CORNERS = tuple((f"__x{k}", f"__y{k}") for k in range(4))


def _box_corners(d: DataFrame, pad: float) -> DataFrame:
    """Adds the corners of the box turned about its centre; shared terms are columns of their own."""
    w, h = F.col("width") * F.col("w"), F.col("height") * F.col("h")
    rad = F.radians(F.coalesce("rotation_deg", F.lit(0.0)))
    d = d.withColumns({
        "__cx": F.col("left") * F.col("w") + w / 2.0, "__cy": F.col("top") * F.col("h") + h / 2.0,
        "__hw": w / 2.0 + pad, "__hh": h / 2.0 + pad, "__cos": F.cos(rad), "__sin": F.sin(rad),
    })
    cx, cy, hw, hh, c, s = (F.col(n) for n in ("__cx", "__cy", "__hw", "__hh", "__cos", "__sin"))
    # Opposite corners lie equally far from the centre.
    d = d.withColumns({"__xs": hw * c + hh * s, "__xd": hw * c - hh * s, "__ys": hw * s + hh * c, "__yd": hw * s - hh * c})
    xs, xd, ys, yd = (F.col(n) for n in ("__xs", "__xd", "__ys", "__yd"))
    ends = ((cx - xd, cy - ys), (cx + xs, cy + yd), (cx + xd, cy + ys), (cx - xs, cy - yd))
    d = d.withColumns({n: c for names, end in zip(_CORNERS, ends) for n, c in zip(names, end)})
    return d.drop("__cx", "__cy", "__hw", "__hh", "__cos", "__sin", "__xs", "__xd", "__ys", "__yd")


def _line_corners(d: DataFrame, pad: float) -> DataFrame:
    """Adds ``__line``: corners around the piece t0..t1 of the baseline; null without text or length."""
    d = d.withColumns({"__x1": F.col("p1.x") * F.col("w"), "__y1": F.col("p1.y") * F.col("h"), "__x2": F.col("p2.x") * F.col("w"), "__y2": F.col("p2.y") * F.col("h")})
    x1, y1, x2, y2 = (F.col(n) for n in ("__x1", "__y1", "__x2", "__y2"))
    d = d.withColumn("__flip", (x2 - x1 < 0) | ((F.abs(x2 - x1) < 1e-12) & (y2 - y1 < 0)))
    flip = F.col("__flip")
    d = d.withColumns({
        "__ax": F.when(flip, x2).otherwise(x1), "__ay": F.when(flip, y2).otherwise(y1),
        "__dx": F.when(flip, x1 - x2).otherwise(x2 - x1), "__dy": F.when(flip, y1 - y2).otherwise(y2 - y1), "__len": F.hypot(x2 - x1, y2 - y1),
    })
    length = F.col("__len")
    d = d.withColumns({"__ux": F.try_divide("__dx", length), "__uy": F.try_divide("__dy", length), "__th": F.greatest(F.lit(1.0), F.coalesce("height_raw", F.lit(0.0)) * F.col("h"))})
    ux, uy, h = F.col("__ux"), F.col("__uy"), F.col("__th")
    # The normal always points down the page.
    sign = F.when(ux < 0, -1.0).otherwise(1.0)
    d = d.withColumns({"__nx": -uy * sign, "__ny": ux * sign})
    nx, ny, drop = F.col("__nx"), F.col("__ny"), h * BASELINE_SHIFT
    t0, t1 = F.coalesce("t0", F.lit(0.0)) * length, F.coalesce("t1", F.lit(1.0)) * length
    d = d.withColumns({
        "__sx": F.col("__ax") + ux * t0 + nx * drop - ux * pad, "__sy": F.col("__ay") + uy * t0 + ny * drop - uy * pad,
        "__ex": F.col("__ax") + ux * t1 + nx * drop + ux * pad, "__ey": F.col("__ay") + uy * t1 + ny * drop + uy * pad,
        "__ox": nx * (h / 2.0 + pad), "__oy": ny * (h / 2.0 + pad),
    })
    sx, sy, ex, ey, ox, oy = (F.col(n) for n in ("__sx", "__sy", "__ex", "__ey", "__ox", "__oy"))
    quad = F.array(point(sx - ox, sy - oy), point(ex - ox, ey - oy), point(ex + ox, ey + oy), point(sx + ox, sy + oy))
    d = d.withColumn("__line", F.when(F.coalesce("valid_text", F.lit(False)) & (length > 1e-9), quad))
    return d.drop("__x1", "__y1", "__x2", "__y2", "__flip", "__ax", "__ay", "__dx", "__dy", "__len", "__ux", "__uy", "__th", "__nx", "__ny", "__sx", "__sy", "__ex", "__ey", "__ox", "__oy")


def _plain_corners(d: DataFrame, pad: float) -> DataFrame:
    """Adds ``__plain``: the axis-aligned box in whole pixels, inside the page."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")

    def inside(v: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(hi, v))

    d = d.withColumns({
        "__pl": inside(F.rint(F.col("left") * w) - pad, w), "__pt": inside(F.rint(F.col("top") * h) - pad, h),
        "__pr": inside(F.rint((F.col("left") + F.col("width")) * w) + pad, w), "__pb": inside(F.rint((F.col("top") + F.col("height")) * h) + pad, h),
    })
    l, t, r, b = (F.col(n) for n in ("__pl", "__pt", "__pr", "__pb"))
    return d.withColumn("__plain", F.when((r > l) & (b > t), F.array(point(l, t), point(r, t), point(r, b), point(l, b)))).drop("__pl", "__pt", "__pr", "__pb")


def _corners(spans: DataFrame, pad: float, drop_empty: bool) -> DataFrame:
    """Adds the corners as columns of their own and ``__has``: false where there is no area.

    Nearly all spans have a box; the others take their own, longer way.
    """
    boxed = F.coalesce((F.col("width") * F.col("w") > 0) & (F.col("height") * F.col("h") > 0), F.lit(False))
    turned = _box_corners(spans.filter(boxed), pad).withColumn("__has", F.lit(True))
    rest = _plain_corners(_line_corners(spans.filter(~boxed), max(0.0, pad)), pad)
    # Made once a span and apart from what reads it: in one piece the generated method would be too large to be compiled.
    found = F.filter(F.array(F.coalesce("__line", "__plain")), lambda q: q.isNotNull())
    rest = rest.withColumn("__q", F.explode_outer(found)).drop("__line", "__plain")
    if drop_empty:
        rest = rest.filter(F.col("__q").isNotNull())
    ends = {n: F.get("__q", F.lit(k))[c] for k, names in enumerate(_CORNERS) for n, c in zip(names, "xy")}
    return turned.unionByName(rest.withColumns({**ends, "__has": F.col("__q").isNotNull()}).drop("__q"))


def _quad() -> Column:
    return F.array(*[point(F.col(x), F.col(y)) for x, y in _CORNERS])


def token_quads(spans: DataFrame, pad: float = 0.0, drop_empty: bool = False) -> DataFrame:
    """Add ``quad``: the turned box, else the piece of baseline, else the plain box."""
    d = _corners(spans, pad, drop_empty).withColumn("quad", F.when(F.col("__has"), _quad()))
    return d.drop("__has", *[n for names in _CORNERS for n in names])


def _clip(d: DataFrame, left: Column, top: Column, right: Column, bottom: Column) -> DataFrame:
    """Adds ``clip``: whole-pixel bounds inside the page; null if empty."""
    w, h = F.col("w").cast("double"), F.col("h").cast("double")

    def inside(v: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(hi, v.cast("double")))

    d = d.withColumns({"__cl": inside(F.floor(left), w), "__ct": inside(F.floor(top), h), "__cr": inside(F.ceil(right), w), "__cb": inside(F.ceil(bottom), h)})
    l, t, r, b = (F.col(n) for n in ("__cl", "__ct", "__cr", "__cb"))
    body = F.struct(*[c.cast("int").alias(n) for n, c in (("l", l), ("t", t), ("r", r), ("b", b))])
    return d.withColumn("clip", F.when((r > l) & (b > t), body)).drop("__cl", "__ct", "__cr", "__cb")


def clip_quads(df: DataFrame, quad: str = "quad") -> DataFrame:
    """Add ``clip`` (l, t, r, b): whole-pixel bounds of the quad inside the page; null if empty."""
    xs, ys = F.col(quad)["x"], F.col(quad)["y"]  # of all points, without a walk through the list
    return _clip(df, F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def erase_regions(original: DataFrame, translated: DataFrame, pad: float = ERASE_PAD, digits: int | None = None) -> DataFrame:
    """Areas to paint over: padded quad and clipped rectangle of every span of both sides; ``digits`` rounds the corners."""
    both = original.withColumn("source_order", F.lit(0)).unionByName(translated.withColumn("source_order", F.lit(1)))
    d = _corners(both, pad, drop_empty=True).drop("__has")
    names = [n for corner in _CORNERS for n in corner]
    if digits is not None:
        d = d.withColumns({n: fixed(n, digits) for n in names})
    xs, ys = ([F.col(c[i]) for c in _CORNERS] for i in (0, 1))
    return _clip(d, F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)).withColumn("quad", _quad()).drop(*names)


# ---------------------------------------------------------------- spans on baselines


def span_geometry(df: DataFrame) -> DataFrame:
    """Box, angle and centre of a span from its line's baseline and its share t0..t1; unusable rows are dropped.

    Reads x1, y1, x2, y2 (fractions), height_norm, t0, t1, w, h.
    """
    w, h = F.col("w"), F.col("h")

    def rightwards(p: Column) -> Column:
        flip = (p["x2"] - p["x1"] < 0) | ((F.abs(p["x2"] - p["x1"]) < 1e-12) & (p["y2"] - p["y1"] < 0))
        back = F.struct(p["x2"].alias("ax"), p["y2"].alias("ay"), (p["x1"] - p["x2"]).alias("dx"), (p["y1"] - p["y2"]).alias("dy"))
        return F.when(flip, back).otherwise(F.struct(p["x1"].alias("ax"), p["y1"].alias("ay"), (p["x2"] - p["x1"]).alias("dx"), (p["y2"] - p["y1"]).alias("dy")))

    ends = F.struct((F.col("x1") * w).alias("x1"), (F.col("y1") * h).alias("y1"), (F.col("x2") * w).alias("x2"), (F.col("y2") * h).alias("y2"))
    base = once(once(ends, rightwards), lambda g: F.struct(g["ax"], g["ay"], g["dx"], g["dy"], F.hypot(g["dx"], g["dy"]).alias("len")))
    d = df.filter(F.col("t0").isNotNull() | F.col("t1").isNotNull()).withColumns({"t0": F.coalesce("t0", F.lit(0.0)), "t1": F.coalesce("t1", F.lit(1.0))})
    # Behind an outer explode the condition stays where it is; further down it would spell out the whole baseline again.
    d = d.withColumn("__g", F.explode_outer(F.filter(F.array(base), lambda g: g["len"] > 1e-12))).filter(F.col("__g").isNotNull())
    mid = (F.col("t0") + F.col("t1")) / 2.0
    cx, cy = F.col("__g.ax") + F.col("__g.dx") * mid, F.col("__g.ay") + F.col("__g.dy") * mid
    width, height = F.abs(F.col("t1") - F.col("t0")) * F.col("__g.len"), F.col("height_norm") * h
    return d.select(
        *[c for c in df.columns],
        ((cx - width / 2.0) / w).alias("left"), ((cy - height / 2.0) / h).alias("top"), (width / w).alias("width"), (height / h).alias("height"),
        once(F.degrees(F.atan2("__g.dy", "__g.dx")), fold_angle).alias("rotation_deg"), (cx / w).alias("cx"), (cy / h).alias("cy"),
    )


def span_offsets(spans: DataFrame) -> DataFrame:
    """Fill a missing ``start_raw`` with the furthest offset seen before on the page; spans without an end go."""
    seen = F.greatest(F.coalesce("start_raw", F.lit(0)), F.coalesce("end_raw", F.lit(0)))
    order = ["para_index", "item_index", "span_index"]
    d = ordered_scan(spans, ["image_id"], order, maxs={"__cursor": seen})
    return d.withColumn("start_raw", F.coalesce("start_raw", "__cursor", F.lit(0))).drop("__cursor").filter(F.col("end_raw").isNotNull())


# ---------------------------------------------------------------- angles and oriented bounds


def mean_angle(items: DataFrame, keys: list[str], angle: str = "rotation_deg") -> DataFrame:
    """Circular mean of the angles per group, 0 for none."""
    rad = F.radians(F.col(angle))
    deg = F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad))))
    return items.groupBy(*keys).agg(F.coalesce(deg, F.lit(0.0)).alias("mean_deg"))


def _extent(l: Column, t: Column, r: Column, b: Column, deg: Column, base: Column) -> dict[str, Column]:
    """Bounds of a turned rectangle in a frame turned by ``base``: its corners never need to be listed."""
    a, d = F.radians(base), F.radians(deg - base)
    cx, cy, hw, hh = (l + r) / 2.0, (t + b) / 2.0, (r - l) / 2.0, (b - t) / 2.0
    rx, ry = cx * F.cos(a) + cy * F.sin(a), cy * F.cos(a) - cx * F.sin(a)
    ex = F.abs(hw * F.cos(d)) + F.abs(hh * F.sin(d))
    ey = F.abs(hw * F.sin(d)) + F.abs(hh * F.cos(d))
    return {"x0": rx - ex, "y0": ry - ey, "x1": rx + ex, "y1": ry + ey}


def oriented_bounds(paras: DataFrame, items: DataFrame, eps: float = 0.0) -> DataFrame:
    """Rectangle (l, t, r, b) of each paragraph in its own orientation ``deg``.

    ``paras``: image_id, para_index and ``rect`` (may be null); ``items``: image_id, para_index, ``rect``.
    The paragraph's angle is its own, or the circular mean of its lines where it has none.
    """
    keys = ["image_id", "para_index"]
    it = items.filter(F.col("rect").isNotNull()).select(*keys, *[F.col("rect")[c].alias("i" + c) for c in ("l", "t", "r", "b", "deg")])
    rad = F.radians("ideg")
    g = it.groupBy(*keys).agg(
        *[F.min("i" + c).alias("u" + c) for c in "lt"], *[F.max("i" + c).alias("u" + c) for c in "rb"],
        F.degrees(F.atan2(F.avg(F.sin(rad)), F.avg(F.cos(rad)))).alias("mean"), F.collect_list(F.struct(*["i" + c for c in ("l", "t", "r", "b", "deg")])).alias("lines"),
    )
    p = paras.join(g, keys, "left")
    own = F.coalesce(F.col("rect.deg"), F.lit(0.0))
    derive = (F.abs(own) <= SMALL_ANGLE) & (F.abs(F.coalesce("mean", F.lit(0.0))) > SMALL_ANGLE)
    base = F.struct(*[F.coalesce(F.col("rect")[c], F.col("u" + c)).alias(c) for c in "ltrb"])
    p = p.filter(F.col("rect").isNotNull() | F.col("ul").isNotNull())
    p = p.select(*keys, F.when(derive, F.col("mean")).otherwise(own).alias("deg"), F.when(~derive, base).alias("own"), "lines")
    # bounds of the lines in the angle of each row of their paragraph; a paragraph may have several
    extents = F.transform("lines", lambda i: F.struct(*[c.alias(n) for n, c in _extent(*[i["i" + c] for c in ("l", "t", "r", "b", "deg")], F.col("deg")).items()]))
    d = p.withColumn("lines", extents)
    rows = W.partitionBy(*keys)
    ext = [F.min(F.array_min(F.col("lines")[c])).over(rows).alias(c) for c in ("x0", "y0")] + [F.max(F.array_max(F.col("lines")[c])).over(rows).alias(c) for c in ("x1", "y1")]
    d = d.select(*keys, "deg", "own", *ext)
    o = _extent(*[F.col("own")[c] for c in "ltrb"], F.col("deg"), F.col("deg"))
    x0, y0 = F.least("x0", o["x0"]), F.least("y0", o["y0"])
    x1, y1 = F.greatest("x1", o["x1"]), F.greatest("y1", o["y1"])
    a = F.radians("deg")
    mx, my = (x0 + x1) / 2.0, (y0 + y1) / 2.0
    cx, cy = mx * F.cos(a) - my * F.sin(a), mx * F.sin(a) + my * F.cos(a)
    return d.select(
        *keys, (cx - (x1 - x0) / 2.0 - eps).alias("l"), (cy - (y1 - y0) / 2.0 - eps).alias("t"),
        (cx + (x1 - x0) / 2.0 + eps).alias("r"), (cy + (y1 - y0) / 2.0 + eps).alias("b"), "deg",
    )


def _turn(d: Column) -> Column:
    """Difference of two angles, wrapped to (-180, 180]."""
    return F.when(d <= -180.0, d + 360.0).when(d > 180.0, d - 360.0).otherwise(d)


def _sign(c: Column) -> Column:
    return F.when(c >= 0, 1.0).otherwise(-1.0)


def curve_offsets(items: DataFrame) -> DataFrame:
    """Add ``curve_px``: how far the middle of a line bends away from its neighbours in the paragraph.

    Reads centre cx/cy, width, height (fractions), rotation_deg, w, h.
    """
    keys = ["image_id", "para_index"]
    px = items.withColumns({
        "__x": F.col("cx") * F.col("w"), "__y": F.col("cy") * F.col("h"),
        "__w": F.greatest(F.lit(1.0), F.col("width") * F.col("w")), "__h": F.greatest(F.lit(1.0), F.col("height") * F.col("h")),
    })
    here = F.struct(F.col("__x").alias("x"), F.col("__y").alias("y"))
    d = ordered_scan(px, keys, ["item_index"], lags={"__a": here}, leads={"__z": here})
    x, y, w, h = (F.col(c) for c in ("__x", "__y", "__w", "__h"))
    ax, ay, bx, by = F.col("__a.x"), F.col("__a.y"), F.col("__z.x"), F.col("__z.y")
    vx, vy = bx - ax, by - ay
    chord = F.hypot(vx, vy)
    signed = F.try_divide(vx * (y - ay) - vy * (x - ax), chord)
    bend = once(F.degrees(F.atan2(by - y, bx - x)) - F.degrees(F.atan2(y - ay, x - ax)), _turn)

    def bent(m: Column) -> Column:
        side = F.when((m["signed"] != 0) & (m["bend"] != 0) & (_sign(m["signed"]) != _sign(m["bend"])), -m["signed"]).otherwise(m["signed"])
        bonus = F.least(h * 0.32, F.greatest(w, m["chord"] * 0.5) * 0.1, F.abs(m["bend"]) * 0.18)
        return F.when(m["chord"] > 1e-6, side + _sign(m["bend"]) * bonus).otherwise(0.0)

    middle = once(F.struct(signed.alias("signed"), bend.alias("bend"), chord.alias("chord")), bent)
    nx, ny = F.coalesce(ax, bx), F.coalesce(ay, by)
    lean = once(F.col("rotation_deg") - F.degrees(F.atan2(y - ny, x - nx)), _turn)
    end = once(lean, lambda v: F.when(F.abs(v) >= 8.0, _sign(v) * F.least(h * 0.2, w * 0.06, F.abs(v) * 0.2)).otherwise(0.0))
    both = F.col("__a").isNotNull() & F.col("__z").isNotNull()
    raw = F.when(both, middle).when(F.col("__a").isNotNull() | F.col("__z").isNotNull(), end).otherwise(0.0)
    limit = F.least(h * 0.72, w * 0.18, F.lit(42.0))
    d = d.withColumn("__raw", raw)
    kept = F.when(F.abs("__raw") < F.greatest(F.lit(2.0), h * 0.12), 0.0).otherwise(F.greatest(-limit, F.least(limit, F.col("__raw"))))
    return d.withColumn("curve_px", kept).drop("__x", "__y", "__w", "__h", "__a", "__z", "__raw")


# ---------------------------------------------------------------- display


def project_to_display(df: DataFrame) -> DataFrame:
    """Add sx, sy, off_x, off_y: how a picture (nw x nh) sits in its element (cw x ch) under ``fit`` and ``position``."""
    cw, ch = F.col("cw").cast("double"), F.col("ch").cast("double")
    nw, nh = F.col("nw").cast("double"), F.col("nh").cast("double")
    fit = F.coalesce("fit", F.lit("fill"))
    fx, fy = F.try_divide(cw, nw), F.try_divide(ch, nh)
    scale = (
        F.when(fit == "contain", F.least(fx, fy)).when(fit == "cover", F.greatest(fx, fy))
        .when(fit == "scale-down", F.least(F.lit(1.0), fx, fy)).otherwise(1.0)
    )
    parts = F.split(F.trim(F.when(F.coalesce("position", F.lit("")) == "", "50% 50%").otherwise(F.col("position"))), r"\s+")
    px, py = F.get(parts, 0), F.coalesce(F.get(parts, 1), F.get(parts, 0))

    def offset(v: Column, pad: Column) -> Column:
        number = F.regexp_extract(v, r"^([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
        inside = F.least(pad, F.greatest(F.lit(0.0), number))
        return F.when(pad == 0, 0.0).when(v.endswith("%"), pad * number / 100.0).when(number.isNotNull(), inside).otherwise(pad * 0.5)

    filled = fit == "fill"
    pad_x, pad_y = F.greatest(F.lit(0.0), cw - nw * scale), F.greatest(F.lit(0.0), ch - nh * scale)
    good = lambda c: F.when(c > 0, c).otherwise(1.0)
    return df.withColumns({
        "sx": good(F.when(filled, fx).otherwise(scale)), "sy": good(F.when(filled, fy).otherwise(scale)),
        "off_x": F.when(filled, 0.0).otherwise(offset(px, pad_x)), "off_y": F.when(filled, 0.0).otherwise(offset(py, pad_y)),
    })


# ---------------------------------------------------------------- fonts


def uniform_span_font(spans: DataFrame) -> DataFrame:
    """Add ``font_px``: per line, the smallest size at which every span's text fits its box, never above the base.

    Reads base_px, tw, th (text size at the base), width, height, w, h, text.
    """
    aw, ah = F.col("width") * F.col("w"), F.col("height") * F.col("h")
    s = F.least(F.try_divide(aw * 0.995, F.col("tw")), F.try_divide(ah * 0.995, F.col("th")))
    usable = (F.trim("text") != "") & (aw > 0) & (ah > 0) & (F.col("tw") > 0) & (F.col("th") > 0) & (s < 1.0)
    need = F.when(usable, F.greatest(F.lit(10), F.floor(F.col("base_px") * s).cast("int")))
    keys = ["image_id", "para_index", "item_index"]
    large = large_keys(spans, keys, ["text", "width", "height", "base_px"])
    d = unranged(group_stats(ranged(spans, keys, ["text", "width", "height", "base_px"], large), keys, [], {"__least": ("min", need)}, large))
    return d.withColumn("font_px", F.least("base_px", "__least").cast("int")).drop("__least")
