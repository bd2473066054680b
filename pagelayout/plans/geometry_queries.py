"""Registered queries: geometry of boxes and lines, fitting, overlay HTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from pagelayout.functions.exprs import fixed
from pagelayout.operators import geometry as geo
from pagelayout.operators import render
from pagelayout.operators.layout import assemble_layout, explode_layout
from pagelayout.plans.registry import query
from pagelayout.sources import views
from pagelayout.sources.views import with_views


def sql_fixed(x: str, digits: int = 4) -> str:
    return f"floor(({x})*{10**digits}.0::DOUBLE+0.5)/{10**digits}.0::DOUBLE"


# Three forms of a box, by line number: fractions, percents, pixel bounds; some pixel bounds are empty.
FORMS_SQL = """SELECT image_id, para_index, item_index, w, h, "left"*w AS l, top*h AS t, ("left"+width)*w AS r, (top+height)*h AS b, rotation_deg, (para_index + item_index) % 4 AS form FROM items"""


def forms(spark: SparkSession, sf: str) -> DataFrame:
    i = views.items(spark, sf)
    form = (F.col("para_index") + F.col("item_index")) % 4
    frac, pct = form == 0, form == 1
    out = i.select("image_id", "para_index", "item_index", "w", "h", *[F.when(frac, F.col(c)).alias(c) for c in ("left", "top", "width", "height")],
                   *[F.when(pct, F.col(c) * 100.0).alias(c + "_pct") for c in ("left", "top", "width", "height")],
                   F.when(form % 2 == 0, F.col("rotation_deg")).alias("rotation_css"), F.col("rotation_deg").alias("rotation"),
                   (F.col("left") * F.col("w")).alias("l"), (F.col("top") * F.col("h")).alias("t"),
                   F.when(form == 3, F.col("left") * F.col("w")).otherwise((F.col("left") + F.col("width")) * F.col("w")).alias("r"), ((F.col("top") + F.col("height")) * F.col("h")).alias("b"))
    return out


@query(
    "F8_resolve_rect",
    with_views("items", f"""SELECT image_id, para_index, item_index, {", ".join(f"CASE WHEN form < 3 THEN {sql_fixed(c, 3)} END AS {c}" for c in "ltrb")}, CASE form WHEN 3 THEN NULL WHEN 2 THEN 0.0::DOUBLE ELSE rotation_deg END AS deg FROM forms""", forms=FORMS_SQL),
)
def q_resolve_rect(spark: SparkSession, sf: str) -> DataFrame:
    r = geo.resolve_rect(forms(spark, sf))
    return r.select("image_id", "para_index", "item_index", *[fixed(F.col("rect")[c], 3).alias(c) for c in "ltrb"], F.col("rect.deg").alias("deg"))


# Spans with every kind of geometry: turned boxes, baselines only, neither.
GEOM_SQL = """SELECT image_id, para_index, item_index, span_index, w, h, "left", top, CASE WHEN span_index % 4 = 3 THEN 0.0::DOUBLE ELSE width END AS width, CASE WHEN span_index % 8 = 7 THEN height ELSE height END AS height, rotation_deg,
  "left" AS x1, top + height*0.8::DOUBLE AS y1, CASE WHEN span_index % 8 = 7 THEN "left" ELSE "left" - width*2.0::DOUBLE END AS x2, CASE WHEN span_index % 8 = 7 THEN top + height*0.8::DOUBLE ELSE top END AS y2 FROM spans"""


def geom_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = views.spans(spark, sf)
    j = F.col("span_index")
    p1 = geo.point(F.col("left"), F.col("top") + F.col("height") * 0.8)
    p2 = geo.point(F.when(j % 8 == 7, F.col("left")).otherwise(F.col("left") - F.col("width") * 2.0), F.when(j % 8 == 7, F.col("top") + F.col("height") * 0.8).otherwise(F.col("top")))
    return s.withColumns({
        "p1": p1, "p2": p2, "t0": F.when(j % 3 != 0, F.lit(0.25)), "t1": F.lit(0.75), "height_raw": F.col("height"), "valid_text": F.lit(True),
        "width": F.when(j % 4 == 3, 0.0).otherwise(F.col("width")),
    })


_BOXQ = """SELECT image_id, para_index, item_index, span_index, w, h, cx + (sx*hw*c - sy*hh*s) AS x, cy + (sx*hw*s + sy*hh*c) AS y, k FROM
  (SELECT *, "left"*w + width*w/2.0::DOUBLE AS cx, top*h + height*h/2.0::DOUBLE AS cy, width*w/2.0::DOUBLE + 2.0::DOUBLE AS hw, height*h/2.0::DOUBLE + 2.0::DOUBLE AS hh, cos(radians(rotation_deg)) AS c, sin(radians(rotation_deg)) AS s FROM geom WHERE width > 0) g,
  (VALUES (0,-1.0::DOUBLE,-1.0::DOUBLE),(1,1.0::DOUBLE,-1.0::DOUBLE),(2,1.0::DOUBLE,1.0::DOUBLE),(3,-1.0::DOUBLE,1.0::DOUBLE)) v(k, sx, sy)"""
_LINEQ = """SELECT image_id, para_index, item_index, span_index, w, h, CASE WHEN k IN (0,3) THEN ax + ux*(t0*len) - ux*2 ELSE ax + ux*(0.75::DOUBLE*len) + ux*2 END + nx*hs*0.4::DOUBLE + (CASE WHEN k < 2 THEN -1 ELSE 1 END)*nx*(hs/2+2) AS x,
  CASE WHEN k IN (0,3) THEN ay + uy*(t0*len) - uy*2 ELSE ay + uy*(0.75::DOUBLE*len) + uy*2 END + ny*hs*0.4::DOUBLE + (CASE WHEN k < 2 THEN -1 ELSE 1 END)*ny*(hs/2+2) AS y, k FROM (
  SELECT *, dx/len AS ux, dy/len AS uy, -dy/len AS nx, dx/len AS ny, CASE WHEN span_index % 3 = 0 THEN 0.0::DOUBLE ELSE 0.25::DOUBLE END AS t0, greatest(1.0::DOUBLE, height*h) AS hs FROM (
  SELECT *, x2*w AS ax, y2*h AS ay, x1*w - x2*w AS dx, y1*h - y2*h AS dy, sqrt((x1*w-x2*w)*(x1*w-x2*w) + (y1*h-y2*h)*(y1*h-y2*h)) AS len FROM geom WHERE width = 0 AND span_index % 8 <> 7)), range(4) r(k)"""
_RECTQ = """SELECT image_id, para_index, item_index, span_index, w, h, CASE WHEN k IN (0,3) THEN l ELSE r END AS x, CASE WHEN k < 2 THEN t ELSE b END AS y, k FROM (SELECT *, greatest(0, least(w, round_even("left"*w, 0)-2)) AS l, greatest(0, least(w, round_even("left"*w, 0)+2)) AS r,
  greatest(0, least(h, round_even(top*h, 0)-2)) AS t, greatest(0, least(h, round_even((top+height)*h, 0)+2)) AS b FROM geom WHERE width = 0 AND span_index % 8 = 7) , range(4) q(k)"""
QUADS = {"geom": GEOM_SQL, "boxq": _BOXQ, "lineq": _LINEQ, "rectq": _RECTQ, "quads": "SELECT * FROM boxq UNION ALL SELECT * FROM lineq UNION ALL SELECT * FROM rectq"}


@query("F9_token_quads", with_views("spans", f"SELECT image_id, para_index, item_index, span_index, CAST(k AS INTEGER) AS k, {sql_fixed('x', 3)} AS x, {sql_fixed('y', 3)} AS y FROM quads", **QUADS))
def q_token_quads(spark: SparkSession, sf: str) -> DataFrame:
    q = geo.token_quads(geom_spans(spark, sf), 2.0)
    # The inner form would work out every quad a second time in the filter it implies.
    d = q.select("image_id", "para_index", "item_index", "span_index", F.posexplode_outer("quad").alias("k", "p"))
    return d.select("image_id", "para_index", "item_index", "span_index", "k", fixed("p.x", 3).alias("x"), fixed("p.y", 3).alias("y"))


_CLIP = """SELECT image_id, para_index, item_index, span_index, CAST(greatest(0, least(w, floor(min(x)))) AS INTEGER) AS l, CAST(greatest(0, least(h, floor(min(y)))) AS INTEGER) AS t, CAST(greatest(0, least(w, ceil(max(x)))) AS INTEGER) AS r, CAST(greatest(0, least(h, ceil(max(y)))) AS INTEGER) AS b
  FROM quads GROUP BY image_id, para_index, item_index, span_index, w, h"""


# Whole-pixel bounds are compared from coordinates rounded to 1/1000 px, so both engines floor the same number.
def _snap(df: DataFrame) -> DataFrame:
    corners = [F.get("quad", F.lit(k)) for k in range(4)]
    return df.withColumn("quad", F.when(F.col("quad").isNotNull(), F.array(*[geo.point(fixed(p["x"], 3), fixed(p["y"], 3)) for p in corners])))


_SNAPPED = {**QUADS, "quads": f"SELECT image_id, para_index, item_index, span_index, w, h, {sql_fixed('x', 3)} AS x, {sql_fixed('y', 3)} AS y FROM (SELECT * FROM boxq UNION ALL SELECT * FROM lineq UNION ALL SELECT * FROM rectq)"}


@query("F10_clip_quads", with_views("spans", f"SELECT image_id, para_index, item_index, span_index, CASE WHEN r > l AND b > t THEN l END AS l, CASE WHEN r > l AND b > t THEN t END AS t, CASE WHEN r > l AND b > t THEN r END AS r, CASE WHEN r > l AND b > t THEN b END AS b FROM ({_CLIP})", **_SNAPPED))
def q_clip_quads(spark: SparkSession, sf: str) -> DataFrame:
    q = geo.clip_quads(_snap(geo.token_quads(geom_spans(spark, sf), 2.0)))
    return q.select("image_id", "para_index", "item_index", "span_index", "clip.l", "clip.t", "clip.r", "clip.b")


_CORNERS_SQL = f"""SELECT image_id, para_index, item_index, span_index, {", ".join(f"max(CASE WHEN k = {k} THEN {sql_fixed(c, 3)} END) AS {c}{k}" for k in range(4) for c in "xy")}
  FROM (SELECT * FROM boxq UNION ALL SELECT * FROM lineq UNION ALL SELECT * FROM rectq) GROUP BY image_id, para_index, item_index, span_index"""


@query(
    "F17_erase_regions",
    with_views(
        "spans",
        f"""SELECT c.*, CAST(so AS INTEGER) AS source_order, {", ".join(f"CASE WHEN r > l AND b > t THEN {c} END AS {c}" for c in "ltrb")}
  FROM corners c JOIN ({_CLIP}) USING (image_id, para_index, item_index, span_index), range(2) z(so)""",
        **_SNAPPED, corners=_CORNERS_SQL,
    ),
)
def q_erase_regions(spark: SparkSession, sf: str) -> DataFrame:
    s = geom_spans(spark, sf)
    r = geo.erase_regions(s, s, digits=3)
    corners = [F.get("quad", F.lit(k))[c].alias(f"{c}{k}") for k in range(4) for c in "xy"]
    return r.select("image_id", "para_index", "item_index", "span_index", "source_order", *corners, *[F.col("clip")[c].alias(c) for c in "ltrb"])


_BASE_SQL = """SELECT image_id, para_index, item_index, span_index, w, h, CASE WHEN span_index % 5 = 0 THEN NULL ELSE 0.125::DOUBLE*(span_index % 3) END AS t0, CASE WHEN span_index % 7 = 0 THEN NULL ELSE 0.9::DOUBLE END AS t1,
  CASE WHEN item_index % 2 = 0 THEN "left" ELSE "left" + 0.3::DOUBLE END AS x1, top AS y1, CASE WHEN item_index % 2 = 0 THEN "left" + 0.3::DOUBLE ELSE "left" END AS x2, top + 0.001::DOUBLE*(para_index % 9 - 4) AS y2, height AS hn FROM spans"""


@query(
    "F12_span_geometry",
    with_views(
        "spans",
        f"""SELECT image_id, para_index, item_index, span_index, {sql_fixed('(cx - abs(t1-t0)*len/2)/w', 6)} AS "left", {sql_fixed('(cy - hn*h/2)/h', 6)} AS top, {sql_fixed('abs(t1-t0)*len/w', 6)} AS width, {sql_fixed('degrees(atan2(dy,dx))', 4)} AS rotation_deg FROM (
  SELECT *, ax + dx*(t0+t1)/2 AS cx, ay + dy*(t0+t1)/2 AS cy, sqrt(dx*dx+dy*dy) AS len FROM (SELECT image_id, para_index, item_index, span_index, w, h, hn, coalesce(t0, 0.0::DOUBLE) AS t0, coalesce(t1, 1.0::DOUBLE) AS t1, least(x1,x2)*w AS ax, CASE WHEN x2 < x1 THEN y2 ELSE y1 END*h AS ay, abs(x2*w-x1*w) AS dx,
  CASE WHEN x2 < x1 THEN y1*h-y2*h ELSE y2*h-y1*h END AS dy FROM based WHERE t0 IS NOT NULL OR t1 IS NOT NULL))""",
        based=_BASE_SQL,
    ),
)
def q_span_geometry(spark: SparkSession, sf: str) -> DataFrame:
    s = views.spans(spark, sf)
    j, i, k = F.col("span_index"), F.col("item_index"), F.col("para_index")
    l, r = F.col("left"), F.col("left") + 0.3
    s = s.select("image_id", "para_index", "item_index", "span_index", "w", "h",
                 F.when(j % 5 != 0, F.lit(0.125) * (j % 3)).alias("t0"), F.when(j % 7 != 0, F.lit(0.9)).alias("t1"),
                 F.when(i % 2 == 0, l).otherwise(r).alias("x1"), F.col("top").alias("y1"), F.when(i % 2 == 0, r).otherwise(l).alias("x2"), (F.col("top") + F.lit(0.001) * (k % 9 - 4)).alias("y2"), F.col("height").alias("height_norm"))
    d = geo.span_geometry(s)
    return d.select("image_id", "para_index", "item_index", "span_index", *[fixed(c, 6).alias(c) for c in ("left", "top", "width")], fixed("rotation_deg").alias("rotation_deg"))


_OFFS = """SELECT image_id, para_index, item_index, span_index, CASE WHEN span_index % 3 <> 1 THEN para_index*1000 + item_index*200 + span_index*10 END AS start_raw, CASE WHEN span_index % 5 <> 4 THEN para_index*1000 + item_index*200 + span_index*10 + 8 END AS end_raw FROM spans"""


@query(
    "W13_span_offsets",
    with_views(
        "spans",
        """SELECT image_id, para_index, item_index, span_index, start_raw, end_raw FROM (SELECT image_id, para_index, item_index, span_index, coalesce(start_raw, max(greatest(coalesce(start_raw,0), coalesce(end_raw,0))) OVER (PARTITION BY image_id ORDER BY para_index, item_index, span_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_raw, end_raw FROM offs) WHERE end_raw IS NOT NULL""",
        offs=_OFFS,
    ),
)
def q_span_offsets(spark: SparkSession, sf: str) -> DataFrame:
    s = views.spans(spark, sf)
    at = F.col("para_index") * 1000 + F.col("item_index") * 200 + F.col("span_index") * 10
    s = s.select("image_id", "para_index", "item_index", "span_index", F.when(F.col("span_index") % 3 != 1, at).alias("start_raw"), F.when(F.col("span_index") % 5 != 4, at + 8).alias("end_raw"))
    return geo.span_offsets(s)


@query("A3_mean_angle", with_views("items", f"SELECT image_id, para_index, {sql_fixed('degrees(atan2(avg(sin(radians(rotation_deg))), avg(cos(radians(rotation_deg)))))')} AS mean_deg FROM items GROUP BY ALL"))
def q_mean_angle(spark: SparkSession, sf: str) -> DataFrame:
    return geo.mean_angle(views.items(spark, sf), ["image_id", "para_index"]).withColumn("mean_deg", fixed("mean_deg"))


def item_rects(spark: SparkSession, sf: str) -> DataFrame:
    return _rects(views.items(spark, sf)).select("image_id", "para_index", "item_index", "text", "w", "h", "rotation_deg", "rect")


def _rects(items: DataFrame) -> DataFrame:
    i = items.withColumns({c: F.lit(None).cast("double") for c in ("left_pct", "top_pct", "width_pct", "height_pct", "rotation_css", "l", "t", "r", "b")})
    return geo.resolve_rect(i.withColumn("rotation", F.col("rotation_deg")))


def para_rects(spark: SparkSession, sf: str) -> DataFrame:
    """Every third paragraph has no bounds of its own."""
    p = views.paras(spark, sf)
    rect = F.struct("l", "t", "r", "b", F.lit(0.0).alias("deg"))
    return p.select("image_id", "para_index", "text", F.when(F.col("para_index") % 3 != 0, rect).alias("rect"))


CORNERS = """SELECT i.image_id, i.para_index, cx + sx*hw*cos(radians(deg)) - sy*hh*sin(radians(deg)) AS x, cy + sx*hw*sin(radians(deg)) + sy*hh*cos(radians(deg)) AS y FROM (SELECT image_id, para_index, ("left"+width/2)*w AS cx, (top+height/2)*h AS cy, width*w/2 AS hw, height*h/2 AS hh, rotation_deg AS deg FROM items) i,
  (VALUES (-1.0::DOUBLE,-1.0::DOUBLE),(1.0::DOUBLE,-1.0::DOUBLE),(1.0::DOUBLE,1.0::DOUBLE),(-1.0::DOUBLE,1.0::DOUBLE)) v(sx,sy)"""
ANGLES = """SELECT p.image_id, p.para_index, CASE WHEN abs(m) > 0.01 THEN m ELSE 0.0::DOUBLE END AS deg, abs(m) > 0.01 AS derived, CASE WHEN p.para_index % 3 <> 0 THEN p.l ELSE u.l END AS l, CASE WHEN p.para_index % 3 <> 0 THEN p.t ELSE u.t END AS t, CASE WHEN p.para_index % 3 <> 0 THEN p.r ELSE u.r END AS r, CASE WHEN p.para_index % 3 <> 0 THEN p.b ELSE u.b END AS b
  FROM paras p JOIN (SELECT image_id, para_index, degrees(atan2(avg(sin(radians(rotation_deg))), avg(cos(radians(rotation_deg))))) AS m, min("left"*w) AS l, min(top*h) AS t, max(("left"+width)*w) AS r, max((top+height)*h) AS b FROM items GROUP BY ALL) u USING (image_id, para_index)"""
ORIENTED = """SELECT image_id, para_index, deg, x0, y0, x1, y1, (x0+x1)/2*cos(radians(deg)) - (y0+y1)/2*sin(radians(deg)) AS mx, (x0+x1)/2*sin(radians(deg)) + (y0+y1)/2*cos(radians(deg)) AS my FROM (
  SELECT image_id, para_index, deg, min(x*cos(radians(-deg)) - y*sin(radians(-deg))) AS x0, max(x*cos(radians(-deg)) - y*sin(radians(-deg))) AS x1, min(x*sin(radians(-deg)) + y*cos(radians(-deg))) AS y0, max(x*sin(radians(-deg)) + y*cos(radians(-deg))) AS y1 FROM (
  SELECT a.image_id, a.para_index, a.deg, c.x, c.y FROM angles a JOIN corners c USING (image_id, para_index) UNION ALL SELECT image_id, para_index, deg, CASE WHEN k IN (0,3) THEN l ELSE r END, CASE WHEN k < 2 THEN t ELSE b END FROM angles, range(4) q(k) WHERE NOT derived) GROUP BY ALL)"""


@query(
    "A5_oriented_bounds",
    with_views("items paras", f"SELECT image_id, para_index, {sql_fixed('mx-(x1-x0)/2', 3)} AS l, {sql_fixed('my-(y1-y0)/2', 3)} AS t, {sql_fixed('mx+(x1-x0)/2', 3)} AS r, {sql_fixed('my+(y1-y0)/2', 3)} AS b, {sql_fixed('deg')} AS deg FROM oriented", corners=CORNERS, angles=ANGLES, oriented=ORIENTED),
)
def q_oriented_bounds(spark: SparkSession, sf: str) -> DataFrame:
    o = geo.oriented_bounds(para_rects(spark, sf), item_rects(spark, sf))
    return o.select("image_id", "para_index", *[fixed(c, 3).alias(c) for c in "ltrb"], fixed("deg").alias("deg"))


_CURVES = """SELECT *, lag(x) OVER o AS ax, lag(y) OVER o AS ay, lead(x) OVER o AS bx, lead(y) OVER o AS by_ FROM (SELECT image_id, para_index, item_index, ("left"+width/2 + 0.03::DOUBLE*((item_index*item_index) % 3))*w AS x, (top+height/2)*h AS y, greatest(1.0::DOUBLE, width*w) AS pw, greatest(1.0::DOUBLE, height*h) AS ph, rotation_deg AS deg FROM items)
  WINDOW o AS (PARTITION BY image_id, para_index ORDER BY item_index)"""
_BENT = """SELECT *, CASE WHEN d <= -180 THEN d + 360 WHEN d > 180 THEN d - 360 ELSE d END AS bend FROM (SELECT *, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN degrees(atan2(by_-y, bx-x)) - degrees(atan2(y-ay, x-ax)) ELSE deg - degrees(atan2(y-coalesce(ay,by_), x-coalesce(ax,bx))) END AS d,
  sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS chord, ((bx-ax)*(y-ay) - (by_-ay)*(x-ax))/sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) AS signed FROM curves)"""
_RAWC = """SELECT *, CASE WHEN ax IS NOT NULL AND bx IS NOT NULL THEN CASE WHEN signed <> 0 AND bend <> 0 AND (signed >= 0) <> (bend >= 0) THEN -signed ELSE signed END + (CASE WHEN bend >= 0 THEN 1 ELSE -1 END)*least(ph*0.32::DOUBLE, greatest(pw, chord*0.5::DOUBLE)*0.1::DOUBLE, abs(bend)*0.18::DOUBLE)
  WHEN (ax IS NOT NULL OR bx IS NOT NULL) AND abs(bend) >= 8 THEN (CASE WHEN bend >= 0 THEN 1 ELSE -1 END)*least(ph*0.2::DOUBLE, pw*0.06::DOUBLE, abs(bend)*0.2::DOUBLE) ELSE 0.0::DOUBLE END AS raw FROM bent"""


@query(
    "W8_curve_offsets",
    with_views("items", f"SELECT image_id, para_index, item_index, {sql_fixed('CASE WHEN abs(raw) < greatest(2.0::DOUBLE, ph*0.12::DOUBLE) THEN 0.0::DOUBLE ELSE greatest(-lim, least(lim, raw)) END', 3)} AS curve_px FROM (SELECT *, least(ph*0.72::DOUBLE, pw*0.18::DOUBLE, 42.0::DOUBLE) AS lim FROM rawc)", curves=_CURVES, bent=_BENT, rawc=_RAWC),
)
def q_curve_offsets(spark: SparkSession, sf: str) -> DataFrame:
    i = views.items(spark, sf)
    i = i.withColumns({"cx": F.col("left") + F.col("width") / 2 + F.lit(0.03) * ((F.col("item_index") * F.col("item_index")) % 3), "cy": F.col("top") + F.col("height") / 2})
    return geo.curve_offsets(i).select("image_id", "para_index", "item_index", fixed("curve_px", 3).alias("curve_px"))


_FITS = ["fill", "contain", "cover", "scale-down", "none"]
_POS = ["50% 50%", "10% 90%", "5px 7px", "left", "25%", ""]


@query(
    "F11_project_to_display",
    with_views(
        "images",
        f"""SELECT image_id, {sql_fixed('sx', 6)} AS sx, {sql_fixed('sy', 6)} AS sy, {sql_fixed("CASE WHEN fit = 'fill' OR px = 0 THEN 0.0::DOUBLE ELSE CASE pos WHEN 0 THEN px*50/100 WHEN 1 THEN px*10/100 WHEN 2 THEN least(px, 5.0::DOUBLE) WHEN 3 THEN px*0.5::DOUBLE WHEN 4 THEN px*25/100 ELSE px*50/100 END END", 3)} AS off_x,
  {sql_fixed("CASE WHEN fit = 'fill' OR py = 0 THEN 0.0::DOUBLE ELSE CASE pos WHEN 0 THEN py*50/100 WHEN 1 THEN py*90/100 WHEN 2 THEN least(py, 7.0::DOUBLE) WHEN 3 THEN py*0.5::DOUBLE WHEN 4 THEN py*25/100 ELSE py*50/100 END END", 3)} AS off_y FROM (
  SELECT *, greatest(0.0::DOUBLE, cw - nw*s) AS px, greatest(0.0::DOUBLE, ch - nh*s) AS py, CASE WHEN fit = 'fill' THEN cw/nw ELSE s END AS sx, CASE WHEN fit = 'fill' THEN ch/nh ELSE s END AS sy FROM (
  SELECT *, CASE fit WHEN 'contain' THEN least(cw/nw, ch/nh) WHEN 'cover' THEN greatest(cw/nw, ch/nh) WHEN 'scale-down' THEN least(1.0::DOUBLE, cw/nw, ch/nh) ELSE 1.0::DOUBLE END AS s FROM (
  SELECT image_id, image_id % 6 AS pos, {views.sql_pick(_FITS, 'image_id')} AS fit, CAST(300 + image_id % 2000 AS DOUBLE) AS cw, CAST(400 + (image_id*7) % 3000 AS DOUBLE) AS ch, CAST(w AS DOUBLE) AS nw, CAST(h AS DOUBLE) AS nh FROM images)))""",
    ),
)
def q_project_to_display(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("image_id")
    i = views.images(spark, sf).select("image_id", F.col("w").alias("nw"), F.col("h").alias("nh"), (300 + k % 2000).alias("cw"), (400 + (k * 7) % 3000).alias("ch"), views.pick(_FITS, k).alias("fit"), views.pick(_POS, k).alias("position"))
    return geo.project_to_display(i).select("image_id", fixed("sx", 6).alias("sx"), fixed("sy", 6).alias("sy"), fixed("off_x", 3).alias("off_x"), fixed("off_y", 3).alias("off_y"))


@query(
    "A17_uniform_span_font",
    with_views(
        "spans",
        """SELECT image_id, para_index, item_index, span_index, CAST(least(base, coalesce(min(CASE WHEN s < 1 THEN greatest(10, CAST(floor(base*s) AS INTEGER)) END) OVER (PARTITION BY image_id, para_index, item_index), base)) AS INTEGER) AS font_px FROM (
  SELECT *, least(width*w*0.995::DOUBLE/(7.0::DOUBLE*length(text) + span_index), height*h*0.995::DOUBLE/(14.0::DOUBLE + span_index)) AS s, 16 + para_index % 5 AS base FROM spans)""",
    ),
)
def q_uniform_span_font(spark: SparkSession, sf: str) -> DataFrame:
    s = views.spans(spark, sf).withColumns({"tw": 7.0 * F.length("text") + F.col("span_index"), "th": 14.0 + F.col("span_index"), "base_px": 16 + F.col("para_index") % 5})
    return geo.uniform_span_font(s).select("image_id", "para_index", "item_index", "span_index", "font_px")


# ---------------------------------------------------------------- fitting

FIT_SQL = """SELECT image_id, para_index, item_index, CAST(CASE WHEN wraps THEN best ELSE size END AS INTEGER) AS font_px, wraps AS wrap FROM (
  SELECT *, size <= 12 AND ah >= 24 AND tw > aw*1.2::DOUBLE AND best >= floor(size*1.25::DOUBLE) AS wraps FROM (
  SELECT *, coalesce(list_max(list_filter(range(size, CAST(greatest(size, floor(least(greatest(16.0::DOUBLE, ah), 288.0::DOUBLE))) AS BIGINT) + 1), lambda s: ceil(greatest(1.0::DOUBLE, tw*(s/96.0::DOUBLE))/greatest(1.0::DOUBLE, aw))*th*(s/96.0::DOUBLE) <= ah)), size) AS best FROM (
  SELECT *, greatest(10, CAST(floor(96.0::DOUBLE*least(aw*0.98::DOUBLE/tw, ah*0.94::DOUBLE/th)) AS INTEGER)) AS size FROM (
  SELECT image_id, para_index, item_index, greatest(1.0::DOUBLE, width*w/(1 + para_index % 7)) AS aw, greatest(1.0::DOUBLE, height*h*(1 + para_index % 4) - 2.0::DOUBLE) AS ah, 50.0::DOUBLE*length(text) AS tw, 90.0::DOUBLE + item_index AS th FROM items))))"""


def fitted(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("para_index")
    i = views.items(spark, sf).withColumns({
        "avail_w": F.col("width") * F.col("w") / (1 + k % 7), "avail_h": F.col("height") * F.col("h") * (1 + k % 4) - 2.0,
        "tw96": 50.0 * F.length("text"), "th96": 90.0 + F.col("item_index"), "is_thai": F.lit(False),
    })
    return render.fit_font_size(i)


@query("W16_fit_font_size", with_views("items", "SELECT * FROM fit", fit=FIT_SQL))
def q_fit_font_size(spark: SparkSession, sf: str) -> DataFrame:
    return fitted(spark, sf).select("image_id", "para_index", "item_index", "font_px", "wrap")


@query("A9_shared_font_size", with_views("items", "SELECT image_id, para_index, CAST(least(s, med) AS INTEGER) AS font_px FROM (SELECT image_id, para_index, min(font_px) AS s FROM fit GROUP BY ALL) JOIN (SELECT image_id, round_even(quantile_cont(CAST(s AS DOUBLE), 0.5), 0) AS med FROM (SELECT image_id, para_index, min(font_px) AS s FROM fit GROUP BY ALL) GROUP BY 1) USING (image_id)", fit=FIT_SQL))
def q_shared_font_size(spark: SparkSession, sf: str) -> DataFrame:
    return render.shared_font_size(fitted(spark, sf))


@query("A10_median_font_size", with_views("items", "SELECT image_id, para_index, CAST(list_extract(list(font_px ORDER BY font_px), count(*)//2 + 1) AS INTEGER) AS font_px FROM fit GROUP BY ALL", fit=FIT_SQL))
def q_median_font_size(spark: SparkSession, sf: str) -> DataFrame:
    return render.median_font_size(fitted(spark, sf))


_TOKS = """SELECT image_id, para_index, item_index, w, "left", width, unnest(ts) AS text, CAST(unnest(range(len(ts))) AS INTEGER) AS word_no FROM (SELECT *, regexp_extract_all(text, ' +|[^ ]+') AS ts FROM items)"""


@query(
    "W17_word_boxes",
    with_views(
        "items",
        f"""SELECT image_id, para_index, item_index, word_no, text, {sql_fixed('(margin + before)/lw', 6)} AS t0, {sql_fixed('(margin + before + wp)/lw', 6)} AS t1, {sql_fixed('"left" + width*(margin+before)/lw', 6)} AS "left", {sql_fixed('width*wp/lw', 6)} AS width FROM (
  SELECT *, CASE WHEN total < lw THEN (lw - total)/2 ELSE 0.0::DOUBLE END AS margin FROM (SELECT *, 6.0::DOUBLE*length(text) AS wp, width*w AS lw, coalesce(sum(6.0::DOUBLE*length(text)) OVER (PARTITION BY image_id, para_index, item_index ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
  sum(6.0::DOUBLE*length(text)) OVER (PARTITION BY image_id, para_index, item_index) AS total FROM toks)) WHERE trim(text) <> ''""",
        toks=_TOKS,
    ),
)
def q_word_boxes(spark: SparkSession, sf: str) -> DataFrame:
    i = views.items(spark, sf)
    toks = i.select("image_id", "para_index", "item_index", "w", "left", "top", "width", "height", F.posexplode(F.regexp_extract_all("text", F.lit(" +|[^ ]+"), 0)).alias("word_no", "text"))
    toks = toks.withColumns({"kind": F.when(F.trim("text") == "", "space").otherwise("word"), "width_px": 6.0 * F.length("text")})
    d = render.word_boxes(toks)
    return d.select("image_id", "para_index", "item_index", "word_no", "text", *[fixed(c, 6).alias(c) for c in ("t0", "t1", "left", "width")])


@query("W15_wrap_words")
def q_wrap_words(spark: SparkSession, sf: str) -> DataFrame:
    # exploding keeps the width of a paragraph from being worked out for every line
    p = views.paras(spark, sf).select("*", F.explode(F.array(F.col("r") - F.col("l"))).alias("wide"))
    toks = F.regexp_extract_all("text", F.lit(r"\s+|\S+"), 0)
    blank = lambda t: (t < "!") & (F.trim(F.replace(t, F.lit("\n"), F.lit(" "))) == "")  # a glance at the first letter tells most words
    tokens = F.transform(toks, lambda t: F.struct(F.when(blank(t), "space").otherwise("word").alias("kind"), t.alias("text"), (8.0 * F.length(t)).alias("width")))
    caps = F.transform(F.sequence(F.lit(0), F.col("para_index") % 6), lambda i: F.col("wide") * (1.0 - i * 0.1))
    lines = render.wrap_words(tokens, caps, (F.col("para_index") % 4).cast("int"))
    # The inner form would wrap every paragraph a second time in the filter it implies.
    wrapped = p.select("image_id", "para_index", lines.alias("lines")).select("image_id", "para_index", F.posexplode_outer("lines").alias("line", "text"))
    return wrapped.filter(F.col("line").isNotNull())


# ---------------------------------------------------------------- nesting and HTML


def trees(spark: SparkSession, sf: str) -> DataFrame:
    keys = {"side": F.lit("original")}
    box = F.struct("left", "top", "width", "height").alias("box")
    p = views.paras(spark, sf).withColumns(keys).select("image_id", "side", "para_index", "text")
    i = views.items(spark, sf).withColumns(keys).select("image_id", "side", "para_index", "item_index", "text", box)
    s = views.spans(spark, sf).withColumns({**keys, "t0": F.lit(0.0), "t1": F.lit(1.0)}).filter(F.col("item_index") != 1)
    return assemble_layout(p, i, s.select("image_id", "side", "para_index", "item_index", "span_index", "text", "t0", "t1", box))


@query(
    "S5_assemble_layout",
    with_views("paras items spans", "SELECT p.image_id, p.n AS paras, i.n AS items, coalesce(s.n, 0) AS spans FROM (SELECT image_id, count(*) AS n FROM paras GROUP BY 1) p JOIN (SELECT image_id, count(*) AS n FROM items GROUP BY 1) i USING (image_id) LEFT JOIN (SELECT image_id, count(*) AS n FROM spans WHERE item_index <> 1 GROUP BY 1) s USING (image_id)"),
)
def q_assemble_layout(spark: SparkSession, sf: str) -> DataFrame:
    t = trees(spark, sf)
    n_items = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda a, p: a + F.size(p["items"]))
    n_spans = F.aggregate("paragraphs", F.lit(0).cast("long"), lambda a, p: a + F.aggregate(p["items"], F.lit(0).cast("long"), lambda b, i: b + F.coalesce(F.size(i["spans"]), F.lit(0)) * F.when(i["spans"].isNull(), 0).otherwise(1)))
    return t.select("image_id", F.size("paragraphs").cast("long").alias("paras"), n_items.alias("items"), n_spans.alias("spans"))


@query(
    "S4_explode_layout",
    with_views(
        "items spans",
        """SELECT image_id, para_index, item_index, CAST(span_index AS INTEGER) AS span_index, text FROM spans WHERE item_index <> 1 UNION ALL SELECT image_id, para_index, item_index, -1, text FROM items WHERE item_index = 1""",
    ),
)
def q_explode_layout(spark: SparkSession, sf: str) -> DataFrame:
    return explode_layout(trees(spark, sf))[2].select("image_id", "para_index", "item_index", "span_index", "text")


_FS = "greatest(6, least(CASE WHEN font_px > 0 THEN font_px ELSE greatest(10, CAST(round_even(ih*0.85::DOUBLE, 0) AS INTEGER)) END, greatest(6, CAST(floor(ih*0.95::DOUBLE) AS INTEGER))))"


@query(
    "A15_render_overlay_html",
    with_views(
        "items paras",
        f"""SELECT image_id, count(*) AS elements, CAST(sum({_FS}) AS BIGINT) AS font_total, CAST(sum(length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))) AS BIGINT) AS chars FROM (
  SELECT i.*, i.height*i.h AS ih, f.font_px FROM items i JOIN fit f USING (image_id, para_index, item_index)) GROUP BY 1""",
        fit=FIT_SQL,
    ),
)
def q_render_overlay_html(spark: SparkSession, sf: str) -> DataFrame:
    """The HTML itself is checked in the tests; here its parts are counted back out of the page strings."""
    html = overlay_html(spark, sf)
    elements = F.regexp_extract_all("html", F.lit(r'class="tp-item '), 0)
    fonts = F.regexp_extract_all("html", F.lit(r"font-size: (\d+)px"), 1)
    texts = F.regexp_extract_all("html", F.lit(r"<span>([^<]*)</span>"), 1)
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + f(x))
    return html.select("image_id", F.size(elements).cast("long").alias("elements"), total(fonts, lambda x: x.cast("long")).alias("font_total"), total(texts, F.length).alias("chars"))


def overlay_html(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles and font sizes come from the lines in one pass; lines of the same number share their sizes, as in a join by number."""
    i = _rects(fitted(spark, sf)).filter("image_id IS NOT NULL")
    fits = F.collect_list(F.struct("font_px", "wrap")).over(W.partitionBy("image_id", "para_index", "item_index"))
    items = i.select("image_id", "para_index", "item_index", "text", "rect", fits.alias("fits"))
    items = items.select("image_id", "para_index", "item_index", "text", "rect", F.explode_outer("fits").alias("fit")).select("image_id", "para_index", "item_index", "text", "rect", "fit.*")
    pages = views.pages_of_paras(spark, sf)
    return render.render_overlay_html(para_rects(spark, sf), items, pages)


@query(
    "S8_export_overlays",
    with_views("paras", """SELECT image_id, 'page ' || image_id || '.lens_text.fr.html' AS file_name, true AS whole FROM paras WHERE para_index = 0"""),
)
def q_export_overlays(spark: SparkSession, sf: str) -> DataFrame:
    h = overlay_html(spark, sf).withColumnRenamed("html", "overlay_html")
    pages = h.join(views.pages_of_paras(spark, sf), "image_id")
    k = F.col("image_id").cast("string")
    pages = pages.select("image_id", F.concat(F.lit("page "), k, F.lit(".png")).alias("name"), "w", "h", F.lit("data:image/png;base64,AAAA").alias("background"), "overlay_html", F.lit("lens_text").alias("mode"), F.lit("fr").alias("lang"))
    d = render.standalone_pages(pages)
    return d.select("image_id", "file_name", (d.html.startswith("<!doctype html>") & F.contains(d.html, F.lit("tp-draw-scope")) & d.html.endswith("</html>\n")).alias("whole"))
