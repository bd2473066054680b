"""Registered queries: boxes, lines, paragraphs, page text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelayout.functions.exprs import fixed, steady
from pagelayout.operators import layout
from pagelayout.operators.scans import SAMPLE
from pagelayout.plans.registry import query
from pagelayout.sources import views
from pagelayout.sources.views import with_views

FILTERED = """SELECT b.image_id, b.box_id, b.text, b.confidence, b.angle_deg, b.vr, d.w, d.h, greatest(0.0::DOUBLE, least(b.l, d.w)) AS l, greatest(0.0::DOUBLE, least(b.t, d.h)) AS t,
  greatest(0.0::DOUBLE, least(b.r, d.w)) AS r, greatest(0.0::DOUBLE, least(b.b, d.h)) AS b
  FROM boxes b JOIN page_dims d USING (image_id) WHERE b.confidence >= 0.35::DOUBLE
  AND greatest(0.0::DOUBLE, least(b.r, d.w)) - greatest(0.0::DOUBLE, least(b.l, d.w)) >= 2 AND greatest(0.0::DOUBLE, least(b.b, d.h)) - greatest(0.0::DOUBLE, least(b.t, d.h)) >= 2"""
# By construction the boxes of one text row form one line.
NUMBERED = """SELECT *, dense_rank() OVER (PARTITION BY image_id ORDER BY vr) - 1 AS line_no FROM filtered"""
LINES = """SELECT image_id, line_no, w, h, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b, avg(angle_deg) AS angle_deg, string_agg(text, ' ' ORDER BY l, box_id) AS text, count(*) AS n_boxes
  FROM numbered GROUP BY image_id, line_no, w, h"""
LAGGED = """SELECT *, lag(l) OVER p AS pl, lag(r) OVER p AS pr, lag(b) OVER p AS pb FROM lines WINDOW p AS (PARTITION BY image_id ORDER BY line_no)"""
FLAGGED = """SELECT *, CASE WHEN pl IS NULL OR NOT (t - pb <= greatest(1.0::DOUBLE, b-t)*0.95::DOUBLE
  AND greatest(0.0::DOUBLE, least(r,pr)-greatest(l,pl)) / greatest(1.0::DOUBLE, least(r-l, pr-pl)) >= 0.2::DOUBLE) THEN 1 ELSE 0 END AS fresh FROM lagged"""
PLACED = """SELECT *, CAST(sum(fresh) OVER (PARTITION BY image_id ORDER BY line_no) - 1 AS INTEGER) AS para_index FROM flagged"""
INDEXED = """SELECT *, CAST(row_number() OVER (PARTITION BY image_id, para_index ORDER BY line_no) - 1 AS INTEGER) AS item_index,
  CAST(coalesce(sum(length(text)+2) OVER (PARTITION BY image_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS start_raw FROM placed"""
STEPS = {"filtered": FILTERED, "numbered": NUMBERED, "lines": LINES, "lagged": LAGGED, "flagged": FLAGGED, "placed": PLACED, "indexed": INDEXED}


def sql_upto(last: str, body: str, views_needed: str = "boxes page_dims", **more: str) -> str:
    steps: dict[str, str] = {}
    for name, text in STEPS.items():
        steps[name] = text
        if name == last:
            break
    return with_views(views_needed, body, **steps, **more)


def filtered(spark: SparkSession, sf: str, by_page: bool = False) -> DataFrame:
    return layout.filter_boxes(views.sized_boxes(spark, sf, by_page))


def bare_boxes(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Line numbers come from the geometry alone: Arrow stages pass all columns on, so text that nobody asks for is left out before them."""
    return filtered(spark, sf, by_page=True).select("image_id", "box_id", "l", "t", "b", *more)


def page_lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.layout_from_boxes(filtered(spark, sf, by_page=True).drop("confidence", "w", "h"))


@query("F1_filter_boxes", sql_upto("filtered", "SELECT image_id, box_id, l, t, r, b FROM filtered"))
def q_filter_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return filtered(spark, sf).select("image_id", "box_id", "l", "t", "r", "b")


@query("W1_group_lines", sql_upto("numbered", "SELECT image_id, box_id, line_no FROM numbered"))
def q_group_lines(spark: SparkSession, sf: str) -> DataFrame:
    return layout.group_lines(bare_boxes(spark, sf)).select("image_id", "box_id", "line_no")


@query("O1_reading_order", sql_upto("numbered", "SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY line_no, l, box_id) - 1 AS position FROM numbered"))
def q_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    boxes = bare_boxes(spark, sf)
    large = layout.large_pages(boxes)
    return layout.reading_order(layout.group_lines(boxes, large), None if large is None else SAMPLE).select("image_id", "box_id", "position")


@query("A4_line_angle", sql_upto("lines", "SELECT image_id, line_no, floor(angle_deg*10000+0.5)/10000 AS angle_deg FROM lines"))
def q_line_angle(spark: SparkSession, sf: str) -> DataFrame:
    return layout.line_angle(layout.group_lines(bare_boxes(spark, sf, "angle_deg"))).withColumn("angle_deg", fixed("angle_deg"))


@query("W2_group_paragraphs", sql_upto("indexed", "SELECT image_id, line_no, para_index, item_index FROM indexed"))
def q_group_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return page_lines(spark, sf).select("image_id", "line_no", "para_index", "item_index")


@query("W3_text_offsets", sql_upto("indexed", "SELECT image_id, line_no, start_raw, CAST(start_raw + length(text) AS INTEGER) AS end_raw FROM indexed"))
def q_text_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return page_lines(spark, sf).select("image_id", "line_no", "start_raw", "end_raw")


@query(
    "A11_page_text",
    sql_upto("indexed", "SELECT image_id, string_agg(ptext, chr(10) || chr(10) ORDER BY para_index) AS page_text, count(*) AS n_paras FROM (SELECT image_id, para_index, string_agg(text, chr(10) ORDER BY line_no) AS ptext FROM indexed GROUP BY ALL) GROUP BY image_id"),
)
def q_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return layout.page_text(layout.paragraph_table(page_lines(spark, sf)))


def page_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: one row per page with its lines, paragraphs, characters and average confidence."""
    lines = layout.layout_from_boxes(filtered(spark, sf, by_page=True).drop("w", "h"), ["confidence"])
    return lines.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        (F.max("para_index") + 1).cast("long").alias("n_paragraphs"),
        F.sum(F.length("text")).alias("n_chars"),
        steady(F.sum("confidence") / F.sum("n_boxes")).alias("avg_confidence"),
        F.sum("n_boxes").alias("n_boxes"),
    )


query(
    "page_summary",
    sql_upto(
        "indexed",
        """SELECT l.image_id, n_lines, n_paragraphs, n_chars, avg_confidence, n_boxes FROM
  (SELECT image_id, count(*) AS n_lines, CAST(max(para_index)+1 AS BIGINT) AS n_paragraphs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM indexed GROUP BY 1) l
  JOIN (SELECT image_id, floor(floor((avg(confidence))*1000000000.0::DOUBLE+0.5)/1000000000.0::DOUBLE*10000+0.5)/10000 AS avg_confidence, count(*) AS n_boxes FROM filtered GROUP BY 1) c USING (image_id)""",
    ),
)(page_summary)


@query(
    "F5_normalize_box",
    sql_upto(
        "filtered",
        """SELECT image_id, box_id, l/w AS "left", t/h AS top, greatest(1.0::DOUBLE, r-l)/w AS width, greatest(1.0::DOUBLE, b-t)/h AS height, angle_deg AS rotation_deg,
  (l + greatest(1.0::DOUBLE, r-l)/2.0::DOUBLE)/w AS cx, (t + greatest(1.0::DOUBLE, b-t)/2.0::DOUBLE)/h AS cy FROM filtered""",
    ),
)
def q_normalize_box(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    node = layout.normalize_box(c("l"), c("t"), c("r"), c("b"), c("w"), c("h"), c("angle_deg")).alias("n")
    d = filtered(spark, sf).select("image_id", "box_id", node)
    return d.select("image_id", "box_id", "n.left", "n.top", "n.width", "n.height", "n.rotation_deg", c("n.center.x").alias("cx"), c("n.center.y").alias("cy"))


@query(
    "F2_resize_plan",
    with_views(
        "images",
        """SELECT image_id, CAST(CASE WHEN big THEN greatest(1.0::DOUBLE, round_even(w*ratio, 0)) ELSE w END AS INTEGER) AS ocr_w,
  CAST(CASE WHEN big THEN greatest(1.0::DOUBLE, round_even(h*ratio, 0)) ELSE h END AS INTEGER) AS ocr_h, big AS resized,
  CASE WHEN big THEN w / greatest(1.0::DOUBLE, round_even(w*ratio, 0)) ELSE 1.0::DOUBLE END AS scale_x, CASE WHEN big THEN h / greatest(1.0::DOUBLE, round_even(h*ratio, 0)) ELSE 1.0::DOUBLE END AS scale_y
  FROM (SELECT *, greatest(w,h) > 2600 AS big, 2600.0::DOUBLE/greatest(w,h) AS ratio FROM images)""",
    ),
)
def q_resize_plan(spark: SparkSession, sf: str) -> DataFrame:
    return layout.resize_plan(views.images(spark, sf), 2600).select("image_id", "ocr_w", "ocr_h", "resized", "scale_x", "scale_y")


def boxes_with_poly(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes with a slanted polygon; every fifth box has none."""
    b = views.boxes(spark, sf)
    lean = (F.col("box_id") % 11 - 5).cast("double")

    def pt(x: str, y: str, dy: float) -> F.Column:
        return F.struct(F.col(x).alias("x"), (F.col(y) + lean * dy).alias("y"))

    poly = F.array(pt("l", "t", 0.0), pt("r", "t", 3.0), pt("r", "b", 3.0), pt("l", "b", 0.0))
    none = F.col("box_id") % 5 == 0
    return b.withColumn("poly", F.when(~none, poly).otherwise(F.slice(poly, 1, 0)))


@query(
    "F3_scale_boxes",
    with_views(
        "boxes",
        """SELECT image_id, box_id, l*1.5::DOUBLE AS l, t*0.75::DOUBLE AS t, r*1.5::DOUBLE AS r, b*0.75::DOUBLE AS b,
  floor(CASE WHEN box_id % 5 = 0 THEN angle_deg ELSE degrees(atan2((t + (box_id % 11 - 5)*3.0::DOUBLE)*0.75::DOUBLE - t*0.75::DOUBLE, r*1.5::DOUBLE - l*1.5::DOUBLE)) END * 10000 + 0.5)/10000 AS angle_deg FROM boxes""",
    ),
)
def q_scale_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = boxes_with_poly(spark, sf).withColumns({"scale_x": F.lit(1.5), "scale_y": F.lit(0.75)})
    return layout.scale_boxes(b).select("image_id", "box_id", "l", "t", "r", "b", fixed("angle_deg").alias("angle_deg"))


@query(
    "F4_poly_angle",
    with_views(
        "boxes",
        """SELECT image_id, box_id, floor(CASE WHEN a < -90 THEN a + 180 WHEN a > 90 THEN a - 180 ELSE a END * 10000 + 0.5)/10000 AS angle FROM
  (SELECT image_id, box_id, degrees(atan2(CAST((box_id*7) % 23 - 11 AS DOUBLE), CAST((box_id*5) % 19 - 9 AS DOUBLE))) AS a FROM boxes)""",
    ),
)
def q_poly_angle(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("box_id")
    origin = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    tip = F.struct(((i * 5) % 19 - 9).cast("double").alias("x"), ((i * 7) % 23 - 11).cast("double").alias("y"))
    return views.boxes(spark, sf).select("image_id", "box_id", fixed(layout.poly_angle(F.array(origin, tip))).alias("angle"))


@query(
    "A1_layout_stats",
    with_views(
        "paras items spans",
        """SELECT image_id, 'original' AS side, paras, items, spans FROM (SELECT image_id, count(*) AS paras FROM paras GROUP BY 1)
  JOIN (SELECT image_id, count(*) AS items FROM items GROUP BY 1) USING (image_id) JOIN (SELECT image_id, count(*) AS spans FROM spans GROUP BY 1) USING (image_id)""",
    ),
)
def q_layout_stats(spark: SparkSession, sf: str) -> DataFrame:
    p, i, s = (v(spark, sf).withColumn("side", F.lit("original")) for v in (views.paras, views.items, views.spans))
    return layout.layout_stats(p, i, s)


@query(
    "A12_pick_template",
    with_views(
        "paras items spans",
        """SELECT image_id, original_score, translated_score, CASE WHEN original_score < 0 AND translated_score < 0 THEN NULL WHEN original_score > translated_score THEN 'original' ELSE 'translated' END AS template
  FROM (SELECT p.image_id, n_i*10000 + n_p*100 + n_s AS original_score, CASE WHEN p.image_id % 4 = 0 THEN n_i*10000 + n_p*100 + n_s WHEN p.image_id % 4 = 1 THEN -1 ELSE n_p*100 END AS translated_score
  FROM (SELECT image_id, count(*) AS n_p FROM paras GROUP BY 1) p JOIN (SELECT image_id, count(*) AS n_i FROM items GROUP BY 1) i USING (image_id) JOIN (SELECT image_id, count(*) AS n_s FROM spans GROUP BY 1) s USING (image_id))""",
    ),
)
def q_pick_template(spark: SparkSession, sf: str) -> DataFrame:
    p, i, s = (v(spark, sf).withColumn("side", F.lit("original")) for v in (views.paras, views.items, views.spans))
    k = F.col("image_id") % 4
    tr = F.lit("translated")
    p2 = p.unionByName(p.filter(k != 1).withColumn("side", tr))
    i2 = i.unionByName(i.filter(k == 0).withColumn("side", tr))
    s2 = s.unionByName(s.filter(k == 0).withColumn("side", tr))
    return layout.pick_template(layout.layout_stats(p2, i2, s2))


@query(
    "A2_paragraph_bounds",
    with_views(
        "paras items spans",
        """SELECT p.image_id, p.para_index, floor(CASE WHEN p.para_index % 2 = 1 THEN p.l ELSE u.l END*1000+0.5)/1000 AS l, floor(CASE WHEN p.para_index % 2 = 1 THEN p.t ELSE u.t END*1000+0.5)/1000 AS t,
  floor(CASE WHEN p.para_index % 2 = 1 THEN p.r ELSE u.r END*1000+0.5)/1000 AS r, floor(CASE WHEN p.para_index % 2 = 1 THEN p.b ELSE u.b END*1000+0.5)/1000 AS b
  FROM paras p LEFT JOIN (SELECT image_id, para_index, min("left"*w) AS l, min(top*h) AS t, max("left"*w + width*w) AS r, max(top*h + height*h) AS b FROM
  (SELECT image_id, para_index, "left", top, width, height, w, h FROM items UNION ALL SELECT image_id, para_index, "left", top, width, height, w, h FROM spans) GROUP BY 1,2) u USING (image_id, para_index)""",
    ),
)
def q_paragraph_bounds(spark: SparkSession, sf: str) -> DataFrame:
    p = views.paras(spark, sf).withColumn("r", F.when(F.col("para_index") % 2 == 1, F.col("r")).otherwise(F.col("l")))
    out = layout.paragraph_bounds(p.select("image_id", "para_index", "l", "t", "r", "b"), views.items(spark, sf), views.spans(spark, sf))
    return out.select("image_id", "para_index", *[fixed(c, 3).alias(c) for c in "ltrb"])


@query(
    "A6_ocr_quality",
    with_views(
        "boxes",
        """SELECT image_id, count(*) AS tiles, CAST(sum(raw_boxes) AS BIGINT) AS raw_boxes, CAST(sum(boxes) AS BIGINT) AS boxes, CAST(sum(paragraphs) AS BIGINT) AS paragraphs,
  CASE WHEN sum(boxes) > 0 THEN floor(floor((sum(avg_confidence*boxes)/sum(boxes))*1000000000.0::DOUBLE+0.5)/1000000000.0::DOUBLE*10000+0.5)/10000 ELSE 0.0::DOUBLE END AS avg_confidence, coalesce(first(lang ORDER BY tile_no) FILTER (WHERE lang IS NOT NULL), '') AS lang,
  CAST(count(*) FILTER (WHERE tile_no % 2 = 1) AS BIGINT) AS resized_tiles FROM (SELECT m.*, CASE WHEN tile_no % 3 <> 0 THEN d.lang END AS lang FROM
  (SELECT image_id, CAST(floor(t/1460) AS INTEGER) AS tile_no, count(*) AS raw_boxes, count(*) FILTER (WHERE confidence >= 0.35::DOUBLE) AS boxes, count(DISTINCT vr//4) AS paragraphs,
  coalesce(floor(floor((avg(confidence) FILTER (WHERE confidence >= 0.35::DOUBLE))*1000000000.0::DOUBLE+0.5)/1000000000.0::DOUBLE*10000+0.5)/10000, 0) AS avg_confidence FROM boxes GROUP BY 1,2) m JOIN documents d ON d.doc_id = m.image_id) GROUP BY image_id""",
    ),
)
def q_ocr_quality(spark: SparkSession, sf: str) -> DataFrame:
    keep = F.col("confidence") >= 0.35
    b = views.boxes(spark, sf).withColumn("tile_no", F.floor(F.col("t") / 1460).cast("int"))
    metas = b.groupBy("image_id", "tile_no").agg(
        F.count(F.lit(1)).alias("raw_boxes"),
        F.count_if(keep).alias("boxes"),
        F.count_distinct(F.floor(F.col("box_id") / 48)).alias("paragraphs"),
        F.coalesce(steady(F.avg(F.when(keep, F.col("confidence")))), F.lit(0.0)).alias("avg_confidence"),
    )
    docs = views.table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), "lang")
    metas = metas.join(docs, "image_id").withColumns({
        "lang": F.when(F.col("tile_no") % 3 != 0, F.col("lang")),
        "resized": F.col("tile_no") % 2 == 1,
    })
    return layout.ocr_quality(metas)
