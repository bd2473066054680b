"""Registered queries: aligning translations, and strips of tall pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelayout.functions.exprs import fixed
from pagelayout.operators import align, tiles as tl
from pagelayout.plans.registry import query
from pagelayout.plans.text_queries import ANSWERS_SQL, SEGS_SQL, answers, sql_collapse
from pagelayout.sources import views
from pagelayout.sources.views import with_views

# Translated paragraphs as a list: positions are dense, every third index is unknown.
TRANS_SQL = "SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY para_index) - 1 AS pos, CASE WHEN (image_id + para_index) % 3 <> 0 THEN para_index END AS para_index, target AS text FROM segments WHERE target IS NOT NULL"


def trans_list(spark: SparkSession, sf: str) -> DataFrame:
    from pagelayout.operators.scans import ordered_scan

    s = views.segments(spark, sf).filter(F.col("target").isNotNull())
    s = ordered_scan(s, ["image_id"], ["para_index"], number="pos")
    known = (F.col("image_id") + F.col("para_index")) % 3 != 0
    return s.select("image_id", "pos", F.when(known, F.col("para_index")).alias("para_index"), F.col("target").alias("text"))


@query(
    "J4_match_translations",
    with_views(
        "segments",
        """SELECT o.image_id, o.para_index, coalesce(i.text, p.text, '') AS text, i.image_id IS NOT NULL OR p.image_id IS NOT NULL AS matched FROM segments o
  LEFT JOIN (SELECT image_id, para_index, arg_min(text, pos) AS text FROM trans WHERE para_index IS NOT NULL GROUP BY ALL) i ON i.image_id = o.image_id AND i.para_index = o.para_index
  LEFT JOIN trans p ON p.image_id = o.image_id AND p.pos = o.para_index""",
        trans=TRANS_SQL,
    ),
)
def q_match_translations(spark: SparkSession, sf: str) -> DataFrame:
    orig = views.segments(spark, sf).select("image_id", F.col("para_index").cast("long").alias("pos"), "para_index")
    return align.match_translations(orig, trans_list(spark, sf)).drop("pos")


FILLED_SQL = f"""SELECT a.image_id, CAST(a.i AS INTEGER) AS para_index, coalesce(nullif(s.segment, ''), {sql_collapse('f.text')}, '') AS segment, coalesce(s.segment, '') = '' AS filled FROM (SELECT image_id, unnest(range(expected)) AS i FROM answers) a
  LEFT JOIN (SELECT image_id, para_index, {sql_collapse('arg_min(seg, occ)')} AS segment FROM segs GROUP BY ALL) s ON s.image_id = a.image_id AND s.para_index = a.i LEFT JOIN fallback f ON f.image_id = a.image_id AND f.para_index = a.i"""
# The translated side serves where it is complete.
FALLBACK_SQL = "SELECT image_id, para_index, CASE WHEN bool_and(target IS NOT NULL) OVER (PARTITION BY image_id) THEN target ELSE source END AS text FROM segments"


def filled(spark: SparkSession, sf: str) -> DataFrame:
    s = views.segments(spark, sf)
    source = s.select("image_id", "para_index", F.col("source").alias("text"))
    target = s.filter(F.col("target").isNotNull()).select("image_id", "para_index", F.col("target").alias("text"))
    return align.fill_missing_segments(answers(spark, sf), align.fallback_paragraphs(source, target))


@query("J5_fill_missing_segments", with_views("translations segments", "SELECT * FROM filled", answers=ANSWERS_SQL, segs=SEGS_SQL, fallback=FALLBACK_SQL, filled=FILLED_SQL))
def q_fill_missing_segments(spark: SparkSession, sf: str) -> DataFrame:
    return filled(spark, sf)


@query(
    "J5_repair_meta",
    with_views("translations segments", "SELECT image_id, bool_or(filled) AS repaired, count(*) AS expected, count(*) FILTER (WHERE NOT filled) AS found, count(*) FILTER (WHERE filled) AS missing FROM filled GROUP BY 1", answers=ANSWERS_SQL, segs=SEGS_SQL, fallback=FALLBACK_SQL, filled=FILLED_SQL),
)
def q_repair_meta(spark: SparkSession, sf: str) -> DataFrame:
    return align.repair_meta(filled(spark, sf))


@query(
    "J6_missing_markers",
    with_views("translations", "SELECT image_id, CAST(i AS INTEGER) AS para_index FROM (SELECT image_id, unnest(range(expected)) AS i FROM answers WHERE regexp_matches(marked_text, '<<TP_P\\d+>>')) a ANTI JOIN segs s ON s.image_id = a.image_id AND s.para_index = a.i", answers=ANSWERS_SQL, segs=SEGS_SQL),
)
def q_missing_markers(spark: SparkSession, sf: str) -> DataFrame:
    return align.missing_markers(answers(spark, sf))


TEXTS_SQL = """SELECT image_id, para_index, CASE WHEN para_index % 5 = 4 THEN '' WHEN para_index % 3 = 0 THEN text || ' ' || text WHEN para_index % 3 = 1 THEN left(text, 50) ELSE text END AS text FROM paras"""


@query(
    "W4_allocate_words",
    with_views(
        "paras items",
        """SELECT image_id, para_index, CAST(i - 1 AS INTEGER) AS item_index, array_to_string(words[cuts[i]+1:cuts[i+1]], ' ') AS text FROM (
  SELECT *, unnest(range(1, len(lens)+1)) AS i FROM (SELECT *, list_concat([0], list_transform(range(1, len(lens)), lambda m: CAST(list_max(list_transform(range(1, m+1), lambda k: least(len(words), CAST(round_even(list_reduce(shares[1:k], lambda a, b: a + b), 0) AS BIGINT)))) AS BIGINT)), [CAST(len(words) AS BIGINT)]) AS cuts FROM (
    SELECT *, list_transform(lens, lambda x: CAST(x AS DOUBLE) / greatest(1, list_sum(lens)) * len(words)) AS shares FROM (
      SELECT t.image_id, t.para_index, l.lens, list_filter(string_split_regex(t.text, '[ \\n]+'), lambda x: x <> '') AS words FROM texts t
      JOIN (SELECT image_id, para_index, list(length(text) ORDER BY item_index) AS lens FROM items GROUP BY ALL) l USING (image_id, para_index)))))""",
        texts=TEXTS_SQL,
    ),
)
def q_allocate_words(spark: SparkSession, sf: str) -> DataFrame:
    k, t = F.col("para_index"), F.col("text")
    p = views.paras(spark, sf).withColumn("text", F.when(k % 5 == 4, "").when(k % 3 == 0, F.concat(t, F.lit(" "), t)).when(k % 3 == 1, F.left(t, F.lit(50))).otherwise(t))
    return align.translate_lines(p, views.items(spark, sf))


@query("U2_union_spans", with_views("spans", "SELECT image_id, para_index, item_index, span_index, text, 0 AS source_order FROM spans UNION ALL SELECT image_id, para_index, item_index, span_index, text || '!', 1 FROM spans"))
def q_union_spans(spark: SparkSession, sf: str) -> DataFrame:
    s = views.spans(spark, sf).select("image_id", "para_index", "item_index", "span_index", "text")
    return align.union_spans(s, s.withColumn("text", F.concat("text", F.lit("!"))))


# ---------------------------------------------------------------- strips

SHIFTED_SQL = "SELECT p.image_id, p.side, p.tile_no, p.para_index, p.text, p.l, p.t + s.y AS t, p.r, p.b + s.y AS b, p.w, p.page_h, row_number() OVER (PARTITION BY p.image_id ORDER BY p.tile_no, p.para_index) - 1 AS rid FROM tile_paras p JOIN tiles s USING (image_id, tile_no)"


def page_paras(spark: SparkSession, sf: str) -> DataFrame:
    """All strips' paragraphs in page coordinates, numbered in strip order."""
    shifted = tl.shift_tiles_to_page(views.tile_paras(spark, sf), views.tiles(spark, sf))
    return tl.union_tiles([shifted]).withColumn("rid", F.col("page_para").cast("long"))


@query(
    "F6_shift_tiles_to_page",
    with_views("tile_paras tiles", "SELECT p.image_id, p.tile_no, p.para_index, p.t + s.y AS t, p.b + s.y AS b, ((p.t/s.h)*s.h + s.y)/s.page_h AS top, ((p.b-p.t)/s.h)*s.h/s.page_h AS height FROM tile_paras p JOIN tiles s USING (image_id, tile_no)"),
)
def q_shift_tiles(spark: SparkSession, sf: str) -> DataFrame:
    p, t = views.tile_paras(spark, sf), views.tiles(spark, sf)
    p = p.join(t.select("image_id", "tile_no", "h"), ["image_id", "tile_no"])
    p = p.withColumns({"top": F.col("t") / F.col("h"), "height": (F.col("b") - F.col("t")) / F.col("h")}).drop("h")
    return tl.shift_tiles_to_page(p, t).select("image_id", "tile_no", "para_index", "t", "b", "top", "height")


@query("U1_union_tiles", with_views("tile_paras", "SELECT image_id, tile_no, para_index, CAST(row_number() OVER (PARTITION BY image_id ORDER BY tile_no, para_index) - 1 AS INTEGER) AS page_para FROM tile_paras"))
def q_union_tiles(spark: SparkSession, sf: str) -> DataFrame:
    p = views.tile_paras(spark, sf)
    odd = F.col("tile_no") % 2 == 1
    return tl.union_tiles([p.filter(odd), p.filter(~odd)]).select("image_id", "tile_no", "para_index", "page_para")


@query("W9_reindex_paragraphs", with_views("tile_paras tiles", "SELECT image_id, rid, CAST(row_number() OVER (PARTITION BY image_id ORDER BY floor(t), rid) - 1 AS INTEGER) AS para_index FROM shifted", shifted=SHIFTED_SQL))
def q_reindex_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    p = page_paras(spark, sf).withColumn("row", F.floor("t"))
    return align.reindex_paragraphs(p, ["row", "rid"]).select("image_id", "rid", "para_index")


@query(
    "J1_overlap_pairs",
    with_views(
        "tile_paras tiles",
        """SELECT image_id, a_rid, b_rid, floor(inter/(aa + ba - inter)*10000+0.5)/10000 AS iou FROM (SELECT a.image_id, a.rid AS a_rid, b.rid AS b_rid, greatest(0.0::DOUBLE, least(a.r,b.r)-greatest(a.l,b.l))*greatest(0.0::DOUBLE, least(a.b,b.b)-greatest(a.t,b.t)) AS inter, (a.r-a.l)*(a.b-a.t) AS aa, (b.r-b.l)*(b.b-b.t) AS ba
  FROM shifted a JOIN shifted b ON a.image_id = b.image_id AND a.rid < b.rid AND a.t < b.b AND b.t < a.b) WHERE inter > 0 AND inter/(aa + ba - inter) >= 0.35::DOUBLE""",
        shifted=SHIFTED_SQL,
    ),
)
def q_overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tl.overlap_pairs(page_paras(spark, sf)).select("image_id", "a_rid", "b_rid", fixed("iou").alias("iou"))


@query("J2_similar_pairs")
def q_similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tl.similar_pairs(page_paras(spark, sf))


@query(
    "J3_seam_pairs",
    with_views(
        "tile_paras tiles",
        """SELECT DISTINCT a.image_id, a.rid AS a_rid, b.rid AS b_rid FROM ranked a JOIN ranked b ON a.image_id = b.image_id AND b.pos > a.pos AND b.pos <= a.pos + 5
  JOIN (SELECT image_id, y + h AS seam FROM tiles QUALIFY tile_no < max(tile_no) OVER (PARTITION BY image_id)) s ON s.image_id = a.image_id AND a.cy < s.seam AND s.seam < b.cy
  WHERE greatest(0.0::DOUBLE, least(a.r,b.r)-greatest(a.l,b.l))/least(a.r-a.l, b.r-b.l) >= 0.5 AND b.t - a.b BETWEEN -80 AND 200""",
        shifted=SHIFTED_SQL,
        ranked="SELECT *, (t+b)/2 AS cy, row_number() OVER (PARTITION BY image_id ORDER BY (t+b)/2, rid) AS pos FROM shifted",
    ),
)
def q_seam_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tl.seam_pairs(page_paras(spark, sf), views.tiles(spark, sf)).select("image_id", "a_rid", "b_rid")


@query("O6_dedupe_paragraphs")
def q_dedupe_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return tl.dedupe_paragraphs(page_paras(spark, sf)).select("image_id", "side", "rid", "para_index", "text", "l", "t", "r", "b")


@query("O7_merge_seam_paragraphs")
def q_merge_seam_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    p = page_paras(spark, sf).select("image_id", "side", "rid", "text", "l", "t", "r", "b")
    return tl.merge_seam_paragraphs(p, views.tiles(spark, sf))


RAW_SQL = "SELECT *, dy + dx*0.35::DOUBLE + std*0.08::DOUBLE AS raw FROM row_profile"
NEAR_SQL = """SELECT *, coalesce(max(raw) OVER (PARTITION BY image_id ORDER BY y ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 0) AS up, coalesce(max(raw) OVER (PARTITION BY image_id ORDER BY y ROWS BETWEEN 1 FOLLOWING AND 60 FOLLOWING), 0) AS down FROM raws"""
SCORE_SQL = "SELECT image_id, y, raw - dark*1.5::DOUBLE + CASE WHEN raw < 6 AND up > 6 AND down > 6 THEN 15.0::DOUBLE*(1.0::DOUBLE - raw/6.0::DOUBLE) ELSE 0.0::DOUBLE END AS score FROM near"


@query("W6_row_detail_score", with_views("row_profile", "SELECT image_id, y, floor(score*10000+0.5)/10000 AS score FROM scores", raws=RAW_SQL, near=NEAR_SQL, scores=SCORE_SQL))
def q_row_detail_score(spark: SparkSession, sf: str) -> DataFrame:
    return tl.row_detail_score(views.row_profile(spark, sf)).select("image_id", "y", fixed("score").alias("score"))


@query(
    "W5_smooth_profile",
    with_views(
        "row_profile",
        """SELECT image_id, y, floor((s + greatest(0, 32 - y)*f + greatest(0, y + 32 - m)*l)/65.0::DOUBLE*10000+0.5)/10000 AS smooth FROM (SELECT image_id, y, sum(dy) OVER (PARTITION BY image_id ORDER BY y ROWS BETWEEN 32 PRECEDING AND 32 FOLLOWING) AS s FROM row_profile)
  JOIN (SELECT image_id, arg_min(dy, y) AS f, arg_max(dy, y) AS l, max(y) AS m FROM row_profile GROUP BY 1) USING (image_id)""",
    ),
)
def q_smooth_profile(spark: SparkSession, sf: str) -> DataFrame:
    return tl.smooth_profile(views.row_profile(spark, sf), "dy").select("image_id", "y", fixed("smooth").alias("smooth"))


@query("W7_choose_cuts")
def q_choose_cuts(spark: SparkSession, sf: str) -> DataFrame:
    scored = tl.row_detail_score(views.row_profile(spark, sf))
    return tl.choose_cuts(tl.smooth_profile(scored, "score"), max_h=300)
