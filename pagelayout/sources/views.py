"""Operator inputs derived from the driver's tables, written once for Spark and once as SQL.

None of the driver's tables holds text boxes, page strips or job records.  Each view below is a
deterministic formula over whole tables and whole texts; ``with_views`` puts the matching SQL in front of
an oracle statement.  Every word of a document becomes a box: twelve words to a line, four lines to a
paragraph, so pages are as tall as their text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelayout.operators.scans import ordered_scan

PAGE_W = 1200
WORDS_PER_LINE = 12
LINES_PER_PARA = 4
TILE_H = 1880
TILE_STEP = 1460

# Fixed sample messages, one per error rule; the job view assigns them round robin.
SAMPLE_ERRORS = [
    "API returned no overlay data",
    "[download] no image data",
    "AI api_key is required",
    "401 unauthorized, bad key",
    "[ai] 403 forbidden",
    "[download] HTTP 404",
    "[download] Not an image: text/html",
    "cannot identify image file",
    "[ocr] unsupported image mode",
    "[render] model m1 does not exist",
    "[ai] HTTP 429 too many requests",
    "[ai] service overloaded",
    "rest poll timed out",
    "[render] request timed out",
    "Failed to fetch",
    "[ai] blocked by policy",
    "[ocr] HTTP 500 internal",
    "insufficient balance",
    "Codex CLI usage limit reached. Try again at 5 PM.",
    "tool requires authentication in the browser",
    "Expecting value: line 1",
    "REST submit failed",
    "Something nobody has seen before went wrong in the middle of it",
    "[render] odd",
]

# Fixed request values, assigned by event number.
SAMPLE_LANGS = ["jp", "Thai", "EN", "zh_tw", "he", "xx-YY", "fr", " "]
SAMPLE_PROVIDERS = ["google", "OpenAI", "claude", "hf", "auto", "", "deepseek", "unknownp"]
SAMPLE_MODELS = ["auto", "", "flash", "GPT-4o-mini", "claude-sonnet", "custom-model", "auto", "Gemini-2.5-Flash"]
SAMPLE_MODES = ["lens_text", "lens_images", "LENS_TEXT ", "other"]
SAMPLE_SOURCES = ["translated", "original", "ai", "cli_codex", "AI"]
SAMPLE_ENGINES = ["google_lens", "paddle-ocr", "PaddleOCR", "paddle", ""]


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values: list[str], index: str) -> str:
    body = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"list_extract([{body}], CAST(({index}) % {len(values)} + 1 AS BIGINT))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _boxes_of(docs: DataFrame, *more: str) -> DataFrame:
    """Boxes of the documents' words; the documents' columns ``more`` follow."""
    ws = F.filter(F.split("text", "[ \n]+"), lambda w: w != "")
    # The inner form would split every text a second time in the filter it implies.
    words = docs.select(F.col("doc_id").alias("image_id"), *more, F.posexplode_outer(ws).alias("wi", "word")).filter(F.col("word").isNotNull())
    wi, vr = F.col("wi"), F.floor(F.col("wi") / WORDS_PER_LINE)
    w = words.withColumn("vr", vr.cast("long"))
    vr = F.col("vr")
    l = (20 + 96 * (wi % WORDS_PER_LINE)).cast("double")
    t = (20 + 26 * vr + 60 * F.floor(vr / LINES_PER_PARA) + wi % 3).cast("double")
    return w.select(
        "image_id",
        wi.cast("long").alias("box_id"),
        F.col("word").alias("text"),
        (F.lit(0.3).cast("double") + ((31 * F.col("image_id") + 7 * vr + 3 * wi) % 70).cast("double") / F.lit(100.0).cast("double")).alias("confidence"),
        l.alias("l"),
        t.alias("t"),
        (l + 8.0 * F.length("word")).alias("r"),
        (t + F.when(wi % 53 == 7, F.lit(1.0)).otherwise(F.lit(18.0))).alias("b"),
        ((wi % 7 - 3).cast("double") * 0.5).alias("angle_deg"),
        *more,
    )


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return _boxes_of(table(spark, sf, "documents").select("doc_id", "text"))


RAW_BYTES = 4 << 20  # JSON that is handed over at once


@lru_cache(1 << 14)
def _place(i: int) -> tuple[int, int, str, str, str]:
    """Where a page's word number ``i`` stands: left, bottom, and what its JSON has before, between and behind its right edge."""
    vr = i // WORDS_PER_LINE
    l, t = 20 + 96 * (i % WORDS_PER_LINE), 20 + 26 * vr + 60 * (vr // LINES_PER_PARA) + i % 3
    b = t + (1 if i % 53 == 7 else 18)
    return l, b, f"{l}.0,{t}.0", f".0,{t}.0],[", f".0,{b}.0],[{l}.0,{b}.0]],["


@lru_cache(1 << 8)
def _confidence(hundredths: int) -> str:
    return str(0.3 + hundredths / 100.0)


def _page_json(image_id: int | None, words: list[tuple[int, str]]) -> str:
    """The boxes of a page's words (number and text, in order) as recogniser JSON: even pages as named lists, odd ones as nested lines."""
    if image_id is None:  # a null confidence leaves no line
        return "[[]]"
    scores = []
    for i, _ in words:
        k = 31 * image_id + 7 * (i // WORDS_PER_LINE) + 3 * i
        scores.append(_confidence(k % 70 if k >= 0 else -(-k % 70)))
    lines = []
    if image_id % 2:
        for (i, w), score in zip(words, scores):
            l, _, corner, top, low = _place(i)
            r = l + 8 * len(w)
            lines.append(f"[[[{corner}],[{r}{top}{r}{low}{encode_basestring(w)},{score}]]")
        return f"[[{','.join(lines)}]]"
    for i, w in words:
        l, b, corner, _, _ = _place(i)
        lines.append(f"[{corner},{l + 8 * len(w)}.0,{b}.0]")
    texts = ",".join([encode_basestring(w) for _, w in words])
    return f'{{"res":{{"rec_texts":[{texts}],"rec_scores":[{",".join(scores)}],"rec_boxes":[{",".join(lines)}]}}}}'


def recogniser_json(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes of a page written out as recogniser JSON (image_id, raw); texts that share a page meet as texts, before they are boxes."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), "text")
    held = docs.groupBy("image_id").agg(F.collect_list("text").alias("texts"))
    gap = re.compile("[ \n]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raws, size = [], [], 0
            for image_id, texts in zip(batch.column("image_id").to_pylist(), batch.column("texts")):
                words = [(i, w) for t in texts.as_py() for i, w in enumerate(filter(None, gap.split(t)))]
                if not words:
                    continue
                ids.append(image_id)
                raws.append(_page_json(image_id, sorted(words) if len(texts) > 1 else words))
                size += len(raws[-1])
                if size > RAW_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("image_id").type), pa.array(raws, pa.string())], names=["image_id", "raw"])
                    ids, raws, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("image_id").type), pa.array(raws, pa.string())], names=["image_id", "raw"])

    return held.mapInArrow(run, f"image_id {docs.schema['image_id'].dataType.simpleString()}, raw string")


def sized_boxes(spark: SparkSession, sf: str, by_page: bool = False) -> DataFrame:
    """Boxes with the size of their page; texts meet the sizes, not their words, which are many times more bytes.

    ``by_page``: texts are dealt out by page, so that steps which need a page's boxes together need not move the boxes.
    """
    docs = table(spark, sf, "documents").select("doc_id", "text")
    sizes = pages_of_boxes(spark, sf).withColumnRenamed("image_id", "doc_id")
    if by_page:
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
        docs = docs.repartition(n, "doc_id")  # a number: partitions joined by the size of their texts would hold too many boxes
    return _boxes_of(docs.join(sizes, "doc_id"), "w", "h")


def pages_of_boxes(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n = F.size(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""))
    rows = F.floor((n + WORDS_PER_LINE - 1) / WORDS_PER_LINE)
    return docs.select(
        F.col("doc_id").alias("image_id"),
        F.lit(PAGE_W).alias("w"),
        (120 + 26 * rows + 60 * F.floor(rows / LINES_PER_PARA)).cast("int").alias("h"),
    )


def paras(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs with their page size; all array work stays inside the document's row."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    docs = docs.select(F.col("doc_id").alias("image_id"), F.array_remove(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), "").alias("ws"))
    per = WORDS_PER_LINE * LINES_PER_PARA
    docs = docs.filter(F.size("ws") > 0).withColumn("np", F.floor((F.size("ws") + per - 1) / per).cast("int"))
    ex = docs.select("image_id", "np", F.explode_outer(F.transform(F.sequence(F.lit(0), F.col("np") - 1), lambda k: F.struct(k.alias("k"), F.slice("ws", k * per + 1, F.lit(per)).alias("ws")))).alias("p"))
    rows = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("p.ws") - 1) / WORDS_PER_LINE).cast("int")),
        lambda i: F.array_join(F.slice(F.col("p.ws"), i * WORDS_PER_LINE + 1, F.lit(WORDS_PER_LINE)), " "),
    )
    ex = ex.select("image_id", "np", F.col("p.k").alias("k"), rows.alias("lines"))
    longest = F.array_max(F.transform("lines", F.length))
    t = (20 + 164 * F.col("k")).cast("double")
    return ex.select(
        "image_id",
        F.col("k").alias("para_index"),
        F.array_join("lines", "\n").alias("text"),
        F.lit(20.0).alias("l"),
        t.alias("t"),
        (20.0 + F.least(8 * longest, F.lit(1160))).cast("double").alias("r"),
        (t + 98.0).alias("b"),
        F.lit(PAGE_W).alias("w"),
        (164 * F.col("np") + 120).cast("int").alias("h"),
    )


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the paragraphs, each with a slightly turned box in page fractions."""
    p = paras(spark, sf).select("image_id", "para_index", "w", "h", F.col("t").alias("pt"), F.posexplode_outer(F.split("text", "\n")).alias("item_index", "text"))
    i, k = F.col("item_index"), F.col("para_index")
    wpx = F.least(8 * F.length("text"), F.lit(1160)).cast("double")
    tpx = F.col("pt") + 26.0 * i
    return p.select(
        "image_id",
        "para_index",
        "item_index",
        "text",
        "w",
        "h",
        (F.lit(20.0) / F.col("w")).alias("left"),
        (tpx / F.col("h")).alias("top"),
        (wpx / F.col("w")).alias("width"),
        (F.lit(18.0) / F.col("h")).alias("height"),
        (((k * 7 + i * 3) % 41 - 20).cast("double") * 0.75).alias("rotation_deg"),
    )


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the lines as spans; a word's number gives its paragraph, line and place, so lines need not be put together and cut again."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("image_id"), F.array_remove(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), "").alias("ws"))
    per = WORDS_PER_LINE * LINES_PER_PARA
    docs = docs.withColumn("h", (164 * F.floor((F.size("ws") + per - 1) / per).cast("int") + 120).cast("int"))
    # The inner form would split every text a second time in the filter it implies.
    words = docs.select("image_id", "h", F.posexplode_outer("ws").alias("wi", "text")).filter(F.col("text").isNotNull())
    wi = F.col("wi")
    s = words.select(
        "image_id", "h", "text", F.floor(wi / per).cast("int").alias("para_index"),
        F.floor(wi % per / WORDS_PER_LINE).cast("int").alias("item_index"), (wi % WORDS_PER_LINE).alias("span_index"),
    )
    k, i, j = (F.col(c) for c in ("para_index", "item_index", "span_index"))
    w = F.lit(PAGE_W)
    return s.select(
        "image_id",
        "para_index",
        "item_index",
        "span_index",
        "text",
        w.alias("w"),
        "h",
        ((20.0 + 96.0 * j) / w).alias("left"),
        (((20 + 164 * k).cast("double") + 26.0 * i) / F.col("h")).alias("top"),
        (8.0 * F.length("text") / w).alias("width"),
        (F.lit(18.0) / F.col("h")).alias("height"),
        (((k * 7 + i * 3) % 41 - 20).cast("double") * 0.75).alias("rotation_deg"),
    )


def pages_of_paras(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that have paragraphs, with their size; words are counted, paragraphs need not be made."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    n = F.size(F.filter(F.split("text", "[ \n]+"), lambda w: w != ""))
    # An outer explode keeps the condition from counting a second time.
    rows = docs.select(F.col("doc_id").alias("image_id"), F.explode_outer(F.array(F.floor((n + WORDS_PER_LINE * LINES_PER_PARA - 1) / (WORDS_PER_LINE * LINES_PER_PARA)))).alias("np"))
    return rows.filter("np > 0").select("image_id", F.lit(PAGE_W).alias("w"), (164 * F.col("np") + 120).cast("int").alias("h"))


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    pages = pages_of_paras(spark, sf).select("image_id", "h")
    n = F.greatest(F.lit(1), F.ceil((F.col("h") - (TILE_H - TILE_STEP)) / F.lit(TILE_STEP))).cast("int")
    ex = pages.select("image_id", F.col("h").alias("page_h"), F.explode(F.sequence(F.lit(0), n - 1)).alias("tile_no"))
    y = (F.col("tile_no") * TILE_STEP).cast("int")
    return ex.select("image_id", "tile_no", y.alias("y"), F.least(F.lit(TILE_H), F.col("page_h") - y).cast("int").alias("h"), "page_h")


def tile_paras(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs as each strip sees them: strip-relative, later copies shifted and sometimes cut."""
    p = paras(spark, sf)
    last = F.greatest(F.lit(1), F.ceil((F.col("h") - (TILE_H - TILE_STEP)) / F.lit(TILE_STEP))).cast("int") - 1
    lo = F.greatest(F.lit(0), F.ceil((F.col("t") - TILE_H + 1) / F.lit(TILE_STEP))).cast("int")
    hi = F.least(last, F.floor((F.col("b") - 1) / F.lit(TILE_STEP)).cast("int"))
    ex = p.withColumn("tile_no", F.explode(F.sequence(F.least(lo, hi), hi)))
    first = F.least(lo, hi)
    copy = F.col("tile_no") > first
    y = F.col("tile_no") * TILE_STEP
    cut = copy & (F.col("para_index") % 3 == 1)
    shift = F.when(copy, F.lit(4.0)).otherwise(F.lit(0.0))
    return ex.select(
        "image_id",
        F.lit("original").alias("side"),
        "tile_no",
        "para_index",
        F.when(cut, F.substring("text", 4, 1 << 30)).otherwise(F.col("text")).alias("text"),
        "l",
        (F.col("t") - y + shift).alias("t"),
        "r",
        (F.col("b") - y + shift).alias("b"),
        "w",
        F.col("h").alias("page_h"),
    )


def images(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("image_id"))
    k = F.col("image_id")
    return o.select("image_id", (800 + k % 700).cast("int").alias("w"), (1000 + (37 * k) % 9000).cast("int").alias("h"))


def row_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Row statistics of page pictures: the supplier is the picture, its line items in order its rows."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    d = ordered_scan(li, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], number="y")
    return d.select(
        F.col("l_suppkey").alias("image_id"),
        F.col("y").cast("long").alias("y"),
        F.col("l_quantity").alias("dy"),
        (F.lit(100.0) * F.col("l_discount")).alias("dx"),
        (F.lit(100.0) * F.col("l_tax")).alias("std"),
        F.col("l_discount").alias("dark"),
    )


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Source paragraph and its translation; every fifth translation is missing."""
    c = table(spark, sf, "conversations")
    users = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("source"))
    nxt = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    numbered = ordered_scan(users, ["conv_id"], ["turn"], number="para_index")
    j = numbered.join(nxt, ["conv_id", "turn"], "left")
    gone = (F.col("conv_id") + F.col("para_index")) % 5 == 0
    return j.select(
        F.col("conv_id").alias("image_id"),
        F.col("para_index").cast("int").alias("para_index"),
        "source",
        F.when(~gone, F.col("target")).alias("target"),
    )


def translations(spark: SparkSession, sf: str) -> DataFrame:
    """One marked answer per conversation: the markers whose translation exists, in order."""
    s = segments(spark, sf)
    part = F.concat(F.lit("<<TP_P"), F.col("para_index").cast("string"), F.lit(">>\n"), F.col("target"))
    rows = F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("para_index", part.alias("part")))))
    return s.groupBy("image_id").agg(
        F.array_join(F.transform(rows, lambda x: x["part"]), "\n\n").alias("marked_text"),
        F.count(F.lit(1)).cast("int").alias("expected"),
    )


STATUS_OF = {"signup": "queued", "view": "running", "click": "inserting", "purchase": "done", "error": "error"}


def job_events_from(e: DataFrame) -> DataFrame:
    eid, uid, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    status = F.coalesce(*[F.when(et == k, F.lit(v)) for k, v in STATUS_OF.items()], et)
    stage = F.when(et == "view", F.when(eid % 2 == 0, "lens_ocr").otherwise("ai")).otherwise(status)
    return e.select(
        "event_id",
        F.concat(F.lit("j"), uid.cast("string")).alias("job_id"),
        "ts",
        status.alias("status"),
        stage.alias("stage"),
        F.when(uid % 2 == 1, "ai").otherwise("direct").alias("queue_kind"),
        F.date_format("ts", "yyyy-MM-dd").alias("batch_id"),
        F.concat_ws("-", uid.cast("string"), (eid % 5).cast("string")).alias("image_key"),
        F.when(eid % 4 == 0, 2).otherwise(1).alias("attempt"),
        F.when(et == "error", pick(SAMPLE_ERRORS, eid)).alias("message"),
        F.concat(F.lit("tp:"), uid.cast("string"), F.lit("-"), F.hour("ts").cast("string")).alias("idempotency_key"),
    )


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    return job_events_from(table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type"))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    eid = F.col("event_id")
    return e.select(
        eid.alias("request_id"),
        "ts",
        pick(SAMPLE_MODES, eid).alias("mode"),
        pick(SAMPLE_LANGS, F.floor(eid / 2)).alias("lang"),
        pick(SAMPLE_SOURCES, eid).alias("source"),
        pick(SAMPLE_ENGINES, F.floor(eid / 3)).alias("ocr_engine"),
        pick(SAMPLE_PROVIDERS, eid).alias("provider"),
        pick(SAMPLE_MODELS, F.floor(eid / 5)).alias("model"),
        pick(["auto", "http://localhost:8080/", ""], eid).alias("base_url"),
        F.col("user_id").alias("tab_id"),
        F.concat(F.lit("h"), (eid % 97).cast("string")).alias("img_hash"),
        F.concat(F.lit("https://img.example.com/p/"), (eid % 211).cast("string"), F.lit(".png")).alias("src"),
    )


def page_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url", "html")
    hrefs = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), 1)
    return p.select("page_id", "url", F.posexplode_outer(hrefs).alias("pos", "href")).filter(F.col("href").isNotNull())


VIEW_SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "wordlists": (
        "SELECT doc_id AS image_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS ws FROM documents",
        (),
    ),
    "words": (
        "SELECT image_id, unnest(ws) AS word, CAST(unnest(range(len(ws))) AS BIGINT) AS wi FROM wordlists",
        ("wordlists",),
    ),
    "boxes": (
        """SELECT image_id, wi AS box_id, word AS text, 0.3::DOUBLE + CAST((31*image_id + 7*(wi//12) + 3*wi) % 70 AS DOUBLE)/100.0::DOUBLE AS confidence,
  CAST(20+96*(wi % 12) AS DOUBLE) AS l, CAST(20+26*(wi//12)+60*(wi//48)+wi % 3 AS DOUBLE) AS t,
  CAST(20+96*(wi % 12)+8*length(word) AS DOUBLE) AS r,
  CAST(20+26*(wi//12)+60*(wi//48)+wi % 3 + CASE WHEN wi % 53 = 7 THEN 1 ELSE 18 END AS DOUBLE) AS b,
  CAST(wi % 7 - 3 AS DOUBLE)*0.5::DOUBLE AS angle_deg, wi//12 AS vr FROM words""",
        ("words",),
    ),
    "page_dims": (
        "SELECT image_id, 1200 AS w, CAST(120 + 26*((len(ws)+11)//12) + 60*((len(ws)+11)//48) AS INTEGER) AS h FROM wordlists",
        ("wordlists",),
    ),
    "para_lines": (
        """SELECT image_id, CAST(wi//48 AS INTEGER) AS para_index, CAST((wi//12) % 4 AS INTEGER) AS item_index, string_agg(word, ' ' ORDER BY wi) AS text
  FROM words GROUP BY ALL""",
        ("words",),
    ),
    "paras": (
        """SELECT image_id, para_index, text, 20.0::DOUBLE AS l, CAST(20+164*para_index AS DOUBLE) AS t, CAST(20+least(8*longest,1160) AS DOUBLE) AS r,
  CAST(118+164*para_index AS DOUBLE) AS b, 1200 AS w, CAST(164*(1+max(para_index) OVER (PARTITION BY image_id))+120 AS INTEGER) AS h
  FROM (SELECT image_id, para_index, string_agg(text, chr(10) ORDER BY item_index) AS text, max(length(text)) AS longest FROM para_lines GROUP BY ALL)""",
        ("para_lines",),
    ),
    "items": (
        """SELECT i.image_id, i.para_index, i.item_index, i.text, p.w, p.h, 20.0::DOUBLE/p.w AS "left", (p.t + 26.0::DOUBLE*i.item_index)/p.h AS top,
  CAST(least(8*length(i.text),1160) AS DOUBLE)/p.w AS width, 18.0::DOUBLE/p.h AS height,
  CAST((i.para_index*7 + i.item_index*3) % 41 - 20 AS DOUBLE)*0.75::DOUBLE AS rotation_deg
  FROM para_lines i JOIN paras p USING (image_id, para_index)""",
        ("para_lines", "paras"),
    ),
    "spans": (
        """SELECT image_id, para_index, item_index, span_index, word AS text, w, h, (20.0::DOUBLE + 96.0::DOUBLE*span_index)/w AS "left", top,
  8.0::DOUBLE*length(word)/w AS width, height, rotation_deg
  FROM (SELECT image_id, para_index, item_index, w, h, top, height, rotation_deg, unnest(string_split(text,' ')) AS word,
        CAST(unnest(range(len(string_split(text,' ')))) AS INTEGER) AS span_index FROM items)""",
        ("items",),
    ),
    "tiles": (
        """SELECT image_id, CAST(tile_no AS INTEGER) AS tile_no, CAST(tile_no*1460 AS INTEGER) AS y, CAST(least(1880, page_h - tile_no*1460) AS INTEGER) AS h, page_h
  FROM (SELECT image_id, h AS page_h, unnest(range(greatest(1, CAST(ceil((h-420)/1460.0) AS BIGINT)))) AS tile_no FROM paras WHERE para_index = 0)""",
        ("paras",),
    ),
    "tile_paras": (
        """SELECT image_id, 'original' AS side, tile_no, para_index,
  CASE WHEN tile_no > first_no AND para_index % 3 = 1 THEN substr(text, 4) ELSE text END AS text, l,
  t - y + CASE WHEN tile_no > first_no THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS t, r, b - y + CASE WHEN tile_no > first_no THEN 4.0::DOUBLE ELSE 0.0::DOUBLE END AS b, w, page_h
  FROM (SELECT p.image_id, p.para_index, p.text, p.l, p.t, p.r, p.b, p.w, p.h AS page_h, s.tile_no, s.y, min(s.tile_no) OVER (PARTITION BY p.image_id, p.para_index) AS first_no
        FROM paras p JOIN tiles s ON s.image_id = p.image_id AND p.t < s.y + 1880 AND p.b > s.y)""",
        ("paras", "tiles"),
    ),
    "images": (
        "SELECT o_orderkey AS image_id, CAST(800 + o_orderkey % 700 AS INTEGER) AS w, CAST(1000 + (37*o_orderkey) % 9000 AS INTEGER) AS h FROM orders",
        (),
    ),
    "row_profile": (
        """SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS y,
  l_quantity AS dy, 100.0::DOUBLE*l_discount AS dx, 100.0::DOUBLE*l_tax AS std, l_discount AS dark FROM lineitem""",
        (),
    ),
    "segments": (
        """SELECT conv_id AS image_id, CAST(para_index AS INTEGER) AS para_index, source, CASE WHEN (conv_id + para_index) % 5 <> 0 THEN target END AS target
  FROM (SELECT u.conv_id, u.text AS source, a.text AS target, row_number() OVER (PARTITION BY u.conv_id ORDER BY u.turn) - 1 AS para_index
        FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user')""",
        (),
    ),
    "translations": (
        """SELECT image_id, coalesce(string_agg('<<TP_P' || para_index || '>>' || chr(10) || target, chr(10) || chr(10) ORDER BY para_index) FILTER (WHERE target IS NOT NULL), '') AS marked_text,
  CAST(count(*) AS INTEGER) AS expected FROM segments GROUP BY image_id""",
        ("segments",),
    ),
    "job_events": (
        f"""SELECT event_id, 'j' || user_id AS job_id, ts,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'inserting' WHEN 'purchase' THEN 'done' ELSE event_type END AS status,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN CASE WHEN event_id % 2 = 0 THEN 'lens_ocr' ELSE 'ai' END WHEN 'click' THEN 'inserting' WHEN 'purchase' THEN 'done' ELSE event_type END AS stage,
  CASE WHEN user_id % 2 = 1 THEN 'ai' ELSE 'direct' END AS queue_kind, strftime(ts, '%Y-%m-%d') AS batch_id, user_id || '-' || (event_id % 5) AS image_key,
  CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS attempt, CASE WHEN event_type = 'error' THEN {sql_pick(SAMPLE_ERRORS, "event_id")} END AS message,
  'tp:' || user_id || '-' || hour(ts) AS idempotency_key FROM events""",
        (),
    ),
    "requests": (
        f"""SELECT event_id AS request_id, ts, {sql_pick(SAMPLE_MODES, "event_id")} AS mode, {sql_pick(SAMPLE_LANGS, "event_id//2")} AS lang,
  {sql_pick(SAMPLE_SOURCES, "event_id")} AS source, {sql_pick(SAMPLE_ENGINES, "event_id//3")} AS ocr_engine, {sql_pick(SAMPLE_PROVIDERS, "event_id")} AS provider,
  {sql_pick(SAMPLE_MODELS, "event_id//5")} AS model, {sql_pick(["auto", "http://localhost:8080/", ""], "event_id")} AS base_url, user_id AS tab_id,
  'h' || (event_id % 97) AS img_hash, 'https://img.example.com/p/' || (event_id % 211) || '.png' AS src FROM events""",
        (),
    ),
    "page_links": (
        """SELECT page_id, url, unnest(hrefs) AS href, CAST(unnest(range(len(hrefs))) AS INTEGER) AS pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM pages)""",
        (),
    ),
}


def with_views(names: str, body: str, **more: str) -> str:
    """Oracle SQL: the named views (and what they need) as common table expressions, then ``body``."""
    order: list[str] = []

    def need(name: str) -> None:
        if name in order:
            return
        for dep in VIEW_SQL[name][1]:
            need(dep)
        order.append(name)

    for n in names.split():
        need(n)
    # Views feed several readers; keep the engine from recomputing them for each.
    ctes = [f"{n} AS MATERIALIZED (\n{VIEW_SQL[n][0]}\n)" for n in order]
    ctes += [f"{n} AS (\n{sql}\n)" for n, sql in more.items()]
    return "WITH " + ",\n".join(ctes) + "\n" + body


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "boxes": boxes,
    "page_dims": pages_of_boxes,
    "paras": paras,
    "items": items,
    "spans": spans,
    "tiles": tiles,
    "tile_paras": tile_paras,
    "images": images,
    "row_profile": row_profile,
    "segments": segments,
    "translations": translations,
    "job_events": job_events,
    "requests": requests,
    "page_links": page_links,
}
