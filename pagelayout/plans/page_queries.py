"""Registered queries: page harvesting, URL forms, dimensions, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelayout.functions import keys as ky
from pagelayout.functions.exprs import fixed
from pagelayout.operators import dims, pages as pg
from pagelayout.operators.jobs import micros
from pagelayout.plans.registry import query
from pagelayout.plans.text_queries import sql_prompt
from pagelayout.sources import images as im
from pagelayout.sources import views
from pagelayout.sources.views import sql_pick, with_views

RESOLVED = """CASE WHEN href = '' THEN '' ELSE regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*:)', 1) || href
  WHEN starts_with(href, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || href WHEN starts_with(href, '#') THEN url WHEN starts_with(href, '?') THEN regexp_replace(url, '[?#].*$', '') || href
  ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || href END, '#.*$', '') END"""
LINKS = f"SELECT page_id, pos, trim(href) AS raw, {RESOLVED} AS url FROM (SELECT page_id, url, pos, trim(href) AS href FROM page_links)"


@query("S6_extract_page_images", with_views("page_links", "SELECT page_id, url, min(pos) AS pos FROM links WHERE url <> '' GROUP BY page_id, url", links=LINKS))
def q_extract_page_images(spark: SparkSession, sf: str) -> DataFrame:
    return pg.extract_page_images(views.table(spark, sf, "pages"), "a", ["href"]).select("page_id", "url", "pos")


@query(
    "T15_normalize_url",
    with_views(
        "page_links",
        """SELECT l.page_id, l.pos, l.url AS page_form, CASE WHEN regexp_matches(l.raw, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN regexp_replace(l.raw, '#.*$', '') ELSE l.raw END AS image_form,
  regexp_replace(regexp_replace(CASE WHEN regexp_matches(p.url, '(?i)^https?://') THEN p.url ELSE 'http://' || p.url END, '/+$', ''), '^(https?)://[^/:?#]*', '\\1://127.0.0.1') AS api_form FROM links l JOIN pages p USING (page_id)""",
        links=LINKS,
    ),
)
def q_normalize_url(spark: SparkSession, sf: str) -> DataFrame:
    p = views.page_links(spark, sf)
    local = F.regexp_replace("url", r"^(https?)://[^/:?#]*", "$1://localhost")
    return p.select("page_id", "pos", ky.page_url("href", "url").alias("page_form"), ky.image_url("href").alias("image_form"), ky.api_url(F.concat(local, F.lit("//"))).alias("api_form"))


_URLS = ["/data/h1/a.png", "/x/data-saver/h2/b.png?q=1", "/data/h3", "/data/h4/data/h5/c.png#f", "/chapter/0a1b2c3d-9/7", "/data/u/v/data/w", "/plain/1.png"]
_U = f"'https://up.example.org' || {sql_pick(_URLS, 'event_id')}"


@query(
    "T16_chapter_key",
    f"""SELECT event_id, list_extract(['md:data/h1/a.png','md:data-saver/h2/b.png','','md:data/h5/c.png','','',''], CAST(event_id % 7 + 1 AS BIGINT)) AS page_key, list_extract(['md:data/h1/a.png','md:data-saver/h2/b.png',NULL,'md:data/h5/c.png',NULL,'md:data/u/v',NULL], CAST(event_id % 7 + 1 AS BIGINT)) AS back_key,
  CASE WHEN event_id % 7 = 4 THEN '0a1b2c3d-9' ELSE '' END AS chapter, true AS host_ok FROM (SELECT event_id, {_U} AS u FROM events)""",
)
def q_chapter_key(spark: SparkSession, sf: str) -> DataFrame:
    u = F.concat(F.lit("https://up.example.org"), views.pick(_URLS, F.col("event_id")))
    e = views.table(spark, sf, "events").select("event_id", u.alias("u"))
    return e.select("event_id", ky.chapter_key_page("u").alias("page_key"), ky.chapter_key("u").alias("back_key"), ky.chapter_id("u").alias("chapter"), ky.host_matches("u", "example.org").alias("host_ok"))


@query(
    "T17_page_index",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 6 WHEN 1 THEN page_id % 9 ELSE (SELECT CASE WHEN n IS NOT NULL THEN greatest(0, n - 1) END FROM (SELECT CAST(nullif(regexp_extract(url, '^[^?#]*\\?(?:[^#]*&)?page=(\\d+)(?:&|#|$)', 1), '') AS BIGINT) AS n)) END AS idx, CASE page_id % 3 WHEN 0 THEN 4 WHEN 1 THEN page_id ELSE NULL END AS image_idx FROM pages""",
)
def q_page_index(spark: SparkSession, sf: str) -> DataFrame:
    k, u = F.col("page_id"), F.col("url")
    bare = F.regexp_replace(u, "[?#].*$", "")
    url = F.when(k % 4 == 0, F.concat(bare, F.lit("/chapter/ab/7"))).when(k % 4 == 1, F.concat(bare, F.lit("#x&page="), (k % 9 + 1).cast("string"))).otherwise(u)
    none = F.lit(None).cast("string")
    alt = F.when(k % 3 == 0, "Shot 5 / 20")
    tag = F.when(k % 3 == 1, (k + 1).cast("string"))
    return views.table(spark, sf, "pages").select("page_id", ky.page_index(url).alias("idx"), ky.image_page_index(alt, tag, none, none, none, none).alias("image_idx"))


@query(
    "T31_export_name",
    """SELECT page_id, CASE WHEN x = '' THEN 'page' ELSE x END || '.lens_text.pt-br.png' AS name FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(url, '\\.[^.]+$', ''), '[\\\\/:*?"<>|]+', '_', 'g'), '\\s+', ' ', 'g')) AS x FROM pages)""",
)
def q_export_name(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "pages").select("page_id", ky.export_name(F.col("url"), F.lit("lens_text"), F.lit("pt br"), F.lit("png")).alias("name"))


_SIZES = "SELECT o_orderkey AS image_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 60 + o_orderkey % 500 END AS w, 40 + (o_orderkey*7) % 900 AS h FROM orders"


def sized(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(k.alias("image_id"), F.when(k % 10 != 0, 60 + k % 500).alias("w"), (40 + (k * 7) % 900).alias("h"))


@query("F7_filter_scan_candidates", f"WITH s AS ({_SIZES}) SELECT image_id FROM s WHERE NOT coalesce(least(w,h) < 120 OR w*h < 60000, false) OR w IS NULL")
def q_filter_scan(spark: SparkSession, sf: str) -> DataFrame:
    return pg.filter_scan_candidates(sized(spark, sf)).select("image_id")


@query("F7_filter_reader_pages", f"WITH s AS ({_SIZES}) SELECT image_id FROM s WHERE NOT (coalesce(w,0)*h < 65000 AND (coalesce(w,0) < 260 OR h < 260))")
def q_filter_reader(spark: SparkSession, sf: str) -> DataFrame:
    return pg.filter_scan_candidates(sized(spark, sf), reader=True).select("image_id")


@query(
    "F15_select_overlay",
    with_views(
        "requests",
        """SELECT request_id, CASE WHEN lower(source) = 'ai' OR starts_with(lower(source), 'cli_') THEN ai ELSE CASE WHEN source = 'original' THEN 'O' || request_id ELSE 'T' || request_id END END AS shown_html,
  CASE WHEN (lower(source) = 'ai' OR starts_with(lower(source), 'cli_')) AND ai = '' THEN CASE request_id % 7 WHEN 0 THEN 'No text' WHEN 1 THEN 'Rate limit' ELSE 'AI…' END END AS badge, coalesce(CASE WHEN request_id % 2 = 0 THEN src END, CASE WHEN request_id % 5 = 0 THEN lang END) AS image
  FROM (SELECT *, CASE WHEN request_id % 4 = 0 THEN '' ELSE 'A' || request_id END AS ai FROM requests)""",
    ),
)
def q_select_overlay(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("request_id")
    r = views.requests(spark, sf)
    r = r.select("request_id", "source", F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("A"), k.cast("string"))).alias("ai_html"), F.concat(F.lit("O"), k.cast("string")).alias("original_html"), F.concat(F.lit("T"), k.cast("string")).alias("translated_html"),
                 F.when(k % 7 == 0, " no_text ").when(k % 7 == 1, "rate_limited").alias("skipped_reason"), F.when(k % 2 == 0, F.col("src")).otherwise("").alias("imageDataUri"), F.when(k % 5 == 0, F.col("lang")).alias("image_url"))
    return pg.select_overlay(r).select("request_id", "shown_html", "badge", "image")


@query("F16_page_badge", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Overlay ready' WHEN page_id % 2 = 0 THEN 'Image ready' ELSE 'Original' END AS badge FROM pages")
def q_page_badge(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("page_id")
    p = views.table(spark, sf, "pages").select("page_id", F.when(k % 3 == 0, True).alias("overlay_applied"), F.when(k % 2 == 0, F.col("url")).otherwise("").alias("translated_image"))
    return pg.page_badge(p).select("page_id", "badge")


@query(
    "F19_validate_images",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '[download] Not an image: text/html' WHEN n_chars < 64 THEN '[download] Image too small' WHEN n_chars*2048 > 26214400 AND doc_id % 3 = 0 THEN '[download] Image too large' END AS reject FROM documents""",
)
def q_validate_images(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("doc_id"), F.col("n_chars")
    d = views.table(spark, sf, "documents").select("doc_id", F.when(k % 5 == 0, "text/html; charset=x").otherwise("IMAGE/png").alias("mime"), F.when((k % 3 == 0) & (n >= 64), n * 2048).otherwise(n).alias("size"), F.lit(None).cast("long").alias("uri_length"))
    return pg.validate_images(d).select("doc_id", "reject")


@query("J12_map_pages_to_urls", with_views("page_links", "SELECT page_id, CAST(pos AS INTEGER) AS page_index, href AS chapter_url FROM page_links WHERE href <> ''"))
def q_map_pages(spark: SparkSession, sf: str) -> DataFrame:
    links = views.page_links(spark, sf)
    chapters = links.groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "href"))), lambda x: x["href"]).alias("urls"))
    # every place of the page's own list, and the one behind it
    want = links.select("page_id", F.explode(F.array(F.col("pos").cast("int"), (F.col("pos") + 1).cast("int"))).alias("page_index")).distinct()
    return pg.map_pages_to_urls(want, chapters, "page_id")


@query(
    "J16_match_targets",
    with_views(
        "page_links",
        """SELECT page_id, result_id, min(prio) AS rule, arg_min(img_no, (prio, img_no)) AS img_no FROM (
  SELECT r.page_id, r.pos AS result_id, CASE WHEN i.pos % 4 = 0 AND i.pos = r.pos THEN 1 WHEN i.pos % 4 = 1 AND i.url = r.url THEN 2 WHEN i.pos = 3 AND r.pos % 2 = 1 AND i.url = r.url THEN 4 WHEN i.pos % 4 = 3 AND i.url = r.url THEN 5 END AS prio, i.pos AS img_no
  FROM links r JOIN links i USING (page_id)
  UNION ALL
  SELECT r.page_id, r.pos, 3, arg_max(i.pos, (9000000 - i.pos % 3 * 4000000, i.pos)) FROM links r JOIN links i USING (page_id)
  WHERE i.pos % 4 = 2 AND i.url = r.url AND 9000000 - i.pos % 3 * 4000000 <= CASE WHEN r.pos % 2 = 1 THEN 3000000 ELSE 9000000 END GROUP BY r.page_id, r.pos
) WHERE prio IS NOT NULL GROUP BY page_id, result_id""",
        links=f"SELECT * FROM ({LINKS}) WHERE url <> ''",
    ),
)
def q_match_targets(spark: SparkSession, sf: str) -> DataFrame:
    p = views.page_links(spark, sf)
    d = p.select("page_id", "pos", ky.page_url("href", "url").alias("url")).filter("url <> ''")
    k = F.col("pos")
    name = F.concat(F.lit("md:"), k.cast("string"))
    results = d.select("page_id", k.alias("result_id"), F.when(k % 4 == 0, name).alias("key"), "url", (k % 2 * -6_000_000 + 9_000_000).cast("long").alias("us"))
    images = d.select("page_id", k.alias("img_no"), F.when(k % 4 == 0, name).alias("key"), F.when(k % 4 == 1, F.col("url")).alias("original"), F.when(k % 4 == 3, F.col("url")).alias("current"), F.lit(None).cast("string").alias("src"))
    recent = d.filter(k % 4 == 2).select("page_id", "url", k.alias("img_no"), (9_000_000 - k % 3 * 4_000_000).cast("long").alias("us"))
    clicks = d.filter(k == 3).select("page_id", k.alias("img_no"), F.lit(0).cast("long").alias("us"), F.array("url").alias("urls"))
    # clicks on every picture long after all results; they change nothing
    clicks = clicks.unionByName(d.select("page_id", k.alias("img_no"), (900_000_000 + k).cast("long").alias("us"), F.array("url").alias("urls")))
    return pg.match_targets(results, images, recent, clicks)


@query("A16_distinct_images", "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc_id FROM documents GROUP BY 1")
def q_distinct_images(spark: SparkSession, sf: str) -> DataFrame:
    return pg.distinct_images(views.table(spark, sf, "documents"), "text", "doc_id")


@query(
    "O2_natural_sort",
    """SELECT page_id, array_to_string(list_transform(regexp_extract_all(trim(url), '\\d+|\\D+'), lambda x: CASE WHEN regexp_matches(x, '^\\d') THEN lpad(CAST(length(regexp_replace(x, '^0+(.)', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(x, '^0+(.)', '\\1') ELSE x END), '') AS sort_key FROM pages""",
)
def q_natural_sort(spark: SparkSession, sf: str) -> DataFrame:
    p = views.table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("id"), F.lit("").alias("relative_path"), F.col("url").alias("name"))
    return pg.natural_sort(p).select("page_id", "sort_key")


@query(
    "S2_decode_data_uris",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/octet-stream' ELSE '' END AS mime, CASE WHEN doc_id % 3 < 2 AND text <> '' THEN sha256(text) ELSE '' END AS sha256, CASE WHEN doc_id % 3 = 2 THEN NULL ELSE 'data:image/png;base64,' || base64(encode(text)) END AS unwrapped FROM documents""",
)
def q_decode_data_uris(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 3
    b64 = F.base64(F.encode("text", "UTF-8"))
    uri = F.when(k == 0, F.concat(F.lit(" data:text/plain;base64,"), F.regexp_replace(b64, "=+$", ""))).when(k == 1, F.concat(F.lit("data:,"), b64)).otherwise(F.col("text"))
    full = im.encode_data_uris(F.encode("text", "UTF-8"), F.lit("image/png"))
    wrapped = F.when(k == 0, full).when(k == 1, F.regexp_replace(F.base64(F.encode(full, "UTF-8")), "=+$", "")).otherwise("none")
    d = views.table(spark, sf, "documents").select("doc_id", uri.alias("uri"), wrapped.alias("wrapped"))
    return im.decode_data_uris(d, "uri").select("doc_id", "mime", "sha256", im.unwrap_data_uris("wrapped").alias("unwrapped"))


@query(
    "S3_ingest_ocr_boxes",
    with_views("boxes", """SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY box_id) - 1 AS box_id, text, confidence, l, t, r, b, 0.0::DOUBLE AS angle_deg FROM boxes"""),
)
def q_ingest_ocr_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes written out as recogniser JSON, half the pages in each of the two shapes, and read back."""
    return im.ingest_ocr_boxes(recogniser_json(spark, sf)).select("image_id", "box_id", "text", "confidence", "l", "t", "r", "b", fixed("angle_deg").alias("angle_deg"))


@query(
    "S3_ocr_rejects",
    with_views("boxes", "SELECT image_id, CASE WHEN image_id % 7 = 0 THEN 'no JSON' ELSE 'nested too deep' END AS reason FROM (SELECT DISTINCT image_id FROM boxes) WHERE image_id % 7 = 0 OR image_id % 11 = 0"),
)
def q_ocr_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Recogniser results of which some are cut off and some are wrapped too often."""
    k, whole = F.col("image_id"), F.col("raw")
    deep = F.concat(F.repeat(F.lit("["), F.lit(im.NESTING)), whole, F.repeat(F.lit("]"), F.lit(im.NESTING)))
    broken = recogniser_json(spark, sf).select("image_id", F.when(k % 7 == 0, F.expr("left(raw, length(raw) - 1)")).when(k % 11 == 0, deep).otherwise(whole).alias("raw"))
    return im.ocr_rejects(broken).select("image_id", "reason")


def recogniser_json(spark: SparkSession, sf: str) -> DataFrame:
    return views.recogniser_json(spark, sf)


# ---------------------------------------------------------------- dimensions


@query(
    "J8_conform_language",
    with_views("requests", "SELECT request_id, list_extract(['ja','th','en','zh-TW','iw','xx','fr',''], CAST((request_id//2) % 8 + 1 AS BIGINT)) AS lang_norm, CASE WHEN lower(trim(lang)) = 'jp' THEN 'japan' ELSE 'en' END AS ocr_lang FROM requests"),
)
def q_conform_language(spark: SparkSession, sf: str) -> DataFrame:
    return dims.conform_language(views.requests(spark, sf)).select("request_id", "lang_norm", "ocr_lang")


_PROV = "CASE lower(trim(provider)) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in dims.PROVIDER_ALIASES.items()) + " ELSE lower(trim(provider)) END"
_DEF = "CASE p " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in dims.PROVIDER_DEFAULTS.items()) + f" ELSE '{dims.PROVIDER_DEFAULTS['openai'][0]}' END"
_MOD = "CASE p || '/' || lower(trim(model)) " + " ".join(f"WHEN '{p}/{a}' THEN '{b}'" for p, d in dims.MODEL_ALIASES.items() for a, b in d.items()) + " ELSE trim(model) END"


@query("J9_conform_provider_model", with_views("requests", f"SELECT request_id, p AS provider_norm, CASE WHEN lower(trim(model)) IN ('', 'auto') THEN {_DEF} ELSE {_MOD} END AS model_norm FROM (SELECT *, {_PROV} AS p FROM requests)"))
def q_conform_provider(spark: SparkSession, sf: str) -> DataFrame:
    return dims.conform_provider_model(views.requests(spark, sf)).select("request_id", "provider_norm", "model_norm")


_PROMPTS = "SELECT lang, model, arg_min(text, doc_id) AS text FROM (SELECT d.lang, CASE WHEN d.doc_id % 4 = 0 THEN 'auto' ELSE 'm' || (d.doc_id % 3) END AS model, d.text, d.doc_id FROM labels l JOIN documents d USING (doc_id)) GROUP BY 1, 2"


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    d = views.table(spark, sf, "documents").join(views.table(spark, sf, "labels").select("doc_id"), "doc_id")
    p = d.select("lang", F.when(k % 4 == 0, "auto").otherwise(F.concat(F.lit("m"), (k % 3).cast("string"))).alias("model"), "text", "doc_id")
    return dims.one_prompt_per_key(p, "doc_id")


@query(
    "J10_lookup_prompt",
    f"""WITH prompts AS ({_PROMPTS}), req AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'zz' ELSE lang END AS lang, 'm' || (doc_id % 5) AS model, CASE WHEN doc_id % 2 = 0 THEN source END AS legacy FROM documents)
  SELECT doc_id, md5({sql_prompt('text')}) AS digest FROM (SELECT r.doc_id, coalesce(nullif(a.text, ''), nullif(b.text, ''), nullif(r.legacy, ''), '') AS text FROM req r LEFT JOIN prompts a ON a.lang = r.lang AND a.model = r.model LEFT JOIN prompts b ON b.lang = r.lang AND b.model = 'auto')""",
)
def q_lookup_prompt(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    r = views.table(spark, sf, "documents").select("doc_id", F.when(k % 9 == 0, "zz").otherwise(F.col("lang")).alias("lang"), F.concat(F.lit("m"), (k % 5).cast("string")).alias("model"), F.when(k % 2 == 0, F.col("source")).alias("legacy"))
    return dims.lookup_prompt(r, prompts(spark, sf)).select("doc_id", F.md5("prompt").alias("digest"))


CONTRACT = ["Answer with the translation alone.", "Keep every marker such as <<TP_P0>> as it is and where it is.", "Put the text of each paragraph behind its marker."]
RETRY = "Again, with all markers from the first to the last."
TEMPLATE, SCHEMA = "Translate this:\n{input_json}\nAnswer as {output_schema}", '{"aiTextFull": "..."}'
STYLES = [("en", "Style en"), ("fr", "Style fr"), ("default", "Default style")]
_Q = "'" + "\n".join(CONTRACT).replace("'", "''") + "'"
_R = "'" + RETRY + "'"


@query(
    "J11_build_prompts",
    f"""SELECT doc_id, md5(CASE WHEN own <> '' THEN own || CASE WHEN contains(own, '<<TP_P') OR contains(lower(own), 'marker') THEN CASE WHEN retry THEN chr(10) || chr(10) || {_R} ELSE '' END ELSE chr(10) || chr(10) || contract END
  ELSE 'Base.' || chr(10) || chr(10) || CASE WHEN lang IN ('en','fr') THEN 'Style ' || lang ELSE 'Default style' END || chr(10) || chr(10) || contract END) AS system_digest, md5('Input:' || chr(10) || text) AS user_digest FROM (
  SELECT doc_id, lang, text, doc_id % 3 = 0 AS retry, CASE doc_id % 4 WHEN 0 THEN 'Keep markers' WHEN 1 THEN source ELSE '' END AS own, {_Q} || CASE WHEN doc_id % 3 = 0 THEN chr(10) || {_R} ELSE '' END AS contract FROM documents)""",
)
def q_build_prompts(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    r = views.table(spark, sf, "documents").select("doc_id", "lang", F.when(k % 4 == 0, "Keep markers").when(k % 4 == 1, F.col("source")).otherwise("").alias("prompt"), (k % 3 == 0).alias("is_retry"), F.col("text").alias("marked_text"))
    styles = spark.createDataFrame(STYLES, "lang string, style string")
    return dims.build_prompts(r, styles, "Base.", CONTRACT, RETRY).select("doc_id", F.md5("system_text").alias("system_digest"), F.md5("user_text").alias("user_digest"))


@query(
    "J11_json_prompts",
    f"""SELECT doc_id, md5('Base.' || chr(10) || chr(10) || CASE WHEN lang IN ('en','fr') THEN 'Style ' || lang ELSE 'Default style' END || chr(10) || chr(10) || {_Q}) AS system_digest,
  md5('Translate this:' || chr(10) || '{{"target_lang": ' || CAST(to_json(coalesce(lang, '')) AS VARCHAR) || ', "originalTextFull": ' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || '}}' || chr(10) || 'Answer as {SCHEMA}') AS user_digest FROM documents""",
)
def q_json_prompts(spark: SparkSession, sf: str) -> DataFrame:
    r = views.table(spark, sf, "documents").select("doc_id", "lang", "text")
    d = dims.build_json_prompts(r, spark.createDataFrame(STYLES, "lang string, style string"), "Base.", CONTRACT, TEMPLATE, SCHEMA)
    return d.select("doc_id", F.md5("system_text").alias("system_digest"), F.md5("user_text").alias("user_digest"))


_NAMES = ["Gemma-3-27b-it", "llama-3-8b", "qwen2-instruct", " mistral:7b", "gpt-x", "", "GLM-4", "gemma-2-9b-it", "alpha", "Beta"]
_MODELS = f"SELECT 'p' || (o_custkey % 40) AS provider, {sql_pick(_NAMES, 'o_orderkey + o_custkey % 3')} AS model, o_orderkey FROM orders WHERE o_custkey % 40 <> o_orderkey % 10"


def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    o = views.table(spark, sf, "orders").filter(F.col("o_custkey") % 40 != F.col("o_orderkey") % 10)
    return o.select(F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string")).alias("provider"), views.pick(_NAMES, F.col("o_orderkey") + F.col("o_custkey") % 3).alias("model"), "o_orderkey")


@query("U3_merge_model_lists", f"SELECT DISTINCT provider, trim(model) AS model FROM ({_MODELS}) WHERE trim(model) <> ''")
def q_merge_models(spark: SparkSession, sf: str) -> DataFrame:
    m = model_rows(spark, sf)
    even = F.col("o_orderkey") % 2 == 0
    return dims.merge_model_lists([m.filter(even), m.filter(~even)])


_TIER = "CASE WHEN contains(lower(model), 'instruct') OR suffix(lower(model), '-it') OR contains(model, ':') THEN CASE " + " ".join(f"WHEN contains(lower(model), '{f}') THEN {i}" for i, f in enumerate(dims.MODEL_PRIORITY)) + " ELSE 7 END ELSE 99 END"


@query(
    "O4_rank_models",
    f"""WITH m AS ({_MODELS}), clean AS (SELECT DISTINCT provider, trim(model) AS model FROM m WHERE trim(model) <> ''), per AS (SELECT provider, arg_min(model, (lower(model), model)) AS first, arg_min(model, ({_TIER}, lower(model), model)) AS automatic FROM clean GROUP BY 1)
  SELECT w.o_orderkey AS request_id, w.provider, CASE WHEN c.model IS NOT NULL THEN c.model ELSE coalesce(per.first, w.model) END AS model, automatic FROM (SELECT o_orderkey, 'p' || (o_orderkey % 40) AS provider, {sql_pick(_NAMES, 'o_orderkey // 7')} AS model FROM orders) w LEFT JOIN clean c ON c.provider = w.provider AND c.model = w.model LEFT JOIN per ON per.provider = w.provider""",
)
def q_rank_models(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    want = views.table(spark, sf, "orders").select(k.alias("request_id"), F.concat(F.lit("p"), (k % 40).cast("string")).alias("provider"), views.pick(_NAMES, F.floor(k / 7)).alias("model"))
    return dims.choose_models(model_rows(spark, sf).select("provider", "model"), want)
