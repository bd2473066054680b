"""Harvesting pictures from pages, and the tables around a page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelayout.functions.exprs import trim_ws
from pagelayout.functions.keys import page_url
from pagelayout.operators.jobs import asof
from pagelayout.operators.scans import first_by

# Attributes that may hold a picture's address, best first; the stored original counts only as a URL.
STORED_ORIGINAL = "data-tp-original"
SOURCE_ATTRS = ["src", "data-src", "data-original", "data-lazy-src"]


def attribute(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, "(?i)[\\s\"'/]" + name + "\\s*=\\s*[\"']([^\"']*)[\"']", 1)


def extract_page_images(pages: DataFrame, tag: str = "img", attrs: Sequence[str] = tuple(SOURCE_ATTRS)) -> DataFrame:
    """Candidates of each page in page order, the first of every address (page_id, pos, raw, url)."""
    tags = F.regexp_extract_all("html", F.lit(f"(?is)<{tag}\\s[^>]*>"), 0)
    d = pages.select("page_id", F.col("url").alias("__base"), F.posexplode_outer(tags).alias("pos", "__tag")).filter(F.col("pos").isNotNull())
    stored = attribute(F.col("__tag"), STORED_ORIGINAL)
    first = [F.when(stored.rlike("(?i)^https?:"), stored)] + [F.when(attribute(F.col("__tag"), a) != "", attribute(F.col("__tag"), a)) for a in attrs]
    d = d.withColumn("raw", F.coalesce(*first, F.lit(""))).withColumn("url", page_url("raw", "__base")).filter("url <> ''")
    return first_by(d.select("page_id", "url", "pos", "raw"), ["page_id", "url"], ["pos"])


def filter_scan_candidates(images: DataFrame, reader: bool = False) -> DataFrame:
    """Drop pictures too small to hold text; unknown sizes pass (``reader``: the looser rule for reader pages)."""
    w, h = F.coalesce("w", F.lit(0)), F.coalesce("h", F.lit(0))
    if reader:
        small = (w * h < 65000) & ((w < 260) | (h < 260))
    else:
        small = (w != 0) & (h != 0) & ((F.least(w, h) < 120) | (w * h < 60000))
    return images.filter(~small)


IMAGE_FIELDS = ["imageDataUri", "imageDataURI", "image", "imageUrl", "image_url", "imageURL"]


def select_overlay(results: DataFrame) -> DataFrame:
    """Add ``shown_html``, ``badge`` and ``image`` for the requested ``source``."""
    s = F.lower(trim_ws(F.coalesce("source", F.lit(""))))
    ai = s.isin("ai", "cli") | s.startswith("cli_")
    html = F.when(ai, F.col("ai_html")).when(s == "original", F.col("original_html")).otherwise(F.col("translated_html"))
    html = F.coalesce(html, F.lit(""))
    reason = trim_ws(F.coalesce("skipped_reason", F.lit("")))
    badge = F.when(reason == "no_text", "No text").when(reason == "rate_limited", "Rate limit").otherwise("AI…")
    image = F.coalesce(*[F.when(F.col(f) != "", F.col(f)) for f in IMAGE_FIELDS if f in results.columns])
    return results.withColumns({"shown_html": html, "badge": F.when(html == "", badge), "image": image})


def page_badge(pages: DataFrame) -> DataFrame:
    image = F.coalesce("translated_image", F.lit("")) != ""
    return pages.withColumn("badge", F.when(F.coalesce("overlay_applied", F.lit(False)), "Overlay ready").when(image, "Image ready").otherwise("Original"))


MIN_BYTES, MAX_BYTES = 64, 25 * 1024 * 1024
MIN_URI, MAX_URI = 128, 34 * 1024 * 1024


def validate_images(files: DataFrame) -> DataFrame:
    """Add ``reject``: why a downloaded picture is no good; null for good ones.

    Reads mime, size and, for pictures taken from a page, uri_length.
    """
    mime = trim_ws(F.split(F.coalesce("mime", F.lit("")), ";")[0])
    reject = (
        F.when((mime != "") & ~F.lower(mime).startswith("image/"), F.concat(F.lit("[download] Not an image: "), mime))
        .when(F.col("size") < MIN_BYTES, "[download] Image too small").when(F.col("size") > MAX_BYTES, "[download] Image too large")
        .when(F.col("uri_length") < MIN_URI, "[download] no image data").when(F.col("uri_length") > MAX_URI, "[download] Image too large")
    )
    return files.withColumn("reject", reject)


def map_pages_to_urls(pages: DataFrame, chapters: DataFrame, key: str) -> DataFrame:
    """Chapter address of each page by its index; indices outside the chapter drop out.

    ``pages``: key, page_index; ``chapters``: key, urls (array).
    """
    urls = chapters.select(key, F.posexplode("urls").alias("page_index", "chapter_url")).filter(F.coalesce("chapter_url", F.lit("")) != "")
    return pages.join(urls, [key, "page_index"])


CLICK_MICROS = 8_000_000  # a click stands for the next results this long


def match_targets(results: DataFrame, images: DataFrame, recent: DataFrame, clicks: DataFrame) -> DataFrame:
    """Picture on the page that a result belongs to, by the first rule that finds one.

    results: page_id, result_id, key, url, us; images: page_id, img_no, key, original, current, src;
    recent: page_id, url, img_no, us (when the picture showed that URL); clicks: page_id, img_no, us, urls.  Of the pictures
    seen with the result's URL the last one not later than the result counts, however old (of several at once the highest number);
    of the clicks the last one before the result, if it is less than eight seconds old.  Sightings at an unknown time count for nothing.
    """
    r = results.select("page_id", "result_id", "key", "url", "us")

    def hits(right: DataFrame, on: Column, prio: int, keep: Column | None = None) -> DataFrame:
        j = r.join(right.withColumnRenamed("page_id", "__p"), (F.col("page_id") == F.col("__p")) & on)
        j = j if keep is None else j.filter(keep)
        return j.select("page_id", "result_id", F.lit(prio).alias("prio"), "img_no")

    def named(c: str) -> DataFrame:
        return images.filter(F.coalesce(c, F.lit("")) != "").select("page_id", "img_no", F.col(c).alias("__v"))

    by_key = hits(named("key"), F.col("key") == F.col("__v"), 1)
    by_original = hits(named("original"), F.col("url") == F.col("__v"), 2)
    seen = recent.filter((F.coalesce("url", F.lit("")) != "") & F.col("us").isNotNull()).groupBy("page_id", "url", "us").agg(F.max("img_no").alias("img_no"))
    last_seen = asof(r.filter(F.coalesce("url", F.lit("")) != ""), seen, ["page_id", "url"], "us", F.col("img_no"), "__seen", "result_id").filter("__seen IS NOT NULL")
    by_recent = last_seen.select("page_id", "result_id", F.lit(3).alias("prio"), F.col("__seen").alias("img_no"))
    clicked = asof(r, clicks, ["page_id"], "us", F.struct("img_no", "urls", F.col("us").alias("at")), "__c", "result_id")
    clicked = clicked.filter((F.col("us") - F.col("__c.at") < CLICK_MICROS) & ((F.col("url") == "") | F.array_contains("__c.urls", F.col("url"))))
    by_click = clicked.select("page_id", "result_id", F.lit(4).alias("prio"), F.col("__c.img_no").alias("img_no"))
    shown = named("current").unionByName(named("src"))
    by_shown = hits(shown, (F.col("url") == F.col("__v")) & (F.col("url") != ""), 5)
    found = by_key.unionByName(by_original).unionByName(by_recent).unionByName(by_click).unionByName(by_shown)
    best = found.groupBy("page_id", "result_id").agg(F.min(F.struct("prio", "img_no")).alias("b"))
    return best.select("page_id", "result_id", F.col("b.prio").alias("rule"), F.col("b.img_no").alias("img_no"))


def distinct_images(requests: DataFrame, content: str, order: str) -> DataFrame:
    """Exact duplicates by digest: how often each picture was sent, and where first."""
    d = requests.select(F.sha2(content, 256).alias("sha256"), F.col(order))
    return d.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias(f"first_{order}"))


def natural_key(c: Column) -> Column:
    """Sort key in which digit runs compare as numbers: each is written with its length, as long as any length can be, in front."""
    runs = F.regexp_extract_all(trim_ws(F.coalesce(c, F.lit(""))), F.lit(r"\d+|\D+"), 0)

    def part(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        return F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)).otherwise(x)

    return F.array_join(F.transform(runs, part), "")


def natural_sort(pages: DataFrame) -> DataFrame:
    """Pages in natural order of path, name or id, ignoring case and accents; ties by id."""
    name = F.coalesce(*[F.when(trim_ws(F.coalesce(c, F.lit(""))) != "", F.col(c)) for c in ("relative_path", "name")], F.col("id"))
    d = pages.withColumns({"sort_key": natural_key(name), "__id": natural_key(F.col("id"))})
    ordered = d.orderBy(F.collate("sort_key", "UNICODE_CI_AI"), F.collate("__id", "UNICODE_CI_AI"))
    return ordered.drop("__id")
