"""Bringing translated text back onto the original paragraphs and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelayout.functions.exprs import collapse_ws, trim_ws
from pagelayout.functions.text import marker, marker_numbers, marker_segments
from pagelayout.operators.scans import ordered_scan


def match_translations(orig: DataFrame, trans: DataFrame) -> DataFrame:
    """Text for every original paragraph: same ``para_index`` first, else same position, else blank.

    Both sides carry ``image_id, pos, para_index``; ``trans`` has ``text``.
    """
    by_index = trans.filter(F.col("para_index").isNotNull()).groupBy("image_id", "para_index").agg(F.min_by(F.struct("text"), "pos").alias("__i"))
    by_pos = trans.groupBy("image_id", "pos").agg(F.first(F.struct("text")).alias("__p"))
    j = orig.join(by_index, ["image_id", "para_index"], "left").join(by_pos, ["image_id", "pos"], "left")
    hit = F.coalesce("__i", "__p")
    return j.select(*orig.columns, F.coalesce(hit["text"], F.lit("")).alias("text"), hit.isNotNull().alias("matched"))


def missing_markers(answers: DataFrame) -> DataFrame:
    """Paragraphs to ask for again: expected markers that are absent, where at least one is present."""
    a = answers.select("image_id", "expected", marker_numbers("marked_text").alias("found")).filter((F.size("found") > 0) & (F.col("expected") > 0))
    want = a.select("image_id", F.explode(F.sequence(F.lit(0), F.col("expected") - 1)).alias("para_index"))
    have = a.select("image_id", F.explode("found").alias("n")).select("image_id", F.col("n").cast("int").alias("para_index")).distinct()
    return want.join(have, ["image_id", "para_index"], "left_anti")


def fallback_paragraphs(source: DataFrame, translated: DataFrame) -> DataFrame:
    """The translated side where it has as many paragraphs as the source, else the source."""
    ns = source.groupBy("image_id").agg(F.count(F.lit(1)).alias("__ns"))
    nt = translated.groupBy("image_id").agg(F.count(F.lit(1)).alias("__nt"))
    use = ns.join(nt, "image_id", "left").select("image_id", (F.coalesce("__nt", F.lit(0)) == F.col("__ns")).alias("__use"))
    s = source.join(use, "image_id").filter(~F.col("__use"))
    t = translated.join(use, "image_id").filter(F.col("__use"))
    return s.unionByName(t).select("image_id", "para_index", "text")


def fill_missing_segments(answers: DataFrame, fallback: DataFrame) -> DataFrame:
    """Every expected segment: the answer's, or the fallback paragraph where that is missing or empty."""
    slots = answers.filter(F.col("expected") > 0).select("image_id", F.explode(F.sequence(F.lit(0), F.col("expected") - 1)).alias("para_index"))
    segs = marker_segments(answers, ["image_id"])
    j = slots.join(segs, ["image_id", "para_index"], "left").join(fallback.withColumnRenamed("text", "__f"), ["image_id", "para_index"], "left")
    return j.select(
        "image_id", "para_index",
        F.coalesce("segment", collapse_ws("__f"), F.lit("")).alias("segment"),
        F.col("segment").isNull().alias("filled"),
    )


def repair_meta(filled: DataFrame) -> DataFrame:
    return filled.groupBy("image_id").agg(
        (F.count_if("filled") > 0).alias("repaired"),
        F.count(F.lit(1)).alias("expected"),
        F.count_if(~F.col("filled")).alias("found"),
        F.count_if("filled").alias("missing"),
    )


def repaired_text(filled: DataFrame) -> DataFrame:
    """The repaired answer of each page as one marked text."""
    rows = F.array_sort(F.collect_list(F.struct("para_index", "segment")))
    lines = F.array_join(F.transform(rows, lambda x: F.concat(marker(x["para_index"]), F.lit("\n"), x["segment"], F.lit("\n"))), "\n")
    return filled.groupBy("image_id").agg(F.regexp_replace(lines, r"^\n+|\n+$", "").alias("marked_text"))


def allocate_words(df: DataFrame, text: str, lengths: str, out: str) -> DataFrame:
    """Words of ``text`` dealt to slots in proportion to ``lengths``; shares add up, rounding is half-even.

    The last slot takes the rest, so nothing is lost.
    """
    clean = trim_ws(F.coalesce(text, F.lit("")))
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, r"(?U)\s+"))
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    d = df.withColumns({"__words": words, "__whole": F.greatest(F.lit(1).cast("long"), total).cast("double"), "__slots": F.size(lengths)})
    d = d.withColumn("__n", F.size("__words"))
    n, whole, slots = F.col("__n"), F.col("__whole"), F.col("__slots")
    start = F.struct(F.lit(0.0).alias("acc"), F.lit(0).alias("last"), F.array(F.lit(0)).alias("cuts"))

    def step(s: Column, length: Column) -> Column:
        acc = s["acc"] + length.cast("double") / whole * n
        at = F.greatest(s["last"], F.least(n, F.rint(acc).cast("int")))
        return F.struct(acc.alias("acc"), at.alias("last"), F.concat(s["cuts"], F.array(at)).alias("cuts"))

    inner = F.aggregate(F.slice(lengths, F.lit(1), F.greatest(F.lit(0), slots - 1)), start, step)["cuts"]
    d = d.withColumn("__cuts", F.concat(inner, F.array(n)))
    dealt = F.transform(lengths, lambda _, i: F.array_join(F.slice("__words", F.get("__cuts", i) + 1, F.get("__cuts", i + 1) - F.get("__cuts", i)), " "))
    filled = F.when((slots > 0) & (F.size("__words") >= 0), dealt).otherwise(F.array().cast("array<string>"))
    return d.withColumn(out, filled).drop("__words", "__whole", "__slots", "__n", "__cuts")


def translate_lines(paras: DataFrame, items: DataFrame) -> DataFrame:
    """Texts of the original lines after translation: each paragraph's words dealt over its lines."""
    keys = ["image_id", "para_index"]
    ordered = F.array_sort(F.collect_list(F.struct("item_index", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))))
    lines = items.groupBy(*keys).agg(ordered.alias("__l"))
    j = paras.select(*keys, F.col("text").alias("__t")).join(lines, keys)
    j = j.withColumns({"__len": F.transform("__l", lambda x: x["n"]), "__ix": F.transform("__l", lambda x: x["item_index"])})
    j = allocate_words(j, "__t", "__len", "__dealt")
    out = j.select(*keys, F.explode_outer(F.arrays_zip(F.col("__ix").alias("item_index"), F.col("__dealt").alias("text"))).alias("z"))
    return out.select(*keys, F.col("z.item_index").alias("item_index"), F.col("z.text").alias("text"))


def reindex_paragraphs(paras: DataFrame, order: Sequence[str], keys: Sequence[str] = ("image_id", "side")) -> DataFrame:
    """Contiguous ``para_index`` along ``order``."""
    d = ordered_scan(paras, list(keys), list(order), number="__n")
    return d.withColumn("para_index", F.col("__n").cast("int")).drop("__n")


def union_spans(orig: DataFrame, trans: DataFrame) -> DataFrame:
    """All spans of both sides, originals first; nothing is de-duplicated."""
    a = orig.withColumn("source_order", F.lit(0))
    return a.unionByName(trans.withColumn("source_order", F.lit(1)))
