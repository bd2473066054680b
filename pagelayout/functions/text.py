"""Text functions as columns: markers, answers, prompts, escaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelayout.functions.exprs import col, collapse_ws, is_blank, trim_ws

MARKER = r"<<TP_P\d+>>"
MARKER_ID = r"<<TP_P(\d+)>>"
# A segment belongs to a marker only if its number is written without leading zeros.
CANONICAL = r"^(0|[1-9]\d*)$"


def marker(i: Column) -> Column:
    return F.concat(F.lit("<<TP_P"), i.cast("string"), F.lit(">>"))


def _ids(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(MARKER_ID), 1)


def _number(digits: Column) -> Column:
    """A marker's number as int, leading zeros aside; null for numbers that no paragraph can have."""
    return F.regexp_replace(digits, r"^0+(?=\d)", "").try_cast("int")


def marker_numbers(s: Column | str) -> Column:
    """Distinct marker numbers, ascending."""
    return F.array_sort(F.array_distinct(F.transform(_ids(col(s)), lambda x: F.regexp_replace(x, r"^0+(?=\d)", "").try_cast("decimal(38,0)"))))


def clamp_repeats(s: Column | str, n: int = 12) -> Column:
    """Runs of one character longer than ``n`` are cut to ``n``; newlines are left alone."""
    return F.regexp_replace(col(s), r"(?d)(.)\1{%d,}" % n, "$1" * n)


def apply_markers(paras: Column | str) -> Column:
    """Array of paragraph texts to one marked text."""
    parts = F.transform(col(paras), lambda t, i: F.concat(marker(i), F.lit("\n"), trim_ws(F.coalesce(t, F.lit("")))))
    return F.array_join(parts, "\n\n")


def has_meaningful_text(s: Column | str) -> Column:
    return ~is_blank(F.regexp_replace(F.coalesce(col(s), F.lit("")), MARKER, ""))


def needs_retry(s: Column | str, expected: Column | str) -> Column:
    """An answer without a single marker has to be asked for again."""
    return (col(expected) > 0) & (F.size(_ids(F.coalesce(col(s), F.lit("")))) == 0)


def markers_complete(s: Column | str, expected: Column | str) -> Column:
    """Markers 0..n-1 all occur and their first occurrences come in order."""
    n = col(expected)
    first_seen = F.array_distinct(_ids(F.coalesce(col(s), F.lit(""))))
    wanted = F.filter(first_seen, lambda x: x.rlike(CANONICAL) & F.coalesce(_number(x) < n, F.lit(False)))
    return (n <= 0) | (wanted == F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i.cast("string")))


def norm_dedupe_text(s: Column | str) -> Column:
    return collapse_ws(F.lower(F.regexp_replace(F.coalesce(col(s), F.lit("")), MARKER, "")))


def _segments(df: DataFrame, text: str, expected: str, keys: list[str]) -> DataFrame:
    """One row per marker occurrence: its number, order and raw segment."""
    parts = F.split(F.col(text), MARKER)
    pairs = F.arrays_zip(_ids(F.col(text)).alias("id"), F.slice(parts, F.lit(2), F.size(parts)).alias("seg"))
    d = df.select(*keys, expected, F.posexplode_outer(pairs).alias("occ", "p"))
    return d.select(*keys, expected, F.col("p.id").alias("id"), "occ", F.col("p.seg").alias("seg"))


def marker_segments(df: DataFrame, keys: list[str], text: str = "marked_text", expected: str = "expected") -> DataFrame:
    """Non-empty segment of each marker's first occurrence, white space collapsed."""
    d = _segments(df, text, expected, keys).filter(F.col("id").rlike(CANONICAL))
    d = d.withColumn("para_index", _number(F.col("id"))).filter(F.col("para_index") < F.col(expected))
    first = d.groupBy(*keys, "para_index").agg(F.min_by("seg", "occ").alias("seg"))
    return first.select(*keys, "para_index", collapse_ws("seg").alias("segment")).filter("segment <> ''")


def marker_segments_for_layout(df: DataFrame, keys: list[str], text: str = "marked_text", expected: str = "expected") -> DataFrame:
    """Exactly ``expected`` segments: first non-empty occurrence, inner white space kept.

    Text without markers is cut on blank lines instead; missing segments are empty.
    """
    has = F.size(_ids(F.col(text))) > 0
    d = _segments(df.filter(has), text, expected, keys)
    d = d.withColumns({"para_index": _number(F.col("id")), "seg": trim_ws("seg")}).filter((F.col("para_index") < F.col(expected)) & (F.col("seg") != ""))
    marked = d.groupBy(*keys, "para_index").agg(F.min_by("seg", "occ").alias("segment"))
    plain = df.filter(~has & (F.col(text) != "")).select(*keys, expected, F.posexplode(F.split(F.col(text), "\n\n")).alias("para_index", "segment"))
    plain = plain.filter(F.col("para_index") < F.col(expected)).select(*keys, "para_index", "segment")
    slots = df.filter(F.col(expected) > 0).select(*keys, F.explode(F.sequence(F.lit(0), F.col(expected) - 1)).alias("para_index"))
    return slots.join(marked.unionByName(plain), [*keys, "para_index"], "left").withColumn("segment", F.coalesce("segment", F.lit("")))


def sanitize_marked_text(df: DataFrame, text: str, out: str) -> DataFrame:
    """Repair a marked answer: one marker per line, broken markers removed, segments collapsed and sorted.

    Each step is a column of its own, so that no step is worked out again for every element of the next.
    """
    t = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"<<TP_P(?!\d+>>)[^\s>]*>?", "")
    t = F.regexp_replace(t, r"(?m)^\s*(<<TP_P\d+>>)\s*(\S)", "$1\n$2")

    def line(x: Column) -> Column:
        head = F.regexp_extract(x, r"^\s*(<<TP_P\d+>>)", 1)
        rest = trim_ws(F.regexp_replace(x, r"^\s*<<TP_P\d+>>", ""))
        return (
            F.when(~F.contains(x, F.lit("<<TP_P")), x)
            .when(head != "", F.when(rest == "", head).otherwise(F.concat(head, F.lit("\n"), rest)))
            .otherwise(F.regexp_replace(x, MARKER, ""))
        )

    d = df.withColumn("__t", F.array_join(F.transform(F.split(t, "\n"), line), "\n"))
    parts = F.split("__t", MARKER)
    pairs = F.arrays_zip(_ids(F.col("__t")).alias("id"), F.slice(parts, F.lit(2), F.size(parts)).alias("seg"))

    def numbered(x: Column, i: Column) -> Column:
        odd = ~x["id"].rlike(CANONICAL)
        return F.struct(x["id"].cast("decimal(38,0)").alias("n"), odd.alias("odd"), i.alias("occ"), F.when(odd, "").otherwise(collapse_ws(x["seg"])).alias("seg"))

    d = d.withColumn("__s", F.array_sort(F.transform(pairs, numbered)))
    first = F.filter("__s", lambda x, i: (i == 0) | (F.get("__s", i - 1)["n"] != x["n"]))
    body = F.array_join(F.transform(first, lambda x: F.concat(marker(x["n"]), F.lit("\n"), x["seg"])), "\n\n")
    fixed = F.when(F.size("__s") == 0, collapse_ws("__t")).otherwise(F.regexp_replace(body, r"^\n+|\n+$", ""))
    return d.withColumn(out, fixed).drop("__t", "__s")


def merge_overlap_text(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Join two texts over their longest common seam, by words first, else by characters."""
    d = df.withColumns({"__a": trim_ws(F.coalesce(a, F.lit(""))), "__b": trim_ws(F.coalesce(b, F.lit("")))})
    d = d.withColumns({"__wa": F.split("__a", r"(?U)\s+"), "__wb": F.split("__b", r"(?U)\s+"), "__ca": F.length("__a"), "__cb": F.length("__b")})
    d = d.withColumns({"__na": F.size("__wa"), "__nb": F.size("__wb")})
    na, nb, ca, cb = (F.col(c) for c in ("__na", "__nb", "__ca", "__cb"))
    words = F.sequence(F.lit(1), F.least(na, nb))
    same_words = lambda k: (F.get("__wa", na - k) == F.get("__wb", F.lit(0))) & (F.slice("__wa", na - k + 1, k) == F.slice("__wb", F.lit(1), k))
    d = d.withColumn("__kw", F.array_max(F.filter(words, same_words)))
    chars = F.when(F.col("__kw").isNull(), F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(ca, cb))))
    same_chars = lambda k: F.substring("__a", ca - k + 1, k) == F.substring("__b", F.lit(1), k)
    d = d.withColumn("__kc", F.array_max(F.filter(chars, same_chars)))
    by_words = F.array_join(F.concat("__wa", F.slice("__wb", F.col("__kw") + 1, F.greatest(nb, F.lit(1)))), " ")
    by_chars = F.concat("__a", F.substring("__b", F.col("__kc") + 1, F.greatest(cb, F.lit(1))))
    joined = (
        F.when(F.col("__a") == "", F.col("__b")).when(F.col("__b") == "", F.col("__a"))
        .when(F.col("__kw").isNotNull(), by_words).when(F.col("__kc").isNotNull(), by_chars).otherwise(F.concat_ws(" ", "__a", "__b"))
    )
    return d.withColumn(out, joined).drop("__a", "__b", "__wa", "__wb", "__ca", "__cb", "__na", "__nb", "__kw", "__kc")


# ---------------------------------------------------------------- model answers


def strip_wrappers(s: Column | str) -> Column:
    """Without code fences and answer tags, line ends unified."""
    t = F.regexp_replace(trim_ws(F.coalesce(col(s), F.lit(""))), r"\r\n?", "\n")
    t = F.regexp_replace(t, "```[a-zA-Z0-9_-]*", "")
    return trim_ws(F.regexp_replace(t, "(?i)</?AiTextFull>", ""))


def parse_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Add ``ai_text`` (null when unusable) and ``parse_error`` (null when fine)."""
    t = strip_wrappers(raw)
    d = df.withColumn("__t", t)
    t = F.col("__t")
    is_json = t.startswith("{")
    got = F.coalesce(F.get_json_object(t, "$.aiTextFull"), F.get_json_object(t, "$.textFull"))
    value = F.regexp_replace(got, r'([^\n\t"\\])\1{3,}', "$1$1$1")

    def real_newlines(x: Column) -> Column:
        return F.when(F.contains(x, F.lit("\\n")) & ~F.contains(x, F.lit("\n")), F.replace(x, F.lit("\\n"), F.lit("\n"))).otherwise(x)

    from_json = trim_ws(F.regexp_replace(real_newlines(value), r"\r\n?", "\n"))
    plain = trim_ws(F.regexp_replace(real_newlines(t), r"(?i)^aiTextFull\s*[:=]\s*", ""))
    return d.select(
        *df.columns,
        F.when(t == "", F.lit(None).cast("string")).when(is_json, from_json).otherwise(plain).alias("ai_text"),
        F.when(t == "", "empty").when(is_json & got.isNull(), "no answer field").alias("parse_error"),
    )


def sanitize_text(s: Column | str) -> Column:
    """Line ends unified; zero-width, control and unassigned characters removed."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(col(s), F.lit("")), r"\r\n?", "\n"), r"[\p{C}&&[^\n]]", "")


def clean_thai_pronoun(s: Column | str) -> Column:
    """Drop the stand-alone honorific the models overuse, then tidy blanks."""
    # Fixed pattern: the honorific between white space, quotes or brackets.
    t = F.regexp_replace(col(s), "(?<=^|[\\s\"'“”‘’()\\[\\]{}<>])นาย(?=\\s|\\z)", "")
    t = F.regexp_replace(t, r"[ \t]{2,}", " ")
    return F.regexp_replace(t, r"(?m)^[ \t]+", "")


# ---------------------------------------------------------------- prompts


def normalize_prompt(s: Column | str, max_chars: int = 8192) -> Column:
    t = trim_ws(F.regexp_replace(F.coalesce(col(s), F.lit("")), r"\r\n?", "\n"))
    return F.when(F.length(t) > max_chars, F.regexp_replace(F.left(t, F.lit(max_chars)), r"(?U)\s+$", "")).otherwise(t)


def sanitize_prompt(s: Column | str, max_chars: int = 1200) -> Column:
    t = trim_ws(F.regexp_replace(F.coalesce(col(s), F.lit("")), r"\r\n?", "\n"))
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)[\t ]+$", ""), r"\n{3,}", "\n\n")
    return F.when(F.length(t) > max_chars, F.regexp_replace(F.left(t, F.lit(max_chars)), r"(?U)\s+$", "")).otherwise(t)


def migrate_prompt_map(m: Column | str) -> Column:
    """Map to ``struct(entries, changed)``: bare language keys become ``lang::auto``; the later of equal keys wins."""
    given = F.filter(F.map_entries(col(m)), lambda e: e["value"].isNotNull() & (e["value"] != ""))

    def entry(e: Column) -> Column:
        lang = trim_ws(e["key"])
        key = F.when(F.contains(e["key"], F.lit("::")), e["key"]).otherwise(F.concat(F.when(lang == "", "en").otherwise(lang), F.lit("::auto")))
        value = normalize_prompt(e["value"])
        return F.struct(key.alias("key"), value.alias("value"), (~F.contains(e["key"], F.lit("::")) | (value != e["value"])).alias("changed"))

    all_e = F.transform(given, entry)
    keys = F.transform(given, lambda e: F.when(F.contains(e["key"], F.lit("::")), e["key"]).otherwise(F.concat(F.when(trim_ws(e["key"]) == "", "en").otherwise(trim_ws(e["key"])), F.lit("::auto"))))
    last = F.filter(all_e, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.struct(
        F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"]))).alias("entries"),
        F.exists(all_e, lambda e: e["changed"]).alias("changed"),
    )


def target_language(s: Column | str) -> Column:
    got = trim_ws(F.regexp_extract(F.coalesce(col(s), F.lit("")), r"(?im)^\s*Target\s+language\s*:\s*([^\n\r]+)", 1))
    return F.when(got != "", got).otherwise("the target language specified in the rules")


# ---------------------------------------------------------------- small helpers


def script_runs(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Runs of Thai and other characters; blanks stay with the run they follow, newlines stand alone."""
    # one class, not a choice of two: a repeated choice goes one call deeper per character, until the stack of the executor's thread ends
    pattern = "\\n|[\\u0E00-\\u0E7F][\\u0E00-\\u0E7F[\\p{IsWhite_Space}&&[^\\n]]]*|[^\\u0E00-\\u0E7F\\n]+"
    d = df.select(*keys, F.posexplode_outer(F.regexp_extract_all(F.col(text), F.lit(pattern), 0)).alias("run_no", "run")).filter(F.col("run").isNotNull())
    is_thai = F.when(F.col("run") != "\n", F.col("run").rlike("^[\\u0E00-\\u0E7F]"))
    return d.withColumn("is_thai", is_thai)


def item_text(aliases: list[Column], spans: Column) -> Column:
    """First non-empty alias, else the span texts put together."""
    return F.coalesce(*[F.when(a != "", a) for a in aliases], F.array_join(F.transform(spans, lambda s: F.coalesce(s, F.lit(""))), ""))


def html_escape(s: Column | str, quotes: bool = False, drop_cr: bool = True) -> Column:
    t = F.coalesce(col(s), F.lit(""))
    if drop_cr:
        t = F.replace(t, F.lit("\r"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.replace(t, F.lit('"'), F.lit("&quot;")) if quotes else t


def truncate(s: Column | str, n: int) -> Column:
    return F.when(F.length(col(s)) > n, F.concat(F.left(col(s), F.lit(n)), F.lit("…"))).otherwise(col(s))


def split_words(s: Column | str) -> Column:
    """Alternating blank and non-blank tokens."""
    return F.regexp_extract_all(col(s), F.lit(r"(?U)\s+|\S+"), 0)


def ordered_values(m: Column | str) -> Column:
    """Values of a map in the numeric order of its keys (text order if none is a number, as given if mixed)."""
    e = F.map_entries(col(m))
    digits = F.forall(e, lambda x: x["key"].rlike(r"^\d+$"))
    words = F.forall(e, lambda x: ~x["key"].rlike(r"^\d+$"))
    by_number = F.transform(F.array_sort(F.transform(e, lambda x, i: F.struct(x["key"].try_cast("decimal(38,0)"), i.alias("i"), x["value"].alias("value")))), lambda x: x["value"])
    by_text = F.transform(F.array_sort(F.transform(e, lambda x, i: F.struct(x["key"], i.alias("i"), x["value"].alias("value")))), lambda x: x["value"])
    return F.when(digits, by_number).when(words, by_text).otherwise(F.map_values(col(m)))
