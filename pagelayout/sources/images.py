"""Pictures and recogniser output as tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.functions.exprs import col, is_blank, once, trim_ws
from pagelayout.operators.layout import fold_angle

# MIME types by file ending.
MIME_BY_ENDING = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif", "bmp": "image/bmp", "avif": "image/avif", "svg": "image/svg+xml"}


def catalog_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files under ``path`` with name, relative path, type, size and time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    mime = F.coalesce(*[F.when(ending == e, m) for e, m in MIME_BY_ENDING.items()], F.lit("application/octet-stream"))
    root = "^(?:[a-z0-9]+:/*)?/*" + path.split(":", 1)[-1].strip("/").replace(".", r"\.") + "/"
    return files.select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.regexp_replace("path", root, "").alias("relative_path"),
        mime.alias("mime"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
    ).filter(F.col("mime").startswith("image/"))


def _padded(b64: Column) -> Column:
    filled = lambda clean: F.concat(clean, F.repeat(F.lit("="), F.pmod(4 - F.length(clean) % 4, F.lit(4)).cast("int")))
    return once(F.regexp_replace(b64, "[^A-Za-z0-9+/]", ""), filled)


def decode_data_uris(df: DataFrame, uri: str) -> DataFrame:
    """Add ``mime``, ``bytes``, ``sha256``; anything that is no data URI gives empty values."""
    # the text is trimmed once, in front of all that reads it
    d = df.withColumn("__uri", F.explode(F.array(trim_ws(F.coalesce(uri, F.lit(""))))))
    s = F.col("__uri")
    head, body = F.regexp_extract(s, "^data:([^,]*)", 1), F.regexp_extract(s, "(?s)^data:[^,]*,(.*)$", 1)
    mime = once(F.regexp_extract(head, "^([^;]*);", 1), lambda named: F.when(named == "", "application/octet-stream").otherwise(named))
    ok = s.startswith("data:")
    d = d.withColumn("bytes", F.when(ok, F.unbase64(_padded(body))).otherwise(F.lit(b"")))
    return d.withColumns({
        "mime": F.when(ok, mime).otherwise(""),
        "sha256": F.when(F.length("bytes") > 0, F.sha2("bytes", 256)).otherwise(""),
    }).drop("__uri")


def encode_data_uris(data: Column | str, mime: Column | str) -> Column:
    # Base64 comes in lines of 76 characters; a URI has none.
    return F.concat(F.lit("data:"), col(mime), F.lit(";base64,"), F.translate(F.base64(col(data)), "\r\n", ""))


def unwrap_data_uris(c: Column | str) -> Column:
    """A data URI of an image, given plainly or wrapped in base64 once more; null otherwise."""
    s = F.coalesce(col(c), F.lit(""))
    inner = F.make_valid_utf8(F.unbase64(_padded(F.translate(s, "-_", "+/"))).cast("string"))
    found = once(F.regexp_extract(inner, "(?s)(data:image.*)$", 1), lambda f: F.when(F.contains(f, F.lit("base64,")), trim_ws(f)))
    plain = s.startswith("data:image") & F.contains(s, F.lit("base64,"))
    return F.when(plain, s).otherwise(found)


# ---------------------------------------------------------------- recogniser output

# Field names of the two result shapes, best first, and the names results are wrapped in.
TEXTS, SCORES, POLYS, BOXES, WRAPPERS = ("rec_texts", "texts"), ("rec_scores", "scores"), ("rec_polys", "dt_polys", "polys"), ("rec_boxes", "boxes"), ("res", "result", "ocr_res", "data")
NESTING = 32  # levels of lists and wrappers that are opened; deeper results are rejected as a whole
STRIDE = 8  # levels that are opened at once where each holds one list and nothing else: opening a level copies what is in it


def _list(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _at(v: Column, i: int, kind: str = "variant") -> Column:
    """Element ``i`` of a list, without the rest of it."""
    return F.try_variant_get(v, f"$[{i}]", kind)


def _number(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def _said(v: Column) -> Column:
    return trim_ws(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def _corner(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _outline(v: Column) -> Column:
    """Points of a polygon, those that are none left out; null with fewer than four."""
    full = lambda plain: F.when((F.size(plain) >= 4) & F.forall(plain, lambda p: (F.size(p) >= 2) & F.get(p, F.lit(0)).isNotNull() & F.get(p, F.lit(1)).isNotNull()), plain)
    whole = once(F.try_variant_get(v, "$", "array<array<double>>"), full)  # as polygons usually are, in one step
    points = F.transform(_list(v), lambda p: _corner(_at(p, 0, "double"), _at(p, 1, "double")))
    good = once(F.filter(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), lambda some: F.when(F.size(some) >= 4, some))
    return F.coalesce(F.transform(whole, lambda p: _corner(F.get(p, F.lit(0)), F.get(p, F.lit(1)))), good)


def _upright(v: Column) -> Column:
    """Corners of a box left, top, right, bottom; null if one is missing."""
    l, t, r, b = (_at(v, i, "double") for i in range(4))
    whole = l.isNotNull() & t.isNotNull() & r.isNotNull() & b.isNotNull()
    return F.when(whole, F.array(_corner(l, t), _corner(r, t), _corner(r, b), _corner(l, b)))


def _field(v: Column, names: Sequence[str]) -> Column:
    """The first of the named lists that is there and not empty; else an empty one."""
    found = [once(F.try_variant_get(v, f"$.{n}", "array<variant>"), lambda f: F.when(F.size(f) > 0, f)) for n in names]
    return F.coalesce(*found, F.array().cast("array<variant>"))


def _has(v: Column, names: Sequence[str]) -> Column:
    """Is one of the named lists there and not empty? Looked up by its first entry, without the list."""
    first = [F.try_variant_get(v, f"$.{n}[0]", "variant").isNotNull() for n in names]
    return reduce(lambda a, b: a | b, first)


def _is_page(v: Column) -> Column:
    return _has(v, TEXTS) & (_has(v, POLYS) | _has(v, BOXES))


def _is_line(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$[1][1]", "variant").isNotNull() & _outline(_at(v, 0)).isNotNull(), F.lit(False))


def _parts(v: Column) -> Column:
    """Per box of a result that needs no more unwrapping: its text, score, polygon and rectangle, as they come."""
    names = ("t", "s", "p", "b")
    page = F.arrays_zip(*[_field(v, n).alias(x) for x, n in zip(names, (TEXTS, SCORES, POLYS, BOXES))])
    page = F.slice(page, F.lit(1), F.size(_field(v, TEXTS)))
    pair = _at(v, 1)
    none = F.lit(None).cast("variant")
    line = F.array(F.struct(_at(pair, 0).alias("t"), _at(pair, 1).alias("s"), _at(v, 0).alias("p"), none.alias("b")))
    return F.when(_is_page(v), page).otherwise(line)


def _box(x: Column) -> Column:
    shape = F.coalesce(_outline(x["p"]), _upright(x["b"]))
    corners = F.flatten(F.transform(shape, lambda p: F.array(p["x"], p["y"])))
    return F.struct(_said(x["t"]).alias("text"), F.coalesce(_number(x["s"]), F.lit(1.0)).alias("confidence"), corners.alias("corners"))


def _unwrapped(root: Column) -> Column:
    """struct<open, done>: results with their path in the JSON, and what is still wrapped after ``NESTING`` levels."""
    node = "array<struct<path:array<int>,v:variant>>"

    def inside(n: Column) -> Column:
        held = F.transform(_list(n["v"]), lambda x, i: F.struct(F.concat(n["path"], F.array(i)).alias("path"), x.alias("v")))
        named = F.array(*[F.struct(F.concat(n["path"], F.array(F.lit(i))).alias("path"), F.try_variant_get(n["v"], f"$.{w}", "variant").alias("v")) for i, w in enumerate(WRAPPERS)])
        return F.coalesce(held, named)

    def further(s: Column, tested: Column) -> Column:
        held = F.flatten(F.transform(F.filter(tested, lambda t: ~t["ends"]), lambda t: inside(t["n"])))
        held = F.filter(held, lambda n: n["v"].isNotNull() & ~F.is_variant_null(n["v"]))
        return F.struct(held.alias("open"), F.concat(s["done"], F.transform(F.filter(tested, lambda t: t["ends"]), lambda t: t["n"])).alias("done"), (s["left"] - 1).alias("left"))

    def step(s: Column, _: Column) -> Column:
        # a line is a list and a page is none, so the eight names of a page are not looked up in every line
        tested = F.transform(s["open"], lambda n: F.struct(n.alias("n"), (_is_line(n["v"]) | _is_page(n["v"])).alias("ends")))
        by_one = once(tested, lambda t: further(s, t))
        only = F.get(s["open"], F.lit(0))

        def deeper(v: Column) -> Column:
            there = F.struct(F.concat(only["path"], F.array_repeat(F.lit(0), STRIDE)).alias("path"), v.alias("v"))
            moved = F.struct(F.array(there).alias("open"), s["done"].alias("done"), (s["left"] - STRIDE).alias("left"))
            return F.when(v.isNotNull() & ~F.is_variant_null(v), moved).otherwise(by_one)

        # a list of one element is neither a line nor a page
        alone = reduce(lambda a, b: a & b, [F.try_variant_get(only["v"], "$" + "[0]" * i + "[1]", "variant").isNull() for i in range(STRIDE)])
        nested = (F.size(s["open"]) == 1) & (s["left"] >= STRIDE) & alone
        at_once = once(F.try_variant_get(only["v"], "$" + "[0]" * STRIDE, "variant"), deeper)
        return F.when((F.size(s["open"]) > 0) & (s["left"] > 0), F.when(nested, at_once).otherwise(by_one)).otherwise(s)

    first = F.array(F.struct(F.array().cast("array<int>").alias("path"), root.alias("v"))).cast(node)
    return F.aggregate(F.sequence(F.lit(1), F.lit(NESTING)), F.struct(first.alias("open"), F.array().cast(node).alias("done"), F.lit(NESTING).alias("left")), step)


# Plain results, as recognisers usually write them, are read by type in one pass; every other one goes through the variant. Both give the same boxes.
_NUMBER = r"(-?(?:0|[1-9]\d*+)(?:\.\d++)?(?:[eE][+-]?\d++)?)"
_POINT = rf"\[{_NUMBER}, ?{_NUMBER}\]"
# A text with something in it: what stands first, behind white space, is neither its end nor an escape that may be white space.
_PLAIN = r'[^"\\\x00-\x1f]*+'
_TEXT = rf'("(?=(?U:\s)*+(?!\\[nrtfu])(?U:[^\s"])){_PLAIN}(?:\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{{4}}){_PLAIN}){{0,99}}+")'
_PLAIN_LINE = rf"\[\[{_POINT}, ?{_POINT}, ?{_POINT}, ?{_POINT}\], ?\[{_TEXT}, ?{_NUMBER}\]\]"
_BOX = "struct<text:string,confidence:double,corners:array<double>>"


def _steady_signs(raw: Column) -> Column:
    """No number may be a negative zero, whose sign a variant loses."""
    return ~(F.contains(raw, F.lit("-0")) & raw.rlike(r"-0[.0]*[^.0-9]"))


PLAIN_LENGTH = 1 << 22  # a variant of longer JSON may be larger than variants can be


def _lines_only(raw: Column) -> Column:
    """Is this a list that holds one list of plain lines, and so valid JSON?"""
    return F.regexp_replace(raw, _PLAIN_LINE, "0").rlike(r"^\[\[(?:0(?:, ?0)*+)?\]\]\z")


def _plain_lines(raw: Column) -> Column:
    """Boxes of valid JSON that is lists of plain lines; null for all else."""
    typed = F.regexp_replace(raw, _PLAIN_LINE, '{"text":$9,"confidence":$10,"corners":[$1,$2,$3,$4,$5,$6,$7,$8]}')
    read = F.from_json(F.concat(F.lit('{"v":'), typed, F.lit("}")), f"struct<v:array<array<{_BOX}>>,_corrupt_record:string>")
    own = F.contains(raw, F.lit("{")) & raw.rlike(r"[\[,]\s*+\{")  # an object among the lines is no line
    return F.when(~own, once(read, lambda r: F.when(r["_corrupt_record"].isNull(), F.array_compact(F.flatten(r["v"])))))


def _plain_page(v: Column, raw: Column) -> Column:
    """Boxes of valid JSON that is one page of texts, bare or in one wrapper, each text with a whole box and none blank; null for all else."""
    lists = ",".join([f"{n}:array<double>" for n in SCORES] + [f"{n}:array<array<array<double>>>" for n in POLYS] + [f"{n}:array<array<double>>" for n in BOXES])
    read = F.from_json(raw, f"struct<{lists},{','.join(f'{w}:struct<{lists}>' for w in WRAPPERS)},_corrupt_record:string>")
    first = lambda held: F.coalesce(*[F.when(F.size(x) > 0, x) for x in held])

    def texts(at: str) -> Column:
        # as the variant gives them: a number is a text too
        return first([F.try_variant_get(v, f"$.{at}{n}", "array<string>") for n in TEXTS])

    def boxes(p: Column) -> Column:
        shown = lambda t: t.isNotNull() & (((t >= "!") & (t < "\x7f")) | ~is_blank(t))
        whole = F.forall(p["t"], shown) & F.forall(p["b"], lambda b: F.coalesce((F.size(b) == 4) & (F.size(F.array_compact(b)) == 4), F.lit(False)))
        n = F.size(p["t"])
        zipped = F.arrays_zip(p["t"].alias("text"), F.slice(F.coalesce(p["s"], F.array().cast("array<double>")), F.lit(1), n).alias("confidence"), F.slice(p["b"], F.lit(1), n).alias("corners"))
        return F.when((n <= F.size(p["b"])) & whole, zipped)

    def page(r: Column) -> Column:
        none = first([r[n] for n in POLYS]).isNull()
        return F.when(none, F.struct(first([r[n] for n in SCORES]).alias("s"), first([r[n] for n in BOXES]).alias("b")))

    def chosen(r: Column) -> Column:
        bare = reduce(lambda a, b: a & b, [r[w].isNull() for w in WRAPPERS])
        alone = [reduce(lambda a, b: a & b, [r[o].isNull() for o in WRAPPERS if o != w], r[w].isNotNull()) for w in WRAPPERS]
        named = lambda at, p: once(p, lambda x: F.struct(texts(at).alias("t"), x["s"].alias("s"), x["b"].alias("b")))
        found = F.when(bare, named("", page(r)))
        for w, only in zip(WRAPPERS, alone):
            found = found.when(only & ~_is_page(v), named(f"{w}.", page(r[w])))
        return once(F.when(r["_corrupt_record"].isNull(), found), boxes)

    return F.when(F.substring(F.ltrim(raw), 1, 1) == "{", once(read, chosen))


def _results(df: DataFrame, raw: str) -> DataFrame:
    """(image_id, raw) of results that are not blank; exploding keeps filters from making a result again."""
    return df.select("image_id", F.explode(F.array(F.col(raw))).alias("raw")).filter(F.col("raw").rlike(r"(?U)\S"))


def ingest_ocr_boxes(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Recogniser results (image_id, JSON text) to box rows, numbered in the order of the JSON; ``ocr_rejects`` has what cannot be read.

    A box needs a text and a polygon of four points, or else a rectangle; points that are none are passed over; scores that are none count as 1.
    """
    v, text = F.col("__v"), F.col("raw")
    d = _results(df, raw).select("image_id", "raw", F.explode(F.array(F.try_parse_json("raw"))).alias("__v")).filter(v.isNotNull())
    kind = f"array<{_BOX}>"
    plain = F.when(_steady_signs(text), F.coalesce(_plain_lines(text).cast(kind), _plain_page(v, text).cast(kind)))

    def in_order(u: Column) -> Column:
        nodes = F.array_sort(u["done"], lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))
        made = F.transform(F.flatten(F.transform(nodes, lambda n: _parts(n["v"]))), _box)
        return F.when(F.size(u["open"]) == 0, F.filter(made, lambda x: (x["text"] != "") & x["corners"].isNotNull()).cast(kind))

    d = d.select("image_id", F.posexplode(F.coalesce(plain, once(_unwrapped(v), in_order))).alias("box_id", "x"))  # made once per result, by the explode
    d = d.select("image_id", F.col("box_id").cast("long").alias("box_id"), F.col("x.text").alias("__said"), F.coalesce("x.confidence", F.lit(1.0)).alias("confidence"), F.col("x.corners").alias("__held"))
    # mostly there is nothing to be trimmed: both ends are visible ASCII characters
    ends = [F.substring("__said", 1, 1), F.substring("__said", -1, 1)]
    d = d.withColumn("text", F.when(reduce(lambda a, b: a & b, [(e >= "!") & (e < "\x7f") for e in ends]), F.col("__said")).otherwise(trim_ws("__said")))
    # a rectangle goes around from its left upper corner, as a polygon does
    l, t, r, b = (F.get("__held", F.lit(i)) for i in range(4))
    d = d.withColumn("__at", F.when(F.size("__held") == 4, F.array(l, t, r, t, r, b, l, b)).otherwise(F.col("__held")))
    at = [F.get("__at", F.lit(i)) for i in range(8)]
    four = F.size("__at") == 8
    points = F.transform(F.sequence(F.lit(0), F.size("__at") - 2, F.lit(2)), lambda i: _corner(F.get("__at", i), F.get("__at", i + 1)))
    d = d.withColumn("poly", F.when(four, F.array(*[_corner(at[i], at[i + 1]) for i in range(0, 8, 2)])).otherwise(points))
    for name, most, end, i in (("l", F.least, F.array_min, 0), ("t", F.least, F.array_min, 1), ("r", F.greatest, F.array_max, 0), ("b", F.greatest, F.array_max, 1)):
        d = d.withColumn(name, F.when(four, most(*at[i::2])).otherwise(end(f"poly.{'xy'[i]}")))
    d = d.withColumn("__deg", F.degrees(F.atan2(at[3] - at[1], at[2] - at[0]))).withColumn("angle_deg", fold_angle(F.col("__deg")))
    return d.select("image_id", "box_id", "text", "confidence", "poly", "l", "t", "r", "b", "angle_deg")


def ocr_rejects(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Results that ``ingest_ocr_boxes`` cannot read: image_id, raw, reason. Null and blank results are no results."""
    text = F.col("raw")
    # what is no plain list of lines is parsed, and opened level by level
    opened = once(F.try_parse_json(text), lambda v: F.when(v.isNull(), F.lit(-1)).otherwise(F.size(_unwrapped(v)["open"])))
    left = F.when((F.octet_length(text) < PLAIN_LENGTH) & _lines_only(text), F.lit(0)).otherwise(opened)
    d = _results(df, raw).select("image_id", "raw", F.explode(F.array(left)).alias("__left")).filter("__left <> 0")
    return d.select("image_id", "raw", F.when(F.col("__left") < 0, "no JSON").otherwise("nested too deep").alias("reason"))


# ---------------------------------------------------------------- row statistics

PROFILE_WIDTH = 640


def _narrow(gray: np.ndarray) -> np.ndarray:
    """Shrink to PROFILE_WIDTH columns with a triangle filter as wide as the scale."""
    w = gray.shape[1]
    scale = w / PROFILE_WIDTH
    centre = (np.arange(PROFILE_WIDTH) + 0.5) * scale
    weight = np.clip(1.0 - np.abs(np.arange(w)[:, None] + 0.5 - centre[None, :]) / scale, 0.0, None)
    return np.rint(gray @ (weight / weight.sum(axis=0))).astype(np.int16)


def profile_of(gray: np.ndarray) -> pd.DataFrame | None:
    """Per row: change from the row above, change along the row, spread, share of dark pixels."""
    if gray.shape[1] > PROFILE_WIDTH:
        gray = _narrow(gray)
    if gray.ndim != 2 or gray.shape[0] < 4:
        return None
    g = gray.astype(np.int16)
    dy = np.abs(np.diff(g, axis=0)).mean(axis=1)
    return pd.DataFrame({
        "y": np.arange(g.shape[0], dtype=np.int64), "dy": np.concatenate([dy[:1], dy]), "dx": np.abs(np.diff(g, axis=1)).mean(axis=1) if g.shape[1] > 1 else 0.0,
        "std": g.std(axis=1), "dark": (g < 45).mean(axis=1),
    })


def row_profile(images: DataFrame) -> DataFrame:
    """Row statistics of decoded pictures (rows of the built-in image source)."""
    schema = "image_id string, y long, dy double, dx double, std double, dark double"
    d = images.select(F.col("image.origin").alias("image_id"), F.col("image.width").alias("w"), F.col("image.height").alias("h"), F.col("image.nChannels").alias("c"), F.col("image.data").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                px = np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.c).astype(np.int64)
                # Integer luma of blue, green, red samples.
                gray = px[:, :, 0] if r.c == 1 else (px[:, :, 2] * 19595 + px[:, :, 1] * 38470 + px[:, :, 0] * 7471 + 32768) >> 16
                rows = profile_of(gray)
                if rows is not None:
                    yield rows.assign(image_id=r.image_id)[["image_id", "y", "dy", "dx", "std", "dark"]]

    return d.mapInPandas(run, schema)
