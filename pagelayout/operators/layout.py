"""Boxes to lines, lines to paragraphs, paragraphs to page text.

Everything is keyed by ``image_id``.  A page is settled in the task that has its boxes; only a page that holds more than
a task's fair share of all boxes is spread over its height by scans over ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.functions.exprs import is_blank, once, steady, trim_ws
from pagelayout.operators.folds import ordered_label
from pagelayout.operators.scans import SAMPLE, group_stats, large_keys, ordered_scan, ranged, unranged

MIN_CONFIDENCE = 0.35
LINE_REACH = 0.55
SLACK = 1e-6


# ---------------------------------------------------------------- boxes


def filter_boxes(boxes: DataFrame, min_conf: float = MIN_CONFIDENCE) -> DataFrame:
    """Drop unsure boxes, clamp the rest into the page (``w``, ``h``), drop what is under 2 px. Polygons stay."""

    def clamp(c: str, hi: str) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.col(c), F.col(hi).cast("double")))

    kept = boxes.filter(F.col("confidence") >= F.lit(float(min_conf)))
    clamped = kept.withColumns({"l": clamp("l", "w"), "r": clamp("r", "w"), "t": clamp("t", "h"), "b": clamp("b", "h")})
    return clamped.filter((F.col("r") - F.col("l") >= 2.0) & (F.col("b") - F.col("t") >= 2.0))


def resize_plan(images: DataFrame, max_side: int) -> DataFrame:
    """Recognition size and the factors back to the original size."""
    longest = F.greatest("w", "h")
    ratio = F.try_divide(F.lit(float(max_side)), longest.cast("double"))
    shrink = (F.lit(max_side) > 0) & (longest > max_side)

    def dim(c: str) -> Column:
        return F.when(shrink, F.greatest(F.lit(1.0), F.rint(F.col(c) * ratio))).otherwise(F.col(c)).cast("int")

    out = images.withColumns({"ocr_w": dim("w"), "ocr_h": dim("h"), "resized": shrink})
    return out.withColumns({
        "scale_x": F.when(shrink, F.col("w") / F.col("ocr_w").cast("double")).otherwise(1.0),
        "scale_y": F.when(shrink, F.col("h") / F.col("ocr_h").cast("double")).otherwise(1.0),
    })


def fold_angle(deg: Column) -> Column:
    """Wrap to (-180, 180], then fold to [-90, 90]."""
    wrapped = F.when(deg <= -180.0, deg + 360.0).when(deg > 180.0, deg - 360.0).otherwise(deg)
    return F.when(wrapped < -90.0, wrapped + 180.0).when(wrapped > 90.0, wrapped - 180.0).otherwise(wrapped)


def poly_angle(poly: Column) -> Column:
    """Direction of the polygon's first edge in degrees; 0 for fewer than two points."""

    def angle(p: Column) -> Column:
        a, b = F.get(p, 0), F.get(p, 1)
        return F.when(F.size(p) >= 2, once(F.degrees(F.atan2(b["y"] - a["y"], b["x"] - a["x"])), fold_angle)).otherwise(0.0)

    return once(poly, angle)


def scale_boxes(boxes: DataFrame, sx: str = "scale_x", sy: str = "scale_y") -> DataFrame:
    """Scale box and polygon; the angle follows the scaled polygon where there is one."""
    x, y = F.col(sx), F.col(sy)
    same = (x == 1.0) & (y == 1.0)
    scaled = F.transform("poly", lambda p: F.struct((p["x"] * x).alias("x"), (p["y"] * y).alias("y")))
    out = boxes.withColumns({"l": F.col("l") * x, "r": F.col("r") * x, "t": F.col("t") * y, "b": F.col("b") * y, "poly": scaled})
    return out.withColumn("angle_deg", F.when(~same & (F.size("poly") > 0), poly_angle(F.col("poly"))).otherwise(F.col("angle_deg")))


def normalize_box(l: Column, t: Column, r: Column, b: Column, w: Column, h: Column, angle: Column) -> Column:
    """Box node in page fractions; sides are at least one pixel."""
    bw, bh = F.greatest(F.lit(1.0), r - l), F.greatest(F.lit(1.0), b - t)
    return F.struct(
        (l / w).alias("left"),
        (t / h).alias("top"),
        (bw / w).alias("width"),
        (bh / h).alias("height"),
        angle.alias("rotation_deg"),
        F.struct(((l + bw / 2.0) / w).alias("x"), ((t + bh / 2.0) / h).alias("y")).alias("center"),
    )


# ---------------------------------------------------------------- lines


def _line_labels():
    """First line, in order of creation, whose running mean centre is near enough takes the box.

    Boxes arrive by centre.  A line whose centre lies further above than the tallest box of the island can
    reach will never match again and is let go, so the state stays as small as the lines side by side.
    """
    lines: list[list[float]] = []
    made = 0

    def step(row: tuple) -> int:
        nonlocal lines, made
        cy, h, tallest = row
        live, hit = [], -1
        for line in lines:
            number, n, sum_cy, sum_h = line
            mean_cy, mean_h = sum_cy / n, sum_h / n
            if hit < 0 and abs(cy - mean_cy) <= max(h, mean_h) * LINE_REACH:
                line[1:] = [n + 1, sum_cy + cy, sum_h + h]
                hit = int(number)
                live.append(line)
            elif cy - mean_cy <= tallest * LINE_REACH * 1.001:
                live.append(line)
        if hit < 0:
            hit = made
            made += 1
            live.append([hit, 1, cy, h])
        lines = live
        return hit

    return step


LINE = ["__top", "__island", "__sub"]


def _centred(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"__cy": (F.col("t") + F.col("b")) / 2.0, "__h": F.greatest(F.lit(1.0), F.col("b") - F.col("t"))})


def large_pages(boxes: DataFrame) -> DataFrame | None:
    """Pages that are cut in ranges of their height, for all steps from boxes to lines."""
    return large_keys(_centred(boxes), ["image_id"], ["__cy", "l", "box_id"])


def box_lines(boxes: DataFrame, large: DataFrame | None) -> DataFrame:
    """Boxes with the line they are in: its top edge, island and place in the island.

    The rule is sequential (first match against running means), but a page falls apart exactly where no box
    below can reach any line above: those *islands* are found with ordered scans.  An island flatter than the
    reach of its smallest box is one line by itself; only the others are folded in Python.
    """
    slack = SLACK
    cy, h = F.col("__cy"), F.col("__h")
    keys, order = ["image_id"], ["__cy", "l", "box_id"]
    d = ranged(_centred(boxes), keys, order, large)
    d = ordered_scan(
        d, keys, order, large=large,
        maxs={"__down": cy + h * LINE_REACH + slack},
        suffix_mins={"__up": cy - h * LINE_REACH - slack},
        lags={"__prev": cy},
    )
    first = F.col("__prev").isNull() | ((cy > F.col("__down")) & (F.col("__up") > F.col("__prev")))
    d = d.withColumn("__start", F.when(first, 1).otherwise(0)).drop("__down", "__up", "__prev")
    d = ordered_scan(d, keys, order, large=large, sums={"__island": F.col("__start")})
    d = d.withColumn("__island", F.col("__island") + F.col("__start")).drop("__start")
    d = group_stats(d, keys, ["__island"], {"__low": ("min", cy), "__high": ("max", cy), "__least": ("min", h), "__tallest": ("max", h), "__top": ("min", F.col("t"))}, large)
    d = unranged(d)
    flat = F.col("__high") - F.col("__low") <= F.col("__least") * LINE_REACH - slack
    easy = d.filter(flat).withColumn("__sub", F.lit(0).cast("long"))
    hard = ordered_label(d.filter(~flat), ["image_id", "__island"], order, ["__cy", "__h", "__tallest"], _line_labels, "__sub")
    hard = hard.withColumn("__top", F.min("t").over(W.partitionBy("image_id", "__island", "__sub")))
    return easy.unionByName(hard).drop("__low", "__high", "__least", "__tallest", "__h")


def group_lines(boxes: DataFrame, large: DataFrame | str | None = SAMPLE) -> DataFrame:
    """Add ``line_no`` (reading order, 0-based) to filtered boxes. ``large``: the ``large_pages`` where they are known."""
    if isinstance(large, str):
        large = large_pages(boxes)
    if large is None:
        return _whole_pages(boxes)
    huge, rest = split_pages(boxes, large)
    return _spread_pages(huge, large).unionByName(_whole_pages(rest))


def split_pages(boxes: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boxes of the pages that are cut in ranges, and of all others."""
    d, keys = boxes.withColumn("__key", F.struct("image_id")), F.broadcast(large.select("__key"))
    return tuple(d.join(keys, "__key", how).select(*boxes.columns) for how in ("left_semi", "left_anti"))


def _numbered(page: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Places of a page's boxes by centre, and the line of each: islands by running bounds, as in ``box_lines``; only tangled ones go box by box."""
    t, b = (page.column(c).to_numpy().astype("float64") for c in "tb")
    cy, h = (t + b) / 2.0, np.maximum(1.0, b - t)
    places = pa.table({"cy": cy, "l": page.column("l"), "box_id": page.column("box_id")})
    order = pc.sort_indices(places, sort_keys=[(c, "ascending") for c in places.column_names], null_placement="at_start").to_numpy()
    t, cy, h = t[order], cy[order], h[order]
    down = np.maximum.accumulate(cy + h * LINE_REACH + SLACK)
    up = np.minimum.accumulate((cy - h * LINE_REACH - SLACK)[::-1])[::-1]
    first = np.ones(len(cy), bool)
    first[1:] = (cy[1:] > down[:-1]) & (up[1:] > cy[:-1])
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(cy))
    flat = cy[ends - 1] - cy[starts] <= np.minimum.reduceat(h, starts) * LINE_REACH - SLACK
    sub, lines = np.zeros(len(cy), "int64"), np.ones(len(starts), "int64")
    for k in np.flatnonzero(~flat):
        lo, hi = starts[k], ends[k]
        step, tallest = _line_labels(), float(h[lo:hi].max())
        sub[lo:hi] = [step((y, tall, tallest)) for y, tall in zip(cy[lo:hi].tolist(), h[lo:hi].tolist())]
        lines[k] = sub[lo:hi].max() + 1
    line = np.repeat(np.cumsum(lines) - lines, ends - starts) + sub
    top = np.full(lines.sum(), np.inf)
    np.minimum.at(top, line, t)
    rank = np.empty(len(top), "int64")
    rank[np.argsort(top, kind="stable")] = np.arange(len(top))
    return order, rank[line]


def _with_lines(page: pa.Table) -> pa.Table:
    order, line = _numbered(page)
    number = np.empty(len(order), "int64")
    number[order] = line
    return page.append_column("line_no", pa.array(number))


def _whole_pages(boxes: DataFrame) -> DataFrame:
    """``group_lines`` of pages that fit in a task: one grouping of the boxes, which moves nothing if they lie by page already."""
    schema = T.StructType([*boxes.schema.fields, T.StructField("line_no", T.LongType())])
    return boxes.groupBy("image_id").applyInArrow(_with_lines, schema)


def _whole_page_lines(boxes: DataFrame, sums: Sequence[str]) -> DataFrame:
    """``line_table`` of pages that fit in a task: a page's boxes become its lines where they lie, so only lines are moved."""
    own = {f.name: f.dataType for f in boxes.schema.fields}

    def total(values: pa.ChunkedArray, at: np.ndarray) -> pa.Array:
        some = np.add.reduceat(pc.is_valid(values).to_numpy().astype("int64"), at) > 0
        return pa.array(np.add.reduceat(values.fill_null(0.0).to_numpy().astype("float64"), at), mask=~some)

    def lines(page: pa.Table) -> pa.Table:
        order, line = _numbered(page)
        # lines in the order of the page, boxes of a line from left to right
        places = pa.table({"line": line, "l": page.column("l").take(order), "at": np.arange(len(order))})
        by_line = pc.sort_indices(places, sort_keys=[(c, "ascending") for c in places.column_names]).to_numpy()
        page, line = page.take(order[by_line]), line[by_line]
        starts = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        sizes = np.diff(np.append(starts, len(line)))
        value = {c: page.column(c).to_numpy() for c in "ltrb"}
        out = {"image_id": page.column("image_id").take(starts), "line_no": line[starts]}
        out |= {c: np.minimum.reduceat(value[c], starts) for c in "lt"} | {c: np.maximum.reduceat(value[c], starts) for c in "rb"}
        out["angle_deg"] = np.add.reduceat(page.column("angle_deg").fill_null(0.0).to_numpy().astype("float64"), starts) / sizes
        words = page.column("text").combine_chunks()
        out["words"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(line)), pa.int32()), words)
        out["n_boxes"] = sizes
        return pa.table(out | {c: total(page.column(c), starts) for c in sums})

    kinds = {"image_id": own["image_id"], "line_no": T.LongType(), **{c: own[c] for c in "ltrb"}, "angle_deg": T.DoubleType()}
    kinds |= {"words": T.ArrayType(T.StringType()), "n_boxes": T.LongType(), **{c: T.DoubleType() for c in sums}}
    d = boxes.groupBy("image_id").applyInArrow(lines, T.StructType([T.StructField(c, k) for c, k in kinds.items()]))
    texts = F.transform("words", lambda w: trim_ws(F.coalesce(w, F.lit(""))))
    text = F.array_join(F.filter(texts, lambda w: w != ""), " ")
    return d.select(*[text.alias("text") if c == "words" else c for c in kinds])


def _spread_pages(boxes: DataFrame, large: DataFrame) -> DataFrame:
    """``group_lines`` of pages that are cut in ranges."""
    order = [*LINE, "__cy", "l", "box_id"]
    d = ranged(box_lines(boxes, large), ["image_id"], order, large, at=F.col("__top"))
    d = ordered_scan(d, ["image_id"], order, large=large, lags={"__before": F.struct(*LINE)})
    d = d.withColumn("__new", F.when(F.col("__before").eqNullSafe(F.struct(*LINE)), 0).otherwise(1)).drop("__before")
    d = ordered_scan(d, ["image_id"], order, large=large, sums={"line_no": F.col("__new")})
    d = d.withColumn("line_no", (F.col("line_no") + F.col("__new") - 1).cast("long"))
    return unranged(d).drop(*LINE, "__cy", "__new")


def reading_order(boxes_with_lines: DataFrame, large: DataFrame | str | None = SAMPLE) -> DataFrame:
    """Position of each box on its page: line by line, left to right. ``large``: None where it is known that no page is large."""
    cy = (F.col("t") + F.col("b")) / 2.0
    d = boxes_with_lines.withColumn("__cy", cy)
    return ordered_scan(d, ["image_id"], ["line_no", "l", "__cy", "box_id"], large=large, number="position").drop("__cy")


def line_table(boxes_with_lines: DataFrame, line: Sequence[str] = ("line_no",), more: Sequence[Column] = ()) -> DataFrame:
    """One row per line: bounds, joined text, mean box angle, and aggregates asked for in ``more``."""
    cy = (F.col("t") + F.col("b")) / 2.0
    words = F.array_sort(F.collect_list(F.struct("l", cy.alias("cy"), "box_id", trim_ws(F.coalesce("text", F.lit(""))).alias("s"))))
    return boxes_with_lines.groupBy("image_id", *line).agg(
        F.min("l").alias("l"),
        F.min("t").alias("t"),
        F.max("r").alias("r"),
        F.max("b").alias("b"),
        F.avg(F.coalesce("angle_deg", F.lit(0.0))).alias("angle_deg"),
        F.array_join(F.transform(F.filter(words, lambda x: x["s"] != ""), lambda x: x["s"]), " ").alias("text"),
        F.count(F.lit(1)).alias("n_boxes"),
        *more,
    )


def line_angle(boxes_with_lines: DataFrame) -> DataFrame:
    return boxes_with_lines.groupBy("image_id", "line_no").agg(F.avg(F.coalesce("angle_deg", F.lit(0.0))).alias("angle_deg"))


# ---------------------------------------------------------------- paragraphs


def _paragraphs(lines: DataFrame, large: DataFrame | None) -> DataFrame:
    """``group_paragraphs`` on ranged lines."""
    keep = lines.columns
    d = ordered_scan(lines, ["image_id"], ["line_no"], large=large, lags={"__p": F.struct("l", "r", "b")})
    p = F.col("__p")
    height = F.greatest(F.lit(1.0), F.col("b") - F.col("t"))
    overlap = F.greatest(F.lit(0.0), F.least("r", p["r"]) - F.greatest("l", p["l"]))
    narrow = F.greatest(F.lit(1.0), F.least(F.col("r") - F.col("l"), p["r"] - p["l"]))
    same = (F.col("t") - p["b"] <= height * 0.95) & (overlap / narrow >= 0.20)
    d = d.withColumn("__new", F.when(p.isNull() | ~same, 1).otherwise(0)).select(*keep, "__new")
    start_no = F.when(F.col("__new") == 1, F.col("line_no"))
    d = ordered_scan(d, ["image_id"], ["line_no"], large=large, sums={"__n": F.col("__new")}, lasts={"__start": start_no})
    return d.select(
        *keep,
        (F.col("__n") + F.col("__new") - 1).cast("int").alias("para_index"),
        (F.col("line_no") - F.col("__start")).cast("int").alias("item_index"),
    )


def _offsets(lines: DataFrame, large: DataFrame | None) -> DataFrame:
    """``text_offsets`` on ranged lines."""
    room = F.when(is_blank("text"), 0).otherwise(F.length("text") + 2)
    d = ordered_scan(lines, ["image_id"], ["line_no"], large=large, sums={"start_raw": room})
    return d.withColumns({
        "start_raw": F.col("start_raw").cast("int"),
        "end_raw": (F.col("start_raw") + F.when(is_blank("text"), 0).otherwise(F.length("text"))).cast("int"),
    })


def _by_line(lines: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    large = large_keys(lines, ["image_id"], ["line_no"])
    return ranged(lines, ["image_id"], ["line_no"], large), large


def group_paragraphs(lines: DataFrame) -> DataFrame:
    """Add ``para_index`` and ``item_index``: a line joins the paragraph of the line before it if near and overlapping."""
    return unranged(_paragraphs(*_by_line(lines)))


def text_offsets(lines: DataFrame) -> DataFrame:
    """Add ``start_raw``/``end_raw`` over the page text; blank lines take no room."""
    return unranged(_offsets(*_by_line(lines)))


def paragraph_table(lines: DataFrame) -> DataFrame:
    """One row per paragraph from lines that carry paragraph and offset columns."""
    full = ~is_blank("text")
    texts = F.array_sort(F.collect_list(F.when(full, F.struct("item_index", "text"))))
    return lines.groupBy("image_id", "para_index").agg(
        F.coalesce(F.min(F.when(full, F.col("start_raw"))), F.min("start_raw")).alias("start_raw"),
        F.coalesce(F.max(F.when(full, F.col("end_raw"))), F.min("start_raw")).alias("end_raw"),
        trim_ws(F.array_join(F.transform(texts, lambda x: x["text"]), "\n")).alias("text"),
        F.min(F.when(full, F.col("l"))).alias("l"),
        F.min(F.when(full, F.col("t"))).alias("t"),
        F.max(F.when(full, F.col("r"))).alias("r"),
        F.max(F.when(full, F.col("b"))).alias("b"),
        F.sum(F.when(full, 1).otherwise(0)).alias("n_items"),
    ).withColumn("valid_text", F.col("text") != "")


def lines_to_items(lines: DataFrame, side: str = "original") -> DataFrame:
    """Item rows (with box node and baseline) from lines carrying ``w``/``h``; blank lines are skipped."""
    base = (F.col("t") + (F.col("b") - F.col("t")) * 0.80) / F.col("h")
    return lines.filter(~is_blank("text")).select(
        "image_id",
        F.lit(side).alias("side"),
        "para_index",
        "item_index",
        "text",
        "start_raw",
        "end_raw",
        normalize_box(F.col("l"), F.col("t"), F.col("r"), F.col("b"), F.col("w"), F.col("h"), F.col("angle_deg")).alias("box"),
        F.struct((F.col("l") / F.col("w")).alias("x"), base.alias("y")).alias("p1"),
        F.struct((F.col("r") / F.col("w")).alias("x"), base.alias("y")).alias("p2"),
        ((F.col("b") - F.col("t")) / F.col("h")).alias("height_raw"),
        "l", "t", "r", "b",
    )


def items_to_spans(items: DataFrame) -> DataFrame:
    """Local recognition has one span per line that covers all of it."""
    return items.select(
        "image_id", "side", "para_index", "item_index", F.lit(0).alias("span_index"), "text", "start_raw", "end_raw",
        F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), "box", "p1", "p2", "height_raw", F.lit(True).alias("valid_text"),
    )


def page_text(paras: DataFrame, items: DataFrame | None = None, raw: DataFrame | None = None) -> DataFrame:
    """Paragraph texts joined by blank lines; blank paragraphs fall back to their items, pages to raw text."""
    p = paras.select("image_id", "para_index", trim_ws(F.coalesce("text", F.lit(""))).alias("text"))
    if items is not None:
        it = items.select("image_id", "para_index", "item_index", trim_ws(F.coalesce("text", F.lit(""))).alias("s")).filter("s <> ''")
        joined = it.groupBy("image_id", "para_index").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_index", "s"))), lambda x: x["s"]), " ").alias("__items")
        )
        p = p.join(joined, ["image_id", "para_index"], "left").select(
            "image_id", "para_index", F.when(F.col("text") == "", F.coalesce("__items", F.lit(""))).otherwise(F.col("text")).alias("text")
        )
    pages = p.groupBy("image_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_index", "text"))), lambda x: x["text"]), "\n\n").alias("page_text"),
        F.count(F.lit(1)).alias("n_paras"),
    )
    if raw is not None:
        pages = raw.select("image_id", "raw_text").join(pages, "image_id", "left").select(
            "image_id", F.coalesce("page_text", "raw_text").alias("page_text"), F.coalesce("n_paras", F.lit(0)).alias("n_paras")
        )
    return pages


# ---------------------------------------------------------------- statistics and nesting


def layout_stats(paras: DataFrame, items: DataFrame, spans: DataFrame) -> DataFrame:
    """Paragraph, item and span counts per page side."""
    keys = ["image_id", "side"]
    tagged = [df.select(*keys, F.lit(tag).alias("kind")) for df, tag in ((paras, "p"), (items, "i"), (spans, "s"))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).groupBy(*keys).agg(
        F.count_if(F.col("kind") == "p").alias("paras"),
        F.count_if(F.col("kind") == "i").alias("items"),
        F.count_if(F.col("kind") == "s").alias("spans"),
    )


def pick_template(stats: DataFrame) -> DataFrame:
    """Which side gives the template: original only if it scores strictly higher."""
    score = F.when(F.col("paras") > 0, F.col("items") * 10000 + F.col("paras") * 100 + F.col("spans")).otherwise(-1)
    s = stats.withColumn("score", score).groupBy("image_id").agg(
        F.coalesce(F.max(F.when(F.col("side") == "original", F.col("score"))), F.lit(-1)).alias("original_score"),
        F.coalesce(F.max(F.when(F.col("side") == "translated", F.col("score"))), F.lit(-1)).alias("translated_score"),
    )
    o, t = F.col("original_score"), F.col("translated_score")
    return s.withColumn("template", F.when((o < 0) & (t < 0), F.lit(None).cast("string")).when(o > t, "original").otherwise("translated"))


def paragraph_bounds(paras: DataFrame, items: DataFrame, spans: DataFrame) -> DataFrame:
    """Pixel bounds of a paragraph, from its own bounds if valid, else from its item and span boxes."""
    keys = ["image_id", "para_index"]
    rects = []
    for df in (items, spans):
        l, t = F.col("left") * F.col("w"), F.col("top") * F.col("h")
        r = l + F.greatest(F.lit(0.0), F.col("width") * F.col("w"))
        b = t + F.greatest(F.lit(0.0), F.col("height") * F.col("h"))
        rects.append(df.select(*keys, l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b")).filter("r > l and b > t"))
    u = rects[0].unionByName(rects[1]).groupBy(*keys).agg(
        F.min("l").alias("ul"), F.min("t").alias("ut"), F.max("r").alias("ur"), F.max("b").alias("ub")
    )
    ok = F.coalesce((F.col("r") > F.col("l")) & (F.col("b") > F.col("t")), F.lit(False))
    j = paras.join(u, keys, "left")
    return j.select(*keys, *[F.when(ok, F.col(c)).otherwise(F.col("u" + c)).alias(c) for c in "ltrb"])


def ocr_quality(tile_metas: DataFrame) -> DataFrame:
    """Recognition quality of a page from its strips."""
    n = F.sum("boxes")
    return tile_metas.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("tiles"),
        F.sum("raw_boxes").alias("raw_boxes"),
        n.alias("boxes"),
        F.sum("paragraphs").alias("paragraphs"),
        F.when(n > 0, steady(F.try_divide(F.sum(F.col("avg_confidence") * F.col("boxes")), n.cast("double")))).otherwise(0.0).alias("avg_confidence"),
        F.coalesce(F.min_by("lang", F.when(F.coalesce(F.col("lang"), F.lit("")) != "", F.col("tile_no"))), F.lit("")).alias("lang"),
        F.count_if("resized").alias("resized_tiles"),
    )


def explode_layout(trees: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nested layout rows (``image_id, side, paragraphs array``) to paragraph, item and span rows.

    An item without spans counts as its own token: span_index -1 over the whole baseline.
    """
    paras = trees.select("image_id", "side", F.posexplode("paragraphs").alias("para_pos", "p"))
    p = paras.select("image_id", "side", F.coalesce("p.para_index", "para_pos").alias("para_index"), "p.text", "p.items")
    items = p.select("image_id", "side", "para_index", F.posexplode("items").alias("item_index", "i"))
    it = items.select("image_id", "side", "para_index", "item_index", "i.text", "i.box", "i.spans")
    none = F.size(F.coalesce("spans", F.expr("array()"))) == 0
    whole = F.array(F.struct(F.lit(-1).alias("span_index"), F.col("text").alias("text"), F.lit(0.0).alias("t0"), F.lit(1.0).alias("t1"), F.col("box").alias("box")))
    listed = F.transform("spans", lambda s, n: F.struct(n.alias("span_index"), s["text"].alias("text"), s["t0"].alias("t0"), s["t1"].alias("t1"), s["box"].alias("box")))
    sp = it.select("image_id", "side", "para_index", "item_index", F.explode(F.when(none, whole).otherwise(listed)).alias("s"))
    return (
        p.drop("items"),
        it.drop("spans"),
        sp.select("image_id", "side", "para_index", "item_index", "s.span_index", "s.text", "s.t0", "s.t1", "s.box"),
    )


def assemble_layout(paras: DataFrame, items: DataFrame, spans: DataFrame) -> DataFrame:
    """Inverse of ``explode_layout``: one row per page side, lists ordered by index.

    All rows of a page side end in one row, so the three tables are dealt out once by page side; lists are put together where they are.
    """
    keys = ["image_id", "side"]
    kinds = {c: t for df in (paras, items, spans) for c, t in ((f.name, f.dataType) for f in df.schema)}
    names = [*keys, "para_index", "item_index", "span_index", "text", "t0", "t1", "box"]
    rows = None
    for kind, df in (("p", paras), ("i", items), ("s", spans)):
        own = {"p": names[:3] + ["text"], "i": names[:4] + ["text", "box"], "s": names}[kind]
        part = df.select(F.lit(kind).alias("kind"), *[(F.col(c) if c in own else F.lit(None).cast(kinds[c])).alias(c) for c in names])
        rows = part if rows is None else rows.unionByName(part)
    kind = F.col("kind")
    d = rows.repartition(*keys).groupBy(*keys, "para_index", "item_index").agg(
        F.collect_list(F.when(kind == "p", F.struct("text"))).alias("paras"),
        F.collect_list(F.when(kind == "i", F.struct("text", "box"))).alias("items"),
        F.array_sort(F.collect_list(F.when((kind == "s") & (F.col("span_index") >= 0), F.struct("span_index", "text", "t0", "t1", "box")))).alias("spans"),
        F.count_if(kind == "s").alias("n_spans"),
    )
    # rows meet by their keys, and a null key meets none
    page = F.col("image_id").isNotNull() & F.col("side").isNotNull() & F.col("para_index").isNotNull()
    spans_of = F.when(page & F.col("item_index").isNotNull() & (F.col("n_spans") > 0), F.col("spans"))
    listed = F.transform("items", lambda i: F.struct(F.col("item_index"), i["text"].alias("text"), i["box"].alias("box"), spans_of.alias("spans")))
    d = d.groupBy(*keys, "para_index").agg(F.flatten(F.collect_list("paras")).alias("paras"), F.array_sort(F.flatten(F.collect_list(listed))).alias("items"))
    items_of = F.when(page & (F.size("items") > 0), F.col("items"))
    listed = F.transform("paras", lambda p: F.struct(F.col("para_index"), p["text"].alias("text"), items_of.alias("items")))
    return d.groupBy(*keys).agg(F.array_sort(F.flatten(F.collect_list(listed))).alias("paragraphs")).filter(F.size("paragraphs") > 0)


def layout_from_boxes(boxes: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """Filtered boxes to lines that carry paragraph, item and text-offset columns.

    Lines are made before they are numbered or moved, so only lines, not boxes, are put in the order of the page.
    ``sums``: further columns, of which a line gets the sum over its boxes.
    """
    large = large_pages(boxes)
    huge, rest = (None, boxes) if large is None else split_pages(boxes, large)
    out = _offsets(_paragraphs(_whole_page_lines(rest, sums), None), None)
    return out if huge is None else out.unionByName(_spread_layout(huge, large, sums))


def _spread_layout(boxes: DataFrame, large: DataFrame, sums: Sequence[str]) -> DataFrame:
    """``layout_from_boxes`` of pages that are cut in ranges."""
    lines = line_table(box_lines(boxes, large), LINE, [F.sum(c).cast("double").alias(c) for c in sums])
    lines = ranged(lines, ["image_id"], LINE, large, at=F.col("__top"))
    lines = ordered_scan(lines, ["image_id"], LINE, large=large, number="line_no").drop(*LINE)
    lines = lines.select("image_id", "line_no", *[c for c in lines.columns if c not in ("image_id", "line_no")])
    return unranged(_offsets(_paragraphs(lines, large), large))
