"""Fitting text to lines and writing overlay HTML.  Text widths are inputs: no fonts are measured here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.functions.exprs import is_blank, once
from pagelayout.functions.keys import export_name
from pagelayout.functions.text import html_escape
from pagelayout.operators.geometry import SMALL_ANGLE, oriented_bounds
from pagelayout.operators.scans import group_stats, large_keys, ordered_scan, ranged, unranged

BASE_PX = 96


def fit_font_size(items: DataFrame) -> DataFrame:
    """Add ``font_px`` (null where nothing can be fitted) and ``wrap``.

    Reads text, is_thai, tw96 and th96 (text size at 96 px), avail_w, avail_h in pixels.
    """
    tw, th = F.col("tw96"), F.col("th96")
    aw, ah = F.greatest(F.lit(1.0), F.col("avail_w")), F.greatest(F.lit(1.0), F.col("avail_h"))
    k = F.when(F.col("is_thai"), 0.90).otherwise(0.94)
    scale = F.least(F.try_divide(aw * 0.98, tw), F.try_divide(ah * k, th))
    ok = ~is_blank("text") & (tw > 1e-6) & (th > 1e-6) & (scale > 0)
    size = F.greatest(F.lit(10), F.floor(BASE_PX * scale).cast("int"))
    d = items.withColumns({"__ok": ok, "__size": size, "__aw": aw, "__ah": ah})
    size, aw, ah = F.col("__size"), F.col("__aw"), F.col("__ah")
    top = F.floor(F.least(F.greatest(F.lit(16.0), ah), F.lit(float(BASE_PX * 3)))).cast("int")

    def fits(s: Column) -> Column:
        f = s / float(BASE_PX)
        return F.ceil(F.greatest(F.lit(1.0), tw * f) / F.greatest(F.lit(1.0), aw)) * th * f <= ah

    best = F.coalesce(F.array_max(F.filter(F.sequence(size, F.greatest(size, top)), fits)), size)
    wraps = (size <= 12) & (ah >= 24) & (tw > aw * 1.2) & (best >= F.floor(size * 1.25))
    return d.withColumns({
        "font_px": F.when(F.col("__ok"), F.when(wraps, best).otherwise(size)),
        "wrap": F.coalesce(F.col("__ok") & wraps, F.lit(False)),
    }).drop("__ok", "__size", "__aw", "__ah")


def shared_font_size(items: DataFrame) -> DataFrame:
    """One size per paragraph position for all sides: the smallest fit there, at most the page's median."""
    least = items.filter(F.col("font_px").isNotNull()).groupBy("image_id", "para_index").agg(F.min("font_px").alias("least"))
    middle = least.groupBy("image_id").agg(F.rint(F.percentile("least", F.lit(0.5))).cast("int").alias("median"))
    return least.join(middle, "image_id").select("image_id", "para_index", F.least("least", "median").cast("int").alias("font_px"))


def median_font_size(items: DataFrame) -> DataFrame:
    """Upper median of the fitted sizes per paragraph, from value counts."""
    counts = items.filter(F.col("font_px").isNotNull()).groupBy("image_id", "para_index", "font_px").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("image_id", "para_index").agg(F.array_sort(F.collect_list(F.struct("font_px", "n"))).alias("v"), F.sum("n").alias("total"))
    middle = F.floor(F.col("total") / 2)
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("hit"))
    walk = F.aggregate(
        "v", start,
        lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.coalesce(s["hit"], F.when(s["seen"] + x["n"] > middle, x["font_px"].cast("int"))).alias("hit")),
    )
    return listed.select("image_id", "para_index", walk["hit"].alias("font_px"))


def word_boxes(words: DataFrame) -> DataFrame:
    """Boxes of the words of a line: shares t0..t1 of the line from summed widths, centred where the line is wider.

    Reads image_id, para_index, item_index, word_no, kind (word or space), text, width_px (scaled), and the line's
    left/top/width/height fractions and w.
    """
    keys = ["image_id", "para_index", "item_index"]
    large = large_keys(words, keys, ["word_no"])
    d = ordered_scan(ranged(words, keys, ["word_no"], large), keys, ["word_no"], large=large, sums={"__x": F.col("width_px")})
    d = unranged(group_stats(d, keys, [], {"__total": ("sum", F.col("width_px"))}, large))
    line = F.col("width") * F.col("w")
    margin = F.when(F.col("__total") < line, (line - F.col("__total")) / 2.0).otherwise(0.0)
    t0 = F.try_divide(margin + F.col("__x"), line)
    t1 = F.try_divide(margin + F.col("__x") + F.col("width_px"), line)
    return d.filter(F.col("kind") == "word").select(
        *keys, "word_no", "text", t0.alias("t0"), t1.alias("t1"),
        (F.col("left") + F.col("width") * t0).alias("left"), "top", (F.col("width") * (t1 - t0)).alias("width"), "height",
    )


SOFT_FILL = 0.90  # share of a line that is filled while text is to be spread over several
ZERO_WIDTH_SPACE = "\u200b"  # a break opportunity: no word when words are counted


def _gaps(kinds: list, texts: list) -> list[str | None]:
    """What each word of a paragraph adds behind another one: the white space in front and its text. Null white space takes the word with it."""
    gap, pieces = "", []
    for kind, text in zip(kinds, texts):
        if kind == "space":
            gap = None if gap is None or text is None else gap + text
        elif text:
            if kind is not None:
                pieces.append(None if gap is None else gap + text)
            gap = ""
    return pieces


def _filled(widths: np.ndarray, gaps: np.ndarray, first: np.ndarray, count: np.ndarray, caps: np.ndarray, at: np.ndarray, n: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Line number of every word: a word that does not fit opens the next line, while there is one.

    The words of a paragraph stand from ``first`` on, its caps from ``at`` on. All paragraphs take a step together, the first words, then the second ones.
    Masked widths, gaps and caps are null: nothing is known to be too long then.
    """
    order = np.argsort(-count, kind="stable")
    first, count, at, last, wanted = first[order], count[order], at[order], n[order] - 1, wanted[order]
    line, used, lost = np.zeros(len(order), np.int64), np.zeros(len(order)), np.zeros(len(order), bool)
    out = np.zeros(len(widths), np.int64)
    w, w_null, g, g_null, c, c_null = (x for held in (widths, gaps, caps) for x in (held.data, np.ma.getmaskarray(held)))
    many = np.searchsorted(-count, -np.arange(count[0] if len(count) else 0), "left")  # paragraphs that have the step's word
    for k, m in enumerate(many):
        i, now = first[:m] + k, line[:m]
        cap = c[at[:m] + now]
        soft = (wanted[:m] > 1) & (now < wanted[:m])
        limit = np.where(soft & (cap * SOFT_FILL < cap), cap * SOFT_FILL, cap)
        longer, unknown = used[:m] + w[i], lost[:m] | w_null[i]
        if k:
            longer, unknown = longer + g[i], unknown | g_null[i]
            over = (longer > limit) | (np.isnan(longer) & ~np.isnan(limit))
            opens = (now < last[:m]) & ~(limit <= 0) & over & ~unknown & ~c_null[at[:m] + now]
            line[:m] += opens
            longer, unknown = np.where(opens, w[i], longer), np.where(opens, w_null[i], unknown)
        used[:m], lost[:m], out[i] = longer, unknown, line[:m]
    return out


def _spread(starts: list[int], seen: np.ndarray, wanted: int) -> list[int]:
    """Starts of lines, the end behind them, until there are ``wanted`` lines: the first of those with most words is cut before its middle word.

    ``seen``: how many words that count come before each word, and all at the end; lines of one word stay.
    """
    while len(starts) - 1 < wanted:
        counts = np.diff(seen[starts])
        if not len(counts) or counts.max() <= 1:
            break
        i = int(counts.argmax())
        middle = int(np.searchsorted(seen, seen[starts[i]] + counts[i] // 2 + 1)) - 1
        starts = [*starts[: i + 1], middle, *starts[i + 1 :]]
    return starts


def _masked(a: pa.Array) -> np.ma.MaskedArray:
    return np.ma.MaskedArray(pc.fill_null(a, 0.0).to_numpy(zero_copy_only=False), mask=a.is_null().to_numpy(zero_copy_only=False))


def _bounds(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in ``flatten()``, and the end."""
    return np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)


def _wrapped(tokens: pa.Array, caps: pa.Array, min_lines: pa.Array) -> pa.Array:
    """Lines of a batch of paragraphs, all of them together: a step of numpy for each place in a paragraph, none for each paragraph."""
    flat, cap_at, bounds = tokens.flatten(), _bounds(caps), _bounds(tokens)
    # a null token has neither kind nor text
    kind, text, width = (pc.if_else(flat.is_valid(), flat.field(i), None) if flat.null_count else flat.field(i) for i in range(3))
    size = np.diff(cap_at)
    wanted = np.maximum(1, np.minimum(pc.fill_null(min_lines, np.iinfo(np.int32).max).to_numpy(zero_copy_only=False), size))
    true = lambda a: pc.fill_null(a, False).to_numpy(zero_copy_only=False)
    space, some = true(pc.equal(kind, "space")), true(pc.not_equal(text, ""))
    is_word = some & ~space & true(kind.is_valid())
    word = np.flatnonzero(is_word)
    first = np.searchsorted(word, bounds)
    count = np.where(size > 0, np.diff(first), 0)

    widths = _masked(width.cast(pa.float64()))
    # the white space behind the last token that is none, added up in its order
    gaps = np.ma.MaskedArray(np.zeros(len(word)), mask=np.zeros(len(word), bool))
    held = np.flatnonzero(space)
    held = held[: np.searchsorted(held, word[-1])] if len(word) else held[:0]
    place = np.searchsorted(word, held)  # the word that follows
    ends = np.flatnonzero(some & ~space)  # words, and texts of no kind, which end white space too
    follows = (word[place] < bounds[np.searchsorted(bounds, held, "right")]) & (np.searchsorted(ends, held) == np.searchsorted(ends, word[place]))
    held, place = held[follows], place[follows]
    np.add.at(gaps.data, place, widths.data[held])
    np.logical_or.at(gaps.mask, place, widths.mask[held])
    line = _filled(np.ma.MaskedArray(widths.data[word], mask=widths.mask[word]), gaps, first[:-1], count, _masked(caps.flatten().cast(pa.float64())), cap_at[:-1], size, wanted)

    opens = np.ones(len(word) + 1, bool)
    opens[1:-1] = line[1:] != line[:-1]
    opens[first] = True
    starts = np.flatnonzero(opens)
    from_line, lines = np.searchsorted(starts, first), []
    counts = np.concatenate([[0], np.cumsum(true(pc.not_equal(text, ZERO_WIDTH_SPACE))[word])])
    text = text.cast(pa.large_string())
    letters, at = text.buffers()[2], np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8) if len(text) else np.zeros(1, np.int64)
    letters = memoryview(letters) if letters else b""
    plain = ~(true(kind.is_null()) | true(text.is_null()))
    odd = np.concatenate([[0], np.cumsum(~plain)])
    odd = odd[bounds[1:]] != odd[bounds[:-1]]
    sizes, nulls = size.tolist(), tokens.is_null().to_pylist()
    short = (np.diff(from_line) < wanted) & (count > 0)
    word_list, first_list, from_list, short_list, odd_list = word.tolist(), first.tolist(), from_line.tolist(), short.tolist(), odd.tolist()
    begin, end = at[word].tolist(), at[word + 1].tolist()
    starts_list = starts.tolist()
    for p, n in enumerate(sizes):
        if not n or nulls[p]:
            lines.append([] if not n else None)
            continue
        if first_list[p] == first_list[p + 1]:
            lines.append([b""] * n)
            continue
        cuts = starts_list[from_list[p] : from_list[p + 1]] + [first_list[p + 1]]
        if short_list[p]:
            cuts = [first_list[p] + x for x in _spread([x - first_list[p] for x in cuts], counts[first_list[p] : first_list[p + 1] + 1], int(wanted[p]))]
        if odd_list[p]:
            lo, hi = int(bounds[p]), int(bounds[p + 1])
            behind, own = _gaps(kind[lo:hi].to_pylist(), text[lo:hi].to_pylist()), first_list[p]
            made = ["".join([text[word_list[a]].as_py(), *[x for x in behind[a + 1 - own : b - own] if x is not None]]).encode() for a, b in zip(cuts, cuts[1:])]
        else:
            # a line is what lies between the ends of its first and last word, white space and all
            made = [bytes(letters[begin[a] : end[b - 1]]) for a, b in zip(cuts, cuts[1:])]
        lines.append(made + [b""] * (n - len(made)))
    return pa.array(lines, pa.list_(pa.string()))


_wrap_batches = F.arrow_udf(_wrapped, T.ArrayType(T.StringType()))


def wrap_words(tokens: Column, caps: Column, min_lines: Column) -> Column:
    """Texts of the lines of a paragraph, as many as there are ``caps`` (widths); no caps, no lines.

    ``tokens``: array of (kind, text, width), kind ``word`` or ``space``. Text fills at least ``min_lines`` lines if it has the words.
    White space at the ends of a line goes. Spark 4.1 does not find the call again if a lambda inside a lambda makes its arguments: explode such ones first.
    """
    return _wrap_batches(tokens, caps, min_lines.cast("int"))


# ---------------------------------------------------------------- HTML


def short_number(c: Column) -> Column:
    """Six significant digits without trailing zeros, for magnitudes from 0.001 up to a million."""
    a = F.abs(c)
    text = F.when(a >= 100000, F.format_string("%.0f", c))
    for digits, least in ((1, 10000), (2, 1000), (3, 100), (4, 10), (5, 1), (6, 0.1), (7, 0.01), (8, 0.0)):
        text = text.when(a >= least, F.format_string(f"%.{digits}f", c))
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def _px(c: Column) -> Column:
    return F.concat(F.format_string("%.6f", c), F.lit("px; "))


def mapped_texts(para_text: Column, raw: Column) -> Column:
    """Line texts of a paragraph: where its own text has newlines and the lines do not carry it, it is cut over them."""
    def lines(t: Column) -> Column:
        return F.transform(F.filter(F.split(t, r"\r?\n+"), lambda s: ~is_blank(s)), lambda s: F.regexp_replace(s, r"(?U)\s+$", ""))

    def chosen(v: Column) -> Column:
        raw, p = v["raw"], v["p"]
        full = F.size(F.filter(raw, lambda t: ~is_blank(t)))
        nl = F.exists(raw, lambda t: F.contains(t, F.lit("\n")))
        first = F.coalesce(F.get(raw, F.lit(0)), F.lit(""))
        rest_blank = F.forall(F.slice(raw, 2, F.greatest(F.lit(1), F.size(raw))), is_blank)
        return F.when(F.contains(p, F.lit("\n")) & ((full <= 1) | nl), lines(p)).when(F.contains(first, F.lit("\n")) & ((full <= 1) | rest_blank), lines(first))

    def mapped(v: Column) -> Column:
        picked = F.slice(F.zip_with(v["raw"], v["chosen"], lambda t, c: F.coalesce(c, t)), F.lit(1), F.size(v["raw"]))
        return F.when(F.size(v["chosen"]) > 0, picked).otherwise(v["raw"])

    held = F.struct(raw.alias("raw"), F.coalesce(para_text, F.lit("")).alias("p"))
    return once(held, lambda v: once(F.struct(v["raw"].alias("raw"), chosen(v).alias("chosen")), mapped))


def render_overlay_html(paras: DataFrame, items: DataFrame, pages: DataFrame) -> DataFrame:
    """One HTML string per page: a scope, one block per paragraph, one element per line.

    ``paras``: image_id, para_index, text, rect; ``items``: image_id, para_index, item_index, text, rect, font_px,
    wrap; ``pages``: image_id, w, h.
    """
    keys = ["image_id", "para_index"]
    rects = oriented_bounds(paras.select(*keys, "rect"), items)
    own = F.struct("item_index", F.coalesce("text", F.lit("")).alias("text"), "rect", "font_px", "wrap")
    listed = items.groupBy(*keys).agg(F.array_sort(F.collect_list(own)).alias("v"))
    texts = paras.select(*keys, F.col("text").alias("ptext")).join(listed, keys)
    texts = texts.select(*keys, "v", mapped_texts(F.col("ptext"), F.transform("v", lambda x: x["text"])).alias("tx"))

    def with_text(x: Column, t: Column) -> Column:
        return F.struct(*[x[c].alias(c) for c in ("item_index", "rect", "font_px", "wrap")], t.alias("shown"))

    # Lines meet the texts at their place; where several share a number, each has all their texts.
    numbers, by_number = F.transform("v", lambda x: x["item_index"]), F.arrays_zip(F.transform("v", lambda x: x["item_index"]).alias("ix"), F.col("tx").alias("tx"))
    shared = F.flatten(F.transform("v", lambda x: F.transform(F.filter(by_number, lambda z: z["ix"] == x["item_index"]), lambda z: with_text(x, z["tx"]))))
    placed = F.when(F.size(F.array_distinct(numbers)) == F.size(numbers), F.zip_with("v", "tx", with_text)).otherwise(shared)
    lines = texts.select(*keys, F.explode_outer(placed).alias("z")).select(*keys, "z.*").filter(F.col("item_index").isNotNull() & F.col("rect").isNotNull())
    r = rects.select(*keys, *[F.col(c).alias("p" + c) for c in "ltrb"], F.col("deg").alias("pdeg"))
    d = lines.join(r, keys)
    l, t, rr, b = (F.col("rect")[c] for c in "ltrb")
    w, h = rr - l, b - t
    d = d.filter(~is_blank("shown") & (w > 0) & (h > 0))
    fs = F.when(F.col("font_px") > 0, F.rint("font_px")).otherwise(F.greatest(F.lit(10.0), F.rint(h * 0.85)))
    fs = F.greatest(F.lit(6.0), F.least(fs, F.greatest(F.lit(6.0), F.floor(h * 0.95).cast("double"))))
    lh = F.greatest(F.lit(1.0), F.least(F.rint(h), F.rint(fs * 1.12)))
    turned = F.abs("pdeg") > SMALL_ANGLE
    pcx, pcy = (F.col("pl") + F.col("pr")) / 2.0, (F.col("pt") + F.col("pb")) / 2.0
    dx, dy = (l + rr) / 2.0 - pcx, (t + b) / 2.0 - pcy
    c, s = F.cos(F.radians(-F.col("pdeg"))), F.sin(F.radians(-F.col("pdeg")))
    left = F.when(turned, pcx + (dx * c - dy * s) - w / 2.0 - F.col("pl")).otherwise(l - F.col("pl"))
    top = F.when(turned, pcy + (dx * s + dy * c) - h / 2.0 - F.col("pt")).otherwise(t - F.col("pt"))
    deg = F.col("rect.deg") - F.when(turned, F.col("pdeg")).otherwise(0.0)

    def spin(x: Column) -> Column:
        return once(x, lambda v: F.when(F.abs(v) > SMALL_ANGLE, F.concat(F.lit(" transform: rotate("), short_number(v), F.lit("deg); transform-origin: center center;"))).otherwise(""))

    pi, ii = F.col("para_index").cast("string"), F.col("item_index").cast("string")
    item = F.concat(
        F.lit('<div class="tp-item tp-item-'), ii, F.lit('" data-para-index="'), pi, F.lit('" data-item-index="'), ii, F.lit('"'),
        F.when(F.coalesce("wrap", F.lit(False)), ' data-wrap="1"').otherwise(""),
        F.lit(' style="left: '), _px(left), F.lit("top: "), _px(top), F.lit("width: "), _px(w), F.lit("height: "), _px(h),
        F.lit("font-size: "), fs.cast("int").cast("string"), F.lit("px; line-height: "), lh.cast("int").cast("string"), F.lit("px; padding-bottom: 0px;"),
        spin(deg), F.lit('"><span>'), html_escape("shown"), F.lit("</span></div>"),
    )
    body = d.select(*keys, "item_index", item.alias("html")).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_index", "html"))), lambda x: x["html"]), "").alias("body")
    )
    block = F.concat(
        F.lit('<div class="tp-para tp-para-'), pi, F.lit('" data-para-index="'), pi, F.lit('" style="left: '), _px(F.col("pl")), F.lit("top: "), _px(F.col("pt")),
        F.lit("width: "), _px(F.greatest(F.lit(0.0), F.col("pr") - F.col("pl"))), F.lit("height: "), F.format_string("%.6f", F.greatest(F.lit(0.0), F.col("pb") - F.col("pt"))), F.lit("px;"),
        spin(F.col("pdeg")), F.lit('">'), F.coalesce("body", F.lit("")), F.lit("</div>"),
    )
    blocks = r.join(body, keys, "left").select("image_id", "para_index", block.alias("html"))
    page = blocks.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_index", "html"))), lambda x: x["html"]), "").alias("inner"))
    scope = F.concat(F.lit('<div class="tp-draw-scope" style="width: '), F.col("w").cast("string"), F.lit("px; height: "), F.col("h").cast("string"), F.lit('px;">'), "inner", F.lit("</div>"))
    return pages.join(page, "image_id").select("image_id", scope.alias("html"))


def tokens_to_html(tokens: DataFrame, container: str = "overlay", token: str = "token") -> DataFrame:
    """Accessible token layer: one empty, labelled element per token with text, placed in percent of the page.

    Reads image_id, para_index, item_index, span_index, text, left, top, width, height, rotation_deg, font_px.
    """
    t = tokens.filter(~is_blank("text"))
    pct = lambda c: F.concat((F.col(c) * 100.0).cast("string"), F.lit("%); "))
    label = F.replace(F.replace("text", F.lit('"'), F.lit("&quot;")), F.lit("\n"), F.lit(" "))
    font = F.when(F.col("font_px") > 0, F.concat(F.lit(" font-size: "), F.col("font_px").cast("string"), F.lit("px; line-height: "), F.greatest(F.lit(1.0), F.rint(F.col("font_px") * 1.05)).cast("int").cast("string"), F.lit("px;"))).otherwise("")
    html = F.concat(
        F.lit(f'<div class="{token}" aria-label="'), label, F.lit('" data-wi="0" role="button" tabindex="-1" style="top: calc('), pct("top"), F.lit("left: calc("), pct("left"),
        F.lit("width: calc("), pct("width"), F.lit("height: calc("), pct("height"), F.lit("transform: rotate("), F.col("rotation_deg").cast("string"), F.lit("deg);"), font, F.lit('"></div>'),
    )
    rows = t.select("image_id", "para_index", "item_index", "span_index", html.alias("html"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_index", "item_index", "span_index", "html"))), lambda x: x["html"]), "")
    return rows.groupBy("image_id").agg(F.concat(F.lit(f'<div class="{container}">'), joined, F.lit("</div>")).alias("html"))


def standalone_pages(pages: DataFrame, css: str = "") -> DataFrame:
    """Self-contained HTML documents: picture below, overlay above.

    Reads image_id, name, w, h, background (data URI or URL), overlay_html, mode, lang.
    """
    w, h = F.col("w").cast("string"), F.col("h").cast("string")
    title = html_escape("name", quotes=True, drop_cr=False)
    doc = F.concat(
        F.lit('<!doctype html>\n<html lang="en"><head><meta charset="utf-8" /><title>'), title,
        F.lit("</title><style>body{margin:0}.page{position:relative;width:min(100vw,"), w, F.lit("px);margin:0 auto}.page img{display:block;width:100%;height:auto}.layer{position:absolute;inset:0}" + css + "</style></head>\n"),
        F.lit('<body><div class="page" style="aspect-ratio:'), w, F.lit("/"), h, F.lit('"><img src="'), "background", F.lit('" width="'), w, F.lit('" height="'), h, F.lit('" alt="'), title,
        F.lit('" /><div class="layer">'), F.coalesce("overlay_html", F.lit("")), F.lit("</div></div></body></html>\n"),
    )
    good = pages.filter(F.coalesce("background", F.lit("")) != "")
    return good.select("image_id", export_name(F.col("name"), F.col("mode"), F.col("lang"), F.lit("html")).alias("file_name"), doc.alias("html"))


def export_overlays(pages: DataFrame, path: str, css: str = "", buckets: int = 256) -> None:
    """Write the standalone pages, grouped in folders by a hash of the page."""
    out = standalone_pages(pages, css).withColumn("bucket", F.pmod(F.xxhash64("image_id"), F.lit(buckets)).cast("int"))
    out.write.mode("overwrite").partitionBy("bucket").parquet(path)
