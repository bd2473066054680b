"""Registered queries: text functions over whole documents, answers and prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelayout.functions import text as tx
from pagelayout.functions.exprs import collapse_ws
from pagelayout.plans.registry import query
from pagelayout.sources import views
from pagelayout.sources.views import with_views

# White space as the operators mean it, in the other engine's regular-expression dialect.
WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def doc_query(name: str, make: Callable[[Column], Column], sql_expr: str, text: Callable[[], Column] | None = None, sql_text: str = "text") -> None:
    """A text function over every document, compared by digest."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        d = docs(spark, sf)
        if text is not None:
            d = d.withColumn("text", text())
        out = make(F.col("text"))
        return d.select("doc_id", F.length(out).cast("long").alias("n"), F.md5(out).alias("digest"))

    query(name, f"SELECT doc_id, length(x) AS n, md5(x) AS digest FROM (SELECT doc_id, {sql_expr} AS x FROM (SELECT doc_id, {sql_text} AS text FROM documents))")(run)


doc_query("T1_collapse_ws", collapse_ws, sql_collapse("text"))
doc_query("T10_norm_dedupe_text", tx.norm_dedupe_text, sql_collapse("lower(regexp_replace(text, '<<TP_P\\d+>>', '', 'g'))"), lambda: F.concat(F.lit("<<TP_P3>> "), F.col("text")), "'<<TP_P3>> ' || text")
doc_query(
    "T12_sanitize_text",
    tx.sanitize_text,
    "regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\\x00-\\x09\\x0b-\\x1f\\x7f-\\x9f\\p{Cf}\\p{Co}]', '', 'g')",
    lambda: F.concat(F.lit("\u200b\ufeff\t"), F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))),
    "chr(8203) || chr(65279) || chr(9) || replace(text, chr(10), chr(13) || chr(10))",
)
def sql_prompt(x: str) -> str:
    t = sql_trim(x)
    return f"CASE WHEN length({t}) > 8192 THEN regexp_replace(left({t}, 8192), '{WS}+$', '') ELSE {t} END"


doc_query("T13_normalize_prompt", tx.normalize_prompt, sql_prompt("text"))
_SP = f"regexp_replace(regexp_replace({sql_trim('text')}, '(?m)[\\t ]+$', '', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
doc_query(
    "T13_sanitize_prompt", tx.sanitize_prompt,
    f"CASE WHEN length({_SP}) > 1200 THEN regexp_replace(left({_SP}, 1200), '{WS}+$', '') ELSE {_SP} END",
    lambda: F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("  \n\n\n")), F.lit(". "), F.lit(".\r\n")),
    "replace(replace(replace(text, chr(10), '  ' || chr(10) || chr(10) || chr(10)), '. ', '.' || chr(13) || chr(10)), chr(13) || chr(10), chr(10))",
)
doc_query("T32_html_escape", lambda t: tx.html_escape(t, quotes=True), "replace(replace(replace(replace(replace(text, chr(13), ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')")
doc_query("T33_truncate", lambda t: tx.truncate(t, 180), "CASE WHEN length(text) > 180 THEN left(text, 180) || '…' ELSE text END")
doc_query(
    "T29_clean_thai_pronoun", tx.clean_thai_pronoun,
    "regexp_replace(regexp_replace(regexp_replace(text, '(^|[\\s\"''“”‘’()\\[\\]{}<>])นาย(\\s|$)', '\\1\\2', 'g'), '[ \\t]{2,}', ' ', 'g'), '(?m)^[ \\t]+', '', 'g')",
    lambda: F.concat(F.lit("นาย ไป"), F.replace(F.col("text"), F.lit(" le "), F.lit(" นาย le นายก ")), F.lit(" (นาย")),
    "'นาย ไป' || replace(text, ' le ', ' นาย le นายก ') || ' (นาย'",
)


@query(
    "T2_clamp_repeats",
    """SELECT doc_id, count(*) AS n, md5(string_agg(ch, '' ORDER BY pos)) AS digest FROM (
  SELECT doc_id, pos, ch, row_number() OVER (PARTITION BY doc_id, ch, pos - rk ORDER BY pos) AS k FROM (
    SELECT doc_id, pos, ch, row_number() OVER (PARTITION BY doc_id, ch ORDER BY pos) AS rk FROM (
      SELECT doc_id, unnest(cs) AS ch, unnest(range(len(cs))) AS pos FROM (SELECT doc_id, string_split(text || repeat('x', 40) || chr(10) || repeat('!', CAST(doc_id % 20 AS INTEGER)), '') AS cs FROM documents))))
  WHERE k <= 12 OR ch = chr(10) GROUP BY doc_id""",
)
def q_clamp_repeats(spark: SparkSession, sf: str) -> DataFrame:
    padded = F.concat("text", F.lit("x" * 40 + "\n"), F.repeat(F.lit("!"), (F.col("doc_id") % 20).cast("int")))
    d = docs(spark, sf).select("doc_id", tx.clamp_repeats(padded).alias("x"))
    return d.select("doc_id", F.length("x").cast("long").alias("n"), F.md5("x").alias("digest"))


@query(
    "T35_split_words",
    f"""SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE regexp_matches(tok, '^{WS}')) AS n_blank, md5(string_agg(tok, chr(1) ORDER BY i)) AS digest FROM (
  SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{WS}+|[^\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+') AS toks FROM documents)) GROUP BY doc_id""",
)
def q_split_words(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", tx.split_words("text").alias("toks")).filter(F.size("toks") > 0)
    blank = F.size(F.filter("toks", lambda t: t.rlike(r"(?U)^\s")))
    return d.select("doc_id", F.size("toks").cast("long").alias("n_tokens"), blank.cast("long").alias("n_blank"), F.md5(F.array_join("toks", "\x01")).alias("digest"))


@query(
    "W14_script_runs",
    r"""SELECT doc_id, run_no, CASE WHEN run <> chr(10) THEN regexp_matches(run, '^[\x{0E00}-\x{0E7F}]') END AS is_thai, md5(run) AS digest FROM (
  SELECT doc_id, unnest(rs) AS run, CAST(unnest(range(len(rs))) AS INTEGER) AS run_no FROM (
    SELECT doc_id, regexp_extract_all(replace(text, 'an', 'ไท ย'), '\n|[\x{0E00}-\x{0E7F}](?:[\x{0E00}-\x{0E7F}]|[\t\x0b\f\r \x{85}\p{Z}])*|[^\x{0E00}-\x{0E7F}\n]+') AS rs FROM documents))""",
)
def q_script_runs(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", F.replace("text", F.lit("an"), F.lit("ไท ย")).alias("text"))
    return tx.script_runs(d, ["doc_id"], "text").select("doc_id", "run_no", "is_thai", F.md5("run").alias("digest"))


# ---------------------------------------------------------------- marked answers

# Damaged answers of every kind, made from the clean ones.
ANSWERS_SQL = """SELECT image_id, expected, CASE WHEN image_id % 7 = 6 THEN regexp_replace(marked_text, '<<TP_P\\d+>>', '', 'g') WHEN image_id % 5 = 1 THEN replace(marked_text, '>>' || chr(10), '>> ')
  WHEN image_id % 5 = 2 THEN marked_text || chr(10) || chr(10) || '<<TP_P0>>' || chr(10) || 'said again' WHEN image_id % 5 = 3 THEN replace(marked_text, '<<TP_P1>>', '<<TP_Px> ')
  WHEN image_id % 5 = 4 THEN replace(marked_text, 'a ', 'a <<TP_P3>> ') ELSE marked_text END AS marked_text FROM translations"""


def answers(spark: SparkSession, sf: str) -> DataFrame:
    t, m = F.col("marked_text"), F.col("image_id")
    damaged = (
        F.when(m % 7 == 6, F.regexp_replace(t, tx.MARKER, ""))
        .when(m % 5 == 1, F.replace(t, F.lit(">>\n"), F.lit(">> ")))
        .when(m % 5 == 2, F.concat(t, F.lit("\n\n<<TP_P0>>\nsaid again")))
        .when(m % 5 == 3, F.replace(t, F.lit("<<TP_P1>>"), F.lit("<<TP_Px> ")))
        .when(m % 5 == 4, F.replace(t, F.lit("a "), F.lit("a <<TP_P3>> ")))
        .otherwise(t)
    )
    return views.translations(spark, sf).withColumn("marked_text", damaged)


SEGS_SQL = """SELECT image_id, expected, CAST(id AS BIGINT) AS para_index, occ, seg FROM (
  SELECT image_id, expected, unnest(ids) AS id, unnest(range(len(ids))) AS occ, unnest(parts[2:]) AS seg FROM (
  SELECT image_id, expected, regexp_extract_all(marked_text, '<<TP_P(\\d+)>>', 1) AS ids, string_split_regex(marked_text, '<<TP_P\\d+>>') AS parts FROM answers))"""


@query(
    "T3_apply_markers",
    with_views("segments", f"SELECT image_id, md5(string_agg('<<TP_P' || para_index || '>>' || chr(10) || {sql_trim('source')}, chr(10) || chr(10) ORDER BY para_index)) AS digest FROM segments GROUP BY image_id"),
)
def q_apply_markers(spark: SparkSession, sf: str) -> DataFrame:
    s = views.segments(spark, sf).groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_index", "source"))), lambda x: x["source"]).alias("paras"))
    return s.select("image_id", F.md5(tx.apply_markers("paras")).alias("digest"))


@query(
    "T4_marker_segments",
    with_views("translations", f"SELECT image_id, CAST(para_index AS INTEGER) AS para_index, segment FROM (SELECT image_id, para_index, {sql_collapse('arg_min(seg, occ)')} AS segment FROM segs WHERE para_index < expected GROUP BY image_id, para_index) WHERE segment <> ''", answers=ANSWERS_SQL, segs=SEGS_SQL),
)
def q_marker_segments(spark: SparkSession, sf: str) -> DataFrame:
    return tx.marker_segments(answers(spark, sf), ["image_id"])


@query(
    "T5_marker_segments_for_layout",
    with_views(
        "translations",
        f"""SELECT s.image_id, s.para_index, coalesce(m.segment, p.segment, '') AS segment FROM slots s
  LEFT JOIN (SELECT image_id, para_index, arg_min(seg, occ) AS segment FROM (SELECT image_id, para_index, occ, {sql_trim('seg')} AS seg FROM segs) WHERE seg <> '' GROUP BY ALL) m ON m.image_id = s.image_id AND m.para_index = s.para_index
  LEFT JOIN (SELECT image_id, unnest(ps) AS segment, unnest(range(len(ps))) AS para_index FROM (SELECT image_id, string_split(marked_text, chr(10) || chr(10)) AS ps FROM answers WHERE NOT regexp_matches(marked_text, '<<TP_P\\d+>>') AND marked_text <> '')) p
  ON p.image_id = s.image_id AND p.para_index = s.para_index""",
        answers=ANSWERS_SQL, segs=SEGS_SQL, slots="SELECT image_id, CAST(unnest(range(expected)) AS INTEGER) AS para_index FROM answers",
    ),
)
def q_marker_segments_for_layout(spark: SparkSession, sf: str) -> DataFrame:
    return tx.marker_segments_for_layout(answers(spark, sf), ["image_id"])


_NO_HEAD = "regexp_replace(x, '^\\s*<<TP_P\\d+>>', '')"
_T6_LINE = (
    "CASE WHEN NOT contains(x, '<<TP_P') THEN x WHEN regexp_matches(x, '^\\s*<<TP_P\\d+>>') THEN regexp_extract(x, '^\\s*(<<TP_P\\d+>>)', 1) || "
    f"CASE WHEN {sql_trim(_NO_HEAD)} = '' THEN '' ELSE chr(10) || {sql_trim(_NO_HEAD)} END "
    "ELSE regexp_replace(x, '<<TP_P\\d+>>', '', 'g') END"
)


@query(
    "T6_sanitize_marked_text",
    with_views(
        "translations",
        f"""SELECT image_id, CASE WHEN NOT regexp_matches(t, '<<TP_P\\d+>>') THEN {sql_collapse('t')} ELSE (SELECT regexp_replace(string_agg('<<TP_P' || n || '>>' || chr(10) || seg, chr(10) || chr(10) ORDER BY n), '^\\n+|\\n+$', '', 'g') FROM
  (SELECT n, {sql_collapse('arg_min(seg, occ)')} AS seg FROM (SELECT CAST(unnest(regexp_extract_all(t, '<<TP_P(\\d+)>>', 1)) AS BIGINT) AS n, unnest(range(len(regexp_extract_all(t, '<<TP_P(\\d+)>>', 1)))) AS occ, unnest(string_split_regex(t, '<<TP_P\\d+>>')[2:]) AS seg) GROUP BY n)) END AS clean FROM tidy""",
        answers=ANSWERS_SQL,
        step1="SELECT image_id, replace(replace(regexp_replace(regexp_replace(marked_text, '<<TP_P(\\d+)>>', chr(1) || '\\1' || chr(2), 'g'), '<<TP_P[^\\s>]*>?', '', 'g'), chr(1), '<<TP_P'), chr(2), '>>') AS t FROM answers",
        step2="SELECT image_id, regexp_replace(t, '(?m)^\\s*(<<TP_P\\d+>>)\\s*([^\\s])', '\\1' || chr(10) || '\\2', 'g') AS t FROM step1",
        tidy=f"SELECT image_id, array_to_string(list_transform(string_split(t, chr(10)), lambda x: {_T6_LINE}), chr(10)) AS t FROM step2",
    ),
)
def q_sanitize_marked_text(spark: SparkSession, sf: str) -> DataFrame:
    return tx.sanitize_marked_text(answers(spark, sf), "marked_text", "clean").select("image_id", "clean")


@query(
    "T8_markers_complete",
    with_views(
        "translations",
        """SELECT image_id, expected <= 0 OR len(list_filter(range(expected), lambda i: list_position(ids, CAST(i AS VARCHAR)) IS NULL OR list_position(ids, CAST(i AS VARCHAR)) = 0
  OR (i > 0 AND coalesce(list_position(ids, CAST(i-1 AS VARCHAR)), 0) >= list_position(ids, CAST(i AS VARCHAR))))) = 0 AS complete FROM (SELECT image_id, expected, regexp_extract_all(marked_text, '<<TP_P(\\d+)>>', 1) AS ids FROM answers)""",
        answers=ANSWERS_SQL,
    ),
)
def q_markers_complete(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("image_id", tx.markers_complete("marked_text", "expected").alias("complete"))


@query("T9_needs_retry", with_views("translations", "SELECT image_id, expected > 0 AND NOT regexp_matches(marked_text, '<<TP_P\\d+>>') AS retry FROM answers", answers=ANSWERS_SQL))
def q_needs_retry(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("image_id", tx.needs_retry("marked_text", "expected").alias("retry"))


_UNMARKED = "regexp_replace(marked_text, '<<TP_P[0-9]+>>', '', 'g')"


@query("F14_has_meaningful_text", with_views("translations", f"SELECT image_id, {sql_trim(_UNMARKED)} <> '' AS meaningful FROM answers", answers=ANSWERS_SQL))
def q_has_meaningful_text(spark: SparkSession, sf: str) -> DataFrame:
    return answers(spark, sf).select("image_id", tx.has_meaningful_text("marked_text").alias("meaningful"))


@query(
    "U4_expected_minus_found",
    with_views("translations", "SELECT image_id, CAST(i AS INTEGER) AS para_index FROM (SELECT image_id, unnest(range(expected)) AS i FROM answers) EXCEPT SELECT image_id, CAST(para_index AS INTEGER) FROM segs", answers=ANSWERS_SQL, segs=SEGS_SQL),
)
def q_expected_minus_found(spark: SparkSession, sf: str) -> DataFrame:
    a = answers(spark, sf)
    want = a.filter("expected > 0").select("image_id", F.explode(F.sequence(F.lit(0), F.col("expected") - 1)).alias("para_index"))
    found = a.select("image_id", F.explode(tx.marker_numbers("marked_text")).alias("n")).select("image_id", F.col("n").cast("int").alias("para_index"))
    return want.join(found.distinct(), ["image_id", "para_index"], "left_anti")


@query(
    "T7_merge_overlap_text",
    with_views(
        "paras",
        """SELECT image_id, para_index, md5(CASE WHEN kw IS NOT NULL THEN array_to_string(list_concat(wa, wb[kw+1:]), ' ') WHEN kc IS NOT NULL THEN a || substr(b, kc+1) ELSE a || ' ' || b END) AS digest FROM (
  SELECT *, list_max(list_filter(range(1, least(len(wa), len(wb))+1), lambda k: wa[len(wa)-k+1:] = wb[1:k])) AS kw, list_max(list_filter(range(1, least(length(a), length(b))+1), lambda k: right(a, k) = left(b, k))) AS kc FROM seams)""",
        halves="SELECT image_id, para_index, string_split_regex(text, '[ \\n]+') AS ws FROM paras",
        seams="""SELECT image_id, para_index, a, b, string_split_regex(a, '[ \\n]+') AS wa, string_split_regex(b, '[ \\n]+') AS wb FROM (SELECT image_id, para_index, array_to_string(ws[1:2*len(ws)//3+1], ' ') AS a,
  CASE para_index % 3 WHEN 0 THEN array_to_string(ws[len(ws)//3+1:], ' ') WHEN 1 THEN right(array_to_string(ws[1:2*len(ws)//3+1], ' '), 2) || 'Q ' || array_to_string(ws[len(ws)//3+1:], ' ') ELSE 'Q1 ' || ws[1] END AS b FROM halves)""",
    ),
)
def q_merge_overlap_text(spark: SparkSession, sf: str) -> DataFrame:
    ws = F.col("ws")
    n = F.size(ws)
    a = F.array_join(F.slice(ws, 1, F.floor(2 * n / 3).cast("int") + 1), " ")
    rest = F.array_join(F.slice(ws, F.floor(n / 3).cast("int") + 1, n), " ")
    k = F.col("para_index") % 3
    b = F.when(k == 0, rest).when(k == 1, F.concat(F.right(a, F.lit(2)), F.lit("Q "), rest)).otherwise(F.concat(F.lit("Q1 "), F.get(ws, F.lit(0))))
    d = views.paras(spark, sf).withColumn("ws", F.split("text", "[ \n]+")).select("image_id", "para_index", a.alias("a"), b.alias("b"))
    return tx.merge_overlap_text(d, "a", "b", "joined").select("image_id", "para_index", F.md5("joined").alias("digest"))


_CONV = "SELECT conv_id, turn, text FROM conversations"
_KIND = "(conv_id + turn) % 6"


@query(
    "T11_parse_responses",
    f"""SELECT conv_id, turn, CASE WHEN {_KIND} = 5 THEN NULL WHEN {_KIND} IN (0, 4) THEN md5({sql_trim('short')}) ELSE md5({sql_trim('text')}) END AS digest, CASE WHEN {_KIND} = 5 THEN 'no answer field' END AS parse_error
  FROM conversations JOIN (SELECT conv_id, turn, string_agg(ch, '' ORDER BY pos) AS short FROM (
    SELECT conv_id, turn, pos, ch, row_number() OVER (PARTITION BY conv_id, turn, ch, pos - rk ORDER BY pos) AS k FROM (
      SELECT conv_id, turn, pos, ch, row_number() OVER (PARTITION BY conv_id, turn, ch ORDER BY pos) AS rk FROM (
        SELECT conv_id, turn, unnest(cs) AS ch, unnest(range(len(cs))) AS pos FROM (SELECT conv_id, turn, string_split(text, '') AS cs FROM conversations))))
    WHERE k <= 3 OR ch IN (chr(10), chr(9), chr(34), chr(92)) GROUP BY conv_id, turn) USING (conv_id, turn)""",
)
def q_parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    kind = (F.col("conv_id") + F.col("turn")) % 6
    text = F.col("text")
    full = F.to_json(F.struct(text.alias("aiTextFull")))
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("<AiTextFull>\r\n"), F.replace(text, F.lit("\n"), F.lit("\r\n")), F.lit("</aitextfull>")))
        .when(kind == 2, F.concat(F.lit("AITEXTFULL : "), text))
        .when(kind == 3, F.replace(text, F.lit("\n"), F.lit("\\n")))
        .when(kind == 4, F.concat(F.to_json(F.struct(text.alias("textFull"))), F.lit(" trailing words")))
        .otherwise(F.to_json(F.struct(text.alias("other"))))
    )
    d = views.table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))
    return tx.parse_responses(d).select("conv_id", "turn", F.md5("ai_text").alias("digest"), "parse_error")


@query(
    "T14_migrate_prompt_map",
    f"""SELECT doc_id, string_agg(k || '=' || md5(v), ';' ORDER BY k) AS entries, true AS changed FROM (
  SELECT doc_id, lang || '::auto' AS k, {sql_prompt('text')} AS v FROM documents WHERE text <> '' UNION ALL SELECT doc_id, lang || '::m1', {sql_prompt('text')} FROM documents WHERE text <> '') GROUP BY doc_id""",
)
def q_migrate_prompt_map(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.col("lang")
    m = F.create_map(
        F.concat(lang, F.lit("::auto")), F.lit("older"),
        lang, F.concat(F.lit("  "), "text"),
        F.concat(lang, F.lit("::m1")), F.col("text"),
        F.lit("zz::none"), F.lit(""),
    )
    d = docs(spark, sf).filter("text <> ''").select("doc_id", tx.migrate_prompt_map(m).alias("m"))
    listed = F.transform(F.array_sort(F.map_entries("m.entries")), lambda e: F.concat(e["key"], F.lit("="), F.md5(e["value"])))
    return d.select("doc_id", F.array_join(listed, ";").alias("entries"), F.col("m.changed").alias("changed"))


@query(
    "T37_target_language",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang WHEN 1 THEN coalesce(nullif(regexp_replace(regexp_extract(text, '[^\\n\\r]+'), '^\\s+|\\s+$', '', 'g'), ''), 'the target language specified in the rules') ELSE 'the target language specified in the rules' END AS target FROM documents""",
)
def q_target_language(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 3
    prompt = F.when(k == 0, F.concat("text", F.lit("\n  target  LANGUAGE : "), "lang", F.lit(" \nmore"))).when(k == 1, F.concat(F.lit("Target language:\n"), "text")).otherwise(F.col("text"))
    return docs(spark, sf).select("doc_id", tx.target_language(prompt).alias("target"))


@query(
    "T30_item_text",
    with_views("items", """SELECT image_id, para_index, item_index, CASE (para_index + item_index) % 4 WHEN 0 THEN text WHEN 1 THEN text || '!' WHEN 2 THEN text || '?' ELSE replace(text, ' ', '') END AS shown FROM items"""),
)
def q_item_text(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("para_index") + F.col("item_index")) % 4
    t = F.col("text")
    none = F.lit(None).cast("string")
    aliases = [F.when(k == 0, t).otherwise(F.lit("")), F.when(k == 1, F.concat(t, F.lit("!"))), none, F.when(k == 2, F.concat(t, F.lit("?"))), none, none, F.lit("")]
    return views.items(spark, sf).select("image_id", "para_index", "item_index", tx.item_text(aliases, F.split(t, " ")).alias("shown"))


@query(
    "T36_ordered_values",
    with_views("items", """SELECT image_id, para_index, string_agg(text, '|' ORDER BY item_index DESC) AS listed FROM items GROUP BY ALL"""),
)
def q_ordered_values(spark: SparkSession, sf: str) -> DataFrame:
    e = F.array_sort(F.collect_list(F.struct("item_index", "text")))
    m = F.map_from_entries(F.transform(e, lambda x: F.struct((10 - x["item_index"]).cast("string"), x["text"])))
    d = views.items(spark, sf).groupBy("image_id", "para_index").agg(m.alias("m"))
    return d.select("image_id", "para_index", F.array_join(tx.ordered_values("m"), "|").alias("listed"))
