"""Classification of error messages by ordered rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelayout.functions.exprs import col, trim_ws

STAGE_TAGS = ["download", "ai", "ocr", "render"]


@dataclass(frozen=True)
class Rule:
    """``groups``: every group must have one of its needles in the lower-cased message."""

    groups: list[list[str]]
    permanent: bool
    label: str
    stage: str = ""
    pattern: str = ""
    forced: bool = field(default=False)


# Needles, labels and stages, in the order in which they are tried.  "{tag}" stands for the
# stage tag found in the message, "{code}" for the matched status code; ``forced`` stages override the tag.
RULES = [
    Rule([["no overlay data"]], True, "{tag}ไม่พบข้อความในภาพ"),
    Rule([["no image data"]], True, "{tag}ไม่มีข้อมูลภาพ", "download"),
    Rule([["ai api_key is required", "missing_api_key"]], True, "[ai] ไม่มี AI Key", "ai", forced=True),
    Rule([["401", "unauthorized"], ["ai", "api_key", "key"]], True, "[ai] Key ไม่ถูกต้อง (401)", "ai", forced=True),
    Rule([["403", "forbidden"], ["ai", "api_key", "key"]], True, "[ai] Key ถูกปฏิเสธ (403)", "ai", forced=True),
    Rule([], True, "{tag}HTTP {code}", pattern=r"\b(401|403|404|410)\b"),
    Rule([["not an image"]], True, "{tag}ไฟล์ไม่ใช่ภาพ", "download"),
    Rule([["cannot identify image", "image file is truncated"]], True, "[ocr] ภาพเสียหาย", "ocr", forced=True),
    Rule([["unsupported"], ["image"]], True, "[ocr] รูปแบบภาพไม่รองรับ", "ocr", forced=True),
    Rule([["model"], ["not found", "not exist"]], True, "[ai] Model ไม่พบ", "ai", forced=True),
    Rule([["rate limit", "ratelimit", "too many requests", "http 429", " 429"]], False, "{tag}Rate limit"),
    Rule([["http 503", " 503", "overloaded", "temporarily"]], False, "{tag}เซิร์ฟเวอร์ไม่ว่าง"),
    Rule([["timeout", "timed out"]], False, "[{timeout}] หมดเวลา", "{timeout}", forced=True),
    Rule([["failed to fetch", "network error", "econnrefused"]], False, "{tag}เชื่อมต่อ API ล้มเหลว", "api"),
    Rule([["safety", "filter", "blocked", "policy"]], True, "{tag}ถูกบล็อก (Safety)"),
    Rule([["internal server error", "http 500", " 500"]], False, "{tag}เซิร์ฟเวอร์ AI ขัดข้อง (500)"),
    Rule([["โควต้า ai หมด", "quota", "insufficient", "payment required", "402"]], True, "[ai] โควต้าหมด (402)", "ai", forced=True),
    Rule([["usage limit", "quota exceeded", "resource exhausted", "daily limit", "limit reached"]], True, "[ai] CLI/AI usage limit reached", "ai", forced=True),
    Rule(
        [["requires authentication", "please visit the url to log in"]], True,
        '[ai] ต้องล็อกอิน Antigravity CLI (กรุณาเปิด cmd/terminal แล้วรัน `agy --print "hello" --dangerously-skip-permissions` เพื่อล็อกอิน)',
        "ai", forced=True,
    ),
    Rule([["expecting value", "cookie", "update_cookie.py"]], True, "[render] คุกกี้หมดอายุ (กรุณาอัปเดตคุกกี้ใหม่)", "render", forced=True),
    Rule([["rest submit failed"]], False, "[api] ส่งงานล้มเหลว", "api", forced=True),
    Rule([["rest poll failed"]], False, "[api] ตรวจสอบงานล้มเหลว", "api", forced=True),
]
UNKNOWN = "ผิดพลาด"


def contains_any(s: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(s, F.lit(n)) for n in needles])


def detect_stage(msg: Column | str) -> Column:
    """First stage tag found in the message, in fixed order."""
    m = col(msg)
    return F.coalesce(*[F.when(F.contains(m, F.lit(f"[{t}]")), F.lit(t)) for t in STAGE_TAGS], F.lit(""))


def classify_error(msg: Column | str) -> Column:
    """``struct(permanent, label, stage)`` of a message."""
    raw = F.coalesce(col(msg), F.lit(""))
    m = F.lower(raw)
    stage = detect_stage(raw)
    tag = F.when(stage == "", F.lit("")).otherwise(F.concat(F.lit("["), stage, F.lit("] ")))
    timeout = F.when(stage != "", stage).when(F.contains(m, F.lit("poll")), "api").when(F.contains(m, F.lit("ai")), "ai").otherwise("api")

    def result(permanent: bool, label: Column, st: Column) -> Column:
        return F.struct(F.lit(permanent).alias("permanent"), label.alias("label"), st.alias("stage"))

    def label_of(rule: Rule) -> Column:
        if rule.pattern:
            return F.concat(tag, F.lit("HTTP "), F.regexp_extract(m, rule.pattern, 1))
        if "{timeout}" in rule.label:
            return F.concat(F.lit("["), timeout, F.lit("] หมดเวลา"))
        if rule.label.startswith("{tag}"):
            return F.concat(tag, F.lit(rule.label[len("{tag}"):]))
        return F.lit(rule.label)

    def stage_of_rule(rule: Rule) -> Column:
        if rule.stage == "{timeout}":
            return timeout
        if rule.forced:
            return F.lit(rule.stage)
        return F.when(stage == "", F.lit(rule.stage)).otherwise(stage)

    chain = F.when(m == "", result(False, F.lit(""), F.lit("")))
    for rule in RULES:
        hit = m.rlike(rule.pattern) if rule.pattern else reduce(lambda a, b: a & b, [contains_any(m, g) for g in rule.groups])
        chain = chain.when(hit, result(rule.permanent, label_of(rule), stage_of_rule(rule)))
    snippet = F.when(F.length(raw) > 40, F.concat(F.left(raw, F.lit(37)), F.lit("..."))).otherwise(raw)
    return chain.otherwise(result(False, F.concat(tag, F.lit(UNKNOWN + " ("), snippet, F.lit(")")), stage))


def classify_error_sql(msg: str) -> tuple[str, str, str]:
    """The same rules as three SQL expressions: permanent, label, stage."""
    m = f"lower({msg})"
    stage = "CASE " + " ".join(f"WHEN contains({msg}, '[{t}]') THEN '{t}'" for t in STAGE_TAGS) + " ELSE '' END"
    tag = f"CASE WHEN ({stage}) = '' THEN '' ELSE '[' || ({stage}) || '] ' END"
    timeout = f"CASE WHEN ({stage}) <> '' THEN ({stage}) WHEN contains({m}, 'poll') THEN 'api' WHEN contains({m}, 'ai') THEN 'ai' ELSE 'api' END"

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    perm, label, stg = [], [], []
    for r in RULES:
        if r.pattern:
            cond, lab = f"regexp_matches({m}, '{r.pattern}')", f"({tag}) || 'HTTP ' || regexp_extract({m}, '{r.pattern}', 1)"
        else:
            cond = " AND ".join("(" + " OR ".join(f"contains({m}, {q(n)})" for n in g) + ")" for g in r.groups)
            lab = f"'[' || ({timeout}) || '] หมดเวลา'" if "{timeout}" in r.label else (f"({tag}) || {q(r.label[5:])}" if r.label.startswith("{tag}") else q(r.label))
        st = f"({timeout})" if r.stage == "{timeout}" else (q(r.stage) if r.forced else f"CASE WHEN ({stage}) = '' THEN {q(r.stage)} ELSE ({stage}) END")
        perm.append(f"WHEN {cond} THEN {str(r.permanent).lower()}")
        label.append(f"WHEN {cond} THEN {lab}")
        stg.append(f"WHEN {cond} THEN {st}")
    snippet = f"CASE WHEN length({msg}) > 40 THEN left({msg}, 37) || '...' ELSE {msg} END"
    return (
        f"CASE {' '.join(perm)} ELSE false END",
        f"CASE {' '.join(label)} ELSE ({tag}) || '{UNKNOWN} (' || {snippet} || ')' END",
        f"CASE {' '.join(stg)} ELSE ({stage}) END",
    )


# Words that say where a processing error came from.
AI_WORDS = [
    "ai ", "ai_", "openai", "gemini", "anthropic", "api_key", "api key", "rate limit", "ratelimit", "429", "quota", "usage limit",
    "resource exhausted", "daily limit", "limit reached", "codex cli", "antigravity cli", "agy", "model", "generate", "chat/completions",
]
IMAGE_WORDS = ["cannot identify image", "image file is truncated", "unsupported", "decode", "pixel"]
# Words that rule a retry out, and words that allow it.
PERMANENT_WORDS = ["usage limit", "quota", "resource exhausted", "daily limit", "limit reached", "not found", "please install", "api_key", "api key"]
RETRY_WORDS = ["timed out", "timeout", "empty output", "no output", "execution failed", "econnreset", "connection", "spawn", "eperm", "temporarily"]
RATE_WORDS = ["rate limit", "ratelimit", "too many requests", "http 429", " 429", "http 503", " 503", "overloaded", "temporarily"]


def tag_error_stage(msg: Column | str) -> Column:
    m = F.lower(col(msg))
    tag = F.when(contains_any(m, AI_WORDS), "[ai] ").when(contains_any(m, IMAGE_WORDS), "[ocr] ").otherwise("[render] ")
    return F.concat(tag, col(msg))


def is_retryable(msg: Column | str) -> Column:
    m = F.lower(F.coalesce(col(msg), F.lit("")))
    return (m != "") & ~contains_any(m, PERMANENT_WORDS) & contains_any(m, RETRY_WORDS)


def is_rate_limited(msg: Column | str) -> Column:
    return contains_any(F.lower(F.coalesce(col(msg), F.lit(""))), RATE_WORDS)


# Kinds of provider error, tried in order; the last test of the first kind ignores blanks.
ERROR_KINDS = [
    ("invalid_api_key", ["401", "unauthorized"]),
    ("auth_error", ["403", "forbidden", "permission"]),
    ("rate_limited", ["429", "rate limit", "too many"]),
    ("connection_error", ["connect", "timeout", "resolv"]),
]


def resolve_error_kind(msg: Column | str) -> Column:
    m = F.lower(F.coalesce(col(msg), F.lit("")))
    literal = F.contains(F.replace(m, F.lit(" "), F.lit("")), F.lit("invalid.*key"))
    chain = F.when(contains_any(m, ERROR_KINDS[0][1]) | literal, ERROR_KINDS[0][0])
    for kind, words in ERROR_KINDS[1:]:
        chain = chain.when(contains_any(m, words), kind)
    return chain.otherwise("provider_error")


def short_cli_error(msg: Column | str) -> Column:
    """Kind and short text of a command-line tool's failure: ``struct(kind, detail)``."""
    t = trim_ws(F.coalesce(col(msg), F.lit("")))
    m = F.lower(t)
    has = lambda *words: contains_any(m, list(words))
    report = F.regexp_extract(t, r"(?i)full report available at:\s*([^\r\n]+)", 1)
    again = F.regexp_extract(t, r"(?i)try again(?: at| in)?\s+([^\r\n.]+)", 1)
    auth = has("opening authentication page") | (has("authentication") & has("browser"))
    broken = has("cannot find module") & has("@google") & has("gemini-cli")
    limit = has("usage limit", "quota exceeded", "resource exhausted", "daily limit", "limit reached", "too many requests")

    def out(kind: str, detail: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))

    return (
        F.when(auth, out("auth", F.lit("")))
        .when(broken, out("broken_install", F.lit("")))
        .when(has("error when talking to gemini api"), out("api", trim_ws(report)))
        .when(limit, out("usage_limit", F.when(again != "", F.concat(F.lit("Try again "), trim_ws(again), F.lit("."))).otherwise("")))
        .otherwise(out("other", F.left(t, F.lit(500))))
    )
