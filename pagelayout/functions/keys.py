"""Keys, fingerprints and URL forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelayout.functions.exprs import col, trim_ws


def _s(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def normalize_engine(c: Column | str) -> Column:
    v = F.replace(F.lower(trim_ws(_s(c))), F.lit("-"), F.lit("_"))
    return F.when(v.isin("paddle", "paddle_ocr", "paddleocr"), "paddleocr").otherwise("google_lens")


def prompt_signature(prompt: Column | str) -> Column:
    t = trim_ws(_s(prompt))
    return F.when(t == "", "").otherwise(F.left(F.sha2(t, 256), F.lit(12)))


def cache_key(img_hash: Column, lang: Column, mode: Column, source: Column, engine: Column, ai: Sequence[Column] | None = None) -> Column:
    """Bar-joined result key; ``lang`` is already normalised, ``ai`` is (provider, model, base_url, prompt)."""
    bar = F.lit("|")
    parts = [_s(img_hash), _s(lang), trim_ws(_s(mode)), trim_ws(_s(source)), normalize_engine(engine)]
    if ai:
        provider, model, base_url, prompt = ai
        parts += [trim_ws(_s(provider)), trim_ws(_s(model)), trim_ws(_s(base_url)), prompt_signature(prompt)]
    joined = [parts[0]]
    for p in parts[1:]:
        joined += [bar, p]
    return F.concat(*joined)


def page_cache_key(key: Column, lang: Column, mode: Column, engine: Column) -> Column:
    scope = F.when(mode == "lens_text", "text").when(mode == "lens_images", "images").otherwise(_s(mode))
    eng = trim_ws(_s(engine))
    full = F.concat_ws("::", _s(key), _s(lang), scope, F.when(eng == "", "google_lens").otherwise(eng))
    return F.when((_s(key) == "") | (_s(lang) == "") | (scope == ""), "").otherwise(full)


def json_string(c: Column) -> Column:
    """One JSON string literal."""
    a = F.to_json(F.array(c))
    return F.substring(a, F.lit(2), F.length(a) - 2)


def translation_key(provider: Column, model: Column, base_url: Column, lang: Column, prompt_sig: Column, text: Column) -> Column:
    """sha1 over a JSON object with blanks after its separators."""
    fields = {"provider": provider, "m": model, "u": base_url, "l": lang, "p": prompt_sig, "t": text}
    parts: list[Column] = []
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit(("{" if i == 0 else ", ") + f'"{name}": '), json_string(_s(value))]
    return F.sha1(F.concat(*parts, F.lit("}")))


# Fixed order of the fields that identify a request.
FINGERPRINT_FIELDS = ["src", "imageDataUri", "mode", "lang", "source", "ocrEngine", "aiProvider", "aiModel", "aiBaseUrl", "aiPrompt", "aiReasoningEffort", "pageUrl"]


def request_fingerprint(values: dict[str, Column]) -> Column:
    def of(name: str) -> Column:
        v = _s(values[name]) if name in values else F.lit("")
        return F.when(v == "", "google_lens").otherwise(v) if name == "ocrEngine" else v

    basis = F.struct(*[of(n).alias(n) for n in FINGERPRINT_FIELDS])
    return F.concat(F.lit("tp:"), F.sha2(F.to_json(basis), 256))


def valid_idempotency_key(c: Column | str) -> Column:
    k = trim_ws(_s(c))
    return F.when(k.rlike(r"^[A-Za-z0-9._:-]{1,256}\z"), k).otherwise("")


# Key spellings and prefixes by provider, tried in order.
KEY_WORDS = [
    ("cli_gemini", ["cli-gemini", "cli_gemini"]),
    ("cli_codex", ["cli-codex", "cli_codex"]),
    ("cli_antigravity", ["cli-antigravity", "cli_antigravity"]),
    ("local", ["local", "ollama", "lmstudio", "llama", "llama-server", "localhost", "none", "dummy", "no-key"]),
]
KEY_PREFIXES = [
    ("gemini", ["AIza"]), ("huggingface", ["hf_"]), ("openrouter", ["sk-or-"]), ("opencode", ["sk-oc-", "oc_", "opencode_"]),
    ("anthropic", ["sk-ant-"]), ("groq", ["gsk_"]),
]


def provider_from_key(c: Column | str) -> Column:
    k = trim_ws(_s(c))
    low = F.lower(k)
    chain = F.when(low.isin(*KEY_WORDS[0][1]), KEY_WORDS[0][0])
    for name, words in KEY_WORDS[1:]:
        chain = chain.when(low.isin(*words), name)
    chain = chain.when(low.startswith("local-") | low.startswith("local_"), "local")
    for name, prefixes in KEY_PREFIXES:
        for p in prefixes:
            chain = chain.when(k.startswith(p), name)
    return chain.otherwise("openai")


# ---------------------------------------------------------------- URLs


def image_url(c: Column | str) -> Column:
    """Image form: without its fragment; text that is no absolute URL is only trimmed."""
    t = trim_ws(_s(c))
    return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_replace(t, "#.*$", "")).otherwise(t)


def page_url(c: Column | str, base: Column | str) -> Column:
    """Page form: resolved against the page, without its fragment."""
    t, b = trim_ws(_s(c)), trim_ws(_s(base))
    origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(b, r"[?#].*$", "")
    folder = F.regexp_replace(path, r"[^/]*$", "")
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    full = (
        F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), t)
        .when(t.startswith("//"), F.concat(scheme, t))
        .when(t.startswith("/"), F.concat(origin, t))
        .when(t.startswith("#"), b)
        .when(t.startswith("?"), F.concat(path, t))
        .otherwise(F.concat(folder, t))
    )
    clean = F.regexp_replace(full, "#.*$", "")
    return F.when(t == "", "").when(origin == "", F.regexp_replace(t, "[#?].*$", "")).otherwise(clean)


def api_url(c: Column | str) -> Column:
    """API base form: scheme added, trailing slashes dropped, local names become 127.0.0.1."""
    t = trim_ws(_s(c))
    u = F.when(t.rlike(r"(?i)^https?://"), t).otherwise(F.concat(F.lit("http://"), t))
    u = F.regexp_replace(u, "/+$", "")
    u = F.regexp_replace(u, r"(?i)^(https?)://(localhost|0\.0\.0\.0|\[::1\])(?=[:/?#]|$)", "$1://127.0.0.1")
    return F.when(t == "", "").otherwise(u)


def url_path(c: Column | str) -> Column:
    return F.regexp_extract(_s(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def chapter_key_page(c: Column | str) -> Column:
    """Page form: only the right-most data segment counts."""
    segs = F.filter(F.split(url_path(c), "/"), lambda s: s != "")
    n = F.size(segs)
    at = F.array_max(F.transform(segs, lambda s, i: F.when(s.isin("data", "data-saver"), i + 1)))
    key = F.concat(F.lit("md:"), F.array_join(F.slice(segs, at, F.lit(3)), "/"))
    return F.when(at.isNotNull() & (n >= at + 2), key).otherwise("")


def chapter_key(c: Column | str) -> Column:
    """Background form: the right-most data segment that has two segments after it; null without one."""
    segs = F.filter(F.split(url_path(c), "/"), lambda s: s != "")
    n = F.size(segs)
    at = F.array_max(F.transform(segs, lambda s, i: F.when(s.isin("data", "data-saver") & (i + 3 <= n), i + 1)))
    return F.when(at.isNotNull(), F.concat(F.lit("md:"), F.array_join(F.slice(segs, at, F.lit(3)), "/")))


def chapter_id(c: Column | str) -> Column:
    return F.regexp_extract(url_path(c), r"(?i)/chapter/([a-f0-9-]{8,})", 1)


def same_chapter(a: Column | str, b: Column | str) -> Column:
    return (chapter_id(a) != "") & (chapter_id(a) == chapter_id(b))


def host_matches(c: Column | str, domain: str) -> Column:
    host = F.lower(F.regexp_extract(_s(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return (host == domain) | host.endswith("." + domain)


def _zero_based(digits: Column) -> Column:
    return F.when(digits != "", F.greatest(F.lit(0), digits.try_cast("long") - 1))


def page_index(c: Column | str) -> Column:
    """0-based page number from path, query or fragment; null if the URL has none."""
    u = _s(c)
    in_path = F.regexp_extract(url_path(u), r"^/+(?:[^/]+/+)*?chapter/+[^/]+/+(\d+)(?:/|$)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    page = F.regexp_extract(query, r"(?:^|&)page=([^&]*)", 1)
    short = F.regexp_extract(query, r"(?:^|&)p=([^&]*)", 1)
    q = F.when(page != "", page).otherwise(short)
    frag = F.regexp_extract(F.regexp_extract(u, r"(#.*)$", 1), r"(?i)(?:^|[?#&])page=(\d+)", 1)
    return F.coalesce(_zero_based(in_path), F.when(q.rlike(r"^\d+$"), _zero_based(q)), _zero_based(frag))


def image_page_index(alt: Column, tag_page: Column, stored_key: Column, original: Column, data_page: Column, near_page: Column) -> Column:
    """0-based page number of an image from its label, stored tags or surroundings."""
    a = _s(alt)

    def number(x: Column) -> Column:
        return F.when(_s(x).rlike(r"^\d+$"), _zero_based(_s(x)))

    return F.coalesce(
        _zero_based(F.regexp_extract(a, r"^\s*(\d+)\s*[-_]", 1)),
        _zero_based(F.regexp_extract(a, r"(?:^|\D)(\d+)\s*/\s*(\d+)", 1)),
        _zero_based(F.regexp_extract(a, r"(?i)page\s*(\d+)", 1)),
        number(tag_page),
        _zero_based(F.regexp_extract(_s(stored_key), r"/(\d+)\s*[-_]", 1)),
        _zero_based(F.regexp_extract(_s(original), r"/(\d+)\s*[-_]", 1)),
        number(data_page),
        number(near_page),
    )


def file_part(c: Column | str) -> Column:
    t = F.regexp_replace(_s(c), r"\.[^.]+$", "")
    t = F.regexp_replace(t, r'[\\/:*?"<>|]+', "_")
    t = F.trim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.when(t == "", "page").otherwise(t)


def export_name(stem: Column, mode: Column, lang: Column, ext: Column) -> Column:
    def part(c: Column, default: str) -> Column:
        return F.regexp_replace(file_part(F.when(_s(c) == "", default).otherwise(c)), r"\s+", "-")

    return F.concat_ws(".", file_part(stem), part(mode, "mode"), part(lang, "en"), ext)
