"""Every registered query on a small written table, against its contract in plain Python; and on empty tables."""

import base64
import collections
import hashlib
import random
import re
import zlib

import pytest

from pagelayout.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(4)
    word = lambda: f"w{int(rng.random() ** 2 * 900)}"
    texts = [" ".join(word() for _ in range(rng.choice([0, 3, 30, 120, 300]))) for _ in range(60)]
    texts += [texts[4], texts[4], None, "", "é ü", "x" * 900, "x" * 900 + "y", "a  b\n c"]
    return [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 5 else None, 0) for i, t in enumerate(texts)]


def pages():
    body = ["<p>one</p>", "<p>one</p>", None, None, "", "<article><p>two é</p></article>", "<p>one</p>"]
    return [(50 - i, f"http://h/{i}", b) for i, b in enumerate(body)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(documents(), DOCS).repartition(3).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(2).write.parquet(f"{top}/pages.parquet")
    return top


def rows(spark, folder, name):
    return queries.queries()[name](spark, folder).collect()


def test_op1(spark, folder):
    docs = documents()
    got = {r["doc_id"]: r for r in rows(spark, folder, "op1_order_minhash")}
    assert len(got) == len(docs)
    for (i, t, *_), (_, n, *_) in zip(docs, docs[1:] + docs[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_edited"] <= 1 and (edited != t or got[i]["near_edited"] == 1)
    prints = collections.defaultdict(set)
    for i, t, *_ in docs:
        prints[t or ""].add(got[i]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_op2(spark, folder):
    docs = documents()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in docs}
    got = {r["doc_id"]: r for r in rows(spark, folder, "op2_mix_sources")}
    assert {i: r["size"] for i, r in got.items()} == size and all(r["taken"] <= 3 * r["size"] for r in got.values())
    for source in {d[3] for d in docs}:
        own = [got[d[0]] for d in docs if d[3] == source]
        assert {r["source_size"] for r in own} == {sum(r["size"] for r in own)}
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)


def test_op5(spark, folder):
    got = {r["page_id"]: r for r in rows(spark, folder, "op5_html_extraction")}
    assert len(got) == 7 and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert got[45]["text"] == "two é" and got[48]["text"] == "" and got[50]["url"] == "http://h/0"


def test_op7(spark, folder):
    got = {r["page_id"]: r for r in rows(spark, folder, "op7_warc")}
    first = {}
    for i, _, html in pages():
        first[html or ""] = min(i, first.get(html or "", i))
    for i, _, html in pages():
        data = (html or "").encode()
        want = "response" if first[html or ""] == i else "revisit"
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), want)
        assert got[i]["refers_to"] == (None if want == "response" else first[html or ""])


def test_op8(spark, folder):
    data = [(i, (t or "").encode()) for i, t, *_ in documents()]
    times = collections.Counter(d[a : a + 400] for _, d in data for a in range(len(d) - 399))
    got = {r["doc_id"]: r for r in rows(spark, folder, "op8_suffix_array_dedup")}
    for i, d in data:
        gone = bytearray(len(d))
        for a in range(len(d) - 399):
            if times[d[a : a + 400]] > 1:
                gone[a : a + 400] = b"\1" * 400
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest())


def test_op10(spark, folder):
    got = sorted(rows(spark, folder, "op10_balanced_shards"), key=lambda r: (r["shard"], r["slot"]))
    text = {d[0]: (d[1] or "").encode() for d in documents()}
    assert [r["doc_id"] for r in got] == sorted(text)
    at = collections.Counter()
    for r in got:
        assert (r["size"], r["text_crc32"], r["law"], r["slot"], r["grown_shard"]) == (len(text[r["doc_id"]]) + 1, zlib.crc32(text[r["doc_id"]]), "bytes", at[r["shard"]], None)
        at[r["shard"]] += 1


def test_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name in ("op1_order_minhash", "op2_mix_sources", "op5_html_extraction", "op7_warc", "op8_suffix_array_dedup", "op9_lm_scores", "op10_balanced_shards", "op12_substring_dedup"):
        assert rows(spark, str(tmp_path), name) == []
