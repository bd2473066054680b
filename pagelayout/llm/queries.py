"""The registered queries of this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelayout.llm import conversations, decontamination, fingerprints, html, lm, mixing, neardup, quality, recompression, sharding, substrings, vectorcodes, warc
from pagelayout.llm.common import column, load

Query = Callable[[SparkSession, str], DataFrame]


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint against those of its edited text and of the next document."""
    docs = fingerprints.neighbour_fingerprints(load(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    replaced = F.floor(n / 2).cast("int")
    docs = docs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), n - replaced), F.substring("next_text", F.lit(1), replaced)))
    docs = docs.withColumn("edited_fp", fingerprints.fingerprint(F.col("edited")))
    return docs.select(
        "row.doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fp")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes from it."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    docs = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long").alias("words"), F.xxhash64("text").alias("text_hash"))
    mix = mixing.mix_sources(docs, size=column("words"))
    shards = F.transform("copies", lambda c: c["shard"])
    return mix.select("row.doc_id", "size", "source_size", "target", "taken", shards.alias("shards"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and decision."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    scored = quality.quality_scores(docs, load(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "row.source", "evidence", "host_posterior", "site_posterior", "score", "keep")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class of near duplicates."""
    found = neardup.near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "class_id")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url", html.extract_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it repeats."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated_documents(docs, load(spark, sf_dir, "benchmark"))
    return found.select("row.doc_id", F.col("item").alias("item_id"), "windows", "start", "similarity")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    folder = warc.write_warc(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    records = warc.read_warc(spark, folder, payloads=False)
    return records.select(warc.page_of(F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).cast("long").alias("refers_to"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated strings of 400 bytes."""
    left = substrings.without_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return left.select("row.doc_id", "n_bytes", removed.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's stupid-backoff score."""
    scored = lm.lm_scores(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return scored.select(F.col("id").alias("doc_id"), F.col("words").alias("n_words"), "score", (F.col("score") / F.nullif("words", F.lit(0))).alias("mean_score"))


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 16 contiguous shards of equal bytes."""
    docs = load(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    docs = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.balanced_shards(docs, 16, "doc_id", column("size"))
    return placed.select("row.doc_id", "size", "row.text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error, with the digest of the codebooks."""
    codes = vectorcodes.vector_codes(load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codes.vectors.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.sha256()).alias("codebooks_sha256"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated windows of 35 words."""
    left = recompression.without_repeated_words(load(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate(F.zip_with("starts", "ends", lambda a, z: (z - a).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
    return left.select("row.doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by a hash, with the cheapest edits that mend it."""
    turns = conversations.damaged(load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return conversations.repair_conversations(turns, dropped=column("gone")).withColumnRenamed("conv", "conv_id")


def queries() -> dict[str, Query]:
    named = [op1_order_minhash, op2_mix_sources, op3_quality_classifier, op4_near_duplicates, op5_html_extraction, op6_decontamination, op7_warc, op8_suffix_array_dedup, op9_lm_scores, op10_balanced_shards, op11_vector_codes, op12_substring_dedup, op13_repair_conversations]
    return {q.__name__: q for q in named}


def oracle_sql() -> dict[str, str]:
    return {}
