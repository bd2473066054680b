"""Benchmark decontamination: item-sized windows by an exact bound on shared shingles, exact verification; DataFrame functions only.

SimHash and its Hamming blocks are column functions here, but choose no windows: no radius keeps every pair above the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelayout.llm.common import column, cut, small, wrap

SHINGLE, THRESHOLD = 5, 0.8
BITS, RADIUS = 64, 20
BLOCKS = RADIUS + 1  # within the radius, one block at least is equal
SALTS = 8
MOST_SHINGLES = 1_000_000  # shingles of the benchmark that are broadcast, at most
MOST_ITEMS = 20_000
WHITE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """Lower-case words cut at ASCII white space; none for null."""
    bare = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(F.length(bare) > 0, F.split(bare, WHITE)).otherwise(F.array().cast("array<string>"))


def _places(words: Column, size: int) -> Column:
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(words: Column, size: int) -> Column:
    """64-bit hashes of all runs of ``size`` words."""
    return F.transform(_places(words, size), lambda i: F.xxhash64(F.slice(words, i, size)))


def _shingles(words: Column, size: Column) -> Column:
    """All runs of ``size`` words as text, numbered by occurrence, so that a weighted set is a plain one."""
    places = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    runs = F.array_sort(F.transform(places, lambda i: F.array_join(F.slice(words, i, size), " ")))
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def number(s: Column, run: Column) -> Column:
        n = F.when(run == s["last"], s["n"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("last"), n.alias("n"), F.concat(s["out"], F.array(F.concat_ws("\n", run, n.cast("string")))).alias("out"))

    return F.aggregate(runs, start, number, lambda s: s["out"])


def simhash(words: Column) -> Column:
    """64-bit SimHash of a bag of words: a bit is set where most words' hashes have it; 32 running sums count two bits each."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    pair, out = F.lit((1 << 32) | 1), F.lit(0).cast("long")

    def counts(j: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(h, j).bitwiseAND(pair))

    for j in range(32):
        both = counts(j)
        for count, bit in ((both.bitwiseAND(F.lit(0xFFFFFFFF)), j), (F.shiftrightunsigned(both, 32), j + 32)):
            one = 1 << bit if bit < 63 else -(1 << 63)
            out = out.bitwiseOR(F.when(count * 2 > F.size(words), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def hamming_blocks(fingerprint: Column) -> Column:
    """The fingerprint's ``BLOCKS`` disjoint blocks, each with its number."""
    cuts = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
    parts = [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:])]
    return F.array(*[F.struct(F.lit(i).alias("no"), p.alias("value")) for i, p in enumerate(parts)])


def benchmark_items(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct items that have words: item (smallest id), words, n, size of its shingles."""
    rows = wrap(benchmark)
    rows = rows.select(column(item_id).alias("item"), words_of(column(text)).alias("words")).where(F.size("words") > 0)
    rows = rows.groupBy("words").agg(F.min("item").alias("item"))
    return rows.select("item", F.xxhash64("words").alias("key"), "words", F.size("words").alias("n"), F.least(F.size("words"), F.lit(SHINGLE)).alias("size"))


def candidate_starts(places: Column, shingles: Column) -> Column:
    """Starts of all windows that hold enough of ``places``, where a text has a shingle of an item; windows and item have so many ``shingles``.

    The shared weight cannot exceed the places in a window, and their union is no smaller than the item. A window that begins at a
    place or after the one before it holds enough if it reaches ``need`` - 1 places on; these ranges of starts are disjoint.
    """
    need = F.ceil(shingles * THRESHOLD - 1e-9).cast("int")

    def starts(i: Column) -> Column:
        low = F.greatest(F.get(places, i + need - 1) - shingles + 1, F.get(places, i - 1) + 1)  # no place before: null, passed over
        return F.when(low <= F.get(places, i), F.sequence(low, F.get(places, i))).otherwise(none)

    none = F.array().cast("array<int>")
    return F.when(F.size(places) >= need, F.flatten(F.transform(F.sequence(F.lit(0), F.size(places) - need), starts))).otherwise(none)


def contaminated_windows(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Windows of document texts that repeat a benchmark item: node (digest of the text), item, start (word), n, similarity.

    Windows have an item's number of words (less at the ends of a text) and stand at any start, whatever the order of what they share. A
    window with a similarity of 0.8 holds at 0.8 of the item's shingle places or more a shingle of the item: those that do are verified by
    the exact similarity of weighted shingle sets, so none is left out. Equal windows of one item are one.

    Words are lower case and cut at ASCII white space. Items of fewer than five words have one shingle; items and texts without words match
    nothing. Equal texts are handled once, equal items go by their smallest id. Null ids are ids.
    """
    items = cut(benchmark_items(benchmark, item_id, item_text))
    sizes = [r[0] for r in items.select("size").distinct().collect()]  # at most five numbers
    known = F.lit(None).cast("array<struct<pos:int,h:bigint>>")
    for size in sorted(sizes):
        own = F.transform(shingle_hashes(F.col("words"), size), lambda h, i: F.struct(i.alias("pos"), h.alias("h")))
        known = F.when(F.col("size") == size, own).otherwise(known)
    index = items.select("key", "n", F.explode(known).alias("s")).select("key", "n", F.col("s.pos").alias("at"), F.col("s.h").alias("h"))
    index = small(cut(index), MOST_SHINGLES)

    rows = wrap(docs).select(column(doc_id).alias("id"), column(text).alias("text")).where("text is not null")
    hits = None
    for size in sorted(sizes):
        split = rows.select("id", F.md5("text").alias("node"), words_of(F.col("text")).alias("words"))
        found = split.select("id", "node", F.posexplode(shingle_hashes(F.col("words"), size)).alias("pos", "h")).join(index, "h")
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = rows.select("id", F.md5("text").alias("node"), F.lit(0).alias("pos")).join(index, F.lit(False))
    windows = hits.groupBy("node", "key", "n").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("pos")).alias("places"))
    windows = windows.join(small(cut(items.select("key", "item", F.col("words").alias("item_words"), "size")), MOST_ITEMS), "key")
    windows = windows.withColumn("starts", candidate_starts(F.col("places"), F.col("n") - F.col("size") + 1)).where(F.size("starts") > 0)
    windows = cut(windows.drop("places"))

    texts = windows.groupBy("node").agg(F.min("id").alias("i"))
    own = rows.withColumn("t", F.md5("text")).join(texts.withColumnRenamed("node", "t"), "t").where(F.col("id").eqNullSafe(F.col("i")))
    own = own.groupBy("t").agg(F.first("text").alias("text")).select(F.col("t").alias("node"), words_of(F.col("text")).alias("all_words"))
    windows = windows.join(own, "node").withColumn("theirs", _shingles(F.col("item_words"), F.col("size")))
    # starts before the text's begin and a text shorter than the item give equal windows
    spans = F.array_distinct(F.transform("starts", lambda s: F.struct(F.greatest(s, F.lit(0)).alias("a"), F.least(s + F.col("n"), F.size("all_words")).alias("z"))))
    spans = F.transform(spans, lambda s: F.struct(s["a"].alias("start"), F.slice("all_words", s["a"] + 1, s["z"] - s["a"]).alias("words")))
    pairs = windows.select("node", "item", "theirs", "size", F.explode(spans).alias("s")).select("node", "item", "theirs", "size", "s.*")
    pairs = pairs.select("node", "item", "theirs", "start", F.size("words").alias("n"), _shingles(F.col("words"), F.col("size")).alias("ours"))
    both = F.size(F.array_intersect("ours", "theirs"))
    pairs = pairs.withColumn("similarity", both / (F.size("ours") + F.size("theirs") - both))
    return pairs.where(F.col("similarity") >= THRESHOLD).select("node", "item", "start", "n", "similarity")


def _salted(found: DataFrame) -> DataFrame:
    return found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """A row per document and item it repeats: ``row``, item, windows, start (of the most similar), similarity."""
    found = contaminated_windows(docs, benchmark, doc_id, text, **columns)
    best = F.struct("similarity", -F.col("start"))
    found = cut(found.groupBy("node", "item").agg(F.count(F.lit(1)).alias("windows"), F.max_by("start", best).alias("start"), F.max("similarity").alias("similarity")))
    rows = wrap(docs).withColumn("node", F.md5(column(text))).withColumn("salt", F.pmod(F.xxhash64(column(doc_id)), F.lit(SALTS)).cast("int"))
    return rows.join(_salted(found), ["node", "salt"]).select("row", "item", "windows", "start", "similarity")


def decontaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **columns) -> DataFrame:
    """The documents that repeat no item, as they came."""
    found = cut(contaminated_windows(docs, benchmark, doc_id, text, **columns).select("node").distinct())
    rows = wrap(docs).withColumn("node", F.md5(column(text))).withColumn("salt", F.pmod(F.xxhash64(column(doc_id)), F.lit(SALTS)).cast("int"))
    return rows.join(_salted(found), ["node", "salt"], "left_anti").select("row.*")
