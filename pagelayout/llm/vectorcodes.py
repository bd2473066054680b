"""Codes of vectors: a codebook per part, fitted by Lloyd rounds over cover trees."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelayout.llm.common import column, drop_table, table, wrap
from pagelayout.llm.covertree import CoverTree

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CHUNK = 2048  # vectors whose trees are built together
SALTS = 8


@dataclass
class Codes:
    """vectors: id, label, code (hex, two digits a part), error, label_error; codebooks: part -> entry -> components."""

    vectors: DataFrame
    codebooks: list[list[list[int]]]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.codebooks for entry in part for x in entry).encode()).hexdigest()


def _whole(vectors: list[list[float]], width: int, limit: int, scale: int) -> np.ndarray:
    """Vectors as integers: floor(scale * x), padded with zeros to ``width``."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    with np.errstate(over="ignore"):
        return np.clip(np.floor(out * scale), -limit, limit).astype(np.int64)


def vector_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Every vector's code: per part the index of the nearest entry of the part's codebook, and the summed squared distances.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components are dropped. Vectors are cut in ``parts`` equal parts; those of
    another length are padded with zeros to the longest, and that to a multiple of ``parts``. Components beyond the range in which an error fits a
    long (for 64 components 2**27, so x beyond half a million) are taken as its ends. Codebooks start as the parts of the vectors with the smallest ids (null ids
    last, equal ids by components; fewer vectors give fewer entries); each round replaces an entry by the floored mean of the parts nearest
    to it, ties to the lower index; entries without parts stay. ``label_error`` sums the errors of a label, nulls together. No vectors give no rows and empty codebooks.

    Arrow batches are cut in chunks; a task builds a cover tree per part of its chunk and writes it, one row per chunk, to the shared folder. A round
    reads the trees, assigns whole subtrees with their running sums, and sends one sum and count per part and entry and task batch; the
    new codebooks, parts times entries rows, go through the driver.
    """
    rows = wrap(vectors).select(column(vec_id).alias("id"), column(label).alias("label"), column(vector).alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & finite)
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts) * parts
    size, limit = width // parts, math.isqrt(2**62 // max(width, 1)) // 2

    as_double = F.transform("v", lambda x: x.cast("double"))
    first = rows.orderBy(F.asc_nulls_last("id"), as_double, F.asc_nulls_first("label")).limit(entries).select("v").collect()  # at most ``entries`` rows
    seeds = _whole([r["v"] for r in first], width, limit, scale).reshape(len(first), parts, size)
    books = [seeds[:, p].copy() for p in range(parts)]

    chunk_type = T.StructType([T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("labels", T.ArrayType(rows.schema["label"].dataType)), T.StructField("trees", T.ArrayType(T.StructType([T.StructField(n, T.BinaryType()) for n in ("points", "order", "nodes")])))])

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                some = batch.slice(a, CHUNK)
                whole = _whole(some.column("v").to_pylist(), width, limit, scale)
                trees = []
                for p in range(parts):
                    tree = CoverTree.build(whole[:, p * size : (p + 1) * size])
                    trees.append({"points": tree.points.astype(np.int32).tobytes(), "order": tree.order.tobytes(), "nodes": tree.nodes.tobytes()})

                def one(name: str, some: pa.RecordBatch = some) -> pa.Array:
                    held = some.column(name)
                    held = pa.concat_arrays([held])
                    return pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)

                kind = pa.list_(pa.struct([("points", pa.binary()), ("order", pa.binary()), ("nodes", pa.binary())]))
                yield pa.RecordBatch.from_arrays([one("id"), one("label"), pa.array([trees], kind)], names=["ids", "labels", "trees"])

    grown = table(rows.mapInArrow(grow, chunk_type))

    def read(trees: list[dict]) -> list[CoverTree]:
        out = []
        for t in trees:
            order = np.frombuffer(t["order"], np.int32)
            out.append(CoverTree(np.frombuffer(t["points"], np.int32).astype(np.int64).reshape(len(order), size), order, np.frombuffer(t["nodes"], np.int64).reshape(-1, 6)))
        return out

    def summed(batches: Iterator[pa.RecordBatch], books: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, counts = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books]
            for trees in batch.column("trees"):
                for p, tree in enumerate(read(trees.as_py())):
                    _, s, c = tree.assign(books[p])
                    sums[p] += s
                    counts[p] += c
            found = [(p, e, int(counts[p][e]), sums[p][e].tolist()) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist()]
            columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    for _ in range(rounds if width else 0):
        held = grown.select("trees").mapInArrow(lambda batches, books=books: summed(batches, books), "part int, entry int, n long, sums array<long>")
        totals = held.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(d)).cast("decimal(20,0)")).alias(f"d{d}") for d in range(size)])
        books = [b.copy() for b in books]
        for r in totals.collect():  # one row per part and entry
            books[r["part"]][r["entry"]] = [int(r[f"d{d}"]) // r["n"] for d in range(size)]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, trees in zip(batch.column("ids"), batch.column("labels"), batch.column("trees")):
                n = len(ids.values)
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                for p, tree in enumerate(read(trees.as_py()) if width else []):
                    nearest, _, _ = tree.assign(books[p])
                    code[tree.order, p] = nearest
                    error[tree.order] += ((tree.points - books[p][nearest]) ** 2).sum(axis=1)
                text = code.tobytes().hex()
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array([text[i * 2 * parts : (i + 1) * 2 * parts] for i in range(n)]), pa.array(error)], names=["id", "label", "code", "error"])

    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("label", rows.schema["label"].dataType)]).add("code", "string").add("error", "long")
    done = table(grown.mapInArrow(coded, kind))
    drop_table(grown)
    # a label may hold a third of all rows: its one total goes to every salt
    totals = done.groupBy("label").agg(F.sum(F.col("error").cast("decimal(20,0)")).try_cast("long").alias("label_error"))
    totals = totals.select(F.col("label").alias("l"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    salted = done.withColumn("salt", F.pmod(F.xxhash64("id", "code"), F.lit(SALTS)).cast("int"))
    out = salted.join(totals, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")))
    return Codes(out.select("id", "label", "code", "error", "label_error"), [b.tolist() for b in books])
