"""WARC archives: written one gzip member per record, read back by byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from pagelayout.llm.common import column, partitions, row_hash, shared_dir, wrap

MAGIC = b"\x1f\x8b\x08"
SALTS = 16
RANGE_BYTES = 32 << 20
_READ = 1 << 20
_BATCH = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, offset long, length long, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, problem string"


def _store(path: str) -> tuple[files.FileSystem, str]:
    return files.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def assign_records(pages: DataFrame, page_id: str = "page_id", payload: str = "html", least: int = 0) -> DataFrame:
    """Which pages become responses and which revisits of an equal payload.

    ``row``, payload binary, first (page_id of the response, for revisits), record_type. Of pages with equal payloads of at
    least ``least`` bytes, the one with the smallest page_id is the response; of repeated ids the first by url and row. Null
    payloads are empty; null ids come after all others.

    Digests with one page need no partner. For the others one row per digest is made by partial aggregation and copied to
    ``SALTS`` salts, so that pages of one frequent payload spread.
    """
    rows = wrap(pages)
    rows = rows.select("row", row_hash(rows).alias("tie"), column(page_id).alias("id"), F.coalesce(column(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.join(groups, ["digest", "salt"], "left")
    same_id = F.row_number().over(W.partitionBy("digest", "salt", "id").orderBy("tie"))
    revisit = F.col("n").isNotNull() & ~(F.col("id").eqNullSafe(F.col("first")) & (same_id == 1))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
    return rows.select("row", "id", "payload", F.when(F.col("record_type") == "revisit", F.col("first")).alias("first"), "record_type")


def _name(page_id: object) -> str:
    return f"<urn:page:{'' if pd.isna(page_id) else quote(str(page_id))}>"


def _record(kind: str, page_id: object, url: str | None, first: object, payload: bytes, date: str) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f%]", lambda m: quote(m[0]), url))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(first)}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "WARC/1.1\r\n".encode() + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> str:
    """Write a record per page to archives in ``folder`` (default: a new one in the shared folder); returns the folder.

    One archive per task, named after its partition. A task writes under a name of its own attempt and renames at the end, so a
    repeated or a second attempt leaves one whole archive.
    """
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = assign_records(pages, page_id, payload, least)
    rows = rows.select(F.col("id").cast("string").alias("id"), column(url).cast("string").alias("url"), F.col("first").cast("string").alias("first"), "payload", "record_type")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        store, base = _store(folder)
        name = f"{base}/part-{task.partitionId():06d}.warc.gz"
        own, out, n = f"{base}/.{task.partitionId():06d}-{task.taskAttemptId()}.open", None, 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(own)
                squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                url_ = None if pd.isna(r.url) else r.url
                out.write(squeeze.compress(_record(r.record_type, r.id, url_, r.first, bytes(r.payload), date)) + squeeze.flush())
                n += 1
        if out is not None:
            out.close()
            store.move(own, name)
        yield pd.DataFrame({"n": [n]})

    rows.mapInPandas(write, "n long").agg(F.sum("n")).collect()
    spark = pages.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)  # without pages no task has made it
    return folder


class _Window:
    """Bytes of a file from a position on, read as needed; earlier ones are let go."""

    def __init__(self, file, at: int) -> None:
        self.file, self.at, self.data = file, at, bytearray()
        file.seek(at)

    def upto(self, end: int) -> bool:
        """Have bytes up to ``end`` of the file; False if it is shorter."""
        while self.at + len(self.data) < end:
            more = self.file.read(_READ)
            if not more:
                return False
            self.data += more
        return True

    def drop(self, at: int) -> None:
        del self.data[: at - self.at]
        self.at = at


def _member(window: _Window, at: int) -> tuple[bytes, int] | None | str:
    """The decoded member at ``at`` and its end; None if none that holds a record begins there; a text if it is damaged."""
    squeeze, out, pos = zlib.decompressobj(31), bytearray(), at
    while not squeeze.eof:
        if not window.upto(pos + 1):
            return "truncated" if out.startswith(b"WARC/") else None
        piece = bytes(window.data[pos - window.at : pos - window.at + 65536])
        try:
            out += squeeze.decompress(piece)
        except zlib.error as e:
            return str(e) if out.startswith(b"WARC/") else None
        pos += len(piece)
        if out[:5] != b"WARC/"[: len(out)]:
            return None
    return (bytes(out), pos - len(squeeze.unused_data)) if out.startswith(b"WARC/") else None


def _headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _parsed(raw: bytes) -> dict:
    head, _, rest = raw.partition(b"\r\n\r\n")
    h = _headers(head)
    block = rest[: int(h.get("content-length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = h.get("warc-type"), h.get("warc-payload-digest", "").removeprefix("sha1:")
    problem = None if len(rest) >= len(block) == int(h.get("content-length", 0)) else "short record"
    if kind == "revisit":
        payload, size = None, int(_headers(http).get("content-length", 0))
    else:
        own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        problem = problem or (f"digest {digest} in the header" if digest and digest != own else None)
        digest, size = own, len(payload)
    uri = h.get("warc-target-uri")
    return {"record_type": kind, "record_id": h.get("warc-record-id"), "target_uri": None if uri is None else unquote(uri), "refers_to": h.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": size, "payload": payload, "problem": problem}


def scan_range(path: str, start: int, end: int) -> Iterator[dict]:
    """Records whose gzip member begins in [start, end) of a file.

    The range is searched for the gzip magic; a candidate counts if it decodes to the head of a record. It is then read
    to its end, be it beyond the range, and the search goes on behind it. A damaged member gives a row with its problem.
    """
    store, name = _store(path)
    with store.open_input_file(name) as file:
        window, at = _Window(file, start), start
        while at < end:
            window.drop(at)
            window.upto(at + _READ)
            found = window.data.find(MAGIC)
            if found < 0:
                if len(window.data) < _READ:
                    return
                at += len(window.data) - len(MAGIC) + 1
                continue
            at += found
            if at >= end:
                return
            window.drop(at)
            member = _member(window, at)
            if isinstance(member, tuple):
                raw, after = member
                yield {"file": path, "offset": at, "length": after - at, **_parsed(raw)}
                at = after
            else:
                if member:
                    yield {"file": path, "offset": at, "length": None, "problem": member}
                at += 1


def read_warc(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """Records of all archives in a folder, one row each (``RECORD``).

    Files are cut into byte ranges; each task scans its ranges and owns the members that begin there, so a large archive is read by
    many tasks, and a lost one is just read again. Empty files have no ranges. An archive inside a stored payload may look like
    members of the outer one only if gzip kept it verbatim.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path", "length").where("length > 0")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    ranges = found.select("path", "length", starts.alias("start")).select("path", "start", F.least(F.col("start") + range_bytes, "length").alias("end"))
    names = [c.split()[0] for c in RECORD.split(", ")]

    def frame(rows: Iterable[dict]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"length": "Int64", "payload_bytes": "Int64"})

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                for record in scan_range(r.path, r.start, r.end):
                    held += len(record.get("payload") or b"")
                    rows.append(record if payloads else record | {"payload": None})
                    if len(rows) >= _BATCH or held > 8 * _READ:
                        yield frame(rows)
                        rows, held = [], 0
        if rows:
            yield frame(rows)

    return ranges.repartition(partitions(spark), "path", "start").mapInPandas(scan, RECORD)


def page_of(record_id):
    """The page_id in a record's name, as text; null if it has none."""
    return F.nullif(F.regexp_extract(record_id, r"^<urn:page:(.*)>$", 1), F.lit(""))
