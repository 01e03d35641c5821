"""WARC archives: a writer that deduplicates payloads and a splittable reader.

The writer makes one gzip member a record.  The reader plans byte ranges of
every archive; a task scans its range for the gzip magic, takes a candidate for
a member only if it decompresses to a WARC header, and owns the records whose
member starts inside its range, the last of which may end beyond it.

Null payloads count as empty; a null address is written as ``urn:page:<id>``.
Repeated rows give repeated records.  If the page that others revisit occurs
several times with that payload, each occurrence is a response.  A null page_id
is always a response and never revisited unless all pages of a payload lack one.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import Workspace, load, open_fs, small_batches, write_atomically

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that carries the page id."""
    if page_id is None:
        return "urn:uuid:00000000-0000-8000-9000-000000000000"
    h = f"{page_id & (1 << 64) - 1:016x}"
    return f"urn:uuid:{h[:8]}-{h[8:12]}-8{h[12:15]}-8{h[15]}00-000000000000"


def page_of(record: str) -> int | None:
    h = record.strip("<>").rpartition(":")[2].replace("-", "")
    if h[16] == "9":
        return None
    n = int(h[:12] + h[13:16] + h[17], 16)
    return n - (1 << 64) if n >> 63 else n


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Target-URI: {uri}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha1(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with refers_to: the largest page_id with an equal payload of ``least`` bytes or more.

    Only digests are grouped, with partial counts; the pages meet the few that
    revisit another by page and digest, so a payload of a third of all pages isn't gathered.
    """
    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    own = own.withColumn("digest", F.sha1(F.encode("html", "utf-8")))
    keys = own.filter(F.octet_length("html") >= least).select("page_id", "digest")
    largest = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    later = keys.join(largest, "digest").filter("page_id < refers_to").distinct()
    return own.join(later, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")


def write(pages: DataFrame, folder: str, *, date: str = "2024-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """Write (page_id, url, html, refers_to) to ``folder``, an archive a task; returns path and size of each, once run."""
    small_batches(pages.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        uri, some = f"{folder}/pages-{TaskContext.get().partitionId():06d}.warc.gz", False
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return

        def fill(out):
            batch = first
            while batch is not None:
                for page, url, html, to in zip(*(batch.column(i) for i in range(4))):
                    coder = zlib.compressobj(level, zlib.DEFLATED, 31)
                    out.write(coder.compress(record(page.as_py(), url.as_py(), html.as_py().encode(), to.as_py(), date)) + coder.flush())
                batch = next(batches, None)

        size = write_atomically(uri, fill)
        yield pa.RecordBatch.from_pydict({"path": [uri], "size": [size]})

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, size long")


def members(file, size: int, start: int, end: int, block: int = 1 << 18):
    """Decompressed records whose gzip member starts in [start, end)."""
    held, base = b"", start

    def grow() -> bool:
        nonlocal held
        more = file.read_at(min(block, size - base - len(held)), base + len(held)) if base + len(held) < size else b""
        held += more
        return bool(more)

    def decode(at: int, least: int | None):
        """(bytes, end) of the member at ``at``; of its first ``least`` bytes only if that is given; None if it isn't one."""
        coder, out, pos, n = zlib.decompressobj(31), [], at, 0
        try:
            while not coder.eof and (least is None or n < least):
                if pos == base + len(held) and not grow():
                    return None
                out.append(coder.decompress(held[pos - base :], 0 if least is None else least))
                n += len(out[-1])
                pos = base + len(held) - len(coder.unused_data) - len(coder.unconsumed_tail)
                if coder.unconsumed_tail and least is not None:
                    break
        except zlib.error:
            return None
        return b"".join(out), pos

    at = start
    while at < end:
        found = held.find(MAGIC, at - base)
        if found < 0:
            # keep two bytes: the magic may straddle two reads
            keep = max(0, len(held) - len(MAGIC) + 1)
            base, held = base + keep, held[keep:]
            at = base
            if at >= end or not grow():
                return
            continue
        at = base + found
        if at >= end:
            return
        head = decode(at, 16)
        whole = decode(at, None) if head and head[0].startswith(b"WARC/1.") else None
        if whole is None:
            at += 1
            continue
        yield whole[0]
        at = whole[1]
        held, base = held[at - base :], at


def parse(raw: bytes) -> tuple:
    """The fields of RECORD from one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.partition(": ")[::2] for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    url = fields["WARC-Target-URI"]
    kind = fields["WARC-Type"]
    if kind == "response":
        digest, n, to = sha1(payload), len(payload), None
    else:
        digest, n, to = told, int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), page_of(fields["WARC-Refers-To"])
    return page_of(fields["WARC-Record-ID"]), url, n, digest, kind, to, digest == told


def read(archives: DataFrame, *, split_bytes: int = 8 << 20) -> DataFrame:
    """Records of ``archives`` (path, size), read in byte ranges of ``split_bytes``."""
    spark = archives.sparkSession
    step = F.lit(split_bytes).cast("long")
    ranges = archives.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, step)).alias("start"))
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start").select("path", "size", "start")

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                store, name = open_fs(path)
                with store.open_input_file(name) as f:
                    rows = []
                    for raw in members(f, size, start, min(size, start + split_bytes)):
                        rows.append(parse(raw))
                        if len(rows) == 1024:
                            yield pack(rows)
                            rows = []
                    if rows:
                        yield pack(rows)

    return ranges.mapInArrow(run, RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to archives in the shared folder and read back."""
    work = Workspace(spark, "warc")
    archives = work.table(write(revisits(load(spark, sf_dir, "pages")), work.sub("archives")), "manifest")
    return read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
