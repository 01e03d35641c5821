"""Interleaved sequences of text and media, with content-addressed payloads.

``parse`` turns HTML into ordered items: texts, and references to media with
their captions.  ``resolve`` joins the references with a media table by digest
and puts each sequence together again by position, so captions stay with their
media and an unresolved reference stays in its place with null fields.

``store`` writes payloads losslessly as 8-bit grey PNG images, 64 samples a
row, and ``features`` reads the stored bytes back.  Null texts count as empty; an
empty text is one row of zero bytes.  Repeated rows are kept apart by a row
number; equal payloads share one digest and so all their values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bramble.llm.common import Workspace, load, small_batches

WIDTH = 64
SCHEME = "sha256:"
ITEMS = "array<struct<position:int,kind:string,text:string,ref:string,caption:string>>"
FEATURES = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 1) -> bytes:
    """A grey image of 8-bit samples, one a byte."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.hstack([np.zeros((len(rows), 1), np.uint8), rows]).tobytes()
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image made by ``to_png``; raises if it is damaged."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG image")
    at, data, height = len(SIGNATURE), [], 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + n]
        if struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG image")
        if kind == b"IHDR":
            height = struct.unpack(">I", body[4:8])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, WIDTH + 1)
    return rows[:, 1:].tobytes()


def describe(payload: bytes) -> str:
    """Size, mean, deviation and a 64-bit average hash of the samples."""
    grey = np.frombuffer(payload, np.uint8).astype(np.int64)
    sums = np.add.reduceat(grey, np.linspace(0, len(grey), 65).astype(np.int64)[:-1])
    bits = np.packbits(sums * 64 > grey.sum()).tobytes().hex()
    return f"gray8:{WIDTH}x{len(grey) // WIDTH}:mean={grey.mean():.4f}:std={grey.std():.4f}:ahash={bits}"


def pad(data: bytes, unit: int = WIDTH) -> bytes:
    return data + b"\0" * (-len(data) % unit or unit * (not data))


def store(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_bytes, html, digest, media) of (doc_id, text): a page that shows the payload, and its image."""
    small_batches(docs.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            names, sizes, pages, digests, media = [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode()
                payload = pad(data)
                digest = hashlib.sha256(payload).hexdigest()
                names.append(name)
                sizes.append(len(data))
                digests.append(digest)
                pages.append(f'<article><figure><img src="{SCHEME}{digest}"><figcaption>{"" if name is None else name}</figcaption></figure></article>')
                media.append(to_png(payload))
            rows = pa.array(range(row, row + len(names)), pa.int64())
            row += len(names)
            yield pa.RecordBatch.from_arrays([rows, pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(pages, pa.string()), pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["row", "doc_id", "n_bytes", "html", "digest", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "row long, doc_id long, n_bytes long, html string, digest string, media binary")


class _Items(HTMLParser):
    """Texts between media, and media with the alternative text or the caption of their figure.

    A caption counts for all media of its figure, before and after it, and for those of figures within that have none of
    their own; without any media it is a text in its place.
    """

    BLOCKS = frozenset("p div article section h1 h2 h3 h4 h5 h6 li ul ol table tr td th br figure blockquote pre".split())
    SKIP = frozenset(("script", "style", "template"))

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.held: list[str] = []
        self.skipped = 0
        self.figures: list[dict] = []
        self.caption: list[str] | None = None

    def add(self, kind: str, text: str | None = None, ref: str | None = None, caption: str | None = None, figure: dict | None = None) -> dict:
        self.items.append({"kind": kind, "text": text, "ref": ref, "caption": caption, "figure": figure})
        return self.items[-1]

    def flush(self):
        text = " ".join("".join(self.held).split())
        self.held = []
        if text:
            self.add("text", text)

    def captioned(self):
        if self.caption is not None:
            said, self.caption = " ".join("".join(self.caption).split()), None
            if said:
                figure = self.figures[-1] if self.figures else None
                self.add("text", said, figure=figure)
                if figure is not None:
                    figure["said"].append(said)

    def closed(self):
        """The end of the innermost figure."""
        self.captioned()
        figure = self.figures.pop()
        for item in figure["media"]:
            if figure["said"]:
                item["caption"] = " ".join(figure["said"])
        if not figure["said"] and self.figures:
            self.figures[-1]["media"] += figure["media"]

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.skipped += 1
        if tag in self.BLOCKS:
            self.flush()
        if tag == "figure":
            self.figures.append({"media": [], "said": []})
        elif tag == "figcaption":
            self.captioned()
            self.flush()
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            at = dict(attrs)
            if at.get("src"):
                self.flush()
                item = self.add("media", ref=at["src"], caption=at.get("alt"))
                if self.figures:
                    self.figures[-1]["media"].append(item)

    def handle_endtag(self, tag):
        if tag in self.SKIP and self.skipped:
            self.skipped -= 1
        if tag == "figcaption":
            self.captioned()
        elif tag in self.BLOCKS:
            self.flush()
            if tag == "figure" and self.figures:
                self.closed()

    def handle_data(self, data):
        if not self.skipped:
            (self.held if self.caption is None else self.caption).append(data)

    def finished(self) -> list[dict]:
        self.close()
        self.captioned()
        self.flush()
        while self.figures:
            self.closed()
        kept = [i for i in self.items if not (i["figure"] and i["figure"]["media"])]
        return [{"position": n, **{k: i[k] for k in ("kind", "text", "ref", "caption")}} for n, i in enumerate(kept)]


def items(html: str | None) -> list[dict]:
    """The sequence of a page; null and empty pages have none."""
    parser = _Items()
    parser.feed(html or "")
    return parser.finished()


def parse(pages: DataFrame, html: str = "html") -> DataFrame:
    """(row, items) of pages with a unique ``row``."""
    small_batches(pages.sparkSession)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([items(x.as_py()) for x in batch.column(1)], kind)], ["row", "items"])

    return pages.select(F.col("row").cast("long"), F.col(html).cast("string")).mapInArrow(run, f"row long, items {ITEMS}")


def features(media: DataFrame) -> DataFrame:
    """Features of (digest, media), a row each, from the stored bytes."""
    small_batches(media.sparkSession)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1)):
                stored = stored.as_py()
                payload = from_png(stored)
                rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), describe(payload)))
            yield pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in FEATURES.split(", ")], r)) for r in rows], schema=pa.schema([("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    return media.select("digest", "media").mapInArrow(run, FEATURES)


def resolve(parsed: DataFrame, media: DataFrame) -> DataFrame:
    """(row, items) with each media item's columns of ``media`` (digest, ...) in the struct ``media``, null where unknown.

    Rows of ``media`` for one digest are equal, and repeated ones count once; the join carries references and what the caller
    kept of ``media``.  A page without items has an empty list.
    """
    flat = parsed.select("row", F.explode_outer("items").alias("item"))
    flat = flat.withColumn("digest", F.regexp_extract("item.ref", f"^{SCHEME}([0-9a-f]{{64}})$", 1))
    told = media.distinct().select("digest", F.struct(*[F.col(f"`{c}`") for c in media.columns if c != "digest"]).alias("media"))
    joined = flat.join(told, "digest", "left")
    lists = joined.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("item.position").alias("position"), "item", "media"))).alias("items"))
    return lists.select("row", F.filter("items", lambda i: i["position"].isNotNull()).alias("items"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts as media, stored, referenced from pages, resolved by digest and described."""
    work = Workspace(spark, "media")
    kept = work.table(store(load(spark, sf_dir, "documents")), "store")
    sequences = resolve(parse(kept), features(kept))
    shown = sequences.select("row", F.explode("items").alias("i")).filter("i.item.kind = 'media'").select("row", "i.media.*", F.col("i.item.caption").alias("caption"))
    return kept.select("row", "doc_id", "n_bytes").join(shown, "row").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "caption")
