"""Media columns: documents as interleaved sequences of text and media references.

HTML is parsed into an ordered array of items (pos, kind, text, ref, caption): text blocks, and references to images,
audio and video, each with the caption of its figure or its alt text. References name payloads by digest; a join on the
digest resolves them, and position and caption stay with the item; items without a reference take part in no join, so they
meet in no task. Payloads are kept in a media store as binary pixmaps
of 64 pixels a row, 8 bits a sample, which give the bytes back unchanged.

Edge cases: null or empty html has no items; a reference that no payload answers stays with a null payload; repeated
rows keep their own sequences; equal payloads are one payload; an empty table gives an empty result; other columns
pass through, columns named like an item's fields or the media table's columns are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, shared_dir, written

ITEMS = "array<struct<pos:int,kind:string,text:string,ref:string,caption:string>>"
FIELDS = ("pos", "kind", "text", "ref", "caption")
SLICE = 500
WIDTH = 64
ROW = 3 * WIDTH
MEDIA_TAGS = {"img": "image", "video": "video", "audio": "audio"}
BLOCK_TAGS = {"p", "div", "article", "section", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "table", "tr", "td", "th", "blockquote", "pre", "figure", "header", "footer", "nav", "body", "br", "hr"}


class Items(HTMLParser):
    """Collects a page's items in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.text: list[str] = []
        self.hidden = 0
        self.figure: list[int] | None = None
        self.caption: list[str] | None = None

    def flush(self):
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in MEDIA_TAGS:
            self.flush()
            own = dict(attrs)
            if own.get("src"):
                self.items.append([MEDIA_TAGS[tag], None, own["src"], own.get("alt")])
                if self.figure is not None:
                    self.figure.append(len(self.items) - 1)
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure":
                self.figure = []

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            caption, self.caption = " ".join("".join(self.caption).split()), None
            for k in self.figure or []:
                self.items[k][3] = caption
        elif tag in BLOCK_TAGS:
            self.flush()
            if tag == "figure":
                self.figure = None

    def handle_data(self, data):
        if self.caption is not None:
            self.caption.append(data)
        elif not self.hidden:
            self.text.append(data)


def items_of(html: str | None) -> list[dict]:
    p = Items()
    p.feed(html or "")
    p.close()
    p.flush()
    return [{"pos": k, "kind": kind, "text": text, "ref": ref, "caption": caption} for k, (kind, text, ref, caption) in enumerate(p.items)]


def with_items(df: DataFrame, html: str = "html") -> DataFrame:
    """df with items, the parsed sequence."""
    df = df.drop("items")
    place = df.columns.index(html)
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())]))

    def run(batches):
        for b in batches:
            for k in range(0, len(b), SLICE):  # parsed items are larger than their text
                part = b.slice(k, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([items_of(x.as_py()) for x in part.column(place)], kind)], names=[*b.schema.names, "items"])

    return df.mapInArrow(run, df.withColumn("items", F.lit(None).cast(ITEMS)).schema)


def resolved(df: DataFrame, media: DataFrame, digest: str = "digest") -> DataFrame:
    """One row per item of df.items, its fields beside df's other columns, joined with the media table (one row per digest)."""
    kept = [c for c in df.columns if c not in {"items", *FIELDS, *media.columns}]
    items = df.select(*kept, F.explode_outer("items").alias("__item")).select(*kept, "__item.*")
    # Rows without a reference get keys that no digest has and that are spread evenly.
    items = items.withColumn("__ref", F.coalesce("ref", F.concat(F.lit(" "), F.xxhash64("text", "pos").cast("string"))))
    return items.join(media, items["__ref"] == media[digest], "left").drop(media[digest]).drop("__ref")


def to_pixmap(payload: bytes) -> bytes:
    """A payload of whole rows as a binary pixmap."""
    return b"P6\n%d %d\n255\n" % (WIDTH, len(payload) // ROW) + payload


def from_pixmap(media: bytes) -> bytes:
    magic, size, depth, payload = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P6" or depth != b"255" or len(payload) != 3 * width * height:
        raise ValueError("not a pixmap of the expected form")
    return payload


def feature_of(payload: bytes) -> str:
    """Mean and standard deviation of each channel, and a difference hash over nine parts of the picture."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, 3).astype(np.float64)
    parts = [p.mean() for p in np.array_split(x.ravel(), 9)]
    bits = "".join("1" if b > a else "0" for a, b in zip(parts, parts[1:], strict=False))
    return ";".join(f"{m:.4f},{s:.4f}" for m, s in zip(x.mean(0), x.std(0), strict=True)) + ";" + bits


def padded(text: str) -> F.Column:
    """The text, followed by spaces up to a positive multiple of a row's bytes."""
    rows = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / ROW))
    return F.concat(F.col(text), F.repeat(F.lit(" "), (rows * ROW - F.octet_length(text)).cast("int")))


def media_store(payloads: DataFrame, folder: str) -> DataFrame:
    """Writes payload (text) of each row as a pixmap; returns the store: digest, media. Repeats within a task are stored once."""
    spark = payloads.sparkSession

    def run(batches):
        seen: set[bytes] = set()
        for b in batches:
            digests, media = [], []
            for x in b.column(0):
                raw = x.as_py().encode()
                key = hashlib.sha256(raw)
                if key.digest() not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key.digest())
                    digests.append("sha256:" + key.hexdigest())
                    media.append(to_pixmap(raw))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], names=["digest", "media"])

    schema = "digest string, media binary"
    payloads.select("payload").mapInArrow(run, schema).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def features(store: DataFrame) -> DataFrame:
    """One row per digest of the store, from the stored bytes: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def row(digest: str, media: bytes):
        p = from_pixmap(media)
        return digest, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(p)

    def run(batches):
        for b in batches:
            if len(b):
                rows = [row(d.as_py(), m.as_py()) for d, m in zip(*b.columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])

    return store.select("digest", "media").mapInArrow(run, schema).dropDuplicates(["digest"])


def page_of(text: F.Column, figure: F.Column) -> F.Column:
    """HTML of a text: a paragraph for each line that is not blank, with the figure in the middle."""
    plain = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.filter(F.split(plain, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>")))
    half = F.ceil(F.size(lines) / 2).cast("int")
    return F.concat(F.lit("<article>"), F.array_join(F.slice(lines, 1, half), ""), figure, F.array_join(F.slice(lines, half + 1, F.size(lines)), ""), F.lit("</article>"))


def document_media(docs: DataFrame) -> DataFrame:
    """Each row of docs (doc_id, text) as a page of its lines around a picture of its text: the resolved items in order, with n_bytes of the text and n_items of the page."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    df = df.withColumn("payload", padded("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    store = media_store(df, shared_dir(docs.sparkSession, "media"))
    found = written(features(store), "features")
    ref = F.concat(F.lit("sha256:"), F.sha2("payload", 256))
    figure = F.concat(F.lit("<figure><img src='"), ref, F.lit("'><figcaption>"), F.col("n_bytes").cast("string"), F.lit(" bytes</figcaption></figure>"))
    pages = with_items(df.select("doc_id", "n_bytes", page_of(F.col("text"), figure).alias("html"))).drop("html")
    return resolved(pages.withColumn("n_items", F.size("items").cast("long")), found)
