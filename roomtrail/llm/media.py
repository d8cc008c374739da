"""Interleaved document sequences: ordered text and media references of pages, with
payloads stored once per digest and joined back.

A page's markup becomes an array of structs (position, kind, text, digest, caption).
Media live in a table of their own, keyed by the SHA-256 of the stored form; any
number of pages may refer to one entry. Stored media are 8-bit grey PNG images: one
byte of payload is one sample, rows are ROW samples wide, zlib keeps them lossless.
"""

from __future__ import annotations

import binascii
import hashlib
import html as html_lib
import re
import struct
import uuid
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, shared_dir

ROW = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:"
ITEM = "struct<position:int,kind:string,text:string,digest:string,caption:string>"
_BLOCK = frozenset("address article aside blockquote div dd dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_MEDIA = frozenset("img audio video source embed".split())
_SKIP = frozenset("script style template noscript title head".split())


# --- stored form --------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of ROW."""
    return data + bytes(-len(data) % ROW or ROW * (not data))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", binascii.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """A grey 8-bit image of ROW samples a row; ``payload`` is a positive multiple of ROW long."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)  # filter type 0 before each row
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    head = struct.pack(">IIBBBBB", ROW, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """Samples of an image that ``to_png`` stored; damage raises ValueError."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body = 8, b"", []
    while at < len(data):
        size, kind = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8]
        part, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if struct.pack(">I", binascii.crc32(kind + part)) != check:
            raise ValueError("damaged chunk")
        head = part if kind == b"IHDR" else head
        if kind == b"IDAT":
            body.append(part)
        at += 12 + size
    width, rows, depth, colour = struct.unpack(">IIBB", head[:10])
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, width + 1)
    if (depth, colour) != (8, 0) or lines[:, 0].any():
        raise ValueError("unexpected form")
    return lines[:, 1:].tobytes()


# --- markup -------------------------------------------------------------------------


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.skip = 0
        self.figure: list[dict] = []  # media of the open figure
        self.in_caption = self.in_figure = False
        self.caption: list[str] = []

    def flush(self):
        body = " ".join("".join(self.text).split())
        self.text = []
        if body:
            self.items.append({"position": len(self.items), "kind": "text", "text": body, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.skip += 1
        if tag in _BLOCK or tag == "br":
            self.flush()
        if tag == "figure":
            self.in_figure, self.figure, self.caption = True, [], []
        elif tag == "figcaption":
            self.in_caption = True
        elif tag in _MEDIA and not self.skip:
            found = dict(attrs)
            source = found.get("src") or ""
            if source.startswith(SCHEME):
                self.flush()
                item = {"position": len(self.items), "kind": "media", "text": None, "digest": source[len(SCHEME) :], "caption": " ".join((found.get("alt") or "").split()) or None}
                self.items.append(item)
                if self.in_figure:
                    self.figure.append(item)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.skip = max(0, self.skip - 1)
        if tag in ("figcaption", "figure"):
            self.in_caption = False
        if tag == "figure":
            said = " ".join("".join(self.caption).split())
            for item in self.figure:  # a caption belongs to every medium of its figure
                item["caption"] = said or item["caption"]
            self.in_figure = False
        if tag in _BLOCK:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.caption if self.in_caption else self.text).append(data)


def items_of(html: str | None) -> list[dict]:
    """Text blocks and media references of one page, in page order."""
    p = _Items()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.items


def sequences(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``(id, items)`` for every row: positions count from 0 without gaps. Null and
    empty markup gives no items; references of another scheme are left out."""

    def rows(batch: pa.RecordBatch) -> dict:
        return {"id": batch.column(0), "items": [items_of(t) for t in batch.column(1).to_pylist()]}

    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html"))
    return arrow_map(base, ["id", "html"], f"id long, items array<{ITEM}>", rows, by="html")


def resolve(items: DataFrame, media: DataFrame) -> DataFrame:
    """``items(items, ...)`` as one row per item, its other columns kept, with the columns
    of ``media(digest, ...)`` beside it; text items and unknown digests have nulls there. ``media`` must have a
    digest once. Text items take no part in the join, so that no key is null."""
    each = items.select(*[c for c in items.columns if c != "items"], F.inline("items"))
    others = [c for c in media.columns if c != "digest"]
    nothing = [F.lit(None).cast(media.schema[c].dataType).alias(c) for c in others]
    refs = each.filter("digest IS NOT NULL").join(media, "digest", "left").select(*each.columns, *others)
    return refs.union(each.filter("digest IS NULL").select(*each.columns, *nothing))


# --- documents as interleaved pages ---------------------------------------------------


def page_of(text: str, digest: str, title: str) -> str:
    """A page with the text's lines as paragraphs and its medium in a figure."""
    lines = "".join(f"<p>{html_lib.escape(x, quote=False)}</p>" for x in re.split(r"\n+", text) if x.strip())
    return f'<article>{lines}<figure><img src="{SCHEME}{digest}"><figcaption>{title}</figcaption></figure></article>'


def from_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, items, n_bytes, digest, stored)``: each document's markup parsed into its
    sequence, and the medium its reference names. Null texts are empty."""

    def rows(batch: pa.RecordBatch) -> dict:
        out: dict = {"doc_id": batch.column(0), "items": [], "n_bytes": [], "digest": [], "stored": []}
        for text in batch.column(1).to_pylist():
            data = (text or "").encode()
            stored = to_png(padded(data))
            digest = hashlib.sha256(stored).hexdigest()
            out["items"].append(items_of(page_of(text or "", digest, f"{len(data)} bytes")))
            for name, value in (("n_bytes", len(data)), ("digest", digest), ("stored", stored)):
                out[name].append(value)
        return out

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id long, items array<{ITEM}>, n_bytes long, digest string, stored binary"
    return arrow_map(base, ["doc_id", "text"], schema, rows, by="text")


def features(media: DataFrame) -> DataFrame:
    """``media(digest, stored)`` read back: sizes, digests and a feature of each payload."""

    def rows(batch: pa.RecordBatch) -> dict:
        names = ("digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
        out: dict = {n: [] for n in names}
        for digest, stored in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            payload = from_png(stored)
            x = np.frombuffer(payload, np.uint8)
            share = np.bincount(x >> 5, minlength=8) * 255 // len(x)
            feature = f"{len(x) // ROW}x{ROW}:" + bytes(share.astype(np.uint8)).hex() + f":{int(x.sum(dtype=np.int64)) // len(x)}"
            values = (digest, len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-ROW:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
            for n, v in zip(names, values, strict=True):
                out[n].append(v)
        return out

    schema = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(media, ["digest", "stored"], schema, rows, by="stored")


def store(built: DataFrame) -> DataFrame:
    """The media written below the shared folder and read again, as (doc_id, items, n_items,
    n_bytes, digest, stored); ``items`` are the media items alone of a sequence of ``n_items``."""
    path = f"{shared_dir(built.sparkSession)}/media-{uuid.uuid4().hex}"
    refs = F.filter("items", lambda x: x["kind"] == "media")
    built.select("doc_id", refs.alias("items"), F.size("items").alias("n_items"), "n_bytes", "digest", "stored").write.option("compression", "none").parquet(path)
    return built.sparkSession.read.parquet(path)

