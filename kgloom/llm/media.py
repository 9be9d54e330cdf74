"""Operator 9: media columns as interleaved document sequences.

``sequences`` parses HTML into an ordered array of items: text blocks and media references, each with its position, a
reference with its source and caption (the figcaption of its figure, wherever it stands there, else alt or title; a
figcaption without media is a text item). ``resolved`` joins the references with a table of payloads by digest and puts them
back at their positions, captions beside them; references whose digest is unknown stay, unresolved.

``document_media`` makes a page of each document: its lines, whole and in order, as blocks, and after half of them a figure with the
document's payload as its medium. The page is parsed, its reference resolved, and the features of the payload are
read from its place in the sequence.

Payloads are stored as 8-bit grey images, 64 samples wide (binary PGM, the number of bytes before padding as a comment), in a
Parquet table; rows are keyed by the SHA-256 of the payload. A task stores each payload once; copies from other tasks are
equal and meet as small feature rows, so payloads are never shuffled. What is read back is checked against its digest.

Nulls and edge cases: a null text is empty (one row of 64 zero samples); null HTML has no items; broken HTML is parsed as
far as it goes; repeated rows are returned each; an empty table gives an empty result. Texts of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import checkpoint, documents, id_and_text, map_rows, narrow_batches, shared_dir, stored, text_of

WIDTH = 64
#: Elements whose text is not shown, elements that end a text block, and elements that name media.
HIDDEN = {"script", "style", "template", "noscript"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "dd", "div", "dl", "dt", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
MEDIA = {"img", "video", "audio", "source", "embed", "iframe"}
ITEM = "struct<pos: int, kind: string, text: string, ref: string, caption: string>"
ITEM_TYPE = pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])


SPACES = re.compile(r"[\t\n\f\r ]+")


class _Items(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items, self.words, self.hidden = [], [], 0
        self.figures, self.caption = [], None  # for each open figure the places of its media and its captions; the words of an open caption

    def block(self, words: list[str] | None = None) -> None:
        text = SPACES.sub(" ", "".join(self.words if words is None else words)).strip(" ")
        if words is None:
            self.words = []
        if text:
            self.items.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "figcaption":
            self.close_caption()
            self.block()
            self.caption = []
        elif tag in BLOCKS:
            if tag == "figure":
                self.close_caption()
            self.boundary()
            if tag == "figure":
                self.figures.append(([], []))
        elif tag in MEDIA and not self.hidden:
            at = dict(attrs)
            if at.get("src"):
                self.block()
                if self.figures:
                    self.figures[-1][0].append(len(self.items))
                self.items.append({"kind": "media", "text": None, "ref": at["src"], "caption": at.get("alt") or at.get("title") or None})

    def handle_endtag(self, tag: str) -> None:
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self.close_caption()
        elif tag in BLOCKS:
            if tag == "figure":
                self.close_figure()
            else:
                self.boundary()

    def boundary(self) -> None:
        """A block begins or ends; inside a caption that is a space."""
        if self.caption is None:
            self.block()
        else:
            self.caption.append(" ")

    def close_caption(self) -> None:
        if self.caption is not None:
            words, self.caption = self.caption, None
            if self.figures:
                self.figures[-1][1].append("".join(words))
            else:
                self.block(words)

    def close_figure(self) -> None:
        self.close_caption()
        self.block()
        if self.figures:
            media, captions = self.figures.pop()
            text = SPACES.sub(" ", " ".join(captions)).strip(" ")
            for at in media:
                self.items[at]["caption"] = text or self.items[at]["caption"]
            if not media:
                self.block([text])

    def close_all(self) -> None:
        while self.figures:
            self.close_figure()
        self.close_caption()
        self.block()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parse_items(text: str | None) -> list[dict]:
    """The ordered items of an HTML text."""
    parser = _Items()
    parser.feed(text or "")
    parser.close()
    parser.close_all()
    return [{"pos": i, **x} for i, x in enumerate(parser.items)]


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, items): the interleaved sequence of every row."""
    narrow_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), text_of(html_col).alias("html"))
    make = lambda: lambda columns: [columns[0], [parse_items(t) for t in columns[1]]]
    return map_rows(rows, f"id long, items array<{ITEM}>", pa.schema([("id", pa.int64()), ("items", pa.list_(ITEM_TYPE))]), make)


def resolved(found: DataFrame, payloads: DataFrame, texts: bool = True) -> DataFrame:
    """(id, items): the sequences with the payload row (all columns but digest) of each media item as ``payload``.

    payloads has one row for each digest; a source ``sha256:`` and a digest refers to it. Positions and captions stay as parsed.
    Without ``texts`` the text items keep their places but not their words, which then do not travel.
    """
    columns = [c for c in payloads.columns if c != "digest"]
    text = F.col("x.text") if texts else F.lit(None).cast("string")
    rows = found.withColumn("row", F.monotonically_increasing_id()).select("id", "row", F.explode_outer("items").alias("x"))
    rows = stored(rows.select("id", "row", "x.pos", "x.kind", text.alias("text"), "x.ref", "x.caption"), "items")  # stored, so that row numbers stay
    item = F.struct("pos", "kind", "text", "ref", "caption", "payload")
    digest = F.when(F.col("ref").startswith("sha256:"), F.substring("ref", 8, 64))
    media = rows.where(F.col("ref").startswith("sha256:")).withColumn("digest", digest)
    media = media.join(payloads.select("digest", F.struct(*columns).alias("payload")), "digest", "left").select("row", "id", F.when(F.col("kind").isNotNull(), item).alias("item"))
    kind = media.schema["item"].dataType["payload"].dataType
    rest = rows.where("ref IS NULL OR NOT startswith(ref, 'sha256:')").withColumn("payload", F.lit(None).cast(kind)).select("row", "id", F.when(F.col("kind").isNotNull(), item).alias("item"))
    return media.unionByName(rest).groupBy("row", "id").agg(F.array_sort(F.collect_list("item"), lambda x, y: x["pos"] - y["pos"]).alias("items")).select("id", "items")


def payload_of(text: str) -> bytes:
    raw = text.encode()
    return raw + bytes(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def to_image(payload: bytes, n_bytes: int) -> bytes:
    return b"P5\n# %d\n%d %d\n255\n" % (n_bytes, WIDTH, len(payload) // WIDTH) + payload


def from_image(image: bytes) -> tuple[bytes, int]:
    """(samples, number of bytes before padding)."""
    magic, note, size, depth, samples = image.split(b"\n", 4)
    width, height = map(int, size.split())
    if magic != b"P5" or depth != b"255" or width * height != len(samples):
        raise ValueError("not an 8-bit grey image")
    return samples, int(note[1:])


def feature(samples: bytes) -> str:
    """An 8 x 8 mean hash of the image, with mean and deviation of its samples."""
    import numpy as np

    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH).astype(np.float64)
    columns = x.reshape(len(x), 8, 8).mean(2)
    if len(columns) < 8:
        columns = np.repeat(columns, -(-8 // len(columns)), 0)
    cells = np.add.reduceat(columns, np.arange(8) * len(columns) // 8, 0) / np.diff([*(np.arange(8) * len(columns) // 8), len(columns)])[:, None]
    bits = np.packbits((cells > cells.mean()).ravel()).tobytes().hex()
    return f"{bits}-{x.mean():.4f}-{x.std():.4f}"


def page_of(text: str) -> str:
    """A page with the lines of a text as blocks and, after half of them, its payload as a figure."""
    lines = text.split("\n")
    half, n_bytes = len(lines) // 2, len(text.encode())
    block = lambda some: "".join(f"<p>{html.escape(x, quote=False)}</p>" for x in some)
    figure = f'<figure><img src="sha256:{hashlib.sha256(payload_of(text)).hexdigest()}"><figcaption>{n_bytes} bytes in {len(lines)} lines</figcaption></figure>'
    return f"<article>{block(lines[:half])}{figure}{block(lines[half:])}</article>"


def document_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, html): the page of every document."""
    make = lambda: lambda columns: [columns[0], [page_of(t) for t in columns[1]]]
    return map_rows(id_and_text(docs, id_col, text_col), "doc_id long, html string", pa.schema([("doc_id", pa.int64()), ("html", pa.string())]), make)


def store_payloads(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write (digest, image) below path and read it back; a task leaves out payloads that it has stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: set[bytes] = set()
        for batch in batches:
            digests, images = [], []
            for text in batch.column(1).to_pylist():
                payload = payload_of(text)
                digest = hashlib.sha256(payload)
                if digest.digest() not in had:
                    digests.append(digest.hexdigest())
                    images.append(to_image(payload, len(text.encode())))
                    if len(had) < 500_000:
                        had.add(digest.digest())
            if digests:
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array(images, pa.binary())], names=["digest", "image"])

    id_and_text(docs, id_col, text_col).mapInArrow(run, "digest string, image binary").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def payload_features(images: DataFrame) -> DataFrame:
    """One row for each digest, computed from the stored images."""

    def make():
        def each(columns: list[list]) -> list:
            rows = []
            for digest, image in zip(*columns, strict=True):
                samples, n_bytes = from_image(image)
                sha = hashlib.sha256(samples).hexdigest()
                if sha != digest:
                    raise ValueError(f"payload {digest} was not read back as stored")
                rows.append((digest, n_bytes, len(samples), sha, zlib.crc32(samples[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature(samples)))
            return list(zip(*rows, strict=True))

        return each

    fields = [("digest", pa.string()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    found = map_rows(images.select("digest", "image"), schema, pa.schema(fields), make)
    return found.groupBy("digest").agg(*(F.max(n).alias(n) for n, _ in fields[1:]))


def document_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as an image, referenced from a page of its own; resolve the references; a row for each document."""
    features = checkpoint(payload_features(store_payloads(docs, path, id_col, text_col)))  # apart from the join, so that a payload of very many documents can be split there
    found = resolved(sequences(document_pages(docs, id_col, text_col), "doc_id", "html"), features, texts=False)
    media = found.select("id", F.size("items").alias("n_items"), F.explode(F.filter("items", lambda x: x["kind"] == "media")).alias("x"))
    return media.select(F.col("id").alias("doc_id"), "x.payload.*", "x.pos", "x.caption", "n_items")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_media(documents(spark, sf_dir), f"{shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}")


QUERIES = {"op9_media": op9_media}
SQL: dict[str, str] = {}
