"""Media columns: interleaved document sequences whose media references are resolved by digest.

An HTML document is parsed into an ordered sequence of items: text items, and media references with the digest of the
payload and the caption that belongs to them. Payloads live in a media store, a table keyed by digest. References are
exploded with their positions, joined with the store by digest, and gathered again in the order of their positions, so a
payload, its position and its caption stay together. References without a payload in the store stay, unresolved.

Payloads are stored losslessly as 8-bit grey samples, 64 a row, in binary PGM. Bytes are padded with zeros to a positive
multiple of 64. What is returned about a payload is computed from the stored bytes read back.

Defined cases: an empty table gives no rows; a null or empty text is one row of zeros; an empty or null document has an
empty sequence; several references to one digest all resolve to it; equal texts share a digest and get equal values;
repeated rows come out repeated; other columns are ignored.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veraframe.llm.common import materialise, small_batches

WIDTH = 64
ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("ref", pa.string()), ("caption", pa.string())])
ITEMS = "array<struct<position: int, kind: string, text: string, ref: string, caption: string>>"
_REF = re.compile(r"sha256:([0-9a-f]{64})")


class _Sequence(HTMLParser):
    """Collects [kind, text, ref, caption] in page order; a figure's caption goes to the references in it.

    A caption ends with its figure, with a new figure or caption, or with the page; its figure's references get it then.
    Outside a figure, figcaption is a block of text like any other, and so is the caption of a figure without references.
    """

    BREAKS = frozenset("p div section article figure figcaption h1 h2 h3 h4 h5 h6 li ul ol table tr td br hr blockquote pre".split())
    MEDIA = frozenset("img video audio source embed".split())
    HIDDEN = frozenset("script style template".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[list] = []
        self.words: list[str] = []
        self.caption: list[str] | None = None
        self.figure: int | None = None  # where the open figure's items begin
        self.hidden = 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        self.words = []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is None:
            return
        text, self.caption = " ".join("".join(self.caption).split()), None
        media = [item for item in self.items[self.figure :] if item[0] == "media"]
        for item in media:
            item[3] = text or item[3]
        if text and not media:
            self.items.append(["text", text, None, None])

    def handle_starttag(self, tag, attrs) -> None:
        if tag in self.BREAKS:
            self.flush()
        if tag in self.HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.end_caption()
            self.figure = len(self.items)
        elif tag == "figcaption":
            self.end_caption()
            self.caption = [] if self.figure is not None else None
        elif tag in self.MEDIA:
            named = dict(attrs)
            found = _REF.search(named.get("src") or "")
            if found:
                self.flush()
                self.items.append(["media", None, found[1], named.get("alt") or None])

    def handle_endtag(self, tag) -> None:
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        if tag in self.BREAKS:
            self.flush()
        if tag == "figure":
            self.end_caption()
            self.figure = None
        elif tag == "figcaption":
            self.end_caption()

    def handle_data(self, data) -> None:
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)

    def close(self) -> None:
        super().close()
        self.end_caption()
        self.flush()


def parse_sequence(source: str) -> list[dict]:
    parser = _Sequence()
    parser.feed(source)
    parser.close()
    return [{"position": i, "kind": k, "text": t, "ref": r, "caption": c} for i, (k, t, r, c) in enumerate(parser.items)]


def sequences(docs: DataFrame, key: str, source: str) -> DataFrame:
    """(key, items) of every HTML document."""

    def run(batches):
        for b in small_batches(batches, 1):
            items = [parse_sequence(s) for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(items, pa.list_(ITEM))], names=[key, "items"])

    rows = docs.select(key, F.coalesce(F.col(source), F.lit("")).alias(source))
    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, items {ITEMS}")


def resolve_references(items: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """(key, media): the references of each of ``items`` (key, items) with their rows of ``store``, in order of position.

    ``media`` is an array of (position, caption, ref, found, payload facts), one for each reference; documents without
    references have no row. References are few and narrow, whatever the texts around them.
    """
    facts = [c for c in store.columns if c != "ref"]
    refs = items.select(key, F.explode(F.filter("items", lambda i: i.kind == "media")).alias("item")).select(key, "item.position", "item.caption", "item.ref")
    refs = materialise(refs, "media-references")  # so that a digest that many refer to can be split in the join
    joined = refs.join(store.withColumn("found", F.lit(True)), "ref", "left")
    one = F.struct("position", "caption", "ref", F.coalesce("found", F.lit(False)).alias("found"), *facts)
    return joined.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("media"))


def resolve(items: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """``items`` (key, items) with :func:`resolve_references`' column ``media``, empty for documents without references."""
    media = resolve_references(items, store, key)
    return items.join(media, key, "left").withColumn("media", F.coalesce("media", F.array().cast(media.schema["media"].dataType)))


def padded(text: str) -> Column:
    """UTF-8 bytes of the text, with zeros up to a positive multiple of WIDTH."""
    raw = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(raw) / WIDTH)) * WIDTH
    return F.rpad(raw, n.cast("int"), F.unhex(F.lit("00")))


def as_pgm(payload: Column) -> Column:
    header = F.concat(F.lit(f"P5\n{WIDTH} "), (F.octet_length(payload) / WIDTH).cast("long").cast("string"), F.lit("\n255\n"))
    return F.concat(F.encode(header, "UTF-8"), payload)


def write_store(docs: DataFrame, text: str) -> DataFrame:
    """The media store of all texts: (ref, media), written and read back; copies may be stored more than once."""
    payload = docs.select(padded(text).alias("payload"))
    return materialise(payload.select(F.sha2("payload", 256).alias("ref"), as_pgm(F.col("payload")).alias("media")), "media-store", compression="zstd")


def payload_facts(store: DataFrame) -> DataFrame:
    """Facts of every stored payload, from the bytes read back, one row per ref."""

    def run(batches):
        for b in small_batches(batches, 1):
            payloads, feats = [], []
            for m in b.column(1).to_pylist():
                kind, size, most, raw = m.split(b"\n", 3)
                width, height = map(int, size.split())
                if kind != b"P5" or most != b"255" or len(raw) != width * height:
                    raise ValueError("a stored payload is damaged")
                grey = np.frombuffer(raw, np.uint8).reshape(height, width)
                shades = np.bincount(grey.ravel() >> 5, minlength=8)
                edges = np.abs(np.diff(grey.astype(np.int16), axis=1)).sum(dtype=np.int64)
                feats.append(f"{width}x{height};mean={grey.mean():.4f};std={grey.std():.4f};edge={edges / grey.size:.4f};hist={','.join(map(str, shades))}")
                payloads.append(raw)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payloads, pa.binary()), pa.array(feats, pa.string())], names=["ref", "media", "payload", "feature"])

    read = store.mapInArrow(run, "ref string, media binary, payload binary, feature string")
    facts = read.select(
        "ref",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -WIDTH, WIDTH)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
    return materialise(facts.dropDuplicates(["ref"]), "media-facts")


def as_page(text: str) -> Column:
    """A text as an HTML document: its words, and a figure that refers to its payload."""
    escaped = F.coalesce(F.col(text), F.lit(""))
    for mark, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        escaped = F.replace(escaped, F.lit(mark), F.lit(ref))
    return F.concat(F.lit("<article><p>"), escaped, F.lit('</p><figure><img src="sha256:'), F.sha2(padded(text), 256), F.lit('"><figcaption>'), F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("string"), F.lit("</figcaption></figure></article>"))


def text_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's payload by its sequence: the caption is the unpadded length, the rest comes from the store."""
    facts = payload_facts(write_store(docs, text))
    pages = docs.select(F.struct(F.col(key).alias("doc_id"), F.monotonically_increasing_id().alias("row")).alias("of"), as_page(text).alias("page"))
    media = resolve_references(sequences(pages, "of", "page"), facts, "of")
    one = media.select(F.col("of.doc_id").alias("doc_id"), F.element_at("media", 1).alias("m"))
    return one.select("doc_id", "m.position", F.col("m.caption").cast("long").alias("n_bytes"), "m.ref", *[f"m.{c}" for c in facts.columns if c != "ref"])


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return text_media(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position")
