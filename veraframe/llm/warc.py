"""WARC archives: writing records with revisits, and reading them back by boundary-chain verification.

Writing: of records with equal payloads the one with the largest id is a ``response``; the others are ``revisit``
records without a block that refer to it. A record ends with two line ends, which is what the text writer puts after
every row, so archives are written by Spark itself to any file system, a part file of whole records for each task. Rows
that can't be revisits, by a table of hash cells of fixed size, are written where they are; all others meet the narrow
table of revisits in a shuffled join.

Reading: a file is split at every occurrence of the record magic, by byte ranges of any size. Tasks emit a candidate for
every occurrence: its offset and, if its header can be parsed, the offset of the record that it declares to follow.
A magic may well stand inside a payload, and what follows it may look like a header. So only candidates that are
reached from the start of their file, following declared successors, are records. The chain is resolved by pointer
jumping: in each round the reached set takes one jump and every pointer is joined with the pointer at its target, so a
file of ``n`` records needs about ``log2(n)`` rounds. Text between a record and its successor is its block, put
together from all pieces that magics inside it made.

Defined cases: an empty table writes an empty archive and gives no rows; a null payload counts as empty; equal payloads
with equal ids (repeated rows) are told apart by a row number, which their record ids end in, one being the response; a
null id is smallest and has no record id; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veraframe.llm.common import give_back, materialise, new_path, same, told_apart

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: The standard's profile of revisits by payload digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Stands between the id and the row number in the record id of a row that repeats another.
COPY = ";copy="


def base32_of_hex(column) -> F.Column:
    """Upper-case base32 of a 40-digit hex string: eight groups of five bytes, 5 bits a letter."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = []
    for g in range(4):
        number = F.conv(F.substring(column, 10 * g + 1, 10), 16, 10).cast("long")
        groups += [F.substring(letters, (F.shiftright(number, s).bitwiseAND(31) + 1).cast("int"), F.lit(1)) for s in range(35, -1, -5)]
    return F.concat(*groups)


def record_kinds(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """Narrow table (id, row, sha1, bytes, refers_to, response_row): refers_to is null for responses."""
    content = F.coalesce(F.col(payload), F.lit(""))
    narrow = materialise(pages.select(F.col(key).alias("id"), F.monotonically_increasing_id().alias("row"), F.sha1(content).alias("sha1"), F.octet_length(content).cast("long").alias("bytes")), "warc-digests")
    latest = narrow.filter(F.col("bytes") >= min_bytes).groupBy("sha1", "bytes").agg(F.max(F.struct("id", "row")).alias("of"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    latest = materialise(latest.select("sha1", "bytes", F.col("of.id").alias("of"), F.col("of.row").alias("of_row")), "warc-responses")
    revisits = narrow.join(latest, ["sha1", "bytes"]).filter(F.col("row") != F.col("of_row"))
    return materialise(revisits.select("id", "sha1", "of", F.when(F.col("id").eqNullSafe(F.col("of")), F.lit(1)).otherwise(0).alias("repeats")), "warc-revisits")


def records(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """The text of one WARC record per row, without its end."""
    revisits = record_kinds(pages, key, payload, min_bytes)
    content = F.coalesce(F.col(payload), F.lit(""))
    base = pages.select(F.col(key).alias("id"), F.col(url).cast("string").alias("url"), content.alias("content"), F.sha1(content).alias("sha1"), F.octet_length(content).alias("bytes"))
    both = {"id": "id", "sha1": "sha1"}
    mixed, calm = told_apart(base, revisits.select("id", "sha1"), both)
    others = revisits.filter("repeats = 0").groupBy("id", "sha1").agg(F.first("of").alias("of"))
    side = others.select(F.col("id").alias("r_id"), F.col("sha1").alias("r_sha1"), "of", F.lit(True).alias("again")).hint("merge")
    met = mixed.join(side, same(mixed, side, {"id": "r_id", "sha1": "r_sha1"}), "left").drop("r_id", "r_sha1")
    # Rows that repeat a response in id and payload: all but one of them are revisits.
    repeated = revisits.filter("repeats = 1").select("id", "sha1").distinct()
    met = met.withColumn("copy", F.lit(None).cast("long"))
    if not repeated.isEmpty():
        met = materialise(met.withColumn("copy", F.monotonically_increasing_id()), "warc-mixed")
        first = met.join(repeated, same(met, repeated, both), "left_semi").groupBy("id", "sha1").agg(F.min("copy").alias("first"))
        side = first.select(F.col("id").alias("r_id"), F.col("sha1").alias("r_sha1"), "first").hint("merge")
        met = met.join(side, same(met, side, {"id": "r_id", "sha1": "r_sha1"}), "left")
        met = met.withColumn("copy", F.when(F.col("copy") > F.col("first"), F.col("copy"))).drop("r_id", "r_sha1", "first")
    alone = calm.withColumns({"of": F.lit(None).cast(pages.schema[key].dataType), "again": F.lit(None).cast("boolean"), "copy": F.lit(None).cast("long")})
    joined = met.unionByName(alone)
    revisit = F.coalesce(F.col("again"), F.lit(False)) | F.col("copy").isNotNull()
    refers = F.coalesce(F.when(F.col("again"), F.col("of")), F.col("id"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    return joined.select(
        F.concat(
            F.lit(MAGIC),
            line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
            F.coalesce(line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.coalesce(F.concat(F.lit(COPY), F.col("copy").cast("string")), F.lit("")), F.lit(">"))), F.lit("")),
            line("WARC-Date", F.lit(DATE)),
            F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")), F.lit("")),
            line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex("sha1"))),
            line("Payload-Length", F.col("bytes").cast("string")),
            F.when(revisit, line("WARC-Profile", F.lit(PROFILE))).otherwise(F.lit("")),
            F.coalesce(F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers.cast("string"), F.lit(">")))), F.lit("")),
            line("Content-Type", F.lit("text/html; charset=utf-8")),
            line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
            F.lit("\r\n"),
            F.when(revisit, F.lit("")).otherwise(F.col("content")),
        ).alias("value")
    )


def write_archive(pages: DataFrame, path: str, **columns) -> None:
    records(pages, **columns).write.option("lineSep", END).text(path)


_HEADER = re.compile(rb"((?:[^\r\n:]+:[^\r\n]*\r\n)+)\r\n")


def parse_piece(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields after a magic and the length of the header, if one is there."""
    found = _HEADER.match(piece)
    if not found:
        return None
    fields = dict(line.split(": ", 1) for line in found[1].decode("utf-8", "replace").split("\r\n") if ": " in line)
    return (fields, found.end()) if fields.get("Content-Length", "").isdigit() else None


CANDIDATE = "file string, block long, nth long, length long, head int, successor long, kind string, id string, refers string, digest string, payload long, sha1 string, block_bytes long"


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece between magics, with what its header declares. ``nth`` counts within a byte range of a file."""
    lines = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def run(batches):
        at, nth = None, 0
        for b in batches:
            out = []
            for value, file, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                nth = nth + 1 if at == (file, block) else 0
                at = (file, block)
                parsed = parse_piece(value)
                if not parsed:
                    out.append((file, block, nth, len(value), 0, None, None, None, None, None, None, None, None))
                    continue
                f, head = parsed
                size = int(f["Content-Length"])
                body = value[head : head + size]
                out.append((file, block, nth, len(value), head, head + size + len(END), f.get("WARC-Type"), f.get("WARC-Record-ID"), f.get("WARC-Refers-To"), f.get("WARC-Payload-Digest"), int(f["Payload-Length"]) if f.get("Payload-Length", "").isdigit() else None, hashlib.sha1(body).hexdigest() if len(body) == size else None, size))
            names = [c.split()[0] for c in CANDIDATE.split(", ")]
            kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k.split()[1]]) for c, k in zip(cols, CANDIDATE.split(", "), strict=True)], names=names)
        give_back()

    return lines.mapInArrow(run, CANDIDATE)


def with_offsets(pieces: DataFrame) -> DataFrame:
    """Absolute offsets of the pieces' magics, from the lengths of what stands before them in the file.

    Pieces of a byte range are numbered as they were read; sums go over a file's ranges, and over one range's pieces.
    """
    step = F.col("length") + len(MAGIC)
    ranges = pieces.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ranges.select("file", "block", before.alias("base"))
    within = F.coalesce(F.sum(step).over(Window.partitionBy("file", "block").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # The first piece of a file stands before its first magic, and every other after one.
    offset = F.col("base") + F.col("within") - len(MAGIC)
    return pieces.withColumn("within", within).join(bases, ["file", "block"]).withColumn("at", offset).withColumn("next", F.col("at") + len(MAGIC) + F.col("successor")).drop("base", "within")


def reached(chain: DataFrame) -> DataFrame:
    """(file, at) of the candidates that are reached from offset 0; ``chain`` has file, at and next.

    The tables grow with the archive, so that no side is ever broadcast.
    """
    at = ["file", "at"]
    places = materialise(chain.select(*at), "warc-places").hint("merge")
    # An offset at which no candidate stands is a file's end or a damaged length, and nothing is reached through it.
    jumps = chain.filter("next IS NOT NULL").select("file", F.col("at").alias("from"), F.col("next").alias("at"))
    jumps = materialise(jumps.join(places, at, "left_semi").select("file", F.col("from").alias("at"), F.col("at").alias("next")), "warc-jumps")
    known = materialise(chain.filter("at = 0").select(*at), "warc-reached")
    while not jumps.isEmpty():
        step = known.join(jumps.hint("merge"), at).select("file", F.col("next").alias("at"))
        known = materialise(known.unionByName(step), "warc-reached")  # a jump of 2^k records from the first 2^k: none twice
        far = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("then"))
        jumps = materialise(jumps.join(far.hint("merge"), ["file", "next"]).select("file", "at", F.col("then").alias("next")), "warc-jumps")
    return known


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record: id, kind, refers, digest (as read), payload_bytes and sha1 of the block read back."""
    pieces = materialise(with_offsets(candidates(spark, path)), "warc-candidates")
    heads = reached(pieces)
    real = pieces.join(heads.hint("merge"), ["file", "at"])
    whole = real.filter("sha1 IS NOT NULL")
    # Blocks with magics inside: their pieces are those up to the record's end, joined in order.
    broken = real.filter("sha1 IS NULL").select("file", F.col("at").alias("start"), "next", "head", "kind", "id", "refers", "digest", "payload", "block_bytes")
    broken = materialise(broken, "warc-broken")
    if not broken.isEmpty():
        whole = whole.select(*RECORD).unionByName(reassembled(spark, path, pieces, broken).select(*RECORD))
    return whole.select(*RECORD)


RECORD = ("file", "kind", "id", "refers", "digest", "payload", "sha1", "block_bytes")


def reassembled(spark: SparkSession, path: str, pieces: DataFrame, broken: DataFrame) -> DataFrame:
    """Records whose block holds magics, with the digest of the block put together from its pieces."""
    # Records do not overlap, so a piece belongs to the last broken record that starts at or before it, if to any.
    touched = pieces.filter("at >= 0").select("file", "block", "nth", "at").join(broken.select("file").distinct(), "file", "left_semi")
    starts = broken.select("file", F.col("start").alias("at"), "start", F.col("next").alias("end")).hint("merge")
    upto = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = touched.join(starts, ["file", "at"], "left")
    placed = placed.withColumns({c: F.last(c, ignorenulls=True).over(upto) for c in ("start", "end")})
    parts = materialise(placed.filter("at < end").select("file", "block", "nth", "at", "start"), "warc-parts")
    lines = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    lines = lines.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))

    def number(batches):
        at, nth = None, 0
        for b in batches:
            out = []
            for file, block in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                nth = nth + 1 if at == (file, block) else 0
                at = (file, block)
                out.append(nth)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=["value", "file", "block", "nth"])

    numbered = lines.mapInArrow(number, "value binary, file string, block long, nth long")
    # Only byte ranges' pieces whose cell holds a part are moved.
    key = {c: c for c in ("file", "block", "nth")}
    mixed, _ = told_apart(numbered, parts, key)
    texts = mixed.join(parts.hint("merge"), list(key))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.hex("value").alias("v")))), lambda s: s.v), MAGIC.encode().hex())
    blocks = texts.groupBy("file", "start").agg(F.unhex(joined).alias("bytes"), F.count(F.lit(1)).alias("got"))
    wanted = parts.groupBy("file", "start").agg(F.count(F.lit(1)).alias("wanted"))
    body = F.substring("bytes", F.col("head") + 1, F.col("block_bytes").cast("int"))
    # Byte ranges are planned anew for the second read. If they differ, the job fails instead of losing a record.
    whole = F.when(F.col("got") == F.col("wanted"), F.sha1(body)).otherwise(F.raise_error(F.lit("the archive was split otherwise at the second read")))
    return broken.join(wanted, ["file", "start"]).join(blocks, ["file", "start"], "left").withColumn("sha1", whole)


def archive_round_trip(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, all from the archives read back.

    A response's digest and length are those of its block; a block that differs from its record's header fails the job.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archive")
    write_archive(pages, path, key=key, payload=payload, url=url, min_bytes=min_bytes)
    kind = pages.schema[key].dataType
    ident = lambda c: F.regexp_extract(c, f"^<urn:page:(.*?)(?:{COPY}[0-9]+)?>$", 1).cast(kind)
    read = base32_of_hex("sha1")
    declared = F.regexp_replace("digest", "^sha1:", "")
    response = F.col("kind") == "response"
    digest = F.when(~response | (declared == read), declared).otherwise(F.raise_error(F.lit("a payload differs from its digest")))
    return read_archive(spark, path).select(
        ident("id").alias("page_id"),
        F.when(response, F.col("block_bytes")).otherwise(F.col("payload")).alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("kind").alias("record_type"),
        ident("refers").alias("refers_to"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
