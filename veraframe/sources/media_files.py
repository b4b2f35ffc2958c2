"""Media files: written from a column of bytes, read as a table and validated by their bytes.

Defined cases: an expected path that is not there is ``file_not_found``, a folder ``not_a_file``; null paths are not found; paths that
repeat give a row each. All codes that hold are returned, in the order of CODES. The
duration is read of videos without another fault. A file of more than ``most`` bytes is not opened: its code is ``file_too_large``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes, extensions and signatures as users of such reports know them.
CODES = ["file_not_found", "not_a_file", "empty_file", "unsupported_extension", "signature_unrecognized", "signature_extension_mismatch", "file_too_large", "video_unreadable", "video_too_long"]
IMAGES = (".jpg", ".jpeg", ".png", ".webp")
VIDEOS = (".mp4", ".mov", ".avi", ".mkv", ".webm")
#: (kind, [(offset from 0, bytes), ...])
SIGNATURES = [
    ("image", [(0, b"\xff\xd8\xff")]),
    ("image", [(0, b"\x89PNG\r\n\x1a\n")]),
    ("image", [(0, b"RIFF"), (8, b"WEBP")]),
    ("video", [(4, b"ftyp")]),
    ("video", [(0, b"\x1a\x45\xdf\xa3")]),
    ("video", [(0, b"RIFF"), (8, b"AVI ")]),
]


@dataclass(frozen=True)
class Limits:
    image_bytes: int = 20 << 20
    video_bytes: int = 500 << 20
    seconds: float = 600.0
    images: tuple[str, ...] = IMAGES
    videos: tuple[str, ...] = VIDEOS


def write_files(rows: DataFrame, path: str, content: str, root: str) -> None:
    """Writes each row's bytes below ``root`` under its relative path, on any file system that Arrow knows; a retry writes the same files."""

    def run(part: Iterator) -> None:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        folder = None
        for name, data in part:
            if (needed := f"{base}/{name}".rsplit("/", 1)[0]) != folder:
                fs.create_dir(needed, recursive=True)
                folder = needed
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(bytes(data))

    rows.filter(F.col(path).isNotNull()).select(path, F.coalesce(F.col(content), F.lit(b""))).foreachPartition(run)


def media_files(spark: SparkSession, root: str, most: int = 1 << 30) -> DataFrame:
    """path (relative to ``root``), length and content (null beyond ``most`` bytes, which are not read) of all files below ``root`` that are not empty.

    Spark lists them, which takes driver memory for each file, and leaves out names that begin with ``_`` or a dot. Where the paths are
    known, :func:`media_files_at` does without the list.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = "/" + root.split(":", 1)[-1].strip("/") + "/"
    path = F.substring_index(F.col("path"), at, -1).alias("path")
    small = found.filter(F.col("length") <= most).select(path, "length", "content")
    return small.unionByName(found.filter(F.col("length") > most).select(path, "length", F.lit(None).cast("binary").alias("content")))


#: Bytes of files that a task holds at once, one file aside.
AT_ONCE = 32 << 20


def media_files_at(expected: DataFrame, path: str, root: str, most: int = 1 << 30) -> DataFrame:
    """The rows of :func:`media_files` for the files at ``expected``'s paths.

    A path is looked up and read by the task that holds it, on any file system that Arrow knows; nothing of it goes through the driver.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        framed = lambda rows: pd.DataFrame(rows, columns=["path", "length", "content"]).astype({"length": "int64"})
        for pdf in batches:
            rows, held = [], 0
            for name, info in zip(pdf["path"], fs.get_file_info([f"{base}/{p}" for p in pdf["path"]]), strict=True):
                if info.type != pyarrow.fs.FileType.File or not info.size:
                    continue
                content = None
                if info.size <= most:
                    with fs.open_input_stream(info.path) as file:
                        content = file.read()
                rows.append((name, info.size, content))
                held += len(content or b"")
                if held >= AT_ONCE:
                    yield framed(rows)
                    rows, held = [], 0
            yield framed(rows)

    paths = expected.select(F.col(path).alias("path")).filter("path IS NOT NULL").distinct()
    return paths.mapInPandas(read, "path string, length long, content binary")


def sniffed(content: Column) -> Column:
    """``image``, ``video`` or null, by the first bytes."""
    out = F.lit(None).cast("string")
    for kind, parts in reversed(SIGNATURES):
        held = F.lit(True)
        for at, mark in parts:
            held = held & (F.substring(content, at + 1, len(mark)) == F.lit(mark))
        out = F.when(held, kind).otherwise(out)
    return out


def _boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start and end of the content) of the boxes of an MP4 container; a box that is cut off ends the walk."""
    while at + 8 <= end:
        size, head = int.from_bytes(data[at : at + 4]), 8
        if size == 1 and at + 16 <= end:
            size, head = int.from_bytes(data[at + 8 : at + 16]), 16
        stop = end if size == 0 else at + size
        if stop < at + head or stop > end:
            return
        yield bytes(data[at + 4 : at + 8]), at + head, stop
        at = stop


def _mp4_seconds(data: memoryview) -> float | None:
    for kind, lo, hi in _boxes(data, 0, len(data)):
        for inner, at, stop in _boxes(data, lo, hi) if kind == b"moov" else ():
            wide = inner == b"mvhd" and at < stop and data[at] == 1
            if inner == b"mvhd" and stop - at >= (32 if wide else 20):
                scale, length = struct.unpack_from(">IQ" if wide else ">II", data, at + (20 if wide else 12))
                return length / scale if scale else None
    return None


def _avi_seconds(data: memoryview) -> float | None:
    at = bytes(data[:4096]).find(b"avih")
    if at < 0 or at + 28 > len(data):
        return None
    return struct.unpack_from("<I", data, at + 8)[0] * struct.unpack_from("<I", data, at + 24)[0] / 1e6


def _elements(data: memoryview, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start and end of the content) of Matroska elements; one of unknown size goes to the end."""
    while at < end and data[at]:
        wide = 9 - data[at].bit_length()
        start = at + wide
        if start >= end or not data[start]:
            return
        long = 9 - data[start].bit_length()
        size, most = int.from_bytes(data[start : start + long]) & ((1 << 7 * long) - 1), (1 << 7 * long) - 1
        lo = start + long
        stop = end if size == most else lo + size
        if lo > end or stop > end:
            return
        yield int.from_bytes(data[at:start]), lo, stop
        at = stop


def _matroska_seconds(data: memoryview) -> float | None:
    for top, lo, hi in _elements(data, 0, len(data)):
        for kind, a, b in _elements(data, lo, hi) if top == 0x18538067 else ():
            if kind == 0x1549A966:
                held = {k: bytes(data[x:y]) for k, x, y in _elements(data, a, b)}
                length = held.get(0x4489, b"")
                if len(length) not in (4, 8):
                    return None
                return struct.unpack(">f" if len(length) == 4 else ">d", length)[0] * int.from_bytes(held.get(0x2AD7B1, b"\x0f\x42\x40")) / 1e9
    return None


def container_seconds(data: bytes | None) -> float | None:
    """The duration that a container's header states; None where it has none that can be read."""
    if data is None:
        return None
    view = memoryview(data)
    read = _mp4_seconds if data[4:8] == b"ftyp" else _avi_seconds if data[:4] == b"RIFF" else _matroska_seconds
    return read(view)


@F.pandas_udf(T.DoubleType())
def _seconds(content: pd.Series) -> pd.Series:
    return pd.Series([container_seconds(c) for c in content], dtype="float64")


def by_name_of(path: Column, limits: Limits) -> Column:
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))
    return F.when(ext.isin(*limits.images), "image").when(ext.isin(*limits.videos), "video")


def _unread(root: str):
    """A function of paths that the scan did not give: ``empty_file``, ``not_a_file`` or ``file_not_found``; null for null."""
    codes = {pyarrow.fs.FileType.File: "empty_file", pyarrow.fs.FileType.Directory: "not_a_file"}

    @F.pandas_udf(T.StringType())
    def look(paths: pd.Series) -> pd.Series:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        asked = paths.dropna()
        found = fs.get_file_info([f"{base}/{p}" for p in asked])
        return pd.Series([codes.get(i.type, "file_not_found") for i in found], index=asked.index, dtype=object).reindex(paths.index)

    return look


def validated(expected: DataFrame, path: str, files: DataFrame, root: str, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """``expected``'s columns with media_type, size_bytes, duration_s and codes (an array) of the file at ``path``, as read by :func:`media_files_at` or :func:`media_files`.

    Bytes are looked at where they are read; what is joined to the expected paths is narrow. Neither gives empty files, so
    expected paths that ``files`` does not have are looked up below ``root``, in the tasks that hold them.
    """
    by_name = by_name_of(F.col("path"), limits)
    kind = sniffed(F.col("content"))
    opened = F.col("content").isNotNull()
    size = F.col("length")
    first = {
        "unsupported_extension": by_name.isNull(),
        "signature_unrecognized": opened & kind.isNull(),
        "signature_extension_mismatch": kind != by_name,
        "file_too_large": ~opened | (size > F.when(kind == "image", limits.image_bytes).when(kind == "video", limits.video_bytes)),
    }
    looked = files.select("path", size.alias("size_bytes"), kind.alias("kind"), F.array_compact(F.array(*[F.when(v, c) for c, v in first.items()])).alias("found"), "content")
    timed = looked.withColumn("seconds", _seconds(F.when((F.col("kind") == "video") & (F.size("found") == 0), F.col("content")))).drop("content")
    asked = (F.col("kind") == "video") & (F.size("found") == 0)
    last = F.array_compact(F.array(F.when(asked & F.col("seconds").isNull(), "video_unreadable"), F.when(asked & (F.col("seconds") > limits.seconds), "video_too_long")))
    seen = timed.select(F.col("path").alias("_path"), "size_bytes", "seconds", F.concat("found", last).alias("_codes"), "kind")
    rows = expected.join(seen, F.col(path) == F.col("_path"), "left")
    rows = rows.withColumn("_kind", _unread(root)(F.when(F.col("_codes").isNull(), F.col(path)))).withColumn("_known", by_name_of(F.col(path), limits))
    unread = F.when(F.col("_kind") == "empty_file", F.array_compact(F.array(F.col("_kind"), F.when(F.col("_known").isNull(), "unsupported_extension")))).otherwise(F.array(F.coalesce("_kind", F.lit("file_not_found"))))
    codes = F.coalesce("_codes", unread)
    return rows.select(*[expected[c] for c in expected.columns], F.when(F.size(codes) == 0, F.col("kind")).alias("media_type"), F.coalesce("size_bytes", F.lit(0)).cast("long").alias("size_bytes"), F.col("seconds").alias("duration_s"), codes.alias("codes"))
