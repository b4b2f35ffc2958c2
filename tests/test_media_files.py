"""Durations from container bytes, and files validated by what is in them."""

import struct

import pytest
from pyspark.sql import functions as F

from veraframe.sources import media_files as MF
from veraframe.sources.shared import new_path


def box(kind, content, wide=False):
    return struct.pack(">I4sQ", 1, kind, len(content) + 16) + content if wide else struct.pack(">I4s", len(content) + 8, kind) + content


def mvhd(scale, length, version=0):
    body = struct.pack(">QQIQ", 0, 0, scale, length) if version else struct.pack(">IIII", 0, 0, scale, length)
    return box(b"mvhd", bytes([version, 0, 0, 0]) + body + bytes(80))


FTYP = box(b"ftyp", b"isom")


@pytest.mark.parametrize(
    ("data", "seconds"),
    [
        (FTYP + box(b"moov", mvhd(1000, 2500)), 2.5),
        (FTYP + box(b"mdat", bytes(999), True) + box(b"moov", box(b"udta", b"x") + mvhd(600, 1 << 33, 1)), (1 << 33) / 600),
        (FTYP + struct.pack(">I4s", 0, b"moov") + mvhd(10, 5), 0.5),  # a last box that goes to the end
        (FTYP + box(b"moov", mvhd(0, 5)), None),
        (FTYP + box(b"moov", mvhd(1000, 2500))[:20], None),
        (FTYP + b"\x00\x00\x00\x04moov", None),
        (FTYP, None),
        (b"RIFF", None),
        (b"\x1a\x45\xdf\xa3", None),
        (b"\x1a\x45\xdf\xa3\x80\x18\x53\x80\x67\x90\x15\x49\xa9\x66\x8b\x44\x89\x88" + struct.pack(">d", 1500.0), 1.5),  # default scale
        (b"\x1a\x45\xdf\xa3\x80\x18\x53\x80\x67\x90\x15\x49\xa9\x66\x8b\x44\x89\x88" + bytes(3), None),
        (None, None),
    ],
)
def test_seconds_of_containers(data, seconds):
    assert MF.container_seconds(data) == seconds


def test_every_truncation_is_read_without_a_crash():
    for whole in (FTYP + box(b"moov", mvhd(1000, 2500)), b"RIFF\0\0\0\0AVI LIST\0\0\0\0hdrlavih" + bytes(40), b"\x1a\x45\xdf\xa3\x80\x18\x53\x80\x67\x90\x15\x49\xa9\x66\x8b\x44\x89\x88" + bytes(8)):
        for n in range(8, len(whole)):
            MF.container_seconds(whole[:n])


def test_codes_of_files_on_disk(spark):
    long_film = FTYP + box(b"moov", mvhd(1, 1000))
    files = {"x/ok.JPEG": b"\xff\xd8\xff\xe0", "x/film.mov": long_film, "none.png": b"", "a.b/plain": b"RIFF\0\0\0\0WEBP", "junk.txt": b"junk", "big.png": b"\x89PNG\r\n\x1a\n" + bytes(5000), "film.png": long_film, "huge.mp4": bytes(9000), "bad.mkv": b"\x1a\x45\xdf\xa3", "void": b""}
    root = new_path(spark, "media")
    made = spark.createDataFrame([*((k, bytearray(v)) for k, v in files.items()), (None, bytearray(b"x"))], "name string, bytes binary")
    for _ in range(2):
        MF.write_files(made, "name", "bytes", root)
    names = [*files, "x", "x/none", None, "x/ok.JPEG", "void"]
    expected = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "name string, length int")
    read = MF.media_files(spark, root, most=8000)
    assert {r.path: bytes(r.content) if r.content is not None else None for r in read.collect()} == {k: v for k, v in files.items() if v} | {"huge.mp4": None}
    got = {r.length: (r.media_type, r.size_bytes, r.duration_s, r.codes) for r in MF.validated(expected, "name", read, root, MF.Limits(image_bytes=1000)).collect()}
    want = [("image", 4, None, []), (None, len(long_film), 1000.0, ["video_too_long"]), (None, 0, None, ["empty_file"]), (None, 12, None, ["unsupported_extension"]), (None, 4, None, ["unsupported_extension", "signature_unrecognized"])]
    want += [(None, 5008, None, ["file_too_large"]), (None, len(long_film), None, ["signature_extension_mismatch"]), (None, 9000, None, ["file_too_large"]), (None, 4, None, ["video_unreadable"]), (None, 0, None, ["empty_file", "unsupported_extension"])]
    want += [(None, 0, None, ["not_a_file"]), (None, 0, None, ["file_not_found"]), (None, 0, None, ["file_not_found"]), ("image", 4, None, []), (None, 0, None, ["empty_file", "unsupported_extension"])]
    assert got == dict(enumerate(want))
    assert {c for _, _, _, codes in want for c in codes} == set(MF.CODES)


def test_no_expected_files(spark):
    root = new_path(spark, "media")
    MF.write_files(spark.createDataFrame([("a.png", bytearray(b"x"))], "p string, c binary"), "p", "c", root)
    none = spark.createDataFrame([], "name string")
    assert MF.validated(none, "name", MF.media_files(spark, root), root).filter(F.lit(True)).count() == 0
