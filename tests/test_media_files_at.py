"""Files read at expected paths, in tasks."""

import pytest

from veraframe.plans import incremental_queries as Q
from veraframe.sources import media_files as MF
from veraframe.sources.shared import new_path

JPEG, PNG = b"\xff\xd8\xff\xe0", b"\x89PNG\r\n\x1a\n"


def test_only_expected_files_are_read_and_each_once(spark, monkeypatch):
    files = {"a/x.jpg": JPEG, "a/y.png": PNG + bytes(90), "_a/z.jpg": JPEG, ".h.png": PNG, "void.png": b"", "other.jpg": JPEG}
    root = new_path(spark, "media")
    MF.write_files(spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "name string, bytes binary"), "name", "bytes", root)
    asked = ["a/x.jpg", "a/x.jpg", "a/y.png", "_a/z.jpg", ".h.png", "void.png", "a", "none.jpg", None]
    expected = spark.createDataFrame(list(enumerate(asked)), "id int, name string")
    monkeypatch.setattr(MF, "AT_ONCE", 10)
    found = MF.media_files_at(expected, "name", root, most=50)
    assert sorted((r.path, r.length, None if r.content is None else bytes(r.content)) for r in found.collect()) == [(".h.png", 8, PNG), ("_a/z.jpg", 4, JPEG), ("a/x.jpg", 4, JPEG), ("a/y.png", 98, None)]
    got = {r.id: (r.media_type, r.size_bytes, r.codes) for r in MF.validated(expected, "name", found, root).collect()}
    want = [("image", 4, []), ("image", 4, []), (None, 98, ["file_too_large"]), ("image", 4, []), ("image", 8, []), (None, 0, ["empty_file"]), (None, 0, ["not_a_file"]), (None, 0, ["file_not_found"]), (None, 0, ["file_not_found"])]
    assert got == dict(enumerate(want))


def test_the_query_lists_no_files_in_the_driver(spark, monkeypatch):
    def listed(*_):
        pytest.fail("the driver lists the files")

    monkeypatch.setattr(MF, "media_files", listed)
    assert Q.s9_media_files(spark, "/root/testdata/sf0.001").filter("codes = 'not_a_file'").count() == 1
