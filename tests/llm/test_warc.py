import hashlib
import io
import zipfile

import pyarrow as pa
import pytest

from salesmart.llm import warc


def open_bytes(content):
    return pa.PythonFile(io.BytesIO(content), mode="r")


def test_packages_are_zip_files():
    members = {"a/b.gz": b"12345", "index": b"", "ü": b"x" * 1000}
    content = warc.zip64(members)
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        assert archive.testzip() is None
        assert {n: archive.read(n) for n in archive.namelist()} == members
    file = open_bytes(content)
    for name, (offset, size) in warc.directory(file).items():
        assert content[offset : offset + size] == members[name]


def test_plain_zip_with_a_comment_and_a_packed_member():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("kept", b"stored bytes")
        archive.writestr("packed", b"z" * 500, zipfile.ZIP_DEFLATED)
        archive.comment = b"a comment PK\x05\x06 with a false end"
    content = buffer.getvalue()
    found = warc.directory(open_bytes(content))
    assert list(found) == ["kept"]
    offset, size = found["kept"]
    assert content[offset : offset + size] == b"stored bytes"


def test_zip64_written_by_others():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive, archive.open("big", "w", force_zip64=True) as out:
        out.write(b"content")
    content = buffer.getvalue()
    offset, size = warc.directory(open_bytes(content))["big"]
    assert content[offset : offset + size] == b"content"


def test_no_zip():
    with pytest.raises(ValueError):
        warc.directory(open_bytes(b"no archive at all"))


def test_ranges_are_joined_and_split(monkeypatch):
    content = bytes(range(256)) * 4
    monkeypatch.setattr(warc, "GAP", 10)
    monkeypatch.setattr(warc, "FETCH", 100)
    wanted = [(0, 5), (5, 90), (99, 3), (400, 200), (700, 0)]
    assert list(warc.ranges(open_bytes(content), wanted)) == [content[a : a + n] for a, n in wanted]


@pytest.mark.parametrize("size", [32 << 20, 500])
def test_round_trip(spark, monkeypatch, size):
    """Also where a task writes many packages."""
    monkeypatch.setattr(warc, "PACKAGE_BYTES", size)
    long = "é" * 600
    rows = [
        (1, "http://a", long), (2, "b\r\nX: y", long), (3, None, None), (4, "d", "small"),
        (5, "e", "small"), (6, "f", "\r\n\r\nbody" * 300), (6, "f", "\r\n\r\nbody" * 300),
        (None, "n", long), (7, "g", "q" * 300_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 AS digest", "'x' AS payload", "2 AS first")
    made = sorted(warc.round_trip(spark, pages).collect(), key=str)
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        refers = 2 if html == long and page_id == 1 else None
        kind = "revisit" if refers else "response"
        want.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), kind, refers))
    assert sorted(map(tuple, made), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(spark, pages).count() == 0
