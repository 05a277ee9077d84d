"""WARC records in ZIP packages: written by tasks, found through the ZIP directories."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesmart.llm.tasks import small_batches
from salesmart.storage import fresh_path, stage

# Payloads of fewer bytes are stored whole even where they repeat.
LEAST_SHARED = 1000
# Bytes of records after which a task starts its next package; it holds one.
PACKAGE_BYTES = 32 << 20
# Ranges of a package not further apart than the gap are fetched together.
GAP, FETCH = 64 << 10, 4 << 20
# Bytes of records that a reading task takes, about.
READ_BYTES = 16 << 20
MEMBER, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
# Signatures of the ZIP format.
LOCAL, CENTRAL, END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
END64, LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; any store that Arrow knows."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# --- packages ----------------------------------------------------------------


def zip64(members: dict[str, bytes]) -> bytes:
    """A package of stored members with ZIP64 fields throughout."""
    body, directory = [], []
    at = 0
    for name, content in members.items():
        label = name.encode()
        check = zlib.crc32(content)
        extra = struct.pack("<HHQQ", 1, 16, len(content), len(content))
        head = LOCAL + struct.pack(
            "<5H3I2H", 45, 0x800, 0, 0, 0x21, check, FULL32, FULL32, len(label), len(extra)
        )
        body += [head, label, extra, content]
        far = struct.pack("<HHQQQ", 1, 24, len(content), len(content), at)
        directory += [
            CENTRAL + struct.pack(
                "<6H3I5H2I", 45, 45, 0x800, 0, 0, 0x21, check, FULL32, FULL32, len(label),
                len(far), 0, 0, 0, 0, FULL32,
            ), label, far,
        ]
        at += len(head) + len(label) + len(extra) + len(content)
    listed = b"".join(directory)
    n = len(members)
    tail = END64 + struct.pack("<Q2H2I4Q", 44, 45, 45, 0, 0, n, n, len(listed), at)
    tail += LOCATOR64 + struct.pack("<IQI", 0, at + len(listed), 1)
    tail += END + struct.pack("<4H2IH", FULL16, FULL16, FULL16, FULL16, FULL32, FULL32, 0)
    return b"".join([*body, listed, tail])


def directory(file) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP file as name: (offset of their first byte, size).

    Reads the end of the file, the ZIP64 end where the plain one points to it,
    the central directory and each member's own header; never a member.
    """
    total = file.size()
    near = min(total, 22 + FULL16)
    tail = file.read_at(near, total - near)
    found = tail.rfind(END)
    while found >= 0:
        if found + 22 <= near and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == near:
            break
        found = tail.rfind(END, 0, found)
    if found < 0:
        raise ValueError("Not a ZIP file")
    count, size, offset = struct.unpack_from("<HII", tail, found + 10)
    if count == FULL16 or FULL32 in (size, offset):
        place = total - near + found - 20
        mark, _, where, _ = struct.unpack("<4sIQI", file.read_at(20, place))
        if mark == LOCATOR64:
            end = file.read_at(56, where)
            if end[:4] != END64:
                raise ValueError("Broken ZIP64 directory")
            count, size, offset = struct.unpack_from("<QQQ", end, 32)
    listed = file.read_at(size, offset)
    members: dict[str, tuple[int, int]] = {}
    at = 0
    for _ in range(count):
        if listed[at : at + 4] != CENTRAL:
            raise ValueError("Broken ZIP directory")
        flags, method = struct.unpack_from("<2H", listed, at + 8)
        packed, plain, name_n, extra_n, note_n = struct.unpack_from("<2I3H", listed, at + 20)
        (start,) = struct.unpack_from("<I", listed, at + 42)
        name = listed[at + 46 : at + 46 + name_n].decode("utf-8" if flags & 0x800 else "cp437")
        extra = listed[at + 46 + name_n : at + 46 + name_n + extra_n]
        while len(extra) >= 4:
            kind, n = struct.unpack_from("<2H", extra)
            if kind == 1:
                # Only the fields that are full in the directory, in this order.
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                plain = next(wide) if plain == FULL32 else plain
                packed = next(wide) if packed == FULL32 else packed
                start = next(wide) if start == FULL32 else start
            extra = extra[4 + n :]
        if method == 0 and not flags & 1:
            head = file.read_at(30, start)
            if head[:4] != LOCAL:
                raise ValueError(f"Broken header of {name}")
            own_name, own_extra = struct.unpack_from("<2H", head, 26)
            members[name] = (start + 30 + own_name + own_extra, packed)
        at += 46 + name_n + extra_n + note_n
    return members


def ranges(file, wanted: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each (offset, size) in rising order; near ones fetched together."""
    n = 0
    while n < len(wanted):
        start, end, to = wanted[n][0], sum(wanted[n]), n + 1
        while to < len(wanted):
            offset, size = wanted[to]
            if offset - end > GAP or max(end, offset + size) - start > FETCH:
                break
            end, to = max(end, offset + size), to + 1
        block = file.read_at(end - start, start)
        for offset, size in wanted[n:to]:
            yield block[offset - start : offset - start + size]
        n = to


# --- records -----------------------------------------------------------------


def sha1_text(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def sha1_hex(text: str) -> str:
    return base64.b32decode(text.removeprefix("sha1:")).hex()


def _record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items())]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    whole = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(whole) + pack.flush()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields, by lower-case name, and payload of one compressed record."""
    whole = zlib.decompress(record, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("Not a WARC record")
    fields = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PAGE = "urn:page:"


def _page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    # A line break would end the field.
    target = " ".join((url or "").split())
    fields = {
        "WARC-Record-ID": f"<{PAGE}{'' if page_id is None else page_id}>",
        "WARC-Date": "2024-01-01T00:00:00Z",
        "WARC-Target-URI": target,
        "WARC-Payload-Digest": sha1_text(digest),
    }
    if refers_to is None:
        return _record("response", fields, HTTP + payload)
    fields["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
    fields["WARC-Refers-To"] = f"<{PAGE}{refers_to}>"
    return _record("revisit", fields, HTTP)


def _page_id(text: str | None) -> int | None:
    digits = (text or "").strip("<>").removeprefix(PAGE)
    return int(digits) if digits else None


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Packages of WARC records, one record per row of pages: their paths and counts.

    A page with a payload of ``LEAST_SHARED`` bytes or more that other pages
    have too is a revisit of the one of largest page_id; pages of that same id
    (repeated rows) and pages without an id are responses. Null html is an empty
    payload. Tasks write under names of their own, so a task that runs twice
    leaves a package that no list names. The list is staged: packages are
    written once.
    """
    rows = pages.select(
        F.col("page_id").cast("long"), F.col("url").cast("string"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= LEAST_SHARED)
    firsts = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    firsts = stage(firsts.filter("n > 1").select("digest", "first"), "firsts").rows
    linked = rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest",
        F.when(F.col("page_id") < F.col("first"), F.col("first")).alias("refers_to"),
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        index: list[str] = []
        at = 0

        def close() -> pa.RecordBatch:
            nonlocal at
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            store, inner = _open(path)
            store.create_dir(inner.rpartition("/")[0], recursive=True)
            package = zip64({
                MEMBER: b"".join(records),
                INDEX: "\n".join(index).encode(),
                "datapackage.json": json.dumps({"profile": "data-package"}).encode(),
            })
            with store.open_output_stream(inner) as out:
                out.write(package)
            made = pa.RecordBatch.from_pydict({"package": [path], "records": [len(records)]})
            records.clear()
            index.clear()
            at = 0
            return made

        for batch in batches:
            for values in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                record = _page_record(*values)
                records.append(record)
                index.append(json.dumps({"offset": at, "length": len(record)}))
                at += len(record)
                if at >= PACKAGE_BYTES:
                    yield close()
        if records:
            yield close()

    return stage(linked.mapInArrow(write, "package string, records long"), "packages").rows


def read_index(packages: DataFrame) -> DataFrame:
    """Where each record lies: ``package, offset, length`` of the whole file.

    The index member is located through the ZIP directories and read alone.
    """

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, inner = _open(path)
                with store.open_input_file(inner) as file:
                    members = directory(file)
                    base, size = members[MEMBER]
                    at, n = members[INDEX]
                    lines = [json.loads(x) for x in file.read_at(n, at).decode().split("\n") if x]
                if any(x["offset"] + x["length"] > size for x in lines):
                    raise ValueError(f"Index points beyond the archive in {path}")
                yield pa.RecordBatch.from_pydict({
                    "package": pa.array([path] * len(lines), pa.string()),
                    "offset": pa.array([base + x["offset"] for x in lines], pa.int64()),
                    "length": pa.array([x["length"] for x in lines], pa.int64()),
                })

    return packages.select("package").mapInArrow(locate, "package string, offset long, length long")


RECORD = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "payload binary"
)


def read_records(index: DataFrame) -> DataFrame:
    """The records at these places, each read by its range.

    ``payload`` is null for revisits. A response whose payload has not the digest
    it names is an error.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: dict[str, list[tuple[int, int]]] = {}
            for path, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                places.setdefault(path, []).append((offset, length))
            for path, wanted in places.items():
                store, inner = _open(path)
                rows, held = [], 0
                with store.open_input_file(inner) as file:
                    for record in ranges(file, sorted(wanted)):
                        fields, payload = parse(record)
                        kind = fields["warc-type"]
                        digest = sha1_hex(fields["warc-payload-digest"])
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"Broken payload in {path}")
                        rows.append((
                            _page_id(fields["warc-record-id"]), fields["warc-target-uri"], kind,
                            _page_id(fields.get("warc-refers-to")), digest,
                            payload if kind == "response" else None,
                        ))
                        held += len(payload)
                        if held > FETCH:
                            yield _records(rows)
                            rows, held = [], 0
                yield _records(rows)

    return index.mapInArrow(fetch, RECORD)


def _records(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    names = [part.split()[0] for part in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages written to packages in the shared folder and read back from them.

    One row per page: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``; what a revisit stands for is looked up at the response it
    refers to, by id and digest.
    """
    small_batches(spark)
    packages = write_packages(pages, fresh_path(spark, "warc"))
    # Lists are tiny beside what they stand for: they are dealt out by that.
    each = packages.repartition(max(1, packages.count()), "package")
    index = stage(read_index(each), "index").rows
    total = index.agg(F.expr("coalesce(sum(length), 0)")).first()[0]
    near = [F.col("package"), F.expr(f"offset div {FETCH}")]
    parts = index.repartition(total // READ_BYTES + 1, *near)
    read = read_records(parts).selectExpr(
        "page_id", "octet_length(payload) AS own_bytes", "payload_digest", "record_type",
        "refers_to",
    )
    read = stage(read, "records").rows
    responses = read.filter("record_type = 'response'").groupBy(
        F.col("page_id").alias("refers_to"), "payload_digest"
    ).agg(F.first("own_bytes").alias("their_bytes"))
    wanted = read.filter("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    responses = stage(wanted.join(responses, ["refers_to", "payload_digest"]), "referred").rows
    return read.join(responses, ["refers_to", "payload_digest"], "left").selectExpr(
        "page_id", "bigint(coalesce(own_bytes, their_bytes)) AS payload_bytes", "payload_digest",
        "record_type", "refers_to",
    )
