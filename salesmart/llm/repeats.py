"""Removal of repeated byte strings: suffix arrays over what can repeat at all."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.tasks import held, share, small_batches
from salesmart.storage import stage

# Bytes of a string that counts as repeated.
SPAN = 400
# Bytes of an anchor: each span is filed under the least of the anchors in it.
ANCHOR = 160
# Bytes that are hashed at a time.
BLOB = 1 << 18
# Bytes of parts that a task makes into one suffix array, at least.
LOAD = 1 << 20
# Different pieces under one anchor; more are filed anew by shorter ranges.
GROUP, SPLIT = 3000, 8
# Bits of a filter: so many for each thing in it, up to a limit of 32 MB.
BITS_EACH, MOST_BITS = 16, 1 << 28

_MASK = np.uint64(0xFFFFFF)
_LETTER = np.random.default_rng(400).integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread the low bits, which a sum of powers leaves weak, over all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Hashes of any substring of a blob, from sums of powers."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _BACK)):
                made = np.full(n, base)
                made[0] = 1
                setattr(self, name, np.multiply.accumulate(made))

    def read(self, blob: np.ndarray) -> None:
        self.powers(len(blob) + 1)
        self.sums = np.zeros(len(blob) + 1, np.uint64)
        np.cumsum(_LETTER[blob] * self.up[: len(blob)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours, by running minima of blocks from both sides."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def _blobs(texts: list[bytes], span: int):
    """Texts joined, long ones in parts that share span - 1 bytes: bytes, (text, offset, length)."""
    held, parts, size = [], [], 0
    for n, text in enumerate(texts):
        for at in range(0, max(1, len(text) - span + 1), BLOB):
            piece = text[at : at + BLOB + span - 1]
            if len(piece) < span:
                continue
            held.append(piece)
            parts.append((n, at, len(piece)))
            size += len(piece)
            if size >= BLOB:
                yield b"".join(held), parts
                held, parts, size = [], [], 0
    if parts:
        yield b"".join(held), parts


def pieces(texts: list[bytes], hasher: Hasher, span: int = SPAN, anchor: int = ANCHOR):
    """All spans of texts, filed by anchor: (text, start, end, group, content, at) arrays.

    A span's anchor is the string of ``anchor`` bytes in it whose hash is least,
    the first of equal ones; that depends on the span alone, so equal spans have
    equal anchors. Neighbouring spans of one anchor are one piece, from the
    start of the first to the end of the last. ``group`` is the anchor's hash,
    ``content`` one of the whole piece and of the anchor's place in it.
    """
    made = [[np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)]]
    w = span - anchor + 1
    for blob, parts in _blobs(texts, span):
        raw = np.frombuffer(blob, np.uint8)
        hasher.read(raw)
        begins = np.arange(len(raw) - anchor + 1)
        hashes = hasher.hash(begins, begins + anchor)
        least = _window_min((hashes & ~_MASK) | begins.astype(np.uint64), w)
        place = (least & _MASK).astype(np.int64)
        lengths = np.array([p[2] for p in parts])
        stops = np.cumsum(lengths)
        # Spans that reach into the next text are none.
        inside = np.zeros(len(place), bool)
        for stop, length in zip(stops.tolist(), lengths.tolist(), strict=True):
            inside[stop - length : stop - span + 1] = True
        cut = np.flatnonzero((place[1:] != place[:-1]) | (inside[1:] != inside[:-1])) + 1
        first = np.concatenate(([0], cut))
        last = np.concatenate((cut, [len(place)])) - 1
        kept = inside[first]
        first, last = first[kept], last[kept]
        at, end = place[first], last + span
        content = hasher.hash(first, end) ^ _mix(
            ((end - first) << 20 | (at - first)).astype(np.uint64)
        )
        which = np.searchsorted(stops, first, "right")
        shift = np.array([p[1] for p in parts]) - (stops - lengths)
        text = np.array([p[0] for p in parts])[which]
        made.append([text, first + shift[which], end + shift[which], hashes[at], content, at + shift[which]])
    return [np.concatenate(column) for column in zip(*made, strict=True)]


# --- suffix arrays -----------------------------------------------------------


def _sort_directly(text: bytes, places: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes: by eight bytes as a
    number, and where those tie by the bytes themselves."""
    raw = np.frombuffer(text + bytes(8), np.uint8)
    key = np.zeros(len(places), np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | raw[places + k]
    order = np.argsort(key, kind="stable")
    places, key = places[order], key[order]
    same = key[1:] == key[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    for start, stop in zip(edge[::2].tolist(), (edge[1::2] + 1).tolist(), strict=True):
        group = places[start:stop].tolist()
        group.sort(key=lambda p: text[p + 8 : p + depth])
        places[start:stop] = group
    return places


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Places of all suffixes, in order of their first ``depth`` bytes, in two stages.

    Suffixes smaller than their successor (the suffix one place on) are sorted
    directly. The others are induced: buckets of equal first byte are scanned in
    rising order, and each suffix met puts the one before it, where that begins
    with a greater byte, or with the same and is itself an induced one, at the
    next free place of its bucket. A bucket is scanned as a whole; runs of one
    byte take as many steps as they are long. The end is smaller than any byte.
    """
    x = np.frombuffer(text, np.uint8)
    n = len(x)
    if not n:
        return np.zeros(0, np.int64)
    # Smaller than its successor: what differs next along a run of one byte is greater.
    change = np.flatnonzero(np.concatenate((x[1:] != x[:-1], [True])))
    run_end = change[np.searchsorted(change, np.arange(n))]
    after = np.concatenate((x[1:].astype(np.int16), [-1]))
    smaller = after[run_end] > x
    direct = np.flatnonzero(smaller)
    sorted_direct = _sort_directly(text, direct, depth)
    first = x[sorted_direct]
    bounds = np.searchsorted(first, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    # The empty suffix at the end comes first of all and is met before any bucket.
    if not smaller[n - 1]:
        waiting[x[n - 1]].append(np.array([n - 1]))
    made = []
    for byte in range(256):
        induced = waiting[byte]
        newest = np.concatenate(induced) if induced else np.zeros(0, np.int64)
        parts = [newest]
        while len(newest):
            before = newest - 1
            before = before[before >= 0]
            newest = before[(x[before] == byte) & ~smaller[before]]
            parts.append(newest)
        bucket = np.concatenate([*parts, sorted_direct[bounds[byte] : bounds[byte + 1]]])
        made.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[x[before] > byte]
        letters = x[before]
        order = np.argsort(letters, kind="stable")
        before, letters = before[order], letters[order]
        cut = np.flatnonzero(letters[1:] != letters[:-1]) + 1
        for part in np.split(before, cut):
            if len(part):
                waiting[x[part[0]]].append(part)
    return np.concatenate(made)


def common_prefixes(text: bytes, places: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order, up to ``depth``."""
    n = len(text)
    raw = np.frombuffer(text + bytes(depth + 8), np.uint8)
    words = np.zeros(len(raw) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | raw[k : len(raw) - 7 + k]
    lengths = np.zeros(len(places), np.int64)
    # By eight bytes as long as they agree, then byte by byte.
    active = np.arange(1, len(places))
    for k in range(0, depth, 8):
        active = active[words[places[active - 1] + k] == words[places[active] + k]]
        lengths[active] += 8
    active = np.arange(1, len(places))
    active = active[lengths[active] < depth]
    for _ in range(7):
        at = lengths[active]
        active = active[raw[places[active - 1] + at] == raw[places[active] + at]]
        lengths[active] += 1
    lengths[1:] = np.minimum(lengths[1:], n - np.maximum(places[1:], places[:-1]))
    return np.minimum(lengths, depth)


def repeated_starts(
    parts: list[bytes], ids: np.ndarray, known: np.ndarray, span: int = SPAN
) -> list[np.ndarray]:
    """Starts in each part of spans that occur at two places, or in a known part.

    ``ids`` number the place of each part's first byte in its document, so that
    parts that overlap there are no repeats of each other; ``known`` parts
    repeat as they are.
    """
    # Parts are joined; a span is looked at only where it fits into its part.
    text = b"".join(parts)
    lengths = np.array([len(p) for p in parts], np.int64)
    stops = np.cumsum(lengths)
    order = suffix_array(text, span)
    which = np.searchsorted(stops, order, "right")
    fits = order + span <= stops[which]
    order, which = order[fits], which[fits]
    if not len(order):
        return [np.zeros(0, np.int64) for _ in parts]
    same = common_prefixes(text, order, span) >= span
    run = np.cumsum(~same) - 1
    within = order - (stops - lengths)[which]
    place = ids[which] + within
    starts = np.flatnonzero(~same)
    low, high = np.minimum.reduceat(place, starts), np.maximum.reduceat(place, starts)
    hit = (low != high) | np.logical_or.reduceat(known[which], starts)
    hit = hit[run]
    made = np.split(within[hit][np.argsort(which[hit], kind="stable")],
                    np.cumsum(np.bincount(which[hit], minlength=len(parts)))[:-1])
    return [np.sort(m) for m in made]


# --- filters -----------------------------------------------------------------


class Filter:
    """A Bloom filter of 64-bit hashes; of bounded size, so it only ever spares work."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        x = _mix(x)
        low = (x & np.uint64(size - 1)).astype(np.int64)
        return low, ((x >> np.uint64(32)) & np.uint64(size - 1)).astype(np.int64)

    def may_have(self, x: np.ndarray) -> np.ndarray:
        found = np.ones(len(x), bool)
        for at in self.places(x, len(self.bits) * 8):
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def make_filter(things: DataFrame, name: str) -> Broadcast:
    """A filter of a long column, filled in up to 16 tasks; at most 32 MB."""
    n = things.count()
    size = 1 << max(10, min(MOST_BITS, BITS_EACH * max(1, n)).bit_length() - 1)
    block = min(size // 8, 1 << 16)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in Filter.places(x, size):
                np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        used = [k for k in range(0, len(bits), block) if bits[k : k + block].any()]
        yield pa.RecordBatch.from_pydict({
            "place": pa.array(used, pa.int64()),
            "bits": pa.array([bits[k : k + block].tobytes() for k in used], pa.binary()),
        })

    def join(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint8) for x in table.column("bits").to_pylist()]
        return pa.table({
            "place": table.column("place").slice(0, 1),
            "bits": pa.array([np.bitwise_or.reduce(parts).tobytes()], pa.binary()),
        })

    few = things.select(name).coalesce(16)
    filled = few.mapInArrow(fill, "place long, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in filled.groupBy("place").applyInArrow(join, "place long, bits binary").toLocalIterator():
        bits[row.place : row.place + block] = np.frombuffer(row.bits, np.uint8)
    return share(things.sparkSession, Filter(bits))


# --- documents ---------------------------------------------------------------

FILED = "key binary, start int, end int, at int, low int, high int, grp long, content long, n long"
# The text's own hash is the key of a document: equal texts are one.
KEY = "unhex(md5(text))"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select("doc_id", text.alias("text")).withColumn("key", F.expr(KEY))


def _numbers(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _groups(texts: DataFrame, span: int, anchor: int) -> DataFrame:
    """Anchors that occur more than once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                raw = batch.column(0).slice(start, 500).to_pylist()
                seen, n = np.unique(pieces(raw, hasher, span, anchor)[3], return_counts=True)
                yield pa.RecordBatch.from_pydict({"grp": _numbers(seen), "n": pa.array(n, pa.int64())})

    counted = texts.select("text").mapInArrow(count, "grp long, n long")
    return counted.groupBy("grp").agg(F.sum("n").alias("n")).filter("n > 1").select("grp")


def _file(texts: DataFrame, wanted: Broadcast, span: int, anchor: int) -> DataFrame:
    """Pieces under anchors that may occur more than once, in the columns ``FILED``."""
    w = span - anchor

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, filter_ = Hasher(), held(wanted)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                # Copies in the same part are filed once, with their number.
                first: dict[bytes, int] = {}
                keys = part.column(0).to_pylist()
                copies = np.bincount([first.setdefault(key, len(first)) for key in keys])
                raw = dict(zip(keys, part.column(1).to_pylist(), strict=True))
                text, start, end, group, content, at = pieces(
                    [raw[key] for key in first], hasher, span, anchor
                )
                kept = filter_.may_have(group)
                known = pa.array(list(first), pa.binary())
                n = int(kept.sum())
                yield pa.RecordBatch.from_pydict({
                    "key": known.take(pa.array(text[kept])),
                    "start": pa.array(start[kept], pa.int32()), "end": pa.array(end[kept], pa.int32()),
                    "at": pa.array(at[kept], pa.int32()),
                    "low": pa.array(np.zeros(n), pa.int32()), "high": pa.array(np.full(n, w), pa.int32()),
                    "grp": _numbers(group[kept]), "content": _numbers(content[kept]),
                    "n": pa.array(copies[text[kept]], pa.int64()),
                })

    return texts.select("key", "text").mapInArrow(file, FILED)


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted rows with their texts, compressed: each text sent once by a task."""
    shared = make_filter(wanted.select(F.xxhash64("key").alias("k")).distinct(), "k")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, sent = held(shared), set()
        for batch in batches:
            hit = filter_.may_have(batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            keys, packed = [], []
            for n in np.flatnonzero(hit).tolist():
                key = batch.column(0)[n].as_py()
                if key not in sent:
                    sent.add(key)
                    keys.append(key)
                    packed.append(_pack(batch.column(1)[n].as_py()))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(keys, pa.binary()), "packed": pa.array(packed, pa.binary()),
            })

    hashed = texts.select("key", "text", F.xxhash64("key").alias("k"))
    return wanted.join(hashed.mapInArrow(send, "key binary, packed binary"), "key")


def _pack(text: bytes) -> bytes:
    return len(text).to_bytes(4, "little") + pa.compress(text, "zstd", asbytes=True)


def _unpack(packed: bytes) -> bytes:
    return pa.decompress(packed[4:], int.from_bytes(packed[:4], "little"), "zstd", asbytes=True)


PART = "key binary, start int, grp long, n long, part binary"


def _cut_out(joined: DataFrame) -> DataFrame:
    """The bytes of wanted pieces; rows hold all pieces of one text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                rows = []
                for row in batch.slice(at, 100).to_pylist():
                    text = _unpack(row["packed"])
                    rows += [
                        (row["key"], x["start"], x["grp"], x["n"], text[x["start"] : x["end"]])
                        for x in row["list"]
                    ]
                yield _batch(rows, PART)

    return joined.select("key", "list", "packed").mapInArrow(cut, PART)


_ARROW = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64()}


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = [part.split() for part in fields.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, kinds, strict=True)],
        [name for name, _ in kinds],
    )


MARK = "key binary, start int, end int"


def _compare(parts: DataFrame, span: int) -> DataFrame:
    """Repeated spans of parts, group by group: runs of bytes ``key, start, end``.

    Whole groups are joined until they make a load; a suffix array of it orders
    all their spans.
    """

    def marks(rows: list[dict]) -> pa.RecordBatch:
        # A text may have been sent by several tasks.
        rows = list({(r["grp"], r["key"], r["start"]): r for r in rows}.values())
        number: dict[bytes, int] = {}
        doc = np.array([number.setdefault(r["key"], len(number)) for r in rows], np.int64)
        ids = (doc << 32) + np.array([r["start"] for r in rows], np.int64)
        known = np.array([r["n"] > 1 for r in rows], bool)
        found = repeated_starts([r["part"] for r in rows], ids, known, span)
        out = []
        for row, starts, old in zip(rows, found, known.tolist(), strict=True):
            if old or not len(starts):
                continue
            gaps = np.flatnonzero(np.diff(starts) > span)
            firsts = starts[np.concatenate(([0], gaps + 1))] + row["start"]
            lasts = starts[np.concatenate((gaps, [len(starts) - 1]))] + span + row["start"]
            out += [(row["key"], int(a), int(b)) for a, b in zip(firsts, lasts, strict=True)]
        return _batch(out, MARK)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= LOAD and row["grp"] != rows[-1]["grp"]:
                    yield marks(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row["part"])
        if rows:
            yield marks(rows)

    return parts.repartition("grp").sortWithinPartitions("grp").mapInArrow(compare, MARK)


def _file_anew(joined: DataFrame, span: int) -> DataFrame:
    """Pieces of crowded groups cut into shorter ranges of spans, filed by what
    all spans of such a range have in common; at last each span by itself."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for row in batch.to_pylist():
                text = _unpack(row["packed"])
                out = []
                for x in row["list"]:
                    base = x["start"]
                    raw = np.frombuffer(text[base : x["end"]], np.uint8)
                    hasher.read(raw)
                    width = -(-(x["high"] - x["low"] + 1) // SPLIT)
                    for low in range(x["low"], x["high"] + 1, width):
                        high = min(x["high"], low + width - 1)
                        # Spans that begin from ``high`` to ``low`` bytes before the anchor.
                        start = max(base, x["at"] - high)
                        end = min(x["end"], x["at"] - low + span)
                        if end - start < span:
                            continue
                        core = np.array([[x["at"] - low, x["at"] - high + span], [start, end]]) - base
                        group, content = hasher.hash(core[:, 0], core[:, 1])
                        salt = np.array([low << 40 | (high - low) << 20 | (x["at"] - start)], np.uint64)
                        group, content = _mix(np.array([group]) ^ _mix(salt >> np.uint64(20))), _mix(
                            np.array([content]) ^ _mix(salt + np.uint64(end - start))
                        )
                        out.append((
                            row["key"], start, end, x["at"], low, high,
                            int(group.view(np.int64)[0]), int(content.view(np.int64)[0]), x["n"],
                        ))
                yield _batch(out, FILED)

    made = joined.select("key", "list", "packed").mapInArrow(file, FILED)
    # A text sent by several tasks counts once.
    return made.groupBy("key", "start", "end", "at", "low", "high", "grp", "content").agg(
        F.max("n").alias("n")
    ).select(*[part.split()[0] for part in FILED.split(", ")])


def marks(texts: DataFrame, span: int = SPAN, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """Runs of bytes ``key, start, end`` that repeated spans cover.

    Pieces of equal group and content repeat as they are. Where an anchor also
    has a piece that is alone, its bytes and one piece of each other content
    meet in a task, which orders all their spans by a suffix array. Anchors of
    more than ``group`` contents are filed anew by ranges of spans, so that no
    task ever holds more. Hashes only file; what they take as equal are pieces
    that agree in two 64-bit hashes.
    """
    anchors = stage(_groups(texts, span, anchor), "anchors")
    wanted = make_filter(anchors.rows, "grp")
    anchors.release()
    pieces_ = stage(_file(texts, wanted, span, anchor), "filed")
    found = []
    while True:
        filed = pieces_.rows
        classes = filed.groupBy("grp", "content").agg(
            F.sum("n").alias("total"), F.min(F.struct("key", "start")).alias("one")
        )
        classes = stage(classes, "classes")
        groups = classes.rows.groupBy("grp").agg(
            F.count("*").alias("kinds"), F.min("total").alias("least")
        )
        # Nothing is left to compare where an anchor has one content, or only repeated ones.
        open_ = stage(groups.filter("kinds > 1 AND least = 1"), "open")
        status = classes.rows.join(open_.rows, "grp", "left").filter("total > 1 OR kinds > 1")
        status = stage(status.select("grp", "content", "total", "one", "kinds"), "status")
        rows = filed.join(status.rows, ["grp", "content"])
        rows = stage(
            rows.withColumn("same", F.col("one") == F.struct("key", "start")).drop("one", "n"), "rows"
        ).rows
        for copy in (pieces_, classes, open_, status):
            copy.release()
        found.append(rows.filter("total > 1").select("key", "start", "end"))
        # One piece of each content: those of equal text are one row of the join.
        ones = rows.filter("kinds > 1 AND same").withColumnRenamed("total", "n")
        ones = ones.withColumn("crowded", F.col("kinds") > group)
        lists = ones.groupBy("key", "crowded").agg(
            F.collect_set(F.struct("start", "end", "at", "low", "high", "grp", "n")).alias("list")
        )
        lists = stage(lists, "lists").rows
        parts = _cut_out(_texts_of(texts, lists.filter("NOT crowded")))
        found.append(stage(_compare(parts, span), "compared").rows)
        crowded = lists.filter("crowded")
        if crowded.isEmpty():
            break
        pieces_ = stage(_file_anew(_texts_of(texts, crowded), span), "filed")
    made = found[0]
    for more in found[1:]:
        made = made.unionByName(more)
    return made


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    made: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if made and start <= made[-1][1]:
            made[-1] = made[-1][0], max(made[-1][1], end)
        else:
            made.append((start, end))
    return made


FOUND = "n_bytes long, runs array<struct<start:int, end:int>>, kept binary"


def remove(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR, group: int = GROUP) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, runs, kept``.

    ``runs`` are the maximal runs of bytes covered by a string of ``span`` bytes
    that also starts anywhere else, in any document, the own included, as
    (start, end) in bytes; ``kept`` is the text in UTF-8 without them. Null is
    the empty text; texts shorter than a span have no runs; repeated rows repeat
    each other; a null doc_id stays null. Other columns are not read. Only texts
    with runs are sent anywhere, compressed.
    """
    small_batches(docs.sparkSession)
    texts = _keyed(docs)
    spans = marks(texts, span, anchor, group)
    runs = spans.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    runs = stage(runs, "runs").rows
    shared = make_filter(runs.select(F.xxhash64("key").alias("k")), "k")

    @F.pandas_udf("boolean")
    def has_runs(k: pd.Series) -> pd.Series:
        return pd.Series(held(shared).may_have(k.to_numpy().view(np.uint64)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_pack(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(packed, pa.binary())],
                ["doc_id", "key", "packed"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts_ = [_unpack(x.as_py()) for x in part.column(1)]
                found = [_merged([(x["start"], x["end"]) for x in y or ()]) for y in part.column(2).to_pylist()]
                kept = [
                    b"".join(text[a:b] for a, b in zip(
                        [0, *(end for _, end in spans_)], [*(s for s, _ in spans_), len(text)], strict=True
                    ))
                    for text, spans_ in zip(texts_, found, strict=True)
                ]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0), "n_bytes": pa.array(map(len, texts_), pa.int64()),
                    "runs": pa.array([[{"start": a, "end": b} for a, b in x] for x in found], kind),
                    "kept": pa.array(kept, pa.binary()),
                })

    doc_id = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"
    hashed = texts.withColumn("marked", has_runs(F.xxhash64("key")))
    sent = hashed.filter("marked").select("doc_id", "key", "text").mapInArrow(
        pack, f"{doc_id}, key binary, packed binary"
    )
    joined = sent.join(runs, "key", "left").select("doc_id", "packed", "runs")
    clean = hashed.filter("NOT marked").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.array().cast("array<struct<start:int,end:int>>").alias("runs"), F.col("text").alias("kept"),
    )
    return joined.mapInArrow(cut, f"{doc_id}, {FOUND}").unionByName(clean)
