"""Packed training rows: documents' token ids fitted into rows of one length."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.tasks import held, share

ROW = 2048
# Tokens that a task packs at a time, about; it holds as many.
BLOCK = 1 << 20
# Fixed value: the word pattern of the vocabulary, as its makers give it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokens:
    """A byte-level vocabulary of ranks; built once per worker."""

    def __init__(self, content: bytes, pattern: str = PATTERN):
        self.content, self.pattern, self.coder = content, pattern, None

    def encode(self, texts: list[str]) -> list[list[int]]:
        if self.coder is None:
            lines = (line.split() for line in self.content.splitlines() if line)
            ranks = {base64.b64decode(text): int(rank) for text, rank in lines}
            self.coder = tiktoken.Encoding(
                "ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}
            )
        return [self.coder.encode_ordinary(text) for text in texts]

    def __getstate__(self):
        return self.__dict__ | {"coder": None}


class Rooms:
    """Open rows by free places: a segment tree over capacities that are in use.

    Leaf c counts the open rows with c places free; ``fit`` finds the smallest
    capacity that is enough by going down from the root, so each search and each
    change takes as many steps as the row length has binary digits.
    """

    def __init__(self, row: int):
        self.base = 1 << row.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: dict[int, list[int]] = {}

    def add(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._change(free, 1)

    def _change(self, free: int, by: int) -> None:
        node = self.base + free
        while node:
            self.count[node] += by
            node >>= 1

    def fit(self, size: int) -> tuple[int, int] | None:
        """Take out the row with the least room for ``size``: (free, row)."""
        node = self.base + size
        if not self.count[node]:
            # Up to the first right neighbour that holds a row, then down its left edge.
            while node > 1 and (node & 1 or not self.count[node ^ 1]):
                node >>= 1
            if node <= 1:
                return None
            node ^= 1
            while node < self.base:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        free = node - self.base
        self._change(free, -1)
        return free, self.rows[free].pop()


def best_fit(sizes: np.ndarray, row: int) -> list[list[int]]:
    """Places of the pieces of each row, by best fit in decreasing order of size."""
    rooms, rows = Rooms(row), []
    for place in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[place])
        found = rooms.fit(size)
        if found is None:
            rows.append([])
            found = row, len(rows) - 1
        free, target = found
        rows[target].append(place)
        if free > size:
            rooms.add(free - size, target)
    return rows


PACKED = (
    "ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, "
    "offsets array<long>, n_tokens int"
)


def _row(pieces: list[tuple], row: int, pad: int) -> dict:
    """One packed row; pieces are (doc_id, offset of its first token, ids)."""
    ids = np.full(row, pad, "<u4")
    positions = np.zeros(row, "<u4")
    ends = [0]
    for _, _, piece in pieces:
        start, end = ends[-1], ends[-1] + len(piece)
        ids[start:end] = piece
        positions[start:end] = np.arange(len(piece))
        ends.append(end)
    return {
        "ids": ids.tobytes(), "cu_seqlens": ends, "positions": positions.tobytes(),
        "doc_ids": [p[0] for p in pieces], "offsets": [p[1] for p in pieces], "n_tokens": ends[-1],
    }


def pack(docs: DataFrame, path: str, row: int = ROW, pad: int = 50256, block: int = BLOCK) -> DataFrame:
    """Rows of ``row`` token ids made of whole documents or pieces of long ones.

    ``ids`` and ``positions`` are a row of the matrices as little-endian
    unsigned 32-bit integers, padded by ``pad`` and 0; ``cu_seqlens`` holds the
    cumulative lengths of the segments, ``positions`` start anew in each;
    ``doc_ids`` and ``offsets`` tell which document, from which of its tokens, a
    segment is. A document longer than a row is cut into full rows and a rest,
    and its pieces joined by offset are its ids again. Null and empty texts have
    no token and appear in no row; repeated rows are packed as often; documents
    of null id are packed with a null in ``doc_ids``. Other columns are not
    read. Each task packs what it has read in blocks, without a shuffle.
    """
    with open(path, "rb") as file:
        shared = share(docs.sparkSession, Tokens(file.read()))

    def rows_of(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(p[2]) for p in pieces], np.int64)
        names = [part.split()[0] for part in PACKED.split(", ")]
        kinds = [pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()),
                 pa.list_(pa.int64()), pa.int32()]
        bins = best_fit(sizes, row)
        for at in range(0, len(bins), 128):
            made = [_row([pieces[k] for k in places], row, pad) for places in bins[at : at + 128]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m[name] for m in made], kind) for name, kind in zip(names, kinds, strict=True)],
                names,
            )

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(shared)
        pieces: list[tuple] = []
        n = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array(coder.encode([text.as_py() or ""])[0], "<u4")
                for start in range(0, len(ids), row):
                    pieces.append((doc.as_py(), start, ids[start : start + row]))
                n += len(ids)
                if n >= block:
                    yield from rows_of(pieces)
                    pieces, n = [], 0
        if pieces:
            yield from rows_of(pieces)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(make, PACKED)


def write(packed: DataFrame, path: str) -> None:
    """The packed rows as Parquet: binary matrix rows beside their lengths."""
    packed.write.parquet(path)
