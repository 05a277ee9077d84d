"""How filters act together, from a sparse document-term matrix.

Each task cuts its documents into shards and gives words numbers of its own; the
distinct words of all shards are then numbered once, and every shard is written
in those global numbers as compressed sparse rows. The sums of a row are the
words of a document, its entries the distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.llm.tasks import small_batches
from salesmart.storage import stage

# Bytes of text in a shard, about, and of those split at a time; a longer document is
# a shard, or a piece, of its own.
SHARD_BYTES, PIECE_BYTES = 16 << 20, 2 << 20
# Words of a shard's own dictionary in one row, and documents renumbered at a time.
LISTED, LOT = 50_000, 500
# Parts of the vocabulary that are numbered apart.
BUCKETS = 65_536
MARKS = b"#$%&*|"
FILTERS = "ABCDE"
FEWEST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2


# --- the matrix --------------------------------------------------------------


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers by planes: all first bytes, all second ones, and so on, as many
    as the largest needs. High planes are mostly zero, so that the copies compress."""
    top = int(numbers.max()) if len(numbers) else 0
    wide = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    flat = np.ascontiguousarray(numbers, f"<u{wide}").view(np.uint8).reshape(-1, wide)
    return bytes([wide]) + flat.T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    wide = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(wide, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{wide}").ravel()


def rows_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of texts, and per text its entries: how many, the places of
    words among the distinct ones, and how often each occurs."""
    split = pc.ascii_split_whitespace(texts)
    ends = np.asarray(split.offsets)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    coded = split.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    words, codes = coded.dictionary, np.asarray(coded.indices)
    # Blanks at an end leave an empty word; it has one place.
    empty = pc.index(words, pa.scalar("", words.type)).as_py()
    if empty >= 0:
        used = codes != empty
        row, codes = row[used], codes[used]
        codes = codes - (codes > empty)
        words = pa.concat_arrays([words.slice(0, empty), words.slice(empty + 1)])
    entries, times = np.unique(row << 32 | codes, return_counts=True)
    sizes = np.bincount(entries >> 32, minlength=len(texts))
    return words, sizes, (entries & 0xFFFFFFFF).astype(np.uint32), times.astype(np.uint32)


_KINDS = np.zeros(256, np.uint8)
_KINDS[0x80:0xC0] = 1
_KINDS[ord("A") : ord("Z") + 1] = 2
_KINDS[list(MARKS)] = 4


def letters_of(texts: pa.Array) -> np.ndarray:
    """Code points, capitals A-Z and marks of each text, as three rows of numbers."""
    raw = texts.cast(pa.binary())
    ends = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, 4 * raw.offset)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    kinds = _KINDS[data]
    counts = [
        np.diff(np.searchsorted(np.flatnonzero(kinds == kind), ends - ends[0])) for kind in (1, 2, 4)
    ]
    return np.stack([np.diff(ends) - counts[0], *counts[1:]])


class _Shard:
    """Documents of one task, until they are enough."""

    def __init__(self):
        self.rows: list[pa.Array] = []
        self.parts: list[tuple] = []
        self.letters: list[np.ndarray] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch, size: int) -> None:
        texts = batch.column("text")
        self.rows.append(batch.column("row"))
        self.parts.append(rows_of(texts))
        self.letters.append(letters_of(texts))
        self.size += size

    def out(self, shard: int) -> Iterator[pa.RecordBatch]:
        """Its rows: the numbers with the first words, then the other words."""
        words, sizes, codes, times = zip(*self.parts, strict=True)
        # The words of all pieces as one dictionary.
        coded = pa.concat_arrays(words).dictionary_encode()
        merged, places = coded.dictionary, np.asarray(coded.indices)
        starts = np.cumsum([0, *map(len, words[:-1])])
        codes = np.concatenate([places[a : a + len(w)][c] for a, w, c in zip(starts, words, codes, strict=True)])
        numbers = (np.concatenate(sizes), codes, np.concatenate(times), np.concatenate(self.letters, axis=1).ravel())
        rows = pa.concat_arrays(self.rows)
        head = [
            pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows),
            *(pa.array([packed(x)], pa.binary()) for x in numbers),
        ]
        for first in range(0, max(1, len(merged)), LISTED):
            part = merged.slice(first, LISTED)
            listed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int64()), pa.array([first], pa.int64()), listed, *head], names=_NAMES
            )
            head = [pa.nulls(1, column.type) for column in head]


_NAMES = ["shard", "first", "words", "rows", "sizes", "indices", "data", "letters"]
_NUMBERS = "sizes binary, indices binary, data binary, letters binary"


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Consecutive rows of about as many bytes of text as are split at a time."""
    start = held = 0
    for n, size in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        held += size
        if held >= PIECE_BYTES or n + 1 == batch.num_rows:
            yield batch.slice(start, n + 1 - start), held
            start, held = n + 1, 0


def _shards(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Shards in words' own numbers, and the words of each in several rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 33, _Shard()
        for batch in batches:
            for piece, size in _pieces(batch):
                shard.add(piece, size)
                if shard.size >= SHARD_BYTES:
                    yield from shard.out(number)
                    number, shard = number + 1, _Shard()
        if shard.rows:
            yield from shard.out(number)

    small_batches(docs.sparkSession)
    return rows.mapInArrow(make, f"shard long, first long, words array<string>, rows array<{kind}>, {_NUMBERS}")


def _numbered(words: DataFrame) -> DataFrame:
    """Words of shards with ``id``: equal words have equal numbers, from 0 without gaps.

    Words meet once, in buckets of their hash, and are numbered there; the sizes
    of the buckets, a number each, say where each begins.
    """
    buckets = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)))
    place = F.dense_rank().over(W.partitionBy("bucket").orderBy("word"))
    return buckets.withColumn("place", place)


def _with_ids(placed: DataFrame) -> DataFrame:
    sizes = placed.groupBy("bucket").agg(F.max("place").alias("n"))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "bucket").withColumn("id", F.col("start") + F.col("place") - 1)


def term_matrix(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """The matrix of whole ``text`` columns and its dictionary.

    The matrix has a row per shard: ``shard, rows`` (the ``keep`` columns of its
    documents, in order), ``sizes, indices, data`` (``unpacked`` gives the
    numbers: entries of each row, global words ascending within a row,
    occurrences) and ``letters`` (of each document, code points, capitals, marks).
    The dictionary is ``word, id``: every distinct word of the corpus, numbered
    from 0 without gaps. Words are maximal runs without ASCII white space, as
    they are written; null texts are empty rows. A shard and its words are what
    one task holds; a word that is in every shard comes once from each.
    """
    shards = stage(_shards(docs, keep), "shards").rows
    words = shards.select("shard", F.posexplode("words").alias("pos", "word"), "first").select(
        F.col("shard").alias("of"), (F.col("first") + F.col("pos")).alias("own"), "word"
    )
    placed = _numbered(words)
    dictionary = _with_ids(placed.select("word", "bucket", "place").distinct()).select("word", "id")
    met = _with_ids(stage(placed.drop("word"), "places").rows).select("of", "own", "id")
    matrix = shards.filter("sizes IS NOT NULL").drop("first", "words")
    schema = matrix.schema

    def renumber(left: pa.Table, right: pa.Table) -> pa.Table:
        made = left.slice(0, 1)
        sizes, codes, times = (unpacked(made.column(x)[0].as_py()) for x in ("sizes", "indices", "data"))
        named = right.column("id").to_numpy()
        # Ids are kept as short as they are.
        ids = np.empty(len(named), np.uint32 if named.max(initial=0) < 1 << 32 else np.int64)
        ids[right.column("own").to_numpy()] = named
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        numbers, counts = np.empty(len(codes), ids.dtype), np.empty_like(times)
        for first in range(0, len(sizes), LOT):
            rows = sizes[first : first + LOT]
            here = slice(ends[first], ends[first + len(rows)])
            mine = ids[codes[here]]
            order = np.lexsort((mine, np.repeat(np.arange(len(rows)), rows)))
            numbers[here], counts[here] = mine[order], times[here][order]
        for name, values in (("indices", numbers), ("data", counts)):
            at = made.schema.get_field_index(name)
            made = made.set_column(at, made.schema.field(at), pa.array([packed(values)], pa.binary()))
        return made

    renumbered = matrix.groupBy("shard").cogroup(met.groupBy("of")).applyInArrow(renumber, schema)
    return renumbered, dictionary


def row_counts(matrix: DataFrame) -> DataFrame:
    """The kept columns of each document with ``n_words`` and ``n_distinct``, the sum
    and the number of the entries of its row, and ``n_chars, n_capitals, n_marks``."""
    kind = matrix.schema["rows"].dataType.elementType.simpleString()
    names = ["row", "n_words", "n_distinct", "n_chars", "n_capitals", "n_marks"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                sizes, times, letters = (unpacked(batch.column(x)[n].as_py()) for x in ("sizes", "data", "letters"))
                total = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
                ends = np.cumsum(sizes, dtype=np.int64)
                numbers = [total[ends] - total[ends - sizes], sizes, *letters.reshape(3, -1)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("rows")[n].values, *(pa.array(x, pa.int64()) for x in numbers)], names=names
                )

    some = matrix.select("rows", "sizes", "data", "letters")
    counted = some.mapInArrow(count, f"row {kind}, " + ", ".join(f"{name} long" for name in names[1:]))
    return counted.select("row.*", *names[1:])


# --- the filters -------------------------------------------------------------


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask, n``: which filters documents fail, as bits, A is 1.

    A: fewer than 200 words; B: less than half of them distinct; C: more than
    2 % capitals A-Z; D: one of ``#$%&*|``; E: the same text as a smaller
    doc_id. Texts meet by their SHA-256. Null texts are empty; a null id is
    neither smaller nor larger than another, so such a row passes E, and so do
    all rows that share the smallest id of a text; equal rows are counted in
    ``n``. A text that a third of all rows share is cut to one row per task for
    its smallest id, and its rows then meet that by text and id together.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"),
        F.unhex(F.sha2(text, 256)).alias("key"),
    )
    matrix, _ = term_matrix(known, ["doc_id", "part", "key"])
    counted = row_counts(matrix).selectExpr(
        "doc_id", "part", "key", f"n_words < {FEWEST_WORDS} AS a",
        f"n_distinct * 100 < n_words * {LEAST_DISTINCT} AS b",
        f"n_capitals * 100 > n_chars * {MOST_CAPITALS} AS c", "n_marks > 0 AS d",
    )
    rows = stage(counted.groupBy(*counted.columns).agg(F.count("*").alias("n")), "failures").rows
    least = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    mask = "int(a) + 2 * int(b) + 4 * int(c) + 8 * int(d) + 16 * int(doc_id IS NOT NULL AND least IS NULL)"
    return rows.join(least, ["key", "doc_id"], "left").selectExpr("doc_id", "part", f"{mask} AS mask", "n")


def _orders() -> list[tuple[str, int, int, int]]:
    """Each order and step with the filters before it and its own, as bits."""
    made = []
    for order in map("".join, permutations(FILTERS)):
        before = 0
        for step, letter in enumerate(order, start=1):
            bit = 1 << FILTERS.index(letter)
            made.append((order, step, before, bit))
            before |= bit
    return made


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (``source``, null as empty), order of the filters and step.

    ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` as
    long counts within the part. A document with several rows of labels counts
    as good or toxic if one of them says so, one without labels or id as neither;
    null labels say nothing. No documents give no rows. Documents are summed to
    one row per part and set of failed filters, 32 at most a part, before the
    orders come in: 120 orders ask for 80 different pairs of what went before
    and what comes next.
    """
    spark = docs.sparkSession
    known = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("long")).alias("good"),
        F.max((F.col("toxic") == 1).cast("long")).alias("toxic"),
    )
    cells = failures(docs).join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"),
    )
    orders = _orders()
    pairs = sorted({(before, bit) for _, _, before, bit in orders})
    asked = F.array(*[
        F.struct(F.lit(before).alias("before"), F.lit(bit).alias("bit")) for before, bit in pairs
    ])
    passed, fails = "mask & before = 0", "mask & bit <> 0"
    counts = {
        "kept": f"{passed} AND mask & bit = 0, n", "removed": f"{passed} AND {fails}, n",
        "redundant": f"mask & before <> 0 AND {fails}, n", "unique_fails": "mask = bit, n",
        "good_lost": f"{passed} AND {fails}, good", "toxic_lost": f"{passed} AND {fails}, toxic",
    }
    summed = cells.select("*", F.inline(asked)).groupBy("part", "before", "bit").agg(
        *[F.expr(f"sum(if({test}, 0L))").alias(name) for name, test in counts.items()]
    )
    times = F.lit(0)
    for k in range(len(FILTERS)):
        orders_of = factorial(k) * factorial(len(FILTERS) - 1 - k)
        times = F.when(F.bit_count("before") == k, F.lit(orders_of)).otherwise(times)
    shapley = F.sum(F.col("removed") * times).over(W.partitionBy("part", "bit"))
    steps = spark.createDataFrame(orders, "filter_order string, step int, before int, bit int")
    return summed.withColumn("shapley", shapley).join(F.broadcast(steps), ["before", "bit"]).select(
        "part", "filter_order", "step", *counts, "shapley"
    )
