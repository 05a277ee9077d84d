"""SimHash near-duplicates: a self-join of binary tries over 64-bit fingerprints."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.graph import components, hook
from salesmart.llm.tasks import small_batches
from salesmart.storage import stage

BITS = 64
SEED = 42
# Fingerprints of one trie or pair of tries that a task holds at a time.
CHUNK = 20_000
# Rows that a task joins together, and pairs it compares at a time.
BATCH = 100_000
PAIRS = 1 << 21
# Node pairs with no more fingerprint pairs than this are compared directly.
LEAF = 256


def _fingerprint(text: str | None, width: int) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    n = max(1, len(words) - width + 1)
    ends = stops[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends, strict=True)), "<u8", n
    )
    ones = np.zeros(BITS, np.int64)
    for block in range(0, n, 1 << 16):
        part = hashes[block : block + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint(text: Column, width: int = 4) -> Column:
    """SimHash of the ``width``-word shingles as a signed 64-bit number.

    A-Z are lower-cased, words are split at ASCII white space. Texts of fewer
    words are one shingle; null, empty and blank texts have fingerprint 0.
    """

    @F.pandas_udf("long")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(text, width) for text in texts], dtype="int64")

    return make(text)


def blocks(distance: int) -> list[tuple[int, int]]:
    """``distance + 1`` blocks of bits as (offset, length), at least one of which
    is equal in two fingerprints that are linked."""
    n = distance + 1
    edges = [round(BITS * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def trie_pairs(
    x: np.ndarray, nodes: tuple[np.ndarray, ...], distance: int, depth: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs in ``x`` that differ in at most ``distance`` bits.

    A node of a trie is a range of sorted numbers. ``nodes`` holds pairs of
    nodes (from, to, from, to), a node paired with itself included. All pairs go
    down one bit together: each becomes up to four pairs of children, those over
    different bits carry one more error, and pairs over the budget are pruned.
    Pairs of small nodes are compared directly.
    """
    a0, a1, b0, b1 = (np.asarray(n, np.int64) for n in nodes)
    errors = np.zeros(len(a0), np.int64)
    while len(a0):
        small = (a1 - a0) * (b1 - b0) <= LEAF
        if depth >= BITS:
            small[:] = True
        yield from _compare(x, a0[small], a1[small], b0[small], b1[small], distance)
        a0, a1, b0, b1, errors = (v[~small] for v in (a0, a1, b0, b1, errors))
        if not len(a0):
            return
        zero = np.concatenate(([0], np.cumsum((x >> np.uint64(BITS - 1 - depth)) & np.uint64(1) == 0)))
        am, bm = a0 + zero[a1] - zero[a0], b0 + zero[b1] - zero[b0]
        own = (a0 == b0) & (a1 == b1)
        made = [
            (a0, am, b0, bm, errors, np.ones_like(own)),
            (am, a1, bm, b1, errors, np.ones_like(own)),
            (a0, am, bm, b1, errors + 1, np.ones_like(own)),
            (am, a1, b0, bm, errors + 1, ~own),
        ]
        a0, a1, b0, b1, errors, keep = (np.concatenate(v) for v in zip(*made, strict=True))
        keep &= (a0 < a1) & (b0 < b1) & (errors <= distance)
        a0, a1, b0, b1, errors = (v[keep] for v in (a0, a1, b0, b1, errors))
        depth += 1


def _compare(x, a0, a1, b0, b1, distance) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    sizes = (a1 - a0) * (b1 - b0)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        which = np.repeat(np.arange(at, to), sizes[at:to])
        place = np.arange(len(which)) - np.repeat(ends[at:to] - sizes[at:to] - base, sizes[at:to])
        wide = (b1 - b0)[which]
        left, right = a0[which] + place // wide, b0[which] + place % wide
        near = (left != right) & (np.bitwise_count(x[left] ^ x[right]) <= distance)
        yield left[near], right[near]
        at = to


def _join_batch(rows: pd.DataFrame, distance: int) -> pa.RecordBatch:
    """Links in a batch of whole units, as a forest: (a, b) with b the root."""
    rows = rows.sort_values(["unit", "side", "turned"], ignore_index=True)
    x = rows["turned"].to_numpy().astype(np.uint64)
    parent = np.arange(len(x))
    unit, side = rows["unit"].to_numpy(), rows["side"].to_numpy()
    cut = np.flatnonzero((unit[1:] != unit[:-1]) | (side[1:] != side[:-1])) + 1
    starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(x)]))
    crossed = rows["crossed"].to_numpy()[starts]
    own = ~crossed
    both = np.flatnonzero(crossed[:-1] & (unit[starts[:-1]] == unit[starts[1:]]))
    nodes = [
        np.concatenate((v[own], v[both + k]))
        for v, k in ((starts, 0), (ends, 0), (starts, 1), (ends, 1))
    ]
    for left, right in trie_pairs(x, nodes, distance):
        parent = hook(parent, left, right)
    moved = np.flatnonzero(parent != np.arange(len(x)))
    prints = rows["fp"].to_numpy()
    return pa.RecordBatch.from_arrays(
        [pa.array(prints[moved]), pa.array(prints[parent[moved]])], ["a", "b"]
    )


def links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """A forest ``(a, b)`` with the components of all links between the numbers ``fp``.

    Two linked fingerprints agree in at least one of ``distance + 1`` blocks. For
    each block the trie is turned so that this block comes first, where no
    errors are allowed; the tries below are dealt out by it and joined with
    themselves. A trie of more than ``CHUNK`` fingerprints is dealt out as
    chunks by hash, and every pair of chunks is joined, so that no task holds
    more than two chunks at a time. Tasks return forests, not pairs.
    """
    distinct = stage(prints.select("fp").filter("fp IS NOT NULL").distinct(), "prints").rows
    turns = ", ".join(
        f"struct({i} AS turn, "
        + (f"(fp << {a}) | shiftrightunsigned(fp, {BITS - a})" if a else "fp")
        + f" AS turned, {n} AS n)"
        for i, (a, n) in enumerate(blocks(distance))
    )
    turned = distinct.selectExpr("fp", f"inline(array({turns}))").selectExpr(
        "fp", "turned", "concat(turn, ':', shiftrightunsigned(turned, 64 - n)) AS trie"
    )
    sizes = turned.groupBy("trie").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > CHUNK)
    large = stage(large.selectExpr("trie", f"ceil(n / {CHUNK}) AS chunks"), "large").rows
    dealt = turned.join(large, "trie", "left").withColumn(
        "chunk", F.expr("pmod(xxhash64(fp), coalesce(chunks, 1))")
    )
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, coalesce(chunks, 1) - 1)")))
    units = dealt.selectExpr(
        "fp", "turned", "chunk <> other AS crossed", "int(chunk > other) AS side",
        "concat_ws(':', trie, least(chunk, other), greatest(chunk, other)) AS unit",
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        n = 0
        for batch in batches:
            held.append(batch.to_pandas())
            n += len(held[-1])
            if n >= BATCH:
                rows = pd.concat(held, ignore_index=True)
                # The last unit may go on in the next batch.
                last = rows["unit"].to_numpy() == rows["unit"].iloc[-1]
                if not last.all():
                    yield _join_batch(rows[~last], distance)
                held, n = [rows[last]], int(last.sum())
        if n:
            yield _join_batch(pd.concat(held, ignore_index=True), distance)

    together = units.repartition("unit").sortWithinPartitions("unit")
    return together.mapInArrow(join, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: ``doc_id, fp, component_id``.

    ``component_id`` is the smallest doc_id whose fingerprint is reachable by
    links of at most ``distance`` differing bits, the own included. Equal
    fingerprints are linked, so copies are one node of the graph. Null and empty
    texts have fingerprint 0 and are linked with each other; repeated rows each
    get their row; a component of null ids only has a null id. Columns other
    than doc_id and text are not read.
    """
    small_batches(docs.sparkSession)
    made = docs.select("doc_id", fingerprint(F.col("text"), width).alias("fp"))
    made = stage(made, "fingerprints").rows
    rooted = _rooted(made, distance)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    least = stage(least, "least").rows
    ids = stage(rooted.join(least, "root").select("fp", "component_id"), "ids").rows
    return made.join(ids, "fp", "left").select("doc_id", "fp", "component_id")


def _rooted(made: DataFrame, distance: int) -> DataFrame:
    """``fp, first, root``: distinct fingerprints, the smallest id of each, and a
    fingerprint that stands for its component."""
    firsts = stage(made.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts").rows
    joined = stage(components(links(firsts, distance)), "components").rows
    return firsts.join(joined, firsts["fp"] == joined["node"], "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")
    )


def keep_one(docs: DataFrame, width: int = 4, distance: int = 4) -> DataFrame:
    """Of each component one row, in the columns of ``docs``.

    It is decided by row, not by id: the row of smallest id stays, of those that
    share it the one of smallest fingerprint, and of these the smallest by its
    columns in order. Rows that repeat an id and are alike nothing else stay.
    Rows without an id cannot be told apart by one and all stay.
    """
    small_batches(docs.sparkSession)
    fp = "fp"
    while fp in docs.columns:
        fp = f"_{fp}"
    # Texts are fingerprinted once; the copy is read for the choice and for the rows.
    marked = stage(docs.withColumn(fp, fingerprint(F.col("text"), width)), "fingerprints").rows
    rooted = _rooted(marked.select("doc_id", F.col(fp).alias("fp")), distance)
    chosen = rooted.filter("first IS NOT NULL").groupBy("root").agg(
        F.min(F.struct("first", "fp")).alias("row")
    )
    chosen = stage(chosen.select(F.col("row.first").alias("doc_id"), F.col("row.fp").alias(fp)), "chosen").rows
    # Rows of equal id and fingerprint meet after each task has cut its own to one.
    others = [name for name in docs.columns if name != "doc_id"]
    named = marked.filter("doc_id IS NOT NULL").groupBy("doc_id", fp).agg(
        F.min(F.struct(*others)).alias("_row")
    )
    kept = named.join(chosen, ["doc_id", fp], "left_semi").select("doc_id", "_row.*")
    return kept.select(*docs.columns).unionByName(marked.filter("doc_id IS NULL").drop(fp))
