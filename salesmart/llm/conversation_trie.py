"""The prefix trie of conversations, its subtrees summed by time-forward processing.

A node is a distinct sequence of first turns. Nodes are sorted deepest level
first; each, when its turn comes, takes what its children have sent it from a
priority queue and sends its totals on to its parent, which comes later. Queues
spill sorted runs to the shared folder. The trie is cut into shards, each a
subtree without crowded nodes and of bounded height; their roots' totals then go
through the same steps among shards, and last through the few crowded nodes.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from salesmart.operators.numbering import ranked
from salesmart.storage import delete_path, fresh_path, stage

# A conversation takes over the beginning of the first one of its family of so
# many ids: fewer than TAKEN turns, by a checksum of its id.
FAMILY, TAKEN = 20, 4
# Levels of a shard, and rows beneath a node from which on it is crowded.
SPAN, CROWDED = 1024, 200
# Crowded nodes are at most so many: the bound rises with the number of rows.
MOST_CROWDED = 100_000
# Messages that a queue holds in memory, and that it reads back at a time.
QUEUE, BLOCK = 200_000, 4096
# Bytes of joined ids that are handed on at a time.
JOINED = 1 << 20
WORDS = r"[^\x20\x09-\x0D]+"
ID = ["depth", "p1", "p2"]


# --- rebuilt conversations ---------------------------------------------------


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns as ``conv, turn, key, words``; the key stands for role and text."""
    role, text = (F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ("role", "text"))
    known = conversations.select(
        F.col("conv_id").try_cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text")
    ).filter("conv IS NOT NULL")
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return known.select(
        "conv", "turn", F.unhex(F.md5(whole)).alias("key"),
        F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"),
    )


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations ``conv, length`` and their turns ``conv, depth, key, words, last``.

    Turns are in order of ``turn``, null first, those of equal ``turn`` by the MD5
    of role and text. Their places come from one sort of the whole table by ranges,
    so a conversation that holds a third of all turns is spread over tasks. Of
    conversation c the first h turns are those of c - c % 20, as far as it has
    them, where h is the CRC-32 of c in decimal digits modulo 4.
    """
    placed, _ = ranked(
        _turns(conversations), "conv", F.asc_nulls_first("turn"), "key", name="at"
    )
    rows = stage(placed.drop("turn"), "turns").rows
    sizes = stage(rows.groupBy("conv").agg(F.min("at").alias("first"), F.count("*").alias("n")), "sizes").rows
    asked = sizes.selectExpr(
        "conv", "first", "n", f"conv - conv % {FAMILY} AS base",
        f"crc32(string(conv)) % {TAKEN} AS h",
    )
    bases = sizes.selectExpr("conv AS base", "n AS base_n")
    convs = asked.join(bases, "base", "left").withColumn("taken", F.expr("least(h, coalesce(base_n, 0L))"))
    convs = stage(
        convs.selectExpr("conv", "first", "base", "h", "taken", "taken + greatest(n - h, 0L) AS length"), "convs"
    ).rows
    own = rows.join(convs, "conv").selectExpr(
        "conv", "at - first + 1 - h + taken AS depth", "key", "words", "length", "taken"
    ).filter("depth > taken")
    heads = rows.filter(f"conv % {FAMILY} = 0").join(sizes, "conv").selectExpr(
        "conv AS base", "at - first + 1 AS depth", "key", "words"
    ).filter(f"depth < {TAKEN}")
    begun = convs.join(heads, "base").filter("depth <= taken")
    names = ["conv", "depth", "key", "words", "length"]
    turns = own.select(*names).unionByName(begun.select(*names))
    return convs.select("conv", "length"), turns.withColumn("last", F.expr("depth = length")).drop("length")


# --- nodes -------------------------------------------------------------------


def _prefixes(turns: DataFrame, span: int) -> DataFrame:
    """Turns with the node of their prefix, ``p1, p2``, and of its parent, ``q1, q2``.

    A prefix is the exclusive or of 128-bit hashes of its turns with their
    depths. That can be taken in any grouping: per block of ``span`` turns, over
    the blocks of a conversation, then turn by turn within a block, so that no
    task sees a whole long conversation.
    """
    mixed = turns.withColumns({
        "block": F.expr(f"(depth - 1) div {span}"),
        "z1": F.xxhash64("depth", "key"), "z2": F.xxhash64("key", "depth"),
    })
    blocks = mixed.groupBy("conv", "block").agg(F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"))
    before = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = blocks.select(
        "conv", "block", *[F.coalesce(F.bit_xor(b).over(before), F.lit(0)).alias(f"c{b[1]}") for b in ("b1", "b2")]
    ).filter("block > 0")
    within = W.partitionBy("conv", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    run = mixed.withColumns({"r1": F.bit_xor("z1").over(within), "r2": F.bit_xor("z2").over(within)})
    first = run.filter("block = 0").withColumns({"c1": F.lit(0), "c2": F.lit(0)})
    later = run.filter("block > 0").join(carried, ["conv", "block"])
    made = first.unionByName(later)
    return made.selectExpr(
        "conv", "depth", "block", "words", "last", "r1 ^ c1 AS p1", "r2 ^ c2 AS p2",
        "r1 ^ c1 ^ z1 AS q1", "r2 ^ c2 ^ z2 AS q2",
    )


def _sharded(rows: DataFrame, crowded: DataFrame, deep: bool) -> DataFrame:
    """Rows with their shard ``s``, null on crowded nodes; the first shard on their
    way down ``t`` and, of a shard below another, that one's ``r``.

    A shard begins with the first node of a block that is not crowded. Nodes
    above crowded ones are crowded too, so all rows of a node agree on it.
    """
    marked = rows.join(F.broadcast(crowded.select(*ID, F.lit(True).alias("crowded"))), ID, "left")
    root = F.min(F.when(F.col("crowded").isNull(), F.struct(*ID)))
    if not deep:
        found = marked.withColumn("s", root.over(W.partitionBy("conv", "block")))
        found = found.withColumns({"t": F.col("s"), "r": F.lit(None).cast(found.schema["s"].dataType)})
    else:
        path = W.partitionBy("conv")
        blocks = marked.groupBy("conv", "block").agg(root.alias("s")).select(
            "conv", "block", "s", F.min("s").over(path).alias("t"),
            F.lag("s").over(path.orderBy("block")).alias("r"),
        )
        found = marked.join(blocks, ["conv", "block"])
    light = F.col("crowded").isNull()
    return found.withColumns({name: F.when(light, F.col(name)) for name in "str"}).drop("crowded")


def _nodes(rows: DataFrame) -> DataFrame:
    """One row per node. Whatever its rows agree on is taken from any of them."""
    same = ["q1", "q2", "block", "words", "s", "t", "r"]
    return rows.groupBy(*ID).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
        F.sum(F.col("last").cast("long")).alias("n_ends"), *[F.any_value(x).alias(x) for x in same],
    )


# --- time-forward processing -------------------------------------------------


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path of the shared folder; schemes Arrow cannot write are errors."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", path)
    if scheme is None or scheme.group(1) == "file":
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


class SpillingQueue:
    """Messages by the key of whom they are for, smallest first.

    At most ``limit`` wait in memory. Beyond that they are added up by key,
    sorted and written to a file of ``folder``; files are read back in blocks
    while they are merged with what comes later.
    """

    def __init__(self, folder: str, limit: int = QUEUE):
        self.folder, self.limit = folder, limit
        self.heap: list[tuple] = []
        self.runs: list[tuple] = []
        self.spilled = 0

    def push(self, key: tuple, sums: tuple[int, int, int]) -> None:
        heapq.heappush(self.heap, (key, sums))
        if len(self.heap) > self.limit:
            self._spill()

    def _spill(self) -> None:
        store, folder = _store(self.folder)
        store.create_dir(folder, recursive=True)
        path = f"{folder}/{uuid.uuid4().hex}"
        self.heap.sort()
        made: list[list[int]] = []
        for key, sums in self.heap:
            if made and tuple(made[-1][:3]) == key:
                made[-1][3:] = [a + b for a, b in zip(made[-1][3:], sums, strict=True)]
            else:
                made.append([*key, *sums])
        names = ["level", "i1", "i2", "children", "leaves", "saved"]
        table = pa.table({name: [row[n] for row in made] for n, name in enumerate(names)})
        with store.open_output_stream(path) as sink, pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table, max_chunksize=BLOCK)
        self.heap, self.spilled = [], self.spilled + 1
        self._advance(self._read(store, path), self.spilled)

    @staticmethod
    def _read(store: fs.FileSystem, path: str) -> Iterator[tuple]:
        with store.open_input_stream(path) as source, pa.ipc.open_stream(source) as blocks:
            for block in blocks:
                for row in zip(*[column.to_pylist() for column in block.columns], strict=True):
                    yield row[:3], row[3:]
        store.delete_file(path)

    def _advance(self, run: Iterator[tuple], number: int) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (*head, number, run))

    def take(self, key: tuple) -> tuple[int, int, int]:
        """The sums of all messages for a key; they leave the queue."""
        children = leaves = saved = 0
        while self.heap and self.heap[0][0] == key:
            _, (a, b, c) = heapq.heappop(self.heap)
            children, leaves, saved = children + a, leaves + b, saved + c
        while self.runs and self.runs[0][0] == key:
            _, (a, b, c), number, run = heapq.heappop(self.runs)
            children, leaves, saved = children + a, leaves + b, saved + c
            self._advance(run, number)
        return children, leaves, saved

    def __len__(self) -> int:
        return len(self.heap) + len(self.runs)


TRAVELS = ["g", "level", "i1", "i2", "u1", "u2", "top", "message", "children", "leaves", "saved"]


def forward(rows: DataFrame, folder: str, limit: int = QUEUE) -> DataFrame:
    """Nodes with the sums of their subtrees, each shard ``g`` for itself.

    Rows are nodes, or messages for one, which are added to it. A node has its
    level, its id ``i1, i2``, its parent's ``u1, u2`` one level above, and its
    own ``leaves`` and ``saved``; ``top`` ones send nothing on. Shards are sorted
    by Spark, deepest level first, and read as a stream.
    """
    ordered = rows.repartition("g").sortWithinPartitions(
        "g", F.desc("level"), "i1", "i2", F.desc("message")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, shard = SpillingQueue(folder, limit), None
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in TRAVELS]
            sums: list[tuple[int, int, int]] = []
            for g, level, i1, i2, u1, u2, top, message, children, leaves, saved in zip(*columns, strict=True):
                if g != shard:
                    if len(queue):
                        raise RuntimeError("Messages for nodes that are not in their shard")
                    shard = g
                if message:
                    queue.push((-level, i1, i2), (children, leaves, saved))
                    continue
                a, b, c = queue.take((-level, i1, i2))
                sums.append((a, leaves + b, saved + c))
                if not top:
                    queue.push((1 - level, u1, u2), (1, leaves + b, saved + c))
            nodes = batch.filter(pc.invert(batch.column("message")))
            for n, name in enumerate(("children", "leaves", "saved")):
                at = nodes.schema.get_field_index(name)
                nodes = nodes.set_column(at, name, pa.array([x[n] for x in sums], pa.int64()))
            yield nodes
        if len(queue):
            raise RuntimeError("Messages for nodes that are not in their shard")

    return ordered.mapInArrow(run, ordered.schema)


def _message(g: str | Column, level: str, i1: str, i2: str) -> list[Column]:
    """The columns of a message row beside its sums."""
    place = [F.expr(g) if isinstance(g, str) else g, F.expr(level), F.col(i1), F.col(i2)]
    named = [x.alias(n) for x, n in zip(place, TRAVELS[:4], strict=True)]
    none = [F.lit(None).cast("long").alias(name) for name in ("u1", "u2")]
    return [*named, *none, F.lit(False).alias("top"), F.lit(True).alias("message")]


def _summed(nodes: DataFrame, folder: str, deep: bool, limit: int) -> DataFrame:
    """Nodes with ``children, leaves, saved`` of their subtrees."""
    kept = F.struct("conv_id", "n_convs", "block", "s", "t", "r").alias("node")
    own = {
        "level": F.col("depth"), "i1": F.col("p1"), "i2": F.col("p2"), "u1": F.col("q1"), "u2": F.col("q2"),
        "top": F.coalesce(F.expr("depth = s.depth"), F.expr("depth = 0")), "message": F.lit(False),
        "children": F.lit(0).cast("long"), "leaves": F.expr("bigint(n_ends = n_convs)"),
        "saved": F.expr("(n_convs - 1) * words"),
    }
    shard = F.struct("s.p1", "s.p2")
    columns = [*[value.alias(name) for name, value in own.items()], kept]
    light = nodes.filter("s IS NOT NULL").select(shard.alias("g"), *columns)
    sums = [F.sum(name).alias(name) for name in ("leaves", "saved")]
    if deep:
        # Totals of shards alone, passed up along the shards of each way down.
        alone = stage(forward(light, folder, limit).filter("top"), "shards").rows
        among = alone.select(
            F.struct("node.t.p1", "node.t.p2").alias("g"), F.col("node.block").alias("level"),
            "i1", "i2", F.col("node.r.p1").alias("u1"), F.col("node.r.p2").alias("u2"),
            F.expr("node.r IS NULL").alias("top"), "message", "children", "leaves", "saved",
            F.struct(F.col("level"), "u1", "u2", F.col("node.r").alias("r")).alias("node"),
        )
        whole = forward(among, folder, limit).filter("NOT top")
        whole = whole.select("node.*", "leaves", "saved")
        below = whole.groupBy("r", "level", "u1", "u2").agg(F.count("*").alias("children"), *sums).select(
            *_message(F.struct("r.p1", "r.p2"), "level - 1", "u1", "u2"), "children", "leaves", "saved",
            F.lit(None).cast(light.schema["node"].dataType).alias("node"),
        )
        light = light.unionByName(below)
    done = stage(forward(light, folder, limit), "light").rows
    # Shards hang below crowded nodes: one message for each of these, then one task.
    hanging = done.filter("top AND node.r IS NULL").groupBy("level", "u1", "u2").agg(
        F.count("*").alias("children"), *sums
    )
    one = F.struct(F.lit(0).cast("long").alias("p1"), F.lit(0).cast("long").alias("p2"))
    crown = nodes.filter("s IS NULL").select(one.alias("g"), *columns).unionByName(
        hanging.select(
            *_message(one, "level - 1", "u1", "u2"), "children", "leaves", "saved",
            F.lit(None).cast(done.schema["node"].dataType).alias("node"),
        )
    )
    return done.unionByName(forward(crown, folder, limit))


# --- the trie ----------------------------------------------------------------


def _endings(rows: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ids that end there, ascending, joined by commas.

    Ids are sorted by node and id over all tasks and joined to parts there; the
    parts of a node, a thousandth of its ids or less, are then digested in order.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        node, first, ids, size, total = None, 0, [], 0, 0
        for batch in batches:
            for *now, conv in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if now != node or size >= JOINED:
                    if ids:
                        made.append((*node, first, ",".join(ids)))
                        total += size
                    if total >= JOINED:
                        yield parts(made)
                        made, total = [], 0
                    node, first, ids, size = now, conv, [], 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
        if ids:
            made.append((*node, first, ",".join(ids)))
        yield parts(made)

    def parts(made: list[tuple]) -> pa.RecordBatch:
        names = [*ID, "first", "ids"]
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([row[n] for row in made], kind) for n, kind in enumerate(kinds)], names
        )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, made = None, None, []
        for batch in batches:
            for *now, _, ids in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if now != node:
                    if node:
                        made.append((*node, state.hexdigest()))
                    node, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield ends(made)
            made = []
        if node:
            yield ends([(*node, state.hexdigest())])

    def ends(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array([row[n] for row in made], kind) for n, kind in enumerate(kinds)], [*ID, "ends_sha256"]
        )

    key = [*ID, "conv"]
    joined = rows.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(
        join, "depth long, p1 long, p2 long, first long, ids string"
    )
    return joined.repartition(*ID).sortWithinPartitions(*ID, "first").mapInArrow(
        digest, "depth long, p1 long, p2 long, ends_sha256 string"
    )


def _with_parents(nodes: DataFrame) -> DataFrame:
    """Nodes with ``parent_conv_id``. Parents of so many children that fewer than
    100,000 such can be are broadcast; the others are joined by key."""
    total = nodes.count()
    many = max(10_000, total // MOST_CROWDED)
    parents = nodes.filter("n_children > 0").selectExpr(
        "depth + 1 AS depth", "p1 AS q1", "p2 AS q2", "conv_id AS parent_conv_id", "n_children AS siblings"
    )
    key = ["depth", "q1", "q2"]
    met = nodes.join(F.broadcast(parents.filter(F.col("siblings") > many)), key, "left")
    rest = met.filter("siblings IS NULL").drop("siblings", "parent_conv_id")
    rest = rest.join(parents.filter(F.col("siblings") <= many), key, "left")
    return met.filter("siblings IS NOT NULL").unionByName(rest).drop("siblings")


def trie(
    conversations: DataFrame, span: int = SPAN, crowded: int = CROWDED, limit: int = QUEUE
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, all numbers long.

    ``conv_id`` (the smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``; ids are what tells nodes
    apart, as (conv_id, depth) does. Null roles and texts are empty; rows whose
    conv_id is null or no whole number belong to no conversation; repeated rows
    are turns of their own; a table without conversations has no nodes; other
    columns are not read. ``span``, ``crowded`` and ``limit`` change the way,
    not the result.
    """
    spark = conversations.sparkSession
    convs, turns = rebuilt(conversations)
    rows = stage(_prefixes(turns, span), "prefixes").rows
    size = rows.agg(F.count("*").alias("n"), F.max("block").alias("block")).first()
    # Rows add up to the rows of all nodes, so that few nodes can have so many.
    bound = max(crowded, math.ceil(size.n / MOST_CROWDED))
    many = stage(rows.groupBy(*ID).agg(F.count("*").alias("n")).filter(F.col("n") >= bound), "crowded").rows
    deep = bool(size.block)
    sharded = _sharded(rows, many, deep)
    found = _nodes(sharded)
    place = found.schema["s"].dataType
    nothing = [F.lit(None).cast(place).alias(name) for name in "str"]
    root = convs.agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"),
        F.coalesce(F.sum(F.expr("bigint(length = 0)")), F.lit(0)).alias("n_ends"),
    ).filter("n_convs > 0").select(
        *[F.lit(0).cast("long").alias(name) for name in ID], "conv_id", "n_convs", "n_ends",
        *[F.lit(0).cast("long").alias(name) for name in ("q1", "q2", "block", "words")], *nothing,
    )
    nodes = stage(found.unionByName(root), "nodes").rows
    folder = fresh_path(spark, "spill")
    summed = stage(
        _summed(nodes, folder, deep, limit).select(
            F.col("level").alias("depth"), F.col("i1").alias("p1"), F.col("i2").alias("p2"),
            F.col("u1").alias("q1"), F.col("u2").alias("q2"), "node.conv_id", "node.n_convs",
            F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
            F.col("saved").alias("saved_tokens"),
        ), "summed",
    ).rows
    delete_path(spark, folder)
    empty = convs.filter("length = 0").select(
        *[F.lit(0).cast("long").alias(name) for name in ID], "conv"
    )
    ends = _endings(rows.filter("last").select(*ID, "conv").unionByName(empty))
    done = _with_parents(summed).join(ends, ID, "left")
    return done.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
