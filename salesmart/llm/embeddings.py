"""Embedding near-duplicates: a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.graph import components
from salesmart.llm.tasks import held, share
from salesmart.storage import stage

THRESHOLD = 0.93
# Trees at first; their number doubles for labels of a size of which less than
# this share of the links of about so many query vectors is found.
TREES, RECALL, QUERIES = 4, 0.995, 1024
# A split sends the lower and the upper 60 % to its sides: 20 % go to both.
SIDE = 0.6
# Vectors of a leaf, and those of a subtree that one task builds.
LEAF = 300
SUBTREE = 20_000
# A node is a leaf at any size where this share of its pairs is linked: then
# comparing all of them costs no more than a multiple of what is found.
DENSE = 0.05
BLOCK = 1024
NODE = ("tree", "label", "dim", "node")


def _seed(*parts) -> np.random.Generator:
    return np.random.default_rng(zlib.crc32(repr(parts).encode()))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def leaves(u: np.ndarray, seed: np.random.Generator, threshold: float) -> Iterator[np.ndarray]:
    """Places of unit vectors by leaf of one tree; neighbours share one or more."""
    waiting = [np.arange(len(u))]
    while waiting:
        here = waiting.pop()
        if len(here) > LEAF:
            a, b = seed.choice(here, (2, LEAF))
            close = np.einsum("ij,ij->i", u[a], u[b]) >= threshold
            if (close & (a != b)).mean() < DENSE:
                # By rank, so that equal projections are split as well.
                order = here[np.argsort(u[here] @ seed.standard_normal(u.shape[1]), kind="stable")]
                n = int(np.ceil(len(here) * SIDE))
                waiting += [order[:n], order[-n:]]
                continue
        yield here


def _close(x: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Cosine of rows a and b of x in double precision, compared."""
    dot = np.einsum("ij,ij->i", x[a], x[b])
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return dot / (norm[a] * norm[b]) >= threshold


def near_pairs(
    x: np.ndarray, u: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of different places, one from each list, in blocks."""
    for s in range(0, len(left), BLOCK):
        for t in range(0, len(right), BLOCK):
            a, b = left[s : s + BLOCK], right[t : t + BLOCK]
            i, j = np.nonzero(u[a] @ u[b].T >= threshold - 1e-9)
            a, b = a[i], b[j]
            apart = a < b if left is right else a != b
            a, b = a[apart], b[apart]
            near = _close(x, a, b, threshold)
            yield a[near], b[near]


def _matrix(table: pa.Table) -> np.ndarray:
    flat = pa.concat_arrays(table.column("embedding").chunks).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)


def _join(table: pa.Table, threshold: float) -> pa.Table:
    """Linked pairs of ids within one subtree, or between two chunks of a dense node."""
    x = _matrix(table)
    u = _unit(x)
    ids = table.column("id").to_numpy()
    key = [table.column(name)[0].as_py() for name in (*NODE, "i", "j")]
    found = []
    if key[-1] < 0:
        for here in leaves(u, _seed(*key), threshold):
            # In order, so that a pair reads the same in every leaf.
            here = np.sort(here)
            found += near_pairs(x, u, here, here, threshold)
    else:
        chunk = table.column("chunk").to_numpy()
        left, right = np.flatnonzero(chunk == key[-2]), np.flatnonzero(chunk == key[-1])
        found += near_pairs(x, u, left, left if key[-2] == key[-1] else right, threshold)
    none = np.zeros(0, np.int64)
    a = np.concatenate([none, *(f[0] for f in found)])
    b = np.concatenate([none, *(f[1] for f in found)])
    # By id, and each pair once.
    a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
    _, once = np.unique(np.stack([a, b]), axis=1, return_index=True)
    a, b = a[once], b[once]
    n = table.column("n").to_numpy()
    return pa.table({"a": ids[a], "b": ids[b], "n_a": n[a], "n_b": n[b]})


def _projected(rows: DataFrame) -> DataFrame:
    """``p``: each row on the random direction of its node."""

    @F.pandas_udf("double")
    def project(tree: pd.Series, label: pd.Series, node: pd.Series, vector: pd.Series) -> pd.Series:
        made = np.empty(len(vector))
        for key, at in vector.groupby([tree, label, node]).indices.items():
            u = _unit(np.stack(vector.iloc[at]).astype(np.float64))
            made[at] = u @ _seed("split", *map(str, key)).standard_normal(u.shape[1])
        return pd.Series(made)

    # Equal projections fall to either side by a trifle from their id.
    trifle = F.expr("(xxhash64(id, node) % 1000003) * 1e-15D")
    return rows.withColumn("p", project("tree", "label", "node", "embedding") + trifle)


def _subtrees(rows: DataFrame, subtree: int) -> DataFrame:
    """Rows dealt out to nodes of at most ``subtree`` vectors, or to chunk pairs.

    Nodes above that size are split at the 40th and 60th percentile of their
    projection, all of them in one job a level. Nodes whose vectors hardly
    spread are not split but compared whole, as pairs of chunks. Only large
    nodes take part in a level; where there are none no job runs but a count.
    """
    settled = []
    while True:
        sizes = stage(rows.groupBy(*NODE).agg(F.count("*").alias("size")), "sizes").rows
        large = sizes.filter(F.col("size") > subtree)
        if large.isEmpty():
            break
        sized = rows.join(sizes, list(NODE))
        settled.append(sized.filter(F.col("size") <= subtree).drop("size"))
        big = stage(_projected(sized.filter(F.col("size") > subtree)), "large").rows
        cuts = big.groupBy(*NODE).agg(
            F.percentile_approx("p", [1 - SIDE, SIDE], 10_000).alias("cut"),
            F.var_pop("p").alias("spread"),
        )
        cut = big.join(stage(cuts, "cuts").rows, list(NODE))
        flat = F.col("spread") < 0.1
        chunks = F.ceil(F.col("size") / subtree)
        dense = cut.filter(flat).withColumn("chunk", F.pmod(F.xxhash64("id"), chunks).cast("int"))
        dense = dense.withColumn("other", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1)))
        settled.append(
            dense.withColumn("i", F.least("chunk", "other"))
            .withColumn("j", F.greatest("chunk", "other"))
            .select(*rows.columns[:-3], "chunk", "i", "j")
        )
        sides = F.filter(
            F.array(
                F.when(F.col("p") <= F.col("cut")[1], F.lit("0")),
                F.when(F.col("p") >= F.col("cut")[0], F.lit("1")),
            ),
            lambda side: side.isNotNull(),
        )
        split = cut.filter(~flat).withColumn("side", F.explode(sides))
        split = split.withColumn("node", F.concat("node", "side")).select(*rows.columns)
        rows = stage(split, "split").rows
    for part in settled:
        rows = rows.unionByName(part)
    return rows


def pairs(
    classes: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, subtree: int = SUBTREE,
    first: int = 0,
) -> DataFrame:
    """Distinct linked pairs ``(a, b, n_a, n_b)`` of ids, a below b, with what ``n``
    says of each, of ``(id, label, embedding, n)``. Trees are numbered from ``first``."""
    rows = classes.select(
        F.explode(F.array(*[F.lit(n) for n in range(first, first + trees)])).alias("tree"),
        "label", F.size("embedding").alias("dim"), F.lit("").alias("node"), "id", "embedding", "n",
        F.lit(0).alias("chunk"), F.lit(0).alias("i"), F.lit(-1).alias("j"),
    )
    dealt = _subtrees(rows, subtree)
    joined = dealt.groupBy(*NODE, "i", "j").applyInArrow(
        lambda table: _join(table, threshold), "a long, b long, n_a long, n_b long"
    )
    return joined.distinct()


def _known_links(sized: DataFrame, threshold: float) -> DataFrame:
    """``a, b, power``: all links of query vectors, by comparison with their whole label.

    About ``QUERIES`` vectors of each ``power``, the size of labels by powers of
    two, are drawn by the hash of their id, so what is broadcast is bounded.
    """
    totals = {r.power: r.n for r in sized.groupBy("power").agg(F.count("*").alias("n")).collect()}
    share_of = F.create_map(*[F.lit(x) for p, n in totals.items() for x in (p, QUERIES / n)])
    drawn = F.expr("pmod(xxhash64(id, 'query'), 1000003) / 1000003D") < share_of[F.col("power")]
    asked: dict = {}
    for row in sized.filter(drawn).select("label", "dim", "id", "embedding").collect():
        asked.setdefault((row.label, row.dim), []).append((row.id, row.embedding))
    queries = {
        key: (np.array([k for k, _ in rows]), np.array([x for _, x in rows], np.float64))
        for key, rows in asked.items()
    }
    shared = share(sized.sparkSession, queries)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            keys = list(zip(table.column("label").to_pylist(), table.column("dim").to_pylist(), strict=True))
            places: dict = {}
            for n, key in enumerate(keys):
                places.setdefault(key, []).append(n)
            for key, at in places.items():
                if key not in held(shared):
                    continue
                theirs, y = held(shared)[key]
                part = table.take(pa.array(at))
                ids, x = part.column("id").to_numpy(), _matrix(part)
                both = np.concatenate([x, y])
                left, right = np.arange(len(x)), np.arange(len(x), len(both))
                names = np.concatenate([ids, theirs])
                power = part.column("power")[0].as_py()
                for i, j in near_pairs(both, _unit(both), left, right, threshold):
                    a, b = names[i], names[j]
                    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
                    yield pa.RecordBatch.from_pydict({
                        "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()),
                        "power": pa.array([power] * len(a), pa.int64()),
                    })

    return sized.select("label", "dim", "id", "embedding", "power").mapInArrow(
        compare, "a long, b long, power long"
    ).distinct()


def _enough_pairs(classes: DataFrame, threshold: float, trees: int, subtree: int) -> DataFrame:
    """Linked pairs by as many trees as find the links of query vectors.

    Labels that no tree splits are compared whole and need no queries.
    """
    found = stage(pairs(classes, threshold, trees, subtree), "pairs").rows
    dim = F.size("embedding").alias("dim")
    sizes = classes.groupBy("label", dim).agg(F.count("*").alias("size"))
    sizes = sizes.filter(F.col("size") > min(LEAF, subtree)).select(
        "label", "dim", F.floor(F.log2("size")).alias("power")
    )
    sizes = stage(sizes, "split").rows
    if sizes.isEmpty():
        return found
    sized = classes.withColumn("dim", dim).join(sizes, ["label", "dim"])
    links = stage(_known_links(sized, threshold), "known").rows
    wanted = {r.power: r.n for r in links.groupBy("power").agg(F.count("*").alias("n")).collect()}
    made = trees
    while True:
        missed = links.join(found, ["a", "b"], "left_anti").groupBy("power").agg(F.count("*").alias("n"))
        short = [r.power for r in missed.collect() if r.n > (1 - RECALL) * wanted[r.power]]
        if not short:
            return found
        again = sized.filter(F.col("power").isin(short)).select("id", "label", "embedding", "n")
        more = pairs(again, threshold, made, subtree, made)
        found = stage(found.unionByName(more).distinct(), "pairs").rows
        made *= 2


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, subtree: int = SUBTREE
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors are compared with those of the same label (and dimension) only. Null
    labels, null or zero vectors and vectors with null or non-finite components
    have no links and are components of their own. Equal vectors of one label
    are one node with a count, so copies never become pairs. ``n_links`` counts
    rows; rows of the same id count like others. A null vec_id is never the
    component_id of rows with ids. Other columns are not read.
    """
    x = F.col("embedding")
    usable = (
        F.col("label").isNotNull() & x.isNotNull()
        & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
        & F.exists(x, lambda v: v != 0)
    )
    plain = vectors.select("vec_id", "label", "embedding").withColumn("usable", F.coalesce(usable, F.lit(False)))
    # Two hashes of different readings make a key of 128 bits.
    keyed = plain.withColumns({
        "k": F.when(F.col("usable"), F.xxhash64("label", "embedding")),
        "l": F.when(F.col("usable"), F.xxhash64(F.lit(7), F.reverse("embedding"), "label")),
    })
    ids = stage(keyed.select("vec_id", "k", "l"), "vectors").rows
    classes = keyed.filter("usable").groupBy("k", "l").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.min("vec_id").alias("first"), F.count("*").alias("n"),
    )
    # Written once, so the numbers given here stay.
    classes = stage(classes.withColumn("id", F.monotonically_increasing_id()), "classes").rows
    linked = _enough_pairs(classes.select("id", "label", "embedding", "n"), threshold, trees, subtree)
    both = linked.selectExpr("a", "n_b AS n").unionByName(linked.selectExpr("b AS a", "n_a AS n"))
    more = both.groupBy("a").agg(F.sum("n").alias("more"))
    joined = stage(components(linked), "components").rows
    rooted = (
        classes.select("k", "l", "id", "first", "n")
        .join(joined, F.col("id") == F.col("node"), "left")
        .withColumn("root", F.coalesce("component", "id"))
    )
    least = stage(rooted.groupBy("root").agg(F.min("first").alias("least")), "least").rows
    known = rooted.join(least, "root").join(more, F.col("id") == F.col("a"), "left").select(
        "k", "l", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("links"), "least"
    )
    known = stage(known, "known").rows
    done = ids.join(known, ["k", "l"], "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("k").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"),
    )
    return done.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
