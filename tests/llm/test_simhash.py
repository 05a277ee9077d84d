import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import graph, simhash


def brute(texts, width=4):
    prints = []
    for text in texts:
        words = (text or "").encode().lower().split()
        n = max(1, len(words) - width + 1)
        shingles = [b" ".join(words[k : k + width]) for k in range(n)] if words else []
        hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return prints


def reachable(prints, distance):
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprint_is_the_native_hash_of_a_single_shingle(spark, documents):
    docs = documents(["One two\tTHREE", "a b c d"])
    rows = docs.select(
        simhash.fingerprint(F.col("text")).alias("mine"),
        F.xxhash64(F.regexp_replace(F.lower("text"), r"\s+", " ")).alias("theirs"),
    ).collect()
    assert all(row.mine == row.theirs for row in rows)


@pytest.mark.parametrize("chunk", [20_000, 3])
def test_components_against_brute_force(spark, documents, monkeypatch, chunk):
    """Also where tries are dealt out in chunks."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    base = " ".join(f"w{n}" for n in rng.integers(0, 500, 120))
    texts = [None, "", "short text", "short  TEXT"]
    for n in range(40):
        words = base.split()
        for at in rng.integers(0, len(words), n % 4):
            words[at] = f"z{n}"
        texts.append(" ".join(words))
    found = {r.doc_id: r for r in simhash.near_duplicates(documents(texts)).collect()}
    prints = brute(texts)
    want = reachable(prints, 4)
    for n, fp in enumerate(prints):
        assert found[n].fp % (1 << 64) == fp
        assert found[n].component_id == want[n]


def test_trie_pairs_finds_every_pair():
    rng = np.random.default_rng(0)
    x = np.unique(rng.integers(0, 1 << 12, 900).astype(np.uint64) << np.uint64(30))
    nodes = [np.array([v]) for v in (0, len(x), 0, len(x))]
    found = set()
    for left, right in simhash.trie_pairs(x, nodes, 2):
        found |= {(min(a, b), max(a, b)) for a, b in zip(left.tolist(), right.tolist())}
    want = {
        (i, j) for i in range(len(x)) for j in range(i + 1, len(x))
        if int(x[i] ^ x[j]).bit_count() <= 2
    }
    assert found == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(n, n + 1) for n in range(30)] + [(100, n) for n in range(101, 160)] + [(7, 7), (None, 3)]
    made = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in made} == (
        {(n, 0) for n in range(31)} | {(n, 100) for n in range(100, 160)}
    )


@pytest.mark.parametrize("held", [200_000, 50])
def test_components_of_a_clique(spark, monkeypatch, held):
    """All pairs of a group come down to a forest, in one piece or many."""
    monkeypatch.setattr(graph, "EDGES", held)
    pairs = [(a, b) for a in range(5, 60) for b in range(a + 1, 60)] + [(1, 2), (2, 59)]
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(3)
    assert graph._thinned(frame).count() <= 3 * 57
    made = {r.node: r.component for r in graph.components(frame).collect()}
    assert made == {n: 1 for n in (1, 2, *range(5, 60))}


def test_odd_rows(nasty, empty):
    rows = simhash.near_duplicates(nasty).collect()
    assert len(rows) == nasty.count()
    blank = {r.component_id for r in rows if r.fp == 0}
    assert blank == {0}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(nasty)
    assert kept.columns == nasty.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and ids.count(None) == 2
    assert simhash.keep_one(empty).count() == 0


def test_rows_are_kept_by_row_not_by_id(spark):
    """A repeated id has a copy of another text and a text of its own."""
    first, own = "one two three four five six seven eight", "nothing here is alike any other text at all"
    rows = [(3, first, "x"), (5, first, "x"), (5, own, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    assert sorted(tuple(r) for r in simhash.keep_one(docs).collect()) == [(3, first, "x"), (5, own, "x")]


def test_kept_rows_with_repeated_ids_against_brute_force(spark):
    draw = random.Random(11)
    words = [f"w{n}" for n in range(40)]
    texts = [" ".join(draw.choice(words) for _ in range(60)) for _ in range(12)] + ["", None]
    rows = [(draw.choice([1, 2, 3, 4, 5, 6, None]), draw.choice(texts), draw.randint(0, 1)) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    made = brute([text for _, text, _ in rows])
    roots = reachable(made, 4)
    want = [row for row in rows if row[0] is None]
    for root in set(roots):
        mine = [
            (i, made[n] - (made[n] >> 63 << 64), (text is not None, text, k), (i, text, k))
            for n, (i, text, k) in enumerate(rows) if roots[n] == root and i is not None
        ]
        if mine:
            want.append(min(mine)[3])
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
