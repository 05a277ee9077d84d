import hashlib
import random
import re
import zlib

import pytest

from salesmart.llm import conversation_trie as ct
from salesmart.llm.conversation_trie import SpillingQueue, trie

COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256",
]
SCHEMA = "conv_id long, turn long, role string, text string, depth int, key string"


def brute(rows):
    """The trie from whole sequences held in dictionaries."""
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(conv, []).append((turn is not None, turn, mark, role, text))
    own = {c: [x[3:] for x in sorted(turns)] for c, turns in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children, leaves, saved = {}, {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves[node] = leaves.get(node, 0) + (node not in children)
        saved[node] = saved.get(node, 0) + (len(members[node]) - 1) * words
        if node:
            up = node[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[node]
            saved[up] = saved.get(up, 0) + saved[node]
    return sorted(
        (
            min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children.get(n, 0), leaves[n], saved[n],
            hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest(),
        )
        for n, m in members.items()
    )


def made(spark, rows, **ways):
    df = spark.createDataFrame([(*row, 7, "k") for row in rows], SCHEMA)
    found = trie(df, **ways)
    assert found.columns == COLUMNS
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint"] * 7 + ["string"]
    return sorted(tuple(r) for r in found.select(*COLUMNS).collect())


def some(seed, convs, longest, texts):
    draw = random.Random(seed)
    rows = [
        (c, t, draw.choice(["user", "assistant"]), draw.choice(texts))
        for c in range(convs) for t in range(draw.randint(1, longest))
    ]
    draw.shuffle(rows)
    return rows


def test_random_tries(spark):
    rows = some(1, 60, 6, ["a", "b c", ""])
    want = brute(rows)
    assert made(spark, rows) == want


@pytest.mark.parametrize("ways", [
    {"span": 1}, {"span": 2, "crowded": 3}, {"span": 3, "crowded": 1}, {"span": 4, "crowded": 1000, "limit": 2},
])
def test_shards_of_any_size_and_spilling_queues(spark, ways):
    """Deep and crowded parts, cut everywhere, give the same sums."""
    rows = some(2, 50, 9, ["a", "b c"]) + [(c, t, "user", f"w {t}") for c in (300, 301, 302) for t in range(40)]
    assert made(spark, rows, **ways) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (20, None, None, None), (20, 3, "user", "x y"), (20, 3, "user", "x y"),
        (20, 3, "assistant", ""), (21, 1, None, "word " * 50_000), (22, 0, "user", None), (40, 5, "", ""),
        (-3, 1, "user", "minus"), (-20, 1, "user", "base"), (1, 0, "user", "alone"), (61, 0, "u", "no base"),
        (2**62, 0, "user", "far"),
    ]
    assert made(spark, rows) == brute(rows)


def test_many_that_end_at_one_node(spark, monkeypatch):
    """A third of all are copies; the ids that end there come in several parts."""
    monkeypatch.setattr(ct, "JOINED", 40)
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400) for t in range(3)]
    rows += some(3, 30, 4, ["p", "q"])
    assert made(spark, rows, crowded=20) == brute(rows)


def test_parents_of_many_children(spark, monkeypatch):
    rows = [(20 * c, t, "user", "same" if t == 0 else f"own {c}") for c in range(200) for t in range(2)]
    monkeypatch.setattr(ct, "MOST_CROWDED", 10)
    real = max
    monkeypatch.setattr(ct, "max", lambda a, b: real(5, b), raising=False)
    assert made(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert made(spark, []) == []
    assert made(spark, [(None, 0, "user", "x")]) == []


def test_queue_merges_what_it_spilled(tmp_path):
    draw = random.Random(9)
    queue = SpillingQueue(str(tmp_path / "runs"), 10)
    want = {}
    for _ in range(500):
        key = (draw.randint(-5, 0), draw.randint(0, 9), 0)
        sums = (1, draw.randint(0, 9), draw.randint(0, 9))
        want[key] = tuple(a + b for a, b in zip(want.get(key, (0, 0, 0)), sums))
        queue.push(key, sums)
    assert queue.spilled > 10 and len(queue.heap) <= 10
    for key in sorted(want):
        assert queue.take((key[0], key[1], -1)) == (0, 0, 0)
        assert queue.take(key) == want[key]
    assert not len(queue) and not list((tmp_path / "runs").iterdir())
