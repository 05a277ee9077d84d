import random

import numpy as np
import pytest

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import packing
from salesmart.llm.queries import RANKS


def naive(sizes, row):
    free = []
    for size in sorted(sizes, reverse=True):
        room = [f for f in free if f >= size]
        if room:
            free.remove(min(room))
            free.append(min(room) - size)
        else:
            free.append(row - size)
    return len(free)


def test_best_fit_decreasing():
    random.seed(1)
    for _ in range(200):
        row = random.randint(1, 70)
        sizes = [random.randint(1, row) for _ in range(random.randint(0, 60))]
        bins = packing.best_fit(np.array(sizes, np.int64), row)
        assert sorted(k for places in bins for k in places) == list(range(len(sizes)))
        assert all(sum(sizes[k] for k in places) <= row for places in bins)
        assert len(bins) == naive(sizes, row)


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_round_trip(spark, documents, block):
    random.seed(2)
    texts = [" ".join(random.choice(["lorem", "ipsum", "é", "12"]) for _ in range(random.randint(0, 90)))
             for _ in range(40)] + [None, ""]
    made = packing.pack(documents(texts), RANKS, row=32, block=block).collect()
    with open(RANKS, "rb") as file:
        coder = packing.Tokens(file.read())
    pieces = {}
    for row in made:
        ids, positions = np.frombuffer(row.ids, "<u4"), np.frombuffer(row.positions, "<u4")
        assert len(ids) == len(positions) == 32 and row.cu_seqlens[-1] == row.n_tokens <= 32
        assert all(ids[row.n_tokens :] == 50256)
        for k, doc in enumerate(row.doc_ids):
            a, b = row.cu_seqlens[k], row.cu_seqlens[k + 1]
            assert positions[a:b].tolist() == list(range(b - a))
            pieces.setdefault(doc, {})[row.offsets[k]] = ids[a:b].tolist()
    for n, text in enumerate(texts):
        got = [i for at in sorted(pieces.get(n, {})) for i in pieces[n][at]]
        assert got == coder.encode([text or ""])[0]


def test_odd_rows(spark, nasty, empty):
    rows = packing.pack(nasty, RANKS).collect()
    assert {i for r in rows for i in r.doc_ids} >= {4, 5, 6, 7, None}
    assert packing.pack(empty, RANKS).count() == 0
