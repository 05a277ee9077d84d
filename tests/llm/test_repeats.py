import random

import numpy as np
import pytest

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import repeats


def brute(texts, span):
    seen = {}
    for raw in texts:
        for i in range(len(raw) - span + 1):
            seen[raw[i : i + span]] = seen.get(raw[i : i + span], 0) + 1
    made = []
    for raw in texts:
        starts = [i for i in range(len(raw) - span + 1) if seen[raw[i : i + span]] > 1]
        made.append(repeats._merged([(i, i + span) for i in starts]))
    return made


def test_suffix_array_and_common_prefixes():
    random.seed(0)
    for _ in range(800):
        letters = random.choice([b"a", b"ab", b"abc", bytes(range(256))])
        text = bytes(random.choice(letters) for _ in range(random.randint(0, 60)))
        depth = random.randint(9, 70)
        order = repeats.suffix_array(text, depth)
        starts = [text[i : i + depth] for i in order]
        assert sorted(order.tolist()) == list(range(len(text))) and starts == sorted(starts)
        for k, n in enumerate(repeats.common_prefixes(text, order, depth).tolist()[1:], start=1):
            one, two = starts[k - 1], starts[k]
            assert one[:n] == two[:n] and (n == depth or one[: n + 1] != two[: n + 1])


def test_pieces_cover_every_span_once(monkeypatch):
    monkeypatch.setattr(repeats, "BLOB", 50)
    random.seed(1)
    texts = [bytes(random.choice(b"ab") for _ in range(random.randint(0, 120))) for _ in range(20)]
    text, start, end, group, _, at = repeats.pieces(texts, repeats.Hasher(), 12, 5)
    spans = sorted((t, k) for t, a, b in zip(text, start, end) for k in range(a, b - 11))
    assert spans == sorted((t, k) for t, raw in enumerate(texts) for k in range(len(raw) - 11))
    anchors = {}
    for t, g, a in zip(text, group, at):
        assert anchors.setdefault(g, texts[t][a : a + 5]) == texts[t][a : a + 5]


@pytest.mark.parametrize("group", [3000, 2])
def test_against_brute_force(spark, documents, group):
    """Also where crowded anchors are filed anew."""
    random.seed(group)

    def text(n):
        return "".join(random.choice("abcdeé \n") for _ in range(n))

    shared = [text(n) for n in (70, 60, 45, 39, 200)]
    texts = [None, "", "ab" * 100, "x" * 150, shared[4], shared[4]]
    for n in range(60):
        parts = [text(random.randint(0, 60)), random.choice(shared), text(random.randint(0, 30)),
                 random.choice(shared)[random.randint(0, 9):]]
        texts.append("".join(parts[: random.randint(1, 4)]))
    raw = [(t or "").encode() for t in texts]
    rows = repeats.remove(documents(texts), span=40, anchor=16, group=group).collect()
    want = brute(raw, 40)
    assert len(rows) == len(texts)
    for r in rows:
        assert [(x.start, x.end) for x in r.runs] == want[r.doc_id], r.doc_id
        kept, at = b"", 0
        for a, b in want[r.doc_id]:
            kept, at = kept + raw[r.doc_id][at:a], b
        assert bytes(r.kept) == kept + raw[r.doc_id][at:] and r.n_bytes == len(raw[r.doc_id])


def test_repeats_within_one_text_and_long_texts(spark, documents):
    rng = np.random.default_rng(0)
    long = bytes(rng.integers(97, 123, 600_000).astype(np.uint8)).decode()
    texts = [long, long[300_000:300_400], long[100:499] + "|", long[5_000:5_400] + long[5_000:5_400]]
    rows = {r.doc_id: [(x.start, x.end) for x in r.runs] for r in repeats.remove(documents(texts)).collect()}
    assert rows == {0: [(5_000, 5_400), (300_000, 300_400)], 1: [(0, 400)], 2: [], 3: [(0, 800)]}


def test_odd_rows(nasty, empty):
    rows = repeats.remove(nasty).collect()
    assert len(rows) == nasty.count()
    assert {(r.n_bytes, bytes(r.kept)) for r in rows if r.doc_id == 8} == {(200_000, b"")}
    assert repeats.remove(empty).count() == 0
