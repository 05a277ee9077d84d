import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import filter_audit as fa
from salesmart.llm.filter_audit import audit, letters_of, packed, row_counts, rows_of, term_matrix, unpacked

DOCS = "doc_id long, text string, source string, key string, n long, row string, part string"
LABELS = "doc_id long, quality int, toxic int, source string"


def flags(docs):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    for i, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        yield "".join(letter for letter, fails in zip("ABCDE", (
            len(words) < 200, 100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text)),
            i is not None and i > least[text],
        )) if fails)


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = [(i, source or "", set(f)) for (i, _, source), f in zip(docs, flags(docs), strict=True)]
    made = {}
    for part in {p for _, p, _ in rows}:
        mine = [(i, f) for i, p, f in rows if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, letter in enumerate(order):
                left = [(i, f) for i, f in mine if not f & set(order[:k])]
                gone = [i for i, f in left if letter in f]
                total[letter] += len(gone)
                made[part, order, k + 1] = [
                    len(left) - len(gone), len(gone), sum(letter in f for _, f in mine) - len(gone),
                    sum(f == {letter} for _, f in mine), sum(i in good for i in gone), sum(i in toxic for i in gone),
                ]
        for (p, order, step), row in made.items():
            if p == part:
                row.append(total[order[step - 1]])
    return made


def check(spark, docs, labels):
    made = audit(
        spark.createDataFrame([(*d, "k", 1, "r", "p") for d in docs], DOCS),
        spark.createDataFrame([(*x, "s") for x in labels], LABELS),
    )
    kinds = {f.name: f.dataType.simpleString() for f in made.schema}
    assert kinds == {"part": "string", "filter_order": "string", "step": "int"} | dict.fromkeys(
        ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"], "bigint"
    )
    got = {(r.part, r.filter_order, r.step): list(r[3:]) for r in made.collect()}
    assert got == brute(docs, labels)
    return got


def some(n, seed=1):
    draw = random.Random(seed)
    for i in range(n):
        words = [draw.choice(["a", "Bee", "cé", "d$", " x", "\x1fy"]) + str(draw.randint(0, 150)) for _ in range(draw.randint(0, 400))]
        text = draw.choice([" ", "\n", "\t\x0b "]).join(words)
        yield i, draw.choice([text, text.lower().replace("$", ""), "the same " * 150]), draw.choice(["web", "book", None])


def test_random_documents(spark):
    docs = list(some(80))
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 80, 2)]
    got = check(spark, docs, labels)
    assert len(got) == 3 * 120 * 5


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(fa, "SHARD_BYTES", 5000)
    monkeypatch.setattr(fa, "PIECE_BYTES", 700)
    monkeypatch.setattr(fa, "LISTED", 7)
    check(spark, list(some(30, 2)), [(1, 1, 1)])


def test_odd_rows(spark):
    """Nulls everywhere, repeated rows and ids, empty and very long texts, ties."""
    docs = [
        (None, None, None), (None, "", "s"), (5, "", "s"), (5, "", "s"), (5, "one two", "s"), (4, "one two", ""),
        (6, "word " * 60_000, "s"), (7, "X" * 300_000, "s"), (8, "\t\n ", None), (9, " lead and trail ", "s"),
        (9, None, "s"), (-1, "one two", "t"),
    ]
    labels = [(5, 1, None), (5, 0, 1), (None, 1, 1), (99, 1, 1), (4, None, None)]
    check(spark, docs, labels)


def test_no_documents_and_no_labels(spark):
    assert check(spark, [], [(1, 1, 1)]) == {}
    check(spark, [(1, "a", "s")], [])


def test_one_text_in_a_third_of_all_rows(spark):
    docs = [(i, "the same text", "s") for i in range(300)] + list(some(20, 3))
    check(spark, docs, [(i, 1, 0) for i in range(300)])


def test_matrix_holds_the_words(spark, documents):
    texts = ["b a b", "", None, "c c A a", "  a "]
    matrix, dictionary = term_matrix(documents(texts), ["doc_id", "key"])
    words = {r.id: r.word for r in dictionary.collect()}
    assert sorted(words) == list(range(4)) and set(words.values()) == {"a", "b", "A", "c c"}
    found = {}
    for r in matrix.collect():
        sizes, ids, times = (unpacked(x) for x in (r.sizes, r.indices, r.data))
        bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        for n, row in enumerate(r.rows):
            mine = ids[bounds[n] : bounds[n + 1]]
            assert list(mine) == sorted(set(mine))
            found[row.doc_id] = {words[i]: t for i, t in zip(mine, times[bounds[n] : bounds[n + 1]])}
    assert found == {0: {"a": 1, "b": 2}, 1: {}, 2: {}, 3: {"c c": 1, "A": 1, "a": 1}, 4: {"a": 1}}
    counts = {r.doc_id: (r.n_words, r.n_distinct) for r in row_counts(matrix).collect()}
    assert counts == {0: (3, 2), 1: (0, 0), 2: (0, 0), 3: (3, 3), 4: (1, 1)}


def test_words_are_split_at_ascii_white_space_only():
    text = "".join(f"{chr(c)}x" for c in [*range(1, 0x100), 0x1680, 0x2003, 0x3000])
    words, sizes, codes, times = rows_of(pa.array(["", text, " \t"]))
    want = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert sorted(words.to_pylist()) == sorted(set(want)) and times.sum() == len(want)
    assert list(sizes) == [0, len(set(want)), 0] and len(codes) == len(set(want))
    found = letters_of(pa.array(["x", "", text + "A#é日", "ZZ|"]).slice(1))
    assert found.tolist() == [[0, len(text) + 4, 3], [0, 27, 2], [0, 7, 1]]


def test_packed_numbers():
    for numbers in ([], [0, 1, 255], [256, 2], [0, 1, 255, 256, 2**31], [2**40, 3]):
        assert unpacked(packed(np.array(numbers, np.int64))).tolist() == numbers
