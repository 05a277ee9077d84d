import random

import pytest

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import decontamination as d


def brute(text, items, window=10):
    words = d.plain(text).split()
    hit, met = set(), set()
    for name, item in items:
        w = d.plain(item).split()
        if not w:
            continue
        n = min(len(w), window)
        grams = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        for k in range(len(words) - n + 1):
            if tuple(words[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                met.add(name)
    return len(words), hit, met


def test_automaton_against_brute_force():
    random.seed(5)
    for _ in range(300):
        def text(n):
            return " ".join(random.choice("abc") for _ in range(n))

        items = [(str(k), text(random.randint(0, 9))) for k in range(random.randint(0, 5))]
        doc = text(random.randint(0, 25))
        window = random.randint(1, 5)
        automaton = d.ItemAutomaton([(k, d.plain(t)) for k, t in items], window)
        runs, met, _ = automaton.follow(d.plain(doc).split())
        _, hit, names = brute(doc, items, window)
        assert {n for a, b in zip(runs[::2], runs[1::2]) for n in range(a, b)} == hit
        assert met == names


ITEM = "One two three four five six seven eight nine ten eleven"


@pytest.mark.parametrize("shard", [8 << 20, 30])
def test_marks(spark, documents, monkeypatch, shard):
    """Also where items need several automata."""
    monkeypatch.setattr(d, "SHARD_BYTES", shard)
    texts = [f"x {ITEM.upper()}! y", "tiny item here", "nothing", None, ITEM.replace("two", "2")]
    items = [(7, ITEM), (10, "Tiny, item"), (None, "nothing"), (3, None), (4, "...")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = d.mark(documents(texts), frame).orderBy("doc_id").collect()
    assert [r.n_words for r in rows] == [13, 3, 1, 0, 11]
    assert [list(r.runs) for r in rows] == [[1, 12], [0, 2], [0, 1], [], []]
    assert [list(r.item_ids) for r in rows] == [["7"], ["10"], [], [], []]
    assert rows[0].longest == 11


def test_spans_are_cut_out(spark, documents):
    filler = " ".join(["Ünd so"] * 20)
    texts = [f"{filler} {ITEM}, {filler}", ITEM, "clean text", None, ""]
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    docs = documents(texts)
    rows = {r.doc_id: r for r in d.decontaminate(docs, items).collect()}
    assert d.decontaminate(docs, items).columns == docs.columns
    assert rows[0].text == f"{filler} {filler}" and rows[0].n_chars == len(rows[0].text)
    assert 1 not in rows
    assert rows[2].text == "clean text" and rows[3].text is None and rows[4].text == ""


def test_odd_rows(spark, nasty, empty):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert d.mark(nasty, items).count() == nasty.count()
    assert d.decontaminate(nasty, items).count() == nasty.count()
    assert d.mark(empty, items).count() == 0
    assert d.mark(nasty, items.limit(0)).filter("size(runs) > 0").count() == 0
