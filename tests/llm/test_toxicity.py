import itertools
import random

import numpy as np
import pytest

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import toxicity as t


def paths(model, lift):
    """P(state 1) and expected transitions by adding up all paths."""
    n = len(lift)
    total, ones, steps = 0.0, np.zeros(n), np.zeros((2, 2))
    for path in itertools.product((0, 1), repeat=n):
        score = model.start * path[0] + sum((x + model.bias) * s for x, s in zip(lift, path))
        score += sum(model.step[a, b] for a, b in itertools.pairwise(path))
        weight = np.exp(score)
        total += weight
        ones += weight * np.array(path)
        for a, b in itertools.pairwise(path):
            steps[a, b] += weight
    return ones / total, steps / total


def test_marginals_against_all_paths(monkeypatch):
    monkeypatch.setattr(t, "CHAIN", 5)
    rng = np.random.default_rng(0)
    model = t.Chain()
    model.step, model.bias, model.start = rng.normal(size=(2, 2)), 0.3, -0.4
    lengths = np.array([4, 0, 1, 12, 5])
    lift = rng.normal(size=lengths.sum())
    p, counts, first = model.marginals(lift, lengths, pairs=True)
    want, steps, at = [], np.zeros((2, 2)), 0
    for n in lengths:
        for start in range(0, n, 5):
            ones, more = paths(model, lift[at + start : at + min(n, start + 5)])
            want += list(ones)
            steps += more
        at += n
    assert np.allclose(p, want) and np.allclose(counts, steps)
    assert np.allclose(model.marginals(np.zeros(0), np.zeros(2, np.int64)), [])


@pytest.fixture(scope="module")
def corpus():
    random.seed(4)
    plain = [f"{a}{b}" for a in "bcdfgh" for b in ("ado", "ine", "ull", "eth", "oral")]
    texts, toxic = [], []
    for n in range(300):
        words = random.choices(plain, k=random.randint(5, 150))
        bad = n % 3 == 0
        for _ in range(random.randint(1, 4) if bad else 0):
            words.insert(random.randrange(len(words)), random.choice(["Nasty", "vilest", "vilexyz", "vileab"]))
        texts.append(" ".join(words) + ".")
        toxic.append(int(bad))
    return texts, toxic


def test_held_out_accuracy_and_offsets(spark, documents, corpus):
    texts, toxic = corpus
    docs = documents(texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    model = t.train(docs, labels)
    rows = t.score(docs, model).withColumn("out", t.held_out()).collect()
    out = [r for r in rows if r.out]
    assert 30 < len(out) < 100
    assert np.mean([(r.score >= 0.5) == bool(toxic[r.doc_id]) for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        for x in r.spans:
            assert texts[r.doc_id][x.start : x.end].lower().startswith(("nasty", "vile"))
    kept = {r.doc_id for r in t.drop_toxic(docs, labels).collect()}
    assert np.mean([(n in kept) != bool(y) for n, y in enumerate(toxic)]) > 0.97
    assert t.drop_toxic(docs, labels).columns == docs.columns


def test_labels_of_held_out_documents_teach_nothing(spark, documents, corpus):
    texts, toxic = corpus
    docs = documents(texts)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    turned = labels.withColumn("toxic", t.F.when(t.held_out(), 1 - t.F.col("toxic")).otherwise(t.F.col("toxic")))
    one, other = t.train(docs, labels), t.train(docs, turned)
    assert np.array_equal(one.document, other.document) and one.weight == other.weight


def test_lowering_keeps_offsets():
    for text in ("İstanbul ABC", "ΑΣ", "ǅ ﬀ", ""):
        assert len(t.lowered(text)) == len(text)


def test_odd_rows(spark, nasty, empty, documents, corpus):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (None, 1), (2, None), (3, 7), (999, 1), (4, 0)], "doc_id long, toxic int"
    )
    for known in (labels, labels.limit(0)):
        model = t.train(nasty, known)
        rows = t.score(nasty, model).collect()
        assert len(rows) == nasty.count() and all(r.score is not None for r in rows)
        assert t.score(empty, model).count() == 0
    assert t.train(empty, labels).weight == {}
    texts, toxic = corpus
    model = t.fit(texts, toxic, (1.0, 1.0))
    rows = t.score(nasty, model).collect()
    assert len({r.score for r in rows if r.text in (None, "", " ")}) == 1
