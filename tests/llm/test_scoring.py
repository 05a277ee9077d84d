import random

import numpy as np
import pytest

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import scoring as s


@pytest.fixture
def small(monkeypatch):
    for name, value in {"SHARED": 8, "CLASSES": 4, "LESSON": 64, "COUNTED": 5, "FAN": 2}.items():
        monkeypatch.setattr(s, name, value)


def texts_of(n, seed):
    """Words that follow each other in a ring, from a random place."""
    random.seed(seed)
    ring = ["red", "green", "blue", "white", "black", "grey"]
    made = []
    for _ in range(n):
        at = random.randrange(6)
        made.append(" ".join(ring[(at + k) % 6] for k in range(random.randint(1, 40))))
    return made


def test_counts_cover_all_words(spark, documents, small):
    texts = [*texts_of(30, 1), None, "", "Über x1,x2 ÜBER"]
    got = {bytes(r.word).decode(): r.n for r in s.count_words(documents(texts)).collect()}
    want = {}
    for text in texts:
        for word in s.plain(text).split():
            want[word.decode()] = want.get(word.decode(), 0) + 1
    assert got == want


def test_the_most_frequent_words(spark):
    rows = [(f"w{n}".encode(), 1 + n * n % 37) for n in range(80)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for size in (1, 5, 79, 80, 200):
        some = s._frequent(counts, size)
        got = [r.n for r in some.orderBy(s.F.desc("n")).limit(size).collect()]
        assert got == sorted((n for _, n in rows), reverse=True)[:size]


def test_probabilities_add_up(spark, documents, small):
    docs = documents([*texts_of(30, 1), "seldom rare words"])
    words = s.vocabulary(docs, words=4)
    inside = np.bincount(words.classes, np.exp(words.within), 4)
    # Shared places hold several words: their mass is that of one word times their number.
    assert np.all(inside <= 1 + 1e-9)
    net = s.train(docs, words)
    _, _, z = net.forward(np.random.default_rng(0).integers(0, words.size + 1, (10, 4)))
    assert np.allclose(np.exp(z).sum(axis=1), 1, atol=1e-5)


def test_scores_against_a_loop(spark, documents, small):
    texts = [*texts_of(20, 2), None, "!!!"]
    docs = documents(texts)
    words = s.vocabulary(docs, words=4)
    net = s.Network(words.size, seed=1)
    rows = {r.doc_id: r for r in s.score(docs, words, net).collect()}
    for n, text in enumerate(texts):
        places = words.places(s.plain(text).split())
        padded = [words.size] * 2 + list(places) + [words.size] * 2
        total = 0.0
        for k, place in enumerate(places):
            x = np.concatenate([net.embed[padded[k + 2 + side]] for side in s.SIDES])
            z = np.tanh(x @ net.mix + net.hidden_bias) @ net.out + net.bias
            c = words.classes[place]
            total += z[c] - np.log(np.exp(z).sum()) + words.within[place]
        assert rows[n].n_words == len(places) and abs(rows[n].log_prob - total) < 1e-3
        assert (rows[n].mean_log_prob is None) == (not len(places))


def test_gradient_step(small):
    net = s.Network(10, seed=2)
    rng = np.random.default_rng(3)
    around, target = rng.integers(0, 11, (64, 4)), rng.integers(0, 4, 64)
    before = net.forward(around)[2][np.arange(64), target].mean()
    for _ in range(20):
        net.learn(around, target)
    assert net.forward(around)[2][np.arange(64), target].mean() > before + 0.05


def test_a_lesson_is_the_gradient(small):
    """Of both losses, by differences; windows at the ends of a document included."""
    rng = np.random.default_rng(4)
    classes = np.sort(rng.integers(0, 4, 14))
    mass = rng.integers(1, 9, 14).astype(float)
    within = np.log(mass / np.bincount(classes, mass, 4)[classes])
    known = s.Vocabulary({b"%d" % n: n for n in range(6)}, classes, within, mass, np.ones(14, int), "")
    row, at, _ = s.padded([rng.integers(0, 14, 9).tolist(), [], rng.integers(0, 14, 5).tolist()], 14)
    places = row[at]
    net = s.Network(14, seed=5)
    net.inner += rng.normal(0, 0.3, net.inner.shape).astype(np.float32)

    def loss():
        _, h = net.hidden(row, at)
        return -(net.class_log_probs(h, known.classes[places]) + net.within(h, places, known)).sum()

    for name, scale in (("out", 5), ("bias", 5), ("mix", 5), ("hidden_bias", 5), ("embed", 20)):
        values = getattr(net, name)
        before = {key: getattr(net, key).copy() for key in (*net.NAMES, "moved")}
        net.lesson(row, at, known.classes[places], places, known, step=1.0)
        gradient = (before[name] - values) * len(at) / scale / np.sqrt(len(at) / s.WHOLE)
        for key, old in before.items():
            getattr(net, key)[...] = old
        for k in rng.choice(values.size, min(6, values.size), replace=False):
            flat, small_step = values.reshape(-1), 1e-2
            flat[k] += small_step
            up = loss()
            flat[k] -= 2 * small_step
            slope = (up - loss()) / (2 * small_step)
            flat[k] += small_step
            assert abs(gradient.reshape(-1)[k] - slope) < 2e-2 * max(1, abs(slope)), name


def test_windows_of_a_row(small):
    """What shifted rows give is what windows give."""
    texts = [[1, 2, 3, 4, 5], [], [6], [7, 8, 9] * 5]
    net = s.Network(10, seed=2)
    _, around, _ = s.windows(texts, 10)
    row, at, _ = s.padded(texts, 10)
    whole = net.hidden(row, at)[1]
    assert np.allclose(whole, net.hidden(*s.apart(around))[1], atol=1e-6)
    x = net.embed[around].reshape(len(around), -1)
    assert np.allclose(whole, np.tanh(x @ net.mix + net.hidden_bias), atol=1e-6)
    parts = [net.hidden(part, here)[1] for _, part, here in s.lots(row, at, 4)]
    assert np.allclose(np.concatenate(parts), whole, atol=1e-6)


def test_order_matters_after_training(spark, documents, small):
    """Held-out texts in order score above the same words shuffled."""
    docs = documents(texts_of(3000, 4))
    words = s.vocabulary(docs, words=6)
    net = s.train(docs.repartition(3), words)
    plain = [words.places(s.plain(t).split()) for t in texts_of(100, 5)]
    mixed = [random.sample(list(p), len(p)) for p in plain]
    assert s.log_probs(plain, words, net)[0].mean() > s.log_probs(mixed, words, net)[0].mean() + 0.1


def test_every_word_has_its_own_count(spark, documents, small):
    """Words of one shared place score by their own counts; all of them add up to it."""
    times = {"common": 50, "rarer": 1, "raring": 23, "rarity": 6}
    docs = documents([word for word, n in times.items() for _ in range(n)])
    words = s.vocabulary(docs, words=1)
    assert len(set(words.places([b"rarer", b"raring", b"rarity"]).tolist())) == 1
    net = s.Network(words.size, seed=1)
    got = {r.doc_id: r.log_prob for r in s.score(documents([*times, "rarely"]), words, net).collect()}
    for k, n in enumerate([1, 23, 6, 0], 1):
        assert abs(got[k] - got[1] - np.log((n + 1 / 6) / (1 + 1 / 6))) < 1e-6
    place = s.log_probs([words.places([b"rarer"])], words, net)[0][0]
    assert abs(np.exp([got[k] for k in (1, 2, 3)]).sum() - np.exp(place)) < 1e-6


def test_context_separates_words_of_one_class(spark, documents, small, monkeypatch):
    """Exchanging a word for another of its class costs probability on held-out texts."""
    monkeypatch.setattr(s, "LESSON", 256)
    ring = [f"w{k}" for k in range(12)]

    def made(n, seed):
        random.seed(seed)
        starts = [random.randrange(12) for _ in range(n)]
        return [" ".join(ring[(at + k) % 12] for k in range(random.randint(10, 40))) for at in starts]

    docs = documents(made(3000, 6))
    words = s.vocabulary(docs, words=12)
    net = s.train(docs.repartition(3), words)
    assert max(np.bincount(words.classes[:12])) >= 3
    places = [words.places(s.plain(t).split()) for t in made(100, 7)]
    at, around, _ = s.windows(places, words.size)
    h = net.hidden(*s.apart(around))[1]
    assert net.within(h, at, words).mean() > words.within[at].mean() + 0.3
    true, other = [], []
    for k in range(0, len(at), 7):
        same = [x for x in range(12) if words.classes[x] == words.classes[at[k]] and x != at[k]]
        if same:
            true.append(net.within(h[k : k + 1], at[k : k + 1], words)[0])
            other.append(net.within(h[k : k + 1], np.array(same[:1]), words)[0])
    assert np.mean(true) > np.mean(other) + 0.5
    every = np.arange(words.size)
    total = np.bincount(words.classes, np.exp(net.within(np.repeat(h[:1], words.size, 0), every, words)))
    assert np.allclose(total[total > 0], 1, atol=1e-5)


def test_words_of_texts():
    """As by ``plain`` and split, also of a part of a column, with nulls and without any word."""
    texts = ["x", None, "", "Über x1,x2 ÜBER", "  two  words ", "!!!", "no\tend", "\x00a\u00a0b\u2003c", "a"]
    for some in (texts, texts[1:3], ["a", "b b", "c"], [None], []):
        column = s.pa.array(["before", *some, "after"], s.pa.string()).slice(1, len(some))
        words, codes, lengths = s.words_of(column)
        want = [s.plain(text).split() for text in some]
        assert [words[k].as_py() for k in codes.tolist()] == [word for text in want for word in text]
        assert lengths.tolist() == [len(text) for text in want]
        assert len(set(words.to_pylist())) == len(words)


def classes_of_places(monkeypatch, sizes, seed):
    rng = np.random.default_rng(seed)
    classes = np.repeat(np.arange(len(sizes)), sizes)
    monkeypatch.setattr(s, "SHARED", len(classes))
    mass = rng.integers(1, 9, len(classes)).astype(float)
    within = np.log(mass / np.bincount(classes, mass)[classes])
    return s.Vocabulary({}, classes, within, mass, np.ones(len(classes), int), ""), rng


def test_places_within_classes(monkeypatch):
    """Against a softmax in double precision: classes of one place, of many, cut by
    the room, and products whose exponentials would be too large or too small."""
    known, rng = classes_of_places(monkeypatch, [1, 5, 1, 40, 2, *[3] * (s.CLASSES - 5)], 8)
    net = s.Network(known.size, seed=9)
    h = np.tanh(rng.normal(0, 1, (700, s.WIDTH))).astype(np.float32)
    places = rng.integers(0, known.size, 700)
    net.inner = rng.normal(0, 0.3, net.inner.shape).astype(np.float32)
    z = h.astype(float) @ net.inner.T.astype(float) + known.prior
    z = np.where(known.classes[:, None] == known.classes[places], z.T, -np.inf)
    want = z[places, np.arange(700)] - np.log(np.exp(z).sum(axis=0))
    for moved in (0, 200, -400):
        # The same for all places of a class: no probability changes.
        known.prior = known.prior + np.where(known.classes % 2, moved, 0).astype(np.float32)
        for room in (1, 50, 1 << 17):
            monkeypatch.setattr(s, "ROOM", room)
            assert np.allclose(net.within(h, places, known), want, atol=1e-3)


def test_many_classes_are_weighed_at_a_time(monkeypatch):
    """Steps follow the words and their places, not the number of classes."""
    known, rng = classes_of_places(monkeypatch, [4] * s.CLASSES, 10)
    net, steps, old = s.Network(known.size, seed=11), [], s._exponentials
    monkeypatch.setattr(s, "_exponentials", lambda *a: steps.append(a) or old(*a))
    h = np.tanh(rng.normal(0, 1, (1000, s.WIDTH))).astype(np.float32)
    net.within(h, rng.integers(0, known.size, 1000), known)
    assert len(steps) <= 2


def test_odd_rows(nasty, empty, small):
    assert s.score_corpus(nasty).count() == nasty.count()
    assert s.score_corpus(empty).count() == 0
