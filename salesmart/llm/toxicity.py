"""Toxicity: a linear-chain conditional random field tags words, documents get scores."""

from __future__ import annotations

import heapq
import itertools
import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.tasks import held, share

# Labelled documents of each label that the model is fitted to, at most; those
# with the smallest hashes of their ids, whole texts.
SAMPLE = 1200
# Words of a chain; longer texts are several chains.
CHAIN = 64
PREFIXES = (3, 4, 5)
ROUNDS = 60
# A word or beginning marks toxic words where it explains so many toxic sample
# documents and there is at most one clean one to so many toxic ones.
SUPPORT, PURITY = 3, 20
PART = 500
# Words of sample documents that pass through the field at a time.
BLOCK = 100_000

_WORD = re.compile(r"\w+")


def lowered(text: str) -> str:
    """Small letters, place by place: every character keeps its offset."""
    low = text.lower()
    if len(low) == len(text):
        return low
    return "".join(x if len(x) == 1 else c for c, x in ((c, c.lower()) for c in text))


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(lowered(text or ""))


def features(word: str) -> list[str]:
    """A word and its beginnings, as texts that tell them apart."""
    return [word, *(f"{word[:n]}-{n}" for n in PREFIXES if len(word) >= n)]


def chains(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of documents go: their step in a chain and their chain."""
    total = int(lengths.sum())
    starts = np.cumsum(lengths) - lengths
    within = np.arange(total) - np.repeat(starts, lengths)
    per = -(-lengths // CHAIN)
    first = np.cumsum(per) - per
    return within % CHAIN, np.repeat(first, lengths) + within // CHAIN


class Chain:
    """Two states in a row: transition weights, and a weight per feature for state 1."""

    def __init__(self):
        self.step = np.zeros((2, 2))
        self.start = 0.0
        self.bias = 0.0
        self.weight: dict[str, float] = {}
        # Weights of largest marginal, expected toxic words and length; then the bias.
        self.document = np.zeros(4)

    def marginals(self, lift: np.ndarray, lengths: np.ndarray, pairs: bool = False):
        """P(state 1) of each word by forward and backward passes over all chains.

        Messages are kept as the odds of state 1 to 0. With ``pairs`` also the
        expected number of each transition, and P(state 1) of the first words.
        """
        step, chain = chains(lengths)
        n = int(chain[-1]) + 1 if len(chain) else 0
        e = np.zeros((CHAIN, n))
        there = np.zeros((CHAIN, n), bool)
        e[step, chain] = np.exp(np.clip(lift + self.bias, -30, 30))
        there[step, chain] = True
        (a00, a01), (a10, a11) = np.exp(self.step)
        forward = np.empty((CHAIN, n))
        backward = np.ones((CHAIN, n))
        forward[0] = e[0] * np.exp(self.start)
        for t in range(1, CHAIN):
            r = forward[t - 1]
            forward[t] = e[t] * (a01 + r * a11) / (a00 + r * a10)
        for t in range(CHAIN - 2, -1, -1):
            x = e[t + 1] * backward[t + 1]
            backward[t] = np.where(there[t + 1], (a10 + a11 * x) / (a00 + a01 * x), 1.0)
        odds = forward * backward
        p = odds / (1 + odds)
        if not pairs:
            return p[step, chain]
        r, x = forward[:-1], e[1:] * backward[1:]
        cells = np.stack([np.full_like(r, a00), a01 * x, a10 * r, a11 * r * x])
        cells /= cells.sum(axis=0)
        counts = (cells * there[1:]).sum(axis=(1, 2)).reshape(2, 2)
        return p[step, chain], counts, p[0]

    def lifts(self, words: Iterable[str]) -> list[float]:
        """The weight of each word's features together; unknown ones have none."""
        get = self.weight.get
        p3, p4, p5 = (f"-{n}" for n in PREFIXES)
        return [
            get(w, 0.0) + get(w[:3] + p3, 0.0) + get(w[:4] + p4, 0.0) + get(w[:5] + p5, 0.0)
            for w in words
        ]

    def documents(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """What a document score looks at, from the marginals of its words."""
        most, expected = np.zeros(len(lengths)), np.zeros(len(lengths))
        some = np.flatnonzero(lengths)
        if len(some):
            at = (np.cumsum(lengths) - lengths)[some]
            most[some], expected[some] = np.maximum.reduceat(p, at), np.add.reduceat(p, at)
        return np.stack([most, np.log1p(expected), np.log1p(lengths) / 10, np.ones(len(most))], 1)

    def score(self, seen: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(seen @ self.document, -30, 30)))


def _number(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature)


def kinds(words: Iterable[str]) -> np.ndarray:
    """The distinct features of a document as 64-bit numbers: far smaller than texts."""
    found = {_number(f) for word in set(words) for f in features(word)}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def marks(seen: list[np.ndarray], toxic: np.ndarray) -> set[int]:
    """Features that explain toxic documents: a greedy cover by all but pure ones.

    ``seen`` holds the features of each document. The feature in most of the
    toxic documents not yet explained comes next, so words that toxic documents
    share by chance, or as copies of each other, are not taken where a common
    mark explains them already.
    """
    bad = [k for k, label in enumerate(toxic) if label]
    empty = np.zeros(0, np.uint64)
    found, n = np.unique(np.concatenate([empty, *(seen[k] for k in bad)]), return_counts=True)
    found, n = found[n >= SUPPORT], n[n >= SUPPORT]
    good = np.zeros(len(found), np.int64)
    for x, label in zip(seen, toxic, strict=True):
        if not label:
            good += np.isin(found, x, assume_unique=True)
    found, n = found[good * PURITY <= n], n[good * PURITY <= n]
    where: dict[int, list[int]] = {int(f): [] for f in found}
    for k in bad:
        for f in found[np.isin(found, seen[k], assume_unique=True)].tolist():
            where[f].append(k)
    waiting = [(-size, f) for f, size in zip(found.tolist(), n.tolist(), strict=True)]
    heapq.heapify(waiting)
    explained: set[int] = set()
    taken = set()
    while waiting:
        _, feature = heapq.heappop(waiting)
        gain = len(set(where[feature]) - explained)
        if gain < SUPPORT:
            continue
        if waiting and -gain > waiting[0][0]:
            heapq.heappush(waiting, (-gain, feature))
            continue
        taken.add(feature)
        explained.update(where[feature])
    return taken


def fit(texts: list[str | None], toxic: list[int], weights: tuple[float, float]) -> Chain:
    """The field by gradient steps on the likelihood of the labelled words, then
    the document score by logistic regression. ``weights``: what a clean and a
    toxic sample document stand for. Without toxic documents all scores are 0."""
    model = Chain()
    label = np.asarray(toxic, float)
    if not label.sum():
        model.document = np.array([0, 0, 0, -30.0])
        return model
    # Words as numbers from here on, so that only distinct ones are held as texts.
    vocabulary: dict[str, int] = {}
    lengths, places, seen_in = [], array("q"), []
    for text in texts:
        words = words_of(text)
        lengths.append(len(words))
        places.extend([vocabulary.setdefault(w, len(vocabulary)) for w in words])
        seen_in.append(kinds(words))
    lengths, places = np.array(lengths, np.int64), np.array(places, np.int64)
    # Labelled words: in toxic documents, those with a mark.
    found = marks(seen_in, label)
    marked = np.array([any(_number(f) in found for f in features(w)) for w in vocabulary], float)
    y = np.repeat(label, lengths) * marked[places]
    # A feature of one document only teaches nothing about others.
    common, n = np.unique(np.concatenate(seen_in), return_counts=True)
    common = set(common[n > 1].tolist())
    del seen_in
    number: dict[str, int] = {}
    # Feature ids of each distinct word.
    owner, ids = array("q"), array("q")
    for word, k in vocabulary.items():
        for feature in features(word):
            if _number(feature) in common:
                owner.append(k)
                ids.append(number.setdefault(feature, len(number)))
    owner, ids = np.array(owner, np.int64), np.array(ids, np.int64)
    step, chain = chains(lengths)
    first = step == 0
    seen = np.zeros((CHAIN, int(chain[-1]) + 1 if len(chain) else 0), np.int64) - 1
    seen[step, chain] = y
    a, b = seen[:-1][seen[1:] >= 0], seen[1:][seen[1:] >= 0]
    observed = np.bincount(2 * a + b, minlength=4).reshape(2, 2)
    w, slow = np.zeros(len(number)), np.ones(len(number))
    rest, rest_slow = np.zeros(6), np.ones(6)
    rest[4] = -3.0
    # Documents go through the passes some at a time: their arrays are many.
    ends = np.cumsum(lengths)
    inner = np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK))
    cuts = np.unique(np.concatenate(([0], inner, [len(ends)])))
    blocks = [
        (slice(a, b), slice(int(ends[a] - lengths[a]), int(ends[b - 1])))
        for a, b in itertools.pairwise(cuts.tolist())
    ]
    p = np.zeros(len(y))
    for _ in range(ROUNDS):
        model.step, model.bias, model.start = rest[:4].reshape(2, 2), rest[4], rest[5]
        by_word = np.bincount(owner, w[ids], len(vocabulary))
        counts, firsts = np.zeros((2, 2)), 0.0
        for docs, at in blocks:
            p[at], some, p_first = model.marginals(by_word[places[at]], lengths[docs], pairs=True)
            counts += some
            firsts += p_first.sum()
        off = np.bincount(places, y - p, len(vocabulary))
        grad = np.bincount(ids, off[owner], len(number)) - 0.05 * w
        slow += grad**2
        w += 0.5 * grad / np.sqrt(slow)
        more = [*(observed - counts).ravel(), (y - p).sum(), y[first].sum() - firsts]
        more = np.array(more) - 0.05 * rest
        rest_slow += more**2
        rest += 0.3 * more / np.sqrt(rest_slow)
    model.step, model.bias, model.start = rest[:4].reshape(2, 2), float(rest[4]), float(rest[5])
    model.weight = {f: float(w[n]) for f, n in number.items() if abs(w[n]) > 0.05}
    by_word = np.array(model.lifts(vocabulary))
    for docs, at in blocks:
        p[at] = model.marginals(by_word[places[at]], lengths[docs])
    inputs = model.documents(p, lengths)
    each = np.where(label > 0, float(weights[1]), float(weights[0]))
    each /= each.mean()
    theta = np.zeros(4)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(inputs @ theta, -30, 30)))
        curve = (inputs * (each * p * (1 - p))[:, None]).T @ inputs + 0.1 * np.eye(4)
        theta += np.linalg.solve(curve, inputs.T @ (each * (label - p)) - 0.1 * theta)
    model.document = theta
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents never learned from: crc32 of the id as text is a multiple of 5."""
    return F.coalesce(F.expr(f"crc32(cast({doc_id} AS string)) % 5 = 0"), F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """The model from at most ``sample`` labelled documents of each label.

    Labels that are null, of no document or held out teach nothing; of repeated
    labels and documents one is taken. The sample's ids, bounded by the
    parameter, are broadcast; its texts are collected.
    """
    known = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out())
    known = known.select("doc_id", "toxic")
    chosen, shares = None, []
    for value in (0, 1):
        of = known.filter(F.col("toxic") == value)
        shares.append(of.count())
        # Of many labels only those of small hashes are sorted, four times as many as needed.
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
        near = of.filter(place < math.ceil(4 * sample / max(1, shares[-1]) * (1 << 40)))
        some = near.dropDuplicates(["doc_id"]).orderBy(place, "doc_id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda row: row.doc_id)
    taken = Counter(row.toxic for row in rows)
    weights = tuple(shares[v] / max(1, taken[v]) for v in (0, 1))
    return fit([row.text for row in rows], [row.toxic for row in rows], weights)


SCORED = "score double, spans array<struct<start:int, end:int, p:double>>"


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """``docs`` with ``score``, from 0 to 1, and the ``spans`` of toxic words.

    Spans are code-point offsets, end exclusive, of words with a marginal of 0.5
    or more. Null and empty texts have no word and get the score of an empty
    document. Every word of a text counts; only the text is looked at. Columns
    of ``docs`` called as the new ones are replaced.
    """
    shared = share(docs.sparkSession, model)
    rows = docs.drop("score", "spans")
    place = rows.columns.index("text")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = held(shared)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for whole in batches:
            for at in range(0, whole.num_rows, PART):
                batch = whole.slice(at, PART)
                texts = [text.as_py() or "" for text in batch.column(place)]
                words = [words_of(text) for text in texts]
                lengths = np.array([len(w) for w in words], np.int64)
                lift = np.array([x for ws in words for x in chain.lifts(ws)])
                p = chain.marginals(lift, lengths)
                scores = chain.score(chain.documents(p, lengths))
                spans, start = [], 0
                for text, n in zip(texts, lengths.tolist(), strict=True):
                    hits = np.flatnonzero(p[start : start + n] >= 0.5)
                    found = list(_WORD.finditer(lowered(text))) if len(hits) else []
                    spans.append([
                        {"start": found[k].start(), "end": found[k].end(), "p": float(p[start + k])}
                        for k in hits.tolist()
                    ])
                    start += n
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                columns |= {"score": pa.array(scores, pa.float64()), "spans": pa.array(spans, kind)}
                yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(step, f"{fields}, {SCORED}")


def drop_toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Documents with a score below ``limit``, unchanged and in the same columns."""
    model = train(docs, labels)
    names = docs.columns
    inner = docs.toDF(*[name if name == "text" else f"_c{n}" for n, name in enumerate(names)])
    kept = score(inner, model).filter(F.col("score") < limit)
    return kept.drop("score", "spans").toDF(*names)
