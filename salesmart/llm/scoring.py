"""Language-model scores: masked pseudo-likelihood by a window network in numpy.

Every word is predicted from the words on both sides of it. The network gives
the probability of the word's class and that of its place within the class, both
by softmax from one hidden layer; words that share a place have their own counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.decontamination import plain
from salesmart.llm.tasks import held, share, small_batches
from salesmart.storage import stage

# The most frequent words have a place of their own, others share one by their
# beginning: sizes of the network, whatever the corpus. Counts are kept of all.
WORDS, SHARED, BEGINNING = 16_384, 1024, 3
# About as many classes as the square root of the places.
CLASSES, WIDTH = 128, 16
SIDES = (-2, -1, 1, 2)
PASSES = 2
# Gradient steps see so many words at a time, scores are computed for so many.
LESSON, LOT = 16_384, 32_768
# Exponentials that are made at a time, so that what is between stays in the cache.
ROOM = 1 << 17
# Sizes of steps: on the network, by so many words, and on places within classes.
WHOLE = 16_384
STEP, INNER = 1.2, 0.25
# Distinct words that a counting task keeps before it hands them on.
COUNTED = 200_000
PART = 500
# Models summed in one group, and the parts a model is sent in.
FAN, SLICES = 32, 16
TINY = np.finfo(np.float32).tiny
# What ``plain`` makes of each byte.
LETTERS = plain("".join(map(chr, range(128)))) + bytes(range(128, 256))


@dataclass
class Vocabulary:
    """Places of words, the class of each place, and log-probabilities within.

    ``within`` holds what the counts say, from which the network departs. In
    ``rank`` places are ordered by class; each class is a range of ``bounds``.
    ``mass`` and ``kinds`` are the occurrences and the distinct words of a place,
    ``counts`` is where the counts of all words are staged. Half an occurrence is
    added to each place: it is spread over its words.
    """

    words: dict[bytes, int]
    classes: np.ndarray
    within: np.ndarray
    mass: np.ndarray
    kinds: np.ndarray
    counts: str

    def __post_init__(self):
        order = np.argsort(self.classes, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.bounds = np.searchsorted(self.classes[order], np.arange(CLASSES + 1))
        self.prior = self.within[order].astype(np.float32)
        # Of each rank, the first one and the number of those of its class.
        sizes = np.diff(self.bounds)
        self.first, self.wide = np.repeat(self.bounds[:-1], sizes), np.repeat(sizes, sizes)

    def sorted(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the order of their ranks, and these. Short numbers are sorted
        by their digits, in a fraction of the time."""
        rank = self.rank[places]
        order = np.argsort(rank.astype(np.uint16 if self.size <= 1 << 16 else np.int64), kind="stable")
        return order, rank[order]

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places of words; those without one of their own share the ones after these."""
        made = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        shared = np.flatnonzero(made < 0)
        made[shared] = [zlib.crc32(words[n][:BEGINNING]) for n in shared.tolist()]
        made[shared] %= SHARED
        made[shared] += len(self.words)
        return made

    @property
    def size(self) -> int:
        return len(self.words) + SHARED


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of documents, the number among them of each word of all
    documents in a row, and how many words each document has."""
    texts = pc.fill_null(texts.cast(pa.binary()), b"")
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    raw = data[int(ends[0]) : int(ends[-1])].to_pybytes() if data else b""
    raw, ends = np.frombuffer(raw.translate(LETTERS), np.uint8), ends - ends[0]
    # A word begins where a text does or after a blank.
    letter = raw != ord(" ")
    begin = letter.copy()
    begin[1:] &= ~letter[:-1]
    firsts = ends[ends < len(raw)]
    begin[firsts] = letter[firsts]
    start = np.flatnonzero(begin)
    # Words are put together without the blanks.
    before = np.zeros(len(raw) + 1, np.int32)
    np.cumsum(letter, dtype=np.int32, out=before[1:])
    offsets = np.append(before[start], before[-1])
    words = pa.Array.from_buffers(
        pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[letter])]
    ).dictionary_encode()
    codes = np.asarray(words.indices).astype(np.int64)
    return words.dictionary, codes, np.diff(np.searchsorted(start, ends))


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` of the whole corpus: counted in each task, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
        seen = schema.empty_table()
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                words, codes, _ = words_of(batch.column(0).slice(start, PART))
                more = pa.table([words, pa.array(np.bincount(codes, minlength=len(words)))], schema)
                seen = pa.concat_tables([seen, more])
                if len(seen) >= COUNTED:
                    sums = seen.group_by("word", use_threads=False).aggregate([("n", "sum")])
                    seen = sums.select(["word", "n_sum"]).rename_columns(["word", "n"])
                if len(seen) >= COUNTED:
                    yield from seen.combine_chunks().to_batches()
                    seen = schema.empty_table()
        yield from seen.combine_chunks().to_batches()

    counted = docs.select(F.col("text").cast("string")).mapInArrow(count, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, words: int) -> DataFrame:
    """The words among which the most frequent ones are: those of at least the
    power of two that enough words reach. Without the rest, what tasks hand on
    does not grow with their number."""
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()
    reached = 0
    for row in sorted(sizes, key=lambda row: -row.power):
        reached += row["count"]
        if reached >= words:
            return counts.filter(F.col("n") >= 2**row.power)
    return counts


def vocabulary(docs: DataFrame, words: int = WORDS) -> Vocabulary:
    """From counts over all documents; what reaches the driver is of fixed size."""
    small_batches(docs.sparkSession)
    staged = stage(count_words(docs), "counts")
    counts = staged.rows
    top = _frequent(counts, words).orderBy(F.desc("n"), "word").limit(words).collect()
    shared = counts.groupBy(
        F.expr(f"crc32(substring(word, 1, {BEGINNING})) % {SHARED}").alias("place")
    ).agg(F.sum("n").alias("n"), F.count("*").alias("distinct")).collect()
    numbers = {bytes(row.word): k for k, row in enumerate(top)}
    mass = np.zeros(len(numbers) + SHARED)
    kinds = np.zeros(len(mass))
    for row in shared:
        mass[len(numbers) + row.place], kinds[len(numbers) + row.place] = row.n, row.distinct
    for row in top:
        place = len(numbers) + zlib.crc32(bytes(row.word)[:BEGINNING]) % SHARED
        mass[numbers[bytes(row.word)]] = row.n
        mass[place] -= row.n
        kinds[place] -= 1
    kinds[: len(numbers)] = 1
    mass += 0.5
    # Frequent words first, in classes of about equal sums of roots: that makes
    # the classes that words meet on average as small as their number allows.
    order = np.argsort(-mass, kind="stable")
    roots = np.sqrt(mass[order])
    classes = np.empty(len(mass), np.int64)
    classes[order] = np.minimum(
        (np.cumsum(roots) - roots / 2) / roots.sum() * CLASSES, CLASSES - 1
    ).astype(np.int64)
    total = np.bincount(classes, mass, CLASSES)
    within = np.log(mass / total[classes])
    return Vocabulary(numbers, classes, within, mass, np.maximum(kinds, 1).astype(np.int64), staged.path)


class Network:
    """Embeddings of the words around, one hidden layer, classes and places in them as output."""

    def __init__(self, places: int, seed: int = 0):
        draw = np.random.default_rng(seed)
        # One place more: beyond the ends of a document.
        self.embed = draw.normal(0, 0.1, (places + 1, WIDTH)).astype(np.float32)
        self.mix = draw.normal(0, 0.2, (len(SIDES) * WIDTH, WIDTH)).astype(np.float32)
        self.out = draw.normal(0, 0.2, (WIDTH, CLASSES)).astype(np.float32)
        self.hidden_bias = np.zeros(WIDTH, np.float32)
        self.bias = np.zeros(CLASSES, np.float32)
        # One row per place, by rank; at first, counts alone decide within a class.
        self.inner = np.zeros((places, WIDTH), np.float32)
        # Squares of the gradients on them so far; each task has its own.
        self.moved = np.full((places, WIDTH), 1e-2, np.float32)

    NAMES = ("embed", "mix", "out", "hidden_bias", "bias", "inner")

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, name).ravel() for name in self.NAMES])

    def load(self, values: np.ndarray) -> Network:
        at = 0
        for name in self.NAMES:
            old = getattr(self, name)
            setattr(self, name, values[at : at + old.size].reshape(old.shape).astype(np.float32))
            at += old.size
        return self

    def hidden(self, row: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of a row of places, and the hidden layer of the words at some
        positions of it, two places or more from its ends.

        The embedding of a place serves all words around it: the layer is a sum
        over shifted rows, without a copy of them for each word.
        """
        x = self.embed.take(row, axis=0)
        far, inner = max(SIDES), len(row) - 2 * max(SIDES)
        z = np.repeat(self.hidden_bias[None], inner, axis=0)
        for side, mix in zip(SIDES, self._mixes(), strict=True):
            z += x[far + side : far + side + inner] @ mix
        return x, np.tanh(z.take(at - far, axis=0))

    def _mixes(self) -> np.ndarray:
        """The part of the hidden layer's weights that belongs to each side."""
        return self.mix.reshape(len(SIDES), WIDTH, WIDTH)

    def forward(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs, hidden layer and log-probabilities of the classes, of windows."""
        x, h = self.hidden(*apart(around))
        z = h @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return x, h, z

    def _classes(self, h: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Words by blocks, with the exponentials and sums of the softmax over classes."""
        weights, more = np.concatenate([self.out, self.bias[None]]), _with_one(h)
        size = max(1, ROOM // CLASSES)
        room, ones = np.empty(size * CLASSES, np.float32), np.ones(CLASSES, np.float32)
        for at in range(0, len(h), size):
            block = slice(at, min(len(h), at + size))
            z = room[: (block.stop - at) * CLASSES].reshape(-1, CLASSES)
            yield block, z, _exponentials([(more[block], weights, z)], z, lambda z: z @ ones)

    def _places(self, h: np.ndarray, rank: np.ndarray, known: Vocabulary) -> Iterator[tuple]:
        """Words sorted by rank in blocks: the block, all exponentials of the softmax
        within their classes, their sums, where those of each word's own place are,
        and class by class its words, its places and its part of the exponentials."""
        weights, more = np.concatenate([self.inner, known.prior[:, None]], axis=1), _with_one(h)
        wide = known.wide[rank]
        ends = np.concatenate([[0], np.cumsum(wide)])
        # Blocks of equal work, cut again where the class changes.
        cuts = np.searchsorted(ends, np.arange(ROOM, ends[-1], ROOM))
        cuts = np.unique(np.concatenate([[0], cuts, [len(h)]]))
        edges = np.union1d(cuts, np.flatnonzero(np.diff(known.first[rank])) + 1)
        low = known.first[rank[edges[:-1]]]
        over = low + wide[edges[:-1]]
        parts = np.stack([edges[:-1], edges[1:], low, over, ends[edges[:-1]]], axis=1).tolist()
        own = ends[:-1] + rank - known.first[rank]
        groups = np.searchsorted(edges, cuts).tolist()
        room = np.empty(np.diff(ends[cuts]).max(initial=0), np.float32)
        for a, b, at, to in zip(cuts.tolist(), cuts[1:].tolist(), groups, groups[1:]):
            start = int(ends[a])
            flat, classes, products = room[: int(ends[b]) - start], [], []
            for first, last, under, over, place in parts[at:to]:
                z = flat[place - start :][: (last - first) * (over - under)].reshape(last - first, -1)
                classes.append((slice(first, last), slice(under, over), z))
                products.append((more[first:last], weights[under:over].T, z))
            rows = ends[a:b] - start
            total = _exponentials(products, flat, lambda flat, rows=rows: np.add.reduceat(flat, rows))
            yield slice(a, b), flat, total, own[a:b] - start, classes

    def class_log_probs(self, h: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Log-probability of each word's class."""
        made = np.empty(len(h))
        for block, z, total in self._classes(h):
            mine = z[np.arange(len(z)), classes[block]]
            made[block] = np.log(np.maximum(mine, TINY) / total)
        return made

    def within(self, h: np.ndarray, places: np.ndarray, known: Vocabulary) -> np.ndarray:
        """Log-probability of each place within its class."""
        order, rank = known.sorted(places)
        made, found = np.empty(len(places)), np.empty(len(places))
        for block, flat, total, own, _ in self._places(h.take(order, axis=0), rank, known):
            found[block] = np.log(np.maximum(flat[own], TINY) / total)
        made[order] = found
        return made

    def lesson(
        self, row: np.ndarray, at: np.ndarray, classes: np.ndarray,
        places: np.ndarray | None = None, known: Vocabulary | None = None, step: float = STEP,
    ) -> None:
        """One gradient step on the log-likelihood of the words at some positions:
        of their classes and, with places, of these within their classes. The
        gradient of a softmax is what it says less what was there.
        """
        x, h = self.hidden(row, at)
        n = len(at)
        if not n:
            return
        # Classes.
        dh, out, bias = np.empty_like(h), np.zeros((CLASSES, WIDTH), h.dtype), np.zeros(CLASSES, h.dtype)
        for block, z, total in self._classes(h):
            z[np.arange(len(z)), classes[block]] -= total
            share = 1 / total
            np.matmul(z, self.out.T, out=dh[block])
            dh[block] *= share[:, None]
            out += z.T @ (h[block] * share[:, None])
            bias += share @ z
        out = out.T
        # Places within them.
        if known is not None:
            order, rank = known.sorted(places)
            sorted_h, more, gradient = h.take(order, axis=0), np.empty_like(h), np.zeros_like(self.inner)
            for block, flat, total, own, parts in self._places(sorted_h, rank, known):
                flat[own] -= total
                share = (1 / total)[:, None]
                sorted_h[block] *= share
                for here, there, z in parts:
                    np.matmul(z, self.inner[there], out=more[here])
                    gradient[there] += z.T @ sorted_h[here]
                more[block] *= share
            back = np.empty_like(order)
            back[order] = np.arange(n)
            dh += more.take(back, axis=0)
            self.moved += gradient * gradient
            self.inner -= INNER * gradient / np.sqrt(self.moved)
        # The hidden layer and the embeddings around. Few words show a direction less
        # surely than a whole lesson does: the step is shorter.
        scale = step * np.sqrt(min(1, n / WHOLE)) / n
        self.out -= scale * 5 * out
        self.bias -= scale * 5 * bias
        far, inner = max(SIDES), len(row) - 2 * max(SIDES)
        dz = np.zeros((inner, WIDTH), np.float32)
        dz[at - far] = dh * (1 - h * h)
        dx, mixes = np.zeros_like(x), self._mixes()
        moves = np.empty_like(mixes)
        for k, side in enumerate(SIDES):
            shifted = slice(far + side, far + side + inner)
            moves[k] = x[shifted].T @ dz
            dx[shifted] += dz @ mixes[k].T
        self.mix -= scale * 5 * moves.reshape(self.mix.shape)
        self.hidden_bias -= scale * 5 * dz.sum(axis=0)
        # An embedding is touched by few words of a lesson, the rest by all.
        short = row.astype(np.uint16 if len(self.embed) <= 1 << 16 else np.int64)
        order = np.argsort(short, kind="stable")
        firsts, sums = _sums(row[order], dx.take(order, axis=0))
        self.embed[firsts] -= scale * 20 * sums

    def learn(self, around: np.ndarray, classes: np.ndarray, step: float = STEP) -> None:
        """A lesson on the classes of words in windows of their own."""
        self.lesson(*apart(around), classes, step=step)


def _with_one(h: np.ndarray) -> np.ndarray:
    """The hidden layer and a one, to which what does not depend on it is added."""
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)


def _exponentials(
    products: list[tuple], whole: np.ndarray, sums: Callable[[np.ndarray], np.ndarray]
) -> np.ndarray:
    """Fill a whole, the parts of which are softmaxes, by exponentials of products; the
    sum of each row. Logarithms are moved only where the exponentials of some would be
    too large or all of them too small."""
    for h, weights, z in products:
        np.matmul(h, weights, out=z)
    # What overflows is noticed and made anew.
    with np.errstate(over="ignore"):
        total = sums(np.exp(whole, out=whole))
    if not (TINY < total.min() and total.max() < np.inf):
        for h, weights, z in products:
            np.matmul(h, weights, out=z)
            z -= z.max(axis=1, keepdims=True)
        total = sums(np.exp(whole, out=whole))
    return total


def _sums(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted keys, and the sum of the rows of each."""
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(rows, starts) if len(starts) else rows[:0]


def apart(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as one row of places, each with room for its word, and those rooms."""
    far, wide = max(SIDES), 2 * max(SIDES) + 1
    row = np.zeros((len(around), wide), np.int64)
    row[:, far + np.array(SIDES)] = around
    return row.ravel(), np.arange(len(around)) * wide + far


def padded(texts: Sequence[Sequence[int]], outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``in_a_row`` of documents that come as lists of places."""
    places = np.array(list(chain.from_iterable(texts)), np.int64)
    return in_a_row(places, np.array([len(t) for t in texts], np.int64), outside)


def in_a_row(
    places: np.ndarray, lengths: np.ndarray, outside: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents as one row of places, ``outside`` between and around them; the
    positions of their words, and each one's document."""
    far = max(SIDES)
    row = np.full(len(places) + far * (len(lengths) + 1), outside, np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(doc)) + far * (doc + 1)
    row[at] = places
    return row, at, doc


def lots(row: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Words so many at a time: which, the part of the row around them, their positions in it."""
    far = max(SIDES)
    for start in range(0, len(at), size):
        part = at[start : start + size]
        low = part[0] - far
        yield slice(start, start + len(part)), row[low : part[-1] + far + 1], part - low


def windows(texts: list[list[int]], outside: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of documents, the words around each, and each one's document."""
    row, at, doc = padded(texts, outside)
    return row[at], row[at[:, None] + np.array(SIDES)], doc


def _average(trained: DataFrame) -> np.ndarray:
    """The mean of the tasks' networks, weighted by words, in groups of ``FAN``."""

    def add(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).to_pylist()[0]
        words = table.column("n").to_numpy().astype(np.float64)
        total = np.zeros(len(first["mean"]) // 4)
        for mean, n in zip(table.column("mean"), words, strict=True):
            total += np.frombuffer(mean.as_py(), np.float32) * n
        return pa.table({
            "slice": pa.array([first["slice"]], pa.int32()),
            "part": pa.array([first["part"] // FAN], pa.int32()),
            "mean": pa.array([(total / words.sum()).astype(np.float32).tobytes()], pa.binary()),
            "n": pa.array([int(words.sum())], pa.int64()),
        })

    rows = stage(trained, "networks").rows
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        rows = rows.groupBy("slice", F.expr(f"part div {FAN}").alias("group")).applyInArrow(
            add, "slice int, part int, mean binary, n long"
        )
        parts = -(-parts // FAN)
        if parts <= 1:
            break
        rows = stage(rows, "networks").rows
    made = sorted(rows.collect(), key=lambda row: row["slice"])
    return np.concatenate([*(np.frombuffer(row["mean"], np.float32) for row in made), np.zeros(0, np.float32)])


def train(docs: DataFrame, words: Vocabulary, passes: int = PASSES) -> Network:
    """The network after each document was learned from once.

    In each pass every task starts from the common network, takes gradient steps
    over its documents of that pass (by the hash of their text) and sends its
    network; their mean, by words, is the next common one. A network that no
    word reached is left as it was.
    """
    network = Network(words.size)
    spark = docs.sparkSession
    for k in range(passes):
        shared = share(spark, (words, network.flat()))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known, values = held(shared)
            own, n = Network(known.size).load(values), 0
            for whole in batches:
                for start in range(0, whole.num_rows, PART):
                    distinct, codes, lengths = words_of(whole.column(0).slice(start, PART))
                    place = known.places(distinct.to_numpy(zero_copy_only=False).tolist())[codes]
                    row, at, _ = in_a_row(place, lengths, known.size)
                    classes = known.classes[place]
                    for which, part, here in lots(row, at, LESSON):
                        own.lesson(part, here, classes[which], place[which], known)
                    n += len(at)
            if n:
                means = np.array_split(own.flat(), SLICES)
                yield pa.RecordBatch.from_pydict({
                    "slice": pa.array(range(SLICES), pa.int32()),
                    "part": pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()),
                    "mean": pa.array([x.tobytes() for x in means], pa.binary()),
                    "n": pa.array([n] * SLICES, pa.int64()),
                })

        rows = docs.select(F.col("text").cast("string").alias("text"))
        mine = rows.filter(F.expr(f"pmod(xxhash64(text), {passes}) = {k}"))
        mean = _average(mine.mapInArrow(learn, "slice int, part int, mean binary, n long"))
        if len(mean):
            network.load(mean)
    return network


def log_probs(
    texts: Sequence[Sequence[int]], words: Vocabulary, network: Network
) -> tuple[np.ndarray, np.ndarray]:
    """log P of each word's place given the words around it, and each one's document."""
    row, at, doc = padded(texts, words.size)
    return _log_probs(row, at, words, network), doc


def _log_probs(row: np.ndarray, at: np.ndarray, words: Vocabulary, network: Network) -> np.ndarray:
    places = row[at]
    made = np.empty(len(places))
    for which, part, here in lots(row, at, LOT):
        _, h = network.hidden(part, here)
        made[which] = network.class_log_probs(h, words.classes[places[which]])
        made[which] += network.within(h, places[which], words)
    return made


TAIL = pa.struct([("word", pa.binary()), ("times", pa.int32()), ("kinds", pa.int64())])


def _tails(
    words: pa.Array, places: np.ndarray, codes: np.ndarray, doc: np.ndarray, docs: int, known: Vocabulary
) -> pa.Array:
    """The distinct words of each document that share their place, and how often each occurs."""
    shared = places[codes] >= len(known.words)
    found, times = np.unique(doc[shared] << 32 | codes[shared], return_counts=True)
    which = found & 0xFFFFFFFF
    made = pa.StructArray.from_arrays([
        words.take(pa.array(which)), pa.array(times, pa.int32()),
        pa.array(known.kinds[places[which]], pa.int64()),
    ], fields=list(TAIL))
    ends = np.searchsorted(found >> 32, np.arange(docs + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), made)


def score(docs: DataFrame, words: Vocabulary, network: Network) -> DataFrame:
    """``doc_id, n_words, log_prob, mean_log_prob`` per document.

    ``log_prob`` is the pseudo-log-likelihood: the sum over all words of the
    whole text. Null and wordless texts have 0 words, 0 as sum and a null mean;
    repeated rows each have their row; other columns are not read. Tasks add up
    what the network says; words that share a place then meet their own counts
    in a join. None of them is frequent, so no key is crowded.
    """
    spark = docs.sparkSession
    shared = share(spark, (words, network))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, net = held(shared)
        # Rows are numbered within their task.
        first, key = len(known.words), TaskContext.get().partitionId() << 33
        for whole in batches:
            for start in range(0, whole.num_rows, PART):
                batch = whole.slice(start, PART)
                distinct, codes, lengths = words_of(batch.column(1))
                places, docs_ = known.places(distinct.to_numpy(zero_copy_only=False).tolist()), len(lengths)
                place = places[codes]
                row, at, doc = in_a_row(place, lengths, known.size)
                each = _log_probs(row, at, known, net)
                each -= np.where(place >= first, np.log(known.mass[place]), 0)
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(range(key, key + docs_), pa.int64()),
                    "doc_id": batch.column(0),
                    "n_words": pa.array(lengths, pa.int64()),
                    "log_prob": pa.array(np.bincount(doc, each, docs_), pa.float64()),
                    "tail": _tails(distinct, places, codes, doc, docs_, known),
                })
                key += docs_

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = stage(rows.mapInArrow(
        make, f"key long, doc_id {kind}, n_words long, log_prob double, "
        "tail array<struct<word: binary, times: int, kinds: long>>",
    ), "scored").rows
    counts = spark.read.schema("word binary, n long").parquet(words.counts)
    own = made.select("key", F.inline("tail")).join(counts, "word", "left").groupBy("key").agg(
        F.sum(F.expr("times * ln(coalesce(n, 0L) + 0.5D / kinds)")).alias("own")
    )
    done = made.drop("tail").join(own, "key", "left").select(
        "doc_id", "n_words", (F.col("log_prob") + F.coalesce("own", F.lit(0.0))).alias("log_prob")
    )
    return done.withColumn("mean_log_prob", F.try_divide("log_prob", "n_words"))


def score_corpus(docs: DataFrame) -> DataFrame:
    """Scores of documents by a model of these documents."""
    words = vocabulary(docs)
    return score(docs, words, train(docs, words))
