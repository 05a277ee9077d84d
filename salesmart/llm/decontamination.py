"""Benchmark decontamination: documents stream through a suffix automaton of items."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesmart.llm.tasks import held, share
from salesmart.storage import stage

WINDOW = 10
# Item text that one automaton takes; more items make more automata, one pass each.
SHARD_BYTES = 1 << 20

# ASCII capitals become small letters, other ASCII that is no digit or letter a blank.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)


def plain(text: str | None) -> bytes:
    """The words of a text with blanks between, as long as its UTF-8 bytes."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS)


class ItemAutomaton:
    """Generalised suffix automaton over the words of items, with their windows.

    A window is ``window`` consecutive words of an item; an item of fewer words,
    but not none, is one window. ``follow`` gives what a document contains.
    """

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW):
        self.window = window
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = []
        for name, words in items:
            ids = [self.number.setdefault(w, len(self.number)) for w in words.split()]
            if ids:
                texts.append((name, ids))
                last = 0
                for word in ids:
                    last = self._extend(last, word)
        # The state of the last ``window`` words, where a state holds longer strings.
        order = sorted(range(len(self.length)), key=self.length.__getitem__)
        self.whole = [-1] * len(order)
        for state in order[1:]:
            above = self.link[state]
            self.whole[state] = self.whole[above]
            if self.whole[above] < 0 and self.length[state] >= window:
                self.whole[state] = state
        self.items: dict[int, set] = {}
        short: dict[int, list] = {}
        self.shortest = window
        for name, ids in texts:
            state = 0
            for n, word in enumerate(ids, start=1):
                state = self.next[state][word]
                if n >= window:
                    self.items.setdefault(self.whole[state], set()).add(name)
            if len(ids) < window:
                short.setdefault(state, []).append((len(ids), name))
                self.shortest = min(self.shortest, len(ids))
        # Whole short items that end with a state's strings, on its links upwards.
        self.short: list[tuple] = [()] * len(order)
        for state in order[1:]:
            self.short[state] = self.short[self.link[state]] + tuple(short.get(state, ()))

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of a step, cut off where it also ends longer strings."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        made = self._state(self.length[last] + 1, 0, {})
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = made
            last = self.link[last]
        if last >= 0:
            self.link[made] = self._split(last, word)
        return made

    def follow(self, words: list[bytes]) -> tuple[list[int], set, int]:
        """Hit words as runs (from, to, from, to, ...), items met, longest match in words."""
        if not self.number:
            return [], set(), 0
        known = self.number.get
        ids = [known(word, -1) for word in words]
        there = np.array(ids, np.int64) >= 0
        edge = np.flatnonzero(np.diff(np.concatenate(([0], there.view(np.int8), [0]))))
        starts, ends = edge[::2], edge[1::2]
        long = ends - starts >= self.shortest
        runs: list[int] = []
        met: set = set()
        longest = 0
        for start, end in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
            state = matched = 0
            for n in range(start, end):
                word = ids[n]
                while state and word not in self.next[state]:
                    state = self.link[state]
                    matched = self.length[state]
                if word not in self.next[state]:
                    continue
                state = self.next[state][word]
                matched += 1
                longest = max(longest, matched)
                back = 0
                if matched >= self.window:
                    back = self.window
                    met |= self.items[self.whole[state]]
                for size, name in self.short[state]:
                    if size <= matched:
                        back = max(back, size)
                        met.add(name)
                if back:
                    first = n + 1 - back
                    # A longer window may begin before runs that ended.
                    while runs and runs[-2] >= first:
                        del runs[-2:]
                    if runs and runs[-1] >= first:
                        runs[-1] = n + 1
                    else:
                        runs += [first, n + 1]
        return runs, met, longest


def _union(left: list[int], right: list[int]) -> list[int]:
    if not left or not right:
        return left or right
    spans = sorted([*zip(left[::2], left[1::2]), *zip(right[::2], right[1::2])])
    made: list[int] = []
    for start, end in spans:
        if made and start <= made[-1]:
            made[-1] = max(made[-1], end)
        else:
            made += [start, end]
    return made


def _shards(items: DataFrame) -> list[DataFrame]:
    """Items in groups of bounded size, by the hash of their text."""
    rows = items.select(
        F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")
    ).filter("text IS NOT NULL")
    total = rows.agg(F.expr("coalesce(sum(octet_length(text)), 0)")).first()[0]
    n = max(1, -(-total // SHARD_BYTES))
    return [rows.filter(f"pmod(xxhash64(text), {n}) = {k}") for k in range(n)]


MARKS = "n_words long, runs array<int>, item_ids array<string>, longest int"


def mark(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` and what they share with items: four more columns.

    ``n_words`` is the number of words, ``runs`` the hit words as from, to, from,
    to and so on, ``item_ids`` the items with windows that occur, sorted as
    strings, ``longest`` the longest match in words. Null and empty texts have
    none of these. Items are read in groups of at most ``SHARD_BYTES`` of text,
    each collected, made into an automaton and broadcast; documents are passed
    once per group, without a shuffle. Items of null or blank text have no
    window; those of null id hit but are not listed. Columns of ``docs`` that
    are called as the new ones are replaced.
    """
    return _passed(docs.drop(*NEW), items, window, None)


NEW = [part.split()[0] for part in MARKS.split(", ")]
# What happens to a batch and its four new columns in the last pass.
Finish = Callable[[dict[str, pa.Array]], pa.RecordBatch]


def _passed(rows: DataFrame, items: DataFrame, window: int, finish: Finish | None) -> DataFrame:
    place = rows.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    shards = _shards(items)
    for k, shard in enumerate(shards):
        found = ((row.item_id, plain(row.text)) for row in shard.collect())
        shared = share(rows.sparkSession, ItemAutomaton(found, window))
        last = k + 1 == len(shards)

        def step(batches: Iterator[pa.RecordBatch], shared=shared, more=k > 0, last=last):
            automaton = held(shared)
            for batch in batches:
                columns = dict(zip(batch.schema.names, batch.columns, strict=True))
                made: list[list] = [[], [], [], []]
                for n, text in enumerate(batch.column(place)):
                    words = plain(text.as_py()).split()
                    runs, met, longest = automaton.follow(words)
                    met.discard(None)
                    if more:
                        runs = _union(columns["runs"][n].as_py(), runs)
                        met |= set(columns["item_ids"][n].as_py())
                        longest = max(longest, columns["longest"][n].as_py())
                    for column, value in zip(made, (len(words), runs, sorted(met), longest)):
                        column.append(value)
                kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int32())
                arrays = {c: pa.array(v, t) for c, v, t in zip(NEW, made, kinds, strict=True)}
                whole = columns | arrays
                yield finish(whole) if finish and last else pa.RecordBatch.from_pydict(whole)

        rows = rows.mapInArrow(step, fields if finish and last else f"{fields}, {MARKS}")
        if not last:
            rows = stage(rows, "marked").rows
    return rows


def hit_words(runs: str = "runs") -> str:
    """SQL of the number of words in runs."""
    return f"aggregate({runs}, 0L, (n, x) -> x - n)"


def remove_spans(text: str, runs: list[int], longer_than: int) -> str:
    """The text without the runs of more than so many words.

    A run goes with the white space and signs up to the next word that stays.
    """
    raw = text.encode("utf-8", "surrogatepass")
    inside = (np.frombuffer(b" " + plain(text), np.uint8) != 32).view(np.int8)
    starts = np.flatnonzero(np.diff(inside) == 1)
    kept, at = [], 0
    for first, end in zip(runs[::2], runs[1::2], strict=True):
        if end - first > longer_than:
            kept.append(raw[at : starts[first]])
            at = int(starts[end]) if end < len(starts) else len(raw)
    kept.append(raw[at:])
    return b"".join(kept).decode("utf-8", "surrogatepass")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    longer_than: int = 0,
    coverage: float = 0.5,
) -> DataFrame:
    """Documents without what they share with items, in the columns of ``docs``.

    Runs of hit words longer than ``longer_than`` are cut out and ``n_chars``,
    where there is one, counts anew; a document of which more than ``coverage``
    of the words is hit goes altogether. Documents without a hit, null and empty
    ones included, stay as they are. Everything happens in the task that reads
    the document.
    """
    names = docs.columns
    inner = docs.toDF(*[
        name if name in ("text", "n_chars") else f"_c{n}" for n, name in enumerate(names)
    ])

    def finish(columns: dict[str, pa.Array]) -> pa.RecordBatch:
        words, runs = columns["n_words"].to_pylist(), columns["runs"].to_pylist()
        texts = columns["text"].to_pylist()
        counts = columns["n_chars"].to_pylist() if "n_chars" in columns else None
        kept = []
        for n, spans in enumerate(runs):
            hit = sum(spans[1::2]) - sum(spans[::2])
            if hit <= words[n] * coverage:
                kept.append(n)
            if spans:
                texts[n] = remove_spans(texts[n], spans, longer_than)
                if counts:
                    counts[n] = len(texts[n])
        made = {name: array for name, array in columns.items() if name not in NEW}
        made["text"] = pa.array(texts, made["text"].type)
        if counts:
            made["n_chars"] = pa.array(counts).cast(made["n_chars"].type)
        return pa.RecordBatch.from_pydict(made).take(pa.array(kept, pa.int64()))

    return _passed(inner, items, window, finish).toDF(*names)
