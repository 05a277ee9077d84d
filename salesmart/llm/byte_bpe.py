"""Byte-level BPE by a transducer that is made deterministic as texts need it.

A token sequence is what the merges give exactly if each two neighbours are what
they give of the two alone. So the merges are a finite-state transducer that
guesses where the token under way began: a guess is the token before it and the
bytes since. The deterministic machine holds all guesses that can still come
true, with the tokens of each that are not certain yet; tokens on which all agree
go out. Its states and steps are made when a text first needs them and kept.
Decoding streams through a UTF-8 state machine.
"""

from __future__ import annotations

import base64
import gc
import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.tasks import held, share

# Fixed value: the published pattern that cuts texts before the merges of rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# States of the machine, pairs of tokens and pieces that a worker keeps; beyond this
# it starts over. Of pieces it keeps the last so many and those before them.
STATES, PAIRS, REMEMBERED = 200_000, 1_000_000, 400_000
# Documents that a worker returns at a time, and ids it decodes at a time.
PART, RUN = 200, 65_536
_BEYOND = re.compile("[\U00010000-\U0010ffff]").search


# --- where texts are cut -----------------------------------------------------


def _ranges(codes: Iterable[int]) -> str:
    """The inside of a character class that holds these code points."""
    made = []
    for _, run in groupby(enumerate(sorted(codes)), key=lambda x: x[1] - x[0]):
        members = [code for _, code in run]
        made.append(f"\\U{members[0]:08x}-\\U{members[-1]:08x}")
    return "".join(made)


def _members(kind: str) -> list[int]:
    """The code points of a class, asked of the library whose results are wanted:
    its Unicode tables are not those of Python."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([n]): n for n in range(256)}
    asked = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={})
    return list(map(ord, bytes(asked.encode_ordinary(every)).decode()))


def _rewritten(pattern: str, top: int) -> str:
    """The pattern with its three classes spelled out up to a code point."""
    inside = {
        kind: _ranges(code for code in _members(kind) if code <= top)
        for kind in (r"\p{L}", r"\p{N}", r"\s")
    }
    kinds = "|".join(map(re.escape, inside))

    def spelled(found: re.Match) -> str:
        part = found.group()
        if part.startswith("["):
            return re.sub(kinds, lambda x: inside[x.group()], part)
        return f"[^{inside[chr(92) + 's']}]" if part == r"\S" else f"[{inside[part]}]"

    return re.sub(rf"\[(?:[^\]\\]|\\.)*\]|\\S|{kinds}", spelled, pattern)


# --- the transducer ----------------------------------------------------------


class _State(dict):
    """Steps by byte, ``(next state, ids that go out)``; the guesses; the ids still
    to come where the text ends here."""

    __slots__ = ("live", "final")


class _Reading(dict):
    """The UTF-8 state after each token, by its id, from one state; made when asked for."""

    def __init__(self, tokens: list[bytes], state: int):
        self.tokens, self.state = tokens, state

    def __missing__(self, token: int) -> int:
        state = self.state
        for byte in self.tokens[token]:
            state = _STEPS[state][byte]
        self[token] = state
        return state


class ByteBpe:
    """Encoder and decoder of one rank file; a worker fills its machine over time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        if any(bytes([n]) not in ranks for n in range(256)):
            raise ValueError("Not a byte-level rank file: single bytes are missing")
        self.ranks = ranks
        self.patterns = [_rewritten(pattern, top) for top in (0x7F, 0xFFFF, 0x10FFFF)]
        self._ready = False

    def __getstate__(self):
        made = (
            "cuts", "tokens", "child", "token_of", "longer", "start", "states", "pairs",
            "pieces", "older", "reading",
        )
        return self.__dict__ | dict.fromkeys(made) | {"_ready": False}

    def _prepare(self) -> None:
        self.cuts = [re.compile(pattern).findall for pattern in self.patterns]
        self.tokens = {number: token for token, number in self.ranks.items()}
        self._grow_tree()
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.reading = [_Reading(self.tokens, state) for state in range(BROKEN)]
        # What is broken stays so.
        self.reading.append(dict.fromkeys(self.tokens, BROKEN))
        self.states: dict[tuple, _State] = {}
        self._restart()
        self._ready = True

    def _grow_tree(self) -> None:
        """Beginnings of tokens as numbers: the next by number and byte, the token
        that a beginning is, and whether longer tokens begin with it."""
        self.child: dict[int, int] = {}
        self.token_of, self.longer = [-1], [True]
        for token, number in self.ranks.items():
            at = 0
            for byte in token:
                self.longer[at] = True
                key = at << 8 | byte
                at = self.child.get(key, 0)
                if not at:
                    at = self.child[key] = len(self.token_of)
                    self.token_of.append(-1)
                    self.longer.append(False)
            self.token_of[at] = number

    def _restart(self) -> None:
        # States lead to each other and back: without their steps they are free at once.
        for state in self.states.values():
            state.clear()
        self.states = {}
        self.start = self._state(((0, -1, ()),))

    def _state(self, live: tuple) -> _State:
        state = self.states.get(live)
        if state is None:
            state = self.states[live] = _State()
            state.live = live
            # The last guess is that a token ends here.
            state.final = live[-1][2]
        return state

    def _merged(self, piece: bytes) -> list[int]:
        """What the merges give, by their definition; for one or two tokens only."""
        ranks = self.ranks
        none = len(ranks) << 8
        parts = [piece[n : n + 1] for n in range(len(piece))]
        found = [ranks.get(piece[n : n + 2], none) for n in range(len(piece) - 1)]
        while found and (best := min(found)) < none:
            at = found.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del found[at]
            if at:
                found[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
            if at < len(found):
                found[at] = ranks.get(parts[at] + parts[at + 1], none)
        return [ranks[part] for part in parts]

    def _follows(self, before: int, token: int) -> bool:
        """Whether the merges leave this token after the one before, or at a start."""
        if before < 0:
            known = self._merged(self.tokens[token]) == [token]
        else:
            known = self._merged(self.tokens[before] + self.tokens[token]) == [before, token]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[before << 32 | token] = known
        return known

    def _step(self, state: _State, byte: int) -> tuple[_State, tuple[int, ...]]:
        """Make the step of a byte: every guess goes on, one of them comes true."""
        child, token_of, longer, pairs = self.child, self.token_of, self.longer, self.pairs
        live, done = [], None
        for guess in state.live:
            at, before, pending = guess
            now = child.get(at << 8 | byte)
            if now is None:
                continue
            token = token_of[now]
            if done is None and token >= 0:
                true = pairs.get(before << 32 | token)
                if true or true is None and self._follows(before, token):
                    done = (*pending, token)
            if longer[now]:
                live.append((now, before, pending))
        sure = 0
        if not live:
            sure = len(done)
        elif live[0][2] and all(x[2] for x in live):
            while all(len(x[2]) > sure and x[2][sure] == done[sure] for x in live):
                sure += 1
        last = done[-1]
        if sure:
            live = [(at, before, pending[sure:]) for at, before, pending in live]
            live.append((0, last, done[sure:]))
            done = done[:sure]
        else:
            live.append((0, last, done))
            done = ()
        step = state[byte] = self._state(tuple(live)), done
        return step

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece."""
        ids = self.pieces.get(piece) or self.older.get(piece)
        if ids is None:
            if len(self.states) >= STATES:
                self._restart()
            data = piece.encode()
            # The library looks whole pieces up before it merges.
            token = self.ranks.get(data)
            if token is not None:
                ids = pack("<I", token)
            else:
                state, out = self.start, []
                for byte in data:
                    state, sure = state.get(byte) or self._step(state, byte)
                    if sure:
                        out += sure
                out += state.final
                ids = pack(f"<{len(out)}I", *out)
        # A piece of a million letters is not worth remembering.
        if len(piece) <= 64:
            if len(self.pieces) >= REMEMBERED:
                # What is met again comes back from the older ones.
                self.older, self.pieces = self.pieces, {}
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self._ready:
            self._prepare()
        cut = self.cuts[0 if text.isascii() else 2 if _BEYOND(text) else 1]
        known = self.pieces.get
        return b"".join([known(piece) or self._piece(piece) for piece in cut(text)])

    # --- decoding ---

    def stream(self, ids: bytes) -> Iterator[str]:
        """The text of ids, a run of them at a time; no character is cut in two.

        The state machine reads whole tokens; a run in which it breaks is read
        by bytes.
        """
        if not self._ready:
            self._prepare()
        reader, tokens, reading = Utf8(), self.tokens, self.reading
        for start in range(0, len(ids), 4 * RUN):
            run = np.frombuffer(ids[start : start + 4 * RUN], "<u4").tolist()
            state = reader.state
            for token in run:
                state = reading[state][token]
            data = b"".join([tokens[token] for token in run])
            yield reader.feed(data) if state == BROKEN else reader.take(data, state)
        yield reader.finish()

    def decode(self, ids: bytes) -> str:
        """The whole text; bytes that are no UTF-8 become U+FFFD."""
        return "".join(self.stream(ids))


# --- UTF-8 -------------------------------------------------------------------

# States: 0 between characters; 1 to 3 so many bytes to come; 4 to 7 the second
# byte after E0, ED, F0 and F4, which has a narrower range.
_AFTER = {4: 1, 5: 1, 6: 2, 7: 2}
_SECOND = {4: (0xA0, 0xBF), 5: (0x80, 0x9F), 6: (0x90, 0xBF), 7: (0x80, 0x8F)}
BROKEN = 8


def _utf8_steps() -> list[list[int]]:
    """The next state by state and byte."""
    steps = [[BROKEN] * 256 for _ in range(8)]
    for byte in range(256):
        if byte < 0x80:
            steps[0][byte] = 0
        elif 0xC2 <= byte <= 0xDF:
            steps[0][byte] = 1
        elif 0xE0 <= byte <= 0xEF:
            steps[0][byte] = {0xE0: 4, 0xED: 5}.get(byte, 2)
        elif 0xF0 <= byte <= 0xF4:
            steps[0][byte] = {0xF0: 6, 0xF4: 7}.get(byte, 3)
        if 0x80 <= byte <= 0xBF:
            for state in (1, 2, 3):
                steps[state][byte] = state - 1
        for state, (low, high) in _SECOND.items():
            if low <= byte <= high:
                steps[state][byte] = _AFTER[state]
    return steps


_STEPS = _utf8_steps()


class Utf8:
    """Text from bytes that come in parts; an unfinished character waits for the rest."""

    def __init__(self):
        self.state, self.waiting = 0, b""

    def feed(self, data: bytes) -> str:
        """The text so far of bytes of any kind."""
        state, made = self.state, []
        # Bytes that wait have been through the machine.
        at, start = len(self.waiting), 0
        data = self.waiting + data
        while at < len(data):
            after = _STEPS[state][data[at]]
            if after != BROKEN:
                state, at = after, at + 1
                continue
            made += [data[start : _begin(data, at, state)].decode(), "\ufffd"]
            # A byte that breaks a character off may begin the next.
            at += state == 0
            start, state = at, 0
        self.waiting = b""
        made.append(self.take(data[start:], state))
        return "".join(made)

    def take(self, data: bytes, state: int) -> str:
        """The text so far of bytes after which the machine is in ``state``."""
        data = self.waiting + data
        begun = _begin(data, len(data), state)
        self.state, self.waiting = state, data[begun:]
        return data[:begun].decode()

    def finish(self) -> str:
        """What is left at the end: an unfinished character is replaced."""
        left = "\ufffd" if self.state else ""
        self.state, self.waiting = 0, b""
        return left


def _begin(data: bytes, at: int, state: int) -> int:
    """Where the character under way began."""
    if state:
        at -= 1
        while data[at] & 0xC0 == 0x80:
            at -= 1
    return at


# --- over documents ----------------------------------------------------------


def load(path: str, pattern: str = PATTERN) -> ByteBpe:
    """The encoder of a rank file that the driver can open; tasks get it by broadcast."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return ByteBpe(ranks, pattern)


def encode(docs: DataFrame, path: str, decoded: bool = False, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, ids`` per document; ids are little-endian unsigned 32-bit integers.

    With ``decoded`` also the text that streaming decoding gives of them, made by
    the same worker. Null and empty texts give no ids; repeated rows each give
    their row; null ids of documents stay null; other columns are not read. The
    rank file, of a fixed size, is read once on the driver and broadcast.
    """
    shared = share(docs.sparkSession, load(path, pattern))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(shared)
        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                part = batch.slice(start, PART)
                # Of the many small objects made here hardly any is garbage: none is sought.
                gc.disable()
                try:
                    ids = [coder.encode(text.as_py() or "") for text in part.column(1)]
                finally:
                    gc.enable()
                made = {"doc_id": part.column(0), "ids": pa.array(ids, pa.binary())}
                if decoded:
                    made["decoded"] = pa.array(map(coder.decode, ids), pa.string())
                yield pa.RecordBatch.from_pydict(made)

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    more = ", decoded string" if decoded else ""
    return rows.mapInArrow(make, f"doc_id {kind}, ids binary{more}")


def decode(spark, ids: Column, path: str) -> Column:
    """The text of ids as ``encode`` makes them; null for null."""
    shared = share(spark, load(path))

    @F.pandas_udf("string")
    def make(column: pd.Series) -> pd.Series:
        coder = held(shared)
        return column.map(lambda ids: None if ids is None else coder.decode(ids)).astype(object)

    return make(ids)
