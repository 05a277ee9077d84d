"""BPE encoding and decoding: texts are cut where no merge can ever reach across."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import pairwise
from struct import pack

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesmart.llm.tasks import held, share

# Remembered words and fragments of a worker; beyond this it starts over.
REMEMBERED = 150_000
# Documents that a worker returns at a time.
PART = 200
# Texts without these need neither composition nor special case folding.
_WIDE = re.compile("[̀-\U0010ffff]")
_ASCII_CLASSES = {r"[\p{L}]": "[a-z]", r"[\p{N}]": "[0-9]", r"\p{L}\p{N}": "a-z0-9"}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {byte: chr(byte) for byte in plain}
    others = (byte for byte in range(256) if byte not in letters)
    letters |= {byte: chr(256 + n) for n, byte in enumerate(others)}
    return [letters[byte] for byte in range(256)]


class WordBpe:
    """A lower-casing byte-level BPE with word ends, read from a tokenizer file.

    ``crossed[last][a, b]`` tells whether any token holds byte a before byte b,
    where ``last`` says that b ends the word. A merge makes a token, so where no
    token holds the pair, no merge reaches across and a word can be cut there.
    Fragments are encoded on their own and their ids concatenated.
    """

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        steps = [step["type"] for step in spec["normalizer"]["normalizers"]]
        if steps != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or spec["decoder"]:
            raise ValueError("Not a lower-casing word-end BPE file")
        self.content = content
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        self.special = {text: pack("<I", number) for text, number in special.items()}
        self.tokens = {number: text for text, number in (vocab | special).items()}
        self.pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.final = [vocab[x + self.suffix] for x in letters]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.crossed = np.zeros((2, 256, 256), bool)
        for token in vocab:
            if token in special:
                continue
            ends = token.endswith(self.suffix) and token != self.suffix
            held = [byte_of[x] for x in (token.removesuffix(self.suffix) if ends else token)]
            for n, (a, b) in enumerate(pairwise(held), start=2):
                self.crossed[int(ends and n == len(held)), a, b] = True
        self._ready = False

    def __getstate__(self):
        made = ("words", "parts", "split", "split_ascii", "split_wide", "cut", "normalizer", "apart")
        return self.__dict__ | dict.fromkeys(made) | {"_ready": False}

    def _prepare(self) -> None:
        self.normalizer = tokenizers.Tokenizer.from_str(self.content).normalizer
        self.split = regex.compile(self.pattern).findall
        self.split_wide = tokenizers.pre_tokenizers.Split(
            tokenizers.Regex(self.pattern), "removed", invert=True
        ).pre_tokenize_str
        narrow = self.pattern
        for wide, ascii_class in _ASCII_CLASSES.items():
            narrow = narrow.replace(wide, ascii_class)
        self.split_ascii = re.compile(narrow, re.ASCII).findall
        self.apart = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        self.cut = self.crossed.tolist()
        self.words, self.parts, self._ready = {}, {}, True

    def fragments(self, word: bytes) -> list[bytes]:
        """The pieces between certain cuts; joined they are the word."""
        inner, final = self.cut
        last = len(word) - 1
        made, start = [], 0
        for n in range(1, last):
            if not inner[word[n - 1]][word[n]]:
                made.append(word[start:n])
                start = n
        if last > 0 and not final[word[last - 1]][word[last]]:
            made.append(word[start:last])
            start = last
        made.append(word[start:])
        return made

    def _merge(self, part: bytes, ends: bool) -> bytes:
        symbols = [self.inner[byte] for byte in part]
        if ends:
            symbols[-1] = self.final[part[-1]]
        merges = self.merges
        while len(symbols) > 1:
            found = [merges.get(pair) for pair in pairwise(symbols)]
            best = min((x for x in found if x), default=None)
            if best is None:
                break
            made, n = [], 0
            while n < len(symbols):
                if n < len(found) and found[n] == best:
                    made.append(best[1])
                    n += 2
                else:
                    made.append(symbols[n])
                    n += 1
            symbols = made
        return pack(f"<{len(symbols)}I", *symbols)

    def _word(self, word: str) -> bytes:
        made = []
        pieces = self.fragments(word.encode())
        for n, part in enumerate(pieces, start=1):
            ends = n == len(pieces)
            ids = self.parts.get((part, ends))
            if ids is None:
                if len(self.parts) >= REMEMBERED:
                    self.parts.clear()
                ids = self.parts[part, ends] = self._merge(part, ends)
            made.append(ids)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        # A word of a million letters is not worth remembering.
        ids = b"".join(made)
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = self.split_ascii(text.lower())
        elif not _WIDE.search(text):
            words = self.split(text.lower())
        else:
            # The library's own Unicode tables, which differ from Python's here and there.
            words = [x for x, _ in self.split_wide(self.normalizer.normalize_str(text))]
        known = self.words.get
        return b"".join([known(word) or self._word(word) for word in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self._ready:
            self._prepare()
        if "<|" not in text:
            return self._plain(text)
        return b"".join(
            self.special.get(part) or self._plain(part) for part in self.apart(text) if part
        )

    def decode(self, ids: bytes) -> str:
        """The tokens, joined by blanks as the file has no decoder."""
        return " ".join([self.tokens[n] for n in np.frombuffer(ids, "<u4").tolist()])


def load(path: str) -> WordBpe:
    """The tokenizer of a file that the driver can open; tasks get it by broadcast."""
    with open(path, encoding="utf-8") as file:
        return WordBpe(file.read())


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """``doc_id, ids`` per document; ids are little-endian unsigned 32-bit integers.

    With ``decoded`` also their text, as ``decode`` gives it, made by the same
    worker. Null and empty texts give no ids; repeated rows each give their row;
    null ids of documents stay null; other columns are not read. The vocabulary,
    of a fixed size, is read once on the driver and broadcast.
    """
    shared = share(docs.sparkSession, load(path))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held(shared)
        for batch in batches:
            # In small parts: ids and Python's texts take many times a text's bytes.
            for start in range(0, batch.num_rows, PART):
                part = batch.slice(start, PART)
                ids = [coder.encode(text.as_py() or "") for text in part.column(1)]
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
