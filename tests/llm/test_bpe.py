import random

import numpy as np
import pytest
import tokenizers

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import bpe
from salesmart.llm.queries import TOKENIZER


@pytest.fixture(scope="module")
def library():
    made = tokenizers.Tokenizer.from_file(TOKENIZER)
    made.no_truncation()
    made.no_padding()
    return made


@pytest.fixture(scope="module")
def coder():
    return bpe.load(TOKENIZER)


def same(library, coder, text):
    want = library.encode(text, add_special_tokens=False).ids
    ids = coder.encode(text)
    return np.frombuffer(ids, "<u4").tolist() == want and coder.decode(ids) == library.decode(
        want, skip_special_tokens=False
    )


def test_random_texts(library, coder):
    random.seed(7)
    signs = [*"abc'sStTrReEvVlLdDmM 123.,-_<|>\n\t\x1c\x85 éÉßİΣς’“́日本😀٣ﬁ",
             "<|startoftext|>", "<|endoftext|>", "the ", "ing ", "tokenization"]
    for _ in range(4000):
        text = "".join(random.choice(signs) for _ in range(random.randint(0, 50)))
        assert same(library, coder, text), text


def test_every_letter_of_the_first_plane(library, coder):
    chars = [chr(c) for c in range(1, 0x3000)]
    assert not [c for c in chars if not same(library, coder, f"a{c}b 1{c}")]


def test_cuts_are_certain(coder):
    """No token reaches across a cut, and the pieces are the word."""
    random.seed(8)
    crossing = coder.crossed
    for _ in range(500):
        word = bytes(random.choice(b"abcdefghijklmnopqrstuvwxyz\xc3\xa9") for _ in range(random.randint(1, 30)))
        parts = coder.fragments(word)
        assert b"".join(parts) == word and all(parts)
        at = 0
        for part in parts[:-1]:
            at += len(part)
            assert not crossing[int(at == len(word) - 1), word[at - 1], word[at]]
    assert sum(len(coder.fragments(w)) for w in (b"zqxjkv", b"qzjx")) > 2


def test_odd_rows(spark, nasty, empty, library):
    rows = bpe.encode(nasty, TOKENIZER, decoded=True).collect()
    assert len(rows) == nasty.count()
    texts = {r.doc_id: r.text for r in nasty.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == want
    again = bpe.encode(nasty, TOKENIZER)
    decoded = again.select(bpe.decode(spark, again["ids"], TOKENIZER).alias("d")).collect()
    assert sorted(r.d for r in decoded) == sorted(r.decoded for r in rows)
    assert bpe.encode(empty, TOKENIZER).count() == 0
