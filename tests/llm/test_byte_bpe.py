import random

import numpy as np
import pytest
import tiktoken

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import byte_bpe
from salesmart.llm.queries import MULTI_RANKS, RANKS


@pytest.fixture(scope="module", params=[MULTI_RANKS, RANKS])
def both(request):
    coder = byte_bpe.load(request.param)
    return coder, tiktoken.Encoding(
        "own", pat_str=byte_bpe.PATTERN, mergeable_ranks=coder.ranks, special_tokens={}
    )


def ids_of(coder, text):
    return np.frombuffer(coder.encode(text), "<u4").tolist()


def test_random_texts(both):
    coder, library = both
    random.seed(3)
    signs = [*"abc'sStTrReEvVlLdDmM 123.,-_<|>\n\t\x1c\x85\xa0éÉßİΣς’“́日本😀٣ﬁ՘",
             "the ", "ing ", " \u2009\u3000", "aaaa", "    ", "\U00011de0"]
    for _ in range(4000):
        text = "".join(random.choice(signs) for _ in range(random.randint(0, 50)))
        assert ids_of(coder, text) == library.encode_ordinary(text), text
        assert coder.decode(coder.encode(text)) == text


def test_words_of_few_letters(both):
    """Many guesses stay open where letters repeat."""
    coder, library = both
    random.seed(4)
    for letters in ("ab", "abenrst", "éab", "日本a"):
        for _ in range(500):
            text = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
            assert ids_of(coder, text) == library.encode_ordinary(text), text


def test_every_character(both):
    coder, library = both
    text = "".join(f"a{chr(c)}b 1{chr(c)}2 " for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    assert ids_of(coder, text) == library.encode_ordinary(text)


def test_the_machine_starts_over(both, monkeypatch):
    coder, library = both
    monkeypatch.setattr(byte_bpe, "STATES", 20)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    text = "So it goes on and on, word after word, whatever is remembered. " * 20
    assert ids_of(coder, text) == library.encode_ordinary(text)


def test_tokens_go_out_before_the_end():
    """Lookahead is bounded: along a long piece the machine keeps few ids back."""
    coder = byte_bpe.load(MULTI_RANKS)
    coder.encode("x")
    random.seed(5)
    state, kept = coder.start, 0
    for byte in "".join(random.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5000)).encode():
        state, _ = state.get(byte) or coder._step(state, byte)
        kept = max(kept, len(state.final))
    assert kept < 20


def test_a_token_that_merges_never_reach():
    """Whole pieces are looked up, and such a token is used nowhere else."""
    ranks = {bytes([n]): n for n in range(256)} | {b"ab": 256, b"abc": 258, b"bc": 257, b"xyz": 259}
    coder = byte_bpe.ByteBpe(ranks)
    library = tiktoken.Encoding("own", pat_str=byte_bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("xyz", "xyzxyz", "axyz", "abc", "abcabc", "bcab", "aabbc"):
        assert ids_of(coder, text) == library.encode_ordinary(text), text


def test_a_file_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe({b"a": 0})


def test_utf8_in_parts():
    random.seed(6)
    some = [0x41, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF, 0xC0, 0xE0, 0xF4, 0x90]
    for _ in range(5000):
        raw = bytes(random.choice(some) for _ in range(random.randint(0, 12)))
        reader, text, at = byte_bpe.Utf8(), "", 0
        while at < len(raw):
            n = random.randint(1, 4)
            text, at = text + reader.feed(raw[at : at + n]), at + n
        assert text + reader.finish() == raw.decode("utf-8", "replace")


def test_decoding_in_runs(monkeypatch):
    coder = byte_bpe.load(MULTI_RANKS)
    monkeypatch.setattr(byte_bpe, "RUN", 1)
    text = "日本語 😀 ﬁ é x"
    assert "".join(coder.stream(coder.encode(text))) == text
    assert "\ufffd" in coder.decode(coder.encode("\U00011de0")[:4])


def test_odd_rows(spark, nasty, empty):
    rows = byte_bpe.encode(nasty, MULTI_RANKS, decoded=True).collect()
    assert len(rows) == nasty.count()
    coder = byte_bpe.load(MULTI_RANKS)
    texts = {r.doc_id: r.text for r in nasty.collect() if r.doc_id is not None}
    for r in rows:
        if r.doc_id is not None:
            assert r.decoded == (texts[r.doc_id] or "") and r.ids == coder.encode(r.decoded)
    again = byte_bpe.encode(nasty, MULTI_RANKS)
    decoded = again.select(byte_bpe.decode(spark, again["ids"], MULTI_RANKS).alias("d")).collect()
    assert sorted(r.d for r in decoded) == sorted(r.decoded for r in rows)
    assert byte_bpe.encode(empty, MULTI_RANKS).count() == 0
