"""Every query at the smallest scale, against its SQL or a plain version."""

import glob
import hashlib
import os

import duckdb
import numpy as np
import pytest
import tiktoken
import tokenizers

import corpus_pipeline
from salesmart.llm import bpe, byte_bpe, decontamination, pii, simhash, toxicity
from salesmart.llm.queries import MULTI_RANKS, ORACLE_SQL, QUERIES, TOKENIZER
from odd_rows import documents, empty, nasty  # noqa: F401
from test_pii import brute as personal
from test_repeats import brute as repeated
from test_simhash import brute as prints
from test_simhash import reachable
from verify import normal

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def found(spark):
    done = {}

    def get(name):
        if name not in done:
            df = QUERIES[name](spark, SF_SMALL)
            done[name] = df.columns, df.collect()
        return done[name]

    return get


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text for r in rows}


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(found, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF_SMALL}/*.parquet"):
        table = os.path.basename(path).removesuffix(".parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    columns, rows = found(name)
    cursor = duck.execute(ORACLE_SQL[name])
    theirs = [item[0] for item in cursor.description]
    assert sorted(columns) == sorted(theirs)
    assert normal([tuple(r) for r in rows], columns) == normal(cursor.fetchall(), theirs)


def test_simhash(found, texts):
    ids = sorted(texts)
    made = prints([texts[i] for i in ids])
    label = reachable(made, 4)
    got = {r.doc_id: r for r in found("op7_simhash")[1]}
    assert len(got) == len(ids)
    for i, fp, root in zip(ids, made, label, strict=True):
        assert (got[i].fingerprint, got[i].component_id) == (f"{fp:016x}", ids[root])


def test_personal_data(found, texts):
    rows = found("op8_pii")[1]
    assert len(rows) == len(texts)
    for r in rows:
        spans = personal(texts[r.doc_id])
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(shown) <= set(r.spans.split(","))


def test_repeats(found, texts):
    ids = sorted(texts)
    raw = [(texts[i] or "").encode() for i in ids]
    want = dict(zip(ids, zip(raw, repeated(raw, 400), strict=True), strict=True))
    for r in found("op9_repeats")[1]:
        text, runs = want[r.doc_id]
        kept, at = b"", 0
        for a, b in runs:
            kept, at = kept + text[at:a], b
        kept += text[at:]
        got = (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
        assert got == (len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest())


def test_bpe(found, texts):
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    library.no_padding()
    for r in found("op10_bpe")[1]:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_byte_bpe(found, texts):
    library = tiktoken.Encoding(
        "own", pat_str=byte_bpe.PATTERN, mergeable_ranks=byte_bpe.load(MULTI_RANKS).ranks, special_tokens={}
    )
    rows = found("op13_byte_bpe")[1]
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode_bytes(ids)).hexdigest()


def test_others_return_whole_tables(found, texts):
    for name in ("op1_lm_scoring", "op6_toxicity"):
        assert sorted(r.doc_id for r in found(name)[1]) == sorted(texts)
    assert {i for r in found("op5_packing")[1] for i in r.doc_ids} == {i for i in texts if texts[i]}


def test_pipeline_against_a_plain_version(spark, texts):
    """Stage by stage in plain Python, from the models the stages train."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    model = toxicity.train(docs, labels)
    items = [
        (str(r.item_id), r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    ]
    kept = {}
    for i, text in texts.items():
        words = toxicity.words_of(text)
        n = np.array([len(words)])
        p = model.marginals(np.array(model.lifts(words)), n)
        if model.score(model.documents(p, n))[0] < 0.5:
            kept[i] = text
    assert 0 < len(kept) < len(texts)
    ids = sorted(kept)
    made = prints([kept[i] for i in ids])
    roots = reachable(made, 4)
    kept = {i: kept[i] for n, i in enumerate(ids) if roots[n] == n}
    automaton = decontamination.ItemAutomaton([(n, decontamination.plain(t)) for n, t in items])
    for i, text in list(kept.items()):
        words = decontamination.plain(text).split()
        runs, _, _ = automaton.follow(words)
        if sum(b - a for a, b in zip(runs[::2], runs[1::2])) > len(words) / 2:
            del kept[i]
        elif runs:
            kept[i] = decontamination.remove_spans(text, runs, 0)
    cleaned = spark.createDataFrame(list(kept.items()), "doc_id long, text string")
    weights = pii.train(cleaned)
    spans = {r.doc_id: r.spans for r in pii.find(cleaned, weights).collect()}
    coder = bpe.load(TOKENIZER)
    want = {}
    for i, text in kept.items():
        done, at = [], 0
        for x in spans[i]:
            if x.start >= at:
                done += [text[at : x.start], f"<{pii.KINDS[x.kind].upper()}>"]
            at = max(at, x.end)
        want[i] = coder.encode("".join([*done, text[at:]]))
    rows = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert {r.doc_id: bytes(r.ids) for r in rows} == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)


def test_pipeline_decodes(spark, documents):
    texts = ["A plain text, 42 words.", "", None, "Grüße <|endoftext|> x"]
    coder = bpe.load(TOKENIZER)
    rows = corpus_pipeline.encode(spark, documents(texts), SF_SMALL).collect()
    for r in rows:
        text = coder.decode(coder.encode(texts[r.doc_id] or ""))
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_pipeline_stages_on_odd_rows(spark, nasty, empty):
    for docs in (nasty, empty):
        for _, step in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stage(step(spark, docs, SF_SMALL), "stage").rows
            assert docs.columns == nasty.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).count() == docs.count()


def test_simhash_keeps_what_stands_alone(spark, documents):
    docs = documents(["one two three four five six", "seven eight nine ten eleven"])
    assert simhash.keep_one(docs).count() == 2
