import hashlib
import random
import re

from pyspark.sql import functions as F

from odd_rows import documents, empty, nasty  # noqa: F401
from salesmart.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEVER = {k: [-9.0] * len(pii.FEATURES) for k in range(4)}


def luhn(digits):
    doubled = [int(c) * (1 + n % 2) for n, c in enumerate(reversed(digits))]
    return sum(x if x < 10 else x - 9 for x in doubled) % 10 == 0


def brute(text):
    found = []
    for k, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_base_spans_against_brute_force(spark):
    random.seed(3)
    signs = [*"ab@.@..-+1234567890123 ()_%é😀\n", "4111 1111 1111 1111", "+1 (988) 555-2485", "a@b.c",
             "1.2.3.4", "255.256.1.1", "(988) 555-2485", "x(at)y.z", "5" * 25]
    texts = ["".join(random.choices(signs, k=random.randint(0, 50))) for _ in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    for r in pii.find(docs, NEVER).collect():
        assert [(x.start, x.kind, x.end) for x in r.spans] == brute(r.text), r.text
        assert all(x.base for x in r.spans)


def test_digest_text_and_counts(spark, documents):
    docs = documents(["x a@b.co 1.2.3.4", None])
    rows = pii.find(docs, NEVER).select(
        pii.listed(F.col("spans")).alias("s"), pii.of_kind(F.col("spans"), "ip").alias("n"),
        F.sha2(pii.listed(F.col("spans")), 256).alias("h"),
    ).collect()
    assert [(r.s, r.n) for r in rows] == [("email:2:8,ip:9:16", 1), ("", 0)]
    assert rows[1].h == hashlib.sha256(b"").hexdigest()


def test_votes_are_weighed(spark, documents):
    """Loose spans are taken where their context speaks for them; base spans always stay."""
    texts = [f"call my phone {200 + n % 700} 555 {1000 + n}" for n in range(60)]
    texts += [f"order no {100 + n} 122 {1000 + n}" for n in range(60)]
    texts += [f"tel +1 (212) 555-{1000 + n}" for n in range(40)]
    docs = documents(texts)
    weights = pii.train(docs)
    rows = {r.doc_id: r.spans for r in pii.find(docs, weights).collect()}
    assert all(len(rows[n]) == 1 and not rows[n][0].base for n in range(60))
    assert not any(rows[n] for n in range(60, 120))
    assert all([x.base for x in rows[n]] == [True] for n in range(120, 160))


def test_reliabilities_find_the_labeler_that_guesses():
    patterns = [pii.Pattern(0, False, (a, a, b), 50 if a == b else 45) for a in (-1, 1) for b in (-1, 1)]
    p = pii.reliabilities(patterns)
    for x, q in zip(patterns, p, strict=True):
        assert (q > 0.5) == (x.votes[0] > 0)
    assert pii.reliabilities([]) == [] and pii.classifier([], [])[0] == [0.0] * len(pii.FEATURES)


def test_masking(spark, documents):
    docs = documents(["Ü a@b.co, +1 212 555 1234!", "no data", "", None])
    rows = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert pii.mask(docs).columns == docs.columns
    assert rows[0].text == "Ü <EMAIL>, <PHONE>!" and rows[0].n_chars == len(rows[0].text)
    assert [rows[n].text for n in (1, 2, 3)] == ["no data", "", None]


def test_nothing_but_built_in_functions(spark, documents):
    plan = pii.find(documents(["a@b.co"]), NEVER)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows(nasty, empty):
    assert pii.find(nasty, pii.train(nasty)).count() == nasty.count()
    assert pii.mask(nasty).count() == nasty.count()
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_very_long_runs(documents):
    texts = ["1" * 100_000, "1 " * 50_000, "a." * 50_000, "+1" * 50_000, "1.1." * 25_000, "a@b.c " * 2_000,
             "x@" + "a." * 50_000 + "a", "x (at) " + "a." * 50_000 + "a", "+" + "1" * 100_000,
             "@" * 100_000, "1-" * 50_000 + "1"]
    rows = {r.doc_id: len(r.spans) for r in pii.find(documents(texts), NEVER).collect()}
    assert [rows[n] for n in range(len(texts))] == [len(brute(t)) for t in texts]
