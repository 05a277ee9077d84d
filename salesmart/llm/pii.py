"""Personal data: labelers vote on candidate spans, a classifier is trained on their votes.

Everything that touches rows is a built-in function. Only counts of vote
patterns, bounded by the number of patterns there can be, come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
NAME = "A-Za-z0-9._%+-"

# What the base rules match, leftmost and without overlap. Where a match cannot
# begin inside a run of its own characters, a look behind saves trying; runs are
# possessive as what follows them never is part of them. The card rule matches
# whole runs of 14 to 19 digits: longer and shorter ones fail anyway.
BASE = {
    "email": rf"(?:(?<![{NAME}])|\G)[{NAME}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Further candidates: forms that only the vote can make personal data.
LOOSE = {
    "email": rf"(?:(?<![{NAME}])|\G)[{NAME}]++\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]++"
    r"(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9A-Za-z+.,-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# A text without such a sign has no candidate.
NEEDED = {"email": r"[@(\[]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": "[0-9]"}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Gazetteers: endings of mail hosts, first octets in use, card issuers, dial codes.
KNOWN = {
    "email": r"(?i)(?:\.|dot\W*)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|it|nl|ch|at|be|us|ca)$",
    "ip": r"^0*(?:[1-9][0-9]?|1[013-9][0-9]|12[0-689]|2[01][0-9]|22[0-3])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[0478]|6)",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
}
# Context: words shortly before a span that speak for it, and against any span.
BEFORE = 40
CUES = {
    "email": r"(?i)\b(?:e-?mails?|contact|write|reach|address|correo|courriel|adresse)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|adresse|client|login)\b",
    "card": r"(?i)\b(?:cards?|visa|credit|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|contact|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|order|invoice|serial|sku|ref|chapter|section|page|no)\b\W*$"
LABELERS = ("rule", "known", "context")
FEATURES = ("one", *(f"{name}_{side}" for name in LABELERS for side in ("for", "against")), "loose")


def _matches(text: Column, pattern: str) -> Column:
    """Matches as (start, end, found), in code points: what lies between them is
    measured by splitting at the same pattern."""
    pairs = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(None).cast("array<struct<start:int,end:int,found:string>>").alias("list"),
    )

    def step(seen: Column, pair: Column) -> Column:
        first = seen["at"] + F.length(pair["0"])
        end = first + F.length(pair["1"])
        here = F.array(F.struct(first.alias("start"), end.alias("end"), pair["1"].alias("found")))
        grown = F.when(seen["list"].isNull(), here).otherwise(F.concat(seen["list"], here))
        return F.when(pair["1"].isNull(), seen).otherwise(
            F.struct(end.alias("at"), grown.alias("list"))
        )

    return F.aggregate(pairs, start, step, lambda seen: seen["list"])


def _valid(kind: str, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    return {
        "email": F.lit(True),
        "ip": found.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": F.call_function("luhn_check", digits),
        "phone": F.length(digits).between(10, 15),
    }[kind]


def _votes(text: Column, kind: str, found: Column, loose: bool) -> Column:
    """A candidate with the votes of the labelers: 1 for, -1 against, 0 none."""
    word = found["found"]
    base = F.lit(False) if loose else _valid(kind, word)
    before = F.substring(
        text, F.greatest(found["start"] - BEFORE, F.lit(0)) + 1, F.least(found["start"], F.lit(BEFORE))
    )
    plain = F.regexp_replace(word, r"[\x20-]", "") if kind == "card" else word
    return F.struct(
        found["start"].alias("start"),
        F.lit(KINDS.index(kind)).alias("kind"),
        found["end"].alias("end"),
        base.alias("base"),
        F.lit(loose).alias("loose"),
        F.when(base, 1).when(F.lit(loose), 0).otherwise(-1).alias("rule"),
        F.when(plain.rlike(KNOWN[kind]), 1).otherwise(-1).alias("known"),
        F.when(before.rlike(AGAINST), -1).when(before.rlike(CUES[kind]), 1).otherwise(0).alias("context"),
    )


def _voter(text: Column, kind: str, loose: bool) -> Callable[[Column], Column]:
    return lambda found: _votes(text, kind, found, loose)


def with_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``candidates``: every span that a labeler looked at, by start.

    Loose ones that overlap a base span are left out. Null and empty texts have
    none.
    """
    column = F.col(text).cast("string")
    parts = {}
    for loose, patterns in ((False, BASE), (True, LOOSE)):
        for kind, pattern in patterns.items():
            # Only texts that can have a match are taken apart.
            found = F.when(column.rlike(NEEDED[kind]) & column.rlike(pattern), _matches(column, pattern))
            parts[f"_{kind}_{int(loose)}"] = found
    rows = docs.withColumns(parts)
    lists = []
    for name in parts:
        kind, loose = name[1:-2], name.endswith("1")
        lists.append(F.coalesce(F.transform(F.col(name), _voter(column, kind, loose)), F.array()))
    rows = rows.withColumn("_all", F.concat(*lists)).drop(*parts)
    base = F.filter("_all", lambda x: x["base"])
    rows = rows.withColumn("_base", base)
    clear = F.filter(
        "_all",
        lambda x: ~x["loose"]
        | ~F.exists("_base", lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])),
    )
    return rows.withColumn("candidates", F.array_sort(clear)).drop("_all", "_base")


# --- what is learned ---------------------------------------------------------


@dataclass(frozen=True)
class Pattern:
    """Candidates of equal kind and votes, and how many there are."""

    kind: int
    loose: bool
    votes: tuple[int, ...]
    n: int


def reliabilities(patterns: Sequence[Pattern], rounds: int = 50) -> list[float]:
    """P(personal data) of each pattern by expectation-maximisation.

    Each kind has a share of true spans, and each labeler a distribution of votes
    on true and on false ones; they start from the mean of the votes and are
    estimated in turn from each other.
    """
    p = [min(0.95, max(0.05, 0.5 + sum(x.votes) / (2 * len(x.votes)))) for x in patterns]
    for _ in range(rounds):
        share = {}
        table = {}
        for kind in {x.kind for x in patterns}:
            own = [(x, q) for x, q in zip(patterns, p, strict=True) if x.kind == kind]
            total = sum(x.n for x, _ in own)
            share[kind] = (1 + sum(x.n * q for x, q in own)) / (2 + total)
            for labeler in range(len(LABELERS)):
                for truth in (0, 1):
                    # A labeler is taken to be better than chance before anything is seen.
                    mass = {v: 4.0 if v == 2 * truth - 1 else 1.0 for v in (-1, 0, 1)}
                    for x, q in own:
                        mass[x.votes[labeler]] += x.n * (q if truth else 1 - q)
                    whole = sum(mass.values())
                    table[kind, labeler, truth] = {v: m / whole for v, m in mass.items()}
        p = []
        for x in patterns:
            odds = math.log(share[x.kind] / (1 - share[x.kind]))
            for labeler, vote in enumerate(x.votes):
                odds += math.log(table[x.kind, labeler, 1][vote] / table[x.kind, labeler, 0][vote])
            p.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
    return p


def _inputs(pattern: Pattern) -> list[float]:
    sides = [float(v == side) for v in pattern.votes for side in (1, -1)]
    return [1.0, *sides, float(pattern.loose)]


def classifier(patterns: Sequence[Pattern], p: Sequence[float], rounds: int = 300) -> dict[int, list[float]]:
    """Weights per kind of a logistic regression on the estimated truths."""
    weights = {}
    for kind in range(len(KINDS)):
        own = [(_inputs(x), x.n, q) for x, q in zip(patterns, p, strict=True) if x.kind == kind]
        total = sum(n for _, n, _ in own)
        w = [0.0] * len(FEATURES)
        for _ in range(rounds if total else 0):
            grad = [-1e-3 * v for v in w]
            for x, n, q in own:
                guess = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x, strict=True))))
                for k, v in enumerate(x):
                    grad[k] += n / total * (q - guess) * v
            w = [v + 2 * g for v, g in zip(w, grad, strict=True)]
        weights[kind] = w
    return weights


def train(docs: DataFrame, text: str = "text") -> dict[int, list[float]]:
    """The classifier, from the votes on all candidates of all documents."""
    found = with_candidates(docs.select(text), text).select(F.explode("candidates").alias("x"))
    counts = found.groupBy("x.kind", "x.loose", *[f"x.{name}" for name in LABELERS]).count()
    patterns = [
        Pattern(row.kind, row.loose, tuple(row[name] for name in LABELERS), row["count"])
        for row in counts.collect()
    ]
    patterns.sort(key=lambda x: (x.kind, x.loose, x.votes))
    return classifier(patterns, reliabilities(patterns))


def _accepted(x: Column, weights: dict[int, list[float]]) -> Column:
    total = None
    for kind, w in weights.items():
        own = F.lit(w[0])
        for n, name in enumerate(LABELERS):
            own = own + F.when(x[name] == 1, w[2 * n + 1]).when(x[name] == -1, w[2 * n + 2]).otherwise(0.0)
        own = own + F.when(x["loose"], w[-1]).otherwise(0.0)
        total = F.when(x["kind"] == kind, own) if total is None else total.when(x["kind"] == kind, own)
    return total > 0


def find(docs: DataFrame, weights: dict[int, list[float]], text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: (start, kind, end, base), by start, then kind.

    Spans of the base rules are always there; others where the classifier takes
    them. ``kind`` is the place in ``KINDS``; offsets are code points, end
    exclusive. Spans of different kinds may overlap.
    """
    kept = F.filter("candidates", lambda x: x["base"] | _accepted(x, weights))
    shown = F.transform(
        kept,
        lambda x: F.struct(*[x[name].alias(name) for name in ("start", "kind", "end", "base")]),
    )
    return with_candidates(docs, text).withColumn("spans", shown).drop("candidates")


def of_kind(spans: Column, kind: str) -> Column:
    """The number of base spans of one kind."""
    place = KINDS.index(kind)
    return F.size(F.filter(spans, lambda x: x["base"] & (x["kind"] == place))).cast("long")


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    name = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["start"], x["end"])), ","
    )


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, as a tag of its kind."""
    tags = F.array(*[F.lit(f"<{kind.upper()}>") for kind in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("done"))

    def step(seen: Column, x: Column) -> Column:
        gap = F.substring(text, seen["at"] + 1, x["start"] - seen["at"])
        return F.when(
            x["start"] >= seen["at"],
            F.struct(x["end"].alias("at"), F.concat(seen["done"], gap, tags[x["kind"]]).alias("done")),
        ).otherwise(F.struct(F.greatest(seen["at"], x["end"]).alias("at"), seen["done"].alias("done")))

    def finish(seen: Column) -> Column:
        return F.concat(seen["done"], F.substring(text, seen["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)


def mask(docs: DataFrame) -> DataFrame:
    """Documents with personal data replaced by tags, in the same columns.

    ``n_chars``, where there is one, counts anew for changed texts. No document
    goes; null and empty texts stay as they are.
    """
    names = docs.columns
    inner = docs.toDF(*[name if name == "text" else f"_c{n}" for n, name in enumerate(names)])
    found = find(inner, train(docs)).withColumn("_masked", masked(F.col("text"), F.col("spans")))
    made = []
    for n, name in enumerate(names):
        if name == "text":
            made.append(F.col("_masked").alias(name))
        elif name == "n_chars":
            counted = F.when(F.size("spans") > 0, F.length("_masked")).otherwise(F.col(f"_c{n}"))
            made.append(counted.cast(docs.schema[name].dataType).alias(name))
        else:
            made.append(F.col(f"_c{n}").alias(name))
    return found.select(*made)
