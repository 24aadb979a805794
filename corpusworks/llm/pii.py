"""Personal data by weak supervision, in DataFrame functions only.

Strict patterns give the base spans, wider ones further candidates. Labelers (pattern rules, gazetteers, words
around, shape) vote yes, no or nothing on each candidate. How often each combination of votes occurs in the whole
corpus, a table of bounded size, is all that expectation-maximisation needs to estimate the labelers' reliabilities
without any labelled row. The posteriors are the targets of the final classifier, a logistic model over traits of a
span that is compiled to a column. Base spans always stay; other candidates are added where it says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import materialise

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Strict patterns. A search may only start where a run of its letters starts, or where the last match ended: the
# leftmost match is the same, but a long run is walked once. Possessive repeats keep the stack flat on long matches.
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
STRICT = {
    EMAIL: rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    IP: r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    EMAIL: rf"(?<!{_LOCAL}){_LOCAL}++(?: ?[(\[{{] ?(?:at|AT|@) ?[)\]}}] ?{_LABEL}++(?: ?[(\[{{] ?(?:dot|DOT|\.) ?[)\]}}] ?{_LABEL}++|\.{_LABEL}++)++"
    rf"| at {_LABEL}++(?: dot {_LABEL}++)++)",
    IP: r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])",
    CARD: r"(?<![0-9A-Za-z])[0-9](?:[\x20./-]?[0-9])++",
    PHONE: r"(?<![0-9A-Za-z+.])\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}\(?[0-9]{2,5}\)?){1,6}(?![0-9A-Za-z])",
}
#: A cheap test that every text with a match passes.
_HINT = {
    EMAIL: lambda t: t.contains("@"),
    IP: lambda t: t.rlike(r"[0-9]\.[0-9]"),
    CARD: lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    PHONE: lambda t: t.contains("+"),
}
_WIDE_HINT = {
    EMAIL: lambda t: t.contains(" dot ") | t.rlike(r"[(\[{] ?(?:at|AT|@) ?[)\]}]"),
    IP: lambda t: t.rlike(r":[0-9A-Fa-f]{0,4}:"),
    CARD: lambda t: t.rlike(r"[0-9](?:[\x20./-]?[0-9]){12}"),
    PHONE: lambda t: t.rlike(r"[0-9][\x20./()-]{1,3}[0-9]"),
}

# Gazetteers and words around, fixed values.
_TOP_LEVEL = "com org net edu gov mil int info io dev app biz name me co uk de fr es it nl be at ch se no dk fi pl pt ie us ca mx br ar cl in cn jp kr au nz za ru eu test example"
_CALLING = "1|7|2[0-9]{1,2}|3[0-9]{1,2}|4[0-9]{1,2}|5[0-9]{1,2}|6[0-9]{1,2}|8[0-9]{1,2}|9[0-9]{1,2}"
_ISSUERS = "4[0-9]{12}|4[0-9]{15}|4[0-9]{18}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3(?:0[0-5]|[68][0-9])[0-9]{11}|6(?:011|5[0-9]{2})[0-9]{12}|35[0-9]{14}"
_CUES = {
    EMAIL: "mail|correo|courriel|contact|write to|schreib|escrib|kontakt",
    IP: "\\bip\\b|\\bhost|address|server|login|from client|adresse|direcci",
    CARD: "card|visa|master|amex|credit|kredit|karte|carte|tarjeta|payment",
    PHONE: "phone|\\btel|\\bcall\\b|mobile|\\bcell\\b|\\bfax\\b|handy|telefon|appel|llam|móvil",
}
_COUNTER_CUES = r"version|\bv$|isbn|order|invoice|serial|\bid\b|token|hash|commit|build|chapter|section|figure|price|date|total|page|[#$€£§=]\s*$"

VOTERS = 4
#: Sizes of the traits of a span; their product bounds the table that the classifier is trained on.
TRAITS = (3, 6, 4, 4, 4, 4, 8)
_BLOCK = 256


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(sizes: Column) -> Column:
    """Sum of the sizes before each one. Totals of blocks come first, so long lists are not copied step by step."""

    def grow(start: Column, part: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))

    def block(b: Column) -> Column:
        return F.slice(sizes, b * _BLOCK + 1, F.lit(_BLOCK))

    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(sizes) / _BLOCK).cast("int") - 1, F.lit(0)))
    totals = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0).cast("long"), lambda a, x: a + x))
    offsets = grow(F.lit(0).cast("long"), totals)
    inside = _let(offsets, lambda o: F.transform(blocks, lambda b: F.slice(grow(o[b], block(b)), F.lit(1), F.greatest(F.size(block(b)), F.lit(1)))))
    return F.flatten(inside)


def _none(fields: str) -> Column:
    return F.from_json(F.lit("[]"), f"array<struct<{fields}>>")


_PLACE = "start long, hit string, before string, after string"


def _places(hits: Column, gaps: Column) -> Column:
    """start, hit, before (up to 32 letters), after (up to 8) of every hit between its gaps."""
    sizes = F.transform(hits, lambda h, i: (F.length(gaps[i]) + F.length(h)).cast("long"))
    place = lambda starts: F.transform(
        hits,
        lambda h, i: F.struct(
            (starts[i] + F.length(gaps[i])).cast("long").alias("start"),
            h.alias("hit"),
            F.lower(F.right(gaps[i], F.lit(32))).alias("before"),
            F.left(gaps[i + 1], F.lit(8)).alias("after"),
        ),
    )
    return F.when(F.size(hits) > 0, _let(_running(sizes), place)).otherwise(_none(_PLACE))


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def worth(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def _small_parts(hit: Column) -> Column:
    return F.forall(F.split(hit, r"\."), lambda p: _let(F.ltrim(p, F.lit("0")), lambda s: (F.length(s) <= 3) & (F.lpad(s, 3, "0") <= "255")))


def valid(kind: int, hit: Column) -> Column:
    """Whether a match of the strict pattern is a base span."""
    if kind == IP:
        return _small_parts(hit)
    if kind == CARD:
        return _let(_digits(hit), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == PHONE:
        return F.length(_digits(hit)).between(9, 15)
    return F.lit(True)


def _worth_a_vote(kind: int, hit: Column) -> Column:
    """Whether a match of the wide pattern is a candidate at all."""
    n = F.length(_digits(hit))
    if kind == IP:
        return F.length(F.regexp_replace(hit, ":", "")) >= 4
    if kind == CARD:
        return n.between(13, 19)
    if kind == PHONE:
        return n.between(7, 12)
    return F.lit(True)


# --- labelers: 1 yes, 2 no, 0 nothing ------------------------------------------------------------------------------------


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, 2).otherwise(0)


def _date(hit: Column) -> Column:
    return hit.rlike("^(?:[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{2}[./-][0-9]{2}[./-][0-9]{4})$")


def _rule(kind: int, base: bool, hit: Column) -> Column:
    """Vote of the form: check digits, groups that telephone numbers have, dates and times."""
    digits, never = _digits(hit), F.lit(False)
    if base:
        return F.lit(1)
    if kind == EMAIL:
        return _vote(hit.rlike(r"[(\[{]"), never)
    if kind == IP:
        return _vote(hit.rlike("[A-Fa-f]") & hit.rlike("::|(?:[0-9A-Fa-f]+:){7}"), hit.rlike("^[0-9]{1,2}:[0-9]{2}:[0-9]{2}$|^(?:[0-9A-Fa-f]{2}:){5}"))
    if kind == CARD:
        return _vote(never, ~_luhn(digits) | hit.contains("."))
    groups = hit.rlike(r"^\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[.\x20-][0-9]{4}$|^\(?0[0-9]+\)?[\x20./-]")
    return _vote(groups & ~_date(hit), _date(hit) | (F.length(digits) < 9))


def _votes(kind: int, base: bool, p: Column) -> Column:
    hit, digits = p["hit"], _digits(p["hit"])
    if kind == EMAIL:
        last = F.lower(F.regexp_extract(hit, "([A-Za-z]+)$", 1))
        known = last.isin(*_TOP_LEVEL.split())
        gazetteer = _vote(known, ~known)
    elif kind == IP:
        gazetteer = _vote(hit.rlike("^(?:10|127|192|172)\\."), hit.rlike("^(?:[0-9]\\.){3}[0-9]$|^0|^:*$"))
    elif kind == CARD:
        known = digits.rlike(f"^(?:{_ISSUERS})$")
        gazetteer = _vote(known, ~known)
    else:
        known = digits.rlike(f"^(?:{_CALLING})") if base else digits.rlike(f"^00(?:{_CALLING})|^0[1-9]") & ~_date(hit)
        gazetteer = _vote(known, _date(hit) | (F.lit(base) & ~known))
    around = _vote(p["before"].rlike(_CUES[kind]), p["before"].rlike(_COUNTER_CUES))
    glued = p["before"].rlike(r"[\p{L}0-9_/=-]$") | p["after"].rlike(r"^[\p{L}0-9_/=]")
    same = F.length(digits) >= 7
    dull = same & digits.rlike(r"^([0-9])\1+$|^0?123456")
    return (((_rule(kind, base, hit) * 3 + gazetteer) * 3 + around) * 3 + _vote(F.lit(False), glued | dull)).cast("int")


def _traits(kind: int, base: bool, p: Column) -> Column:
    """One number for the traits of a span: whether its form checks, its length, separators, letters, what stands next to it, the word before."""
    hit = p["hit"]
    side = lambda c: F.when(c.rlike("^$|^\\s"), 0).when(c.rlike(r"^\p{L}"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)
    parts = [
        _rule(kind, base, hit),
        F.least(F.floor(F.length(hit) / 5), F.lit(5)),
        F.least(F.length(F.regexp_replace(hit, r"[^\x20()./:-]", "")), F.lit(3)),
        F.least(F.floor(F.length(F.regexp_replace(hit, "[^A-Za-z]", "")) / 3), F.lit(3)),
        side(F.right(p["before"], F.lit(1))),
        side(F.left(p["after"], F.lit(1))),
        F.crc32(F.regexp_extract(p["before"], r"(\p{L}+)[^\p{L}]*$", 1).cast("binary")) % TRAITS[-1],
    ]
    total = F.lit(0)
    for part, size in zip(parts, TRAITS, strict=True):
        total = total * size + part.cast("int")
    return total.cast("int")


# --- candidates ----------------------------------------------------------------------------------------------------------


def _hits(text: Column, pattern: str, hint: Column) -> Column:
    return F.when(hint, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _gaps(text: Column, pattern: str, hits: Column) -> Column:
    return F.when(F.size(hits) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>"))


def _candidates(kind: int, base: bool, places: Column) -> Column:
    keep = valid if base else _worth_a_vote
    return F.transform(
        F.filter(places, lambda p: keep(kind, p["hit"])),
        lambda p: F.struct(
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            p["start"].alias("start"),
            (p["start"] + F.length(p["hit"])).alias("stop"),
            _votes(kind, base, p).alias("votes"),
            _traits(kind, base, p).alias("traits"),
        ),
    )


def _masked(text: Column, kind: int, hits: Column) -> Column:
    """The text with base spans of a kind blotted out, so that wide patterns do not meet them."""
    blot = F.lit("\u0001")
    again = _hits(text, STRICT[kind], F.size(hits) > 0)

    def rebuilt(found: Column) -> Column:
        gaps = F.split(text, STRICT[kind], -1)
        parts = F.transform(found, lambda h: F.when(valid(kind, h), F.repeat(blot, F.length(h))).otherwise(h))
        return _let(gaps, lambda g: F.concat(F.array_join(F.transform(parts, lambda x, i: F.concat(g[i], x)), ""), F.element_at(g, -1)))

    return F.when(F.size(hits) > 0, _let(again, lambda f: F.when(F.size(f) > 0, rebuilt(f)).otherwise(text))).otherwise(text)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, found (kind, base, start, stop, votes, traits) of every row; places count code points from 0."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    for base, patterns, hint in ((True, STRICT, _HINT), (False, WIDE, _WIDE_HINT)):
        mark = "b" if base else "w"
        text = F.col("t" if base else "m")
        rows = rows.select("*", *[_hits(text, patterns[k], hint[k](text)).alias(f"{mark}h{k}") for k in range(4)])
        rows = rows.select("*", *[_gaps(text, patterns[k], F.col(f"{mark}h{k}")).alias(f"{mark}g{k}") for k in range(4)])
        if base:
            for k in range(4):
                rows = rows.withColumn("m", _masked(F.col("m" if k else "t"), k, F.col(f"bh{k}")))
    marks = [(m, k) for m in "bw" for k in range(4)]
    rows = rows.select("doc_id", *[_places(F.col(f"{m}h{k}"), F.col(f"{m}g{k}")).alias(f"{m}{k}") for m, k in marks])
    return rows.select("doc_id", F.concat(*[_candidates(k, m == "b", F.col(f"{m}{k}")) for m, k in marks]).alias("found"))


# --- reliabilities and classifier ----------------------------------------------------------------------------------------

_PATTERNS = np.array(np.unravel_index(np.arange(3**VOTERS), (3,) * VOTERS)).T


def posteriors(counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Probability of yes per combination of votes, reliabilities (labeler, truth, vote) and the share of yes.

    ``counts`` says how often each combination occurs. Pseudo-counts state that a vote is right more often than
    not; they also decide where nothing occurs.
    """
    lean = (_PATTERNS == 1).sum(axis=1) - (_PATTERNS == 2).sum(axis=1)
    yes = np.clip(0.5 + 0.4 * lean / VOTERS, 0.05, 0.95)
    prior = np.array([[2.0, 1.0, 3.0], [2.0, 3.0, 1.0]])  # truth no, yes; vote none, yes, no
    for _ in range(rounds):
        table = np.empty((VOTERS, 2, 3))
        for j in range(VOTERS):
            for truth, weight in ((0, 1 - yes), (1, yes)):
                table[j, truth] = prior[truth] + np.bincount(_PATTERNS[:, j], weights=counts * weight, minlength=3)
        table /= table.sum(axis=2, keepdims=True)
        share = (1 + (counts * yes).sum()) / (2 + counts.sum())
        odds = np.log(share / (1 - share)) + sum(np.log(table[j, 1, _PATTERNS[:, j]] / table[j, 0, _PATTERNS[:, j]]) for j in range(VOTERS))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        moved, yes = np.abs(new - yes).max(), new
        if moved < 1e-9:
            break
    return yes, table, float(share)


def _logistic(traits: np.ndarray, n: np.ndarray, yes: np.ndarray, penalty: float = 1.0) -> tuple[float, list[list[float]]]:
    """Bias and one weight per value of each trait, by Newton steps on rows that stand for ``n`` spans each."""
    values = np.array(np.unravel_index(traits, TRAITS)).T
    offsets = np.cumsum([1, *TRAITS])[:-1]
    x = np.zeros((len(traits), 1 + sum(TRAITS)))
    x[:, 0] = 1
    for j, at in enumerate(offsets):
        x[np.arange(len(x)), at + values[:, j]] = 1
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (yes - n * p) - ridge * w
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge), slope)
        w += step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), [w[at : at + size].tolist() for at, size in zip(offsets, TRAITS, strict=True)]


@dataclass
class Model:
    reliabilities: dict[int, np.ndarray]
    bias: dict[int, float]
    weights: dict[int, list[list[float]]]

    def score(self, span: Column) -> Column:
        """Probability that a candidate is personal data."""
        numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])
        total, rest = numbers([self.bias[k] for k in range(4)])[span["kind"]], span["traits"]
        for j in range(len(TRAITS) - 1, -1, -1):
            flat = numbers([v for k in range(4) for v in self.weights[k][j]])
            total = total + flat[span["kind"] * TRAITS[j] + rest % TRAITS[j]]
            rest = F.floor(rest / TRAITS[j]).cast("int")
        return 1 / (1 + F.exp(-total))


def fit(found: DataFrame) -> Model:
    """Reliabilities and classifier from all candidates. The driver gets counts per combination of votes and of traits."""
    spans = found.select(F.explode("found").alias("s")).select("s.*")
    counts = np.zeros((4, 3**VOTERS))
    for r in spans.groupBy("kind", "votes").count().collect():
        counts[r.kind, r.votes] = r["count"]
    solved = [posteriors(c) for c in counts]
    flat = F.array(*[F.lit(float(p)) for yes, _, _ in solved for p in yes])
    rows = spans.groupBy("kind", "traits").agg(F.count("*").alias("n"), F.sum(flat[F.col("kind") * 3**VOTERS + F.col("votes")]).alias("yes")).collect()
    model = Model({k: s[1] for k, s in enumerate(solved)}, {}, {})
    for k in range(4):
        mine = [r for r in rows if r.kind == k]
        model.bias[k], model.weights[k] = _logistic(*(np.array([r[c] for r in mine], dtype=t) for c, t in (("traits", int), ("n", float), ("yes", float))))
    return model


def detect(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, spans (kind, start, stop, base, score) of every row, by kind as listed in KINDS, then start.

    A null text counts as empty and has no spans, a null or repeated doc_id is kept row by row, other columns are
    ignored, no rows give no rows. Texts are read once: candidates, which are small, are written out first.
    """
    found = materialise(candidates(docs), "personal-data")
    model = fit(found)
    scored = F.transform("found", lambda s: F.struct(s["kind"].alias("k"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base"), model.score(s).alias("score")))
    chosen = F.array_sort(F.filter(scored, lambda s: s["base"] | (s["score"] >= least)))
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(chosen, lambda s: F.struct(names[s["k"]].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["base"].alias("base"), s["score"].alias("score")))
    return found.select("doc_id", named.alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:stop of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
