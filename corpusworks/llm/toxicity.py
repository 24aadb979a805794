"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic score over its words and
word beginnings; noisy-or joins them to the document's probability: 1 - prod(1 - p). Only document
labels are learned from; the sentence scores then tell where the offence is. Weights start from the
log odds of each feature and leave them only as far as the documents demand, so words that often come
together each keep their own evidence.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import labelled_sample

#: Bounds of the labelled sample and of the features chosen from it.
SAMPLE_ROWS, FEATURES = 12_000, 4_000
#: Least log-likelihood ratio (G²) of a feature; chance gives 14 to about one feature in 5,000.
EVIDENCE = 14.0
PREFIXES = (4, 5, 7)
#: Steps, penalty on leaving the log odds, weight of the toxic documents, share of labels taken as wrong.
STEPS, LASSO, SHARE, WRONG = 400, 1e-3, 0.3, 0.01
LOWEST, HIGHEST = -12.0, 12.0

_WORD = re.compile(r"\w+")
_END = re.compile(r"[.!?\n](?:(?<=\n)\s*|\s+)")
SPAN = "array<struct<start:int,length:int,score:double>>"


@dataclass
class ToxicModel:
    base: float = LOWEST
    weights: dict[str, float] = field(default_factory=dict)


def features_of(word: str) -> list[str]:
    """The word itself, and its beginnings marked with a star."""
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def sentences(text: str) -> list[tuple[int, str]]:
    """(start, sentence) in code points: cut behind . ! ? before white space, and at line ends."""
    out, at = [], 0
    for m in _END.finditer(text):
        end = m.start() + (text[m.start()] != "\n")
        if end > at:
            out.append((at, text[at:end]))
        at = m.end()
    if at < len(text):
        out.append((at, text[at:]))
    return out


def _document_features(texts) -> list[set[str]]:
    return [{f for w in set(_WORD.findall((t or "").lower())) for f in features_of(w)} for t in texts]


def beginnings(feature: str) -> list[str]:
    """The marked beginnings that every word with ``feature`` has as well, longest first."""
    stem = feature.rstrip("*")
    return [stem[:k] + "*" for k in sorted(PREFIXES, reverse=True) if len(stem) > k]


def choose_features(labelled: DataFrame, positives: int, negatives: int) -> dict[str, float]:
    """Features that are commoner in toxic documents, with G² of EVIDENCE or more, and their log odds beyond
    those of their longest chosen beginning. A beginning as common as a longer feature is left out.

    Counts per partition are added by a shuffle on the feature; FEATURES rows at most reach the driver.
    """

    def count(batches):
        held = Counter(), Counter()
        for batch in batches:
            for label, found in zip(batch.column("label").to_pylist(), _document_features(batch.column("text").to_pylist()), strict=True):
                held[label].update(found)
            if len(held[0]) + len(held[1]) > 1_000_000:
                yield out(*held)
                held = Counter(), Counter()
        yield out(*held)

    def out(others, toxic):
        n = list(others.values()), list(toxic.values())
        return pa.RecordBatch.from_pydict(
            {
                "feature": pa.array([*others, *toxic], pa.string()),
                "others": pa.array(n[0] + [0] * len(n[1]), pa.int64()),
                "toxic": pa.array([0] * len(n[0]) + n[1], pa.int64()),
            }
        )

    counts = labelled.mapInArrow(count, "feature string, others long, toxic long")
    a, b = F.sum("toxic"), F.sum("others")
    found = counts.groupBy("feature").agg(a.alias("a"), b.alias("b")).where(F.col("a") * negatives > F.col("b") * positives)
    share, all_of = positives / (positives + negatives), F.col("a") + F.col("b")
    part = lambda n, expected: F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)
    evidence = 2 * (part(F.col("a"), all_of * share) + part(F.col("b"), all_of * (1 - share)))
    kept = found.withColumn("g", evidence).where(F.col("g") >= EVIDENCE).orderBy(F.col("g").desc(), "feature").limit(FEATURES)
    return log_odds({r.feature: (r.a, r.b) for r in kept.select("feature", "a", "b").collect()}, negatives / positives)


def log_odds(counts: dict[str, tuple[int, int]], ratio: float) -> dict[str, float]:
    """Feature → log odds beyond those of its longest beginning, of (toxic, other) document counts."""
    same = {p for f, n in counts.items() for p in beginnings(f) if counts.get(p) == n}
    odds = {f: math.log((a + 0.5) / (b + 0.5) * ratio) for f, (a, b) in sorted(counts.items()) if f not in same}
    return {f: x - next((odds[p] for p in beginnings(f) if p in odds), 0.0) for f, x in odds.items()}


def sentence_rows(labelled: DataFrame, features: dict[str, float]) -> DataFrame:
    """Per document: label, number of sentences, and the feature numbers of each sentence that has some."""
    number = {f: k for k, f in enumerate(features)}

    def run(batches):
        for batch in batches:
            rows = {"doc_id": batch.column("doc_id"), "label": batch.column("label"), "n": [], "bags": []}
            for text in batch.column("text").to_pylist():
                bags, all_of = [], sentences((text or "").lower())
                for _, s in all_of:
                    bag = {number[f] for w in set(_WORD.findall(s)) for f in features_of(w) if f in number}
                    if bag:
                        bags.append(sorted(bag))
                rows["n"].append(max(1, len(all_of)))
                rows["bags"].append(bags)
            yield pa.RecordBatch.from_arrays(
                [rows["doc_id"], rows["label"], pa.array(rows["n"], pa.int32()), pa.array(rows["bags"], pa.list_(pa.list_(pa.int32())))],
                names=list(rows),
            )

    return labelled.mapInArrow(run, "doc_id long, label int, n int, bags array<array<int>>")


def fit_bags(features: dict[str, float], labels: np.ndarray, counts: np.ndarray, bags: list[list[list[int]]]) -> ToxicModel:
    """Noisy-or likelihood by accelerated proximal gradient; toxic documents weigh SHARE of all.

    The l1 penalty holds each weight to its log odds. log(1 - P) of a document is the sum of -log(1 + e^z)
    over its sentences; sentences without features all have z = base. A label is taken to be wrong with
    chance WRONG, so one odd document cannot force a weight.
    """
    doc = np.array([d for d, x in enumerate(bags) for _ in x], dtype=np.int64)
    sent = np.array([k for k, s in enumerate(s for x in bags for s in x) for _ in s], dtype=np.int64)
    feat = np.array([f for x in bags for s in x for f in s], dtype=np.int64)
    bare = counts - np.bincount(doc, minlength=len(labels))
    weight = np.where(labels == 1, SHARE / max(1, labels.sum()), (1 - SHARE) / max(1, (1 - labels).sum()))
    odds = np.array(list(features.values()), dtype=float)
    given = np.bincount(sent, weights=odds[feat], minlength=len(doc))

    def toxic(move: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
        """Score of each sentence, probability of each document."""
        z = np.clip(base + given + np.bincount(sent, weights=move[feat], minlength=len(doc)), -30, 30)
        none = bare * np.log1p(np.exp(base)) + np.bincount(doc, weights=np.log1p(np.exp(z)), minlength=len(labels))
        return z, -np.expm1(-none)

    def loss(p: np.ndarray) -> float:
        said = WRONG + (1 - 2 * WRONG) * p
        return float(-(weight * np.log(np.where(labels == 1, said, 1 - said))).sum())

    def gradient(z: np.ndarray, p: np.ndarray, base: float) -> tuple[np.ndarray, float]:
        said = WRONG + (1 - 2 * WRONG) * p
        by_document = weight * np.where(labels == 1, -1 / said, 1 / (1 - said)) * (1 - 2 * WRONG) * (1 - p)
        by_sentence = by_document[doc] / (1 + np.exp(-z))
        by_feature = np.bincount(feat, weights=by_sentence[sent], minlength=len(odds))
        return by_feature, float(by_sentence.sum() + (by_document * bare).sum() / (1 + np.exp(-base)))

    move, base = np.zeros(len(odds)), -6.0
    ahead, ahead_base, t, curve = move, base, 1.0, 1.0
    for _ in range(STEPS):
        z, p = toxic(ahead, ahead_base)
        here, (slope, base_slope) = loss(p), gradient(z, p, ahead_base)
        while True:
            new = ahead - slope / curve
            new = np.sign(new) * np.maximum(np.abs(new) - LASSO / curve, 0)
            new_base = float(np.clip(ahead_base - base_slope / curve, LOWEST, HIGHEST))
            by, by_base = new - ahead, new_base - ahead_base
            bound = here + slope @ by + base_slope * by_base + curve / 2 * (by @ by + by_base**2)
            if loss(toxic(new, new_base)[1]) <= bound + 1e-12 or curve > 1e8:
                break
            curve *= 2
        following = (1 + math.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / following
        ahead, ahead_base = new + pull * (new - move), float(np.clip(new_base + pull * (new_base - base), LOWEST, HIGHEST))
        move, base, t, curve = new, new_base, following, max(0.9 * curve, 1e-3)
    return ToxicModel(base, {f: float(x) for f, x in zip(features, odds + move, strict=True) if abs(x) > 1e-3})


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, held_out: int = 0, most: int = SAMPLE_ROWS) -> ToxicModel:
    """Learn ``labels.toxic`` from at most about ``most`` labelled rows outside the held-out fold.

    Without rows of both labels the model is a constant near the only label, 0.5 without any.
    """
    chosen = labelled_sample(labels, "toxic", modulus, held_out, most)
    by = {r.label: r["n"] for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(by) < 2:
        share = (by.get(1, 0) + 0.5) / (sum(by.values()) + 1)
        return ToxicModel(float(np.clip(np.log(share / (1 - share)), LOWEST, HIGHEST)))
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long"), "label", "text")
    features = choose_features(labelled, by[1], by[0])
    rows = sentence_rows(labelled, features).collect()
    if not rows:
        return ToxicModel(0.0)
    rows.sort(key=lambda r: (r.doc_id, r.label, r["n"], r.bags))
    return fit_bags(features, np.array([r.label for r in rows], float), np.array([r["n"] for r in rows], float), [r.bags for r in rows])


def score(docs: DataFrame, model: ToxicModel, locate_from: float = 0.5) -> DataFrame:
    """doc_id, score, and ``offending``: sentences that alone score ``locate_from`` or more, with their place
    in code points. Every row, whole texts, no shuffle.

    Null, empty and blank texts count as one sentence without words. Repeated rows give repeated
    results; other columns are ignored.
    """
    base, weights = model.base, model.weights

    starts = {f.rstrip("*")[: min(PREFIXES)] for f in weights}

    def hits(words: set[str]) -> dict[str, float]:
        """Weights of the words that have one; most words share no beginning with any feature."""
        near = [w for w in words if w[: min(PREFIXES)] in starts]
        return {w: x for w in near if (x := sum(weights[f] for f in features_of(w) if f in weights))}

    def run(batches):
        silent = -math.log1p(math.exp(base))
        for batch in batches:
            scores, places = [], []
            for text in batch.column("text").to_pylist():
                known = hits(set(_WORD.findall((text or "").lower())))
                all_of = sentences(text) if text else []
                none, spans = max(1, len(all_of)) * silent, []
                for start, s in all_of if known else ():
                    z = sum(known[w] for w in set(_WORD.findall(s.lower())) if w in known)
                    if z:
                        z = min(30.0, max(-30.0, base + z))
                        none -= silent + math.log1p(math.exp(z))
                        if (p := 1 / (1 + math.exp(-z))) >= locate_from:
                            spans.append({"start": start, "length": len(s), "score": p})
                scores.append(-math.expm1(none))
                places.append(spans)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(places, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("score", pa.float64())])))],
                names=["doc_id", "score", "offending"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, score double, offending {SPAN}")
