"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text is built. A text is parsed against each automaton
into longest matches (phrases); the language whose text gives the fewest phrases, each weighted with
the bits that point into its training text, wins.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import remainder

UNKNOWN = "und"
#: Bounds of the labelled sample: rows read per language, characters over all languages and per language, and from one row.
SAMPLE_ROWS, TOTAL_CHARS, LANGUAGE_CHARS, ROW_CHARS = 600, 240_000, 30_000, 1_000
CLASSES = 64
BLOCK = 1024


@dataclass
class LanguageModel:
    languages: list[str]
    classes: np.ndarray  # code point -> class, for code points below its length
    table: np.ndarray  # flat transitions: (next state's row << 1) | phrase ended
    roots: np.ndarray  # row of each language's root in the flat table
    bits: np.ndarray  # bits of a phrase: log2 of the training length


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts exactly the substrings of ``codes``."""
    moves, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return moves


def _normal(text: str) -> str:
    return " ".join(text.lower().split())


def build_model(samples: dict[str, list[str]]) -> LanguageModel:
    """Model of labelled texts per language. Code points outside the ``CLASSES`` - 1 most frequent share a class."""
    languages = sorted(samples)
    share = min(LANGUAGE_CHARS, TOTAL_CHARS // max(1, len(languages)))
    texts = {}
    for language in languages:
        picked, size = [], 0
        for text in dict.fromkeys(samples[language]):
            if size >= share:
                break
            picked.append(_normal(text)[: share - size])
            size += len(picked[-1]) + 1
        texts[language] = " ".join(picked)
    counts = Counter()
    for text in texts.values():
        counts.update(text)
    kept = sorted(c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: CLASSES - 1])
    classes = np.zeros(max([0x250, *(ord(c) + 1 for c in kept)]), dtype=np.int32)
    for k, c in enumerate(kept, 1):
        classes[ord(c)] = k
    for c in "\t\n\x0b\x0c\r":
        classes[ord(c)] = classes[0x20]
    tables, roots, rows = [], [], 0
    for language in languages:
        moves = suffix_automaton(classes[[ord(c) if ord(c) < len(classes) else 0 for c in texts[language]]].tolist())
        states = np.full((len(moves), CLASSES), -1, dtype=np.int32)
        for s, row in enumerate(moves):
            states[s, list(row)] = list(row.values())
        start = np.where(states[0] >= 0, states[0], 0)
        # a step that leaves the automaton ends the phrase and starts the next; so does an unknown character at the root
        ended = states < 0
        states = np.where(ended, start[None, :], states)
        tables.append(((states + rows) * (2 * CLASSES) + ended).ravel())
        roots.append(rows * CLASSES)
        rows += len(moves)
    flat = np.concatenate(tables) if tables else np.zeros(0, dtype=np.int32)
    bits = np.log2([max(2, len(texts[x])) for x in languages]) if languages else np.zeros(0)
    return LanguageModel(languages, classes, flat.astype(np.int32, copy=False), np.array(roots, dtype=np.int32), bits)


def fit(docs: DataFrame, modulus: int = 4, held_out: int = 2) -> LanguageModel:
    """Learn from text and lang of rows outside the held-out fold: a sample by hash of the id, at most
    about SAMPLE_ROWS rows per language. Languages whose rows have no text are not learned."""
    may = docs.select("doc_id", "lang", "text").where(
        F.col("lang").isNotNull() & (remainder("doc_id", modulus) != held_out) & F.col("text").rlike(r"\p{L}")
    )
    counts = {r.lang: r.n for r in docs.where(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return build_model({})
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1, SAMPLE_ROWS / n) * (1 << 30))))])
    rows = (
        may.where(draw < share[F.col("lang")])
        .select("lang", "doc_id", F.substring("text", 1, ROW_CHARS).alias("text"))
        .collect()
    )
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, (r.doc_id * 0x9E3779B97F4A7C15) % (1 << 64), r.text)):
        samples.setdefault(r.lang, []).append(r.text)
    return build_model(samples)


def phrase_counts(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Phrases of each text (rows) against each language (columns).

    Texts are parsed in blocks of ``BLOCK`` characters, all blocks side by side; a phrase ends with its block.
    """
    out = np.zeros((len(texts), len(model.languages)), dtype=np.int64)
    if not model.languages or not texts:
        return out
    sizes = np.array([len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < len(model.classes), codes, 1)  # code point 1 has class 0
    codes = model.classes[codes]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(texts)), blocks)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = begins[owner] + inner * BLOCK
    length = np.minimum(BLOCK, begins[owner + 1] - start)
    order = np.argsort(-length, kind="stable")
    owner, start, length = owner[order], start[order], length[order]
    if not len(owner):
        return out
    active = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    state = np.repeat(model.roots[:, None], len(owner), axis=1)
    phrases = np.ones((len(model.languages), len(owner)), dtype=np.int32)
    for t in range(length[0]):
        n = active[t]
        step = model.table.take(state[:, :n] + codes[start[:n] + t])
        phrases[:, :n] += step & 1
        state[:, :n] = step >> 1
    for k in range(len(model.languages)):
        out[:, k] = np.bincount(owner, weights=phrases[k], minlength=len(texts))
    return out


def _posterior(model: LanguageModel, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cost = counts * model.bits
    best = cost.argmin(axis=1)
    odds = np.exp2(np.clip(cost.min(axis=1, keepdims=True) - cost, -60, 0)).sum(axis=1)
    return best, 1 / odds


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row, over whole texts; no shuffle.

    ``und`` with score 0 for texts that are null or have no letter, and for all rows if nothing was
    learned. The score is the winner's share of 2^-bits over the languages. Ties go to the language
    first in the alphabet. Repeated rows give repeated results; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            ids, texts, lettered = (batch.column(i).to_pylist() for i in range(3))
            names, scores = [UNKNOWN] * len(ids), [0.0] * len(ids)
            first = 0
            while first < len(ids):
                last, size = first, 0
                while last < len(ids) and (last == first or size < 4_000_000):
                    size += len(texts[last] or "")
                    last += 1
                rows = [i for i in range(first, last) if lettered[i]] if model.languages else []
                best, score = _posterior(model, phrase_counts(model, [texts[i].lower() for i in rows]))
                for i, b, s in zip(rows, best.tolist(), score.tolist(), strict=True):
                    names[i], scores[i] = model.languages[b], s
                first = last
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "lang_pred": names, "score": pa.array(scores, pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")
