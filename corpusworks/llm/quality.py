"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees grown on a labelled sample give paths; each path is a conjunctive rule. Lasso logistic
regression keeps few of them, and the kept rules become one Spark column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import labelled_sample

#: Bound of the labelled sample, and the shape of the ensemble.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, SHRINK, LEAST_ROWS = 24, 3, 32, 0.3, 10
LASSO, STEPS = 0.001, 800

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is above, threshold) joined by and


def statistics() -> dict[str, Column]:
    """Statistics of a row's ``text`` and ``_words``, each null-free."""
    text, words = F.col("text"), F.col("_words")
    chars, n = F.greatest(F.length(text), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    lines = F.regexp_count(text, F.lit("\n")) + 1

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    same = F.aggregate(
        words,
        F.struct(F.lit("").alias("last"), F.lit(0).alias("n")),
        lambda acc, w: F.struct(w.alias("last"), (acc["n"] + (w == acc["last"]).cast("int")).alias("n")),
        lambda acc: acc["n"],
    )
    return {
        "chars": F.length(text).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": F.length(text) / n,
        "different_words": F.size(F.array_distinct(words)) / n,
        "repeated_next": same / n,
        "capitals": share("\\p{Lu}"),
        "digits": share("[0-9]"),
        "stops": share("[.,;:]"),
        "exclamations": share("[!?]"),
        "symbols": share("[^\\p{L}\\p{N}\\s.,;:!?'\"()-]"),
        "bars": share("[|<>{}\\[\\]]"),
        "line_length": F.length(text) / lines,
    }


def with_statistics(docs: DataFrame, *kept: Column) -> DataFrame:
    """The ``kept`` columns (doc_id if none are named) and one double per statistic; a null text counts as empty."""
    kept = kept or (F.col("doc_id").cast("long").alias("doc_id"),)
    rows = docs.select(F.struct(*kept).alias("_kept"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("_words", F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != ""))
    return rows.select("_kept", *[c.cast("double").alias(k) for k, c in statistics().items()])


@dataclass
class RuleModel:
    names: list[str]
    base: float = 0.0
    rules: list[tuple[float, Rule]] = field(default_factory=list)

    def score(self) -> Column:
        """The ensemble as a column over the statistics."""
        total = F.lit(self.base)
        for weight, rule in self.rules:
            held = F.lit(True)
            for k, above, at in rule:
                held = held & ((F.col(self.names[k]) > at) if above else (F.col(self.names[k]) <= at))
            total = total + F.when(held, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _grow(bins: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, rows: np.ndarray, path: Rule, out: list) -> None:
    """Split ``rows`` where the fit gains most; adds (path, rows, value) of each leaf, and inner paths without value."""
    value = slope[rows].sum() / (weight[rows].sum() + 1)
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
        g, h = slope[rows], weight[rows]
        whole = g.sum() ** 2 / (h.sum() + 1)
        for k in range(bins.shape[1]):
            b = bins[rows, k]
            gs, hs = np.bincount(b, g, BINS + 1).cumsum()[:-1], np.bincount(b, h, BINS + 1).cumsum()[:-1]
            ns = np.bincount(b, minlength=BINS + 1).cumsum()[:-1]
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
            gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = 0
            at = int(gain.argmax())
            if at < len(edges[k]) and gain[at] > best[0]:
                best = (gain[at], (k, at))
    if best[1] is None:
        out.append((path, rows, value))
        return
    k, at = best[1]
    threshold, low = float(edges[k][at]), bins[rows, k] <= at
    for above, part in ((False, rows[low]), (True, rows[~low])):
        step = (*path, (k, above, threshold))
        if len(step) < DEPTH:
            out.append((step, part, None))
        _grow(bins, edges, slope, weight, part, step, out)


def _rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct paths of boosted trees."""
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    z, found = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(TREES):
        p, nodes = _sigmoid(z), []
        _grow(bins, edges, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), (), nodes)
        for path, rows, value in nodes:
            if path:
                found[path] = None
            if value is not None:
                z[rows] += SHRINK * np.clip(value, -4, 4)
    return list(found)


def _holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for k, above, at in rule:
        out &= (x[:, k] > at) if above else (x[:, k] <= at)
    return out


def _lasso(a: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic weights with an l1 penalty, by accelerated proximal gradient; the base is not penalised."""
    a = np.hstack([np.ones((len(a), 1)), a])
    w = v = np.zeros(a.shape[1])
    v = w.copy()
    pace = 4 * len(y) / (np.linalg.norm(a.T @ a, 2) + 1e-9)
    t = 1.0
    for _ in range(STEPS):
        new = v - pace * (a.T @ (_sigmoid(a @ v) - y)) / len(y)
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - pace * LASSO, 0)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w, v, t = new, new + (t - 1) / nt * (new - w), nt
    return float(w[0]), w[1:]


def fit_rows(names: list[str], x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules and weights of labelled statistics. With no rows, or one label only, the score is a constant
    near that label (0.5 without rows)."""
    if len(y) == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(names, float(np.log(share / (1 - share))))
    rules = _rules(x, y)
    if not rules:
        return RuleModel(names, float(np.log(y.mean() / (1 - y.mean()))))
    base, weights = _lasso(np.stack([_holds(x, r) for r in rules], axis=1).astype(float), y)
    return RuleModel(names, base, [(float(w), r) for w, r in zip(weights, rules, strict=True) if abs(w) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, most: int = SAMPLE_ROWS) -> RuleModel:
    """Learn ``labels.quality`` from at most about ``most`` labelled rows outside the held-out fold."""
    names = list(statistics())
    chosen = labelled_sample(labels, "quality", modulus, held_out, most)
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = with_statistics(labelled, F.col("label")).select("_kept.label", *names).toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)  # the fit must not depend on row order
    return fit_rows(names, rows[names].to_numpy(float), rows["label"].to_numpy(float))


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: better) of every row; a projection without shuffle.

    Null and empty texts are scored by their statistics, all zero. Repeated rows give repeated
    results; other columns are ignored.
    """
    return with_statistics(docs).select("_kept.doc_id", model.score().alias("score"))


def accept(docs: DataFrame, model: RuleModel, least: float = 0.7) -> DataFrame:
    """The rows, with all their columns, that score ``least`` or more."""
    judged = with_statistics(docs, *[F.col(f"`{c}`") for c in docs.columns]).where(model.score() >= least)
    return judged.select("_kept.*")
