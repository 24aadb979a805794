"""Mixing to target weights by soft membership.

A classifier learned from labelled rows gives each document a share of each domain. Projected
gradient descent then finds non-negative rates, how often a document is taken, so that the expected
tokens of each domain match their targets with rates as near to one as the steps allow.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusworks.llm.common import arrow_map, bounded, by_bytes, materialise, texts_of, word_groups

#: Bound of the labelled sample, buckets of word features, and the descent.
SAMPLE_ROWS, BUCKETS, SMOOTH = 10_000, 1 << 16, 0.1
STEPS, CLOSE = 60, 1e-4
#: Bytes of text hashed at once.
_PIECE = 1 << 17


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # log odds of a word bucket, buckets x domains
    prior: np.ndarray
    scale: float  # temperature: how much a text's mean log odds count per square root of its words


def _spread(texts: list[bytes]):
    """(first, last, bucket of each word, offsets) of runs of texts, in lower case (ASCII)."""
    for first, last, hashes, offsets in word_groups([t.lower() for t in texts], piece=_PIECE):
        yield first, last, (hashes % np.uint64(BUCKETS)).astype(np.int64), offsets


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0)])
    return total[offsets[1:]] - total[offsets[:-1]]


def posteriors(model: DomainModel, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Share of each domain per text (rows sum to 1), and the number of words. Without words: the prior."""
    shares, words = [], []
    for _, _, bucket, offsets in _spread(texts):
        n = np.diff(offsets)
        mean = _sums(model.weights[bucket], offsets) / np.maximum(n, 1)[:, None]
        z = np.log(model.prior) + model.scale * np.sqrt(n)[:, None] * mean
        z = np.exp(z - z.max(axis=1, keepdims=True))
        shares.append(z / z.sum(axis=1, keepdims=True))
        words.append(n)
    k = len(model.domains)
    return np.concatenate([*shares, np.empty((0, k))]), np.concatenate([*words, np.empty(0, np.int64)])


def fit(docs: DataFrame, labelled: DataFrame, most: int = SAMPLE_ROWS) -> DomainModel:
    """Learn domains from ``labelled`` (doc_id, domain), a sample of ``most`` rows at the most.

    Word counts per bucket and domain are added by a shuffle; BUCKETS rows per domain reach the driver.
    The temperature is the likeliest for the sample. Rows with a null id or domain, and ids with two
    domains, are left out. Without labelled rows there is one domain, "all".
    """
    may = labelled.select("doc_id", F.col("domain").cast("string").alias("domain")).where("doc_id is not null and domain is not null")
    chosen = bounded(may, "doc_id", most).groupBy("doc_id").agg(F.min("domain").alias("domain"), F.max("domain").alias("_other"))
    chosen = chosen.where("domain = _other").select("doc_id", "domain")
    sizes = {r.domain: r.n for r in chosen.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains = sorted(sizes) or ["all"]
    if len(domains) == 1:
        return DomainModel(domains, np.zeros((BUCKETS, 1)), np.ones(1), 1.0)
    number = {d: k for k, d in enumerate(domains)}
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "domain", "text")

    def count(batches):
        held = np.zeros((len(domains), BUCKETS), dtype=np.int64)
        for batch in by_bytes(batches):
            names = batch.column("domain").to_pylist()
            for first, last, bucket, offsets in _spread(texts_of(batch)):
                owner = np.repeat([number[d] for d in names[first:last]], np.diff(offsets))
                held += np.bincount(owner * BUCKETS + bucket, minlength=held.size).reshape(held.shape)
        d, b = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(held[d, b])], names=["d", "b", "n"])

    counts = np.full((len(domains), BUCKETS), SMOOTH)
    for r in arrow_map(rows, count, "d int, b int, n long").groupBy("d", "b").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.d, r.b] += r.n
    logs = np.log(counts / counts.sum(axis=1, keepdims=True))
    prior = np.array([sizes[d] for d in domains], float)
    model = DomainModel(domains, (logs - logs.mean(axis=0)).T.copy(), prior / prior.sum(), 1.0)
    model.scale = _temperature(model, rows, number)
    return model


def _temperature(model: DomainModel, rows: DataFrame, number: dict[str, int]) -> float:
    """The likeliest of a few scales, by sums over the labelled rows."""
    scales = [2.0**k for k in range(-6, 4)]

    def run(batches):
        for batch in by_bytes(batches):
            names, texts = batch.column("domain").to_pylist(), texts_of(batch)
            truth, losses = np.array([number[d] for d in names], dtype=np.int64), []
            for scale in scales:
                shares, _ = posteriors(DomainModel(model.domains, model.weights, model.prior, scale), texts)
                losses.append(float(-np.log(np.maximum(shares[np.arange(len(truth)), truth], 1e-9)).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(scales)), pa.int32()), pa.array(losses, pa.float64())], names=["k", "loss"])

    losses = {r.k: r.loss for r in arrow_map(rows, run, "k int, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    return scales[min(losses, key=lambda k: (round(losses[k], 6), k))] if losses else 1.0


def _lists(shares: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(shares) + 1, dtype=np.int32) * shares.shape[1]), pa.array(shares.ravel()))


def memberships(docs: DataFrame, model: DomainModel) -> DataFrame:
    """doc_id, tokens, shares (one per domain, in the model's order) of every row; whole texts, no shuffle."""

    def run(batches):
        for batch in by_bytes(batches):
            shares, words = posteriors(model, texts_of(batch))
            lists = _lists(shares)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.astype(np.int64)), lists], names=["doc_id", "tokens", "shares"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, tokens long, shares array<double>")


def rate_column(k: int, moves: list[np.ndarray]) -> Column:
    """Rate after some moves: from 1, each move subtracts the shares' product with it and stops at 0."""
    steps = F.array(*[F.array(*[F.lit(float(x)) for x in m]) for m in moves])
    dot = lambda m: sum((F.col("shares")[i] * m[i] for i in range(1, k)), F.col("shares")[0] * m[0])
    return F.aggregate(steps, F.lit(1.0), lambda w, m: F.greatest(F.lit(0.0), w - dot(m))) if moves else F.lit(1.0)


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[list[np.ndarray], list[float]]:
    """Moves of a projected gradient descent on the squared gaps between expected domain tokens and targets
    (shares of all tokens), each gap relative to its domain's own weight; and the expected shares it ends with.

    Each step is one aggregate of as many numbers as there are domains; a document's rate is a function
    of its shares and the moves so far, so no rates are stored on the way. The step size is the inverse of
    the largest eigenvalue of the domains' scaled Gram matrix, which is near one for clear-cut domains, so
    few steps are needed.
    """
    k = len(targets)
    s = [F.col("shares")[i] for i in range(k)]
    gram = members.agg(
        F.sum("tokens").alias("all"), *[F.sum(F.col("tokens") * s[i] * s[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]
    ).first()
    if not gram["all"]:
        return [], [0.0] * k
    total = float(gram["all"])
    matrix = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float) / total
    own = np.maximum(np.diag(matrix), 1e-12)
    pace = 1 / (own * max(np.linalg.eigvalsh(matrix / np.sqrt(own[:, None] * own[None, :]))[-1], 1e-9))
    goal, moves, reached = np.array(targets, float), [], np.zeros(k)
    for step in range(steps + 1):
        w = rate_column(k, moves)
        row = members.withColumn("_w", F.col("tokens") * w).agg(*[F.sum(F.col("_w") * s[i]).alias(f"t{i}") for i in range(k)]).first()
        reached = np.array([row[f"t{i}"] for i in range(k)], float) / total
        gap = reached - goal
        if np.abs(gap).max() <= CLOSE or step == steps:
            break
        moves.append(pace * gap)
    return moves, reached.tolist()


@dataclass
class Mixture:
    """A classifier and the moves that lead from rates of one to the targets."""

    model: DomainModel
    moves: list[np.ndarray]
    seed: str = "mix"
    targets: dict[str, float] = field(default_factory=dict)  # wanted share of all tokens by domain
    reached: dict[str, float] = field(default_factory=dict)  # expected share under the rates

    def missed(self, close: float = CLOSE) -> dict[str, float]:
        """Reached minus wanted share of the domains that are further off than ``close``."""
        gaps = {d: self.reached[d] - t for d, t in self.targets.items()}
        return {d: gap for d, gap in gaps.items() if abs(gap) > close}

    def rate(self) -> Column:
        """The rate as a column over ``shares``."""
        return rate_column(len(self.model.domains), self.moves)

    def copies(self) -> Column:
        """The column ``rate`` rounded down, plus one with the chance of the rest, by a hash of the id."""
        draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.lit(self.seed)), F.lit(1 << 40)) / float(1 << 40)
        return (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("long")).cast("int")


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, seed: str = "mix", steps: int = STEPS) -> tuple[Mixture, DataFrame]:
    """The mixture, and the memberships it was fitted to.

    ``targets`` are weights per learned domain, scaled to sum 1; a domain that is not named gets 0, and
    None asks for equal weights. With no labelled rows all rates are 1. The mixture tells the shares it
    reached; a warning names the domains that miss their targets after ``steps``, such as one without tokens.
    """
    model = fit(docs, labelled)
    named = targets or dict.fromkeys(model.domains, 1.0)
    weights = np.array([max(0.0, float(named.get(d, 0.0))) for d in model.domains])
    weights = weights / weights.sum() if weights.sum() else np.full(len(weights), 1 / len(weights))
    members = materialise(memberships(docs, model), "memberships")
    moves, reached = fit_rates(members, weights.tolist(), steps)
    wanted, got = (dict(zip(model.domains, shares, strict=True)) for shares in (weights.tolist(), reached))
    mixture = Mixture(model, moves, seed, wanted, got)
    if any(reached) and mixture.missed():
        warnings.warn(f"targets missed by {mixture.missed()} after {steps} steps", stacklevel=2)
    return mixture, members


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, seed: str = "mix") -> DataFrame:
    """doc_id, tokens, domain (largest share), shares, rate, copies of every row.

    ``copies`` is a whole number whose expectation is the rate. Null and empty texts have no tokens and the
    labels' overall shares; their rate counts like others'. With no rows the result is empty. Repeated
    rows are draws of the same hash. Other columns are ignored.
    """
    mixture, members = fit_mixture(docs, labelled, targets, seed)
    best = F.element_at(F.array(*[F.lit(d) for d in mixture.model.domains]), F.array_position("shares", F.array_max("shares")).cast("int"))
    rated = members.withColumn("rate", mixture.rate())
    return rated.select("doc_id", "tokens", best.alias("domain"), "shares", "rate", mixture.copies().alias("copies"))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None, seed: str = "mix") -> DataFrame:
    """The rows that are taken once or more, with all their columns, ``rate`` and ``copies``.

    Shares are computed again from the text, which costs less than bringing rates and texts together.
    """
    mixture, _ = fit_mixture(docs, labelled, targets, seed)

    kept = [c for c in docs.columns if c not in ("shares", "rate", "copies")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])

    def run(batches):
        for batch in by_bytes(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(posteriors(mixture.model, texts_of(batch))[0])], names=[*batch.schema.names, "shares"])

    with_shares = T.StructType([*docs.schema.fields, T.StructField("shares", T.ArrayType(T.DoubleType()))])
    rated = arrow_map(docs, run, with_shares).withColumn("rate", mixture.rate())
    taken = rated.withColumn("copies", mixture.copies()).where("copies > 0")
    return taken.select(*[F.col(f"`{c}`") for c in kept], "rate", "copies")
