"""Nearest neighbours by a block matrix join.

Vectors are cut into blocks. Each tile (query block x candidate block) multiplies int8 codes, which
gives every inner product up to a bound that follows from the quantisation errors. Pairs whose upper
bound stays below the k-th lower bound of their query are out; the rest are computed again from the
original vectors in double precision. Heaps of k per tile are merged per query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of up to WIDTH components in a task's query block and candidate block (fewer of wider rows), rows of
#: the tiles that a task multiplies, and pairs computed again at once.
QUERY_BLOCK, CANDIDATE_BLOCK, WIDTH = 16_384, 32_768, 64
TILE, PAIRS = (1024, 4096), 100_000
SCHEMA = "query_id long, vec_id long, score double"


def usable(embedding: Column) -> Column:
    """Not null, not empty, all components finite numbers, not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their largest component in [0.5, 1), and the powers of two taken out of them."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    half = -power // 2  # in two steps: one power alone may lie beyond the range of a double
    return np.ldexp(np.ldexp(x, half[:, None]), (-power - half)[:, None]), power


def _codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, their scale, the length of each decoded vector and of its error."""
    scale = np.abs(x).max(axis=1, keepdims=True) / 127
    codes = np.rint(x / scale).astype(np.int8)
    decoded = codes * scale
    return codes, scale[:, 0], np.linalg.norm(decoded, axis=1), np.linalg.norm(x - decoded, axis=1)


def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    q = query[order]
    first = np.searchsorted(q, q, side="left")
    return order[np.arange(len(q)) - first < k]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner product of each pair of rows, summed in the order of the components on every machine."""
    total = np.zeros(len(a))
    for part in np.ascontiguousarray((a * b).T):
        total += part
    return total


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products; sums that overflow on the way are computed again without their powers of two."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = _products(a, b)
        wrong = np.flatnonzero(~np.isfinite(out))
        if len(wrong):
            (x, p), (y, q) = _scaled(a[wrong]), _scaled(b[wrong])
            out[wrong] = np.ldexp(_products(x, y), p + q)
    return out


def _parts(n: int, size: int) -> list[slice]:
    return [slice(i, i + size) for i in range(0, n, size)]


def tile(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best candidates of each query of two blocks, tile by tile.

    Bounds are in units of the query's and the block's largest power of two, so none overflows. A bound
    asks for no more than the largest double, and allows for products below the smallest one: scores that
    end there are ties, which ids decide.
    """
    if queries.empty or candidates.empty:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    qi, ci = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
    q, c = np.stack(queries["embedding"].to_numpy()).astype(float), np.stack(candidates["embedding"].to_numpy()).astype(float)
    (qn, qp), (cn, cp) = _scaled(q), _scaled(c)
    qc, qs, ql, qe = _codes(qn)
    cc, cs, cl, ce = _codes(cn)
    top = int(cp.max())
    cs, cl, ce = (np.ldexp(v, cp - top) for v in (cs, cl, ce))
    # float32 holds these int8 products exactly up to 1,024 dimensions; above, double does
    kind = np.float32 if q.shape[1] <= 1024 else np.float64
    with np.errstate(over="ignore"):
        most = np.ldexp(1.0, 1022 - qp - top)
        least = np.ldexp(4.0 * q.shape[1], -1074 - qp - top) + 1e-300
    parts = []
    for a in _parts(len(q), TILE[0]):
        held, floor = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), np.full(len(qi[a]), -np.inf)
        for b in _parts(len(c), TILE[1]):
            near = (qc[a].astype(kind) @ cc[b].astype(kind).T).astype(float) * qs[a, None] * cs[None, b]
            slack = ql[a, None] * ce[None, b] + qe[a, None] * (cl + ce)[None, b]
            slack = slack * (1 + 1e-9) + 1e-5 * (ql[a, None] * cl[None, b]) + least[a, None]
            low = near - slack
            own = qi[a, None] == ci[None, b]
            low[own] = -np.inf
            others = min(k, low.shape[1])
            limit = np.minimum(np.partition(low, low.shape[1] - others, axis=1)[:, low.shape[1] - others], most[a])
            if low.shape[1] >= k:
                floor = np.maximum(floor, limit)
            limit = np.maximum(limit, floor) if low.shape[1] >= k else floor
            rows, cols = np.nonzero((near + slack >= limit[:, None]) & ~own)
            scores = np.concatenate([_scores(q[a][rows[p]], c[b][cols[p]]) for p in _parts(len(rows), PAIRS)] or [np.empty(0)])
            held = tuple(np.concatenate(x) for x in zip(held, (rows, ci[b][cols], scores), strict=True))
            kept = _best(*held, k)
            held = tuple(x[kept] for x in held)
        parts.append((qi[a][held[0]], held[1], held[2]))
    query_id, vec_id, score = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each query row.

    A row is no candidate of its own id. Only vectors of the same length meet. Rows that are not
    ``usable`` or have a null id take no part; of rows with the same id the smallest vector counts.
    Ties go to the smaller id. Other columns are ignored. Exact: the bounds lose no pair.

    Scores are those of doubles: a product beyond them counts as infinite, one below them as zero.

    Blocks are dealt by a hash of the id; each query block meets each candidate block in a task of
    its own, so a task holds two blocks whatever the table's size. A candidate travels once per query block.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("embedding")).alias("dim")).first()
    wide = max(WIDTH, sizes.dim or 0)
    query_blocks, blocks = (max(1, -(-n * wide // (most * WIDTH))) for n, most in ((sizes.q, QUERY_BLOCK), (sizes.n, CANDIDATE_BLOCK)))
    dealt = F.xxhash64("vec_id", F.lit("block"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    base = rows.withColumn("dim", F.size("embedding"))
    queries = base.where(is_query).withColumn("qb", F.pmod(dealt, F.lit(query_blocks)).cast("int")).withColumn("cb", every(blocks))
    candidates = base.withColumn("cb", F.pmod(dealt, F.lit(blocks)).cast("int")).withColumn("qb", every(query_blocks))
    keys = ["dim", "qb", "cb"]
    best = queries.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInPandas(lambda q, c: tile(q, c, k), SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
