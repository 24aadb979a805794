"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints with 3 or fewer differing bits, one
half differs by one bit at the most, so both have a variant of that half, with one bit position
wiped, in common. Variants are dealt out by equality and candidates verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import materialise, texts_of
from corpusworks.llm.components import components

BITS = 3
SEED = 42
#: Buckets up to PAIRWISE members are compared pair by pair in vector operations, up to SEARCHED by a
#: search that visits each member once. Larger ones are dealt again by variants of the other half;
#: then 18 bits at most can differ inside a bucket, which bounds it.
PAIRWISE, SEARCHED = 16, 8192
_ROWS, _SHINGLES = 1 << 18, 1 << 16


def fingerprint(raw: bytes, shingle: int = 3) -> bytes:
    """Fingerprint of a text as 8 bytes, high bit first: a bit is set if it is in over half of the hashes."""
    words = raw.lower().split()  # bytes: A-Z and the six ASCII white space characters only
    if not words:
        return bytes(8)
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SHINGLES):
        part = words[at : min(n, at + _SHINGLES) + shingle - 1]
        runs = zip(*(part[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [part]
        digests = b"".join([xxhash.xxh64_digest(b" ".join(run), SEED) for run in runs])
        counts += np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every row's whole text; a null text counts as empty."""

    def run(batches):
        for batch in batches:
            fps = np.frombuffer(b"".join([fingerprint(t, shingle) for t in texts_of(batch)]), dtype=">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def variants(fps: DataFrame) -> DataFrame:
    """key, fp: the 64 one-wildcard variants of each fingerprint. A key holds the wiped position and its half."""
    rows = fps.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(63))))
    half = F.when(F.col("p") < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    wiped = half.bitwiseAND(F.expr("~(1L << (p % 32))"))
    return rows.select(F.expr("cast(p as long) << 32").bitwiseOR(wiped).alias("key"), "fp")


def inner_variants(rows: DataFrame) -> DataFrame:
    """key, inner, fp: per member of a large bucket the 32 one-wildcard variants of its other half's 16-bit pieces."""
    rows = rows.withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(31))))
    other = F.when(F.shiftrightunsigned("key", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    piece = F.when(F.col("p") < 16, other.bitwiseAND(0xFFFF)).otherwise(F.shiftrightunsigned(other, 16))
    wiped = piece.bitwiseAND(F.expr("~(1L << (p % 16))"))
    return rows.select("key", F.expr("cast(p as long) << 16").bitwiseOR(wiped).alias("inner"), "fp")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= BITS


def _search(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star links (member, first member) of the components among a bucket's fingerprints."""
    left, out_a, out_b = fps, [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = left[:0]
        hit = _near(left, seed)
        while hit.any():
            front, left = left[hit], left[~hit]
            out_a.append(front)
            out_b.append(np.full(len(front), seed))
            hit = np.zeros(len(left), dtype=bool)
            for at in range(0, len(front), 256):
                hit |= _near(front[at : at + 256, None], left[None, :]).any(axis=0)
    none = fps[:0]
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _masks(width: int) -> np.ndarray:
    bits = [1 << i for i in range(width)]
    one = bits
    two = [a | b for i, a in enumerate(bits) for b in bits[i + 1 :]]
    three = [a | b | c for i, a in enumerate(bits) for j, b in enumerate(bits[i + 1 :], i + 1) for c in bits[j + 1 :]]
    return np.array(one + two + three, dtype=np.int64)


def _search_dense(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Like _search for fingerprints that differ in 18 bits at most: neighbours are looked up, not compared."""
    varying = np.bitwise_or.reduce(fps ^ fps[0])
    places = [i for i in range(64) if (int(varying) >> i) & 1]
    index = np.zeros(len(fps), dtype=np.int64)
    for k, i in enumerate(places):
        index |= ((fps >> np.uint64(i)) & np.uint64(1)).astype(np.int64) << k
    at = np.full(1 << len(places), -1, dtype=np.int64)
    at[index] = np.arange(len(fps))
    masks, out_a, out_b = _masks(len(places)), [], []
    for seed in range(len(fps)):
        if at[index[seed]] < 0:
            continue
        at[index[seed]] = -1
        front = index[seed : seed + 1]
        while len(front):
            new = []
            for part in range(0, len(front), 1024):
                near = np.unique((front[part : part + 1024, None] ^ masks[None, :]).ravel())
                near = near[at[near] >= 0]
                members = at[near]
                at[near] = -1
                out_a.append(fps[members])
                out_b.append(np.full(len(members), fps[seed]))
                new.append(near)
            front = np.concatenate(new)
    none = fps[:0]
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def _first_shared(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether this bucket is the first that the two fingerprints share, so that each link is given once."""
    p = key >> np.uint64(32)
    low, high = (a ^ b) & np.uint64(0xFFFFFFFF), (a ^ b) >> np.uint64(32)
    in_low = np.bitwise_count(low) <= 1
    place = np.where(in_low, np.where(low == 0, p == 0, True), np.where(high == 0, p == 32, True))
    return np.where(p < 32, in_low, ~in_low) & place


def _links(key: np.ndarray, fp: np.ndarray, searched: int) -> tuple[list, list]:
    """(a, b) links, and (key, fp) members of buckets over ``searched``, of rows sorted by key."""
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(begins, len(key)))
    links, large = [], []
    size_of = np.repeat(sizes, sizes)
    for apart in range(1, PAIRWISE):
        rows = np.flatnonzero((size_of > apart) & (size_of <= PAIRWISE))
        rows = rows[rows + apart < len(key)]
        rows = rows[key[rows] == key[rows + apart]]
        if not len(rows):
            break
        a, b = fp[rows], fp[rows + apart]
        good = _near(a, b) & _first_shared(key[rows], a, b)
        links.append((a[good], b[good]))
    for at, n in zip(begins[sizes > PAIRWISE], sizes[sizes > PAIRWISE], strict=True):
        if n <= searched:
            links.append(_search(fp[at : at + n]))
        else:
            large.append((key[at : at + n], fp[at : at + n]))
    return links, large


def _batch(links: list, large: list) -> pa.RecordBatch:
    a = np.concatenate([x for x, _ in links] + [x for _, x in large] or [np.empty(0, np.uint64)])
    b = np.concatenate([x for _, x in links] or [np.empty(0, np.uint64)])
    k = np.concatenate([x for x, _ in large] or [np.empty(0, np.uint64)])
    pad_b, pad_k = np.zeros(len(a), dtype=bool), np.ones(len(a), dtype=bool)
    pad_b[len(b) :], pad_k[len(b) :] = True, False
    zero = np.zeros(len(k), np.uint64)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(a.view(np.int64)),
            pa.array(np.concatenate([b, zero]).view(np.int64), mask=pad_b),
            pa.array(np.concatenate([np.zeros(len(b), np.uint64), k]).view(np.int64), mask=pad_k),
        ],
        names=["a", "b", "key"],
    )


def _scan(searched: int):
    """Batches of rows sorted by key → links and members of large buckets, in bounded memory."""

    def run(batches):
        key = fp = np.empty(0, np.uint64)
        through = None  # a large bucket whose members pass through
        for batch in batches:
            k, f = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "fp"))
            if through is not None:
                same = int(np.searchsorted(k, through, side="right"))
                if same:
                    yield _batch([], [(k[:same], f[:same])])
                k, f = k[same:], f[same:]
                if not len(k):
                    continue
                through = None
            key, fp = np.concatenate([key, k]), np.concatenate([fp, f])
            if len(key) < _ROWS:
                continue
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield _batch(*_links(key[:cut], fp[:cut], searched))
                key, fp = key[cut:], fp[cut:]
            if len(key) > searched:
                through = key[-1]
                yield _batch([], [(key, fp)])
                key = fp = key[:0]
        if len(key):
            yield _batch(*_links(key, fp, searched))

    return run


def _inner(table: pa.Table) -> pa.Table:
    fps = np.unique(table.column("fp").to_numpy().view(np.uint64))
    a, b = _search(fps) if len(fps) <= SEARCHED else _search_dense(fps)
    return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})


def links(fps: DataFrame, searched: int = SEARCHED) -> DataFrame:
    """a, b: links that join the same fingerprints as all pairs at 3 or fewer differing bits do.

    Buckets over PAIRWISE members give a star per component instead of their pairs.
    """
    dealt = variants(fps).repartition("key").sortWithinPartitions("key", "fp")
    found = materialise(dealt.mapInArrow(_scan(searched), "a long, b long, key long"), "simhash-links")
    out = found.where("key is null").select("a", "b")
    large = found.where("key is not null").select("key", F.col("a").alias("fp"))
    if large.limit(1).count():
        out = out.unionByName(inner_variants(large).groupBy("key", "inner").applyInArrow(_inner, "a long, b long"))
    return out


def near_duplicates(docs: DataFrame, shingle: int = 3, searched: int = SEARCHED) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable by links of 3 or fewer differing bits).

    Texts without words have fingerprint zero and link like others. A null doc_id is never the smallest;
    a component of null ids alone has a null component_id. Repeated rows give repeated results; other
    columns are ignored. Work on links is done on distinct fingerprints, so copies cost one row each.
    """
    rows = materialise(fingerprints(docs, shingle), "fingerprints")
    classes = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-classes")
    roots = components(links(classes.select("fp"), searched))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed, "fingerprint-roots")
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(least, "root").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is the least of their group; rows with a null id stay."""
    gone = groups.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti")
