"""SimHash, substrings and neighbours against brute force, with large groups and awkward rows."""

import hashlib
import random
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corpusworks.llm import ann, common, simhash, substrings
from corpusworks.llm.components import components
from tests.llm.helpers import AWKWARD, documents

WORDS = [f"w{i}" for i in range(60)]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    value = 0
    for bit in range(64):
        ones = sum((xxhash.xxh64_intdigest(r, seed=42) >> bit) & 1 for r in runs)
        value |= (2 * ones > len(runs)) << bit if runs else 0
    return value


def roots(nodes, near):
    """Smallest node reachable, by search over all pairs."""
    left, out = sorted(nodes), {}
    while left:
        seed = left.pop(0)
        front, out[seed] = [seed], seed
        while front:
            x = front.pop()
            for y in [y for y in left if near(x, y)]:
                left.remove(y)
                out[y] = seed
                front.append(y)
    return out


def test_fingerprints_and_spark_hashes(spark):
    texts = ["", "One", "one TWO", "a b c", "É b c d e f", "x " * 70_000]
    got = {r.doc_id: r.fp for r in simhash.fingerprints(documents(spark, list(enumerate(texts)))).collect()}
    assert [got[i] & (2**64 - 1) for i in range(len(texts))] == [plain_fingerprint(t) for t in texts]
    assert spark.sql("select xxhash64('abc') h").first().h & (2**64 - 1) == xxhash.xxh64_intdigest(b"abc", seed=42)


@pytest.mark.parametrize("searched", [simhash.SEARCHED, 20, 2])
def test_links_join_what_all_pairs_join(spark, searched):
    draw = random.Random(5)
    fps = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(draw.choice([1, 3, 40, 120])):
            x = centre
            for _ in range(draw.randint(0, 5)):
                x ^= 1 << draw.randrange(64)
            fps.add(x)
    fps |= {draw.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1, 1, 7, 15}
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    got = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), searched)).collect()
    want = roots(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    assert {r.node: r.root for r in got} == {n: r for n, r in want.items() if n != r}


def test_near_duplicates_by_document(spark):
    base = " ".join(random.Random(2).choices(WORDS, k=400))
    rows = [(9, base), (4, base.upper()), (12, base), (30, "other text that stands alone"), (31, ""), (2, None), (None, base), (40, "ab cd"), *AWKWARD[5:6]]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.component_id)
    assert len(got) == len(rows)
    assert by[9] == by[4] == by[12] == by[None] == {4} and by[31] == by[2] == {2} and by[30] == {30} and by[40] == {40}
    kept = simhash.keep_one(documents(spark, rows), simhash.near_duplicates(documents(spark, rows)))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [2, 4, 5, 30, 40]
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_path_a_star_and_a_ring(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 700)]
    ring = [(i, 900 + (i - 899) % 30) for i in range(900, 930)]
    got = {r.node: r.root for r in components(spark.createDataFrame([*path, *star, *ring, (7, 7)], "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 500 for i in range(501, 700)}, **{i: 900 for i in range(901, 930)}}


def plain_cut(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = (text or "").encode().split()
        gone = set()
        for s in range(len(words) - length + 1):
            key = tuple(words[s : s + length])
            if key in seen:
                gone.update(range(s, s + length))
            seen.add(key)
        kept = [w for k, w in enumerate(words) if k not in gone]
        out[i] = (len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("length,anchor,flush", [(20, 4, None), (20, 4, 2_000), (7, 3, 500), (5, 5, 500)])
def test_substrings_equal_brute_force(spark, monkeypatch, length, anchor, flush):
    if flush:
        monkeypatch.setattr(substrings, "FLUSH_BYTES", flush)
    draw = random.Random(length + anchor)
    passages = [draw.choices(WORDS, k=draw.randint(length - 2, 70)) for _ in range(6)]
    rows = []
    for i in range(80):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += draw.choice([draw.choice(passages), draw.choices(WORDS, k=draw.randint(1, 40)), [draw.choice(WORDS)] * draw.randint(1, 50)])
        rows.append((i * 3, draw.choice([" ", "\n", " \t "]).join(words)))
    docs = documents(spark, rows).repartition(5)
    got = substrings.cut(docs, substrings.repeats(docs, length, anchor)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("sha"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.sha) for r in got.collect()} == plain_cut(rows, length)


def test_frequent_anchors_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FREQUENT", 1)
    monkeypatch.setattr(substrings, "SAMPLED", 10_000)
    draw = random.Random(8)
    passage = draw.choices(WORDS, k=45)
    rows = [(i, " ".join([*draw.choices(WORDS, k=15), *passage, *draw.choices(WORDS, k=15)])) for i in range(60)]
    docs = documents(spark, rows).repartition(6)
    got = substrings.cut(docs, substrings.repeats(docs)).collect()
    want = plain_cut(rows, 20)
    assert {r.doc_id: (r.n_words, r.n_removed) for r in got} == {i: v[:2] for i, v in want.items()}


def test_substrings_take_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    ranges = substrings.repeats(docs)
    rows = substrings.cut(docs, ranges).collect()
    assert len(rows) == len(AWKWARD)
    long = next(r for r in rows if r.doc_id == 4)
    assert (long.n_words, long.n_removed) == (200_000, 199_990 - 0) or long.n_removed == plain_cut([AWKWARD[4]], 20)[4][1]
    assert {r.n_removed for r in rows if r.doc_id != 4} == {0}
    empty = documents(spark, [])
    assert substrings.cut(empty, substrings.repeats(empty)).count() == 0


def test_word_hashes_do_not_depend_on_pieces():
    draw = random.Random(4)
    texts = [" ".join(draw.choices(WORDS, k=k)).encode() for k in (0, 1, 50, 4000)] + [b"", b"  ", b"y" * 5000 + b" z"]
    whole = [(h.tolist(), (o - o[0]).tolist()) for _, _, h, o in common.word_groups(texts, piece=1 << 20)]
    small = [h.tolist() for _, _, h, _ in common.word_groups(texts, piece=64)]
    assert [x for h, _ in whole for x in h] == [x for h in small for x in h]
    assert sum(len(h) for h in small) == sum(len(t.split()) for t in texts)


def plain_neighbours(rows, k):
    out = []
    vectors = {i: np.array(v) for i, v in rows}
    for q in sorted(i for i in vectors if i % 20 == 0):
        ranked = sorted((-float(vectors[q] @ v), i) for i, v in vectors.items() if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked, 1)]
    return out


@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 17)])
def test_neighbours_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ann, "QUERY_BLOCK", blocks[0])
    monkeypatch.setattr(ann, "CANDIDATE_BLOCK", blocks[1])
    monkeypatch.setattr(ann, "TILE", (5, 30))
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(150)]
    rows += [(i, rows[7][1]) for i in range(150, 260)]  # many equal vectors: ties
    bad = [(300, None), (320, [0.0] * 8), (340, [float("nan")] * 8), (360, [float("inf")] + [1.0] * 7), (380, [None] + [1.0] * 7), (None, [1.0] * 8), (400, []), (420, [1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "x") for i, v in [*rows, *bad, rows[20]]], "vec_id long, embedding array<double>, rank string")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(table, F.col("vec_id") % 20 == 0, 20).collect())
    want = plain_neighbours(rows, 20)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) > 0.99 * len(want)


def test_neighbours_of_few_and_no_rows(spark):
    few = spark.createDataFrame([(20, [1.0, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id) for r in ann.search(few, F.col("vec_id") % 20 == 0).collect()] == [(20, 1)]
    assert ann.search(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("scale", ["huge", "denormal", "mixed"])
def test_neighbours_of_huge_and_tiny_vectors(spark, monkeypatch, scale):
    """Products beyond the doubles are infinite ties, those below them zero ties; no row is lost."""
    monkeypatch.setattr(ann, "TILE", (4, 25))
    rng = np.random.default_rng(3)
    power = {"huge": rng.integers(500, 531, 200), "denormal": rng.integers(-1060, -500, 200), "mixed": rng.integers(-1060, 1000, 200)}[scale]
    rows = [(i, (rng.normal(size=8) * 2.0 ** int(p)).tolist()) for i, p in enumerate(power)]
    rows += [(200, [1.7e308] * 5 + [-1.7e308] * 3), (201, [1.7e308] * 8), (202, [5e-324] * 8), (203, [1e160] * 8), (220, [1e160] * 8)]
    exact = {i: [Fraction(x) for x in v] for i, v in rows}

    def score(a, b):
        with np.errstate(all="ignore"):
            total = 0.0
            for x, y in zip(a, b, strict=True):
                total += x * y
        if np.isfinite(total):
            return total
        value = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True))
        try:
            return float(value)
        except OverflowError:
            return float("inf") if value > 0 else float("-inf")

    vectors = dict(rows)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 0, 7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in exact if i % 20 == 0}
    for query, found in got.items():
        want = sorted(((-score(vectors[query], v), i) for i, v in rows if i != query))[:7]
        assert [f[1] for f in sorted(found)] == [i for _, i in want]
        assert [f[2] for f in sorted(found)] == pytest.approx([-s for s, _ in want], rel=1e-12)
