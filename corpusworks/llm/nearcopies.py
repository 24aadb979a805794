"""Near copies by the Jaccard similarity of word shingles: rare shingles propose pairs, whole shingle sets decide.

Texts at similarity 0.8 differ in about ten bits of a 64-bit SimHash, with a spread of three, so a radius that finds
them leaves no segment long enough to deal by. Shared rare shingles do. Put all shingles in one order: of two sets at
similarity t or more, the first n - ceil(t n) + 1 shingles of one and of the other have one in common, n being each
set's size. No pair is missed whatever the order. It starts with shingles that are not frequent in a sample of the
texts, so that passages which many texts share propose no pairs among texts that are otherwise unlike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusworks.llm import simhash
from corpusworks.llm.common import arrow_map, bounded, by_bytes, grams, materialise, mix, texts_of, word_groups
from corpusworks.llm.components import components

#: Rows sampled for the order, texts of them that make a shingle frequent, and frequent shingles kept (8 bytes each,
#: sent to every task). The sample chooses the order only.
SAMPLE, OFTEN, MOST = 8192, 6, 1 << 20
#: Pairs of two parts that are compared in a round, before all that are left.
ROUNDS = 1, 16
#: Bits that say which texts' sets are needed.
SLOTS, _SLICE = 1 << 23, 1 << 15
#: Bytes of text taken at once and hashed at once.
_TAKEN, _PIECE = 1 << 19, 1 << 17


def shingle_sets(texts: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's word runs; a text of fewer words is one run, one without words has none."""
    for first, last, hashes, offsets in word_groups([t.lower() for t in texts], piece=_PIECE):
        for i in range(last - first):
            words = hashes[offsets[i] : offsets[i + 1]]
            yield np.unique(grams(words, min(shingle, len(words)))) if len(words) else words


def _node(shingles: np.ndarray) -> int:
    """One number for a set of shingles."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])


def leading(shingles: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set by that order, as many as a partner must share one of."""
    n = len(shingles)
    if not n:
        return np.empty(0, np.int64)
    common = np.zeros(n, dtype=bool)
    if len(frequent):
        common = frequent[np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)] == shingles
    order = np.lexsort((mix(shingles), common))
    return shingles[order[: n - math.ceil(similarity * n - 1e-9) + 1]].view(np.int64)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def frequent_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Sorted shingles that OFTEN or more different texts of a sample of about SAMPLE rows have."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_row", F.xxhash64("doc_id", "text"))
    sample = _sets(bounded(rows, "_row", SAMPLE), shingle).groupBy("node").agg(F.first("shingles").alias("shingles"))
    counts = sample.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN)
    found = counts.groupBy("n").agg(F.count("*").alias("shingles")).collect()
    least, held = OFTEN, 0
    for row in sorted(found, key=lambda r: -r.n):
        held += row.shingles
        if held > MOST:
            least = row.n + 1
            break
    return np.sort(np.array([r.s for r in counts.where(F.col("n") >= least).select("s").collect()], dtype=np.int64).view(np.uint64))


def signatures(docs: DataFrame, shingle: int, similarity: float, bits: bool = False) -> DataFrame:
    """doc_id, text_key (a hash of the text), node (equal for equal shingle sets), n (shingles), leading (the shingles
    that propose pairs; none without words) of every row; with ``bits`` also fp, its SimHash fingerprint."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))

    def run(batches):
        for batch in by_bytes(batches, most=_TAKEN):
            nodes, sizes, first, texts = [], [], [], texts_of(batch)
            for s in shingle_sets(texts, shingle):
                nodes.append(_node(s))
                sizes.append(len(s))
                first.append(leading(s, frequent.value, similarity))
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), _lists(first)]
            if bits:
                columns.append(pa.array([int.from_bytes(simhash.fingerprint(t), "big", signed=True) for t in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "text_key", "node", "n", "leading", *(["fp"] if bits else [])]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key())
    return arrow_map(rows, run, "doc_id long, text_key long, node long, n long, leading array<long>" + (", fp long" if bits else ""))


def _sets(docs: DataFrame, shingle: int, wanted: bytes | None = None) -> DataFrame:
    """node, shingles of the rows whose node may be in the bitmap ``wanted`` (all without one), once per task."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        given, bits = set(), shared.value
        for batch in by_bytes(batches, most=_TAKEN):
            sets = {}
            for s in shingle_sets(texts_of(batch), shingle):
                node = _node(s)
                slot = node % SLOTS
                if node not in given and (bits is None or bits[slot >> 3] >> (slot & 7) & 1):
                    given.add(node)
                    sets[node] = s.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), _lists(list(sets.values()))], names=["node", "shingles"])

    return arrow_map(docs.select("text"), run, "node long, shingles array<long>")


def _bitmap(nodes: DataFrame) -> bytes:
    """The nodes in a bitmap of SLOTS bits: 1 MB at any size. Nodes of one slot stand for each other."""
    slot = F.pmod("node", F.lit(SLOTS))
    parts = nodes.groupBy(F.floor(slot / _SLICE).cast("int").alias("slice")).agg(F.bitmap_construct_agg(slot % _SLICE).alias("bits"))
    bits = bytearray(SLOTS // 8)
    for row in parts.collect():  # SLOTS / _SLICE rows at the most
        bits[row.slice * _SLICE // 8 : (row.slice + 1) * _SLICE // 8] = row.bits
    return bytes(bits)


def shared_lists(nodes: DataFrame) -> DataFrame:
    """key, node, n of the lists that more than one node is on.

    Most lists hold one node. Rows are sorted by list and node over range partitions, so a long list spreads over
    many; only runs of one list go on, and what stands at a partition's edges, where a list may go on.
    """

    def run(batches):
        held = None  # last row of the batch before, not yet given out
        first = True
        for batch in batches:
            key, node, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                key, node, n = (np.concatenate([[h], c]) for h, c in zip(held[:3], (key, node, n), strict=True))
            same = key[1:] == key[:-1]
            keep = np.concatenate([[bool(held and held[3])], same])
            keep[:-1] |= same
            if first and len(key):
                keep[0], first = True, False
            if len(key):
                held = (key[-1], node[-1], n[-1], bool(keep[-1]))
                key, node, n, keep = key[:-1], node[:-1], n[:-1], keep[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep], pa.int64()) for c in (key, node, n)], names=["key", "node", "n"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(c)], pa.int64()) for c in held[:3]], names=["key", "node", "n"])

    dealt = nodes.select(F.explode("leading").alias("key"), "node", F.col("n").cast("long").alias("n"))
    placed = dealt.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    return materialise(placed.mapInArrow(run, "key long, node long, n long"), "near-lists")


def enough(a: Column, b: Column, similarity: float) -> Column:
    """How many leading shingles sets of ``a`` and ``b`` shingles share at the least, to have that similarity.

    They share t / (1 + t) of a + b shingles in all. Of the two, take the set whose leading shingles end first in the
    order: what it shares of them, the other has among its own, and behind them stand ceil(t n) - 1 more.
    """
    shared = F.ceil((a + b) * (similarity / (1 + similarity)) - 1e-6)
    return F.greatest(F.lit(1), shared - F.ceil(F.greatest(a, b) * similarity - 1e-9) + 1)


def _similar(docs: DataFrame, pairs: DataFrame, shingle: int, similarity: float, parted: bool = False) -> DataFrame:
    """Of rows (a, b, n_a, n_b), one for each shared leading shingle of two nodes and its set's sizes, the pairs (a, b)
    whose shingle sets have that Jaccard similarity or more. Pairs that share too few are not looked at.

    With ``parted`` rows also have part_a and part_b, the parts that the nodes are joined to already, and pairs of
    parts that pairs found before join are left out. Of two parts, the pairs that share most leading shingles come
    first, ROUNDS says how many; all pairs of parts that are not joined then come last.
    """
    parts = [F.first(f("part_a", "part_b")).alias(name) for f, name in ((F.least, "low"), (F.greatest, "high"))] if parted else []
    counted = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.count("*").alias("shared"), F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"), *parts
    )
    pairs = materialise(counted.where(F.col("shared") >= enough(F.col("n_a"), F.col("n_b"), similarity)).drop("n_a", "n_b"), "near-pairs")
    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    # sets of texts that no pair needs stay where they are; the others are shuffled once, for both joins
    sets = _sets(docs, shingle, _bitmap(needed)).groupBy("node").agg(F.first("shingles").alias("shingles"))
    if not parted:
        return _verified(pairs.select("a", "b"), sets, similarity)
    sets, found = materialise(sets, "near-sets"), None
    for most in ROUNDS:
        best = F.max(F.struct("shared", "a", "b")).alias("best")
        tried = pairs.groupBy("low", "high", F.pmod(F.xxhash64("a", "b"), F.lit(most)).alias("slot")).agg(best)
        tried = materialise(tried.select("best.a", "best.b", "low", "high"), "near-tried")
        near = _verified(tried, sets, similarity)
        found = near if found is None else found.unionByName(near)
        roots = components(found.select(F.col("low").alias("a"), F.col("high").alias("b")))
        left = pairs.select("low", "high").distinct()
        for end in ("low", "high"):
            left = left.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
        left = left.where(F.coalesce("low_root", "low") != F.coalesce("high_root", "high")).select("low", "high")
        pairs = pairs.join(left, ["low", "high"], "left_semi").join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = materialise(pairs.select("a", "b", "shared", "low", "high"), "near-pairs")
    return found.select("a", "b").unionByName(_verified(pairs.select("a", "b"), sets, similarity))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The rows of pairs (a, b) whose sets have that Jaccard similarity or more."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    both = both.withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    near = F.col("shared") / (F.size("of_a") + F.size("of_b") - F.col("shared")) >= similarity
    return materialise(both.where(near).select(*pairs.columns), "near-links")


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """a, b: links that join the nodes of (node, fp) whose fingerprints SimHash joins, one star per component."""
    held = materialise(rows.select("node", "fp").distinct(), "near-fingerprints")
    roots = components(simhash.links(held.select("fp").distinct())).select(F.col("node").alias("fp"), "root")
    placed = materialise(held.join(roots, "fp", "left").select("node", F.coalesce("root", "fp").alias("root")), "near-fingerprints")
    first = placed.groupBy("root").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b < last").select("root", "b")
    return materialise(placed.join(first, "root").where("node <> b").select(F.col("node").alias("a"), "b").distinct(), "near-links")


def _placed(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (key, node, n) of lists that hold nodes not joined by ``links`` yet, with the part that each is in."""
    parts = components(links).withColumnRenamed("root", "part")
    placed = materialise(lists.select("key", "node", "n").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node")), "near-members")
    apart = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("key")
    return materialise(placed.join(apart, "key").select("key", "node", "n", "part"), "near-members")


def near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bits: bool = False) -> DataFrame:
    """doc_id, text_key, component_id (smallest doc_id reachable by pairs of that shingle Jaccard or more), kept.

    With ``bits`` texts are joined by SimHash first, as ``simhash.near_duplicates`` does, and its links count like
    those of that similarity; only texts that it leaves apart are compared by their shingles.

    ``kept`` marks the text that stands for its component: of the rows of smallest id, the one of smallest text_key.

    Texts without words are copies of each other. A null doc_id is never the smallest; a component of null
    ids alone has a null component_id. Repeated rows give repeated results; other columns are ignored.
    Members of a list are first compared with its least one, where the lists that it leads show enough shared
    shingles. Then all pairs of a list that are not joined yet are counted over their lists, and those that share
    enough leading shingles are compared by their whole sets, the likeliest pairs of two parts first: a text that
    one of them joins to a group is not compared with the others of that group.
    """
    rows = materialise(signatures(docs, shingle, similarity, bits), "near-signatures")
    links = fingerprint_links(rows) if bits else None
    lists = shared_lists(rows.where("n > 0").select("node", "n", "leading").dropDuplicates(["node"]))
    found = _placed(lists, links) if bits else lists.withColumn("part", F.col("node"))
    hubs = found.groupBy("key").agg(F.min(F.struct("node", "n", "part")).alias("hub"), F.max("node").alias("last")).where("hub.node < last")
    hub = [F.col(f"hub.{c}").alias(name) for c, name in (("node", "hub"), ("n", "hub_n"), ("part", "hub_part"))]
    members = materialise(found.join(hubs.select("key", *hub), "key"), "near-members")
    alike = (F.col("n") >= similarity * F.col("hub_n")) & (F.col("hub_n") >= similarity * F.col("n"))
    led = members.where(F.expr("part <> hub_part") & alike).select(F.col("node").alias("a"), F.col("hub").alias("b"), F.col("n").alias("n_a"), F.col("hub_n").alias("n_b"))
    close = _similar(docs, led, shingle, similarity)
    links = close if links is None else links.unionByName(close)

    apart = _placed(members, links)
    x, y = apart.alias("x"), apart.alias("y")
    fits = (F.col("x.n") >= similarity * F.col("y.n")) & (F.col("y.n") >= similarity * F.col("x.n"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.part") < F.col("y.part")) & fits)
    # two nodes of different parts meet on every list they share, so their count is whole here
    pairs = pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("n_a"), F.col("y.n").alias("n_b"), F.col("x.part").alias("part_a"), F.col("y.part").alias("part_b"))
    links = links.unionByName(_similar(docs, pairs, shingle, similarity, True))

    best = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key"))).alias("least")
    least = rows.groupBy("node").agg(best)
    roots = materialise(least.join(components(links), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")), "near-roots")
    ids = roots.groupBy("root").agg(F.min("least").alias("best"))
    placed = rows.select("doc_id", "text_key", "node").join(roots.join(ids, "root").select("node", "best"), "node")
    kept = F.coalesce((F.col("doc_id") == F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")), F.lit(False))
    return placed.select("doc_id", "text_key", F.col("best.doc_id").alias("component_id"), kept.alias("kept"))


def keep_one(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """One row of ``docs`` per component of ``near_copies``: the text that is marked there; rows with a null id stay.

    Rows meet their marks by id and text, so rows that share an id do not fall with each other. Of equal rows one
    stays. Texts are shuffled for ids that occur again with the same text, and for no others.
    """
    marks = copies.where("doc_id is not null").groupBy("doc_id", "text_key").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    marks = materialise(marks.where("not kept or times > 1"), "near-marks")
    marked = marks.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "kept")
    own = F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("_key")
    single = docs.join(marked, (docs["doc_id"] == F.col("_id")) & own, "left_anti")
    again = marked.where("kept")
    if not again.limit(1).count():
        return single
    rows = docs.join(again, (docs["doc_id"] == F.col("_id")) & own, "inner").dropDuplicates(["_id", "_key"])
    return single.unionByName(rows.select(*[docs[c] for c in docs.columns]))
