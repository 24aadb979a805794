"""Spelling variants by a variable-length gram index.

Grams are anchored at a word's start or end: an edit leaves all to its left and all to its right as it is, and
of all grams inside such a part the anchored one has the shortest list. The dictionary holds the frequent grams,
those on the lists of more than ``longest_list`` words; it is pruned below them. A word decomposes into the
shortest gram from its start and the shortest to its end that are not frequent, so their lists are short.
The grams that an edit can affect are known per word and place. Where the two do not overlap, one edit affects
one of them at most, so near words share a list and the two lists are united. For the places where one edit
affects both, the frequent grams left and right of the edit are taken, and their lists are intersected: the
two grams together make one key. What shares a key is verified by its edit distance.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lengths of the grams in the dictionary, and words on a list before its gram counts as frequent.
SHORTEST, LONGEST, LIST = 3, 10, 64
#: The dictionary is a bitmap of hashed grams, 1 MB at any size of the input. Where two grams meet, both count
#: together: a gram then comes out longer, which loses no pair.
SLOTS, SLICE = 1 << 23, 1 << 15
#: Joined grams of so many letters and more are hashed.
SPELLED = 64
_PRIME, _BASE = (1 << 61) - 1, 0x1F35_6A3C_97D1


def words(docs: DataFrame, least_length: int = 7, least_count: int = 2, damage: int = 31) -> DataFrame:
    """word, n: runs of Latin letters over all texts, A-Z lower-cased, each occurrence counted.

    A run loses one letter where ``damage`` divides the crc32 of ``<doc_id>:<run>``. A null doc_id counts as
    empty text, a null text has no runs, repeated rows count again.
    """
    lowered = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    run = F.explode(F.regexp_extract_all(lowered, F.lit(f"[a-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0)))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run.alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")
    counted = hashed.select(word).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _slot(gram):
    """Slot of a gram's bytes: one formula for the dictionary and for its readers."""
    return F.crc32(gram.cast("binary")) % SLOTS


def dictionary(found: DataFrame, longest_list: int = LIST) -> bytes:
    """Bitmap of the grams on more than ``longest_list`` lists."""
    sizes = F.sequence(F.lit(SHORTEST), F.least(F.length("word"), F.lit(LONGEST)))
    starts = F.transform(sizes, lambda q: _slot(F.concat(F.lit("<"), F.substring("word", F.lit(1), q))))
    ends = F.transform(sizes, lambda q: _slot(F.concat(F.lit(">"), F.substring("word", -q, q))))
    grams = found.where(F.length("word") >= SHORTEST).select(F.explode(F.concat(starts, ends)).alias("slot"))
    frequent = grams.groupBy("slot").count().where(F.col("count") > longest_list)
    slices = frequent.groupBy(F.floor(F.col("slot") / SLICE).cast("int").alias("slice")).agg(
        F.bitmap_construct_agg(F.col("slot") % SLICE).alias("bits")
    )
    bits = bytearray(SLOTS // 8)
    for row in slices.collect():  # SLOTS / SLICE rows at the most
        bits[row.slice * SLICE // 8 : (row.slice + 1) * SLICE // 8] = row.bits
    return bytes(bits)


def reach(grams: list[bytes], bits: bytes) -> int:
    """Length of the shortest gram that is not frequent; ``grams`` are of SHORTEST letters and more. 0 without one."""
    for q, gram in enumerate(grams, SHORTEST):
        slot = zlib.crc32(gram) % SLOTS
        if not bits[slot >> 3] >> (slot & 7) & 1:
            return q
    return 0


def without(word: str, first: int, last: int) -> Iterator[str]:
    """Keys of the word without its letter at each place from ``first`` to before ``last``.

    A key is the text that is left, or a hash of it where it is long: all hashes of a word take one pass.
    """
    if len(word) <= SPELLED:
        yield from ("*" + word[:p] + word[p + 1 :] for p in range(first, last))
    elif first < last:
        after, power = [0] * (len(word) - first), 1  # hash of what follows each place, and its weight
        powers = [1] * len(after)
        for p in range(len(word) - 1, first, -1):
            after[p - first - 1] = (after[p - first] + ord(word[p]) * power) % _PRIME
            power = power * _BASE % _PRIME
            powers[p - first - 1] = power
        before = whole(word[:first])
        for p in range(first, last):
            yield f"#{(before * powers[p - first] + after[p - first]) % _PRIME}"
            before = (before * _BASE + ord(word[p])) % _PRIME


def whole(word: str) -> int:
    value = 0
    for letter in word:
        value = (value * _BASE + ord(letter)) % _PRIME
    return value


def keys_of(word: str, bits: bytes) -> set[str]:
    """The lists a word is on: its two rare grams, and joined pairs of grams for edits that affect both."""
    size, longest = len(word), min(len(word), LONGEST)
    start = reach([b"<" + word[:q].encode() for q in range(SHORTEST, longest + 1)], bits)
    end = reach([b">" + word[size - q :].encode() for q in range(SHORTEST, longest + 1)], bits)
    keys = ({"<" + word[:start]} if start else set()) | ({">" + word[size - end :]} if end else set())
    # a letter at place p is part of the first gram if p < start, of the last if p >= size - end
    first, last = (size - end if end else 0), (start if start else size)
    keys.update(without(word, first, last))
    # a letter put in before place p parts the first gram if p < start, the last if p > size - end
    if max(first + 1 if end else 0, 0) < (last if start else size + 1):
        keys.add("*" + word if size < SPELLED else f"#{whole(word)}")
    return keys


def lists(found: DataFrame, bits: bytes) -> DataFrame:
    """key, word, n for every list a word is on."""
    shared = found.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys, owners, counts = [], [], []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                mine = keys_of(word, known)
                keys.extend(mine)
                owners.extend([word] * len(mine))
                counts.extend([n] * len(mine))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(owners, pa.string()), pa.array(counts, pa.int64())], names=["key", "word", "n"]
            )

    return found.mapInArrow(run, "key string, word string, n long")


def near_words(found: DataFrame, longest_list: int = LIST) -> DataFrame:
    """a, n_a, b, n_b, a < b: all pairs of words that differ by one inserted, deleted or replaced letter."""
    keyed = materialise(lists(found, dictionary(found, longest_list)), "spelling-lists")
    a, b = (keyed.select("key", F.col("word").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    shared = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1))
    return shared.where(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b").distinct()


def variants(docs: DataFrame, ratio: int = 10, longest_list: int = LIST, **rule: int) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words``.

    ``form`` is the most frequent near word (ties: smallest in code-point order) if it occurs at least ``ratio``
    times as often, else null; ``root`` follows forms to the last. No words give no rows; other columns of
    ``docs`` are ignored.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    found = materialise(words(docs, **rule), "spelling-words")
    pairs = near_words(found, longest_list)
    both = pairs.select(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("other"), F.col("n_b").alias("n_other"))
    both = both.unionByName(pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"), F.first("n").alias("own")
    )
    chosen = F.when(-F.col("best.less") >= ratio * F.col("own"), F.col("best"))
    near = materialise(best.select("word", "n_near", chosen["other"].alias("form"), (-chosen["less"]).alias("form_n")), "spelling-near")

    # counts grow at least ratio-fold from form to form, so chains are short; each round doubles the steps taken
    most = found.agg(F.max("n").alias("most")).first()["most"] or 1
    step = near.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(math.log(most, ratio) + 1))):
        step = step.join(step.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root")
        )
    out = found.join(near, "word", "left").join(step, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
