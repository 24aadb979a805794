"""Near copies against brute-force Jaccard, and the pipeline's stage on edited texts."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from corpusworks.llm import nearcopies, simhash
from tests.llm.helpers import AWKWARD, documents
from tests.llm.test_duplicates import WORDS, roots


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    sets = {i: plain_shingles(t) for i, t in rows}
    return roots(sets, lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)


def edited(draw):
    """Copies with a few words edited, some of them of copies, and unlike texts that share a passage."""
    texts, passage = [], draw.choices(WORDS, k=60)
    for _ in range(12):
        chain = [draw.choices(WORDS, k=draw.randint(40, 300))]
        for _ in range(draw.choice([1, 3, 25])):
            words = list(draw.choice(chain))
            for _ in range(draw.randint(1, max(1, len(words) // 25))):
                words[draw.randrange(len(words))] = draw.choice(WORDS)
            chain.append(words)
        texts += chain
    texts += [[*draw.choices(WORDS, k=draw.randint(8, 40)), *passage] for _ in range(60)]
    draw.shuffle(texts)
    return [(i, " ".join(words)) for i, words in enumerate(texts)]


def test_near_copies_equal_brute_force(spark):
    rows = edited(random.Random(3))
    want = plain_components(rows)
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(documents(spark, rows).repartition(4)).collect()}
    assert got == want and len(set(want.values())) < len(rows) - 50


def test_near_copies_of_awkward_rows(spark):
    got = nearcopies.near_copies(documents(spark, [*AWKWARD, (8, "Same\twords here"), (None, None)])).collect()
    assert len(got) == len(AWKWARD) + 2
    of = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert of == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 5}
    assert nearcopies.near_copies(documents(spark, [])).count() == 0


def test_stage_drops_edited_copies(spark):
    words = random.Random(4).choices(WORDS, k=400)
    near = [[*words[:at], "edited", *words[at + 1 :]] for at in (30, 111, 222, 333)]
    both = [w if k % 40 else "changed" for k, w in enumerate(words)]
    rows = [(i, " ".join(w)) for i, w in enumerate([words, *near, both[:200] + words[200:], words[:150]], 10)]
    kept = corpus_pipeline.near_duplicate_stage(spark, documents(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [10, 16]


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = plain_components([(r.doc_id, r.text) for r in docs.collect()])
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert kept == set(want.values()) and len(kept) < len(want)


def test_rows_that_share_an_id_do_not_fall_together(spark):
    """Of equal rows one stays; a text like no other stays whatever its id; of copies the smallest id stays."""
    copied = "one two three four five six seven eight nine ten"
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, copied), (3, copied), (3, "nothing like the others here at all"), (None, copied), (4, None), (5, "")]
    docs = documents(spark, rows)
    kept = nearcopies.keep_one(docs, nearcopies.near_copies(docs))
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept.columns == docs.columns
    assert got == sorted([(1, "a b c d e f g"), (2, copied), (3, "nothing like the others here at all"), (None, copied), (4, None)], key=str)


def test_a_shared_template_proposes_few_pairs(spark, monkeypatch):
    """Texts that have 70 % of a template in common: the pairs compared grow with the texts, not with their square."""
    compared, plain = [], nearcopies._similar

    def counted(docs, pairs, *a):
        compared.append(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().count())
        return plain(docs, pairs, *a)

    monkeypatch.setattr(nearcopies, "_similar", counted)
    draw = random.Random(6)
    template = draw.choices(WORDS, k=70)
    rows = [(i, " ".join([*template, *(f"w{draw.randrange(10**6)}" for _ in range(30))])) for i in range(400)]
    got = {r.component_id for r in nearcopies.near_copies(documents(spark, rows)).collect()}
    assert len(got) == 400 and sum(compared) < 800


def test_leading_shingles_of_similar_sets_meet():
    """Whatever counts as frequent, two sets at the similarity share a leading shingle."""
    draw = random.Random(7)
    for _ in range(500):
        pool = [draw.getrandbits(64) for _ in range(draw.randint(1, 60))]
        a = set(pool)
        b = {x for x in a if draw.random() < 0.9} | {draw.getrandbits(64) for _ in range(draw.randint(0, 4))}
        if not b or len(a & b) / len(a | b) < 0.8:
            continue
        often = np.array(sorted(draw.sample(sorted(a | b), draw.randint(0, len(a | b)))), dtype=np.uint64)
        first = [set(nearcopies.leading(np.array(sorted(s), dtype=np.uint64), often, 0.8).tolist()) for s in (a, b)]
        assert first[0] & first[1]


def test_similar_sets_share_enough_leading_shingles(spark):
    """The least count that lets a pair be compared is never above what similar sets share; it is met exactly by some."""
    draw, rows = random.Random(8), []
    for _ in range(3000):
        a = {draw.getrandbits(64) for _ in range(draw.randint(1, 80))}
        b = {x for x in a if draw.random() < 0.92} | {draw.getrandbits(64) for _ in range(draw.choice([0, 1, 5, 15]))}
        if b and len(a & b) / len(a | b) >= 0.8:
            often = np.array(sorted(draw.sample(sorted(a | b), draw.randint(0, len(a | b)))), dtype=np.uint64)
            first = [set(nearcopies.leading(np.array(sorted(s), dtype=np.uint64), often, 0.8).tolist()) for s in (a, b)]
            rows.append((len(a), len(b), len(first[0] & first[1])))
    pairs = spark.createDataFrame(rows, "a long, b long, shared long")
    least = pairs.withColumn("least", nearcopies.enough(F.col("a"), F.col("b"), 0.8)).collect()
    assert len(least) > 500 and all(r.shared >= r.least for r in least)
    assert any(r.least > 3 for r in least) and any(r.shared == r.least for r in least)


def test_stage_joins_what_simhash_joins(spark, monkeypatch):
    """Texts of equal fingerprints fall together however unlike their sets of shingles, and are not compared by them."""
    compared, plain = [], nearcopies._similar

    def counted(docs, pairs, *a):
        compared.append(pairs.count())
        return plain(docs, pairs, *a)

    monkeypatch.setattr(nearcopies, "_similar", counted)
    often = WORDS[:9] * 60  # an odd number of runs, so that few other words turn no bit
    texts = [[*often, *(f"{c}{k}" for k in range(12))] for c in "abcdef"]
    edited = random.Random(9).choices(WORDS, k=300)
    rows = [(i, " ".join(words)) for i, words in enumerate([*texts, WORDS[9:30], edited, [*edited[:100], "changed", *edited[101:]]], 5)]
    docs = documents(spark, rows)
    joined = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert [joined[i] for i in range(5, 12)] == [5] * 6 + [11]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert kept == [5, 11, 12] and sum(compared) <= 60
    assert {r.component_id for r in nearcopies.near_copies(docs).collect()} == {5, 6, 7, 8, 9, 10, 11, 12}


def test_a_text_joined_to_a_group_is_not_compared_with_all_of_it(spark, monkeypatch):
    """Pairs of two parts are compared by their whole sets a few at a time until one joins them; no link is lost."""
    compared, plain = [], nearcopies._verified

    def counted(pairs, *a):
        compared.append(pairs.count())
        return plain(pairs, *a)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    draw = random.Random(14)
    words = [f"w{k}" for k in range(200)]
    # 41 texts of one part, 5 alone that are near all of these, and one that is near none
    near = [[w if k != at * 4 else f"n{at}" for k, w in enumerate(words)] for at in range(46)]
    far = [w if k % 18 else f"far{k}" for k, w in enumerate(words)]
    docs = documents(spark, [(i, " ".join(t)) for i, t in enumerate([*near, far, draw.sample(words, 60)])])
    ids = [(r.node, r.n, r.leading, r.doc_id) for r in nearcopies.signatures(docs, 5, 0.8).collect()]
    part = {node: (ids[0][0] if i < 41 else node) for node, _, _, i in ids}
    rows = [(a[0], b[0], a[1], b[1], part[a[0]], part[b[0]]) for k, a in enumerate(ids) for b in ids[k + 1 :] if part[a[0]] != part[b[0]] for _ in range(len(set(a[2]) & set(b[2])))]
    pairs = spark.createDataFrame(rows, "a long, b long, n_a long, n_b long, part_a long, part_b long")
    of = {node: i for node, _, _, i in ids}
    links = [(of[r.a], of[r.b]) for r in nearcopies._similar(docs, pairs, 5, 0.8, True).collect()]
    assert all(a != b and max(a, b) < 46 for a, b in links)
    joined = roots(range(48), lambda a, b: (a < 41 and b < 41) or (a, b) in links or (b, a) in links)
    assert len({joined[i] for i in range(46)}) == 1 and sum(compared) < 100 < 41 * 5
