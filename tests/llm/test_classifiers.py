"""Quality, toxicity and language: held-out accuracy, plain versions, awkward rows."""

import math
import random

import numpy as np
import pytest

from corpusworks.llm import langid, quality, toxicity
from tests.llm.helpers import AWKWARD, LABELS, documents


def crc(i, modulus):
    import zlib

    return zlib.crc32(str(i).encode()) % modulus


@pytest.fixture(scope="module")
def judged(spark):
    draw = random.Random(1)
    words = ["".join(draw.choice("abcdeilnorst") for _ in range(draw.randint(2, 9))) for _ in range(400)]
    docs, labels = [], []
    for i in range(600):
        text = ". ".join(" ".join(draw.choice(words) for _ in range(draw.randint(4, 12))).capitalize() for _ in range(draw.randint(2, 12))) + "."
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            text = draw.choice([text.upper().replace(" ", "!! "), " ".join([words[i % 400]] * 60), text.replace(" ", " | ")])
        if toxic:
            text += f" You {draw.choice(['vexling', 'grumbot', 'snarfed'])} of {draw.choice(words)}."
        docs.append((i, text))
        labels.append((i, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (5, 0, 1), (700, None, None), (8, 9, 9), *labels[:5]]
    return documents(spark, docs), spark.createDataFrame(labels, LABELS), {i: (q, t) for i, q, t in labels[:600]}


def test_quality_on_held_out_rows(judged):
    docs, labels, truth = judged
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    held = [i for i in truth if crc(i, 4) == 2]
    assert len(scores) == 600 and np.mean([(scores[i] >= 0.7) == truth[i][0] for i in held]) > 0.95


def test_accept_keeps_rows_whole(judged):
    docs, labels, _ = judged
    model = quality.fit(docs, labels)
    good = {r.doc_id for r in quality.score(docs, model).where("score >= 0.7").collect()}
    kept = quality.accept(docs, model, 0.7)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == good


def test_rules_as_columns_equal_rules_in_numpy(judged):
    docs, labels, _ = judged
    model = quality.fit(docs, labels)
    rows = quality.with_statistics(docs).select("_kept.doc_id", *model.names).toPandas()
    x = rows[model.names].to_numpy(float)
    z = model.base + sum(w * quality._holds(x, r) for w, r in model.rules)
    plain = dict(zip(rows["doc_id"], 1 / (1 + np.exp(-z)), strict=True))
    assert model.rules and all(math.isclose(r.score, plain[r.doc_id], abs_tol=1e-9) for r in quality.score(docs, model).collect())


def test_toxicity_on_held_out_rows(judged):
    docs, labels, truth = judged
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in truth if crc(i, 5) == 0]
    assert np.mean([(rows[i].score >= 0.5) == truth[i][1] for i in held]) > 0.95
    texts = {r.doc_id: r.text for r in docs.collect()}
    located = [i for i in held if truth[i][1] and rows[i].offending]
    assert located
    for i in located:
        s = rows[i].offending[-1]
        assert any(w in texts[i][s.start : s.start + s.length].lower() for w in ("vexling", "grumbot", "snarfed"))


def test_noisy_or_is_the_product_over_sentences(spark):
    model = toxicity.ToxicModel(-3.0, {"bad": 4.0, "aweful": 2.0, "awef*": 1.0})
    docs = documents(spark, [(1, "Fine words. So bad! Quite aweful\nfine"), (2, "fine"), (3, "")])
    p = lambda z: 1 / (1 + math.exp(-z))
    want = {1: 1 - (1 - p(-3)) ** 2 * (1 - p(1)) * (1 - p(0)), 2: p(-3), 3: p(-3)}
    for r in toxicity.score(docs, model).collect():
        assert math.isclose(r.score, want[r.doc_id], abs_tol=1e-9)


def test_log_odds_are_taken_beyond_the_beginning():
    odds = toxicity.log_odds({"idiot": (8, 0), "idio*": (8, 0), "grumbot": (4, 0), "grum*": (9, 3)}, 5.0)
    assert set(odds) == {"idiot", "grumbot", "grum*"}  # idio* says no more than idiot
    assert math.isclose(odds["idiot"], math.log(8.5 / 0.5 * 5))
    assert math.isclose(odds["grum*"] + odds["grumbot"], math.log(4.5 / 0.5 * 5))


def test_weights_stay_near_log_odds_unless_documents_demand_otherwise():
    """The words of the toxic documents keep their log odds though either would do; the base
    falls until a word of clean documents says nothing."""
    features = {"scum": 5.0, "clown": 5.0, "of": 5.0}
    labels = np.array([1.0] * 20 + [0.0] * 80)
    model = toxicity.fit_bags(features, labels, np.full(100, 4.0), [[[0, 1]]] * 20 + [[[2]]] * 80)
    chance = lambda z: 1 / (1 + math.exp(-z))
    assert model.weights["scum"] >= 4.99 and model.weights["clown"] >= 4.99
    assert chance(model.base + model.weights["scum"] + model.weights["clown"]) > 0.9
    assert chance(model.base + model.weights["of"]) < 0.1


def test_sentences_have_places():
    text = "One. Two!  Three\n\nFour? 3.5 is no end."
    found = toxicity.sentences(text)
    assert [s for _, s in found] == ["One.", "Two!", "Three", "Four?", "3.5 is no end."]
    assert all(text[a : a + len(s)] == s for a, s in found)


@pytest.mark.parametrize("labels", [[], [(4, 1, 1)], [(4, 1, 0), (5, 0, 1)]])
def test_classifiers_take_awkward_rows(spark, labels):
    docs, labels = documents(spark, AWKWARD), spark.createDataFrame(labels, LABELS)
    for scored in (quality.score(docs, quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels))):
        rows = scored.collect()
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 for r in rows)


def test_classifiers_take_empty_tables(spark):
    docs, labels = documents(spark, []), spark.createDataFrame([], LABELS)
    assert quality.score(docs, quality.fit(docs, labels)).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert langid.identify(docs, langid.fit(docs)).count() == 0


def plain_phrases(text, training):
    """Greedy parse into the longest pieces found in the training text; an unknown character is a piece."""
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in training:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_equal_a_plain_parse():
    draw = random.Random(3)
    train = {k: "".join(draw.choice(a) for _ in range(600)) for k, a in (("aa", "abc "), ("bb", "bcd "), ("cc", "aadd "))}
    model = langid.build_model({k: [v] for k, v in train.items()})
    train = {k: langid._normal(v) for k, v in train.items()}
    texts = ["".join(draw.choice("abcd ") for _ in range(n)) for n in (1, 2, 17, 300, 1024)] + ["zzz", "ab中"]
    counts = langid.phrase_counts(model, texts)
    for t, row in zip(texts, counts.tolist(), strict=True):
        # every character outside the automaton ends a phrase, so a parse may count one piece less than phrases + 1
        for k, language in enumerate(model.languages):
            assert abs(row[k] - plain_phrases(t, train[language])) <= 1 + sum(c not in train[language] for c in t)


def test_long_texts_are_parsed_in_blocks():
    model = langid.build_model({"aa": ["abcabcabd" * 30], "bb": ["xyzzyx" * 30]})
    one = "abcabd" * 400
    whole = langid.phrase_counts(model, [one])
    pieces = langid.phrase_counts(model, [one[i : i + langid.BLOCK] for i in range(0, len(one), langid.BLOCK)])
    assert whole.tolist() == [pieces.sum(axis=0).tolist()]


def test_language_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    held = [i for i in truth if crc(i, 4) == 2]
    assert len(got) == len(truth) and np.mean([got[i].lang_pred == truth[i] for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_of_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, (20, "der die das und", "de"), (21, "the of and with", None)])
    rows = langid.identify(docs, langid.fit(docs)).collect()
    assert len(rows) == len(AWKWARD) + 2
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 6)} == {langid.UNKNOWN}
    assert all(r.lang_pred in ("en", "de") for r in rows if r.doc_id in (4, 5, 20))
