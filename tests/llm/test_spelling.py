"""Spelling variants against all pairs, and the keys of each word against every possible edit."""

import random
import re
import zlib
from collections import Counter

import pytest

from corpusworks.llm import spelling
from tests.llm.helpers import AWKWARD, documents


def plain_words(rows, least=7, damage=31):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(str.maketrans(spelling.UPPER, spelling.LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= least:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, ratio=10):
    words, near = plain_words(rows), {}
    for w in words:
        near[w] = [v for v in words if abs(len(v) - len(w)) <= 1 and v != w and one_edit(v, w)]
    form = {w: next(iter(sorted(near[w], key=lambda v: (-words[v], v))), None) for w in words}
    form = {w: f if f and words[f] >= ratio * words[w] else None for w, f in form.items()}
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def found(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("longest_list", [2, 8, 64])
def test_equals_all_pairs(spark, longest_list):
    draw = random.Random(longest_list)
    parts = ["tion", "ver", "an", "ei", "ñó", "ck", "le", "st", "×a", "é"]
    base = ["".join(draw.choices(parts, k=draw.randint(3, 5))) for _ in range(60)]
    texts = []
    for i in range(400):
        row = []
        for w in draw.choices(base, weights=[3 ** (k % 7) for k in range(60)], k=30):
            if draw.random() < 0.15:
                at = draw.randrange(len(w))
                w = w[:at] + draw.choice(["", "x", w[at] * 2, "ö"]) + w[at + 1 :]
            row.append(draw.choice([w, w.upper(), w.title()]))
        texts.append((draw.choice([i, i, 7, None]), draw.choice([" ", "_", "3", "ę"]).join(row)))
    expected = plain_variants(texts)
    assert sum(r[1] is not None for r in expected) > 10
    assert found(spelling.variants(documents(spark, texts), longest_list=longest_list)) == expected


def test_equals_all_pairs_on_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    expected = plain_variants([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert found(spelling.variants(docs)) == expected


@pytest.mark.parametrize("share", [0.0, 0.5, 0.9, 1.0])
def test_every_edit_leaves_a_shared_key(share):
    """Whatever the dictionary says, both words of an edit stand on a common list."""
    draw = random.Random(5)
    bits = bytes(sum((draw.random() < share) << k for k in range(8)) for _ in range(1 << 16)) * (spelling.SLOTS >> 19)
    for _ in range(200):
        word = "".join(draw.choices("abcé", k=draw.choice([*range(7, 25), 63, 64, 65, 90])))
        mine = spelling.keys_of(word, bits)
        for at in range(len(word) + 1):
            for other in {word[:at] + "z" + word[at:], word[:at] + "a" + word[at:], word[:at] + "b" + word[at + 1 :]} - {word}:
                assert mine & spelling.keys_of(other, bits), (word, other)


def test_lists_are_short(spark):
    """However many words share a beginning and an end, no list holds more than the limit, pairs of grams aside."""
    names = [(i, f"internation{i:05d}".translate(str.maketrans("0123456789", "abcdefghij")) + "alisation") for i in range(3000)]
    texts = [(i, f"{w} {w}") for i, w in names]
    known = spelling.words(documents(spark, texts), damage=1 << 40)
    keyed = spelling.lists(known, spelling.dictionary(known)).groupBy("key").count().collect()
    assert known.count() == 3000 and max(r["count"] for r in keyed) <= spelling.LIST


def test_ties_chains_and_awkward_rows(spark):
    rows = [(1, "abcdefgh " * 2 + "abcdefgx " * 20 + "abcdefgw " * 20 + "abcdefwx " * 300)]
    got = {r[0]: r for r in found(spelling.variants(documents(spark, rows), damage=1 << 40))}
    assert got["abcdefgh"] == ("abcdefgh", "abcdefgw", "abcdefgw", 2, 2, 20)
    assert got["abcdefgx"] == ("abcdefgx", "abcdefwx", "abcdefwx", 20, 3, 300)
    assert got["abcdefwx"][1] is None and got["abcdefwx"][2] == "abcdefwx"
    long = [(3, "q" * 200_000 + " " + "q" * 200_000 + " " + "q" * 199_999 + " " + "q" * 199_999)]
    assert found(spelling.variants(documents(spark, AWKWARD))) == plain_variants([(r[0], r[1]) for r in AWKWARD])
    assert spelling.words(documents(spark, long), damage=1 << 40).count() == 2
    assert spelling.variants(documents(spark, [])).count() == 0
    everywhere = bytes([255]) * (spelling.SLOTS // 8)
    assert len(spelling.keys_of("qr" * 50_000, everywhere)) == 100_001  # no quadratic work on long words
    with pytest.raises(ValueError):
        spelling.variants(documents(spark, []), ratio=1)
