"""Base spans against plain Python, expectation-maximisation against planted reliabilities, and the added spans."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusworks.llm import pii
from corpusworks.llm.queries import QUERIES
from tests.llm.helpers import AWKWARD, documents

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def right(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in hit.split(".")),
        "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 9 <= len(digits) <= 15,
    }[kind]()


def plain(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if right(k, m.group())]


def spans(rows, base=True):
    return [[(s.kind, s.start, s.stop) for s in r.spans if s.base == base] for r in rows]


def test_base_spans_of_odd_texts(spark):
    draw = random.Random(11)
    pieces = ["4111 1111 1111 1111", "4111-1111-1111-1112", "a.b+c@d-e.org", "x@y", "@z.com", "_q@r.s", "1.2.3.4", "256.1.1.1", "000255.0.0.00001",
              "+1 (555) 010-9999", "+12", "+1.2.3.4.5.6.7.8.9", "7", "0", "+", "-", ".", " ", "@", "é", "\U0001f600", "\n", "(", "12345678901234567890", "a" * 40]
    texts = ["".join(draw.choices(pieces, k=draw.randint(1, 40))) for _ in range(1500)]
    rows = pii.detect(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    expected = [plain(t) for t in texts]
    assert sum(map(len, expected)) > 1500 and spans(rows) == expected


def test_query_on_given_documents(spark, sf):
    import hashlib

    given = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op11_personal_data"](spark, sf).collect()
    assert len(got) == len(given)
    for r in got:
        base = plain(given[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base) for k in PLAIN]
        listed = r.spans.split(",") if r.spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(listed) and len(set(listed)) == len(listed)


def test_long_texts_take_linear_time(spark):
    texts = ["a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "a@b." + "c." * 300_000 + "d", "+1 2" * 100_000, "1 " * 500_000, "x@y.zz " * 60_000, "1.2.3.4 " * 60_000]
    rows = pii.detect(documents(spark, list(enumerate(texts)))).orderBy("doc_id").collect()
    found = spans(rows)
    assert found[0] == [] and found[6] == [("email", 7 * i, 7 * i + 6) for i in range(60_000)]
    assert found[7] == [("ip", 8 * i, 8 * i + 7) for i in range(60_000)] and len(found[3]) == 1


def test_awkward_rows(spark):
    rows = pii.detect(documents(spark, [*AWKWARD, (9, "mail a@b.org"), (9, "mail a@b.org")])).collect()
    assert len(rows) == len(AWKWARD) + 2 and [len(r.spans) for r in rows if r.doc_id == 9] == [1, 1]
    assert pii.detect(documents(spark, [])).count() == 0


def test_reliabilities_are_found():
    """Votes drawn from known labelers give their reliabilities and the share of yes back."""
    draw = np.random.default_rng(2)
    truth = draw.random(200_000) < 0.3
    good = [(0.9, 0.1), (0.8, 0.05), (0.7, 0.2), (0.95, 0.3)]  # chance of voting yes where true, where not
    votes = np.zeros(len(truth), dtype=int)
    for yes, no in good:
        votes = votes * 3 + np.where(draw.random(len(truth)) < np.where(truth, yes, no), 1, 2)
    posterior, table, share = pii.posteriors(np.bincount(votes, minlength=3**pii.VOTERS).astype(float))
    assert abs(share - 0.3) < 0.01
    for j, (yes, no) in enumerate(good):
        assert abs(table[j, 1, 1] - yes) < 0.02 and abs(table[j, 0, 1] - no) < 0.02
    assert ((posterior[votes] > 0.5) == truth).mean() > 0.95


def test_spans_beyond_the_patterns(spark):
    """Written-out addresses and national numbers are added, dates and numbers that fail their check are not."""
    draw = random.Random(3)
    rows = []
    for i in range(400):
        n = lambda k: "".join(draw.choices("0123456789", k=k))
        rows.append(
            draw.choice(
                [f"please call +1 ({n(3)}) 555-{n(4)} now", f"phone: (2{n(2)}) 555-{n(4)} today", f"on {n(4)}-{n(2)}-{n(2)} it rained", f"mail u{n(2)}@host.com", f"contact u{n(3)} [at] host [dot] com please"]
            )
        )
    got = pii.detect(documents(spark, list(enumerate(rows)))).orderBy("doc_id").collect()
    added = spans(got, base=False)
    for text, more in zip(rows, added, strict=True):
        if text.startswith(("phone:", "contact")):
            assert len(more) == 1 and text[more[0][1] : more[0][2]] in text
        else:
            assert more == [], text


def test_no_python_workers(spark, sf):
    plan = pii.detect(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    found = pii.candidates(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan + found) and "Exchange" not in found


@pytest.mark.parametrize("size", [1, 255, 256, 257, 70_000])
def test_running_sums(spark, size):
    sizes = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: (i % 7).cast("long")).alias("s"))
    got = sizes.select(pii._running(F.col("s")).alias("r")).first().r
    assert got == [0, *np.cumsum([i % 7 for i in range(1, size)]).tolist()]
