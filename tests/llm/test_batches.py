"""What Spark hands to a Python worker at once, and what the worker keeps."""

import pyarrow as pa
import pytest

from corpusworks.llm import common, decontam, mixing, nearcopies, secrets
from tests.llm.helpers import documents

TEXTS = [(i, f"{i} " + "alpha beta gamma delta epsilon zeta " * 1_000) for i in range(300)]


def sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])


def decontaminated(spark, docs):
    decontam.without(docs, spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string"))


def contaminated(spark, docs):
    decontam.contaminated(docs, spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string"))


def signatures(spark, docs):
    nearcopies.signatures(docs, 5, 0.8, True)


def redacted(spark, docs):
    secrets.redact(docs, secrets.learn(docs.limit(2)))


def shares(spark, docs):
    mixing.mixed(docs.limit(40), spark.createDataFrame([(i, ("en", "de")[i % 2]) for i in range(40)], "doc_id long, domain string"))


@pytest.mark.parametrize("step", [decontaminated, contaminated, signatures, redacted, shares])
def test_a_worker_gets_texts_by_the_megabyte(spark, step):
    spark.conf.unset(common.SENT_KEY)
    docs = documents(spark, TEXTS).coalesce(1)
    step(spark, docs)
    rows = docs.select("text").mapInArrow(sizes, "n long, size long").collect()
    assert sum(r.n for r in rows) == len(TEXTS) and max(r.size for r in rows) < 2 * common.SENT


def test_a_bound_of_the_session_holds_and_long_rows_stay_whole(spark):
    spark.conf.set(common.SENT_KEY, "300k")
    try:
        rows = common.arrow_map(documents(spark, [(1, "x" * 3_000_000), *TEXTS]).coalesce(1).select("text"), sizes, "n long, size long").collect()
        assert spark.conf.get(common.SENT_KEY) == "300k"
        assert sum(r.n for r in rows) == 301 and sum(r.size > 600_000 for r in rows) == 1
    finally:
        spark.conf.unset(common.SENT_KEY)


def test_power_tables_are_no_longer_than_the_texts(monkeypatch):
    monkeypatch.setattr(common, "_POWERS", common._POWERS[:, :0])
    whole = [h.tolist() for _, _, h, _ in common.word_groups([t.encode() for _, t in TEXTS], piece=1 << 20)]
    monkeypatch.setattr(common, "_POWERS", common._POWERS[:, :0])
    small = [h.tolist() for _, _, h, _ in common.word_groups([t.encode() for _, t in TEXTS], piece=1 << 17)]
    assert sum(whole, []) == sum(small, []) and common._POWERS.nbytes <= 16 << 18
