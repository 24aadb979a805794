"""Small tables with the awkward rows that every operator must take."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        *[T.StructField(n, T.StringType()) for n in ("score", "rate", "shares", "key", "fp", "start", "ranges", "_words", "rank")],
    ]
)
LABELS = "doc_id long, quality int, toxic int"
EXTRA = ("x",) * 9


def documents(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]) as documents with extra columns."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or ""), *EXTRA) for r in rows]
    return spark.createDataFrame(full, DOCS)


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 20_000
AWKWARD = [(None, "no id here at all"), (1, None), (2, ""), (3, " \t\n "), (4, LONG), (5, "same words here"), (5, "same words here"), (6, "!!! ??? ..."), (7, "wörter ünd mehr \U0001f600")]
