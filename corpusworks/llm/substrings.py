"""Substring dedup by seed and extend.

Every window of ``length`` words holds one winnowed anchor, the least k-gram inside it, which depends
on the window's words alone. Documents meet on equal anchors. From an anchor the match is extended to
both sides: each extension to a full window is compared by hash, and the extensions that occurred
earlier are joined to maximal repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import grams, mix, texts_of, word_groups

LENGTH, ANCHOR = 20, 4
#: Text that is compared in one task, and text read before its windows are handed on.
BUCKET_BYTES, FLUSH_BYTES = 16 << 20, 8 << 20
#: Anchors expected in the sample that finds frequent anchors, per bucket, and how many make one frequent.
SAMPLED, FREQUENT = 32, 8
_LOW = 16


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the rightmost least value of each run of ``width``."""
    value, place, span = values, np.arange(len(values)), 1
    while span * 2 <= width:
        right = value[span:] <= value[:-span]
        value, place, span = np.where(right, value[span:], value[:-span]), np.where(right, place[span:], place[:-span]), span * 2
    if span < width:
        rest = width - span
        right = value[rest:] <= value[:-rest]
        place = np.where(right, place[rest:], place[:-rest])
    return place


def windows(hashes: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(document, start in it, hash, place of the anchor, its hash) of all windows of some texts' words."""
    if len(hashes) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64, np.uint64))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    seeds = grams(hashes, anchor)
    start = np.arange(len(hashes) - length + 1)
    start = start[doc[start] == doc[start + length - 1]]
    place = _least(seeds, length - anchor + 1)[start]
    return doc[start], start - offsets[doc[start]], grams(hashes, length)[start], place, seeds[place]


def _runs(*columns: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where a new run begins: another value in a column, or a gap between starts."""
    new = np.concatenate([[True], start[1:] != start[:-1] + 1])
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _ranges(ids: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, from, to) word ranges that windows sorted by (id, start) cover."""
    if not len(ids):
        return ids, start, start
    begin = _runs(ids, start=start)
    end = np.append(begin[1:], len(ids)) - 1
    return ids[begin], start[begin], start[end] + length


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], dtype=np.int64).tobytes(), *(a.tobytes() for a in arrays)])


_TYPES = (np.uint64, np.int64, np.int32, np.uint8, np.uint8, np.int64, np.int32, np.int32)


def _unpack(blob: bytes) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, dtype=np.int64, count=len(_TYPES))
    at, out = 8 * len(_TYPES), []
    for n, kind in zip(sizes, _TYPES, strict=True):
        out.append(np.frombuffer(blob, dtype=kind, count=n, offset=at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _six(wide: np.ndarray) -> np.ndarray:
    """The upper 48 bits of each hash as bytes."""
    return wide.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].ravel()


def _wide(six: np.ndarray) -> np.ndarray:
    out = np.zeros((len(six) // 6, 8), dtype=np.uint8)
    out[:, :6] = six.reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.uint64)


def _blobs(ids: np.ndarray, texts: list[bytes], frequent: np.ndarray, buckets: int, length: int, anchor: int) -> pa.RecordBatch:
    """One row per bucket: the extensions around each anchor, without those seen earlier in the same texts.

    A repeat inside these texts is settled here, and its word range rides along; so a passage with many
    copies leaves each task once.
    """
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[i] for i in order]
    doc, start, wide, place, seed = [], [], [], [], []
    shift = 0
    for first, _, hashes, offsets in word_groups(texts):
        d, s, w, p, k = windows(hashes, offsets, length, anchor)
        for column, x in zip((doc, start, wide, place, seed), (ids[first + d], s, w, p + shift, k), strict=True):
            column.append(x)
        shift += len(hashes)
    doc, start, wide, place, seed = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (doc, start, wide, place, seed))
    if not len(doc):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int32()), pa.array([], pa.binary())], names=["bucket", "blob"])
    late = _later(wide, seed, doc, start)
    done = _ranges(doc[late], start[late], length)
    doc, start, wide, place, seed = (x[~late] for x in (doc, start, wide, place, seed))
    route = np.where(_among(seed, frequent), mix(seed ^ wide), mix(seed))
    bucket = (route % np.uint64(buckets)).astype(np.int32)
    by = np.argsort(bucket, kind="stable")
    doc, start, wide, place, seed, bucket = (x[by] for x in (doc, start, wide, place, seed, bucket))
    begin = _runs(bucket, doc, place, start=start)
    sizes = np.diff(np.append(begin, len(doc)))
    done_bucket = (mix(done[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    done_by = np.argsort(done_bucket, kind="stable")
    done, done_bucket = [x[done_by] for x in done], done_bucket[done_by]
    rows, blobs = np.union1d(bucket, done_bucket), []
    edge = np.searchsorted(bucket, rows), np.searchsorted(bucket, rows, side="right")
    run_edge = np.searchsorted(begin, edge[0]), np.searchsorted(begin, edge[1])
    done_edge = np.searchsorted(done_bucket, rows), np.searchsorted(done_bucket, rows, side="right")
    for i in range(len(rows)):
        r, d = slice(run_edge[0][i], run_edge[1][i]), slice(done_edge[0][i], done_edge[1][i])
        b = begin[r]
        blobs.append(
            _pack(
                seed[b], doc[b].astype(np.int64), start[b].astype(np.int32), sizes[r].astype(np.uint8), _six(wide[edge[0][i] : edge[1][i]]),
                done[0][d].astype(np.int64), done[1][d].astype(np.int32), done[2][d].astype(np.int32),
            )
        )
    return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])


def _among(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def _later(wide: np.ndarray, seed: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of windows in order of (doc, start): which are equal to an earlier one. The same place counts once."""
    order = np.argsort(wide, kind="stable")
    w, s = wide[order], seed[order]
    first = np.concatenate([[True], (w[1:] != w[:-1]) | (s[1:] != s[:-1])])
    head = order[np.maximum.accumulate(np.where(first, np.arange(len(w)), 0))]
    out = np.zeros(len(wide), dtype=bool)
    out[order] = (doc[head] != doc[order]) | (start[head] != start[order])
    return out


def _compare(length: int):
    """All blobs of a bucket → id, from, to of the words in windows that occurred earlier."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack(b) for b in table.column("blob").to_pylist()]
        seed, doc, start, size, six, done_doc, done_from, done_to = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.cumsum(size, dtype=np.int64)
        order = np.lexsort((start, doc))
        n = size[order].astype(np.int64)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = _wide(six)[np.repeat(ends[order] - n, n) + inner]
        seed, doc, start = (np.repeat(x[order], n) for x in (seed, doc, start))
        start = start + inner
        late = _later(wide | (seed & np.uint64((1 << _LOW) - 1)), seed, doc, start)
        doc, begin, end = _ranges(doc[late], start[late], length)
        return pa.table(
            {
                "doc_id": np.concatenate([doc, done_doc]),
                "start": np.concatenate([begin, done_from]).astype(np.int32),
                "end": np.concatenate([end, done_to]).astype(np.int32),
            }
        )

    return run


def _flushes(batches, work):
    """Collect rows up to FLUSH_BYTES of text and hand them to ``work`` as (ids, texts)."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t)
            if held >= FLUSH_BYTES:
                yield work(np.array(ids, dtype=np.int64), texts)
                ids, texts, held = [], [], 0
    if ids:
        yield work(np.array(ids, dtype=np.int64), texts)


def frequent_anchors(rows: DataFrame, size: int, buckets: int, length: int, anchor: int) -> np.ndarray:
    """Hashes of anchors that hold more than a fraction of a bucket, estimated from a sample of documents.

    This only chooses the way to a bucket (by anchor, or by window), never the result. A sample of
    SAMPLED anchors per bucket with FREQUENT needed gives SAMPLED / FREQUENT hashes per bucket at most.
    """
    about = max(1, size // 6 * 2 // (length - anchor + 2))
    share = min(1.0, SAMPLED * buckets / about)
    sample = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("anchors")), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches):
        def work(ids, texts):
            found = []
            for _, _, hashes, offsets in word_groups(texts):
                doc, _, _, place, seed = windows(hashes, offsets, length, anchor)
                if len(doc):
                    found.append(seed[_runs(doc, place, start=np.arange(len(doc)))])
            value, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["seed", "n"])

        yield from _flushes(batches, work)

    found = sample.mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return np.sort(np.array([r.seed for r in found.select("seed").collect()], dtype=np.int64).view(np.uint64))


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, start, end: word ranges of maximal repeats, pieces of at least ``length`` words each word of
    which is covered by a window whose words also start earlier (smaller doc_id, or earlier in the document).
    Ranges of a document may touch or overlap.

    Rows with a null id or text give nothing and count as no source. Rows that share an id count as one
    document: the same words at the same place are one window. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null and text is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    frequent = frequent_anchors(rows, size, buckets, length, anchor)

    def emit(batches):
        yield from _flushes(batches, lambda ids, texts: _blobs(ids, texts, frequent, buckets, length, anchor))

    return rows.mapInArrow(emit, "bucket int, blob binary").groupBy("bucket").applyInArrow(_compare(length), "doc_id long, start int, end int")


def cut(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every row after the words in ``ranges`` are taken out.

    Kept words are joined by one space; a null text counts as empty.
    """
    listed = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    def run(batches):
        for batch in batches:
            words, removed, kept = [], [], []
            for t, spans in zip(texts_of(batch), batch.column("ranges").to_pylist(), strict=True):
                all_of = t.split()
                gone = np.zeros(len(all_of) + 1, dtype=np.int64)
                for s in spans or []:
                    gone[min(s["start"], len(all_of))] += 1
                    gone[min(s["end"], len(all_of))] -= 1
                stays = np.cumsum(gone)[:-1] == 0
                left = all_of if stays.all() else [w for w, k in zip(all_of, stays.tolist(), strict=True) if k]
                words.append(len(all_of))
                removed.append(len(all_of) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    joined = docs.select(F.col("doc_id").cast("long"), "text").join(listed, "doc_id", "left")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept_text", F.col("kept").cast("string"))

