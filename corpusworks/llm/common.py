"""Helpers shared by the training-data operators: tables, labelled samples, word hashes, Arrow loops."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusworks.session import materialise, scratch_path

__all__ = ["materialise", "scratch_path", "table", "remainder", "labelled_sample", "arrow_map", "grams", "word_groups", "mix"]

SAMPLE_BITS = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus


def bounded(rows: DataFrame, id_column: str, most: int) -> DataFrame:
    """About ``most`` rows, chosen by a hash of the id, or all if there are fewer. No shuffle of rows."""
    n = rows.count()
    if n <= most:
        return rows
    share = int(most / n * (1 << SAMPLE_BITS))
    return rows.where(F.pmod(F.xxhash64(F.col(id_column), F.lit("sample")), F.lit(1 << SAMPLE_BITS)) < share)


def labelled_sample(labels: DataFrame, label: str, modulus: int, held_out: int, most: int) -> DataFrame:
    """doc_id, label (0 or 1) of rows that may be learned from, ``most`` of them at the most.

    Rows with a null id or label, another label than 0 and 1, or in the held-out fold are left out;
    so are ids that carry both labels. Repeated rows count once.
    """
    may = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder("doc_id", modulus) != held_out)
    )
    chosen = bounded(may, "doc_id", most)
    one = chosen.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_other"))
    return one.where("label = _other").drop("_other")


#: Bytes of text that a task works on at once, when a batch holds more.
TAKEN = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], name: str = "text", most: int = TAKEN) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows of about ``most`` bytes of text; a row stays whole.

    Memory that is free by the end of a task goes back to the machine: workers live on between tasks.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, first = np.cumsum(sizes + 64), 0  # rows without text cost something too
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
            yield batch.slice(first, last - first)
            first = last
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Bytes of rows sent to Python at once; Spark's own bound of 64 MB takes a whole task's texts, which the executor and
#: its worker then hold at the same time.
SENT, SENT_KEY = 1 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def arrow_map(
    df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType
) -> DataFrame:
    """mapInArrow over batches of about SENT bytes; a row stays whole. Sets this bound for the session, if it has none."""
    if df.sparkSession.conf.get(SENT_KEY, None) is None:
        df.sparkSession.conf.set(SENT_KEY, f"{SENT}b")
    return df.mapInArrow(batches, schema)


# --- word hashes ------------------------------------------------------------------------------------------------------

_WHITE = np.zeros(256, dtype=bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, size=256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = np.ones((2, 0), dtype=np.uint64)
PIECE = 1 << 20


def _powers(n: int) -> np.ndarray:
    """The first n powers, or more, of the base and its inverse; the longest made so far are kept."""
    global _POWERS
    if _POWERS.shape[1] >= n:
        return _POWERS
    size = 1 << max(16, (n - 1).bit_length())
    steps = np.full((2, size), [[_BASE], [_INVERSE]], dtype=np.uint64)
    steps[:, 0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(steps, axis=1, out=steps)
    if size <= 2 * PIECE:  # more is for one very long word: not worth keeping
        _POWERS = steps
    return steps


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_piece(raw: bytes, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of a piece of text."""
    buf = np.frombuffer(raw, dtype=np.uint8)
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~split[buf]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
        return starts, mix((sums[ends] - sums[starts]) * down[starts])


def word_groups(
    texts: list[bytes], split: np.ndarray = _WHITE, piece: int = PIECE
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, hashes, offsets) for runs of texts of about ``piece`` bytes together.

    ``hashes`` are 64-bit word hashes of texts[first:last] in order, ``offsets`` where each text's words
    begin in it, with the end added. ``split`` marks the bytes that part words. A text longer than
    ``piece`` is hashed piece by piece, cut at white space.
    """
    white = re.compile(b"[" + b"".join(b"\\x%02x" % b for b in np.flatnonzero(split)) + b"]")
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < piece):
            size += len(texts[last]) + 1
            last += 1
        if size <= 2 * piece or last > first + 1:
            raw = b" ".join(texts[first:last])
            begins = np.cumsum([0] + [len(t) + 1 for t in texts[first:last]])
            starts, hashes = _hash_piece(raw, split)
            yield first, last, hashes, np.searchsorted(starts, begins)
        else:
            text, parts, at = texts[first], [], 0
            while at < len(text):
                cut = white.search(text, at + piece)
                end = cut.start() if cut else len(text)
                parts.append(_hash_piece(text[at:end], split)[1])
                at = end
            hashes = np.concatenate(parts)
            yield first, last, hashes, np.array([0, len(hashes)])
        first = last


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words; n - k + 1 values, by doubling."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, power, width = None, 0, hashes, 1
    with np.errstate(over="ignore"):
        while True:
            if k & width:  # append `width` words after the `done` words so far
                tail = power[done : done + n]
                out = tail if out is None else out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + tail
                done += width
            if width * 2 > k:
                return mix(out[:n])
            power = power[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
            width *= 2


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [t or b"" for t in batch.column(name).cast(pa.binary()).to_pylist()]
