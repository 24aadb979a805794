"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared runs of SEED words (Karp-Rabin hashes). Of each pair,
the longest common run that is still unmarked on both sides is marked, again and again; the marked
share of the item's words is its coverage. Tiles may lie in any order, so reordered passages count.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusworks.llm.common import arrow_map, by_bytes, grams, word_groups

#: Words of a seed, and least share of an item's words under tiles.
SEED, COVERAGE = 5, 0.5
#: Benchmark words per block. Blocks bound what is sent to every task (16 bytes a word); documents are
#: read once per block.
BLOCK_WORDS = 2_000_000
#: Bytes of text hashed at once.
_PIECE = 1 << 17

_APART = np.ones(256, dtype=bool)
_APART[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_PUNCTUATION = re.compile(r"[^\w\s]|_")


def normal(text: str | None) -> bytes:
    """Lower case; punctuation outside ASCII parts words as ASCII punctuation does."""
    text = (text or "").lower()
    return (text if text.isascii() else _PUNCTUATION.sub(" ", text)).encode()


def _hashes(texts: list[str | None]) -> list[np.ndarray]:
    out = []
    for _, _, hashes, offsets in word_groups([normal(t) for t in texts], _APART, _PIECE):
        out += [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def tiles(starts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in document, place in item, length) of marked runs, longest first; ties go to
    the earlier place in the item, then in the document.

    ``starts`` are places of equal seeds. Candidates are the maximal runs through them. A run that
    overlaps marked words is cut to what is left of it and waits for its new length.
    """
    least = SEED
    seen, runs = set(starts), []
    for d, i in starts:
        if (d - 1, i - 1) not in seen:
            n = least
            while (d + n - least + 1, i + n - least + 1) in seen:
                n += 1
            runs.append((n, i, d))
    by_length: dict[int, list[tuple[int, int]]] = {}
    for n, i, d in runs:
        by_length.setdefault(n, []).append((i, d))
    in_document, in_item, out = set(), set(), []
    for length in range(max(by_length, default=0), least - 1, -1):
        for i, d in sorted(by_length.pop(length, ())):
            free = [i + k not in in_item and d + k not in in_document for k in range(length)]
            if all(free):
                in_item.update(range(i, i + length))
                in_document.update(range(d, d + length))
                out.append((d, i, length))
                continue
            k = 0
            while k < length:
                if not free[k]:
                    k += 1
                    continue
                end = k
                while end < length and free[end]:
                    end += 1
                if end - k >= least:
                    by_length.setdefault(end - k, []).append((i + k, d + k))
                k = end
    return out


class _Items:
    """A block of benchmark items: their words, and sorted seed hashes with item and place."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [r[0] for r in rows]
        self.words = _hashes([r[1] for r in rows])
        seeds = [grams(w, SEED) for w in self.words]
        self.seeds = np.concatenate([*seeds, np.empty(0, np.uint64)])
        self.item = np.repeat(np.arange(len(rows)), [len(s) for s in seeds])
        self.place = np.concatenate([*(np.arange(len(s)) for s in seeds), np.empty(0, np.int64)])
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.item, self.place = self.seeds[order], self.item[order], self.place[order]


def _matches(items: _Items, hashes: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """(document, item) → places of equal seeds, for some texts' words."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    found: dict[tuple[int, int], list[tuple[int, int]]] = {}
    seeds = grams(hashes, SEED)
    if not len(seeds):
        return found
    left = np.searchsorted(items.seeds, seeds, side="left")
    hit = np.flatnonzero(items.seeds[np.minimum(left, len(items.seeds) - 1)] == seeds)
    hit = hit[owner[hit] == owner[hit + SEED - 1]]
    right = np.searchsorted(items.seeds, seeds[hit], side="right")
    for at, a, b in zip(hit.tolist(), left[hit].tolist(), right.tolist(), strict=True):
        d = int(owner[at])
        for k in range(a, b):
            found.setdefault((d, int(items.item[k])), []).append((at - int(offsets[d]), int(items.place[k])))
    return found


def _pairs(items: _Items, texts: list[str | None], coverage: float):
    """(text, item id, coverage, tiles, longest tile) of the pairs that reach the coverage."""
    for first, _, hashes, offsets in word_groups([normal(t) for t in texts], _APART, _PIECE):
        for (d, i), starts in _matches(items, hashes, offsets).items():
            size = len(items.words[i])
            if len({p for _, p in starts}) * SEED < coverage * size:
                continue  # a shared place covers SEED words at the most
            marked = [n for _, _, n in tiles(starts)]
            if sum(marked) >= coverage * size:
                yield first + d, items.ids[i], sum(marked) / size, len(marked), max(marked)


def _scan(items: _Items, coverage: float):
    def run(batches):
        for batch in by_bytes(batches):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[p[0]], *p[1:]) for p in _pairs(items, batch.column("text").to_pylist(), coverage)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            names = ("doc_id", "item_id", "coverage", "n_tiles", "longest")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _blocks_of_items(benchmark: DataFrame, block_words: int):
    for block in blocks(benchmark, block_words):
        items = _Items(sorted({(r.item_id, r.text) for r in block.collect()}))
        if len(items.seeds):
            yield items


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> list[DataFrame]:
    """The benchmark cut by a hash of the item id into blocks of about ``block_words`` words."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)] if n > 1 else [items]


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, longest: pairs whose tiles cover ``coverage`` or more of the item.

    Words are compared in lower case without punctuation. Null texts, null item ids and items of fewer
    than SEED words match nothing. Repeated items count once; an item_id with two texts can give two
    rows. Repeated documents give repeated rows; a null doc_id is kept as it is. Other columns are ignored.
    No shuffle: each block of items goes to every task, bounded by ``block_words``.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    out = None
    for items in _blocks_of_items(benchmark, block_words):
        part = arrow_map(rows, _scan(items, coverage), "doc_id long, item_id long, coverage double, n_tiles int, longest int")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, coverage double, n_tiles int, longest int")
    return out


def without(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows, with all their columns, whose text holds no benchmark item by that coverage; no shuffle."""

    def clean_of(items: _Items):
        def run(batches):
            for batch in by_bytes(batches):
                held = {p[0] for p in _pairs(items, batch.column("text").to_pylist(), coverage)}
                yield batch.filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))

        return run

    for items in _blocks_of_items(benchmark, block_words):
        docs = arrow_map(docs, clean_of(items), docs.schema)
    return docs
