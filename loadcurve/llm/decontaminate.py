"""Benchmark decontamination: SimHash of windows inside items, searched by Hamming blocks.

Words are lower-case runs of letters and digits of texts in one form (:func:`fold_texts`),
shingles five of them.  An item
of ``n`` shingles is given a window size ``w`` that follows from ``n``: large
enough to be told apart, small enough that any passage of similarity
``threshold`` still holds an unbroken run of ``w + STRIDE - 1`` shingles.  All
``w``-windows of the item have their 64-bit SimHash filed in four tables by
16-bit blocks; each document's ``w``-windows at every ``STRIDE`` shingles look
theirs up.  Fingerprints within ``RADIUS`` = 3 bits agree in at least one block
(four blocks, three differences), so none of them is missed, and a passage's
unbroken run gives a window at distance 0.  Each candidate place is then
verified by the weighted Jaccard similarity of the item's shingles and the
shingles of the document's item-sized window there (weights are their counts).
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches
from . import textgrams as tg
from .labelled import with_scores

NGRAM, STRIDE, RADIUS = 5, 4, 3
_SIZES = (64, 48, 32, 24, 16, 12, 8, 6, 4, 3, 2, 1)
_U = np.uint64


_MARKS = re.compile(r"[^\x00-\x7f\w]+")


def fold_texts(column: pa.Array) -> pa.Array:
    """Texts in one form: compatibility-normalised, case-folded, other than letters and digits beyond ASCII as spaces.

    So typographic apostrophes, no-break spaces, ligatures and capitals of any
    script compare equal to their plain forms.  ASCII texts stay as they are:
    what splits them into words lowers their letters.  A null is empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    other = np.flatnonzero(np.asarray(pc.binary_length(column)) != np.asarray(pc.utf8_length(column)))
    if not len(other):
        return column
    texts = column.to_pylist()
    for i in other:
        texts[i] = _MARKS.sub(" ", unicodedata.normalize("NFKC", texts[i]).casefold())
    return pa.array(texts, pa.large_string())


def _shingles(data, offsets):
    h, row, _, _ = tg.words(data, offsets, tg.LETTERS)
    return tg.shingles(h, row, len(offsets) - 1, NGRAM)


def _window_size(n: int, threshold: float) -> int:
    """The largest window whose unbroken, aligned copy any passage of ``threshold`` must hold.

    Of ``n`` shingles a passage of that similarity lacks at most
    ``n (1 - t) / (1 + t)``; an inner word's change breaks five, so the rest
    stands in few runs.
    """
    lost = n * (1 - threshold) / (1 + threshold)
    run = (n - lost) / (lost / NGRAM + 1)
    return next((s for s in _SIZES if s + STRIDE - 1 <= run), 0)


def simhash(bits: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """SimHash of windows of ``size`` shingles; ``starts`` and ``ends`` are places in the running sums ``bits``."""
    more = 2 * (bits[ends] - bits[starts]) > size
    return np.packbits(more, axis=1, bitorder="little").view(_U)[:, 0]


def _running_bits(x: np.ndarray, stride: int) -> np.ndarray:
    """Running sums of the 64 bits of every shingle, at each ``stride`` shingles."""
    n = len(x) // stride
    bits = np.unpackbits(x[: n * stride].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    groups = bits.reshape(n, stride, 64).sum(axis=1, dtype=np.uint8) if stride > 1 else bits
    out = np.zeros((n + 1, 64), np.int32)
    np.cumsum(groups, axis=0, out=out[1:])
    return out


class _Index:
    """The windows of a block of items: fingerprints, items and offsets, filed by size and block."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.threshold, self.items, self.tables, self.whole = threshold, [], {}, {}
        data, offsets = tg.text_buffer(fold_texts(pa.array([t for _, t in items], pa.large_string())))
        x, row = _shingles(data, offsets)
        h, word_row, _, _ = tg.words(data, offsets, tg.LETTERS)
        words = np.bincount(word_row, minlength=len(items))
        found: dict[int, list] = {}
        for k, (item, _) in enumerate(items):
            own = x[row == k]
            self.items.append((item, own, *np.unique(own, return_counts=True)))
            size = _window_size(len(own), threshold) if words[k] >= NGRAM else 0
            if not size:
                if len(own):  # too short for windows: its shingles are looked up as they are
                    for at, v in enumerate(own):
                        self.whole.setdefault(int(v), []).append((k, at))
                continue
            bits = _running_bits(own, 1)
            starts = np.arange(len(own) - size + 1)
            marks = simhash(bits, starts, starts + size, size)
            found.setdefault(size, []).append((marks, np.full(len(starts), k), starts))
        for size, parts in found.items():
            marks, item, at = (np.concatenate(p) for p in zip(*parts, strict=True))
            blocks = []
            for b in range(RADIUS + 1):
                key = (marks >> _U(16 * b)) & _U(0xFFFF)
                order = np.argsort(key, kind="stable")
                first = np.searchsorted(key[order], np.arange(65537, dtype=np.int64).astype(_U))
                blocks.append((order, first))
            self.tables[size] = (marks, item, at, blocks)
        self.short = np.array(sorted(self.whole), dtype=_U)

    def near(self, size: int, marks: np.ndarray):
        """(window, entry) of all fingerprints within the radius."""
        own, _, _, blocks = self.tables[size]
        found = []
        for b, (order, first) in enumerate(blocks):
            key = ((marks >> _U(16 * b)) & _U(0xFFFF)).astype(np.int64)
            n = first[key + 1] - first[key]
            hit = np.flatnonzero(n)
            if not len(hit):
                continue
            n = n[hit]
            window = np.repeat(hit, n)
            entry = order[np.repeat(first[key[hit]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            near = np.bitwise_count(marks[window] ^ own[entry]) <= RADIUS
            found.append(np.stack([window[near], entry[near]]))
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)

    def similarity(self, k: int, window: np.ndarray) -> float:
        _, _, values, counts = self.items[k]
        own, n = np.unique(window, return_counts=True)
        at = np.searchsorted(values, own)
        at[at == len(values)] = 0
        both = int(np.minimum(counts[at], n)[values[at] == own].sum())
        return both / (counts.sum() + len(window) - both)

    def search(self, x: np.ndarray, row: np.ndarray):
        """(row, item number, similarity, place) of the best place of every item in every row."""
        places: set[tuple[int, int, int]] = set()
        if len(self.short):
            for i in np.flatnonzero(np.isin(x, self.short)):
                places.update((int(row[i]), k, int(i) - at) for k, at in self.whole[int(x[i])])
        if self.tables and len(x) >= STRIDE:
            bits = _running_bits(x, STRIDE)
            for size, (_, item, at, _) in self.tables.items():
                if size % STRIDE:
                    grid, fine = np.arange(0, len(x) - size + 1, STRIDE), True
                else:
                    grid, fine = np.arange(0, len(bits) - size // STRIDE) * STRIDE, False
                if not len(grid):
                    continue
                inside = row[grid] == row[grid + size - 1]
                grid = grid[inside]
                if fine:
                    spans = x[grid[:, None] + np.arange(size)]
                    ones = np.unpackbits(spans.view(np.uint8).reshape(len(grid), size, 8), axis=2,
                                         bitorder="little").sum(axis=1, dtype=np.uint8)
                    marks = np.packbits(2 * ones.astype(np.int16) > size, axis=1, bitorder="little").view(_U)[:, 0]
                else:
                    marks = simhash(bits, grid // STRIDE, (grid + size) // STRIDE, size)
                window, entry = self.near(size, marks)
                if len(window):
                    places.update(zip(row[grid[window]].tolist(), item[entry].tolist(),
                                      (grid[window] - at[entry]).tolist(), strict=True))
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for r, k, place in sorted(places):
            first, last = np.searchsorted(row, [r, r + 1])
            n = len(self.items[k][1])
            slack = max(1, int(n * (1 - self.threshold)))
            for a in range(place - slack, place + slack + 1):
                a0, a1 = max(a, first), min(a + n, last)
                if a1 > a0:
                    s = self.similarity(k, x[a0:a1])
                    if s >= self.threshold and s > best.get((r, k), (0.0, 0))[0]:
                        best[r, k] = (s, a0 - int(first))
        return [(r, k, s, place) for (r, k), (s, place) in sorted(best.items())]


def _indexes(benchmark: DataFrame, threshold: float, block_items: int):
    """Indexes of blocks of at most about ``block_items`` items, one after another (one of an empty table)."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
                             ).filter("text is not null")
    n = max(1, -(-items.count() // block_items))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        part = [(r["item_id"], r["text"]) for r in items.filter(block == b).orderBy("item_id", "text").collect()]
        yield _Index(part, threshold)


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, similarity, place): documents that hold a benchmark item, and where.

    One row per row of ``docs`` and item, at the item's best place (counted in
    shingles).  Items are taken in blocks of at most ``block_items``, each block
    against all documents, so the index in a task is bounded.  Items and texts
    without words match nothing; an item of fewer than five words matches only
    a text that is that sequence; repeated items are found each under their
    id; null ids stay.  Empty tables give no rows.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, similarity double, place long"
    found = None
    for index in _indexes(benchmark, threshold, block_items):
        one = rows.mapInArrow(_searcher(index), schema)
        found = one if found is None else found.unionByName(one)
    return found


def _searcher(index: _Index):
    def search(batches):
        for batch in batches:
            data, offsets = tg.text_buffer(fold_texts(batch.column(1)))
            for i, j in tg.row_slices(offsets):
                got = index.search(*_shingles(data, offsets[i: j + 1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([i + r for r, *_ in got], pa.int64())),
                     pa.array([index.items[k][0] for _, k, *_ in got], pa.int64()),
                     pa.array([s for _, _, s, _ in got], pa.float64()),
                     pa.array([p for *_, p in got], pa.int64())], ["doc_id", "item_id", "similarity", "place"])
    return search


def _marker(index: _Index):
    def mark(text):
        data, offsets = tg.text_buffer(fold_texts(text))
        leaks = np.zeros(len(text), bool)
        for i, j in tg.row_slices(offsets):
            got = index.search(*_shingles(data, offsets[i: j + 1]))
            leaks[[i + r for r, *_ in got]] = True
        return [pa.array(leaks)]
    return mark


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, block_items: int = 20_000,
                  by_id: bool = True) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; all columns stay.

    Each row is judged by its own text, with or without an id.  With ``by_id``,
    rows that repeat the id of a leaking row with another text go with it;
    without, they stay.
    """
    kept = docs
    for index in _indexes(benchmark, threshold, block_items):
        kept = with_scores(kept, {"text": F.col("text").cast("string")}, _marker(index), {"__leak__": "boolean"}
                           ).filter("not __leak__").drop("__leak__")
    if not by_id:
        return kept
    leaks = find_leaks(docs, benchmark, threshold, block_items).select(F.col("doc_id").alias("__leak__")).distinct()
    return kept.join(leaks, F.col("doc_id").cast("long") == F.col("__leak__"), "left_anti")
