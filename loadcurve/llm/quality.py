"""Quality classifier: a factorisation machine over hashed words and structure statistics.

A text's features are its distinct words (hashed to ``2**WORD_BITS`` places,
each with value 1 / sqrt(number of distinct words)) and one bin for each
structure statistic and for the declared length (metadata), with value 1.  The
score is the logistic of

    w0 + sum w_i x_i + 1/2 sum_f [ (sum v_if x_i)^2 - sum (v_if x_i)^2 ],

the sum-of-squares form of all pairwise interactions, linear in the features.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textgrams as tg
from .labelled import id_remainder, labelled_sample, with_scores

WORD_BITS = 16
RANK = 8
BINS = 16
STATISTICS = ("bytes", "words", "word_length", "longest_word", "upper", "digits", "symbols", "line_ends",
              "distinct", "repeated", "bare_symbols", "symbol_ends", "n_chars", "n_chars_gap")
WIDTH = (1 << WORD_BITS) + BINS * len(STATISTICS)
_U = np.uint64

_KIND = np.zeros(256, np.uint8)   # 1 upper case, 2 lower case or non-ASCII, 3 digit, 4 symbol, 5 line end, 0 space
_KIND[[i for i in range(33, 127)]] = 4
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:], _KIND[10] = 1, 2, 3, 2, 5


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray):
    """(places, values, row offsets) of the features of the rows between ``offsets``."""
    n = len(offsets) - 1
    h, row, start, end = tg.words(data, offsets)
    words = np.bincount(row, minlength=n)
    place, row_at = tg.distinct_sorted(h & _U((1 << WORD_BITS) - 1), row, n)
    distinct = np.diff(row_at)
    size = np.diff(offsets)
    kinds = _KIND[data[offsets[0]: offsets[-1]]]
    at = offsets - offsets[0]
    count = {k: tg.segment_sums((kinds == k).astype(np.int64), at) for k in (1, 2, 3, 4, 5)}
    length = end - start
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, length)
    repeated = np.bincount(row[1:][(h[1:] == h[:-1]) & (row[1:] == row[:-1])], minlength=n)
    last = _KIND[data[end - 1]] if len(end) else np.empty(0, np.uint8)
    odd = (last == 4) & ~np.isin(data[end - 1], np.frombuffer(b".,;:?)\"'", np.uint8)) if len(end) else last
    bare = np.bincount(row[(length == 1) & odd], minlength=n) if len(end) else np.zeros(n)
    symbol_end = np.bincount(row[odd], minlength=n) if len(end) else np.zeros(n)
    points = tg.segment_sums(((data[offsets[0]: offsets[-1]] & 0xC0) != 0x80).astype(np.int64), at)
    share = lambda a, b: np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)) * (BINS - 1)
    log = lambda a: np.log2(np.maximum(a, 0) + 1.0)
    known = n_chars >= 0
    stats = [log(size), log(words), 2 * log(length_mean(length, row, words)), 2 * log(longest),
             share(count[1], count[1] + count[2]), share(count[3], size), share(count[4], size),
             share(count[5], words), share(distinct, words), share(repeated, words), share(bare, words),
             share(symbol_end, words), np.where(known, 1 + log(n_chars), 0),
             np.where(known, 1 + log(np.abs(n_chars - points)), 0)]
    bins = np.clip(np.stack(stats, axis=1).astype(np.int64), 0, BINS - 1)
    bins += (1 << WORD_BITS) + BINS * np.arange(len(stats))
    k = len(stats)
    out_at = row_at + k * np.arange(n + 1)
    places, values = np.empty(out_at[-1], np.int32), np.ones(out_at[-1], np.float32)
    slot = np.arange(len(place)) + k * (np.repeat(np.arange(n), distinct) + 1)
    places[slot] = place.astype(np.int32)
    values[slot] = np.repeat(1 / np.sqrt(np.maximum(distinct, 1)), distinct)
    fixed = out_at[:-1, None] + np.arange(k)
    places[fixed] = bins
    return places, values, out_at


def length_mean(length, row, words):
    return np.bincount(row, weights=length, minlength=len(words)) / np.maximum(words, 1)


class FactorisationMachine:
    """``w0``, weights ``w`` and factors ``v``; ``score`` takes features and gives probabilities."""

    def __init__(self, w0, w, v):
        self.w0, self.w, self.v = w0, w, v

    def score(self, places, values, at):
        if len(at) < 2:
            return np.empty(0)
        x = values[:, None] * self.v[places]
        sums = np.add.reduceat(x, at[:-1], axis=0, dtype=np.float64)
        squares = np.add.reduceat((x * x).sum(axis=1, dtype=np.float64), at[:-1])
        linear = np.add.reduceat(values * self.w[places], at[:-1], dtype=np.float64)
        y = self.w0 + linear + 0.5 * ((sums ** 2).sum(axis=1) - squares)
        return 1 / (1 + np.exp(-np.clip(y, -40, 40)))


def _fit(rows, epochs: int = 6, rate: float = 0.15, most: int = 256, decay: float = 1e-5) -> FactorisationMachine:
    """Mini-batch Adagrad on the logistic loss; the same rows always give the same model.

    Few rows are taken in small batches, so that they make enough steps.
    """
    batch = max(8, min(most, len(rows) // 40))
    rng = np.random.default_rng(7)
    w, v = np.zeros(WIDTH, np.float32), rng.normal(0, 0.05, (WIDTH, RANK)).astype(np.float32)
    seen = np.full((WIDTH, RANK + 1), 1e-6, np.float32)
    y = np.array([r[0] for r in rows], dtype=np.float64)
    mean = (y.sum() + 1) / (len(y) + 2)
    w0, seen0 = float(np.log(mean / (1 - mean))), 1e-6
    if 0 < y.sum() < len(y):
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(rows), batch):
                chosen = order[a: a + batch]
                places = np.concatenate([rows[i][1] for i in chosen])
                values = np.concatenate([rows[i][2] for i in chosen])
                n = np.array([len(rows[i][1]) for i in chosen])
                at = np.r_[0, np.cumsum(n)]
                error = (FactorisationMachine(w0, w, v).score(places, values, at) - y[chosen]).astype(np.float32)
                x = values[:, None] * v[places]
                sums = np.add.reduceat(x, at[:-1], axis=0)
                g = np.empty((len(places), RANK + 1), np.float32)
                pull = np.repeat(error, n) * values
                g[:, 0] = pull
                g[:, 1:] = pull[:, None] * (np.repeat(sums, n, axis=0) - x)
                by = np.argsort(places, kind="stable")
                own = places[by]
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                own, g = own[first], np.add.reduceat(g[by], first, axis=0) / len(chosen)
                g[:, 0] += decay * w[own]
                g[:, 1:] += decay * v[own]
                seen[own] += g * g
                step = rate * g / np.sqrt(seen[own])
                w[own] -= step[:, 0]
                v[own] -= step[:, 1:]
                g0 = float(error.mean())
                seen0 += g0 * g0
                w0 -= rate * g0 / seen0 ** 0.5
    return FactorisationMachine(w0, w, v)


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> FactorisationMachine:
    """A model of ``labels.quality`` from at most ``sample`` labelled ids whose crc32 modulo 5 is not 0.

    Only whole texts and ``n_chars`` are looked at, never lang, source or id.
    Without usable labels of both kinds every score is near the share of 1.
    """
    rows = labelled_sample(docs, labels, "quality", id_remainder(5) != 0, sample)

    def extract(batches):
        for batch in batches:
            n_chars = _lengths(batch.column(1))
            data, offsets = tg.text_buffer(batch.column(0))
            for i, j in tg.row_slices(offsets):
                places, values, at = features(data, offsets[i: j + 1], n_chars[i:j])
                cut = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())  # noqa: B023, B905, E731
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(i, j - i), cut(places), cut(values)], ["label", "places", "values"])

    got = rows.select("text", "n_chars", "label").mapInArrow(
        extract, "label int, places binary, values binary").toArrow()
    got = [(y, np.frombuffer(p, np.int32), np.frombuffer(x, np.float32))
           for y, p, x in zip(*(c.to_pylist() for c in got.columns), strict=True)]
    got.sort(key=lambda r: (r[1].tobytes(), r[2].tobytes(), r[0]))  # tasks end in any order
    return _fit(got)


def _lengths(column) -> np.ndarray:
    return np.asarray(column.fill_null(-1))


def score_quality(docs: DataFrame, model: FactorisationMachine, out: str = "score") -> DataFrame:
    """``docs`` with the model's probability that the text is good, from 0 to 1.

    Null and empty texts are scored by their structure bins.  A missing or null
    ``n_chars`` falls into a bin of its own.  An older column ``out`` gives way.
    """
    def score(text, n_chars):
        data, offsets = tg.text_buffer(text)
        n_chars = _lengths(n_chars)
        made = [model.score(*features(data, offsets[i: j + 1], n_chars[i:j]))
                for i, j in tg.row_slices(offsets)]
        return [pa.array(np.concatenate(made) if made else np.empty(0), pa.float64())]

    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return with_scores(docs, {"text": F.col("text").cast("string"), "n_chars": n_chars}, score, {out: "double"})
