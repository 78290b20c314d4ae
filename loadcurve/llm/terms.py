"""Exact terms of whole texts and their counts, as Arrow columns without a Python object per word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from . import textgrams as tg

#: Terms are runs of ASCII letters and any non-ASCII character; A-Z become a-z.
ALPHABETIC = tg._table([b for b in range(128) if not chr(b).isalpha()], lower=True)
#: Terms are runs of ASCII letters, digits and any non-ASCII character; A-Z become a-z.
ALPHANUMERIC = tg.LETTERS


def term_counts(column: pa.Array, kind):
    """Blocks of (row, code, count, dictionary): how often each row has each term.

    Blocks hold whole rows, about 1 MB of text; codes count within a block.
    Rows without terms do not appear.  A null text has none.
    """
    fold, sep = kind
    data, offsets = tg.text_buffer(column)
    for i, j in tg.row_slices(offsets):
        lo, hi = int(offsets[i]), int(offsets[j])
        buf = fold[data[lo:hi]]
        if not len(buf):
            continue
        inside = ~sep[buf]
        edges = offsets[i + 1: j] - lo
        edges = edges[(edges > 0) & (edges < len(buf))]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[edges] |= inside[edges]
        ends[:-1] &= ~inside[1:]
        ends[edges - 1] |= inside[edges - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not len(start):
            continue
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start, out=at[1:])
        words = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(buf[inside]))
        coded = words.dictionary_encode()
        size = len(coded.dictionary)
        row = np.searchsorted(offsets[i: j + 1], start + lo, side="right") - 1
        key, count = np.unique(row * size + np.asarray(coded.indices), return_counts=True)
        yield i + key // size, key % size, count, coded.dictionary
