"""Words and word shingles of whole texts as 64-bit hashes, vectorised in numpy.

The functions work on the bytes of an Arrow string column, so no Python object
is made per word.  A word's hash is a polynomial over a random byte table
modulo 2**64, taken from prefix sums, then mixed; it does not depend on where
the word stands.  Work runs in blocks of about ``BLOCK`` bytes, so memory does
not follow the length of a text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_Q = _U(0xD1342543DE82EF95)
_BYTE = mix(np.arange(256, dtype=_U) * _U(0x632BE59BD9B4E019) + _U(0x1234567))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, BLOCK + 4096)
        for name, base in (("up", _P), ("down", _P_INV)):
            p = np.full(size, base, dtype=_U)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


def _table(separators, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    fold = np.arange(256, dtype=np.uint8)
    if lower:
        fold[65:91] += 32
    sep = np.zeros(256, dtype=bool)
    sep[list(separators)] = True
    return fold, sep


#: Words are what stands between white space (space, tab to carriage return).
SPACED = _table([0x20, *range(0x09, 0x0E)], lower=True)
#: Words are runs of ASCII letters, digits and any non-ASCII character.
LETTERS = _table([b for b in range(128) if not chr(b).isalnum()], lower=True)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def row_slices(offsets: np.ndarray, most: int = BLOCK):
    """Ranges of whole rows of about ``most`` bytes (at least one row each)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offsets: np.ndarray, kind=SPACED):
    """(hash, row, start, end) of the words of the rows between ``offsets``.

    ``start`` and ``end`` are byte positions in ``data``.  Rows are numbered
    from 0.  A word never runs over the end of a row.
    """
    fold, sep = kind
    lo, end = int(offsets[0]), int(offsets[-1])
    parts = []
    while lo < end:
        hi = min(lo + BLOCK, end)
        if hi < end:
            seps = np.flatnonzero(sep[data[lo:hi]])
            rows_in = offsets[(offsets > lo) & (offsets <= hi)]
            cut = max(lo + int(seps[-1]) + 1 if len(seps) else lo, int(rows_in[-1]) if len(rows_in) else lo)
            while cut == lo and hi < end:  # one word longer than a block: go on to where it ends
                nxt = min(hi + BLOCK, end)
                seps = np.flatnonzero(sep[data[hi:nxt]])
                rows_in = offsets[(offsets > hi) & (offsets <= nxt)]
                ends = [hi + int(seps[0]) + 1] if len(seps) else []
                ends += [int(rows_in[0])] if len(rows_in) else []
                cut, hi = (min(ends) if ends else lo), nxt
            hi = cut if cut > lo else end
        parts.append(_block_words(fold[data[lo:hi]], sep, lo, offsets))
        lo = hi
    if not parts:
        none = np.empty(0, np.int64)
        return np.empty(0, _U), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _block_words(buf, sep, lo, offsets):
    n = len(buf)
    inside = ~sep[buf]
    edges = offsets[(offsets > lo) & (offsets < lo + n)] - lo
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[edges] |= inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] |= inside[edges - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(n)
    total = np.empty(n + 1, dtype=_U)
    total[0] = 0
    np.cumsum(_BYTE[buf] * up[:n], out=total[1:])
    h = mix((total[e] - total[s]) * down[s] + (e - s).astype(_U) * _Q)
    return h, np.searchsorted(offsets, s + lo, side="right") - 1, s + lo, e + lo


def shingles(h: np.ndarray, row: np.ndarray, n_rows: int, k: int):
    """(hash, row) of the ``k``-word shingles in text order.

    A row of fewer words (but not none) has its whole sequence as its one
    shingle; a row without words has none.
    """
    n = len(h)
    out, rows = np.empty(0, _U), np.empty(0, np.int64)
    if n >= k:
        s = h[: n - k + 1]
        for j in range(1, k):
            s = s * _Q + h[j: n - k + 1 + j]
        whole = row[: n - k + 1] == row[k - 1:]
        out, rows = mix(s[whole] + _U(k)), row[: n - k + 1][whole]
    count = np.bincount(row, minlength=n_rows) if n else np.zeros(n_rows, np.int64)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.cumsum(count) - count
        own = np.empty(len(short), _U)
        for i, r in enumerate(short):
            s = h[first[r]: first[r] + 1]
            for j in range(1, count[r]):
                s = s * _Q + h[first[r] + j]
            own[i] = mix(s + _U(count[r]))[0]
        out, rows = np.concatenate([out, own]), np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, rows


def distinct_sorted(h: np.ndarray, row: np.ndarray, n_rows: int):
    """Sorted distinct hashes of each row, and the rows' offsets in them."""
    h = h.copy()
    ends = np.cumsum(np.bincount(row, minlength=n_rows)) if len(h) else np.zeros(n_rows, np.int64)
    a = 0
    for b in ends:
        h[a:b].sort()
        a = b
    if not len(h):
        return h, np.zeros(n_rows + 1, np.int64)
    keep = np.empty(len(h), bool)
    keep[0] = True
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    offsets = np.zeros(n_rows + 1, np.int64)
    np.cumsum(np.bincount(row[keep], minlength=n_rows), out=offsets[1:])
    return h[keep], offsets


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between ``offsets`` (0 for an empty segment); wraps modulo 2**64."""
    total = np.zeros(len(values) + 1, dtype=values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
