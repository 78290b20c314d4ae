"""Substring dedup by level-wise doubling: word windows that repeat across documents are removed.

A window is ``length`` consecutive words (runs of bytes other than space and
tab to carriage return, unchanged) of one document.  A word goes if a window
over it also starts in a document with a smaller id.

1. *Shortest level.*  Only windows of about a quarter of ``length`` that are
   the least, by hash, of all inside some window of the full length are taken.
   That choice depends on the full window's words alone, so two equal full
   windows hold the same chosen one at the same place: their chosen one repeats
   too.  About one position in twenty is chosen, and one scan of the texts
   gives them, with the hashes of the next level's windows.
2. *Doubling.*  A hash found under one document id only ends there.  What
   repeats is extended to twice its length, to the right and to the left, and
   looked up again; a full window needs the extension that fits into it.
3. *Full length.*  Texts that still hold candidates are read once more, and
   only the windows around those are hashed (128 bits).  A window whose least
   id is smaller than its own document's marks its words.  Longer levels are
   not needed: a longer repeat consists of repeated full windows.

Copies of one text count once, under their smallest id; the others lose all
words if they hold a full window.  Every lookup is a grouped minimum with
partial sums before the shuffle and a join on the hash, which adaptive
execution splits where a passage is hot; no group is collected.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bound_batches, scratch_path
from . import textgrams as tg

_U = np.uint64
NO_ID = (1 << 63) - 1  # rows without an id come after all others

#: Words as they stand: white space separates, nothing is folded.
PLAIN = tg._table([0x20, *range(0x09, 0x0E)], lower=False)

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _key() -> list:
    """128 bits of a text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text, F.lit("key")).alias("k2")]


def _rows(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, text) of all rows, whatever other columns they have."""
    bound_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), *_key(),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def window_hashes(h: np.ndarray, k: int, base: int = _BASES[0]) -> np.ndarray:
    """Hashes of the ``k``-word windows at each word but the last ``k - 1``, from prefix sums."""
    n = len(h)
    if n < k:
        return np.empty(0, _U)
    up, down = (np.full(n + 1, x, dtype=_U) for x in (base, pow(base, -1, 1 << 64)))
    up[0] = down[0] = 1
    up, down = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    total = np.zeros(n + 1, dtype=_U)
    np.cumsum(h * up[:n], out=total[1:])
    return tg.mix((total[k:] - total[:-k]) * down[: n - k + 1] + _U(k))


def _chosen(h: np.ndarray, row: np.ndarray, length: int, short: int):
    """For each start of a full window: the start of its chosen short window; and the starts."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(row[:n] == row[length - 1:])
    g = window_hashes(h, short)
    span = length - short + 1
    at = np.empty(len(starts), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(g, span)
    for i in range(0, len(starts), 1 << 15):  # the first of the least, so equal full windows choose the same
        part = starts[i: i + (1 << 15)]
        at[i: i + (1 << 15)] = part + view[part].argmin(axis=1)
    return at, starts


def _slices(batch):
    """(rows, words' hashes, row of each word, first word of each row) in blocks of whole rows."""
    data, offsets = tg.text_buffer(batch.column("text"))
    for i, j in tg.row_slices(offsets):
        h, row, _, _ = tg.words(data, offsets[i: j + 1], PLAIN)
        first = np.searchsorted(row, np.arange(j - i))
        yield slice(i, j), h, row, first


_ANCHORS = pa.schema([("id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("pos", pa.int32()),
                      ("h", pa.int64()), ("right", pa.int64()), ("left", pa.int64())])


def _anchor_task(length: int, short: int, middle: int):
    """Chosen short windows of each text, and the hashes of their extensions (null where they leave the text).

    A text that has any also gets one row at place -1.
    """
    def run(batches):
        for batch in batches:
            ids, k1, k2 = (np.asarray(batch.column(c)) for c in ("id", "k1", "k2"))
            for rows, h, row, first in _slices(batch):
                at = np.unique(_chosen(h, row, length, short)[0])
                if not len(at):
                    continue
                g, m, last = window_hashes(h, short), window_hashes(h, middle), len(h)
                r = row[at]
                right_end, left_at = at + middle - 1, at + short - middle
                right_ok = (right_end < last) & (row[np.minimum(right_end, last - 1)] == r)
                left_ok = (left_at >= 0) & (row[np.maximum(left_at, 0)] == r)
                most = max(len(m) - 1, 0)
                doc = rows.start + r
                one = np.unique(doc)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[one]), pa.array(k1[one]), pa.array(k2[one]),
                    pa.array(np.full(len(one), -1, np.int32)), *[pa.nulls(len(one), pa.int64())] * 3],
                    schema=_ANCHORS)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[doc]), pa.array(k1[doc]), pa.array(k2[doc]),
                    pa.array((at - first[r]).astype(np.int32)), pa.array(g[at].view(np.int64)),
                    pa.array(m[np.minimum(at, most)].view(np.int64), mask=~right_ok),
                    pa.array(m[np.clip(left_at, 0, most)].view(np.int64), mask=~left_ok)], schema=_ANCHORS)
    return run


def _repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that are found under two ids or more.

    Stored, so that both sides of a join with them are plain exchanges, whose
    hot partitions Spark splits.
    """
    return _stored(rows.groupBy(*keys).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
                   .filter("lo < hi").drop("hi"), "repeated")


_WINDOWS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("id", pa.int64()), ("k1", pa.int64()),
                      ("k2", pa.int64()), ("pos", pa.int32())])


def _window_task(length: int, short: int, middle: int):
    """The full windows of each text whose chosen short window has kept the extension that fits."""
    def run(batches):
        for batch in batches:
            ids, k1, k2 = (np.asarray(batch.column(c)) for c in ("id", "k1", "k2"))
            kept = batch.column("kept")
            values, ends = np.asarray(kept.flatten()), np.asarray(kept.value_lengths()).cumsum()
            begins = ends - np.asarray(kept.value_lengths())
            for rows, h, row, first in _slices(batch):
                at, starts = _chosen(h, row, length, short)
                if not len(at):
                    continue
                sides = np.zeros((2, len(h)), bool)
                for r in range(rows.start, rows.stop):  # a kept entry is twice the place, plus 1 for the left side
                    v = values[begins[r]: ends[r]]
                    sides[v & 1, first[r - rows.start] + (v >> 1)] = True
                fits_right = at - starts + middle <= length
                good = np.where(fits_right, sides[0][at], sides[1][at])
                s = starts[good]
                if not len(s):
                    continue
                a = window_hashes(h, length)[s]
                b = window_hashes(tg.mix(h ^ _U(0x5851F42D4C957F2D)), length, _BASES[1])[s]
                doc = rows.start + row[s]
                for i in range(0, len(s), 100_000):
                    p = slice(i, i + 100_000)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(a[p].view(np.int64)), pa.array(b[p].view(np.int64)), pa.array(ids[doc[p]]),
                        pa.array(k1[doc[p]]), pa.array(k2[doc[p]]),
                        pa.array((s[p] - first[row[s[p]]]).astype(np.int32))], schema=_WINDOWS)
    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again by several branches."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated_windows(docs: DataFrame, length: int = 50) -> DataFrame:
    """(k1, k2, id, pos): windows that also start under a smaller id.

    Each text is searched once, under its smallest id.  A text that has copies
    under larger ids also gives a row with ``pos`` -1.
    """
    short, middle = -(-length // 4), -(-length // 2)
    rows = _rows(docs)
    anchors = (rows.mapInArrow(_anchor_task(length, short, middle), _spark(_ANCHORS))
               .groupBy("k1", "k2", "pos", "h", "right", "left")
               .agg(F.min("id").alias("id"), F.max("id").alias("last")))
    anchors = _stored(anchors, "anchors")
    places = anchors.filter("pos >= 0").drop("last")
    doubled = places.join(_repeated(places, "h").drop("lo"), "h", "left_semi").select(
        "id", "k1", "k2", "pos",
        F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("right").alias("m")),
                          F.struct(F.lit(1).alias("side"), F.col("left").alias("m")))).alias("x"))
    doubled = _stored(doubled.select("id", "k1", "k2", "pos", "x.side", "x.m").filter("m IS NOT NULL"), "doubled")
    kept = (doubled.join(_repeated(doubled, "side", "m").drop("lo"), ["side", "m"], "left_semi")
            .groupBy("id", "k1", "k2").agg(F.collect_list((F.col("pos") * 2 + F.col("side")).cast("int")).alias("kept")))
    windows = _stored(rows.join(kept, ["id", "k1", "k2"]).select("id", "k1", "k2", "text", "kept")
                      .mapInArrow(_window_task(length, short, middle), _spark(_WINDOWS)), "windows")
    found = windows.join(_repeated(windows, "a", "b"), ["a", "b"]).filter("lo < id").select("k1", "k2", "id", "pos")
    return found.unionByName(anchors.filter("pos < 0 AND id < last").select("k1", "k2", "id", "pos"))


def _spark(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def remove_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed) of every row of ``docs``.

    ``kept_text`` has the words that stay, joined by one space.  Null text
    counts as empty.  Rows without an id come after all others and not before
    each other; rows that share an id never remove each other's words; rows
    that repeat id and text have the same result.  An empty table gives no
    rows.  Only ``doc_id`` and ``text`` are read.
    """
    rows = _rows(docs)
    spots = (repeated_windows(docs, length).groupBy("k1", "k2")
             .agg(F.min("id").alias("lo"), F.collect_set("pos").alias("spots")))
    found = rows.join(spots, ["k1", "k2"], "left").select("id", "text", "lo", "spots")

    def run(batches):
        for batch in batches:
            ids, texts, spots = (batch.column(c) for c in ("id", "text", "spots"))
            copy = np.asarray(batch.column("id")) > np.asarray(batch.column("lo").fill_null(NO_ID))
            out, n, gone = [], [], []
            for i in range(len(ids)):
                words = texts[i].as_buffer().to_pybytes().split()  # splits at the six white-space bytes
                total = len(words)
                if copy[i]:  # only texts with a full window are listed, so all words of a copy are covered
                    words = []
                elif spots[i].is_valid:
                    at = np.asarray(spots[i].values)
                    at = at[at >= 0]
                    edges = np.zeros(total + 1, np.int64)
                    edges[at] += 1
                    edges[at + length] -= 1
                    words = list(compress(words, (np.cumsum(edges[:-1]) == 0).tolist()))
                out.append(b" ".join(words).decode("utf-8"))
                n.append(total)
                gone.append(total - len(words))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())],
                ["id", "kept_text", "n_words", "n_removed"])

    made = found.mapInArrow(run, "id long, kept_text string, n_words long, n_removed long")
    return made.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "kept_text", "n_words", "n_removed")


def digest(removed: DataFrame) -> DataFrame:
    """The columns of the registered query: counts and the digest of the words that stay."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))
