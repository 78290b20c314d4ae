"""Document fingerprints: MinHash over word shingles, band join and verified Jaccard.

A fingerprint holds ``PERMUTATIONS`` minima.  Permutation ``k`` is the universal
hash ``(a_k * x + b_k) mod 2**64`` of a shingle's 64-bit hash, of which the top
16 bits are kept (b-bit minwise hashing: equal minima always agree, others agree
once in 65,536).  The share of equal places estimates the Jaccard similarity of
the shingle sets.  Shingles are five words, A-Z lowered; a shorter text is one
shingle; texts without words all have the fingerprint of the empty set.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import ngram_join
from . import textgrams as tg
from .components import connected_components

PERMUTATIONS = 128
NGRAM = 5
_U = np.uint64
_A = tg.mix(np.arange(1, PERMUTATIONS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_B = tg.mix(np.arange(1, PERMUTATIONS + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F))


def signatures(data: np.ndarray, offsets: np.ndarray, ngram: int = NGRAM) -> np.ndarray:
    """(rows, PERMUTATIONS) minima of the rows between ``offsets``, as 16-bit numbers."""
    n_rows = len(offsets) - 1
    out = np.full((n_rows, PERMUTATIONS), 0xFFFF, dtype=np.uint16)
    for i, j in tg.row_slices(offsets, 1 << 19):
        h, row, _, _ = tg.words(data, offsets[i: j + 1])
        x, row = tg.shingles(h, row, j - i, ngram)
        if not len(x):
            continue
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        at = row[first] + i
        value = np.empty_like(x)
        for k in range(PERMUTATIONS):
            np.multiply(x, _A[k], out=value)
            np.add(value, _B[k], out=value)
            out[at, k] = np.minimum.reduceat(value, first) >> _U(48)
    return out


def fingerprints(docs: DataFrame, ngram: int = NGRAM) -> DataFrame:
    """(doc_id, fingerprint): 128 minima as hex text, one row per row of ``docs``.

    Null and blank texts have the empty set's fingerprint; nulls in ``doc_id``
    stay; other columns are not looked at.
    """
    def sign(batches):
        for batch in batches:
            marks = signatures(*tg.text_buffer(batch.column(1)), ngram)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m.byteswap().tobytes().hex() for m in marks], pa.string())],
                ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        sign, "doc_id long, fingerprint string")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, ngram: int = NGRAM, bands: int = 32) -> DataFrame:
    """(doc_id, class_id): documents joined by verified links of Jaccard >= ``threshold``.

    Signature bands are joined in Spark.  Equal fingerprints count once (their
    smallest id stands for them).  In a band bucket each member is paired with
    the bucket's smallest id, not with all others, so a hot bucket gives as
    many pairs as members; each pair's Jaccard is then computed from the whole
    texts.  In buckets that still hold more than one component, members of
    different components are compared in salted blocks.  ``class_id`` is the smallest id reached; rows without an id are
    left out; texts without words stand alone.
    """
    width = PERMUTATIONS // bands * 4
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).filter("doc_id is not null")
    marks = materialize(fingerprints(base, ngram))
    heads = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("a")).filter(
        F.col("fingerprint") != "f" * PERMUTATIONS * 4)
    keys = heads.select("a", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.xxhash64(k, F.substring("fingerprint", k * width + 1, F.lit(width))))).alias("key"))
    hubs = keys.groupBy("key").agg(F.min("a").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    pairs = keys.join(hubs, "key").filter("a <> hub").select("hub", F.col("a").alias("other")).distinct()
    same = marks.join(heads, "fingerprint").filter("doc_id <> a").select(
        F.col("a").alias("hub"), F.col("doc_id").alias("other"))
    pairs = materialize(pairs.unionByName(same).distinct())

    def check(batches):
        for batch in batches:
            left, right = tg.text_buffer(batch.column(2)), tg.text_buffer(batch.column(3))
            keep = [_jaccard(left, right, r, ngram) >= threshold for r in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).columns[:2], ["a", "b"])

    def verified(pairs):
        rows = (pairs.join(base.select(F.col("doc_id").alias("other"), F.col("text").alias("tb")), "other")
                .join(base.select(F.col("doc_id").alias("hub"), F.col("text").alias("ta")), "hub")
                .select("hub", "other", "ta", "tb"))
        return materialize(rows.mapInArrow(check, "a long, b long"))

    links = verified(pairs)
    comps = connected_components(links)
    mixed = materialize(_mixed(keys.join(hubs.filter("n > 2"), "key"), comps))
    if mixed.head(1):
        share = Fraction(str(threshold))
        sets = materialize(ngram_join.sets_with_bits(base.join(mixed.select(F.col("id").alias("doc_id")).distinct(),
                                                               "doc_id", "left_semi"), ngram))
        sized = mixed.join(sets.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("size")), "id").select(
            "tile", "id", "size", "comp", "g")
        more = verified(materialize(ngram_join.cross_pairs(sized, sets, share.numerator, share.denominator).select(
            F.col("a").alias("hub"), F.col("b").alias("other"))))
        if more.head(1):
            comps = connected_components(links.unionByName(more))
    return marks.join(comps, marks["doc_id"] == comps["node"], "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id"))


def _mixed(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(tile, id, comp, g) of the members of buckets with more than one component; ``g`` counts a bucket's members."""
    members = members.join(comps, members["a"] == comps["node"], "left").select(
        F.col("key").alias("tile"), F.col("a").alias("id"), F.coalesce("component", "a").alias("comp"), "n")
    mixed = members.groupBy("tile").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y")
    return members.join(mixed.select("tile"), "tile").select("tile", "id", "comp", F.col("n").alias("g"))


def _jaccard(left, right, r, ngram):
    sets = []
    for data, offsets in (left, right):
        h, row, _, _ = tg.words(data, offsets[r: r + 2])
        sets.append(np.unique(tg.shingles(h, row, 1, ngram)[0]))
    both = len(np.intersect1d(*sets, assume_unique=True))
    union = len(sets[0]) + len(sets[1]) - both
    return both / union if union else 0.0


def _in_order(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, tail, key, text): ranges of ascending ids, each with its successor's first row as a tail.

    Range bounds are the smallest ids of quantile ranges, one per bucket; they
    are the only thing that passes the driver.
    """
    low = -(1 << 63)
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("key"),
                       F.col("text").cast("string").alias("text"))
    at = base.agg(F.min("key"), F.percentile_approx("key", [k / buckets for k in range(1, buckets)] or [0.5],
                                                    max(10_000, 20 * buckets))).first()
    cuts = np.array(sorted({at[0], *(at[1] or [])} - {None}), dtype=np.int64)

    def least(batches):
        for batch in batches:
            key = np.asarray(batch.column(0))
            own = np.searchsorted(cuts, key, side="right") - 1
            order = np.lexsort((key, own))
            first = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0]) if len(key) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[order][first], pa.int32()), pa.array(key[order][first])], ["range", "key"])

    # quantiles go through doubles; the ids that really come first are looked up
    firsts = base.select("key").mapInArrow(least, "range int, key long").groupBy("range").agg(F.min("key").alias("key"))
    bounds = np.array(sorted(r["key"] for r in firsts.collect()), dtype=np.int64)
    wrap = len(bounds)

    def deal(batches):
        for batch in batches:
            key = np.asarray(batch.column(0))
            own = np.searchsorted(bounds, key, side="right") - 1
            first = np.flatnonzero(bounds[own] == key) if wrap else np.empty(0, np.int64)
            take = np.r_[np.arange(len(key)), first]
            bucket = np.r_[own, (own[first] - 1) % max(wrap, 1)]
            tail = np.r_[np.zeros(len(key), np.int32), np.ones(len(first), np.int32)]
            moved = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array(tail, pa.int32()), *moved.columns],
                ["bucket", "tail", "key", "text"])

    dealt = base.mapInArrow(deal, "bucket int, tail int, key long, text string")
    return dealt.repartition(max(wrap, 1), "bucket").sortWithinPartitions("bucket", "tail", "key", "text")


def edited_fingerprints(docs: DataFrame, buckets: int | None = None, ngram: int = NGRAM) -> DataFrame:
    """Fingerprints of each text, of its edited text and their likenesses.

    The edited text has its last quarter of code points replaced by the start
    of the next document in ascending ``doc_id`` (after the last: the first).
    A null text counts as empty; a null id sorts first and stays null; rows
    that share an id follow each other by text.  A single row is its own next.
    """
    buckets = buckets or 4 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def walk(batches):
        held = None
        for batch in batches:
            for i, j in tg.row_slices(tg.text_buffer(batch.column(3))[1], 1 << 22):
                part = batch.slice(i, j - i)
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                yield from _edit(part, ngram)
                held = part.slice(part.num_rows - 1)
        # a bucket ends with a tail row, so no row of its own is held back

    return _in_order(docs, buckets).mapInArrow(
        walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")


def _edit(part: pa.RecordBatch, ngram: int):
    """Results of the rows of ``part`` whose next row is in it too."""
    tail, key = np.asarray(part.column(1)), np.asarray(part.column(2))
    texts = [t or "" for t in part.column(3).to_pylist()]
    rows = [r for r in range(len(texts) - 1) if not tail[r]]
    if not rows:
        return
    marks = signatures(*tg.text_buffer(part.column(3)), ngram)
    edited = []
    for r in rows:
        cut = len(texts[r]) // 4
        edited.append(texts[r][: len(texts[r]) - cut] + texts[r + 1][:cut])
    changed = signatures(*tg.text_buffer(pa.array(edited, pa.large_string())), ngram)
    own, after = marks[rows], marks[[r + 1 for r in rows]]
    low = -(1 << 63)
    yield pa.RecordBatch.from_arrays([
        pa.array([None if key[r] == low else int(key[r]) for r in rows], pa.int64()),
        pa.array([len(texts[r]) for r in rows], pa.int64()),
        pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
        pa.array([m.byteswap().tobytes().hex() for m in own], pa.string()),
        pa.array([m.byteswap().tobytes().hex() for m in changed], pa.string()),
        pa.array((own == changed).mean(axis=1)), pa.array((own == after).mean(axis=1))],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
