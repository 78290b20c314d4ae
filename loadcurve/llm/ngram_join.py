"""N-gram Jaccard join: documents whose shingle sets overlap by a given share.

Two documents link when ``den * |A & B| >= num * |A | B|``.  The search is
exact for any texts:

1. *Size-banded tiles.*  Sizes are cut into bands so that a linked pair lies in
   one band or in two neighbouring ones.  For each pair of bands the largest
   symmetric difference ``d`` of a linked pair is known, so the hash space is
   cut into more than ``d`` parts: a linked pair has the very same shingles in
   at least one part.  A tile is (band, part, hash of the shingles in it).
   A text's copies count once: their rows carry one set id.
2. Tile entries travel as packed arrays, one row per bucket and block of
   texts.  A bucket's task sorts them and keeps tiles of two or more texts;
   tiles with the same members are kept once.
3. In each tile every member is checked against the tile's smallest id
   (as many pairs as members), and links give components.  Only tiles
   that still hold more than one component are gone through pair by pair, in
   blocks, between members of different components.  A text and its near
   copies meet in a tile for each part that they left alone, so tiles of one
   smallest id are first put together where that makes fewer pairs; groups
   that still have many members are cut anew by other cuts of the hash space,
   where that makes fewer pairs in turn.
4. Each check counts the bits of hashed bitmap signatures first: every bit that
   one side alone has stands for a shingle that the other lacks, which bounds
   the overlap from above.  What passes is intersected as sorted arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, materialize
from . import textgrams as tg
from .components import connected_components

_U = np.uint64
BLOCK_MEMBERS = 2048  # members of a tile that one task compares with as many others
SMALL_TILE = 64       # members of a tile up to which its pairs are looked at together with other tiles
HELD_ROWS = 20_000    # members that a task holds to look at them together
HELD_BYTES = 32 << 20  # and their weight at most
TILE_BITS = 16_384    # longest signature that travels with a member of a tile
HOT_BLOCKS = 4        # blocks of a group beyond which it is cut anew
LEVELS = 4            # times at most that a group is cut anew before it is gone through in blocks
BROADCAST_IDS = 1_000_000
BUCKET_SHINGLES = 500_000  # shingles of all texts for each bucket of tile entries
BUCKET_ENTRIES = 160  # tile entries that a packed row should have, as buckets grow with the input
LEAST_ENTRIES, MOST_ENTRIES = 250_000, 1_000_000  # tile entries that a task holds to pack them


def _bands(num: int, den: int, most: int = 1 << 40):
    """Lower ends of the size bands; for each band the parts that its tiles have, and how many of these agree.

    A linked pair differs in ``d`` shingles at most, so of ``d + r`` parts it
    has ``r`` in common.  ``r`` is chosen so that a text seldom has that many
    empty parts: one with fewer has a part in common that is not empty.
    """
    lows = [1]
    while lows[-1] < most:
        lows.append(lows[-1] * den // num + 1)
    parts, agree = [], []
    for low, after in zip(lows[:-1], lows[1:], strict=True):
        a = after - 1
        d = (a + a * den // num) * (den - num) // (den + num)
        r, enough = 0, 1
        while r < enough <= max(1, d // 2):  # few steps: what is enough for ``r`` parts grows slowly
            r = enough
            empty = (d + r) * math.exp(-low / (d + r))  # expected, in a text of the band's least size
            enough = math.ceil(empty + 2 * math.sqrt(empty) + 0.5)
        r = 1 if enough > r else r  # more parts than that would be too small to tell texts apart
        parts.append(d + r)
        agree.append(r)
    return np.array(lows[:-1], dtype=np.int64), np.array(parts, dtype=np.int64), np.array(agree, dtype=np.int64)


class Sets:
    """Sorted distinct shingles of the rows of one block, with sizes and set ids."""

    def __init__(self, data, offsets, ngram):
        h, row, _, _ = tg.words(data, offsets)
        self.n_rows = len(offsets) - 1
        self.values, self.offsets = tg.distinct_sorted(*tg.shingles(h, row, self.n_rows, ngram), self.n_rows)
        self.sizes = np.diff(self.offsets)
        both = tg.segment_sums(tg.mix(self.values + _U(17)), self.offsets)
        self.ids = tg.mix(both + self.sizes.astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)

    def row(self, i):
        return self.values[self.offsets[i]: self.offsets[i + 1]]


def _blocks(batch, ngram, text="text"):
    data, offsets = tg.text_buffer(batch.column(batch.schema.get_field_index(text)))
    for i, j in tg.row_slices(offsets):
        yield i, j, Sets(data, offsets[i: j + 1], ngram)


def _sets(docs: DataFrame, ngram: int, bits: bool) -> DataFrame:
    bound_batches(docs.sparkSession)
    names = ["doc_id", "n_shingles", "set_id"] + ["bits"] * bits

    def sets(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, s in _blocks(batch, ngram):
                made = [ids.slice(i, j - i), pa.array(s.sizes), pa.array(s.ids)]
                if bits:
                    made.append(pa.array([_bitmap(s.row(r)).tobytes() for r in range(j - i)], pa.binary()))
                yield pa.RecordBatch.from_arrays(made, names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(
        sets, "doc_id long, n_shingles long, set_id long" + ", bits binary" * bits)


def shingle_sets(docs: DataFrame, ngram: int = 3) -> DataFrame:
    """(doc_id, n_shingles, set_id) of every row; equal sets have equal set ids.

    Words are what stands between ASCII white space, A-Z lowered.  A text with
    fewer words than ``ngram`` has its sequence as its one shingle; null, empty
    and blank texts have size 0 and a set id that links with nothing.
    """
    return _sets(docs, ngram, False)


def _band_tags(s: Sets, rows: np.ndarray, num, den, lows):
    """Each row with the band of its size and, where a partner can be in it, with the band below."""
    band = np.searchsorted(lows, s.sizes[rows], side="right") - 1
    lower = (band > 0) & (s.sizes[rows] * num <= (lows[band] - 1) * den)
    return np.concatenate([rows, rows[lower]]), np.concatenate([band, band[lower] - 1])


def _tile_keys(s: Sets, rows: np.ndarray, tags: np.ndarray, n_parts, n_agree, level: int = 0):
    """(row, key) of the tiles of ``rows`` under their band tags; each level cuts the hash space anew."""
    m = n_parts[tags]
    sizes = s.sizes[rows]
    at = np.repeat(s.offsets[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    x = s.values[at]
    owner = np.repeat(np.arange(len(rows)), sizes)
    if level:
        x = tg.mix(x + _U(level * 0xD6E8FEB86659FD93 % (1 << 64)))
        order = np.lexsort((x, owner))
        x = x[order]
    part = ((x >> _U(32)) * m[owner].astype(_U)) >> _U(32)
    slot = (np.cumsum(m) - m)[owner] + part.astype(np.int64)
    new = np.empty(len(x), bool)
    new[:1] = True
    new[1:] = slot[1:] != slot[:-1]
    first = np.flatnonzero(new)
    sums = np.add.reduceat(tg.mix(x + _U(99)), first) if len(first) else np.empty(0, _U)
    sums, owner, part = tg.mix(sums), owner[first], part[first]
    # A text with as many empty parts as could hide every agreeing part shows its empty parts too.
    full = np.bincount(owner, minlength=len(rows))
    unsure = m - full >= n_agree[tags]
    if unsure.any():
        has = np.zeros(int(m.sum()), bool)
        has[slot[first]] = True
        has |= np.repeat(~unsure, m)
        gap = np.flatnonzero(~has)
        gap_owner = np.searchsorted(np.cumsum(m), gap, side="right")
        owner = np.concatenate([owner, gap_owner])
        part = np.concatenate([part, (gap - (np.cumsum(m) - m)[gap_owner]).astype(_U)])
        sums = np.concatenate([sums, np.zeros(len(gap), _U)])
    key = tg.mix(sums + part * _U(0xA24BAED4963EE407) + tags[owner].astype(_U) * _U(0x9FB21C651E98DF25))
    return rows[owner], key


def _packed_tiles(docs: DataFrame, ngram, num, den, buckets) -> DataFrame:
    """(bucket, set ids, doc ids, sizes, entries of each, low halves of their keys) as packed arrays.

    A task packs the entries of several blocks of texts together: buckets grow
    with the input, so a row for each bucket and block would make their number
    grow with its square.
    """
    lows, n_parts, n_agree = _bands(num, den)
    most = min(max(LEAST_ENTRIES, BUCKET_ENTRIES * buckets), MOST_ENTRIES)

    def tiles(batches):
        held, entries = [], 0
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for i, j, s in _blocks(batch, ngram):
                order = np.argsort(ids[i:j], kind="stable")
                _, first = np.unique(s.ids[order], return_index=True)
                rows = np.sort(order[first])
                rows = rows[s.sizes[rows] > 0]
                if not len(rows):
                    continue
                row, key = _tile_keys(s, *_band_tags(s, rows, num, den, lows), n_parts, n_agree)
                held.append((s.ids, ids[i:j].astype(np.int64), s.sizes.astype(np.uint32), row.astype(np.uint32), key))
                entries += len(key)
                if entries >= most:
                    yield _packed(held, buckets)
                    held, entries = [], 0
        if held:
            yield _packed(held, buckets)

    return docs.mapInArrow(tiles, "bucket int, sets binary, ids binary, sizes binary, counts binary, keys binary")


def _packed(held, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of the blocks' tile entries."""
    before = np.cumsum([0] + [len(x[0]) for x in held])
    sets, ids, sizes = (np.concatenate([x[k] for x in held]) for k in range(3))
    row = np.concatenate([x[3] + np.uint32(n) for x, n in zip(held, before, strict=False)])
    key = np.concatenate([x[4] for x in held])
    at = (((key >> _U(32)) * _U(buckets)) & _U(0xFFFFFFFF00000000)) | row  # the bucket above, the row below
    order = np.argsort(at, kind="stable")
    key, at = key.astype(np.uint32)[order], at[order]
    row, bucket = at.astype(np.uint32), (at >> _U(32)).astype(np.int32)
    new = np.r_[True, bucket[1:] != bucket[:-1]]
    first = np.flatnonzero(new)
    own = np.flatnonzero(new | np.r_[True, row[1:] != row[:-1]])  # where a text's entries in a bucket begin
    counts = np.diff(np.r_[own, len(row)]).astype(np.uint32)
    texts = np.r_[np.searchsorted(own, first), len(own)]

    def column(values, at):
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(
            (at * values.itemsize).astype(np.int32)), pa.py_buffer(values)])

    row = row[own]
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[first]), *(column(x, texts) for x in (sets[row], ids[row], sizes[row], counts)),
         column(key, np.r_[first, len(key)])], ["bucket", "sets", "ids", "sizes", "counts", "keys"])


def _unpacked(column: pa.Array, kind) -> tuple[np.ndarray, np.ndarray]:
    """The values of a packed column, and where each row's begin."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    values = np.frombuffer(column.buffers()[2], np.uint8)[at[0]: at[-1]].view(kind)
    return values, (at - at[0]) // values.itemsize


def _tiles(packed: DataFrame, partitions: int) -> DataFrame:
    """(tile, ids, sizes): tiles with two or more different texts, each set of members once.

    A partition's rows come sorted by bucket, so a task holds one bucket at a time.
    """
    def join(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = np.asarray(batch.column(0))
            (sets, texts), (ids, _), (sizes, _), (n, _), (keys, entries) = (
                _unpacked(c, kind) for c, kind in zip(
                    batch.columns[1:], (np.int64, np.int64, np.uint32, np.uint32, np.uint32), strict=True))
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            for a, b in zip(first, np.r_[first[1:], len(bucket)], strict=True):
                if bucket[a] != last and held:
                    yield from _members(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
                last = bucket[a]
                own = slice(texts[a], texts[b])
                held.append((keys[entries[a]: entries[b]].copy(),
                             *(np.repeat(x[own], n[own]) for x in (sets, ids, sizes))))
        if held:
            yield from _members(*(np.concatenate(x) for x in zip(*held, strict=True)))

    whole = packed.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(
        join, "tile long, ids array<long>, sizes array<long>")
    return whole.dropDuplicates(["tile"])


def _members(key, sets, ids, sizes):
    order = np.lexsort((ids, sets, key))
    key, sets, ids, sizes = key[order], sets[order], ids[order], sizes[order]
    first = np.r_[True, (key[1:] != key[:-1]) | (sets[1:] != sets[:-1])]  # the smallest id of each text
    key, ids, sizes = key[first], ids[first], sizes[first]
    order = np.lexsort((ids, key))
    key, ids, sizes = key[order], ids[order], sizes[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    n = np.diff(np.r_[start, len(key)])
    many = n > 1
    start, n = start[many], n[many]
    if not len(start):
        return
    total = np.zeros(len(ids) + 1, _U)
    np.cumsum(tg.mix(ids.view(_U) + _U(5)), out=total[1:])
    tile = tg.mix(total[start + n] - total[start] + n.astype(_U)).view(np.int64)
    _, once = np.unique(tile, return_index=True)
    for a in range(0, len(once), 4096):
        at = once[a: a + 4096]
        take = np.concatenate([np.arange(start[t], start[t] + n[t]) for t in at])
        offsets = pa.array(np.r_[0, np.cumsum(n[at])], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(tile[at]), pa.ListArray.from_arrays(offsets, pa.array(ids[take])),
             pa.ListArray.from_arrays(offsets, pa.array(sizes[take].astype(np.int64)))], ["tile", "ids", "sizes"])


def _bitmap(values: np.ndarray) -> np.ndarray:
    """A signature of four to eight bits a shingle; the lengths are powers of two.

    At one or two bits a shingle about half of two sets' differences fall on
    bits that the other has too, so near copies below the share stay open, and
    these grow with the square of their group; at four few of them do.  With
    the members of tiles at most ``TILE_BITS`` travel.
    """
    length = max(512, 4 << (len(values) - 1).bit_length()) if len(values) else 512
    bits = np.zeros(length, bool)
    bits[(values & _U(length - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(_U)


def _folded(bits: np.ndarray, length: int) -> np.ndarray:
    """The signature that a set would have at a shorter length."""
    return np.bitwise_or.reduce(bits.reshape(-1, length), axis=0)


def _may_link(bits, size, others, sizes, num, den):
    """Whether the bit counts leave room for a link between one set and others."""
    return _room(_ones(bits & others), size - _ones(bits), sizes - _ones(others), size + sizes, num, den)


def _ones(bits):
    return np.bitwise_count(bits).sum(axis=-1, dtype=np.int64)


def _room(both, folded, others, total, num, den):
    """The same from the bits in common, and what each side's shingles are more than its bits."""
    overlap = both + np.minimum(folded, others)
    return den * overlap >= num * (total - overlap)


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return int((x[at] == y).sum()) if len(x) else 0


def _verified(pairs: DataFrame, texts: DataFrame, ngram, num, den) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of the sorted whole sets."""
    rows = (pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
            .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
            .select("a", "b", "ta", "tb"))

    def check(batches):
        last = None
        for batch in batches:
            a, b = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            left, right = tg.text_buffer(batch.column(2)), tg.text_buffer(batch.column(3))
            keep = np.zeros(len(a), bool)
            for i, j in tg.row_slices(right[1]):
                s = Sets(right[0], right[1][i: j + 1], ngram)
                for r in range(i, j):
                    text = left[0][left[1][r]: left[1][r + 1]]
                    if last is None or last[0] != a[r] or last[1] != len(text):
                        own = Sets(text, np.array([0, len(text)], np.int64), ngram).row(0)
                        last = (a[r], len(text), own)
                    own, other = last[2], s.row(r - i)
                    both = _overlap(own, other)
                    keep[r] = den * both >= num * (len(own) + len(other) - both) and both > 0
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return rows.mapInArrow(check, "a long, b long").distinct()


def _hub_pairs(tiles: DataFrame, num, den) -> DataFrame:
    """Each tile's smallest id with each other member of a fitting size."""
    return (tiles.select(F.element_at("ids", 1).alias("a"), F.element_at("sizes", 1).alias("na"),
                         F.explode(F.arrays_zip("ids", "sizes")).alias("m"))
            .filter((F.col("m.ids") != F.col("a"))
                    & (F.least("na", "m.sizes") * den >= F.greatest("na", "m.sizes") * num))
            .select("a", F.col("m.ids").alias("b")).distinct())


def _bounded(pairs: DataFrame, sets: DataFrame, num, den) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave room for a link."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n{c}"),
                                 F.col("bits").alias(f"bits_{c}"))

    def bound(batches):
        for batch in batches:
            na, nb = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            keep = np.zeros(len(na), bool)
            for r, both in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                x, y = (np.frombuffer(b, _U) for b in both)
                n = min(len(x), len(y))
                keep[r] = _may_link(_folded(x, n), na[r], _folded(y, n), nb[r], num, den)
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["a", "b"])

    rows = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "bits_a", "bits_b")
    return rows.mapInArrow(bound, "a long, b long").distinct()


def _tile_members(tiles: DataFrame, comps: DataFrame) -> DataFrame:
    """(tile, id, size, comp) of the members of tiles."""
    members = tiles.select("tile", F.explode(F.arrays_zip("ids", "sizes")).alias("m")).select(
        "tile", F.col("m.ids").alias("id"), F.col("m.sizes").alias("size"))
    return members.join(comps, members["id"] == comps["node"], "left").select(
        "tile", "id", "size", F.coalesce("component", "id").alias("comp"))


def _mixed(tiles: DataFrame, comps: DataFrame) -> DataFrame:
    """(tile, id, size, comp, g) of the members of tiles with more than one component, put together in groups."""
    each = materialize(_mixed_tiles(_tile_members(tiles, comps)).filter("g > 2"))  # the hub's pairs are known
    return _grouped(each, lambda some: _tile_members(tiles.join(some, "tile", "left_semi"), comps))


def _mixed_tiles(members: DataFrame, *more: str) -> DataFrame:
    """Tiles with more than one component: their smallest ids, numbers of members, and these on a coarse scale."""
    return (members.groupBy("tile", *more).agg(F.min("comp").alias("x"), F.max("comp").alias("y"),
                                               F.min("id").alias("hub"), F.count("*").alias("g"))
            .filter("x <> y").select("tile", *more, "hub", "g", F.floor(F.log2("g") / 2).alias("scale")))


def _grouped(each: DataFrame, members, *more: str) -> DataFrame:
    """(tile, id, size, comp, g and ``more``): tiles of one smallest id and like size put together where
    that makes fewer pairs, others as they are.

    Parts that near copies left alone make tiles of nearly the same members:
    together they give each pair once.  Where one text shares different
    passages with different others, its tiles stay apart.  ``members`` gives
    the rows of the tiles that it is given.
    """
    by = [*more, "hub", "scale"]
    rows = members(each.select("tile")).join(each.select("tile", *by), "tile")
    together = materialize(rows.select(*by, "id", "size", "comp").distinct())
    pairs = lambda c: F.sum(c.cast("double") * c)
    fewer = materialize(
        together.groupBy(*by).agg(F.count("*").alias("u"))
        .join(each.groupBy(*by).agg(pairs(F.col("g")).alias("pairs")), by)
        .select(*by, "u", (F.col("u").cast("double") * F.col("u") <= F.col("pairs")).alias("fewer")))
    names = ["tile", *more, "id", "size", "comp", "g"]
    groups = together.join(fewer.filter("fewer"), by).withColumns(
        {"tile": F.xxhash64(*by), "g": F.col("u")}).select(*names)
    apart = materialize(each.join(fewer.filter("not fewer"), by, "left_semi").select("tile", *more, "g"))
    if apart.head(1):
        groups = groups.unionByName(members(apart.select("tile")).join(apart, "tile").select(*names))
    return _needed(materialize(groups))


def _needed(groups: DataFrame) -> DataFrame:
    """The groups but those whose members all have the same other group as their largest: it gives their pairs."""
    largest = groups.groupBy("id", "size").agg(F.max(F.struct("g", "tile")).alias("largest"))
    within = (groups.join(largest, ["id", "size"]).groupBy("tile")
              .agg(F.min("largest.tile").alias("x"), F.max("largest.tile").alias("y")).filter("x = y and x <> tile"))
    return materialize(groups.join(within.select("tile"), "tile", "left_anti"))


def _refined(mixed: DataFrame, base: DataFrame, ngram, num, den, level: int) -> tuple[DataFrame, DataFrame]:
    """Groups of too many members cut again: a linked pair also agrees in a part of another cut of the hash space.

    Members that only share a common passage rarely meet again, so the pairs to
    go through fall with each level while none that links is lost.  Near copies
    meet again in most parts; a group that would not have at most half its
    pairs left stays whole.  Gives the groups that are cut, and those that stay.
    """
    lows, n_parts, n_agree = _bands(num, den)

    def keys(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, s in _blocks(batch, ngram):
                rows = np.flatnonzero(s.sizes > 0)
                row, key = _tile_keys(s, *_band_tags(s, rows, num, den, lows), n_parts, n_agree, level)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).take(pa.array(row)), pa.array(key.view(np.int64))], ["id", "key"])

    ids = mixed.select(F.col("id").alias("doc_id")).distinct()
    again = materialize(base.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(
        keys, "id long, key long").distinct())
    parts = mixed.withColumnRenamed("tile", "whole").drop("g").join(again, "id").select(
        F.xxhash64("whole", "key").alias("tile"), "whole", "id", "size", "comp")
    each = materialize(_mixed_tiles(parts, "whole"))
    cut = _grouped(each, lambda some: parts.drop("whole").join(some, "tile", "left_semi"), "whole")
    left = cut.select("tile", "whole", "g").distinct().groupBy("whole").agg(
        F.sum(F.col("g").cast("double") * F.col("g")).alias("left"))
    stay = materialize(mixed.select("tile", "g").distinct().join(left, F.col("tile") == F.col("whole")).filter(
        F.col("left") * 2 > F.col("g").cast("double") * F.col("g")).select("tile"))
    return (cut.join(stay.select(F.col("tile").alias("whole")), "whole", "left_anti").select(*mixed.columns),
            mixed.join(stay, "tile", "left_semi"))


def _cut_anew(mixed: DataFrame, base: DataFrame, ngram, num, den) -> DataFrame:
    """``mixed`` with its largest groups cut, level by level, as long as that makes fewer pairs."""
    most = BLOCK_MEMBERS * HOT_BLOCKS
    rest = None
    for level in range(1, LEVELS + 1):
        hot = mixed.filter(F.col("g") > most)
        if not hot.head(1):
            break
        cool = mixed.filter(F.col("g") <= most)
        cut, whole = _refined(hot, base, ngram, num, den, level)
        cool = cool.unionByName(whole)
        rest = cool if rest is None else rest.unionByName(cool)
        mixed = materialize(cut)
    return mixed if rest is None else rest.unionByName(mixed)


def _short_bits(sets: DataFrame) -> DataFrame:
    """(id, bits): signatures folded to ``TILE_BITS`` at most.

    Shorter ones would save bytes here and leave pairs of near copies below the
    share open, which many tiles hold and which grow with the square of a group.
    """
    def fold(batches):
        for batch in batches:
            short = [_folded(x, min(len(x), TILE_BITS // 64)).tobytes()
                     for x in (np.frombuffer(b, _U) for b in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], ["id", "bits"])

    return sets.select("doc_id", "bits").mapInArrow(fold, "id long, bits binary")


def _cross_pairs(mixed: DataFrame, sets: DataFrame, num, den) -> DataFrame:
    """Pairs of different components in one tile that sizes and bitmaps leave open.

    A long text lies in thousands of tiles, so its signature travels folded to
    ``TILE_BITS``; the few pairs that this leaves open meet their whole
    signatures once each, in ``_bounded``.
    """
    bits = _short_bits(sets)
    n = F.ceil(F.col("g") / BLOCK_MEMBERS).cast("int")
    own = F.pmod(F.xxhash64("id"), n).cast("int")
    dealt = (mixed.join(bits, "id").withColumn("blocks", n).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("tile", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"),
                     "own", "id", "size", "comp", "bits"))
    dealt = dealt.repartition("tile", "p", "q").sortWithinPartitions("tile", "p", "q")

    def compare(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= HELD_ROWS or sum(b.nbytes for b in held) >= HELD_BYTES:
                table = pa.Table.from_batches(held).combine_chunks()
                t, p, q = (np.asarray(table.column(c)) for c in range(3))
                last = (t == t[-1]) & (p == p[-1]) & (q == q[-1])
                whole = int(np.argmax(last))  # the last group may go on in the next batch
                yield from _compare(table.slice(0, whole), num, den)
                held = table.take(pa.array(np.arange(whole, len(t)))).to_batches()  # lets the rest go
        if held:
            yield from _compare(pa.Table.from_batches(held).combine_chunks(), num, den)

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def _compare(table: pa.Table, num, den):
    """Open pairs of whole groups: small ones all at once, others member by member."""
    if not table.num_rows:
        return
    t, p, q, own, ids, sizes, comp = (np.asarray(table.column(c)) for c in range(7))
    first = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
    n = np.diff(np.r_[first, len(t)])
    bits = [np.frombuffer(b, _U) for b in table.column("bits").to_pylist()]
    fits = lambda i, j: ((comp[i] != comp[j]) & (ids[i] != ids[j])
                         & (np.minimum(sizes[i], sizes[j]) * den >= np.maximum(sizes[i], sizes[j]) * num))
    small = (n <= SMALL_TILE) & (p[first] == q[first])
    rows = np.flatnonzero(np.repeat(small, n))
    after = (np.repeat(first + n, n) - np.arange(len(t)) - 1)[rows]
    i = np.repeat(rows, after)
    j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)
    keep = fits(i, j)
    nodes, at = np.unique(ids, return_inverse=True)
    pair = np.minimum(at[i], at[j])[keep] * len(nodes) + np.maximum(at[i], at[j])[keep]
    _, once = np.unique(pair, return_index=True)  # many tiles hold the same pair
    yield from _open_pairs(i[keep][once], j[keep][once], ids, sizes, bits, num, den)
    for a, b in zip(first[~small], (first + n)[~small], strict=True):
        length = np.array([len(bits[r]) for r in range(a, b)])
        x, y = a + np.flatnonzero(own[a:b] == p[a]), a + np.flatnonzero(own[a:b] == q[a])
        for m in np.unique(length):  # pairs whose shorter signature has this length
            rows = np.flatnonzero(length >= m)
            at = np.cumsum(length >= m) - 1
            marks = np.stack([_folded(bits[a + r], m) for r in rows])
            folded = sizes[a + rows] - _ones(marks)
            for i in x[length[x - a] >= m]:
                z = y[(length[y - a] == m) if length[i - a] > m else (length[y - a] >= m)]
                z = z[z > i] if p[a] == q[a] else z
                z = z[fits(i, z)]
                j, k = at[i - a], at[z - a]
                z = z[_room(_ones(marks[j] & marks[k]), folded[j], folded[k], sizes[i] + sizes[z], num, den)]
                if len(z):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(ids[i], ids[z])), pa.array(np.maximum(ids[i], ids[z]))], ["a", "b"])


def _open_pairs(i, j, ids, sizes, bits, num, den, most: int = 1 << 21):
    """The pairs of rows (i, j) that their bitmaps leave open, as ids, compared at the shorter length."""
    if not len(i):
        return
    length = np.array([min(len(bits[x]), len(bits[y])) for x, y in zip(i, j, strict=True)])
    for n in np.unique(length):
        x, y = i[length == n], j[length == n]
        for k in range(0, len(x), max(1, most // int(n))):
            a, b = x[k: k + max(1, most // int(n))], y[k: k + max(1, most // int(n))]
            used, at = np.unique(np.r_[a, b], return_inverse=True)
            marks = np.stack([_folded(bits[r], n) for r in used])
            ok = _may_link(marks[at[: len(a)]], sizes[a], marks[at[len(a):]], sizes[b], num, den)
            if ok.any():
                ends = ids[a[ok]], ids[b[ok]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], ["a", "b"])


def sets_with_bits(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bits): ``shingle_sets`` with signatures, as ``cross_pairs`` takes them."""
    return _sets(docs, ngram, True)


def cross_pairs(mixed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of different components in one tile of ``mixed`` that whole signatures leave open."""
    return _bounded(_cross_pairs(mixed, sets, num, den), sets, num, den)


def similar_links(docs: DataFrame, ngram: int = 3, num: int = 90, den: int = 100,
                  broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(a, b): verified links that connect every component, between smallest ids of equal texts.

    Not every linked pair is listed: pairs already joined through others are
    not looked at again.  Rows without an id or words take no part.  Texts of
    pairs that the bitmaps leave open are written once to the shared folder;
    their ids are broadcast only if there are at most ``broadcast_ids`` of them.
    """
    return _links(docs, materialize(_sets(docs, ngram, True)), ngram, num, den, broadcast_ids)[0]


def _links(docs, sets, ngram, num, den, broadcast_ids):
    """The links, and the components that they make."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
                       ).filter("doc_id is not null and text is not null")
    sets = sets.filter("doc_id is not null and n_shingles > 0")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(partitions, -(-int(total) // BUCKET_SHINGLES))

    def verified(pairs):
        pairs = materialize(pairs)
        if not pairs.head(1):
            return pairs
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
        few = ids.count() <= broadcast_ids
        texts = materialize(base.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"))
        return materialize(_verified(pairs, texts, ngram, num, den))

    tiles = materialize(_tiles(_packed_tiles(base, ngram, num, den, buckets), partitions))
    links = verified(_bounded(_hub_pairs(tiles, num, den), sets, num, den))
    comps = connected_components(links)
    mixed = _mixed(tiles, comps)
    if not mixed.head(1):
        return links, comps
    mixed = _cut_anew(mixed, base, ngram, num, den)
    more = verified(_bounded(_cross_pairs(mixed, sets, num, den), sets, num, den))
    if more.head(1):
        links = links.unionByName(more)
        comps = connected_components(links)
    return links, comps


def jaccard_components(docs: DataFrame, ngram: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest id that links reach, the own id included.
    Texts without words have size 0 and stand alone.  A null id stays null and
    alone; rows that repeat an id with other texts are joined through that id.
    Extra columns are not looked at.  An empty table gives no rows.
    """
    sets = materialize(_sets(docs, ngram, True))
    _, comps = _links(docs, sets, ngram, num, den, BROADCAST_IDS)
    sets = sets.drop("bits")
    # equal texts: the smallest id of each set stands for it
    heads = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"))
    grown = heads.join(comps, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    alone = F.when(F.col("doc_id").isNotNull(), F.least("doc_id", F.coalesce("component_id", "doc_id")))
    return sets.join(grown, "set_id", "left").select("doc_id", "n_shingles", alone.alias("component_id"))


def without_near_copies(docs: DataFrame, ngram: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest id, rows without an id last.

    Rows are judged by their texts.  Where no id is null or repeated the id
    names the row; other rows go by the hash of their text, so copies without
    an id go and different texts under one id stay.  Rows without words all stay.
    """
    odd = materialize(docs.groupBy(F.col("doc_id").cast("long").alias("__id__")).agg(F.count("*").alias("n"))
                      .filter("n > 1 or __id__ is null").select("__id__"))
    key = F.col("doc_id").cast("long")
    if not odd.head(1):
        groups = jaccard_components(docs, ngram, num, den)
        gone = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone__")).distinct()
        return docs.join(gone, key == F.col("__gone__"), "left_anti")
    odd = F.broadcast(odd) if odd.count() <= BROADCAST_IDS else odd
    by_text = F.xxhash64(F.col("text").cast("string")).bitwiseOR(F.lit(-(1 << 63)))
    whole = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    rows = (docs.join(odd, key == F.col("__id__"), "left")
            .withColumn("__key__", F.when(key.isNull() | F.col("__id__").isNotNull(), by_text).otherwise(key))
            .withColumn("__row__", F.xxhash64(*whole)).drop("__id__"))
    groups = jaccard_components(rows.select(F.col("__key__").alias("doc_id"), "text"), ngram, num, den)
    groups = materialize(groups.filter("n_shingles > 0").select(
        F.col("doc_id").alias("__key__"), "component_id").distinct())
    cells = materialize(rows.groupBy("__key__", "__row__", key.alias("id")).agg(F.count("*").alias("n"))
                        .join(groups, "__key__"))
    first = cells.groupBy("component_id").agg(F.min(F.struct(
        F.col("id").isNull().alias("none"), "id", "__key__", "__row__", "n")).alias("first"))
    stays = (F.col("__key__") == F.col("first.__key__")) & (F.col("__row__") == F.col("first.__row__"))
    gone = cells.join(first, "component_id").filter(~stays).select("__key__", "__row__")
    kept = rows.join(gone, ["__key__", "__row__"], "left_anti")
    equal = materialize(first.filter("first.n > 1").select("first.__key__", "first.__row__"))
    if equal.head(1):  # rows that agree in all columns: any of them stays
        one = kept.join(equal, ["__key__", "__row__"], "left_semi").dropDuplicates(["__key__", "__row__"])
        kept = kept.join(equal, ["__key__", "__row__"], "left_anti").unionByName(one)
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def first_of_id(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each repeated id (the first by text); rows without an id all stay.

    Ids that occur once are not shuffled with their texts: only rows of
    repeated ids are.
    """
    repeated = materialize(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"))
                           .filter("n > 1").select(F.col("doc_id").alias("__id__")))
    if not repeated.head(1):
        return docs
    on = F.col("doc_id") == F.col("__id__")
    rest = docs.join(repeated, on, "left_anti")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    by = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last(), *others)
    first = docs.join(repeated, on, "left_semi").withColumn("__n__", F.row_number().over(by)).filter("__n__ = 1")
    return rest.unionByName(first.drop("__n__"))
