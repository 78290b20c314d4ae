"""Ranked lexical search by a dual tree: the highest-scoring documents of each item, exactly.

A document scores, over an item's distinct terms, the sum of ``w * x``: ``w =
floor(1000 * ln((2N + 2) / (2 df + 1)))`` for the term and ``x = (10**9 * tf)
div (1000 * tf + 20 * m)`` for the term in the document, with ``m = 50 + (50 *
n * N) div L`` for the document's length ``n``.  Both are whole and not
negative, so

* an item node (a batch of items) is bounded by the union of its items' terms,
* a document node (a batch of documents) by each term's largest ``x`` in it,

and the sum over the terms of both bounds every score between them from above.
Both sides are halved down to small leaves.  A task goes down its documents'
trees with the item nodes that are still alive; a pair of nodes whose bound is
below the weakest kth score of the node's items goes as a whole, and so does an
item whose own bound in a document leaf is below its kth score.  What is left
is scored as a small dense product.  Equal scores are never pruned, so ties go
to the smaller id exactly.

In Spark: one scan writes each document's counts of the items' terms; grouped
counts give ``df``, ``N`` and ``L``; a slice of one in ``SEED_SLICES`` documents
is searched first, and the kth scores found there are lower bounds to start
with for the search of all documents; a window keeps the first ``k`` rows of
each item among the tasks' own first ``k``.  The items are the stated query set:
they are held whole, in passes of at most ``PASS_ENTRIES`` (item, term) entries.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, scratch_path
from .terms import ALPHANUMERIC, term_counts

PASS_ENTRIES = 5_000_000  # (item, term) entries that one pass over the documents holds
SEED_SLICES = 64          # one in so many documents is searched first
CHUNK = 4096              # documents of a tree
CHUNK_ENTRIES = 2_000_000 # counts of a tree's documents
DOC_LEAF, ITEM_LEAF = 32, 8
NO_ID = (1 << 63) - 1     # documents without an id come after all others
EXACT = 1 << 53           # whole numbers up to here add up exactly as doubles


def _vector_task(terms):
    """Each document's length and its counts of the items' terms."""
    def run(batches):
        number = {t: k for k, t in enumerate(terms.value)}
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for row, code, count, dictionary in term_counts(batch.column("text"), ALPHANUMERIC):
                known = np.array([number.get(t, -1) for t in dictionary.to_pylist()], np.int32)
                rows, at = np.unique(row, return_inverse=True)
                n = np.zeros(len(rows), np.int64)
                np.add.at(n, at, count)
                term = known[code]
                hit = term >= 0
                ends = np.zeros(len(rows) + 1, np.int32)
                np.cumsum(np.bincount(at[hit], minlength=len(rows)), out=ends[1:])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[rows]), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(term[hit])),
                    pa.ListArray.from_arrays(ends, pa.array(count[hit]))], ["id", "n", "terms", "tfs"])
    return run


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(item, term): the distinct terms of each item's texts."""
    def run(batches):
        for batch in batches:
            for row, code, _, dictionary in term_counts(batch.column("text"), ALPHANUMERIC):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(pa.array(row)), dictionary.take(pa.array(code)).cast(pa.string())],
                    ["item", "term"])

    return items.select(F.col(item).cast("long").alias("item"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, "item long, term string").distinct()


class ItemTree:
    """Items in leaves of ``ITEM_LEAF``, halved by which half's terms they share; nodes hold the union of terms."""

    def __init__(self, of_item: list, weights: np.ndarray):
        self.weights = weights.astype(np.float64)
        self.order, self.nodes = [], []
        if of_item:
            self._build(of_item, np.arange(len(of_item)))

    def _build(self, of_item, members) -> int:
        """Adds the node of ``members`` after its children; gives its number."""
        union = np.unique(np.concatenate([of_item[k] for k in members]))
        if len(members) <= ITEM_LEAF:
            lo = len(self.order)
            self.order.extend(members.tolist())
            dense = np.zeros((len(members), len(union)))
            for r, k in enumerate(members):
                at = np.searchsorted(union, of_item[k])
                dense[r, at] = self.weights[of_item[k]]
            self.nodes.append((lo, len(self.order), union, dense, None))
        else:
            members, half = self._halved(of_item, members), len(members) // 2
            lo = len(self.order)
            sides = (self._build(of_item, members[:half]), self._build(of_item, members[half:]))
            self.nodes.append((lo, len(self.order), union, None, sides))
        return len(self.nodes) - 1

    def _halved(self, of_item, members, rounds: int = 6):
        """``members`` in an order whose halves share terms: each round deals them by the terms of both halves."""
        far = members[np.argmin(self._shared(of_item, members, members[:1]))]
        lean = self._shared(of_item, members, [far])
        half = len(members) // 2
        for _ in range(rounds):
            members = members[np.argsort(lean, kind="stable")]
            low, high = (self._shared(of_item, members, m) for m in (members[:half], members[half:]))
            lean = high - low
        return members[np.argsort(lean, kind="stable")]

    def _shared(self, of_item, members, group):
        """Each member's weight of terms, as often as the group's other items have them."""
        flag = np.zeros(len(self.weights))
        for k in group:
            flag[of_item[k]] += self.weights[of_item[k]]
        own = set(np.asarray(group).tolist())
        return np.array([flag[of_item[k]].sum() - (k in own) * self.weights[of_item[k]].sum() for k in members])


class Best:
    """The ``k`` best documents of each item, and the score below which none can join them."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.astype(np.float64)
        self.scores = [np.empty(0)] * len(floors)
        self.ids = [np.empty(0, np.int64)] * len(floors)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids])
        if len(s) > self.k:
            first = np.lexsort((i, -s))[: self.k]
            s, i = s[first], i[first]
        if len(s) == self.k:
            self.floors[item] = max(self.floors[item], s.min())
        self.scores[item], self.ids[item] = s, i


def _doc_nodes(order, at, term, x):
    """The nodes of a halving of ``order``: (lo, hi, terms, largest x, children), children before parents."""
    nodes = []

    def build(lo, hi):
        if hi - lo <= DOC_LEAF:
            spans = [slice(at[d], at[d + 1]) for d in order[lo:hi]]
            t, v = np.concatenate([term[s] for s in spans]), np.concatenate([x[s] for s in spans])
            sides = None
        else:
            mid = (lo + hi) // 2
            sides = build(lo, mid), build(mid, hi)
            t, v = (np.concatenate([nodes[s][c] for s in sides]) for c in (2, 3))
        by = np.argsort(t, kind="stable")
        t, v = t[by], v[by]
        first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.empty(0, np.int64)
        nodes.append((lo, hi, t[first], np.maximum.reduceat(v, first) if len(t) else v, sides))
        return len(nodes) - 1

    if len(order):
        build(0, len(order))
    return nodes


def search_chunk(tree: ItemTree, best: Best, ids, at, term, x) -> int:
    """Scores a chunk of documents (``x`` of ``term``, between ``at``) against all items; gives the pairs scored."""
    lead = np.zeros(len(ids), np.int64)  # documents with the same strongest term lie together
    filled = np.flatnonzero(at[1:] > at[:-1])
    strength = x * tree.weights[term]
    for d in filled:
        lead[d] = term[at[d] + np.argmax(strength[at[d]: at[d + 1]])]
    order = filled[np.argsort(lead[filled], kind="stable")]
    nodes, dense, scored = _doc_nodes(order, at, term, x), np.zeros(len(tree.weights)), 0
    place = np.full(len(tree.weights), -1, np.int64)

    def alive(numbers):
        for k in numbers:
            lo, hi, union, _, _ = tree.nodes[k]
            bound = float(tree.weights[union] @ dense[union])
            if bound > 0 and bound >= best.floors[lo:hi].min():
                yield bound, k

    def visit(d, numbers):
        nonlocal scored
        lo, hi, terms, most, sides = nodes[d]
        dense[terms] = most
        kept = [k for _, k in sorted(alive(numbers), reverse=True)]
        if sides is None:
            while any(tree.nodes[k][4] for k in kept):  # down to the item leaves
                nxt = [s for k in kept for s in (tree.nodes[k][4] or (k,))]
                kept = [k for _, k in sorted(alive(nxt), reverse=True)]
            if kept:
                scored += leaf(order[lo:hi], terms, kept)
            dense[terms] = 0
            return
        dense[terms] = 0
        if kept:
            nxt = [s for k in kept for s in (tree.nodes[k][4] or (k,))]
            for s in sorted(sides, key=lambda s: -float(nodes[s][3] @ tree.weights[nodes[s][2]])):
                visit(s, nxt)

    def leaf(docs, terms, kept):
        place[terms] = np.arange(len(terms))
        values = np.zeros((len(terms), len(docs)))
        for c, d in enumerate(docs):
            values[place[term[at[d]: at[d + 1]]], c] = x[at[d]: at[d + 1]]
        done = 0
        for k in kept:
            lo, hi, union, weights, _ = tree.nodes[k]
            hit = place[union]
            here = hit >= 0
            rows = np.flatnonzero(weights[:, here] @ dense[union[here]] >= best.floors[lo:hi])
            if not len(rows):
                continue
            w, v = weights[np.ix_(rows, np.flatnonzero(here))], values[hit[here]]
            scores = w @ v if float(w.sum(axis=1).max(initial=0)) * 1e6 < EXACT else (w.astype(np.int64) @ v.astype(np.int64))
            for r, s in zip(rows, scores, strict=True):
                good = np.flatnonzero((s > 0) & (s >= best.floors[lo + r]))
                if len(good):
                    best.add(lo + r, s[good], ids[docs[good]])
            done += scores.size
        place[terms] = -1
        return done

    if nodes and tree.nodes:
        visit(len(nodes) - 1, [len(tree.nodes) - 1])
    return scored


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if int(n.max(initial=0)) * n_docs * 50 >= 1 << 63:
        return np.array([50 + (50 * v * n_docs) // n_terms for v in n.tolist()], np.int64)
    return 50 + (50 * n * n_docs) // n_terms


def _search_task(sent, floors, k: int):
    """The task's own best ``k`` documents of each item, over trees of ``CHUNK`` documents."""
    def run(batches):
        item_ids, of_item, weights, n_docs, n_terms = sent.value
        tree = ItemTree(of_item, weights)
        best = Best(floors[np.array(tree.order, int)], k)
        held, docs, entries = [], 0, 0

        def flush():
            ids, n, long, term, tf = (np.concatenate([h[c] for h in held]) for c in range(5))
            at = np.zeros(len(ids) + 1, np.int64)
            np.cumsum(long, out=at[1:])
            m = np.repeat(_lengths(n, n_docs, n_terms), long)
            search_chunk(tree, best, ids, at, term, ((10**9 * tf) // (1000 * tf + 20 * m)).astype(np.float64))

        for batch in batches:
            for i in range(0, len(batch), CHUNK // 4):
                part = batch.slice(i, CHUNK // 4)
                terms, tfs = part.column("terms"), part.column("tfs")
                held.append((np.asarray(part.column("id")), np.asarray(part.column("n")),
                             np.asarray(terms.value_lengths()), np.asarray(terms.flatten()), np.asarray(tfs.flatten())))
                docs, entries = docs + len(part), entries + len(held[-1][3])
                if docs >= CHUNK or entries >= CHUNK_ENTRIES:
                    flush()
                    held, docs, entries = [], 0, 0
        if held:
            flush()
        for at, item in enumerate(tree.order):
            if len(best.ids[at]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item_ids[item]] * len(best.ids[at]), pa.int64()), pa.array(best.ids[at]),
                     pa.array(best.scores[at].astype(np.int64))], ["item_id", "id", "score"])
    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("item_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def _search_pass(docs: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    rows = entries.toArrow().sort_by([("item", "ascending"), ("term", "ascending")])
    coded = rows.column("term").combine_chunks().dictionary_encode()
    terms = coded.dictionary.to_pylist()
    code, of_item, item_ids = np.asarray(coded.indices), [], []
    names = rows.column("item").to_pylist()
    begin = 0
    for end in range(1, len(names) + 1):
        if end == len(names) or names[end] != names[begin]:
            item_ids.append(names[begin])
            of_item.append(np.sort(code[begin:end]).astype(np.int64))
            begin = end
    sent_terms = spark.sparkContext.broadcast(terms)
    path = scratch_path(spark, "vectors")
    (docs.mapInArrow(_vector_task(sent_terms), "id long, n long, terms array<int>, tfs array<long>")
     .write.parquet(path))
    vectors = spark.read.parquet(path)
    n_docs, n_terms = vectors.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), np.int64)
    counted = vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c")).toArrow()
    df[np.asarray(counted.column("t"))] = np.asarray(counted.column("c"))
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(c) + 1))) for c in df], np.int64)
    sent = spark.sparkContext.broadcast((item_ids, of_item, weights, int(n_docs), int(n_terms)))
    schema = "item_id long, id long, score long"
    seeds = vectors.filter(F.pmod(F.xxhash64("id", "n"), F.lit(SEED_SLICES)) == 0)
    none = np.zeros(len(item_ids))
    kth = {r.item_id: r.score for r in _first(seeds.mapInArrow(_search_task(sent, none, k), schema), k)
           .filter(F.col("rank") == k).collect()}
    floors = np.array([kth.get(i, 0) for i in item_ids], float)
    return _first(vectors.mapInArrow(_search_task(sent, floors, k), schema), k)


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, item: str = "item_id",
                  text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest-scoring documents of each item with a score above 0.

    Rows that share an item's id (null is one of them) are one item with the
    terms of all.  Every row of ``docs`` is a document; rows without an id come
    last among equal scores, in the order of their lengths' scores alone.  Null
    and empty texts have no terms: such items give no rows, such documents do
    not count.  Empty tables give no rows.  Only ``doc_id`` and ``text`` are
    read.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                        F.col("text").cast("string").alias("text"))
    path = scratch_path(spark, "item-terms")
    _item_terms(items, item, text).write.parquet(path)
    entries = spark.read.parquet(path)
    passes = max(1, -(-entries.count() // PASS_ENTRIES))
    made = None
    for p in range(passes):
        part = entries.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p) if passes > 1 else entries
        found = _search_pass(texts, part, k)
        made = found if made is None else made.unionByName(found)
    return made.select("item_id", F.col("rank").cast("int").alias("rank"),
                       F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "score")


#: All scores by joins on the term.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(ts))::BIGINT AS terms FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
u AS (SELECT k, unnest(ts) AS term FROM d),
t AS (SELECT k, term, count(*)::BIGINT AS tf FROM u WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
      FROM t, c GROUP BY term, docs),
m AS (SELECT k, doc_id, (50 + (50 * len(ts)::BIGINT * docs) // terms)::BIGINT AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN w USING (term) JOIN m USING (k) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
