"""Source divergence audit: how far the word shares of each source lie from its peers' and its language's.

Within a language, every term that at least ``min_docs`` documents hold has in
each group (language, source) the share ``p = 1 + floor(scale * (n + a) /
(N + a * V))``, with ``n`` the group's count of the term, ``N`` its counts of
all kept terms and ``V`` their number.  The divergence of two groups is the sum
of ``|p - p'|`` over all kept terms.

*Gustavson row accumulation.*  A language's counts are dealt by term into
blocks of bounded size.  A block's task keeps them term-major; each group's row
is then scattered through that index into one dense accumulator, a number per
peer, so postings of a term are never emitted as pairs.  Terms that only one of
two groups has, or none, would need dense rows; instead the scatter adds

    |p - p'| - |p - z'| - |p' - z| + |z - z'|

for terms of both (``z`` is the share of a term that a group lacks), each row
adds its sum of ``|p - z'|`` for all peers by binary search in its sorted
shares, and the first block adds ``(V - v - v') * |z - z'|`` for ``v`` and ``v'``
terms present.  All of it is whole numbers.  A block gives one number per pair
of groups, and Spark sums them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import bound_batches, scratch_path
from .terms import ALPHABETIC, term_counts

SCALE = 1_000_000_000
BLOCK_POSTINGS = 100_000  # counts that one task holds as its index
BROADCAST_ROWS = 200_000  # rows up to which a table of groups or terms may be broadcast
HELD = 400_000            # counts that a task of the scan sums up before it hands them on

_COUNTS = "lang string, source string, term string, n long, docs long"


def _count_task(batches):
    """Counts and document counts of the terms of each group, summed within the task; a null term marks the group."""
    held, rows = [], 0

    def summed():
        table = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return table.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(
            ["lang", "source", "term", "n", "docs"])

    for batch in batches:
        names = [batch.column(c).cast(pa.string()) for c in ("lang", "source")]
        group = np.unique(np.stack([np.asarray(x.dictionary_encode().indices) for x in names]), axis=1,
                          return_index=True, return_inverse=True)
        first, group = group[1], group[2].reshape(-1)
        empty = pa.array([None] * len(first), pa.string())
        held.append(pa.table([*[x.take(pa.array(first)) for x in names], empty,
                              pa.array(np.zeros(len(first), np.int64)), pa.array(np.zeros(len(first), np.int64))],
                             ["lang", "source", "term", "n", "docs"]))
        for row, code, count, dictionary in term_counts(batch.column("text"), ALPHABETIC):
            key, at = np.unique(group[row] * len(dictionary) + code, return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, at, count)
            g = pa.array(first[key // len(dictionary)])
            held.append(pa.table([*[x.take(g) for x in names],
                                  dictionary.take(pa.array(key % len(dictionary))).cast(pa.string()),
                                  pa.array(n), pa.array(np.bincount(at).astype(np.int64))],
                                 ["lang", "source", "term", "n", "docs"]))
            rows += len(key)
            if rows > HELD:
                held, rows = [summed()], 0
                if len(held[0]) > HELD // 2:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held = []
    if held:
        yield from summed().to_batches(max_chunksize=50_000)


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _small(df: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows for a join: broadcast within the bound, shuffled beyond it."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _share(n, size, terms, a: int):
    """``1 + floor(SCALE * (n + a) / (size + a * terms))``, in whole decimals."""
    wide = lambda c: c.cast("decimal(30,0)")
    top = (wide(F.lit(SCALE)) * wide(n + F.lit(a))).cast("decimal(38,0)")
    return F.lit(1) + F.call_function("div", top, wide(size + F.lit(a) * terms))


def group_shares(docs: DataFrame, min_docs: int = 30, a: int = 5) -> tuple[DataFrame, DataFrame, int]:
    """Shares of the terms that groups have, the groups, and the number of groups.

    The first is (lang, source, term, p, q), ``q`` the language's share.  The
    second is (lang, source, peer, peers, zero, held, kept, blocks): the
    group's number within its language, the number of groups there, its share
    of a term it lacks, how many kept terms it has, how many its language
    keeps, and how many blocks the language's counts take.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counts = _stored(docs.select(text("text"), text("lang"), text("source")).mapInArrow(_count_task, _COUNTS), "counts")
    kept = _stored(counts.filter("term IS NOT NULL").groupBy("lang", "term")
                   .agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"))
                   .filter(F.col("docs") >= min_docs).select("lang", "term", "total"), "kept")
    n_kept = kept.count()
    postings = _stored(counts.join(_small(kept, n_kept), ["lang", "term"]).groupBy("lang", "source", "term")
                       .agg(F.sum("n").alias("n"), F.max("total").alias("total")), "postings")
    by_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    sizes = postings.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.count("*").alias("held"))
    groups = (counts.filter("term IS NULL").select("lang", "source").distinct()
              .join(sizes, ["lang", "source"], "left").join(by_lang, "lang", "left")
              .fillna(0, ["size", "held", "kept", "lang_size"]))
    lang = Window.partitionBy("lang")
    groups = groups.select(
        "lang", "source", "size", "held", "kept", "lang_size",
        (F.row_number().over(lang.orderBy("source")) - 1).alias("peer"), F.count("*").over(lang).alias("peers"),
        F.when(F.col("kept") > 0, _share(F.lit(0), F.col("size"), F.col("kept"), a)).otherwise(0).cast("long").alias("zero"),
        F.greatest(F.lit(1), F.ceil(F.sum("held").over(lang) / F.lit(BLOCK_POSTINGS))).cast("int").alias("blocks"))
    groups = _stored(groups, "groups")
    n_groups = groups.count()
    shares = postings.join(_small(groups, n_groups), ["lang", "source"]).select(
        "lang", "source", "term", "peer", "blocks", "zero",
        _share(F.col("n"), F.col("size"), F.col("kept"), a).cast("long").alias("p"),
        _share(F.col("total"), F.col("lang_size"), F.col("kept"), a).cast("long").alias("q"))
    return shares, groups, n_groups


def _accumulate(key, index: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """The block's part of the divergence of each group (a row) from every peer (its accumulator)."""
    groups = groups.sort_values("peer")
    zero, held = groups["zero"].to_numpy(np.int64), groups["held"].to_numpy(np.int64)
    n_peers = len(groups)
    index = index.assign(code=pd.factorize(index["term"])[0]).sort_values(["code", "peer"])
    code, peer, p = (index[c].to_numpy(np.int64) for c in ("code", "peer", "p"))
    begin = np.searchsorted(code, np.arange(code[-1] + 2 if len(code) else 1))
    by_row = np.argsort(peer, kind="stable")
    row_at = np.searchsorted(peer[by_row], np.arange(n_peers + 1))
    first = int(key[1]) == 0
    made = []
    for g in range(n_peers):
        own = by_row[row_at[g]: row_at[g + 1]]
        acc = np.zeros(n_peers, np.int64)
        if len(own):
            share = np.sort(p[own])
            below = np.zeros(len(share) + 1, np.int64)
            np.cumsum(share, out=below[1:])
            k = np.searchsorted(share, zero)
            acc += zero * (2 * k - len(share)) + below[-1] - 2 * below[k]
            long = begin[code[own] + 1] - begin[code[own]]
            ends = np.cumsum(long)
            at = np.arange(ends[-1]) - np.repeat(ends - long - begin[code[own]], long)
            mine, other, to = np.repeat(p[own], long), p[at], peer[at]
            both = (np.abs(mine - other) - np.abs(mine - zero[to]) - np.abs(other - zero[g])
                    + np.abs(zero[g] - zero[to]))
            later = to > g  # once for each pair
            np.add.at(acc, to[later], both[later])
        if first:
            acc[g + 1:] += (int(groups["kept"].iloc[0]) - held[g] - held[g + 1:]) * np.abs(zero[g] - zero[g + 1:])
        elif not len(own):
            continue
        made.append((key[0], g, acc.tolist()))
    return pd.DataFrame({c: pd.Series([m[i] for m in made], dtype=kind)
                         for i, (c, kind) in enumerate((("lang", object), ("g", "int32"), ("parts", object)))})


def pair_divergences(shares: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value): every group with every other source of its language."""
    index = shares.select("lang", "term", "peer", "p", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"))
    peers = groups.select(*[F.col(c).alias(c) for c in ("lang", "peer", "zero", "held", "kept")],  # own names for cogroup
                          F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    parts = index.groupBy("lang", "block").cogroup(peers.groupBy("lang", "block")).applyInPandas(
        _accumulate, "lang string, g int, parts array<long>")
    sums = (parts.select("lang", "g", F.posexplode("parts").alias("h", "part")).filter("g <> h")
            .groupBy("lang", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).agg(F.sum("part").alias("value")))
    both = sums.select("lang", "value", F.explode(F.array(
        F.struct(F.col("g").alias("g"), F.col("h").alias("h")),
        F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("x")).select("lang", "value", "x.g", "x.h")
    name = lambda number, to: _small(groups.select("lang", F.col("peer").alias(number), F.col("source").alias(to)),
                                     n_groups)
    return both.join(name("g", "source"), ["lang", "g"]).join(name("h", "item"), ["lang", "h"]).select(
        "lang", "source", "item", "value")


def audit(docs: DataFrame, min_docs: int = 30, a: int = 5, top_terms: int = 50) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs``.

    Part ``pair``: every other source of the language with the divergence from
    it.  Part ``term``: the ``top_terms`` terms whose share lies furthest above
    the language's.  Ties rank by the item's bytes.  Null text, language and
    source count as ''.  Rows count one by one, repeated ones too; a group
    without terms has shares of zero counts; a language without kept terms has
    divergences of 0; an empty table gives no rows.  Other columns are not read.
    """
    shares, groups, n_groups = group_shares(docs, min_docs, a)
    above = shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                          (F.col("p") - F.col("q")).alias("value"))
    pairs = pair_divergences(shares, groups, n_groups).withColumn("part", F.lit("pair"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    ranked = lambda df: df.select("lang", "source", "part", "item", F.col("value").cast("long"), rank)
    return ranked(pairs).unionByName(ranked(above).filter(F.col("rank") <= top_terms))


#: All shares as dense rows, every pair of sources by a join on the term.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, term, k, count(*) AS n
      FROM (SELECT lang, source, k, unnest(ts) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n)::BIGINT AS total FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 30),
c AS (SELECT lang, source, term, sum(n)::BIGINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS size FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n)::BIGINT AS size FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.size, 0) + 5 * v.v) AS p,
        1 + (1000000000::HUGEINT * (kept.total + 5)) // (v.size + 5 * v.v) AS q
      FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN s USING (lang, source)
      LEFT JOIN c USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
items AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pairs.value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM items)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""
