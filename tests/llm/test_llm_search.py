"""Brute-force versions of the divergence audit, the ranked search and substring dedup, and odd rows."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from loadcurve.llm import lexical_search, source_divergence, substring_dedup
from loadcurve.llm.terms import ALPHABETIC, ALPHANUMERIC, term_counts

SCHEMA = "doc_id long, text string, lang string, source string, id int, term string, n int"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- terms ---------------------------------------------------------------


@pytest.mark.parametrize("kind, pattern", [(ALPHABETIC, r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"),
                                           (ALPHANUMERIC, r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")])
def test_term_counts_equal_regular_expressions(kind, pattern):
    import pyarrow as pa
    texts = [None, "", "A b\x00B a1 É é", "ends", "starts here", " ", "x" * 5000, "naïve-ÉCOLE 3D 日本 ’s"]
    column = pa.array(["dropped", *texts, "dropped"])[1:-1]
    got = defaultdict(dict)
    for row, code, count, dictionary in term_counts(column, kind):
        for r, c, n in zip(row, code, count, strict=True):
            got[int(r)][dictionary[int(c)].as_py()] = int(n)
    assert dict(got) == {k: dict(Counter(found)) for k, t in enumerate(texts)
                         if (found := re.findall(pattern, lower(t)))}


# --- divergence ----------------------------------------------------------


def brute_audit(rows, min_docs, a, top):
    terms = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for t, la, so in rows]
    groups, out = sorted({(la, so) for la, so, _ in terms}), []
    for lang in {la for la, _ in groups}:
        df = Counter(t for la, _, ts in terms if la == lang for t in set(ts))
        kept = [t for t in df if df[t] >= min_docs]
        v, total = len(kept), Counter(t for la, _, ts in terms if la == lang for t in ts if df[t] >= min_docs)
        shares = lambda c: {t: 1 + 10**9 * (c[t] + a) // (sum(c[x] for x in kept) + a * v) for t in kept}
        q, p, n = shares(total), {}, {}
        for so in [s for la, s in groups if la == lang]:
            n[so] = Counter(t for la, s, ts in terms if (la, s) == (lang, so) for t in ts)
            p[so] = shares(n[so])
        for so in p:
            pairs = [(sum(abs(p[so][t] - p[x][t]) for t in kept), x) for x in p if x != so]
            above = [(p[so][t] - q[t], t) for t in kept if n[so][t] and p[so][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", above, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, so, part, x, f, k + 1) for k, (f, x) in enumerate(items[:most])]
    return sorted(out)


def divergence_rows(seed=5, n=300):
    rng = np.random.default_rng(seed)
    vocab = [f"{'éaz'[k % 3]}{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}" for k in range(60)]
    rows = []
    for k in range(n):
        words = [vocab[min(int(rng.exponential(12)), 59)] for _ in range(rng.integers(0, 60))]
        text = " ".join(w.upper() if rng.random() < 0.2 else w for w in words)
        rows.append((None if k % 41 == 0 else text, [None, "", "en", "en", "en", "fr"][k % 6],
                     None if k % 29 == 0 else f"s{k % 7}" if k % 3 else "hot"))
    rows += [("", "xx", "only"), (None, "yy", "a"), ("seldom", "yy", "b"), ("...", "yy", None)]
    return rows


@pytest.mark.parametrize("block", [100_000, 13])
def test_divergence_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(source_divergence, "BLOCK_POSTINGS", block)
    rows = divergence_rows()
    docs = spark.createDataFrame([(None, t, la, so, 1, "x", 2) for t, la, so in rows], SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in source_divergence.audit(docs, 8, 5, 7).collect())
    assert got == brute_audit(rows, 8, 5, 7)


def test_divergence_without_broadcasts_and_of_empty_tables(spark, monkeypatch):
    rows = divergence_rows(seed=8, n=80)
    docs = spark.createDataFrame([(None, t, la, so, 1, "x", 2) for t, la, so in rows], SCHEMA)
    monkeypatch.setattr(source_divergence, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in source_divergence.audit(docs, 5, 5, 50).collect()) == brute_audit(rows, 5, 5, 50)
    assert source_divergence.audit(docs.limit(0)).collect() == []


# --- search --------------------------------------------------------------


def brute_search(docs, items, k):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    docs = [(i, Counter(re.findall(pattern, lower(t)))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n, size = len(docs), sum(c.total() for _, c in docs)
    df, of = Counter(t for _, c in docs for t in c), defaultdict(set)
    for i, t in items:
        of[i] |= set(re.findall(pattern, lower(t)))
    out = []
    for item, terms in of.items():
        found = []
        for i, c in docs:
            m = 50 + 50 * c.total() * n // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                        for t in terms if c[t])
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out += [(item, r + 1, None if i == math.inf else i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def search_rows(n=400, seed=3):
    rng = np.random.default_rng(seed)
    text = lambda most: " ".join(f"w{min(int(rng.exponential(25)), 300)}" for _ in range(rng.integers(0, most)))
    docs = [(int(k), text(60)) for k in rng.permutation(n)]
    docs += [(k + n, docs[k][1]) for k in range(0, n, 5)]  # ties
    docs += [(7, "w1 w2 w3"), (7, "w1 w2 w3"), (None, docs[0][1]), (None, None), (n * 2, ""), (n * 2 + 1, text(20_000))]
    items = [(k, text(25)) for k in range(40)] + [(3, "w1 w299"), (None, "w5 w6"), (50, None), (51, ""), (52, "unknown")]
    return docs, items


@pytest.mark.parametrize("chunk, entries", [(4096, 5_000_000), (64, 5_000_000), (64, 150)])
def test_search_equals_brute_force(spark, monkeypatch, chunk, entries):
    monkeypatch.setattr(lexical_search, "CHUNK", chunk)
    monkeypatch.setattr(lexical_search, "PASS_ENTRIES", entries)
    docs, items = search_rows()
    got = lexical_search.ranked_search(
        spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in docs], SCHEMA).repartition(6),
        spark.createDataFrame(items, "item_id long, text string"), k=10)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_search(docs, items, 10)


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert lexical_search.ranked_search(docs.limit(0), items).collect() == []
    assert lexical_search.ranked_search(docs, items.limit(0)).collect() == []


def test_search_prunes_pairs():
    """Of a collection in two halves without common terms, no pair across them is scored."""
    rng = np.random.default_rng(1)
    of_item = [np.unique(rng.integers(0, 500, 20)) + 500 * (k % 2) for k in range(64)]
    tree = lexical_search.ItemTree(of_item, np.full(1000, 10))
    best = lexical_search.Best(np.zeros(64), 5)
    per, n = 15, 1024
    term = np.concatenate([np.sort(rng.choice(500, per, replace=False)) + 500 * (d % 2) for d in range(n)])
    scored = lexical_search.search_chunk(tree, best, np.arange(n), np.arange(n + 1) * per, term, np.ones(n * per))
    assert 0 < scored <= 0.5 * 64 * n
    for at, item in enumerate(tree.order):
        exact = sorted((-10 * len(np.intersect1d(of_item[item], term[d * per: (d + 1) * per])), d) for d in range(n))[:5]
        assert sorted(zip(-best.scores[at], best.ids[at], strict=True)) == [x for x in exact if x[0]]


# --- substrings ----------------------------------------------------------


def brute_removal(rows, length):
    words = [(math.inf if i is None else i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            key = tuple(w[k: k + length])
            first[key] = min(first.get(key, math.inf), i)
    out = []
    for (i, w), (doc, _) in zip(words, rows, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k: k + length])] < i:
                gone[k: k + length] = [True] * length
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(n=150, seed=4, length=50):
    rng = np.random.default_rng(seed)
    shared = [" ".join(f"p{rng.integers(1000)}" for _ in range(rng.integers(length // 2, 3 * length))) for _ in range(6)]
    rows = []
    for k in rng.permutation(n):
        parts = [" ".join(f"r{rng.integers(2000)}" for _ in range(rng.integers(0, 2 * length)))]
        if k % 2:
            parts.append(shared[rng.integers(6)])
        if k % 5 == 0:
            parts.append("\t\n".join(["again"] * int(rng.integers(1, 2 * length))))
        if k % 7 == 0 and rows:  # a near copy
            w = (rows[rng.integers(len(rows))][1] or "").split()
            if w:
                w[rng.integers(len(w))] = "Edited"
            parts = [" ".join(w)]
        rng.shuffle(parts)
        rows.append((int(k), "  ".join(parts)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[3][1]), (None, rows[3][1]), (None, rows[5][1] + " more"), (n + 3, None),
             (n + 4, ""), (n + 5, " \n\x0b\x0c\r "), (5, shared[0] + " x"), (5, shared[0] + " y"), (5, shared[0] + " y"),
             (n + 6, " ".join(f"long{k % 700}" for k in range(60_000))), (n + 7, " ".join(["one"] * length))]
    return rows


@pytest.mark.parametrize("length", [50, 7, 2, 1])
def test_removal_equals_brute_force(spark, length):
    rows = passages(length=length)
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", 2) for i, t in rows], SCHEMA).repartition(4)
    got = substring_dedup.digest(substring_dedup.remove_repeats(docs, length))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_removal(rows, length)


def test_removal_of_an_empty_table_and_kept_words(spark):
    docs = spark.createDataFrame([(2, "a b c  d"), (1, "x a b c"), (3, "a\tB c")], "doc_id long, text string")
    assert substring_dedup.remove_repeats(docs.limit(0), 3).collect() == []
    got = {r.doc_id: r.kept_text for r in substring_dedup.remove_repeats(docs, 3).collect()}
    assert got == {1: "x a b c", 2: "d", 3: "a B c"}


def test_search_and_removal_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = lexical_search.ranked_search(docs, items, 20).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_search(rows, [(r.item_id, r.text) for r in items.collect()], 20)
    removed = substring_dedup.digest(substring_dedup.remove_repeats(docs))
    assert sorted((tuple(r) for r in removed.collect()), key=str) == brute_removal(rows, 50)
    assert removed.agg(F.sum("n_removed")).first()[0] > 0
