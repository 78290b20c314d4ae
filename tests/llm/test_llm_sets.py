"""Brute-force versions of the operators on pairs, mixes and the pipeline."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from loadcurve.llm import components, decontaminate, mixing, ngram_join, queries
from test_llm_text import grams, odd_docs


def brute_components(rows, k, num, den):
    sets, parent = {d: grams(t, k) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def family(n=120, seed=2):
    """Copies, near copies of every degree and texts that share one passage."""
    rng = np.random.default_rng(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(n):
        if k % 3 and rows:
            w = rows[rng.integers(len(rows))][1].split()
            for _ in range(rng.integers(0, 5)):
                w[rng.integers(len(w))] = f"e{rng.integers(10_000)}"
        else:
            w = [f"r{rng.integers(10_000)}" for _ in range(rng.integers(4, 150))]
            if k % 2:
                w += passage
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize("ngram, num, members", [(3, 90, 2048), (5, 80, 2048), (5, 70, 40)])
def test_jaccard_components_equal_brute_force(spark, monkeypatch, ngram, num, members):
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", members)
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id)
           for r in ngram_join.jaccard_components(docs, ngram, num, 100).collect()}
    assert got == brute_components(rows, ngram, num, 100)


def test_long_texts_of_one_tile_meet_their_whole_signatures(spark, monkeypatch):
    """Signatures folded far below the texts' sizes, and little held at once: the same components."""
    monkeypatch.setattr(ngram_join, "TILE_BITS", 512)
    monkeypatch.setattr(ngram_join, "HELD_BYTES", 4096)
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in range(6000)]
    rows = []
    for d in range(12):  # one half in common; within each third, near copies of every degree
        words = base[:3000] + [f"{d % 3}x{i}" for i in range(3000)]
        for at in rng.choice(np.arange(3000, 6000), 25 * d, replace=False):
            words[at] = f"{d}y{at}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_components(docs, 3, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 3, 80, 100)


@pytest.mark.parametrize("members", [8, 2048])
def test_near_copies_are_gone_through_in_few_groups(spark, monkeypatch, members):
    """Texts lie in few groups of the second search, though near copies share most of their tiles; links stay whole."""
    monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", members)
    rng = np.random.default_rng(6)
    base, rows = [f"b{i}" for i in range(160)], []
    for d in range(70):  # copies with more and more changes, so that many stay below the share
        words = list(base)
        for at in rng.choice(160, d // 5, replace=False):
            words[at] = f"{d}y{at}"
        rows.append((d, " ".join(words)))
    for d in range(70, 130):  # no copies: one passage in common
        rows.append((d, " ".join([f"p{i}" for i in range(60)] + [f"{d}z{i}" for i in range(100)])))
    seen, search = [], ngram_join._cross_pairs

    def spy(mixed, *rest):
        n = mixed.groupBy("id").count().collect()
        seen.append((sum(r["count"] for r in n), len(n)))
        return search(mixed, *rest)

    monkeypatch.setattr(ngram_join, "_cross_pairs", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ngram_join.jaccard_components(docs, 5, 80, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows, 5, 80, 100)
    (members_of_groups, texts), = seen
    assert texts >= 40 and members_of_groups <= 6 * texts


def test_a_task_packs_the_tiles_of_its_blocks_together(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(d, " ".join(map(str, rng.integers(0, 1 << 40, 6000)))) for d in range(30)]  # over two blocks of texts
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    together = ngram_join._packed_tiles(docs, 5, 80, 100, 300).collect()
    assert len(together) == len({r.bucket for r in together}) == 300
    monkeypatch.setattr(ngram_join, "MOST_ENTRIES", 1)
    apart = ngram_join._packed_tiles(docs, 5, 80, 100, 300).collect()
    assert len(apart) > 300

    def entries(packed):
        out = []
        for r in packed:
            n = np.frombuffer(r.counts, np.uint32)
            values = [np.repeat(np.frombuffer(x, k), n).tolist()
                      for x, k in ((r.sets, np.int64), (r.ids, np.int64), (r.sizes, np.uint32))]
            out += zip([r.bucket] * int(n.sum()), *values, np.frombuffer(r["keys"], np.uint32).tolist(), strict=True)
        return sorted(out)

    assert entries(together) == entries(apart)


def test_join_takes_odd_rows(spark):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd_docs(spark)).collect()]
    assert len(got) == 9
    assert {g[0]: g[2] for g in got} == {k: k for k in (1, 2, 3, 4, 5, 9, None)}
    assert {g[:2] for g in got if g[0] in (1, 2, 3)} == {(1, 0), (2, 0), (3, 0)}
    assert ngram_join.jaccard_components(odd_docs(spark).limit(0)).count() == 0
    assert ngram_join.first_of_id(odd_docs(spark)).count() == 7


@pytest.mark.parametrize("per_task", [1_000_000, 7])
def test_connected_components(spark, per_task):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (5, 5), (100, 102), (7, 60)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df, per_task=per_task).collect()}
    assert got == {**{i: 0 for i in [*range(41), 60]}, 100: 100, 101: 100, 102: 100}
    assert components.connected_components(df.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(int(n)))) for i, n in enumerate([5, 6, 8, 14, 25, 40, 59, 90, 200])]
    docs = []
    for d in range(150):
        w = [f"n{rng.integers(5_000)}" for _ in range(rng.integers(0, 200))]
        if d % 2:
            q = items[rng.integers(len(items))][1].split()
            for _ in range(rng.integers(0, 3)):
                q[rng.integers(len(q))] = "changed"
            at = rng.integers(len(w) + 1)
            w[at:at] = q[rng.integers(0, 2): len(q) - rng.integers(0, 2)]
        docs.append((d, " ".join(w).title() + "."))
    shingle = lambda t: [tuple(t.lower().rstrip(".").split()[i: i + 5]) for i in range(len(t.split()) - 4)]
    want = set()
    for i, q in items:
        own = Counter(shingle(q))
        n = sum(own.values())
        for d, t in docs:
            s = shingle(t)
            best = 0.0
            for a in range(-n + 1, len(s)):
                window = Counter(s[max(a, 0): a + n])
                both = sum((own & window).values())
                best = max(best, both / (n + sum(window.values()) - both))
            if best >= 0.8:
                want.add((d, i))
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"), block_items=4)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 30


def test_leaks_take_odd_rows(spark):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "ein anderes"), (3, "ein anderes"), (4, "!!")],
                                  "item_id long, text string")
    got = decontaminate.find_leaks(odd_docs(spark), items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(5, 3)}
    assert decontaminate.without_leaks(odd_docs(spark), items).count() == 6
    assert decontaminate.find_leaks(odd_docs(spark), items.limit(0)).count() == 0
    assert decontaminate.find_leaks(odd_docs(spark).limit(0), items).count() == 0


def test_stages_judge_rows_and_not_ids(spark):
    """Leaks and copies without an id go; different texts under one id stay; one of wholly equal rows stays."""
    import corpus_pipeline as cp
    text = lambda k: " ".join(f"t{k}x{j}" for j in range(60))
    item = " ".join(f"q{j}" for j in range(30))
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = ([(None, f"{text(0)} {item}"), (None, text(1)), (3, f"{text(2)} {item}"), (3, text(3)), (3, text(4))]
            + [(None, text(5))] * 3 + [(6, text(6)), (7, text(6)), (None, text(6)), (8, text(7)), (8, text(7))]
            + [(None, text(9)), (8, text(9) + " more"), (None, ""), (None, None), (8, "")])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clean = decontaminate.without_leaks(docs, items, by_id=False)
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    assert pairs(clean) == sorted((r for r in rows if item not in (r[1] or "")), key=str)
    assert (None, rows[0][1]) not in pairs(decontaminate.without_leaks(docs, items))
    want = [r for k, r in enumerate(rows) if k not in (6, 7, 9, 10, 12, 13)]
    assert pairs(cp.near_duplicate_stage(spark, docs, "")) == sorted(want, key=str)
    plain = [(k, text(k // 2)) for k in range(8)]
    got = cp.near_duplicate_stage(spark, spark.createDataFrame(plain, "doc_id long, text string"), "")
    assert pairs(got) == plain[::2]


def test_simhash_blocks_find_all_within_radius():
    rng = np.random.default_rng(0)
    index = decontaminate._Index([(0, " ".join(f"a{i}" for i in range(40)))], 0.8)
    size, (own, *_rest) = next(iter(index.tables.items()))
    marks = own[rng.integers(len(own), size=500)].copy()
    for m in range(500):
        for bit in rng.choice(64, rng.integers(0, 7), replace=False):
            marks[m] ^= np.uint64(1) << np.uint64(bit)
    want = {(m, e) for m in range(500) for e in range(len(own)) if int(marks[m] ^ own[e]).bit_count() <= 3}
    assert set(map(tuple, index.near(size, marks).T.tolist())) == want


def test_temperature_weights():
    tokens = {"a": 1000, "b": 100, "c": 10, "none": 0}
    entropy = lambda w: -sum(x * math.log(x) for x in w.values() if x)
    for share in (0.2, 0.3, 0.7, 0.9, 0.999):   # below the shares' entropy (0.33) and above
        alpha, w = mixing.temperature_weights(tokens, entropy_share=share, repeats=1e9)
        assert entropy(w) == pytest.approx(share * math.log(3)) and w["none"] == 0 and sum(w.values()) == pytest.approx(1)
        assert (alpha > 1) == (share * math.log(3) < entropy({k: v / 1110 for k, v in tokens.items()}))
        assert w["a"] / w["b"] == pytest.approx(10 ** alpha)
    alpha, w = mixing.temperature_weights(tokens, even=0.5, repeats=1e9)
    own = entropy({k: v / 1110 for k, v in tokens.items()})
    assert entropy(w) == pytest.approx((own + math.log(3)) / 2) and 0 < alpha < 1
    alpha, w = mixing.temperature_weights(tokens, entropy_share=0.9, repeats=4.0)
    assert max(w[k] * 1110 / tokens[k] for k in "abc") == pytest.approx(4.0) and 0 < alpha < 1
    alpha, w = mixing.temperature_weights(tokens, entropy_share=0.05, repeats=1.05)
    assert w["a"] * 1110 / 1000 == pytest.approx(1.05) and alpha > 1
    assert mixing.temperature_weights({"a": 5, "b": 5})[0] == 1.0
    assert mixing.temperature_weights({}) == (1.0, {})


def plain_mix(docs, even, repeats, blocks):
    """The mix by plain loops over rows; Spark gives only the hashes that deal and order the blocks."""
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text",
                       F.pmod(F.xxhash64(F.lit(0), F.col("doc_id").cast("long")), F.lit(blocks)).alias("block")).collect()
    tokens, held = Counter(), Counter()
    for r in rows:
        n = len((r.text or "").encode().split())
        tokens[r.source] += n
        held[r.source, r.block] += n
    _, weights = mixing.temperature_weights(tokens, None, even, None, repeats)
    total, used = sum(tokens.values()), set()
    plans = [(s, b, e) for s, b in held for e in range(math.floor(weights[s] * total / tokens[s] + 1e-9) + 1 if tokens[s] else 1)]
    spark = docs.sparkSession
    marks = spark.createDataFrame(plans, "s string, b int, e int").withColumn(
        "at", F.xxhash64(F.lit(0), "s", "e", "b")).collect()
    at = {(r.s, r.b, r.e): (r["at"], r.b) for r in marks}
    for s in tokens:
        share = weights[s] * total
        whole = math.floor(share / tokens[s] + 1e-9) if tokens[s] else 0
        for e in range(whole + 1):
            left = share - whole * tokens[s] + 1e-6
            for _, b in sorted(at[s, b, e] for x, b in held if x == s):
                left -= held[s, b]
                if e < whole or left >= 0:
                    used.add((s, b, e))
    return Counter((r.doc_id, e) for r in rows for s, b, e in [(r.source, r.block, x) for x in range(50)] if (s, b, e) in used)


@pytest.mark.parametrize("even, repeats", [(0.5, 4.0), (0.9, 1.5), (-2.0, 4.0)])
def test_mix_equals_plain_loops(spark, even, repeats):
    rows = [(i, "w " * (1 + i % 7), None if i % 31 == 0 else "big" if i % 10 else "small") for i in range(2_000)]
    rows += [(i, None if i % 2 else "", "blank") for i in range(2_000, 2_020)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, even=even, repeats=repeats, blocks=64)
    assert Counter((r.doc_id, r.mix_epoch) for r in got.collect()) == plain_mix(docs, even, repeats, 64)
    some = Counter(r.doc_id for r in got.filter("source <> 'blank'").collect())
    assert set(some.values()) != {1} or len(some) < 2_000        # the target binds


def test_mix_realises_weights(spark):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else "small", "x") for i in range(3_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_epoch string")
    mix = mixing.mix(docs, entropy_share=0.9, repeats=3.0).withColumn("t", mixing.word_tokens())
    total = docs.agg(F.sum(mixing.word_tokens())).first()[0]
    for r in mix.groupBy("source").agg(F.sum("t").alias("t"), F.max("mix_weight").alias("w")).collect():
        assert abs(r.t - r.w * total) <= 0.01 * total
    uses = {(r.doc_id, r.mix_epoch): r["count"] for r in mix.groupBy("doc_id", "mix_epoch").count().collect()}
    assert set(uses.values()) == {1} and mix.columns.count("mix_epoch") == 1
    assert mix.filter("mix_position < 0 or mix_position > 1").count() == 0
    odd = mixing.mix(odd_docs(spark))
    assert {1, 2, 3, 5, 9, None} <= {r.doc_id for r in odd.collect()}  # 4 alone is longer than its budget
    assert mixing.mix(docs.limit(0)).count() == 0


def test_ngram_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF_SMALL}/documents.parquet')")
    want = con.execute(queries.ORACLE["op4_ngram_jaccard_join"]).fetchall()
    got = queries.QUERIES["op4_ngram_jaccard_join"](spark, SF_SMALL).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF_SMALL)
        before = docs.count()
        if k + 1 < len(cp.STAGES):
            assert out.columns == list(cp.COLUMNS)
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name == "secrets":
            assert docs.count() == before and docs.filter("text like '%AKIA%'").count() == 0
        elif name != "mixing":
            assert 0.5 * before < docs.count() <= before
    assert docs.count() > 0 and {"mix_epoch", "mix_position", "mix_weight"} < set(docs.columns)


def test_leaks_in_other_letter_forms(spark):
    plain = "l'eau de la ville n'est pas propre et c'est dommage pour l'avenir de nos enfants et qu'on le dise aujourd'hui"
    cyrillic = "все счастливые семьи похожи друг на друга каждая несчастливая семья несчастлива по своему и никто не спорит"
    items = spark.createDataFrame([(1, plain), (2, cyrillic), (3, "office fittings ﬁt the ﬂoor of this one house as they do elsewhere in town")],
                                  "item_id long, text string")
    rows = [(10, "x y z " + plain.replace("'", "’") + " and more"), (11, "a b " + plain.replace(" ", " ")),
            (12, cyrillic.upper() + "!"), (13, "so, office fittings fit the floor of this one house as they do elsewhere in town"),
            (14, plain.upper()), (15, "quite another text about the same town and its houses"), (16, None)]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(10, 1), (11, 1), (12, 2), (13, 3), (14, 1)}
