"""The registered queries of the training-data operators, over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_format, decontaminate, fingerprints, html_extract, lexical_search, mixing, ngram_join, quality,
               secret_scan, source_divergence, substring_dedup, toxicity, url_filter)
from .labelled import id_remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark, sf_dir):
    """Fingerprints of each text and its edited text, and their likenesses."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def _judged(scored, mod, held, threshold, *more):
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(id_remainder(mod) == held, F.lit(False)).alias("held_out"),
        "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *more)


def op2_quality_classifier(spark, sf_dir):
    """Quality scores; labels of ids whose crc32 modulo 5 is 0 are never learned from."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    return _judged(quality.score_quality(docs.select("doc_id", "text", "n_chars"), model), 5, 0, 0.3)


def op3_html_extraction(spark, sf_dir):
    """The main text of every page."""
    return html_extract.extract_text(_table(spark, sf_dir, "pages"))


def op4_ngram_jaccard_join(spark, sf_dir):
    """Components of documents whose 3-word shingle sets overlap by 90 % or more."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), ngram=3, num=90, den=100)


def op5_toxicity(spark, sf_dir):
    """Toxicity scores; labels of ids whose crc32 modulo 3 is 1 are never learned from."""
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.fit_lexicon(docs, _table(spark, sf_dir, "labels"))
    return _judged(toxicity.score_toxicity(docs.select("doc_id", "text"), lexicon), 3, 1, 0.7, "n_hits")


#: The rules of the registered query: (verdict, host, path).
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op6_url_filters(spark, sf_dir):
    """The verdict on every page's URL."""
    rules = [url_filter.site_rule(*r) for r in URL_RULES]
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), rules).select(
        "page_id", "host", "path", "rule", "verdict")


def op7_secret_scans(spark, sf_dir):
    """Counts, digest and spans of the secrets in every text."""
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_chat_formatting(spark, sf_dir):
    """What is read back from the formatted conversations, and from one that quotes control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.createDataFrame([(-7, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))],
                                    rows.schema)
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(quoting)))


def op9_benchmark_decontamination(spark, sf_dir):
    """Documents that hold a benchmark item, with the item, its likeness and its place."""
    return decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_mixing(spark, sf_dir):
    """Uses of each document in the tempered mix of sources."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "mix_epoch", "mix_position", "mix_weight")


def op11_source_divergence(spark, sf_dir):
    """Divergence of each source from its language's others, and the terms it has above its language's share."""
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    """The 50 highest-scoring documents of every benchmark item."""
    return lexical_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark, sf_dir):
    """Every document without the 50-word windows that also start under a smaller id."""
    return substring_dedup.digest(substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_html_extraction": op3_html_extraction,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_toxicity": op5_toxicity,
    "op6_url_filters": op6_url_filters,
    "op7_secret_scans": op7_secret_scans,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_mixing": op10_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_lexical_search": op12_lexical_search,
    "op13_substring_dedup": op13_substring_dedup,
}

#: All distinct 3-word shingles, their common counts by an equality join, then reachability.
_OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3
           THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])
           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g)
      WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
      WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""

#: Every window of 50 words by its digest, and the smallest id that it starts under.
_OP13 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM d WHERE len(ws) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM s),
f AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h),
b AS (SELECT doc_id, i FROM h JOIN f USING (h) WHERE lo < doc_id),
w AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM d),
c AS (SELECT w.doc_id, w.i, word, count(b.i) OVER (PARTITION BY w.doc_id ORDER BY w.i
             ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS gone
      FROM w LEFT JOIN b ON b.doc_id = w.doc_id AND b.i = w.i),
k AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed,
        sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLE = {
    "op4_ngram_jaccard_join": _OP4,
    "op11_source_divergence": source_divergence.ORACLE_SQL,
    "op12_lexical_search": lexical_search.ORACLE_SQL,
    "op13_substring_dedup": _OP13,
}
