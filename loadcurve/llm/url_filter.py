"""URL filter: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with a verdict.  Each rule
is filed under that of its whole literal tokens which fewest distinct URLs
contain; rules without one are filed under the empty token, which every URL
has.  A URL's tokens fetch their rules by an equality join, and only those run
their expressions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Rule:
    """``name`` is what a result shows, ``rank`` decides between rules that match (highest, then name)."""
    name: str
    pattern: str
    verdict: str
    tokens: tuple[str, ...]
    rank: int


def site_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """A rule for a host with all its subdomains and the paths that start with ``path``; longer is stronger."""
    target = f"{host}{path}"
    literal = target if path.endswith("/") else target[: target.rfind("/") + 1]  # a cut last piece is no whole token
    return Rule(target, rf"\A(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict,
                tuple(dict.fromkeys(_TOKEN.findall(literal.lower()))), 1_000 + len(target))


def word_rule(verdict: str, *words: str) -> Rule:
    """A rule for URLs that have the words one after another in one label or path piece."""
    name = "-".join(words)
    return Rule(name, rf"(?i)(?:\A|[^a-z0-9]){'[-_.]?'.join(map(re.escape, words))}(?:[^a-z0-9]|\z)", verdict,
                words if len(words) == 1 else (), len(name))


#: What the filter thinks of a URL without a rule of the caller's: words of sites that hold no prose.
DEFAULT_RULES = tuple(
    [word_rule("block", w) for w in ("porn", "xxx", "casino", "poker", "betting", "viagra", "warez", "torrent",
                                     "escort", "jackpot", "malware", "phishing")]
    + [word_rule("block", *w) for w in (("free", "bets"), ("spam", "farm"), ("link", "farm"), ("adult", "chat"),
                                        ("payday", "loans"), ("cheap", "pills"))])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without one."""
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(
        [(r.name, r.pattern, r.verdict, list(r.tokens), r.rank) for r in rules],
        "rule string, pattern string, verdict string, tokens array<string>, rank int")


def judge_urls(pages: DataFrame, rules, default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """(url, host, path, rule, verdict) of every distinct URL of ``pages``, null included.

    ``rule`` is the name of the strongest matching rule, null if none does; the
    verdict is then ``default``.  The index goes to every task only if it has at
    most ``broadcast_rules`` rows.  An empty table gives no rows.
    """
    spark = pages.sparkSession
    rules = list(rules)
    urls = pages.select(F.col("url").cast("string").alias("url")).groupBy("url").agg(F.lit(1).alias("one"))
    urls = materialize(urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    target = F.concat("host", "path")
    tokens = urls.select("url", target.alias("target"), F.explode(F.array_append(F.array_distinct(
        F.regexp_extract_all(F.lower(target), F.lit(r"[a-z0-9]+"), F.lit(0))), F.lit(""))).alias("token"))
    table = _rule_table(spark, rules)
    literal = table.select("rule", F.explode_outer("tokens").alias("token")).withColumn(
        "token", F.coalesce("token", F.lit("")))
    small = len(rules) <= broadcast_rules
    asked = literal.select("token").distinct()
    counts = tokens.join(F.broadcast(asked) if small else asked, "token").groupBy("token").agg(F.count("*").alias("n"))
    index = (literal.join(counts, "token", "left")
             .groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
             .join(table.drop("tokens"), "rule"))
    matched = (tokens.join(F.broadcast(index) if small else index, "token")
               .filter(F.rlike("target", F.col("pattern")))
               .groupBy("url").agg(F.max(F.struct("rank", "rule", "verdict")).alias("best")))
    matched = matched.withColumnRenamed("url", "known")
    return urls.join(matched, F.col("url").eqNullSafe(F.col("known")), "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules, more_rules=DEFAULT_RULES, default: str = "allow") -> DataFrame:
    """(page_id, url, host, path, rule, verdict): one row for every row of ``pages``.

    ``rules`` come first and are named in ``rule``; where none matches, the
    strongest of ``more_rules`` gives the verdict and ``rule`` is null.  A null
    URL and one without ``://`` have an empty host and path.  Equal URLs are
    judged once; other columns are not looked at.
    """
    own = {r.name for r in rules}
    judged = judge_urls(pages, [*rules, *more_rules], default)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    return rows.join(judged.withColumnRenamed("url", "known"), F.col("url").eqNullSafe(F.col("known"))).select(
        "page_id", "url", "host", "path",
        F.when(F.col("rule").isin(sorted(own)), F.col("rule")).alias("rule"), "verdict")
