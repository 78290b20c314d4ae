"""Mixing sources to target weights: temperature mixing, realised as budgeted block permutations.

A source with token share ``s`` gets the weight ``s ** alpha`` over the sum of
these.  ``alpha`` is bisected to where the weights' entropy meets a target: 1
gives the shares, 0 even weights, and above 1 large sources gain.  If a source
would then be repeated more than a limit, ``alpha`` goes towards 1 until none
is, or as far as that helps.  Each source's rows are
dealt by hash into blocks; in every epoch a source's blocks come in an order of
their own, and the last epoch stops at the block that would pass its budget.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

BLOCKS = 1024
NO_SOURCE = ""


def word_tokens(text: str = "text") -> Column:
    """Tokens as words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _weights(tokens: dict, alpha: float) -> dict:
    top = max(tokens.values())
    raw = {k: (v / top) ** alpha for k, v in tokens.items()}
    total = math.fsum(raw.values())
    return {k: v / total for k, v in raw.items()}


def _entropy(weights) -> float:
    return -math.fsum(w * math.log(w) for w in weights.values() if w > 0)


MOST_ALPHA = 64.0  # past this nearly all weight lies on the largest source


def temperature_weights(tokens: dict[str, int], entropy_share: float | None = None, even: float = 0.5,
                        budget: int | None = None, repeats: float = 4.0,
                        steps: int = 80) -> tuple[float, dict[str, float]]:
    """(alpha, weights) for token totals by source.

    The target is ``entropy_share`` of the largest possible entropy, or, if that
    is not given, ``even`` of the way from the shares' entropy to the largest
    one.  Entropy falls as ``alpha`` grows; a target that no ``alpha`` from 0 to
    ``MOST_ALPHA`` meets gives the nearer end.  If a source would be seen more
    than ``repeats`` times in ``budget`` tokens (all tokens if not given),
    ``alpha`` is bisected towards 1 to where the limit is met.  Sources without
    tokens get no weight; equal shares have the same weights at any ``alpha``.
    """
    some = {k: v for k, v in tokens.items() if v > 0}
    if not some:
        return 1.0, {k: 0.0 for k in tokens}
    budget = sum(some.values()) if budget is None else budget
    largest, own = math.log(len(some)), _entropy(_weights(some, 1.0))
    target = own + even * (largest - own) if entropy_share is None else entropy_share * largest

    def bisect(good, low, high):
        """The border of ``good`` between an end where it holds (low) and one where it does not."""
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if good(mid) else (low, mid)
        return low

    enough = lambda a: _entropy(_weights(some, a)) >= target
    within = lambda a: all(w * budget <= repeats * some[k] for k, w in _weights(some, a).items())
    if len(set(some.values())) == 1:
        alpha = 1.0
    elif not enough(0.0):
        alpha = 0.0
    else:
        alpha = MOST_ALPHA if enough(MOST_ALPHA) else bisect(enough, 0.0, MOST_ALPHA)
    if not within(alpha):
        alpha = 1.0 if not within(1.0) else bisect(within, 1.0, alpha)
    weights = _weights(some, alpha)
    return alpha, {k: weights.get(k, 0.0) for k in tokens}


def mix(docs: DataFrame, entropy_share: float | None = None, even: float = 0.5, repeats: float = 4.0,
        budget: int | None = None, seed: int = 0, source: str = "source", blocks: int = BLOCKS, most_sources: int = 100_000) -> DataFrame:
    """``docs`` with ``mix_epoch``, ``mix_position`` and ``mix_weight``; a row for each time a document is used.

    The weights are :func:`temperature_weights`.  ``budget`` is in tokens (words), all tokens of ``docs`` if not given.  A
    source's realised tokens miss its share of the budget by less than one
    block (1 / ``blocks`` of the source, or one document where that is longer).
    Ordering by ``mix_position`` (0 to 1) interleaves the sources.  A null
    source counts as one named by the empty text; documents without tokens come
    with their block; null ids are dealt like any id, and rows with the same id
    go together; a document longer than what is left of its source's budget is
    not taken.  Only token totals by source and block are gathered; their
    table is broadcast if it is of at most ``most_sources`` sources' totals, and
    the weights of at most that many sources are computed in the driver.
    Older columns with the names of the results give way.
    """
    made = ("mix_epoch", "mix_position", "mix_weight")
    names = [c for c in docs.columns if c not in made]
    frame = docs.select(*[docs[f"`{c}`"] for c in names])
    frame = frame.withColumns({
        "__source__": F.coalesce(F.col(source).cast("string"), F.lit(NO_SOURCE)),
        "__block__": F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long")), F.lit(blocks)).cast("int")})
    totals = materialize(frame.select("__source__", "__block__", word_tokens().alias("t"))
                         .groupBy("__source__", "__block__").agg(F.sum("t").alias("t")))
    by_source = totals.groupBy("__source__").agg(F.sum("t").alias("t"))
    if by_source.count() > most_sources:
        raise ValueError(f"more than {most_sources} sources: group them first or raise most_sources")
    tokens = {r["__source__"]: int(r["t"]) for r in by_source.orderBy("__source__").collect()}
    _, weights = temperature_weights(tokens, entropy_share, even, budget, repeats)
    budget = sum(tokens.values()) if budget is None else budget
    plan = totals.sparkSession.createDataFrame(
        [(k, float(w), int(tokens[k]), float(w * budget)) for k, w in weights.items()],
        "__source__ string, mix_weight double, total long, share double")
    # whole epochs take every block; the last one takes blocks in its order while they fit
    at = F.xxhash64(F.lit(seed), F.col("__source__"), F.col("epoch"), F.col("__block__"))
    rows = totals.join(F.broadcast(plan), "__source__").withColumns({
        "whole": F.when(F.col("total") > 0, F.floor(F.col("share") / F.col("total") + 1e-9)).otherwise(0).cast("int"),
    }).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole")))).withColumn("at", at)
    epoch = Window.partitionBy("__source__", "epoch")
    order = epoch.orderBy("at", "__block__").rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumns({"rank": F.count("*").over(order), "used": F.sum("t").over(order),
                               "n": F.count("*").over(epoch)})
    taken = ranked.filter((F.col("epoch") < F.col("whole"))
                          | (F.col("used") <= F.col("share") - F.col("whole") * F.col("total") + 1e-6))
    epochs = F.when(F.col("total") > 0, F.col("share") / F.col("total")).otherwise(1.0)
    position = F.least(F.lit(1.0), (F.col("epoch") + (F.col("rank") - 0.5) / F.col("n")) / epochs)
    taken = taken.select("__source__", "__block__", F.col("epoch").alias("mix_epoch"),
                         position.alias("mix_position"), "mix_weight")
    return frame.join(F.broadcast(taken) if len(tokens) <= 1_000 else taken, ["__source__", "__block__"]).select(
        *[F.col(f"`{c}`") for c in names], *made)
