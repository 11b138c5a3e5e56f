"""Mixing sources to target weights by entropy balancing, in DataFrame operations alone.

Among all document rates between 0 and ``cap`` whose tokens meet each source's
target, entropy balancing takes those nearest to 1 in relative entropy.  The
convex dual has one multiplier per source, and its solution tilts the rates
exponentially: rate = min(cap, exp(multiplier * size / mean size)).  Newton
steps on the dual need two sums per source, which Spark takes over the
histogram of (source, size), and a row per source of a table; rates are then rounded to whole copies such that
the errors of a source's sizes cancel.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Observation, Window, functions as F

from .common import discard, fresh, let_go, stored, text_or_empty

WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of words of the text, 0 for null."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size")
    )


def _numbered(facts: DataFrame) -> DataFrame:
    """The sources with their place in order of code points, null last, counted over ranges of them."""
    ranges = stored(facts.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("here")).select("part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("part").orderBy(F.col("source").isNull(), "source")
    return ranges.withColumn("at", F.row_number().over(within)).join(counts, "part").withColumn("place", F.col("before") + F.col("at") - 1).drop("part", "at", "before")


def targets(totals: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """source, total, ... -> the same with ``goal``: the sum of all totals shared by weight.

    Weights repeat along the sources by code point, null last.  No goal exceeds
    ``cap`` times its total; what is over is shared anew among the others.  Only
    four sums reach the driver each time, however many sources there are.
    """
    every = stored(_numbered(totals).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))).drop("place"))
    most = F.col("total") * cap
    left, open_, capped = 0, 0, -1
    facts = every.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("all"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")).first()
    left, open_ = facts["all"], facts.weight
    while open_:
        over = F.lit(float(left)) * F.col("weight") / F.lit(float(open_)) > most
        now = every.agg(*(F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(a) for c, v, a in ((over, most, "full"), (~over, F.col("weight"), "weight"), (over, F.lit(1), "capped")))).first()
        if now.capped == capped or not now.weight:
            open_ = now.weight
            break
        left, open_, capped = facts["all"] - now.full, now.weight, now.capped
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(open_)) if open_ else most
    return every.withColumn("goal", F.least(share, most.cast("double")).cast("double")).drop("weight")


def _multipliers(hist: DataFrame, state: DataFrame, cap: float, steps: int) -> DataFrame:
    """key, total, goal, mean -> with ``at``, the multiplier of each source.

    Newton steps on the dual of all sources at once, in the logarithm of their
    tokens, kept within a bracket.  The state of the steps is a table.
    """
    full = F.col("goal") >= F.lit(cap) * F.col("total") * (1 - 1e-12)
    inf = float("inf")
    state = state.select(
        "*",
        F.when(full, F.lit(1e9)).otherwise(F.log(F.greatest("goal", F.lit(1e-9)) / F.col("total"))).alias("at"),
        F.lit(-inf).alias("low"),
        F.lit(inf).alias("high"),
        (~full & (F.col("total") > 0)).alias("moves"),
    )
    state = stored(state)
    top = math.log(cap)
    for _ in range(steps):
        tilt = F.col("at") * F.col("size") / F.col("mean")
        tokens = F.col("n") * F.col("size") * F.exp(F.least(tilt, F.lit(top)))
        slope = F.when(tilt < top, tokens * F.col("size") / F.col("mean")).otherwise(0.0)
        # decimals: the sums do not depend on the order of rows, so reruns agree
        sums = hist.join(state.where("moves").select("key", "at", "mean"), "key").groupBy("key").agg(*(F.sum(c.cast("decimal(32,6)")).cast("double").alias(a) for c, a in ((tokens, "tokens"), (slope, "slope"))))
        low = F.when(F.col("tokens") < F.col("goal"), F.col("at")).otherwise(F.col("low"))
        high = F.when(F.col("tokens") >= F.col("goal"), F.col("at")).otherwise(F.col("high"))
        newton = F.col("at") + F.log(F.col("goal") / F.greatest("tokens", F.lit(1e-9))) * F.col("tokens") / F.when(F.col("slope") > 0, F.col("slope"))
        half = F.when(F.col("high") == inf, F.col("at") * 2 + 1).when(F.col("low") == -inf, F.col("at") * 2 - 1).otherwise((F.col("low") + F.col("high")) / 2)
        step = state.join(sums, "key", "left").withColumns({"low": F.when(F.col("moves"), low).otherwise(F.col("low")), "high": F.when(F.col("moves"), high).otherwise(F.col("high"))})
        step = step.withColumn("moves", F.col("moves") & (F.abs(F.col("tokens") - F.col("goal")) > 1e-7 * F.col("goal")))
        step = step.withColumn("at", F.when(F.col("moves"), F.when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(half)).otherwise(F.col("at")))
        told, old = Observation(), state
        state = stored(step.drop("tokens", "slope").observe(told, F.count_if("moves").alias("moving")))
        discard(old)
        if not told.get.get("moving", 0):
            break
    return state.drop("low", "high", "moves")


def mix(sized: DataFrame, weights=(5, 2, 1), cap: int = 3, steps: int = 40, repairs: int = 8, broadcast_sources: int = 50_000) -> DataFrame:
    """doc_id, source, size -> doc_id, size, source_size, target, taken, source, copies.

    ``taken`` is copies * size; copies are whole, from 0 to ``cap``.  A null
    source is a source of its own.  Documents without words are taken once and
    count nothing.  Equal documents, repeated rows included, may differ by one
    copy, which a hash of doc_id decides, so reruns agree.  An empty table gives
    no rows.  Sources stay in tables, however many there are; up to
    ``broadcast_sources`` of them are broadcast to the rows, more are joined by
    a shuffle.
    """
    sized = stored(sized.withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    totals = sized.groupBy("key", "source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("docs"), F.count_if(F.col("size") > 0).alias("filled"))
    goals = targets(totals, weights, cap).withColumn("mean", F.col("total") / F.greatest("filled", F.lit(1)))
    hist = stored(sized.where("size > 0").groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    state = _multipliers(hist, goals, float(cap), steps)
    let_go(sized.sparkSession)
    facts = state.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs")).first()
    many = facts.docs

    # whole copies for all documents of one source and size
    rate = F.exp(F.least(F.col("at") * F.col("size") / F.col("mean"), F.lit(math.log(cap))))
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    plan = hist.join(state.select("key", "at", "mean", "goal"), "key").withColumn("share", F.least(F.col("n") * rate, F.col("n") * F.lit(float(cap))))
    plan = plan.withColumn("upto", F.floor(F.sum("share").over(down.rowsBetween(Window.unboundedPreceding, 0)) + 0.5))
    plan = plan.withColumn("k", F.greatest(F.lit(0), F.least(F.col("upto") - F.coalesce(F.lag("upto").over(down), F.lit(0)), F.col("n") * cap)))
    whole = Window.partitionBy("key")
    for _ in range(repairs):  # each halves at least what is left over, or uses up a size
        plan = plan.withColumn("gap", F.round("goal").cast("long") - F.sum(F.col("k") * F.col("size")).over(whole))
        room = F.when(F.col("gap") > 0, F.col("n") * cap - F.col("k")).otherwise(F.col("k"))
        fits = (room > 0) & (F.col("size") <= F.abs("gap"))
        plan = plan.withColumn("pick", F.max(F.when(fits, F.col("size"))).over(whole))
        step = F.signum("gap").cast("long") * F.least(F.floor(F.abs("gap") / F.col("size")), room)
        plan = plan.withColumn("k", F.when(F.col("size") == F.col("pick"), F.col("k") + step).otherwise(F.col("k"))).select("key", "size", "n", "goal", "k")

    # which documents of one source and size get the odd copy: ranks over salted parts
    salts = min(max(64, many // 200_000), 1 << 16)
    salted = sized.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit("salt")), F.lit(salts)))
    parts = salted.groupBy("key", "size", "salt").agg(F.count(F.lit(1)).alias("here"))
    before = Window.partitionBy("key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0))).join(plan.drop("goal"), ["key", "size"])
    within = Window.partitionBy("key", "size", "salt").orderBy(F.xxhash64("doc_id"), "doc_id")
    ranked = salted.withColumn("rank", F.row_number().over(within)).join(parts, ["key", "size", "salt"], "left")
    sources = state.select("key", "total", "goal")
    ranked = ranked.join(F.broadcast(sources) if facts.sources <= broadcast_sources else sources, "key")
    copies = F.expr("k div n + int(rank + before <= k % n)")
    return ranked.select(
        "doc_id",
        "size",
        F.col("total").cast("long").alias("source_size"),
        F.col("goal").alias("target"),
        F.coalesce(copies * F.col("size"), F.lit(0)).cast("long").alias("taken"),
        "source",
        F.coalesce(copies, F.lit(1)).cast("int").alias("copies"),
    )


def mix_documents(docs: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    return mix(sizes(docs), weights, cap)


def repeat_by_mix(docs: DataFrame, weights=(5, 2, 1), cap: int = 3) -> DataFrame:
    """The rows, with all of their columns, each as many times as the mix takes it.

    Rows that repeat a doc_id, or have none, come as often as the one of them
    that is taken most.  Names of further columns do not matter.
    """
    names = docs.columns
    key, times, nth = fresh("mix_id", names), fresh("mix_copies", names), fresh("mix_copy", names)
    taken = mix_documents(docs, weights, cap).groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(times)).where(F.col(times) > 0)
    rows = docs.join(taken, F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1), times))).select(*(F.col(f"`{c}`") for c in names))
