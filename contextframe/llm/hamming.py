"""Exact top-k search over binary codes by incremental multi-index hashing.

A code's bits are dealt to segments of whole bytes, log2(number of codes) bits or
a little more, such that each holds as much information; every segment is an
index.  Radii grow one
segment at a time: once all segments have been searched out to radius r - 1 and
the first a of them out to r, no code within distance segments * r + a - 1 is
missing.  A query ends when that covers its k-th best verified distance, and
codes beyond that distance are dropped where they are found.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from .common import discard, let_go, stored

WORD = 64
WIDEST = 24
FAR = 1 << 30
SCAN_ROWS = 1 << 16


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, embedding -> id, code: longs in whose bits, from the lowest of the first, component i is 1 where it is over 0.

    Null components count as 0; a null vector or id has no code, an empty vector
    an empty one.  Vectors of any number of components will do.
    """
    e = F.col(embedding)
    word = lambda w: F.aggregate(
        F.sequence(F.lit(0), F.least(F.lit(WORD), F.size(e) - w * WORD) - 1),
        F.lit(0).cast("long"),
        lambda acc, i: F.when(F.get(e, w * WORD + i) > 0, acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(acc),
    )
    words = F.transform(F.sequence(F.lit(0), F.floor((F.size(e) - 1) / WORD).cast("int")), word)
    code = F.when(F.size(e) == 0, F.array().cast("array<long>")).otherwise(words)
    return vectors.where(F.col(vec_id).isNotNull() & e.isNotNull()).select(F.col(vec_id).cast("long").alias("id"), code.alias("code"))


def _deal(share: list[float], segments: int) -> list[list[int]]:
    """Bits by segment; those that tell codes apart best go round first."""
    order = sorted(range(len(share)), key=lambda b: (-share[b] * (1 - share[b]), b))
    return [sorted(order[s::segments]) for s in range(segments)]


def _segments(code: str, dealt: list[list[int]]) -> Column:
    """The values of a code's segments."""
    bit = lambda b, at: f"shiftleft(int(shiftrightunsigned({code}[{b // WORD}], {b % WORD}) & 1L), {at})"
    return F.expr("array(" + ", ".join(" | ".join(bit(b, at) for at, b in enumerate(bits)) for bits in dealt) + ")")


def _flipped(rows: DataFrame, radius: int) -> DataFrame:
    """q, kth, seg, base, width -> q, kth, seg, val: all values at this distance from base, one flipped bit after the other from the lowest."""
    rows = rows.where(F.col("width") >= radius).select("q", "kth", "seg", "width", F.col("base").alias("val"), F.lit(-1).alias("top"))
    for left in range(radius, 0, -1):
        bits = F.explode(F.sequence(F.col("top") + 1, F.col("width") - left)).alias("bit")
        rows = rows.select("q", "kth", "seg", "width", "val", bits).select("q", "kth", "seg", "width", F.expr("val ^ shiftleft(1, bit)").alias("val"), F.col("bit").alias("top"))
    return rows.select("q", "kth", "seg", "val")


def _apart(segments: int, a: str = "q", b: str = "segs") -> list[Column]:
    return [F.bit_count(F.col(a)[s].bitwiseXOR(F.col(b)[s])) for s in range(segments)]


def search(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """codes (id, code), queries (query_id, code) -> query_id, rank, id, distance.

    The k nearest by Hamming distance, smaller ids first among equals; fewer
    rows only if there are fewer codes.  Equal codes are one entry of the index
    and equal queries one search.  Repeated ids are rows of their own; null ids
    and codes are left out.  A shorter code counts as filled up with zeros.
    Queries whose next radius would look into more places than there are codes
    are compared with all codes, in blocks.
    """
    codes, queries = codes.where("id is not null and code is not null"), queries.where("query_id is not null and code is not null")
    size = F.coalesce(F.max(F.size("code")), F.lit(0)).alias("longest")
    longest = max(t.agg(size).first().longest for t in (codes, queries))
    full = F.transform(F.sequence(F.lit(0), F.lit(max(longest, 1) - 1)), lambda w: F.coalesce(F.get("code", w), F.lit(0).cast("long")))
    codes, queries = codes.withColumn("code", full), queries.withColumn("code", full)
    small = Window.partitionBy("code").orderBy("id")
    ranked = codes.withColumn("nth", F.row_number().over(small)).where(F.col("nth") <= k)
    entries = stored(ranked.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))  # k ids at most
    bits = max(1, WORD * longest)
    one = [F.sum(F.shiftrightunsigned(F.col("code")[b // WORD], b % WORD).bitwiseAND(F.lit(1))) for b in range(bits)]
    many, ones = entries.agg(F.count(F.lit(1)), F.array(*one)).first()
    if not many:
        return codes.sparkSession.createDataFrame([], "query_id long, rank int, id long, distance int")
    width = min(WIDEST, bits, 8 * max(1, math.ceil(math.log2(many + 1) / 8)))
    segments = max(1, round(bits / width))
    dealt = _deal([n / many for n in ones], segments)
    width = max(map(len, dealt))
    index = stored(entries.select(_segments("code", dealt).alias("segs"), F.element_at("ids", 1).alias("first"), F.size("ids").alias("n"), "ids"))
    discard(entries)
    ids, index = index.select("segs", "ids"), index.drop("ids")
    asked = queries.select("query_id", _segments("code", dealt).alias("q"))
    pending = stored(asked.select("q").distinct().withColumn("kth", F.lit(FAR)))
    state = {"left": pending.count(), "least": None}
    found, best, place = [], None, Window.partitionBy("q").orderBy("distance", "first")
    apart = _apart(segments)
    distance = sum(apart[1:], apart[0])

    def take(got: DataFrame, covered: int) -> None:
        """Merge what was found into the best of each query; those that ``covered`` proves complete end."""
        nonlocal best, pending
        got = got.select("q", "segs", "first", "n", "distance")
        rows = got if best is None else got.union(best)
        upto = F.sum("n").over(place.rowsBetween(Window.unboundedPreceding, 0))
        top = stored(rows.withColumn("nth", F.row_number().over(place)).where(F.col("nth") <= k).withColumn("upto", upto))
        stats = top.groupBy("q").agg(F.min(F.when(F.col("upto") >= k, F.col("distance"))).alias("now"), F.count(F.lit(1)).alias("held"))
        state_of = pending.join(stats, "q", "left").select("q", F.coalesce("now", F.lit(FAR)).alias("kth"), F.coalesce("held", F.lit(0)).alias("held"))
        open_ = (F.col("kth") > covered) & (F.col("held") < many)
        told = Observation()
        pending = stored(state_of.where(open_).select("q", "kth").observe(told, F.count(F.lit(1)).alias("left"), F.min("kth").alias("least")))
        state.update(left=told.get.get("left", 0), least=told.get.get("least"))
        top = top.select("q", "segs", "first", "n", "distance")
        if state["left"]:
            found.append(top.join(pending, "q", "left_anti").select("q", "segs", "distance"))
            best = top.join(pending, "q", "left_semi")
        else:
            found.append(top.select("q", "segs", "distance"))

    def probe(radii: range, at: range) -> None:
        """Search these segments at these radii; a code is found by the segment in which it is nearest, the first of such, and once only."""
        widths = F.array(*(F.lit(len(bits)) for bits in dealt))
        if len(at) == 1:
            rows = pending.select("q", "kth", F.lit(at[0]).alias("seg"), F.col("q")[at[0]].alias("base"))
            places = index.select("*", F.lit(at[0]).alias("seg"), F.col("segs")[at[0]].alias("val"))
        else:
            rows = pending.select("q", "kth", F.posexplode("q").alias("seg", "base"))
            places = index.select("*", F.posexplode("segs").alias("seg", "val"))
        rows = rows.withColumn("width", widths[F.col("seg")])
        probes = reduce(DataFrame.union, [_flipped(rows, r) for r in radii])
        may = F.lit(False)
        for s in at:
            nearest = F.col("seg") == s
            for o in range(segments):
                nearest = nearest & (apart[o] > apart[s] if o < s else apart[o] >= apart[s])
            may = may | nearest
        # a merge join: the probes look few to Spark, as it does not count what explode() makes
        got = probes.hint("merge").join(places, ["seg", "val"]).where((distance <= F.col("kth")) & may)
        take(got.withColumn("distance", distance), segments * radii[-1] + at[-1])

    def scan() -> None:
        """The queries that are left against all codes, block by block."""
        nonlocal best
        best = None
        blocks = max(1, many // SCAN_ROWS)
        whole = index.withColumn("block", F.pmod(F.xxhash64("segs"), F.lit(blocks)))
        each = pending.select("q", "kth", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
        take(each.hint("merge").join(whole, (each.block == whole.block) & (distance <= F.col("kth"))).withColumn("distance", distance), FAR)

    radius = 0
    while state["left"] and radius <= width:
        let_go(codes.sparkSession)
        if math.comb(width, radius) > many:
            scan()
            break
        # the first two radii find little and go together; later, one segment at a time where a query may end on the way, by its k-th distance so far
        last = 1 if radius == 0 and width <= many else radius
        may_end = radius > 0 and (state["least"] or FAR) < segments * (radius + 1)
        for at in [range(s, s + 1) for s in range(segments)] if may_end else [range(segments)]:
            if state["left"]:
                probe(range(radius, last + 1), at)
        radius = last + 1
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    hits = hits.join(ids, "segs").select("q", "distance", F.explode("ids").alias("id"))
    by = Window.partitionBy("q").orderBy("distance", "id")
    hits = hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return asked.join(hits, "q").select("query_id", "rank", "id", "distance")
