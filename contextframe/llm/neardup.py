"""Near duplicates by MinHash with tensored banding.

Two collections of ``bands`` half-keys, each of ``rows`` minhashes, are
computed per document; the key of table (i, j) joins half-key i of the first
collection with half-key j of the second.  bands**2 tables of 2*rows minhashes
thus cost 2*bands*rows minhashes instead of 2*rows*bands**2.  A pair of
similarity s is missed when it shares no half-key of one collection:
2 * (1 - s**rows) ** bands at most, 7e-5 at s = 0.8 with the defaults.
Candidates are confirmed on the full shingle sets.
"""

from __future__ import annotations

import math
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import tokens as tk
from .common import discard, fresh, let_go, stored, text_or_empty, tidy
from .graph import components

SIG_BITS = 6
SIG_PER_LONG = 10
BROADCAST_PAIRS = 500_000  # of two longs each
BROADCAST_IDS = 3_000_000  # of a long each


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct ``width``-word shingles of one document; the whole sequence when it is shorter."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    if len(hashes) < width:
        return tk.runs(hashes, len(hashes))
    return np.unique(tk.runs(hashes, width))


def _set_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each shingle; their sums tell equal sets."""
    return tk.mix(x), tk.mix(x ^ np.uint64(0x5851F42D4C957F2D))


def _params(count: int, seed: int = 7):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype=np.uint64)


def _features(width: int, bands: int, rows: int):
    count = 2 * bands * rows
    multiply, flip = _params(count)
    longs = -(-count // SIG_PER_LONG)

    @tidy
    def run(batches):
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            n = batch.num_rows
            size = np.zeros(n, np.int64)
            ident = np.zeros((2, n), np.uint64)
            least = np.zeros((count, n), np.uint64)
            for lo, hi in tk.blocks(bounds):
                h, first, _, _ = tk.words_block(data, bounds, lo, hi, lower=True)
                sets = [shingles(h[first[k] : first[k + 1]], width) for k in range(hi - lo)]
                full = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
                if not len(full):
                    continue
                x = np.concatenate([sets[k] for k in full])
                lens = np.array([len(sets[k]) for k in full])
                starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
                at = full + lo
                size[at] = lens
                ident[:, at] = [np.add.reduceat(k, starts) for k in _set_keys(x)]
                for k in range(count):
                    least[k, at] = np.minimum.reduceat((x ^ flip[k]) * multiply[k], starts)
            least = tk.mix(least)
            sig = np.zeros((longs, n), np.uint64)
            for k in range(count):
                sig[k // SIG_PER_LONG] |= (least[k] >> np.uint64(64 - SIG_BITS)) << np.uint64(SIG_BITS * (k % SIG_PER_LONG))
            half = np.zeros((2 * bands, n), np.uint64)
            for b in range(2 * bands):
                for r in range(rows):
                    half[b] = tk.mix(half[b] * np.uint64(0x9E3779B97F4A7C15) + least[b * rows + r] + np.uint64(b + 1))
            lists = [
                pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * m, m, dtype=np.int32)), pa.array(np.ascontiguousarray(v.T).reshape(-1).view(np.int64)))
                for m, v in ((longs, sig), (bands, half[:bands]), (bands, half[bands:]))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(ident[0].view(np.int64)), pa.array(ident[1].view(np.int64)), *lists],
                names=["doc_id", "n_shingles", "set_a", "set_b", "sig", "half_a", "half_b"],
            )

    return run


def _sets(width: int):
    """doc_id, text -> the set's two keys and its shingles."""

    @tidy
    def run(batches):
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            for lo, hi in tk.blocks(bounds):
                h, first, _, _ = tk.words_block(data, bounds, lo, hi, lower=True)
                sets = [shingles(h[first[k] : first[k + 1]], width) for k in range(hi - lo)]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                every = np.concatenate(sets)
                keys = [np.concatenate([k, np.zeros(1, np.uint64)]) for k in _set_keys(every)]
                keys = [np.where(np.diff(offsets) > 0, np.add.reduceat(k, offsets[:-1]), 0).astype(np.uint64).view(np.int64) for k in keys]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *map(pa.array, keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(every.view(np.int64)))],
                    names=["rep", "set_a", "set_b", "shingles"],
                )

    return run


def _close_enough(a: str, b: str, count: int, threshold: float):
    """A cheap test that pairs of similarity ``threshold`` pass but for one in a hundred thousand.

    Sizes must allow the similarity, and few signature bits may differ.
    """
    sizes = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    longs = -(-count // SIG_PER_LONG)
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.sig")[k].bitwiseXOR(F.col(f"{b}.sig")[k])) for k in range(longs)])
    return (F.least(*sizes) >= threshold * F.greatest(*sizes)) & (apart <= _most_apart(count, threshold))


def _most_apart(count: int, threshold: float, miss: float = 1e-5) -> int:
    """The least number of signature bits that a pair of similarity ``threshold`` exceeds with probability ``miss`` or less."""
    far = np.zeros(count * SIG_BITS + 1)
    for m in range(count + 1):
        share = comb(count, m) * (1 - threshold) ** m * threshold ** (count - m)
        bits = SIG_BITS * m
        far[: bits + 1] += share * np.array([comb(bits, t) / 2**bits for t in range(bits + 1)])
    return int(np.flatnonzero(1 - np.cumsum(far) <= miss)[0])


class _Work:
    """The classes of one table of documents and what their comparison needs."""

    def __init__(self, width: int, threshold: float, bands: int, rows: int):
        self.width, self.bands, self.rows, self.count = width, bands, rows, 2 * bands * rows
        self.threshold, self.percent = threshold, round(100 * threshold)

    def load(self, source: DataFrame) -> None:
        bands = self.bands
        self.feats = stored(
            source.mapInArrow(
                _features(self.width, bands, self.rows),
                "doc_id long, n_shingles long, set_a long, set_b long, sig array<long>, half_a array<long>, half_b array<long>",
            )
        )
        classes = stored(
            self.feats.where("n_shingles > 0 and doc_id is not null")
            .groupBy("set_a", "set_b")
            .agg(F.min(F.struct("doc_id", "n_shingles", "sig", "half_a", "half_b")).alias("m"))
            .select("set_a", "set_b", F.col("m.doc_id").alias("rep"), "m.n_shingles", "m.sig", "m.half_a", "m.half_b")
        )
        # cid names a class: its smallest document, or a number where documents with other sets repeat that id
        if classes.groupBy("rep").count().where("count > 1").isEmpty():
            self.classes = classes.withColumn("cid", F.col("rep"))
        else:
            self.classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()))
        pairs_of_keys = F.flatten(
            F.transform("half_a", lambda a, i: F.transform("half_b", lambda b, j: F.xxhash64(a, b, i * F.lit(bands) + j)))
        )
        keyed = self.classes.select("cid", F.explode(pairs_of_keys).alias("key"))
        lead = keyed.groupBy("key").agg(F.min("cid").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1")
        self.member = stored(keyed.join(lead, "key"))
        busy = stored(self.member.select("cid").distinct())
        few = busy.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        side = F.broadcast if few else lambda ids: ids  # else texts and classes are shuffled by id
        self.light = stored(self.classes.join(side(busy), "cid", "left_semi").select("cid", "set_a", "set_b", "rep", "n_shingles", "sig"))
        texts = source.join(side(self.light.select(F.col("rep").alias("doc_id")).distinct()), "doc_id", "left_semi")
        sets = texts.mapInArrow(_sets(self.width), "rep long, set_a long, set_b long, shingles array<long>")
        key = ["set_a", "set_b", "rep"]
        found = sets.join(self.light.select(*key, "cid", "n_shingles"), key).groupBy(*key, "cid").agg(F.first("n_shingles").alias("n"), F.first("shingles").alias("shingles"))
        self.sets = stored(found.select("cid", "n", "shingles"))
        discard(busy)

    def stars(self) -> DataFrame:
        """src, dst: each bucket's first class with its others, where sizes and signatures allow a link."""
        pairs = self.member.where("cid <> lead").select(F.col("lead").alias("src"), F.col("cid").alias("dst")).distinct()
        a, b = (self.light.select(F.col("cid"), "n_shingles", "sig").alias(n) for n in "ab")
        pairs = pairs.join(a, F.col("src") == F.col("a.cid")).join(b, (F.col("dst") == F.col("b.cid")) & _close_enough("a", "b", self.count, self.threshold))
        return pairs.select("src", "dst")

    def left_apart(self, labels: DataFrame) -> DataFrame:
        """cid, label of the classes in buckets whose members, without the first, hold several labels: stars() has not compared these."""
        rows = self.member.where("members > 2 and cid <> lead").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
        rows = rows.select("key", "cid", F.coalesce("label", "cid").alias("label"))
        mixed = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        return stored(rows.join(mixed, "key", "left_semi").select("cid", "label").distinct())

    def by_prefix(self, apart: DataFrame) -> DataFrame:
        """src, dst: all pairs of classes under different labels that can be similar enough; exact, and without the buckets.

        Shingles are ordered by how many of these classes hold them, rarest
        first.  A pair with the similarity shares one that is early in both sets:
        so early that what follows can still hold all that they must have in
        common.  In the smaller set that is about its first (1 - t) / (1 + t), in
        the larger its first 1 - t.
        """
        t = self.percent
        each = self.sets.join(apart, "cid").select("cid", F.explode("shingles").alias("shingle"))
        common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
        early = F.expr(f"n - (n * {t} + 99) div 100 + 1")  # entries of a set of which a similar one holds at least one
        ordered = (
            each.join(common, "shingle")
            .groupBy("cid")
            .agg(F.array_sort(F.collect_list(F.struct("held", "shingle"))).alias("order"))
            .join(apart.join(self.light.select("cid", F.col("n_shingles").alias("n")), "cid"), "cid")
            .withColumn("alone", F.col("n") - F.size("order"))  # shingles of no other class come first
            .select("cid", "n", "label", "alone", F.posexplode(F.slice("order", 1, F.greatest(F.lit(0), early - F.col("alone")).cast("int"))).alias("at", "entry"))
            .select("cid", "n", "label", F.col("entry.shingle").alias("shingle"), (F.col("n") - F.col("alone") - F.col("at")).alias("rest"))
        )
        ordered = stored(ordered)
        band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / t) + 1e-9)
        large = ordered.select("shingle", band.alias("band"), *(F.col(c).alias(f"{c}_x") for c in ("cid", "n", "label", "rest")))
        small = ordered.where(F.expr(f"rest * {100 + t} >= 2 * n * {t}")).withColumn("band", F.explode(F.array(band, band + 1)))
        small = small.select("shingle", "band", *(F.col(c).alias(f"{c}_y") for c in ("cid", "n", "label", "rest")))
        may = (
            f"label_x <> label_y and (n_y < n_x or n_y = n_x and cid_y < cid_x) and n_y * 100 >= n_x * {t} and least(rest_x, rest_y) * {100 + t} >= (n_x + n_y) * {t}"
        )
        pairs = large.join(small, (large.shingle == small.shingle) & (large.band == small.band) & F.expr(may))
        return pairs.select(F.col("cid_y").alias("src"), F.col("cid_x").alias("dst")).distinct()

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets are similar enough.

        Up to BROADCAST_PAIRS pairs are broadcast, so that only sets that occur in
        them are shuffled; more are joined by shuffles of all sets.
        """
        pairs = stored(pairs)
        one, two = (self.sets.select(F.col("cid").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"set_{c}")) for c in ("src", "dst"))
        if pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS:
            two = two.join(F.broadcast(pairs.select("dst").distinct()), "dst", "left_semi")
            rows = one.join(F.broadcast(pairs), "src")
        else:
            rows = pairs.join(one, "src")
        both = F.size(F.array_intersect("set_src", "set_dst")).cast("long")
        rows = rows.join(two, "dst").select("src", "dst", both.alias("both"), (F.col("n_src") + F.col("n_dst")).alias("total"))
        found = stored(rows.where(F.col("both") * (100 + self.percent) >= F.col("total") * self.percent).select("src", "dst"))
        discard(pairs)
        return found


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, bands: int = 10, rows: int = 2) -> DataFrame:
    """(doc_id, text) -> doc_id, n_shingles, component_id, kept.

    Documents whose sets of ``width``-word shingles have a Jaccard similarity of
    ``threshold`` (whole per cents) or more are linked; component_id is the
    smallest doc_id that links reach, and one document of each component is kept.

    Null or wordless texts have an empty set and are linked with nothing.
    Repeated rows give a row each; rows that share a doc_id but not a text are
    documents of their own.  A null doc_id takes the component of its copies
    that have one, else null, and is kept only then.  Ties, very long texts,
    empty tables and further columns need no care.

    Equal sets are one class, so copies never meet as pairs.  In each bucket of
    the tables the first class is compared with the others.  Classes in buckets
    of three and more that links leave apart are compared by the early shingles
    they share, which loses no pair.  No bucket is capped.
    """
    work = _Work(width, threshold, bands, rows)
    work.load(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    let_go(docs.sparkSession)
    links = work.confirmed(work.stars())
    labels = components(links)
    apart = work.left_apart(labels)
    discard(work.member)
    let_go(docs.sparkSession)
    more = work.confirmed(work.by_prefix(apart))
    if not more.isEmpty():
        labels = components(links.union(more))
    discard(work.sets, work.light, apart, links, more)
    let_go(docs.sparkSession)
    of_class = work.classes.select("cid", "set_a", "set_b", "rep").join(labels.withColumnRenamed("node", "cid"), "cid", "left")
    of_class = of_class.withColumn("label", F.coalesce("label", "cid"))
    least = of_class.groupBy("label").agg(F.min("rep").alias("least"))
    of_class = of_class.join(least, "label").select("set_a", "set_b", "least")
    out = work.feats.select("doc_id", "n_shingles", "set_a", "set_b").join(of_class, ["set_a", "set_b"], "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def first_of_each(docs: DataFrame, width: int = 5, threshold: float = 0.8, broadcast_ids: int = 1_000_000) -> DataFrame:
    """The rows, with all of their columns, of the smallest doc_id of each component.

    Rows with a null doc_id stay.  Of rows that repeat a doc_id to keep, the one
    with the smallest text stays.  The ids to keep are broadcast up to
    ``broadcast_ids`` of them and joined by a shuffle beyond that.
    """
    kept = stored(near_duplicates(docs, width, threshold).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("times")))
    facts = kept.agg(F.count(F.lit(1)).alias("ids"), F.max("times").alias("most")).first()
    key = fresh("kept_id", docs.columns)
    ids = kept.select(F.col("doc_id").alias(key))
    out = docs.join(F.broadcast(ids) if facts.ids <= broadcast_ids else ids, F.col("doc_id") == F.col(key), "left_semi")
    if (facts.most or 0) > 1:
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        out = out.groupBy(F.col("doc_id").alias(key)).agg(F.min_by(row, F.struct(text_or_empty(), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))).alias("kept_row")).select("kept_row.*")
    return out.union(docs.where("doc_id is null"))
