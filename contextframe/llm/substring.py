"""Substring dedup: an FM-index per shard, searched backwards for long repeats.

A window is ``width`` consecutive words.  Every window belongs to the least
hash among its ``anchor``-word groups, so equal windows meet under equal
anchors wherever they stand.  Consecutive windows of one anchor form a run of
at most 2 * width - anchor words.  Runs under an anchor that two documents share
(a bitmap of bounded size says so while texts are read) are dealt to shards by
anchor; each shard indexes its distinct runs, searches all of their windows
backwards over the wavelet matrix, and reports for each the smallest document
that holds it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegralType

from . import tokens as tk
from .common import fresh, let_go, stored, text_or_empty, tidy

SHARD_WORDS = 1 << 20
SEARCHED = 200_000
RUN_BYTES = 8 << 20
HOT_RUNS = 4096
BROADCAST_IDS = 1_000_000
BLOCK_BITS = 20
MOST_BITS = 29


class WaveletMatrix:
    """Ranks of symbols in a sequence, as one bit vector with a count per 64 bits for each binary digit: 1.5 bits to a digit."""

    def __init__(self, seq: np.ndarray, digits: int):
        self.n, self.digits, self.levels = len(seq), digits, []
        cur = seq
        for d in range(digits - 1, -1, -1):
            bit = ((cur >> d) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, bool)]), bitorder="little").view(np.uint64)
            ones = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)]).astype(np.int32)
            zeros = self.n - int(bit.sum())
            self.levels.append((d, packed, ones, zeros))
            cur = np.concatenate([cur[~bit], cur[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place; ``start`` is where its block begins on the last level."""
        for d, packed, ones, zeros in self.levels:
            word = at >> 6
            upto = ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> d) & 1, zeros + upto, at - upto)
        return at - start[symbol]

    def starts(self, symbols: int) -> np.ndarray:
        """Where each symbol's block begins after the last level."""
        s, at = np.arange(symbols), np.zeros(symbols, np.int64)
        for d, packed, ones, zeros in self.levels:
            word = at >> 6
            upto = ones[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((s >> d) & 1, zeros + upto, at - upto)
        return at


class FMIndex:
    """Index of integer sequences for patterns of up to ``depth`` symbols.

    Suffixes are sorted by their first power of two over ``depth`` symbols,
    which is as far as backward search of such patterns looks.
    """

    def __init__(self, text: np.ndarray, depth: int):
        """``text``: symbols from 1; 0 is a separator that no pattern holds."""
        self.alphabet, coded = np.unique(np.append(text, 0), return_inverse=True)  # the last suffix is a separator
        coded = coded.astype(np.int64)
        n = len(coded)
        self.coded, rank, span = coded, coded, 1
        order = np.argsort(rank, kind="stable")
        while span <= depth:
            key = rank * (n + 2)
            key[: n - span] += rank[span:] + 1
            order = np.argsort(key, kind="stable")
            step = key[order]
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(step[1:] != step[:-1])])
            rank, span = new, span * 2
        self.coded, self.order = coded.astype(np.int32), order.astype(np.int32)  # a shard has far fewer words than 2**31
        symbols = len(self.alphabet)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(coded, minlength=symbols))])
        before = coded[order - 1]
        before[order == 0] = 0
        self.wavelet = WaveletMatrix(before, max(1, int(symbols - 1).bit_length()))
        self.start = self.wavelet.starts(symbols)

    def search(self, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the text's own patterns that begin at ``at``."""
        symbol = self.coded[at + length - 1]
        low, high = self.first[symbol], self.first[symbol + 1]
        for k in range(length - 2, -1, -1):
            symbol = self.coded[at + k]
            low = self.first[symbol] + self.wavelet.rank(symbol, low, self.start)
            high = self.first[symbol] + self.wavelet.rank(symbol, high, self.start)
        return low, high

    def encode(self, seq: np.ndarray) -> np.ndarray:
        """Symbols of another sequence; -1 where the text has none."""
        k = np.minimum(np.searchsorted(self.alphabet, seq), len(self.alphabet) - 1)
        return np.where((self.alphabet[k] == seq) & (seq != 0), k, -1)

    def matching(self, seq: np.ndarray, threshold: int) -> np.ndarray:
        """Thresholded matching statistics of another sequence: where a pattern of ``threshold`` symbols that the text holds begins."""
        codes = self.encode(seq)
        m = len(codes) - threshold + 1
        if m <= 0:
            return np.zeros(0, bool)
        low, high = np.zeros(m, np.int64), np.full(m, len(self.coded))
        for k in range(threshold - 1, -1, -1):
            symbol = codes[k : k + m]
            known = np.maximum(symbol, 0)
            low = self.first[known] + self.wavelet.rank(known, low, self.start)
            high = np.where(symbol < 0, low, self.first[known] + self.wavelet.rank(known, high, self.start))
        return high > low


class Filter:
    """Which anchors two rows share: a bitmap over the leading bits of their hashes, and the hot ones among them."""

    def __init__(self, bits: int, blocks: dict[int, bytes], hot: np.ndarray):
        self.shift = np.uint64(64 - bits)
        self.map = np.zeros(1 << max(bits - 3, 0), np.uint8)
        for k, raw in blocks.items():
            at = k << (BLOCK_BITS - 3)
            self.map[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
        self.hot = hot

    def __call__(self, anchors: np.ndarray) -> np.ndarray:
        at = anchors >> self.shift
        return (self.map[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _find_runs(h, first, width, anchor):
    """(anchor, row, first window, end) of each run; ``h`` has the words of all rows, ``first`` where each row's begin."""
    n = len(h) - width + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return np.zeros(0, np.uint64), none, none, none
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    groups = tk.runs(h, anchor)
    place = np.arange(n) + np.lib.stride_tricks.sliding_window_view(groups, width - anchor + 1)[:n].argmin(1)
    valid = row[:n] == row[width - 1 :]
    starts = np.ones(n, bool)
    starts[1:] = (place[1:] != place[:-1]) | (row[1:n] != row[: n - 1]) | ~valid[:-1]
    a = np.flatnonzero(starts & valid)
    edge = np.flatnonzero(np.concatenate([starts | ~valid, [True]]))
    # least hashes are small ones: mixed once more, they are even again
    return tk.mix(groups[place[a]]), row[a], a, edge[np.searchsorted(edge, a, side="right")]


def _anchors(width: int, anchor: int):
    """doc_id, text -> the distinct anchors of each row."""

    @tidy
    def run(batches):
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            for lo, hi in tk.blocks(bounds):
                h, first, _, _ = tk.words_block(data, bounds, lo, hi)
                key, row, _, _ = _find_runs(h, first, width, anchor)
                order = np.lexsort((key, row))
                key, row = key[order], row[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64))], names=["anchor"])

    return run


RUNS = "anchor long, route long, whole long, doc_id long, row long, last_doc long, start int, words binary"
WORD_BYTES = 6  # of each word's hash that a shard compares


def _shared_runs(width: int, anchor: int, wanted, contents: bool):
    """doc_id, text, row -> runs whose anchor passes the filter, hot ones window by window.

    With ``contents`` each distinct run of a block comes once, with its words (48
    bits of each one's hash), its smallest and its largest document; else every
    one comes with its place and no words.
    """
    schema = pa.schema([(n, pa.int64()) for n in ("anchor", "route", "whole", "doc_id", "row", "last_doc")] + [("start", pa.int32()), ("words", pa.binary())])

    @tidy
    def run(batches):
        keep = wanted.value
        for batch in batches:
            ids = batch.column(0).to_numpy().astype(np.int64)
            rows = batch.column(2).to_numpy().astype(np.int64)
            data, bounds = tk.utf8(batch.column(1))
            for lo, hi in tk.blocks(bounds, RUN_BYTES):
                h, first = tk.words(data, bounds[lo : hi + 1])
                key, row, a, b = _find_runs(h, first, width, anchor)
                some = np.flatnonzero(keep(key))
                key, row, a, b = key[some], row[some], a[some], b[some]
                if not len(a):
                    continue
                route = key
                if len(keep.hot) and (hot := np.isin(key, keep.hot)).any():
                    each = np.where(hot, b - a, 1)
                    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                    single = np.repeat(hot, each)
                    key, row, a, b = (np.repeat(x, each) for x in (key, row, a, b))
                    a = a + step
                    b = np.where(single, a + 1, b)
                    route = key.copy()
                    route[single] = tk.runs(h, width)[a[single]]
                sums = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * tk._power("up", len(h))[: len(h)], out=sums[1:])
                whole = tk.mix((sums[b + width - 1] - sums[a]) * tk._power("down", len(h))[a] + (b - a).astype(np.uint64))
                doc, own = ids[lo + row], rows[lo + row]
                last, start = doc, (a - first[row]).astype(np.int32)
                if contents:
                    order = np.lexsort((doc, whole))
                    new = np.flatnonzero(np.concatenate([[True], whole[order][1:] != whole[order][:-1]]))
                    last = np.maximum.reduceat(doc[order], new)
                    pick = order[new]
                    key, route, whole, doc, own, start, a, b = (x[pick] for x in (key, route, whole, doc, own, start, a, b))
                    size = b - a + width - 1
                    ends = np.cumsum(size)
                    take = np.arange(ends[-1]) + np.repeat(a - (ends - size), size)
                    raw = np.ascontiguousarray(h[take].astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - WORD_BYTES :])
                    offsets = (np.concatenate([[0], ends]) * WORD_BYTES).astype(np.int32)
                    held = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                else:
                    held = pa.nulls(len(a), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (key, route, whole)), pa.array(doc), pa.array(own), pa.array(last), pa.array(start), held], schema=schema)

    return run


def _search(width: int):
    """All rows of a partition are one shard -> whole, smallest: by window the least document that holds it.

    Runs that no other document can lose a word by are left out.
    """

    @tidy
    def run(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        shard = pa.Table.from_batches(parts).combine_chunks()
        whole, docs, last = (shard.column(c).to_numpy() for c in ("whole", "doc_id", "last_doc"))
        raw, bounds = tk.utf8(shard.column("words"))
        begin = int(bounds[0])
        offsets = (bounds - begin) // WORD_BYTES
        symbols = np.zeros((int(offsets[-1]), 8), np.uint8)
        symbols[:, :WORD_BYTES] = raw[begin : int(bounds[-1])].reshape(-1, WORD_BYTES)
        symbols = symbols.view("<u8").ravel().astype(np.int64)
        order = np.lexsort((docs, whole))
        new = np.flatnonzero(np.concatenate([[True], whole[order][1:] != whole[order][:-1]]))
        last = np.maximum.reduceat(last[order], new)
        pick = order[new]
        whole, docs, begin, sizes = whole[pick], docs[pick], offsets[pick], (offsets[1:] - offsets[:-1])[pick]
        ends = np.cumsum(sizes)
        text = np.zeros(ends[-1] + len(sizes), np.int64)
        into = np.arange(ends[-1]) + np.repeat(np.arange(len(sizes)), sizes)
        text[into] = symbols[np.arange(ends[-1]) + np.repeat(begin - (ends - sizes), sizes)] + 1
        begin = ends - sizes + np.arange(len(sizes))
        index = FMIndex(text, width)
        windows = sizes - width + 1
        ends = np.cumsum(windows)
        at = np.arange(ends[-1]) - np.repeat(ends - windows, windows) + np.repeat(begin, windows)
        holder = np.append(np.repeat(docs, sizes + 1), np.iinfo(np.int64).max)[index.order]
        low, high = (np.concatenate(x) for x in zip(*(index.search(at[k : k + SEARCHED], width) for k in range(0, len(at), SEARCHED)), strict=True))
        lows, which = np.unique(low, return_inverse=True)
        highs = np.zeros(len(lows), np.int64)
        highs[which] = high
        cuts = np.stack([lows, highs], 1).ravel()
        least = np.minimum.reduceat(np.append(holder, np.iinfo(np.int64).max), cuts)[::2][which]
        useful = np.flatnonzero(np.minimum.reduceat(least, ends - windows) < last)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(least)).take(pa.array(useful))
        out = pa.RecordBatch.from_arrays([pa.array(whole[useful]), lists], names=["whole", "smallest"])
        for k in range(0, out.num_rows, 50_000):
            yield out.slice(k, 50_000)

    return run


def _bitmap(frame):
    bits = np.zeros(1 << BLOCK_BITS, np.uint8)
    bits[frame["bit"].to_numpy()] = 1
    return pd.DataFrame({"block": [int(frame["block"].iloc[0])], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


def _filter(shared: DataFrame, count: int, hot: DataFrame) -> Filter:
    """A bitmap of 64 bits to an anchor and MOST_BITS in all; blocks of it are filled on the executors."""
    bits = min(MOST_BITS, max(BLOCK_BITS, int(64 * count).bit_length()))
    at = F.shiftrightunsigned("anchor", 64 - bits)
    placed = shared.select(F.shiftright(at, BLOCK_BITS).alias("block"), at.bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("bit"))
    blocks = {r.block: bytes(r.bits) for r in placed.groupBy("block").applyInPandas(_bitmap, "block long, bits binary").collect()}
    return Filter(bits, blocks, np.sort(np.array([r.anchor for r in hot.collect()], np.int64).view(np.uint64)))


def repeats(source: DataFrame, width: int, anchor: int) -> DataFrame:
    """doc_id, text, row -> doc_id, row, hits: the word positions where windows begin that a smaller doc_id holds as well.

    ``row`` tells the texts of a repeated doc_id apart.
    """
    source = source.where("doc_id is not null")
    spark = source.sparkSession
    counted = source.mapInArrow(_anchors(width, anchor), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(counted)
    facts = shared.agg(F.count(F.lit(1)).alias("anchors"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    hot = max(HOT_RUNS, facts.rows >> 20)  # so there are at most a million hot anchors
    wanted = spark.sparkContext.broadcast(_filter(shared.select("anchor"), facts.anchors, shared.where(F.col("n") > hot).select("anchor")))
    exact = facts.anchors > 1 << (MOST_BITS - 4)  # the bitmap lets too many others pass

    def runs(contents: bool) -> DataFrame:
        rows = source.mapInArrow(_shared_runs(width, anchor, wanted, contents), RUNS)
        return rows.join(shared.select("anchor"), "anchor", "left_semi") if exact else rows

    shards = max(1, -(-int(facts.rows) * (2 * width - anchor) // SHARD_WORDS))
    found = runs(True).select("route", "whole", "doc_id", "last_doc", "words").repartition(shards, "route").mapInArrow(_search(width), "whole long, smallest array<long>")
    found = stored(found)
    let_go(spark)
    starts = F.transform("smallest", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i))
    hits = runs(False).select("whole", "doc_id", "row", "start").join(found, "whole").select("doc_id", "row", F.filter(starts, lambda x: x.isNotNull()).alias("hits")).where(F.size("hits") > 0)
    return hits.groupBy("doc_id", "row").agg(F.flatten(F.collect_list("hits")).alias("hits"))


def _kept(width: int, with_text: bool):
    """doc_id, text[, hits or null] -> doc_id, n_words, n_removed, kept_sha256 or the kept text."""

    @tidy
    def run(batches):
        for batch in batches:
            data, bounds = tk.utf8(batch.column(1))
            hits = batch.column(2) if batch.num_columns > 2 else None
            total, gone, out = [], [], []
            for lo, hi in tk.blocks(bounds):
                _, first, s, e = tk.words_block(data, bounds, lo, hi)
                for k in range(lo, hi):
                    a, b = int(first[k - lo]), int(first[k - lo + 1])
                    row = data[bounds[k] : bounds[k + 1]].tobytes()
                    found = hits[k].values if hits is not None else None
                    if found is not None and len(found):
                        cover = np.zeros(b - a + 1, np.int64)
                        at = np.unique(found.to_numpy())
                        cover[at] += 1
                        np.subtract.at(cover, np.minimum(at + width, b - a), 1)
                        keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0) + a
                        kept = b" ".join([row[x:y] for x, y in zip((s[keep] - bounds[k]).tolist(), (e[keep] - bounds[k]).tolist(), strict=True)])
                        left = len(keep)
                    else:
                        kept, left = b" ".join(row.split()), b - a
                    total.append(b - a)
                    gone.append(b - a - left)
                    out.append(kept.decode() if with_text else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"]
            )

    return run


def remove_repeats(docs: DataFrame, width: int = 13, anchor: int = 5, with_text: bool = False) -> DataFrame:
    """(doc_id, text) -> doc_id, n_words, n_removed, kept: a hash of the kept words joined by one space, or that text.

    A word goes when a window of ``width`` words covers it whose words also
    begin somewhere in a document with a smaller doc_id; all windows are judged
    on the input.  Null and wordless texts keep nothing and lose nothing.
    Repeats within one document stay.  Rows that repeat a doc_id count as one
    document and give a row each; rows with a null doc_id come back whole and
    count for no other.  Other columns are ignored.
    """
    text = text_or_empty()
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    hits, ids, few = _hits(source, width, anchor)
    schema = "doc_id long, n_words long, n_removed long, kept string"
    side = F.broadcast(ids) if few else ids
    some = source.join(side, "doc_id", "left_semi").join(hits, ["doc_id", "row"], "left").select("doc_id", "text", "hits").mapInArrow(_kept(width, with_text), schema)
    none = source.join(side, "doc_id", "left_anti").select("doc_id", "text")
    return some.union(none.mapInArrow(_kept(width, with_text), schema))


def _hits(source: DataFrame, width: int, anchor: int) -> tuple[DataFrame, DataFrame, bool]:
    """repeats() in a table, the doc_ids it holds, and whether they are few enough to be broadcast."""
    hits = stored(repeats(source, width, anchor))
    ids = hits.select("doc_id").distinct()
    return hits, ids, ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS


def _strip(width: int, text_at: int, chars_at: int | None, names: list[str]):
    """The columns of a table, then doc_id as a long and hits -> the columns, their texts and lengths rewritten where there are hits."""
    rewrite = _kept(width, True)

    @tidy
    def run(batches):
        for batch in batches:
            n = len(names)
            pair = pa.RecordBatch.from_arrays([batch.column(n), batch.column(text_at), batch.column(n + 1)], names=["doc_id", "text", "hits"])
            changed = pc.is_valid(batch.column(n + 1))
            texts = next(iter(rewrite([pair]))).column(3)
            columns = list(batch.columns[:n])
            columns[text_at] = pc.if_else(changed, texts.cast(columns[text_at].type), columns[text_at])
            if chars_at is not None:
                columns[chars_at] = pc.if_else(changed, pc.utf8_length(texts).cast(columns[chars_at].type), columns[chars_at])
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def strip_repeats(docs: DataFrame, width: int = 13, anchor: int = 5) -> DataFrame:
    """The rows, with all of their columns, without the words that remove_repeats() removes.

    ``text`` is rewritten, and ``n_chars`` with it where it is a number, only in
    rows that lose words.  Names of further columns do not matter.
    """
    text = text_or_empty()
    hits, ids, few = _hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row")), width, anchor)
    names = docs.columns
    key, row, held = fresh("strip_id", names), fresh("strip_row", names), fresh("strip_hits", names)
    side = ids.select(F.col("doc_id").alias(key))
    side = F.broadcast(side) if few else side
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col("doc_id").cast("long").alias(key), F.xxhash64(text).alias(row))
    hits = hits.select(F.col("doc_id").alias(key), F.col("row").alias(row), F.col("hits").alias(held))
    touched = rows.join(side, key, "left_semi").join(hits, [key, row], "left").select(*(F.col(f"`{c}`") for c in names), key, held)
    chars = next((k for k, f in enumerate(docs.schema) if f.name == "n_chars" and isinstance(f.dataType, IntegralType)), None)
    rest = rows.join(side, key, "left_anti").select(*(F.col(f"`{c}`") for c in names))
    return rest.union(touched.mapInArrow(_strip(width, names.index("text"), chars, names), docs.schema))
