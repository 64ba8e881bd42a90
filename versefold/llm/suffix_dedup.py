"""Suffix-array dedup by a run-length index: every byte that an earlier 100-byte repeat covers goes.

A window is a string of `length` bytes. Each window belongs to its minimizer, the k-mer of least hash within it (the
leftmost on ties), so equal windows belong to equal minimizers; a maximal run of windows of one minimizer occurrence is
a context. Contexts meet by minimizer:

1. map: contexts as (minimizer hash, 128-bit hash of the context's bytes, document, start, length). Within a task's
   batch, contexts that repeat one are marked at once and only the first goes on.
2. by minimizer hash: contexts that are copies of an earlier one are marked; where a minimizer has several different
   contexts, the first of each goes on to an index. So an index holds each text once.
3. the texts of those contexts are cut from the documents and dealt by minimizer hash to tasks, which build run-length
   indexes of them, a few MB at a time, in document order: the runs of a Burrows-Wheeler transform with suffix samples
   at their ends; the suffix array is gone once they are taken. The matching statistics of the contexts stream from the
   samples: at a run's head the match with the preceding suffix was compared byte by byte, and it is one less at each
   next position. Positions that match the suffix before them over `length` bytes or more are chains of equal windows;
   all but the earliest of a chain are marked.
4. marks are gathered by document and the marked bytes removed.

A minimizer that a large share of documents hold (found in a sample; a list of bounded length) is broken up into
windows of their own keys, so that no key gathers more than one row from each task; the same is done in step 3 where
a minimizer has more than `large` different contexts. The sample and the bounds move rows, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Spans, long_field, map_batches, mix, named_again, slices, table, utf8, with_ids

LENGTH, KMER, CHUNK = 100, 32, 2 << 20
#: Every so manieth document is in the sample, in which a minimizer is hot from this share of documents; so many at most are told to the tasks.
SAMPLE, HOT_SHARE, HOT_MOST, LARGE = 64, 0.01, 4096, 20_000

#: Bytes of a text that minimizers are found in at once; a place in them has 26 bits.
PIECE = 1 << 25

_U = np.uint64
_LOW = _U((1 << 26) - 1)


def contexts(data: np.ndarray, offsets: np.ndarray, length: int, kmer: int, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer hashes, starts and ends (in data) of the contexts of some texts.

    Data beyond `piece` bytes is taken in pieces that share length - 1 bytes; a context over an edge is two, which changes no window's minimizer.
    """
    found = [(k, lo + s, lo + e) for lo in range(0, max(len(data) - length + 1, 1), piece) for k, s, e in [_contexts(data[lo : lo + piece + length - 1], offsets - lo, length, kmer)]]
    return found[0] if len(found) == 1 else tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _contexts(data: np.ndarray, offsets: np.ndarray, length: int, kmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    spans = Spans(data)
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64), np.empty(0, np.int64)
    place = np.arange(len(data) - kmer + 1)
    hashes = spans(place, place + kmer)
    least, reach, width = (hashes & ~_LOW) | place.astype(_U), 1, length - kmer + 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: reach - width], least[width - reach :])
    at = np.arange(n)
    # A window must end where its text ends, at the latest.
    ends = offsets[1:]
    starts = np.flatnonzero(at + length <= ends[np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)])
    if not len(starts):
        return np.empty(0, _U), starts, starts
    at = (least[starts] & _LOW).astype(np.int64)
    head = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)])
    return hashes[at[head]], starts[head], starts[np.r_[head[1:] - 1, len(starts) - 1]] + length


def digests(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each span's bytes, as two columns."""
    raw = memoryview(data.tobytes())
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[x:y]) for x, y in zip(s.tolist(), e.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


_ROW = T.StructType([long_field("k"), long_field("c"), long_field("c2"), long_field("doc"), long_field("a"), T.StructField("n", T.IntegerType())])


def _merged(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of equal documents, joined where they meet."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    group = np.cumsum(np.r_[True, doc[1:] != doc[:-1]]) - 1
    base = group * (int(e.max()) + 1)
    far = np.maximum.accumulate(e + base) - base
    new = np.r_[True, s[1:] > far[:-1]]
    new[edge] = True
    head = np.flatnonzero(new)
    return doc[head], s[head], far[np.r_[head[1:] - 1, len(s) - 1]]


def _windows(k: np.ndarray, s: np.ndarray, e: np.ndarray, pick: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The single windows of the picked contexts: which context, and the start."""
    count = (e - s - length + 1)[pick]
    which = np.repeat(np.flatnonzero(pick), count)
    inner = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, s[which] + inner


def _candidates(docs: DataFrame, length: int, kmer: int, hot: np.ndarray) -> DataFrame:
    """Step 1. Rows with n < 0 are marked spans of -n bytes; their key only deals them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            parts = []
            for lo, hi in slices(offsets):
                own = offsets[lo : hi + 1] - offsets[lo]
                part = data[offsets[lo] : offsets[hi]]
                k, s, e = contexts(part, own, length, kmer)
                if len(hot) and len(k):
                    pick = hot[np.minimum(np.searchsorted(hot, k), len(hot) - 1)] == k
                    _, at = _windows(k, s, e, pick, length)
                    k, s, e = k[~pick], np.r_[s[~pick], at], np.r_[e[~pick], at + length]
                c, c2 = digests(part, s, e)
                # A window by itself is its own minimizer.
                k = np.r_[k, mix(c[len(k) :].view(_U) + _U(1))]
                d = np.searchsorted(own, s, "right") - 1
                parts.append((k, c, c2, ids[lo + d], s - own[d], e - own[d]))
            if not parts:
                continue
            k, c, c2, doc, a, e = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((a, doc, c2, c, k))
            k, c, c2, doc, a, e = (x[order] for x in (k, c, c2, doc, a, e))
            first = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1]) | (c2[1:] != c2[:-1])] if len(k) else np.empty(0, bool)
            d, s, t = _merged(doc[~first], a[~first], e[~first])
            none = np.zeros(len(d), np.int64)
            k = np.r_[k[first], mix(d.astype(_U) * _U(31) + s.astype(_U))]
            n = np.r_[(e - a)[first], s - t]
            columns = [pa.array(k.view(np.int64)), pa.array(np.r_[c[first], none]), pa.array(np.r_[c2[first], none]), pa.array(np.r_[doc[first], d]), pa.array(np.r_[a[first], s]), pa.array(n.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=_ROW.names)

    return docs.select(F.col("__vf_id"), F.col("__vf_text")).mapInArrow(run, _ROW)


def _hot(docs: DataFrame, length: int, kmer: int, share: float) -> np.ndarray:
    """Minimizers of a large share of documents, from a sample; sorted, HOT_MOST at most."""
    sample = docs.where(F.pmod(F.xxhash64("__vf_id"), F.lit(SAMPLE)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([1])], names=["k"]).slice(0, 0)
            for lo, hi in slices(offsets):
                k = contexts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], length, kmer)[0]
                yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64))], names=["k"])

    least = max(16, int(sample.count() * share))
    found = sample.select("__vf_text").mapInArrow(run, "k long").groupBy("k").count().where(F.col("count") >= least)
    rows = found.orderBy(F.desc("count"), "k").limit(HOT_MOST).collect()
    return np.sort(np.array([r["k"] for r in rows], np.int64).view(_U))


class RunIndex:
    """A run-length index of some strings: the runs of their Burrows-Wheeler transform, with suffix samples at the runs' ends.

    The strings end in separators of their own, smaller than any byte and in the strings' order. What is kept grows with
    the runs, not with the text: for each run its symbol and first row, and for each run's first suffix the place of that
    suffix (a head), the suffix before it in order and how far both match. Between heads both move on with the text: at
    the next place the suffix before is that before the last one moved on, and the match is one byte shorter.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        size = np.diff(offsets)
        self.n, self.m = len(data), int((size > 0).sum())
        left = np.repeat(offsets[1:], size) - np.arange(self.n)
        order = _suffixes(data, left, np.repeat(np.arange(len(size)), size), len(size))
        before = order - 1
        starts = (before < 0) | (left[before] == 1)
        last = np.r_[data[offsets[1:][size > 0] - 1].astype(np.int16), np.where(starts, _END, data[before].astype(np.int16))]
        new = np.r_[True, (last[1:] != last[:-1]) | (last[1:] == _END)] if self.n else np.zeros(0, bool)
        if self.n:
            new[self.m] = True
        self.rows = np.flatnonzero(new)
        self.runs = last[self.rows]
        first = self.rows[self.rows >= self.m] - self.m
        at, prior = order[first], order[np.maximum(first - 1, 0)]
        match = _common(data, left, at, prior)
        match[:1] = 0  # the first suffix has none before it
        by_place = np.argsort(at)
        self.heads, self.moves, self.match = at[by_place], (prior - at)[by_place], match[by_place]
        # Rows of each symbol before each run, for backward search.
        size = np.diff(np.r_[self.rows, len(last)])
        by_symbol = np.argsort(self.runs, kind="stable")
        self.symbols, self.symbol_rows, self.symbol_sums = self.runs[by_symbol], self.rows[by_symbol], np.r_[0, np.cumsum(size[by_symbol])]
        self.less = self.m + np.r_[0, np.cumsum(np.bincount(data, minlength=256))]

    def _rank(self, symbol: int, row: int) -> int:
        """How many rows before this one have the symbol."""
        lo, hi = np.searchsorted(self.symbols, [symbol, symbol + 1])
        k = lo + int(np.searchsorted(self.symbol_rows[lo:hi], row))
        if k == lo:
            return 0
        run = self.symbol_sums[k] - self.symbol_sums[k - 1]
        return int(self.symbol_sums[k - 1] - self.symbol_sums[lo] + min(run, row - self.symbol_rows[k - 1]))

    def count(self, pattern: bytes) -> int:
        """How often a string occurs, by backward search over the runs."""
        lo, hi = 0, self.n + self.m
        for c in reversed(pattern):
            lo, hi = int(self.less[c]) + self._rank(c, lo), int(self.less[c]) + self._rank(c, hi)
        return max(hi - lo, 0)

    def matching_statistics(self) -> np.ndarray:
        """At each place, how far it matches the suffix before it in order."""
        size = np.diff(np.r_[self.heads, self.n])
        return np.maximum(np.repeat(self.match + self.heads, size) - np.arange(self.n), 0)

    def later(self, length: int) -> np.ndarray:
        """Places whose string of this length also starts at a smaller place.

        The places of a string are a chain, each tied to that of the suffix before it; ties are ranges that begin at heads.
        """
        size = np.minimum(np.maximum(self.match - length + 1, 0), np.diff(np.r_[self.heads, self.n]))
        tied = np.repeat(self.heads - np.cumsum(size) + size, size) + np.arange(size.sum())
        if not len(tied):
            return tied
        end = np.arange(self.n)
        end[tied] += np.repeat(self.moves, size)
        while True:
            further = end[end[tied]]
            if np.array_equal(further, end[tied]):
                break
            end[tied] = further
        every = np.union1d(tied, end[tied])
        least = np.full(self.n, self.n)
        np.minimum.at(least, end[every], every)
        return every[every > least[end[every]]]


#: What stands before a string's first byte.
_END = 256


def _suffixes(data: np.ndarray, left: np.ndarray, string: np.ndarray, m: int) -> np.ndarray:
    """The suffix array, by prefix doubling from seven bytes."""
    n = len(data)
    padded = np.zeros(n + 7, np.int64)
    padded[:n] = data.astype(np.int64) + 1
    key = np.zeros(n, np.int64)
    for t in range(7):
        key = (key << 9) | np.where(left > t, padded[t : t + n], 0)
    depth = 7
    while True:
        order = np.argsort(key)
        ranked = key[order]
        new = np.r_[False, ranked[1:] != ranked[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n - 1:
            return order
        beyond = left > depth
        second = string.copy()
        second[beyond] = rank[np.flatnonzero(beyond) + depth] + m
        key = rank * (n + m + 1) + second
        depth *= 2


def _common(data: np.ndarray, left: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes, compared eight bytes at a time."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    most = np.minimum(left[a], left[b])
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x, y = a[live] + out[live], b[live] + out[live]
        same = np.cumprod(eight[x] == eight[y], axis=1).sum(1)
        out[live] += same
        live = live[(same == 8) & (out[live] < most[live])]
    return np.minimum(out, most)


_SPAN = T.StructType([long_field("doc"), long_field("a"), T.StructField("n", T.IntegerType())])
_TEXT = T.StructType([long_field("k"), long_field("doc"), long_field("a"), T.StructField("t", T.BinaryType())])


def _indexed(rows: DataFrame, length: int, chunk: int) -> DataFrame:
    """Step 3: rows (k, doc, a, t), dealt and sorted by k, doc, a; the spans that earlier ones cover. A row without t is a window that repeats one of its batch."""

    def spans(ks: list, docs: list, starts: list, texts: list) -> pa.RecordBatch:
        doc, a = np.concatenate(docs), np.concatenate(starts)
        order = np.lexsort((a, doc))
        sizes = np.concatenate([np.diff(o) for _, o in texts])
        data = np.concatenate([d for d, _ in texts])
        begin = np.cumsum(sizes) - sizes
        take = np.repeat(begin[order], sizes[order]) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
        offsets = np.r_[0, np.cumsum(sizes[order])]
        at = RunIndex(data[take], offsets).later(length)
        which = np.searchsorted(offsets, at, "right") - 1
        s = a[order][which] + at - offsets[which]
        d, s, e = _merged(doc[order][which], s, s + length)
        return pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array((s - e).astype(np.int32))], names=_SPAN.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        size = 0
        for batch in batches:
            again = batch.filter(pc.is_null(batch.column(3)))
            if len(again):
                yield pa.RecordBatch.from_arrays([again.column(1), again.column(2), pa.array(np.full(len(again), -length, np.int32))], names=_SPAN.names)
            batch = batch.filter(pc.is_valid(batch.column(3)))
            k = batch.column(0).to_numpy()
            doc, a = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            data, offsets = utf8(batch.column(3))
            cuts = [0, *np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)] if len(k) else []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if size > chunk and held[0][-1] != k[lo]:
                    yield spans(*held)
                    held, size = ([], [], [], []), 0
                held[0].append(k[lo])
                held[1].append(doc[lo:hi])
                held[2].append(a[lo:hi])
                held[3].append((data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1]))
                size += int(offsets[hi] - offsets[lo])
        if size:
            yield spans(*held)

    return rows.mapInArrow(run, _SPAN)


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """The texts of the contexts that go on (rows with m = 0), or of their windows, each its own key (m = 1); null for those that repeat one of the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data, offsets = batch.column(0).to_numpy(), *utf8(batch.column(1))
            lists = batch.column(2)
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            v = lists.flatten()
            k, a, n, m = (v.field(x).to_numpy(zero_copy_only=False) for x in ("k", "a", "n", "m"))
            s = offsets[row] + a
            e = s + n
            gone = np.zeros(len(k), bool)
            if m.any():
                which, at = _windows(k.view(_U), s, e, m.astype(bool), length)
                order = np.lexsort((at, ids[row[which]]))  # by document and place: of equal windows only the first goes on
                which, at = which[order], at[order]
                h, h2 = digests(data, at, at + length)
                order = np.lexsort((np.arange(len(h)), h2, h))
                again = np.zeros(len(h), bool)
                again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
                pick = m == 0
                k, row, a, s, e = np.r_[k[pick], h], np.r_[row[pick], row[which]], np.r_[a[pick], at - offsets[row[which]]], np.r_[s[pick], at], np.r_[e[pick], at + length]
                gone = np.r_[gone[pick], again]
            raw = data.tobytes()
            for lo in range(0, len(k), 50_000):
                part = slice(lo, lo + 50_000)
                texts = [None if z else raw[x:y] for x, y, z in zip(s[part].tolist(), e[part].tolist(), gone[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(ids[row[part]]), pa.array(a[part]), pa.array(texts, pa.binary())], names=_TEXT.names)

    return docs.mapInArrow(run, _TEXT)


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, kmer: int = KMER, chunk: int = CHUNK, hot_share: float = HOT_SHARE, large: int = LARGE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary: what is left of the text's UTF-8).

    Removed is each byte covered by a string of `length` bytes that also starts earlier: in a smaller doc_id, or earlier
    in the same document. A null text is empty. Rows of one doc_id with different texts are documents of their own, in
    the order of their texts; rows that repeat both are one document and get equal results; a null doc_id comes first.
    Columns of these names are replaced; others pass through.
    """
    slim, pairs = with_ids(docs, doc_id, text)
    rows = _candidates(slim, length, kmer, _hot(slim, length, kmer, hot_share))
    by = Window.partitionBy("k").orderBy("c", "c2", "doc", "a")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    marked = rows.withColumn("first", F.lag("c").over(by).isNull() | (F.lag("c").over(by) != F.col("c")) | (F.lag("c2").over(by) != F.col("c2")))
    marked = marked.withColumn("m", F.sum(F.when(F.col("first") & (F.col("n") > 0), 1).otherwise(0)).over(whole))
    marked = marked.withColumn("span", (F.col("n") < 0) | ~F.col("first")).where(F.col("span") | (F.col("m") > 1))
    marked = marked.select("doc", "a", F.when(F.col("span"), -F.abs("n")).otherwise(F.col("n")).alias("n"), F.when(F.col("span"), 0).otherwise(F.col("k")).alias("k"), F.when(F.col("m") > large, 1).otherwise(0).alias("m"))
    gathered = marked.groupBy("doc").agg(F.collect_list(F.struct("a", "n", "k", "m")).alias("v"))

    texts = slim.join(gathered, slim["__vf_id"] == gathered["doc"], "left")
    wanted = F.filter("v", lambda x: x["n"] > 0)
    cut = _cut(texts.select("__vf_id", "__vf_text", wanted.alias("v")).where(F.size("v") > 0), length)
    dealt = cut.repartition("k").sortWithinPartitions("k", "doc", "a")
    again = _indexed(dealt, length, chunk).groupBy("doc").agg(F.collect_list(F.struct("a", "n")).alias("w")).withColumnRenamed("doc", "again")
    both = texts.join(again, F.col("__vf_id") == F.col("again"), "left")
    early = F.transform(F.filter("v", lambda x: x["n"] < 0), lambda x: F.struct(x["a"].alias("a"), x["n"].alias("n")))
    both = both.select("__vf_id", "__vf_text", F.concat(F.coalesce(early, F.array().cast("array<struct<a:bigint,n:int>>")), F.coalesce("w", F.array().cast("array<struct<a:bigint,n:int>>"))).alias("_spans"))
    fields = [long_field("n_bytes"), long_field("n_removed"), long_field("n_spans"), T.StructField("kept", T.BinaryType())]

    def fn(batch: pa.RecordBatch) -> dict:
        data, offsets = utf8(batch.column("__vf_text"))
        lists = batch.column("_spans")
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        v = lists.flatten()
        a, n = v.field("a").to_numpy(), v.field("n").to_numpy()
        row, s, e = _merged(row, a.astype(np.int64), a - n)
        size = np.bincount(row, minlength=len(lists)) if len(row) else np.zeros(len(lists), np.int64)
        gone = np.bincount(row, weights=e - s, minlength=len(lists)).astype(np.int64) if len(row) else np.zeros(len(lists), np.int64)
        edge = np.zeros(len(data) + 1, np.int8)
        np.add.at(edge, offsets[row] + s, 1)
        np.add.at(edge, offsets[row] + e, -1)
        kept = data[np.cumsum(edge[:-1], dtype=np.int8) == 0].tobytes()
        ends = np.cumsum(np.diff(offsets) - gone).tolist()
        texts = [kept[x:y] for x, y in zip([0, *ends], ends, strict=False)]
        return {"n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(gone), "n_spans": pa.array(size.astype(np.int64)), "kept": pa.array(texts, pa.binary())}

    made = map_batches(both, fn, fields).select("__vf_id", "__vf_text", *[f.name for f in fields])
    return named_again(docs.drop(*[f.name for f in fields]), made, pairs, doc_id, text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), windows AS (
  SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS w FROM docs, LATERAL (SELECT unnest(range(greatest(n - 99, 0))) AS p)
), marked AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1
), edges AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100, true) AS fresh FROM marked
), runs AS (
  SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM edges) GROUP BY doc_id, r
), gone AS (
  SELECT doc_id, sum(e - s) AS removed, count(*) AS spans FROM runs GROUP BY doc_id
), pieces AS (
  SELECT doc_id, s AS till, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS since FROM runs
  UNION ALL
  SELECT d.doc_id, d.n, coalesce(max(r.e), 0) FROM docs d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id, d.n
), kept AS (
  SELECT p.doc_id, string_agg(substr(d.h, 2 * since + 1, 2 * (till - since)), '' ORDER BY since, till) AS h FROM pieces p JOIN docs d ON d.doc_id = p.doc_id GROUP BY p.doc_id
)
SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM docs d JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN gone g ON g.doc_id = d.doc_id
"""
