"""N-gram Jaccard join by chosen paths, for documents as sets of word shingles.

Each run samples a few tokens of every set: a token is chosen where its hash in that run is below branch / (threshold *
size), so similar sets tend to choose the same ones. Sets that choose a token share a bucket. A bucket that holds more
than a few sets is split again on further sampled tokens, to `depth` levels; what is small is compared by brute force.
Runs repeat until the target recall (`runs`). Equal sets are one node from the start, with a count, so copies enter no
bucket twice. All levels and runs choose from one pool of sampled tokens that each set carries.

A bucket that splitting doesn't make smaller holds either a family of near copies or sets that share one passage. It is
dealt out in blocks: all sets are compared with some pivots, and those that this doesn't connect with the bucket's main
family with all others (a family costs its length, not its square; what one chain connects needs no further look). Nothing is dropped for its size: bucket sizes are counted over all sets
before rows are shuffled, so no task gathers a large bucket.

Within buckets, one-bit sketches (one permutation, 256 bins) drop pairs that are far from the threshold, and what is
left goes on as a spanning forest, not as pairs. Connected candidates are then verified exactly: the sets of a component
meet in blocks, and all pairs of blocks are counted, so that no link is lost and none is emitted as a row: a block pair
returns each member's number of links and a spanning forest of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_field, mix, named_again, shared_checkpoint, shared_table, shingles, slices, table, utf8, with_ids, words

#: Sets of a bucket that are compared by brute force; levels; sets of a block of a bucket that isn't split further, and its pivots.
WIDTH, THRESHOLD, RECALL, BRANCH, SMALL, DEPTH, SIDE, PIVOTS = 5, 0.8, 0.999, 1.5, 256, 3, 16_384, 512
#: Expected tokens of the pool that paths are chosen from, times the threshold; a bucket whose largest part is this share of it isn't split.
POOL, FAMILY = 48.0, 0.5
#: Sets of a block of a component that is verified, at least and at most, and bytes of their tokens.
LEAST, MOST, BYTES = 256, 2048, 16 << 20
BINS, SIGMAS = 256, 4.5

_U = np.uint64


def runs(threshold: float, recall: float, branch: float = BRANCH, depth: int = DEPTH) -> int:
    """How many runs find a pair at the threshold with this probability.

    Those in which its tree of shared paths dies out multiply; the sketches lose a pair at the threshold with the
    probability of SIGMAS deviations.
    """
    shared, lost = 2 * branch / (1 + threshold), 0.0
    for _ in range(depth):
        lost = math.exp(-shared * (1 - lost))
    kept = 1 - math.erfc(SIGMAS / math.sqrt(2)) / 2
    return max(1, math.ceil(math.log(1 - min(recall / kept, 1 - 1e-9)) / math.log(lost)))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, end to end, and n + 1 offsets. A text of fewer words is one shingle, one without words has none."""
    hashes, row = words(data, offsets)[2:]
    every, n, out = shingles(hashes, width), len(offsets) - 1, []
    for i in range(n):
        lo, hi = row[i], row[i + 1]
        out.append(np.unique(every[lo : hi - width + 1]) if hi - lo >= width else shingles(hashes[lo:hi], int(hi - lo)) if hi > lo else every[:0])
    return (np.concatenate(out) if out else every[:0]), np.r_[0, np.cumsum([len(x) for x in out])].astype(np.int64)


def _sum_by(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def signatures(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set."""
    return mix(_sum_by(mix(tokens), offsets)), mix(_sum_by(mix(tokens ^ _U(0x5851F42D4C957F2D)), offsets))


def sketches(tokens: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set, 256 bits of which bins are held and 256 with one bit of each bin's least token (8 words a row)."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    bins = (tokens >> _U(56)).astype(np.int64)
    new = np.ones(len(tokens), bool)
    new[1:] = (row[1:] != row[:-1]) | (bins[1:] != bins[:-1])
    row, bins, bit = row[new], bins[new], (mix(tokens[new]) & _U(1)).astype(bool)
    bits = np.zeros((n, 2 * BINS), bool)
    bits[row, bins] = True
    bits[row[bit], BINS + bins[bit]] = True
    return np.packbits(bits, axis=1).view(_U)


def near(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sets of these sketches and sizes may reach the threshold (all of a by all of b)."""
    half = BINS // 64
    held = np.zeros((len(a), len(b)), np.int64)
    differ = np.zeros((len(a), len(b)), np.int64)
    for w in range(half):
        x, y, u, v = a[:, None, w], b[None, :, w], a[:, None, half + w], b[None, :, half + w]
        held += np.bitwise_count(x | y)
        differ += np.bitwise_count((x ^ y) | (u ^ v))
    # A bin held by one set only never matches; one held by both does with the Jaccard similarity, and else by chance in half of the cases.
    most = (1 - threshold) * held + SIGMAS * np.sqrt(np.maximum(held, 1) * threshold * (1 - threshold))
    small, large = np.minimum(size_a[:, None], size_b[None, :]), np.maximum(size_a[:, None], size_b[None, :])
    return (differ <= most) & (small >= threshold * large - 1e-9)


def pools(tokens: np.ndarray, offsets: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that a set's paths are chosen from (32 bits of each), and offsets: about POOL / threshold of them."""
    size = np.diff(offsets)
    row = np.repeat(np.arange(len(size)), size)
    h = mix(tokens ^ _U(0x2545F4914F6CDD1D))
    share = np.minimum(POOL / (threshold * np.maximum(size, 1)), 1.0)
    pick = np.flatnonzero((h >> _U(11)).astype(np.float64) / (1 << 53) < share[row])
    return mix(h[pick]).astype(np.uint32), np.searchsorted(row[pick], np.arange(len(size) + 1))


def choose(path: np.ndarray, row: np.ndarray, pool: np.ndarray, size: np.ndarray, threshold: float, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pool tokens are chosen below a path, and the paths that they make. path and size are by row; pool tokens have a row."""
    share = np.minimum(branch / (threshold * np.maximum(size, 1)), 1.0) / np.minimum(POOL / (threshold * np.maximum(size, 1)), 1.0)
    below = mix(path[row] ^ (pool.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
    pick = np.flatnonzero((mix(below) >> _U(11)).astype(np.float64) / (1 << 53) < share[row])
    return pick, below[pick]


_SIGNED = T.StructType([long_field("id"), long_field("sa"), long_field("sb"), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType()), T.StructField("pool", T.BinaryType())])
_ROW = T.StructType([long_field("key"), long_field("id"), T.StructField("n", T.IntegerType()), T.StructField("sketch", T.BinaryType())])
_KID = T.StructType([long_field("parent"), long_field("m"), *_ROW.fields])


def _signed(docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """Size, signature, sketch and pool of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = batch.column(0).to_numpy(), utf8(batch.column(1))
            for lo, hi in slices(offsets):
                tokens, own = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                sa, sb = signatures(tokens, own)
                pool, at = pools(tokens, own, threshold)
                raw, sketch = pool.tobytes(), sketches(tokens, own)
                at = (4 * at).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi]), pa.array(sa.view(np.int64)), pa.array(sb.view(np.int64)), pa.array(np.diff(own).astype(np.int32)), pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([raw[x:y] for x, y in zip(at, at[1:], strict=False)], pa.binary())],
                    names=_SIGNED.names,
                )

    return docs.select("__vf_id", "__vf_text").mapInArrow(run, _SIGNED)


def _pooled(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The rows and tokens of a batch's pools."""
    raw, offsets = utf8(batch.column("pool"))
    return np.repeat(np.arange(len(batch)), np.diff(offsets) // 4), np.frombuffer(raw.tobytes(), np.uint32)


def _first_level(nodes: DataFrame, threshold: float, branch: float, n_runs: int, keys_only: bool = False) -> DataFrame:
    """A row for each chosen token of each set and run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pool = _pooled(batch)
            size = batch.column("n").to_numpy()
            for r in range(n_runs):
                pick, key = choose(np.full(len(size), mix(np.array([r + 1], _U))[0]), row, pool, size, threshold, branch)
                at = row[pick]
                if keys_only:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column("id").take(pa.array(at))], names=["key", "id"])
                else:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(batch.column(c).take(pa.array(at)) for c in ("id", "n", "sketch"))], names=_ROW.names)

    return nodes.select("id", "n", *([] if keys_only else ["sketch"]), "pool").mapInArrow(run, T.StructType(_ROW.fields[:2]) if keys_only else _ROW)


def _next_level(rows: DataFrame, threshold: float, branch: float) -> DataFrame:
    """Rows (key, m, id, n, sketch, pool) of large buckets, split on the tokens chosen below their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, pool = _pooled(batch)
            path = batch.column("key").to_numpy().view(_U)
            pick, key = choose(path, row, pool, batch.column("n").to_numpy(), threshold, branch)
            at = pa.array(row[pick])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("m").take(at), pa.array(key.view(np.int64)), *(batch.column(c).take(at) for c in ("id", "n", "sketch"))], names=_KID.names)

    return rows.select("key", "m", "id", "n", "sketch", "pool").mapInArrow(run, _KID)


def spread_labels(linked: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For 0..n-1 the least index that links connect each with; linked is a matrix of indices a by indices b."""
    label = np.arange(n)
    while True:
        old = label.copy()
        label[b] = np.minimum(label[b], np.where(linked, label[a][:, None], n).min(0, initial=n))
        label[a] = np.minimum(label[a], np.where(linked, label[b][None, :], n).min(1, initial=n))
        label = label[label]
        if np.array_equal(old, label):
            return label


def _grouped(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], out: T.StructType) -> DataFrame:
    """work over the rows of each key, a few hundred keys of a task at a time; whole groups, in order of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def cut(batch: pa.RecordBatch) -> int:
            """Where the last key of a batch begins."""
            low = 0
            for k in keys:
                x = batch.column(k).to_numpy()
                differ = np.flatnonzero(x != x[-1])
                low = max(low, int(differ[-1]) + 1 if len(differ) else 0)
            return low

        def last(batch: pa.RecordBatch, at: int) -> tuple:
            return tuple(batch.column(k)[at].as_py() for k in keys)

        for batch in batches:
            if not len(batch):
                continue
            at = cut(batch)
            if held and (at or last(held[-1], -1) != last(batch, 0)):
                if last(held[-1], -1) == last(batch, 0):
                    held.append(batch.slice(0, at))
                    batch = batch.slice(at)
                    at = 0
                yield from work(pa.Table.from_batches(held).combine_chunks())
                held = []
            if at:
                yield from work(pa.Table.from_batches([batch.slice(0, at)]))
            if len(batch) > at:
                held.append(batch.slice(at))
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks())

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def _cuts(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for x in columns:
        new[1:] |= x[1:] != x[:-1]
    return np.r_[np.flatnonzero(new), len(new)]


def _sketched(rows: pa.Table) -> np.ndarray:
    return np.frombuffer(utf8(rows.column("sketch"))[0].tobytes(), _U).reshape(len(rows), -1)


_EDGE = T.StructType([long_field("u"), long_field("v")])
_TIED = T.StructType([long_field("key"), *_EDGE.fields])


def _small_buckets(rows: DataFrame, threshold: float) -> DataFrame:
    """Edges (u, v) that connect the candidate pairs of small buckets."""

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids, size, sketch = (*(rows.column(c).to_numpy() for c in ("key", "id", "n")), _sketched(rows))
        cuts = _cuts(key)
        u, v = [], []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if hi - lo > 1:
                part = np.arange(hi - lo)
                label = spread_labels(near(sketch[lo:hi], sketch[lo:hi], size[lo:hi], size[lo:hi], threshold), part, part, hi - lo)
                child = np.flatnonzero(label != part)
                u.append(ids[lo:hi][label[child]])
                v.append(ids[lo:hi][child])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=_EDGE.names)

    return _grouped(rows, ["key"], work, _EDGE)


class Forest:
    """Union-find over 0..n-1; the root is the least member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, pairs: Iterator[tuple[int, int]]) -> None:
        for x, y in pairs:
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def _against(rows: DataFrame, keys: list[str], threshold: float, tell: bool, tile: int = 1024) -> DataFrame:
    """Rows (key, ..., pivot, id, n, sketch) by keys: edges that connect pivots with near ones of the others, tile by tile.

    With tell, the pivots are the same in all blocks of a bucket, and (key, id, null) is told for those of the others,
    but for pivots, that the edges don't connect with the main family: the most pivots that are connected among themselves.
    """

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids, size, pivot, sketch = (*(rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "id", "n", "pivot")), _sketched(rows))
        cuts = _cuts(*(rows.column(k).to_numpy() for k in keys))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            # In order of ids, so that buckets of one family name the same root. A set may be a pivot and one of the others.
            order = lo + np.argsort(ids[lo:hi], kind="stable")
            own = pivot[order].astype(bool)
            a, b = np.flatnonzero(own), np.flatnonzero(~own)
            forest = Forest(hi - lo)

            def join(a: np.ndarray, b: np.ndarray) -> None:
                for x in range(0, len(a), tile):
                    for y in range(0, len(b), tile):
                        p, q = a[x : x + tile], b[y : y + tile]
                        linked = near(sketch[order[p]], sketch[order[q]], size[order[p]], size[order[q]], threshold)
                        both = np.r_[p, q]
                        label = spread_labels(linked, np.arange(len(p)), len(p) + np.arange(len(q)), len(both))
                        child = np.flatnonzero(label != np.arange(len(both)))
                        forest.join(zip(both[label[child]].tolist(), both[child].tolist(), strict=True))

            rest, main = b[~np.isin(ids[order[b]], ids[order[a]])] if tell else b[:0], None
            if len(rest) and len(a):
                # By pivots alone, so that all blocks name one family.
                join(a, a)
                main = int(np.bincount([forest.root(x) for x in a.tolist()]).argmax())
            join(a, b)
            root = np.array([forest.root(x) for x in range(hi - lo)])
            child = np.flatnonzero(root != np.arange(hi - lo))
            u, v = ids[order[root[child]]], ids[order[child]]
            u, v = u[u != v].tolist(), v[u != v].tolist()
            alone = ids[order[rest if main is None else rest[root[rest] != root[main]]]].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u) + len(alone), key[lo])), pa.array(u + alone, pa.int64()), pa.array(v + [None] * len(alone), pa.int64())], names=_TIED.names)

    return _grouped(rows, keys, work, _TIED)


def _large_buckets(rows: DataFrame, threshold: float, side: int, pivots: int) -> DataFrame:
    """Edges (u, v) that connect the candidate pairs of buckets that aren't split: rows (key, m, id, n, sketch), m in a bucket.

    A bucket is dealt in blocks of about `side`. Each meets the pivots, some `pivots` of the bucket's sets. What this
    connects with the bucket's main family is one component, and so are pairs of it; any other pair has a pivot, which
    has met all sets, or a set that isn't connected with that family, which then meets all blocks.
    """
    blocks = F.ceil(F.col("m") / side).cast("int")
    first = F.pmod(F.xxhash64("key", "id"), F.ceil(F.col("m") / pivots)) == 0
    rows = shared_table(rows.withColumn("b", blocks).withColumn("first", first).withColumn("j", F.pmod(F.xxhash64("id", "key"), blocks.cast("long")).cast("int")))
    others = rows.withColumn("pivot", F.lit(False))
    heads = rows.where("first").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).withColumn("pivot", F.lit(True))
    found = shared_checkpoint(_against(others.unionByName(heads).drop("m", "b", "first"), ["key", "j"], threshold, True))
    edges = found.where("v is not null").select("u", "v")
    alone = found.where("v is null").select("key", F.col("u").alias("id"))
    if alone.isEmpty():
        return edges
    sizes = shared_checkpoint(alone.groupBy("key").agg(F.ceil(F.count("*") / side).cast("int").alias("parts")))
    rest = rows.join(alone, ["key", "id"]).join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("id", "key", F.lit(1)), F.col("parts").cast("long")).cast("int"))
    heads = rest.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("b") - 1))).withColumn("pivot", F.lit(True))
    every = rows.join(sizes, "key").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("pivot", F.lit(False))
    names = ["key", "i", "j", "pivot", "id", "n", "sketch"]
    return edges.unionByName(_against(heads.select(*names).unionByName(every.select(*names)), ["key", "i", "j"], threshold, False).select("u", "v"))


def _candidates(nodes: DataFrame, threshold: float, branch: float, n_runs: int, small: int, depth: int, side: int, pivots: int) -> DataFrame:
    """Edges (u, v) that connect the candidate pairs of all buckets. nodes: (id, n, sketch, pool)."""
    keys = _first_level(nodes, threshold, branch, n_runs, keys_only=True)
    large = shared_checkpoint(keys.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > small))
    edges = _small_buckets(_first_level(nodes, threshold, branch, n_runs).join(large, "key", "left_anti"), threshold)
    if large.isEmpty():
        return edges
    by_id = nodes.select("id", "n", "sketch", "pool")
    level = keys.join(large, "key").join(by_id, "id")
    leaves = None
    for _ in range(depth - 1):
        level = shared_table(level)
        # Whether splitting a bucket makes it smaller shows on a few of its sets; it decides the way, not the result.
        few = level.where(F.pmod(F.xxhash64("id", "key"), F.ceil(F.col("m") / small)) == 0)
        most = _next_level(few, threshold, branch).groupBy("parent", "key").agg(F.count("*").alias("c")).groupBy(F.col("parent").alias("key")).agg(F.max("c").alias("c"))
        tight = shared_checkpoint(few.groupBy("key").agg(F.count("*").alias("s")).join(most, "key").where(F.col("c") >= F.col("s") * FAMILY).select("key"))
        whole = level.join(tight, "key", "left_semi").drop("pool")
        leaves = whole if leaves is None else leaves.unionByName(whole)
        # A kid's key comes of its parent's, so a key has one parent.
        kids = _next_level(level.join(tight, "key", "left_anti"), threshold, branch).drop("parent", "m")
        size = shared_checkpoint(kids.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > small))
        edges = edges.unionByName(_small_buckets(kids.join(size, "key", "left_anti"), threshold))
        level = kids.select("key", "id").join(size, "key").join(by_id, "id")
        if size.isEmpty():
            level = None
            break
    if level is not None:
        leaves = level.drop("pool") if leaves is None else leaves.unionByName(level.drop("pool"))
    return edges.unionByName(_large_buckets(leaves.select("key", "m", "id", "n", "sketch"), threshold, side, pivots))


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of edges (u, v): the least node that is connected. Labels spread to neighbours and jump to their labels' labels."""
    both = shared_checkpoint(edges.select("u", "v").union(edges.select("v", "u")).where("u <> v").distinct())
    labels = shared_checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")))
    while True:
        got = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("comp").alias("other"))
        near_ = labels.join(got, F.col("node") == F.col("u")).select("node", F.col("comp").alias("old"), F.least("comp", "other").alias("mid"))
        jump = near_.join(labels.withColumnsRenamed({"node": "at", "comp": "then"}), F.col("mid") == F.col("at"), "left")
        new = shared_checkpoint(jump.select("node", "old", F.least("mid", F.coalesce("then", "mid")).alias("comp")))
        if new.where("old <> comp").isEmpty():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def _verified(sets: DataFrame, threshold: float) -> DataFrame:
    """From rows (comp, i, j, side, id, copies, tokens), a row for each member of each block pair: id, links, and the root of a forest of links."""
    out = T.StructType([long_field("id"), long_field("links"), long_field("root")])

    def shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """How many tokens each of a has in common with each of b."""
        flat = [np.concatenate(x) if x else np.empty(0, _U) for x in (a, b)]
        both = np.intersect1d(*(np.unique(x) for x in flat), assume_unique=True)
        total = np.zeros((len(a), len(b)), np.float32)
        at = []
        for x, own in zip(flat, (a, b), strict=True):
            column = np.searchsorted(both, x)
            held = column < len(both)
            held[held] = both[column[held]] == x[held]
            at.append((np.repeat(np.arange(len(own)), [len(y) for y in own])[held], column[held]))
        for lo in range(0, len(both), 4096):
            width = min(4096, len(both) - lo)
            dense = []
            for (row, column), own in zip(at, (a, b), strict=True):
                part = (column >= lo) & (column < lo + width)
                x = np.zeros((len(own), width), np.float32)
                x[row[part], column[part] - lo] = 1
                dense.append(x)
            total += dense[0] @ dense[1].T
        return total

    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        comp, i, j, side, ids, copies = (rows.column(c).to_numpy() for c in ("comp", "i", "j", "side", "id", "copies"))
        raw, offsets = utf8(rows.column("tokens"))
        raw = raw.tobytes()
        cuts = _cuts(comp, i, j)
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            order = lo + np.argsort(ids[lo:hi], kind="stable")
            own, n = ids[order], hi - lo
            tokens = [np.frombuffer(raw, _U, (offsets[k + 1] - offsets[k]) // 8, offsets[k]) for k in order.tolist()]
            size = np.array([len(x) for x in tokens])
            same = i[lo] == j[lo]
            a = np.arange(n) if same else np.flatnonzero(side[order] == i[lo])
            b = np.arange(n) if same else np.flatnonzero(side[order] != i[lo])
            common = shared([tokens[k] for k in a], [tokens[k] for k in b])
            linked = common >= threshold * (size[a][:, None] + size[b][None, :] - common) - 1e-6
            if same:
                np.fill_diagonal(linked, False)
            links = np.zeros(n, np.int64)
            links[a] = linked @ copies[order][b]
            if not same:
                links[b] = linked.T @ copies[order][a]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own, links, own[spread_labels(linked, a, b, n)])], names=out.names)

    return _grouped(sets, ["comp", "i", "j"], work, out)


def _sets(members: DataFrame, width: int) -> DataFrame:
    """Rows (__vf_id, __vf_text, ...) with their shingle sets for their texts."""
    kept = [f for f in members.schema.fields if f.name != "__vf_text"]
    schema = T.StructType([*kept, T.StructField("tokens", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("__vf_text"))
            for lo, hi in slices(offsets):
                tokens, own = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], width)
                texts = [tokens[x:y].tobytes() for x, y in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name).slice(lo, hi - lo) for f in kept), pa.array(texts, pa.binary())], names=schema.names)

    return members.mapInArrow(run, schema)


def join_near(docs: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, branch: float = BRANCH, small: int = SMALL, depth: int = DEPTH, side: int = SIDE, pivots: int = PIVOTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with class_id, n_links and is_first (whether a row's document is the one whose doc_id is its class's).

    Documents are linked whose sets of `width`-word shingles (words after lower-casing A-Z, as in decontamination) have
    a Jaccard similarity of `threshold` or more. n_links counts the other documents that one is linked with; class_id is
    the least doc_id that links connect it with, or its own. A text with fewer words is one shingle; one without words,
    null or empty, has no links. A pair at the threshold is found with probability `recall` or more, a closer one with a
    higher one; equal sets always are, and what is found is exact. Rows that repeat doc_id and text are one document,
    rows of one doc_id with different texts are several. A doc_id may be of any type that has an order. Whole texts of
    any length count. Columns of these names are replaced; others pass through.
    """
    slim, pairs = with_ids(docs, doc_id, text)
    signed = shared_table(_signed(slim, width, threshold))
    # Equal sets have equal sizes, sketches and pools.
    same = signed.where("n > 0").groupBy("sa", "sb").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("pool").alias("pool"))
    nodes = shared_table(same)
    edges = _candidates(nodes, threshold, branch, runs(threshold, recall, branch, depth), small, depth, side, pivots)
    comps = components(edges)
    members = comps.join(nodes.select("id", "copies", "n"), F.col("node") == F.col("id"))
    sized = members.groupBy("comp").agg(F.count("*").alias("m"), F.sum(F.col("n") * F.lit(8).cast("long")).alias("bytes"))
    block = F.least(F.greatest(F.col("m") / 16, F.lit(float(LEAST))), F.lit(float(MOST)))
    sized = sized.select("comp", F.ceil(F.greatest(F.col("m") / block, F.col("bytes") / BYTES)).cast("int").alias("b"))
    own = F.pmod(F.xxhash64("node"), F.col("b").cast("long")).cast("int")
    members = shared_checkpoint(members.join(sized, "comp").select("node", "comp", "copies", "b", own.alias("own")))
    sets = _sets(slim.join(members, F.col("__vf_id") == F.col("node")).select("__vf_id", "__vf_text", "comp", "copies", "b", "own"), width)
    met = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
    met = met.select("comp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), F.col("__vf_id").alias("id"), "copies", "tokens")
    found = shared_checkpoint(_verified(met, threshold))
    links = found.groupBy(F.col("id").alias("of")).agg(F.sum("links").alias("links"))
    classes = components(found.where("id <> root").select(F.col("id").alias("u"), F.col("root").alias("v")))
    done = nodes.select("sa", "sb", "id", "copies").join(links, F.col("id") == F.col("of"), "left").join(classes, F.col("id") == F.col("node"), "left")
    done = done.select("sa", "sb", F.coalesce("comp", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    made = signed.where("n > 0").select("id", "sa", "sb").join(done, ["sa", "sb"]).select(F.col("id").alias("__vf_id"), "class_id", "n_links")
    empty = signed.where("n = 0").select(F.col("id").alias("__vf_id"), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    made = made.unionByName(empty)
    made = made.withColumn("is_first", F.col("__vf_id") == F.col("class_id"))
    if pairs is not None:
        at = pairs.select(F.col("__vf_new").alias("__vf_c"), F.col("__vf_id").alias("__vf_least"))
        made = made.join(at, F.col("class_id") == F.col("__vf_c")).select("__vf_id", F.col("__vf_least").alias("class_id"), "n_links", "is_first")
    return named_again(docs.drop("class_id", "n_links", "is_first"), made, pairs, doc_id, text)


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how: object) -> DataFrame:
    """docs with one document of each class, that of the least doc_id; of rows that repeat doc_id and text, one."""
    kept = join_near(docs, doc_id=doc_id, text=text, **how).where("is_first").select(*docs.columns)
    plain = docs.groupBy(doc_id).count().where(F.col(doc_id).isNull() | (F.col("count") > 1)).isEmpty()
    return kept if plain else kept.dropDuplicates([doc_id, text])


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return join_near(docs).select("doc_id", "class_id", "n_links")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[p : p + least(5, len(w)) - 1], ' ')) AS s FROM words, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p) WHERE len(w) > 0
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT u, v FROM pairs JOIN sizes a ON a.doc_id = u JOIN sizes b ON b.doc_id = v WHERE shared * 10 >= 8 * (a.n + b.n - shared)
), either AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT u, v FROM either UNION SELECT r.u, e.v FROM reach r JOIN either e ON e.u = r.v
), least_ AS (
  SELECT u, min(v) AS c FROM reach GROUP BY u
), degree AS (
  SELECT u, count(*) AS k FROM either GROUP BY u
)
SELECT d.doc_id, coalesce(least(c, d.doc_id), d.doc_id) AS class_id, coalesce(k, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN least_ l ON l.u = d.doc_id LEFT JOIN degree g ON g.u = d.doc_id
"""
