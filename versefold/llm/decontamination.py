"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's windows are its runs of `width` words (a shorter item is one window). The tokens of a window are its word
shingles, ordered by how many of them the corpus holds; as a window must be contained whole, its rarest shingle is the
one necessary prefix token. Documents are joined with windows on that token. A match at a word position gives the only
place where the window can lie (positional bound), which must fit in the document (length bound); there the words are
compared, first by their hashes and then byte by byte.

The items are read in blocks of a bounded size (`block_bytes` of text), each of which every task gets whole; a
benchmark of any size is so many blocks, and each block is a pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_field, lower, map_batches, shingles, slices, table, utf8, words

WIDTH, SHINGLE, BLOCK_BYTES = 10, 3, 8 << 20

_HIT = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))


def spoken(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words as bytes, lower-cased, with blanks between."""
    low = lower(data[starts[0] : ends[-1]]).tobytes() if len(starts) else b""
    return b" ".join(low[x:y] for x, y in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist(), strict=True)) if len(starts) else b""


class Windows:
    """The distinct windows of some items: lengths, word hashes, and the items of each."""

    def __init__(self, ids: list[str], texts: list[str | None], width: int, shingle: int):
        data, offsets = utf8(pa.array(texts, pa.string()))
        starts, ends, hashes, row = words(data, offsets)
        found: dict[bytes, set[str]] = {}
        first: dict[bytes, np.ndarray] = {}
        for i, item in enumerate(ids):
            own = row[i + 1] - row[i]
            n = min(width, own)
            for p in range(row[i], row[i + 1] - n + 1 if n else row[i]):
                said = spoken(data, starts[p : p + n], ends[p : p + n])
                found.setdefault(said, set()).add(item)
                first.setdefault(said, hashes[p : p + n].copy())
        self.shingle = shingle
        self.items, self.said, self.hashes = list(found.values()), list(found), list(first.values())
        self.tokens = {q: np.unique(np.concatenate([shingles(w, q) for w in self.hashes if min(shingle, len(w)) == q])) for q in {min(shingle, len(w)) for w in self.hashes}}

    def positions(self, hashes: np.ndarray, row: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Word positions in a batch where a token of q words lies, and which."""
        own, tokens = shingles(hashes, q), self.tokens[q]
        if not len(own):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        low = np.zeros(1 << 16, bool)
        low[(tokens & np.uint64(0xFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(low[(own & np.uint64(0xFFFF)).astype(np.int64)])
        which = np.minimum(np.searchsorted(tokens, own[at]), len(tokens) - 1)
        same = tokens[which] == own[at]
        at, which = at[same], which[same]
        whole = np.searchsorted(row, at, "right") == np.searchsorted(row, at + q - 1, "right")
        return at[whole], which[whole]

    def order(self, counts: dict[tuple[int, int], int]) -> None:
        """Choose each window's prefix token, the rarest of its shingles (ties: the first)."""
        self.by_token: dict[int, list[list[tuple[int, int]]]] = {q: [[] for _ in t] for q, t in self.tokens.items()}
        for w, own in enumerate(self.hashes):
            q = min(self.shingle, len(own))
            which = np.searchsorted(self.tokens[q], shingles(own, q))
            offset = min(range(len(which)), key=lambda o: counts.get((q, int(which[o])), 0))
            self.by_token[q][which[offset]].append((w, offset))
        keep = {q: np.array([bool(x) for x in lists]) for q, lists in self.by_token.items()}
        self.tokens = {q: t[keep[q]] for q, t in self.tokens.items()}
        self.by_token = {q: [x for x in lists if x] for q, lists in self.by_token.items()}

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, row: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, window) for each occurrence, in words of the batch."""
        for q in self.tokens:
            at, which = self.positions(hashes, row, q)
            doc = np.searchsorted(row, at, "right") - 1
            for p, d, lists in zip(at.tolist(), doc.tolist(), (self.by_token[q][k] for k in which.tolist()), strict=True):
                for w, offset in lists:
                    s = p - offset
                    e = s + len(self.hashes[w])
                    if s >= row[d] and e <= row[d + 1] and np.array_equal(hashes[s:e], self.hashes[w]) and spoken(data, starts[s:e], ends[s:e]) == self.said[w]:
                        yield s, e, w


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[tuple[list[str], list[str]]]:
    """The items in blocks of about block_bytes, by a hash of the id."""
    slim = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).cast("string").alias("t")).where("t is not null")
    total = slim.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = -(-total // block_bytes)
    for k in range(n):
        rows = slim.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()
        yield [r.i for r in rows], [r.t for r in rows]


def _counted(docs: DataFrame, text: str, windows: Windows) -> dict[tuple[int, int], int]:
    """How often each token of the windows occurs in all documents."""
    schema = T.StructType([long_field("q"), long_field("k"), long_field("n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {q: np.zeros(len(t), np.int64) for q, t in windows.tokens.items()}
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in slices(offsets):
                hashes, row = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[2:]
                for q in total:
                    total[q] += np.bincount(windows.positions(hashes, row, q)[1], minlength=len(total[q]))
        for q, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), q)), pa.array(k), pa.array(n[k])], names=schema.names)

    rows = docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, schema).groupBy("q", "k").agg(F.sum("n").alias("n")).collect()
    return {(r.q, r.k): r.n for r in rows}


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


_FIELDS = [long_field("n_words"), T.StructField("hit_spans", _HIT), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())]


def mark_contaminated(docs: DataFrame, items: DataFrame, *, width: int = WIDTH, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, hit_spans (word ranges covered by item windows), item_ids (sorted as strings) and contaminated.

    A null text has no words, as has a null item; an item id that is null counts as ''. Items without words have no
    windows. Each row is marked by itself, so repeated rows get equal marks. Columns of these names are replaced.
    """
    out = None
    for ids, texts in _blocks(items, item_id, item_text, block_bytes):
        windows = Windows(ids, texts, width, shingle)
        if not windows.hashes:
            continue
        windows.order(_counted(docs, text, windows))
        out = _marked(docs if out is None else out, text, windows, first=out is None)
    return _marked(docs, text, None, first=True) if out is None else out


def _marked(docs: DataFrame, text: str, windows: Windows | None, first: bool) -> DataFrame:
    """Mark with one block of windows, on top of what earlier blocks have marked."""

    def fn(batch: pa.RecordBatch) -> dict:
        data, offsets = utf8(batch.column(text).cast(pa.string()))
        n = len(offsets) - 1
        counts = np.zeros(n, np.int64)
        spans: list[list] = [[] for _ in range(n)]
        found: list[set] = [set() for _ in range(n)]
        if not first:
            spans = [[(x["s"], x["e"]) for x in v] for v in batch.column("hit_spans").to_pylist()]
            found = [set(v) for v in batch.column("item_ids").to_pylist()]
        for lo, hi in slices(offsets):
            part = data[offsets[lo] : offsets[hi]]
            starts, ends, hashes, row = words(part, offsets[lo : hi + 1] - offsets[lo])
            counts[lo:hi] = np.diff(row)
            for s, e, w in windows.matches(part, starts, ends, hashes, row) if windows else ():
                d = int(np.searchsorted(row, s, "right")) - 1
                spans[lo + d].append((s - int(row[d]), e - int(row[d])))
                found[lo + d] |= windows.items[w]
        spans = [_merge(x) for x in spans]
        return {"n_words": pa.array(counts), "hit_spans": pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], _ARROW), "item_ids": pa.array([sorted(x) for x in found], pa.list_(pa.string())), "contaminated": pa.array([bool(x) for x in spans])}

    return map_batches(docs, fn, _FIELDS)


_ARROW = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mark_contaminated(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["e"] - x["s"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS k, least(10, len(w)) AS n
  FROM bw, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p) WHERE len(w) > 0
), dg AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS k
  FROM dw, (SELECT DISTINCT n FROM win) l, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS p)
), hit AS (
  SELECT doc_id, p, n, item_id FROM dg JOIN win USING (k, n)
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit)) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
