"""Line dedup: lines that many documents share stay in one of them only.

Two passes over the texts. The first makes of each document its distinct long line keys, as 128-bit hashes, and
counts documents by hash (partial sums before each shuffle, so a line that a third of the documents share is one row
for each task). The second takes the hashes that are over the threshold, a written table, back to the documents that
hold them; both sides of that join are exchanges of its own, which adaptive execution splits where a key is hot, or
broadcasts where the table has turned out small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import long_field, map_batches, shared_checkpoint, string_field, table

#: What is stripped at both ends of a line.
BLANKS = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCUMENTS = 40, 5

def _key(line: bytes, min_chars: int) -> bytes | None:
    """The hash of a line's key, or None for a short one."""
    key = line.strip(BLANKS).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_keys(docs: DataFrame, min_chars: int, doc_id: str, text: str) -> DataFrame:
    """A row (__vf_doc, _a, _b) for each distinct long line key of each row that has an id."""
    schema = T.StructType([T.StructField("__vf_doc", docs.schema[doc_id].dataType), long_field("_a"), long_field("_b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for i, t in enumerate(batch.column(1)):
                if (b := t.as_buffer()) is not None:
                    found = {k for x in b.to_pybytes().split(b"\n") if len(x) >= min_chars and (k := _key(x, min_chars))}
                    rows.append(np.full(len(found), i, np.int64))
                    keys += found
            if keys:
                ab = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=schema.names)

    return docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id), F.col(text).cast("binary")).mapInArrow(run, schema)


def drop_repeated_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the lines gone that are repeated across documents, and with n_lines (before) and n_dropped.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of min_chars code points or more in
    min_documents documents or more lose all their lines but those of the largest doc_id. A null or empty text is one
    empty line and stays as it is. Rows of one doc_id count as one document. Rows without a doc_id are in no count and
    keep their lines. A doc_id may be of any type that has an order; whole texts count, however long. Columns named n_lines
    and n_dropped are replaced; all others pass through.
    """
    keys = line_keys(docs, min_chars, doc_id, text)
    common = keys.groupBy("_a", "_b").agg(F.count_distinct("__vf_doc").alias("_n"), F.max("__vf_doc").alias("_last")).where(F.col("_n") >= min_documents)
    common = shared_checkpoint(common.select("_a", "_b", "_last"))
    gone = keys.join(common, ["_a", "_b"]).where(F.col("__vf_doc") < F.col("_last"))
    gone = gone.groupBy("__vf_doc").agg(F.collect_set(F.struct("_a", "_b")).alias("__vf_gone"))
    names = docs.columns
    joined = docs.join(gone, docs[doc_id] == gone["__vf_doc"], "left").select(*[docs[c] for c in names], "__vf_gone")

    def fn(batch: pa.RecordBatch) -> dict:
        texts, n_lines, n_dropped = [], [], []
        for t, pairs in zip(batch.column(text), batch.column("__vf_gone"), strict=True):
            b = t.as_buffer()
            lines = (b.to_pybytes() if b is not None else b"").split(b"\n")
            n_lines.append(len(lines))
            if pairs.is_valid:
                ab = np.empty((len(pairs.values), 2), np.int64)
                ab[:, 0], ab[:, 1] = pairs.values.field(0).to_numpy(), pairs.values.field(1).to_numpy()
                out = {x.tobytes() for x in ab}
                kept = [x for x in lines if not (len(x) >= min_chars and (k := _key(x, min_chars)) and k in out)]
                n_dropped.append(len(lines) - len(kept))
                texts.append(b"\n".join(kept))
            else:
                n_dropped.append(0)
                texts.append(None if b is None else b.to_pybytes())
        return {text: pa.array(texts, pa.binary()).cast(pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}

    made = map_batches(joined, fn, [string_field(text), long_field("n_lines"), long_field("n_dropped")])
    return made.select(*[c for c in names if c not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, u.pos AS pos, u.line AS line,
         translate(regexp_replace(u.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(l) AS line, unnest(range(len(l))) AS pos) u
), common AS (
  SELECT k, max(doc_id) AS last_id FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT lines.*, coalesce(doc_id < last_id, false) AS gone FROM lines LEFT JOIN common USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
