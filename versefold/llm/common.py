"""What several operators share: reading tables, Arrow row mapping, words and hashes in numpy."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import table

__all__ = ["table"]

#: Bytes of text that a numpy step works on at once; one longer text makes a slice of its own.
SLICE = 1 << 20

_U = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a temporary one; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="versefold-"))
    return sc._jsc.sc().getCheckpointDir().get()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def shared_table(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows written as Parquet in the shared folder, and read again."""
    path = path or shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_table(spark: SparkSession, path: str) -> None:
    """Remove a table of shared_table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def with_fields(schema: T.StructType, fields: list[T.StructField]) -> T.StructType:
    """The schema with these fields at the end; one of the same name goes."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + fields)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], fields: list[T.StructField]) -> DataFrame:
    """Rows of df with the columns that fn makes of each Arrow batch; columns of the same names are replaced."""
    schema = with_fields(df.schema, fields)
    keep = [f.name for f in schema.fields[: len(schema.fields) - len(fields)]]
    names = keep + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = fn(batch)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + [made[f.name] for f in fields], names=names)

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, end to end, and n + 1 offsets; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = a.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(a) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(a) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose bytes come to about the limit."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1))
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_TABLES: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    if len(_TABLES.get("up", ())) < n:
        size = max(n, SLICE + 64)
        for key, b in (("up", base), ("down", inverse)):
            p = np.full(size, b, _U)
            p[0] = 1
            _TABLES[key] = np.multiply.accumulate(p)
    return _TABLES["up"], _TABLES["down"]


def _letters() -> np.ndarray:
    if "letters" not in _TABLES:
        _TABLES["letters"] = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
    return _TABLES["letters"]


class Spans:
    """Hashes of any short span of a byte array, from prefix sums.

    A polynomial modulo 2**64 is weak for spans of hundreds of bytes and more, for which texts can be built that collide;
    so it only picks places (k-mers), and whatever tells texts apart uses word_hashes or xxh3.
    """

    def __init__(self, data: np.ndarray):
        self.up, down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum(_letters()[data] * down[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + (end - start).astype(_U))


#: Bytes from which a word is hashed by itself.
_LONG = 256
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], _U)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: eight bytes at a time, each mixed in before the next; long words by xxh3."""
    size = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix((eight[starts] & _KEEP[np.minimum(size, 8)]) + size.astype(_U) * _U(0x9E3779B97F4A7C15))
    live = np.flatnonzero((size > 8) & (size < _LONG))
    at = 8
    while len(live):
        out[live] = mix(out[live] * _U(0xD6E8FEB86659FD93) + (eight[starts[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size >= _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def _lower() -> tuple[np.ndarray, np.ndarray]:
    if "lower" not in _TABLES:
        low = np.arange(256, dtype=np.uint8)
        low[65:91] += 32
        word = np.zeros(256, bool)
        word[48:58] = word[97:123] = word[128:] = True
        _TABLES["lower"] = low, word
    return _TABLES["lower"]


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z lower-cased."""
    return _lower()[0][data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z: starts, ends, 64-bit hashes, and n + 1 word offsets by row."""
    low, word = _lower()
    data = low[data]
    is_word = word[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = is_word
    cut = offsets[:-1][offsets[:-1] < len(data)]
    edge = np.zeros(len(data) + 1, bool)
    edge[cut] = edge[-1] = True
    starts = np.flatnonzero(is_word & (~before[:-1] | edge[:-1]))
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = is_word
    ends = np.flatnonzero(is_word & (~after[1:] | edge[1:])) + 1
    return starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes (k - 1 fewer than there are words)."""
    if len(hashes) < k:
        return np.empty(0, _U)
    n = len(hashes) - k + 1
    out = np.zeros(n, _U)
    for t in range(k):
        out *= _U(0xD6E8FEB86659FD93)
        out += hashes[t : t + n]
    return mix(out + _U(k))


def long_field(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def string_field(name: str) -> T.StructField:
    return T.StructField(name, T.StringType())


def _own(docs: DataFrame, doc_id: str) -> Column:
    """The id as a long where it is a whole number, else as it is."""
    return F.col(doc_id).cast("long") if isinstance(docs.schema[doc_id].dataType, T.IntegralType) else F.col(doc_id)


def with_ids(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (__vf_id, __vf_text) with unique whole ids in document order, and, where doc_id is no unique whole number, the ids of (doc_id, text)."""
    slim = docs.select(_own(docs, doc_id).alias("__vf_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__vf_text"))
    if slim.schema["__vf_id"].dataType == T.LongType() and slim.groupBy("__vf_id").count().where("__vf_id is null or count > 1").isEmpty():
        return slim.where("__vf_id is not null"), None  # as joins ask for: so all uses of the texts share one exchange
    pairs = slim.distinct().repartitionByRange("__vf_id", "__vf_text").sortWithinPartitions("__vf_id", "__vf_text").withColumn("__vf_new", F.monotonically_increasing_id())
    pairs = shared_checkpoint(pairs)
    return pairs.select(F.col("__vf_new").alias("__vf_id"), "__vf_text"), pairs


def named_again(docs: DataFrame, made: DataFrame, pairs: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """docs with what was made of with_ids(docs): rows (__vf_id, __vf_text, ...), a row for each __vf_id."""
    new = [c for c in made.columns if c not in ("__vf_id", "__vf_text")]
    if pairs is None:
        if set(docs.columns) <= {doc_id, text} and dict(docs.dtypes).get(doc_id) == "bigint" and "__vf_text" in made.columns:
            return made.select(*[F.col("__vf_id" if c == doc_id else "__vf_text").alias(c) for c in docs.columns], *new)
        left = docs.withColumn("__vf_of", F.col(doc_id).cast("long"))
        return left.join(made.drop("__vf_text"), F.col("__vf_of") == F.col("__vf_id")).drop("__vf_of", "__vf_id")
    named = pairs.withColumnsRenamed({"__vf_id": "__vf_doc", "__vf_text": "__vf_t"}).join(made.drop("__vf_text"), F.col("__vf_new") == F.col("__vf_id")).drop("__vf_new", "__vf_id")
    left = docs.withColumn("__vf_of", _own(docs, doc_id)).withColumn("__vf_o", F.coalesce(F.col(text).cast("string"), F.lit("")))
    return left.join(named, F.col("__vf_of").eqNullSafe(F.col("__vf_doc")) & (F.col("__vf_o") == F.col("__vf_t"))).drop("__vf_of", "__vf_o", "__vf_doc", "__vf_t")


def bounded_rows(docs: DataFrame, chosen: DataFrame, most_bytes: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct rows (d, t, *chosen but doc_id) of the documents that `chosen` (a table of bounded length) names, most_bytes of text at most.

    Texts are taken in order of a hash of id and text until the bytes are used up; a row that repeats one is left out.
    A text that alone has a sixteenth of the bytes isn't taken. So neither an id that many rows share nor long texts let
    the sample grow.
    """
    extra = [c for c in chosen.columns if c != doc_id]
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).where(F.col("t").isNotNull() & (F.octet_length("t") <= most_bytes // 16))
    rows = rows.join(F.broadcast(chosen), F.col("d") == F.col(doc_id)).drop(doc_id)
    key = F.xxhash64("d", "t")
    # A text has 64 bytes of its own besides, so the rows are bounded too.
    few = rows.groupBy(key.alias("h")).agg(F.first(F.octet_length("t") + 64).alias("n")).orderBy("h").limit(most_bytes // 64)
    till, used = None, 0
    for r in few.toLocalIterator():
        used += r["n"]
        if used > most_bytes:
            till = r["h"]
            break
    if till is not None:
        rows = rows.where(key < till)
    return rows.distinct().select("d", "t", *extra)


def bounded_sample(docs: DataFrame, chosen: DataFrame, most_bytes: int, doc_id: str = "doc_id", text: str = "text") -> list:
    """bounded_rows in order of id and text, in the driver."""
    return sorted(bounded_rows(docs, chosen, most_bytes, doc_id, text).collect(), key=lambda r: (r["d"], r["t"]))
