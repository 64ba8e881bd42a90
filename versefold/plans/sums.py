"""Running sums of doubles that round as those of the queries' SQL do.

DuckDB deals a window's keys to groups by their hash, sorts each group by key and order, and adds up a frame over a tree
of the group's positions: 16 values make a node, 16 nodes a node above. The last bits of a running sum so depend on where in
its group a key's rows lie; from a key's 17th row on they can differ from those of additions in row order. Where a query
takes a remainder of such a sum, a last bit is a jump, so the same additions have to be made.

Measured with DuckDB 2.0.0: its groups follow from the number of rows alone, whatever the threads and the rows' order, as long
as it has enough memory a thread (375 MB for 6,000,000 rows are enough; with 250 MB it makes fewer groups, and other sums).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FANOUT = 16
#: Groups are 16, then 64 and at last 256, as long as they have more rows than this on the average.
GROUP_ROWS, MOST_BITS = 122_880, 8
_FACTOR, _NULL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xBF58476D1CE4E5B9)


def group_bits(rows: int) -> int:
    bits = 4
    while bits < MOST_BITS and rows >> bits > GROUP_ROWS:
        bits += 2
    return bits


def groups(keys: pa.Array, rows: int) -> np.ndarray:
    """The group of each key (long or null) in a table of so many rows."""
    x = np.array(keys.cast(pa.int64()).fill_null(0)).view(np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _FACTOR
    x = np.where(np.asarray(keys.is_null()), _NULL, x ^ (x >> np.uint64(32)))
    bits = group_bits(rows)
    return ((x >> np.uint64(48 - bits)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def _values(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


class TreeSum:
    """The sum of a key's values so far, the first of which is at position `at` of its group.

    A frame is added up from its first values up to a node's start, by nodes of each level upwards and then downwards, to its
    last values. Each level keeps its end (in nodes of that level), the sum up to it, the sum before the level's first node, the
    node above that is being filled, and whether the first of those is whole.
    """

    __slots__ = ("ends", "firsts", "nodes", "sums", "whole")

    def __init__(self, at: int):
        self.ends, self.firsts, self.nodes, self.sums, self.whole = [at], [0.0], [0.0], [0.0], [at % FANOUT == 0]

    def add(self, x: float, level: int = 0) -> float:
        self.ends[level] += 1
        end, total, node = self.ends[level], self.sums[level] + x, self.nodes[level] + x
        if end % FANOUT:
            self.sums[level], self.nodes[level] = total, node
            return total
        above, whole = level + 1, True
        if above == len(self.ends):
            whole = self.whole[level]
            first, start = (self.firsts[level], end // FANOUT - 1) if whole else (total, end // FANOUT)
            for kept, v in ((self.ends, start), (self.firsts, first), (self.nodes, 0.0), (self.sums, first), (self.whole, start % FANOUT == 0)):
                kept.append(v)
        total = self.add(node, above) if whole else self.sums[above]
        self.sums[level], self.nodes[level] = total, 0.0
        return total


def running_sums(rows: DataFrame, key: str, order: list[str], value: str, total: DataFrame, out: str = "sum") -> DataFrame:
    """rows with the sum of value over the key's rows up to each; `total` has one row with the number of rows.

    Groups are sorted by tasks that hold a batch at a time, so memory doesn't grow with a group or a key. A group is one task:
    there are 256 at most, as its sums need the positions of all its keys.
    """
    columns = rows.columns
    dealt = T.StructType([*rows.schema.fields, T.StructField("_group", T.LongType())])
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.DoubleType())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = groups(batch.column(key), batch.column("_rows")[0].as_py())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found)], names=dealt.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, at, last, tree, seen = None, 0, object(), TreeSum(0), False
        for batch in batches:
            sums: list[float | None] = []
            for g, k, x in zip(*(_values(batch.column(c)) for c in ("_group", key, value)), strict=True):
                if g != group:
                    group, at, last = g, 0, object()
                if k != last:
                    last, tree, seen = k, TreeSum(at), False
                at += 1
                seen = seen or x is not None
                made = tree.add(0.0 if x is None else x)
                sums.append(made if seen else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sums, pa.float64())], names=schema.names)

    numbered = rows.crossJoin(F.broadcast(total.toDF("_rows"))).mapInArrow(deal, dealt)
    return numbered.repartition("_group").sortWithinPartitions("_group", F.col(key).asc_nulls_first(), *order).mapInArrow(run, schema)
