"""Running sums against the sums of DuckDB's windows, bit by bit."""

import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versefold.plans import catalog, sums


def by_duckdb(db, sql):
    return sorted(db.sql(sql).fetchall())


def events(db, users, rows, seed=1):
    """Values are multiples of 0.7, so that one sum in ten is a multiple of 7 but for its last bits."""
    rng = random.Random(seed)
    table = pa.table({"event_id": range(rows), "user_id": [rng.choice(users) for _ in range(rows)], "value": [rng.choice([None, *(round(k * 0.7, 2) for k in range(40))]) for _ in range(rows)]}, schema=pa.schema([("event_id", pa.int64()), ("user_id", pa.int64()), ("value", pa.float64())]))
    db.register("made", table)
    db.execute("CREATE TABLE events AS SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(event_id // 3) AS ts, user_id, 'view' AS event_type, value, '' AS props FROM made")


@pytest.mark.parametrize("users", [[5], [*range(40)], [None, -3, 2**40, -(2**63), 2**63 - 1]])
def test_courtesy_starts_equals_its_sql(spark, tmp_path, users):
    db = duckdb.connect()
    events(db, users, 3000)
    db.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.courtesy_starts(spark, str(tmp_path)).select("event_id", "start_s")
    assert sorted(tuple(r) for r in got.collect()) == by_duckdb(db, f"SELECT event_id, start_s FROM ({catalog.TWINS['courtesy_starts']})")


def test_running_sums_equal_the_windows(spark):
    db = duckdb.connect()
    events(db, [None, *range(7)], 5000)
    want = db.sql("SELECT event_id, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) FROM events").fetchall()
    df = spark.createDataFrame(db.sql("SELECT event_id, user_id, value FROM events").fetchall(), "event_id long, user_id long, value double").repartition(5)
    got = sums.running_sums(df, "user_id", ["event_id"], "value", df.agg(F.count("*")))
    assert got.columns == ["event_id", "user_id", "value", "sum"]
    assert sorted((r.event_id, r["sum"]) for r in got.collect()) == sorted(want)
    assert sums.running_sums(df.limit(0), "user_id", ["event_id"], "value", df.agg(F.count("*"))).count() == 0


@pytest.mark.parametrize("rows", [122_881 * 16 - 1, 122_881 * 16])
def test_groups_double_with_the_rows(rows):
    """Keys of one group, at the numbers of rows where there are more groups."""
    db = duckdb.connect()
    db.execute(f"CREATE TABLE t AS SELECT k, i, (hash(i) % 50000) / 100.0 AS x FROM (SELECT range AS i, (hash(range) % 30000)::BIGINT AS k FROM range({rows}))")
    db.execute("CREATE TABLE s AS SELECT k, i, x, sum(x) OVER (PARTITION BY k ORDER BY i) AS s FROM t")
    keys = pa.array(range(30000), pa.int64())
    mine = [k for k, g in zip(keys.to_pylist(), sums.groups(keys, rows), strict=True) if g == 1]
    last, tree = None, None
    for at, (k, x, s) in enumerate(db.sql(f"SELECT k, x, s FROM s WHERE k IN ({', '.join(map(str, mine))}) ORDER BY k, i").fetchall()):
        if k != last:
            last, tree = k, sums.TreeSum(at)
        assert tree.add(x) == s


def test_group_bits():
    assert [sums.group_bits(n) for n in (0, 1, 122_881 * 16 - 1, 122_881 * 16, 122_881 * 64 - 1, 122_881 * 64, 130_000_000)] == [4, 4, 4, 6, 6, 8, 8]
