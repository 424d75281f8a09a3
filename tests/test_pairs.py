import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from reelloom.operators import pairs

KEYS = {"customer": ("c_custkey", "c_nationkey", "c_acctbal"), "supplier": ("s_suppkey", "s_nationkey", "s_acctbal")}
ODD = [None, float("nan"), float("inf"), -float("inf"), 1e19, 2e19, -0.0, 0.0, 0.5, -0.5, -1.0]


def write(folder, name, rows):
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.float64()))]
    pq.write_table(pa.table(dict(zip(KEYS[name], columns))), f"{folder}/{name}.parquet")


def query(spark, folder):
    return __spark_entry__.queries()["disjunctive_join"](spark, str(folder))


@pytest.mark.parametrize("block", [7, 1000])
def test_odd_rows_as_in_sql(spark, tmp_path, monkeypatch, block):
    """Keys repeated with other values, null keys and values, numbers no bigint holds."""
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 500)
    rng = random.Random(1)
    con = duckdb.connect()
    for name, n in (("customer", 400), ("supplier", 120)):
        balance = lambda: rng.choice(ODD) if rng.random() < 0.3 else round(rng.uniform(-60, 60), 2)
        write(tmp_path, name, [(rng.choice([None, *range(n // 2)]), rng.choice([None, 1, 1, 1, *range(2, 40)]), balance()) for _ in range(n)])
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["disjunctive_join"]).fetchall()
    assert sorted(map(tuple, query(spark, tmp_path).collect()), key=repr) == sorted(want, key=repr)


def test_one_value_spreads_over_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 50)
    monkeypatch.setattr(pairs, "TASK_PAIRS", 20_000)
    write(tmp_path, "customer", [(k, 1, k + 0.5) for k in range(2000)])
    write(tmp_path, "supplier", [(k, 1, k + 0.5) for k in range(300)])
    counts = [r["count"] for r in query(spark, tmp_path).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 600_000 and max(counts) < 100_000


def test_no_rows(spark, tmp_path):
    write(tmp_path, "customer", [(1, None, None)])
    write(tmp_path, "supplier", [(1, None, None)])
    assert query(spark, tmp_path).count() == 0
