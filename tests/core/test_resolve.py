"""Resolution of calls that may mean many targets."""

import glob

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from basaltic.operators import resolve
from basaltic.plans import registry


@pytest.fixture(scope="module")
def hot_tables(tmp_path_factory):
    """500 calls of a name with 300 targets; beside them calls in several rows, whose least
    names and suppliers count, names without targets, and null and negative keys."""
    root = tmp_path_factory.mktemp("hot")
    lines = [(i, 1, 0, 100 + i % 3) for i in range(500)]
    lines += [(900, 2, p, s) for p, s in ((9, 102), (10, 101), (59, 100))] + [(901, 1, p, 3) for p in (2, 1, 19)]
    lines += [(902, 1, 58, 100), (903, 1, None, 100), (904, 1, -7, 101), (904, 1, -12, 102), (905, 1, 57, 7), (906, 1, 0, 777)]
    parts = [1425 * i for i in range(300)] + [1, 2, 42, 10, 35, -7, -12, None, 1, 1]
    suppliers = [(100, 0), (101, 10), (102, 0), (3, 1), (7, None)]
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    pq.write_table(pa.table({c: pa.array([r[i] for r in lines], pa.int64()) for i, c in enumerate(columns)}), root / "lineitem.parquet")
    pq.write_table(pa.table({"p_partkey": pa.array(parts, pa.int64())}), root / "part.parquet")
    pq.write_table(pa.table({"s_suppkey": pa.array([s for s, _ in suppliers], pa.int64()), "s_nationkey": pa.array([n for _, n in suppliers], pa.int32())}), root / "supplier.parquet")
    return root


@pytest.mark.parametrize("name", ["confidence_counts", "tiered_resolution"])
def test_hot_names(spark, hot_tables, name):
    """The results of the SQL, and no scratch table with a row for each pair of call and target."""
    scratch = spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/basaltic/*/*.parquet"
    before = set(glob.glob(scratch))
    df = registry.queries()[name](spark, str(hot_tables))
    columns = df.columns
    got = sorted(map(repr, map(tuple, df.collect())))
    kept = sum(pq.ParquetFile(f).metadata.num_rows for f in set(glob.glob(scratch)) - before)
    con = duckdb.connect()
    for t in ("lineitem", "part", "supplier"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{hot_tables}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, want))
    assert kept <= 506  # calls


def test_blocks(spark, monkeypatch):
    """All targets of a key with several blocks, each once; the first step that finds any wins."""
    monkeypatch.setattr(resolve, "BLOCK", 4)
    index = spark.createDataFrame([("a", "x", f"d{i % 50}") for i in range(100)] + [("b", "x", "e")], "file_id string, name string, dst string")
    calls = spark.createDataFrame([(1, "a", "x", None), (2, "b", "x", None), (3, "c", "x", "r"), (4, "c", "x", None), (5, None, "y", "r")], "call_id long, file_id string, name string, receiver string")
    steps = [resolve.Step("file", ["file_id", "name"], index), resolve.Step("proj", ["name"], index.where("dst = 'd1'"), "receiver is not null"), resolve.Step("proj", ["name"], index)]
    found = resolve.candidates(resolve.judged(resolve.placed(calls, steps)), steps, "tier", "n", "confidence", "ambiguous").collect()
    rows = sorted(map(tuple, found))
    fifty = [f"d{i}" for i in range(50)]
    want = [(1, d, "file", 50, "inferred", True) for d in fifty] + [(2, "e", "file", 1, "certain", False), (3, "d1", "proj", 1, "inferred", False)]
    want += [(4, d, "proj", 51, "inferred", True) for d in [*fifty, "e"]] + [(5, "unresolved:y", "none", 1, "unresolved", False)]
    assert rows == sorted(want)


def test_many_edges_are_spread(spark, monkeypatch):
    """Calls of one file are dealt out so that no task makes most of the edges; few are left."""
    calls = spark.range(0, 1000, 1, 1).selectExpr("id AS call_id", "300L AS n")
    assert resolve.spread(calls).rdd.getNumPartitions() == 1
    monkeypatch.setattr(resolve, "TASK_EDGES", 10_000)
    by_task = resolve.spread(calls).rdd.mapPartitions(lambda rows: [sum(r.n for r in rows)]).collect()
    assert len(by_task) == 30 and sum(by_task) == 300_000
    assert max(by_task) < 30_000
