"""Every query with an oracle gives the rows that DuckDB gives."""

import glob
import os

import pytest

from tagloom import queries as q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def rows(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_fnv(spark):
    from pyspark.sql import functions as F

    from tagloom.functions.text import byte_values, djb2_hex, fnv_hex

    def plain(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    texts = ["", "a", "foobar", "\0", "é", "日本語" * 50, "\uffff𝄞", "z" * 5000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fnv_hex(F.col("t")).alias("h"), byte_values(F.col("t")).alias("b"), djb2_hex(F.col("t")).alias("d")).collect()
    assert [r["h"] for r in rows] == [None if t is None else plain(t) for t in texts]
    assert [r["b"] for r in rows] == [None if t is None else list(t.encode()) for t in texts]
    assert rows[0]["h"] == "cbf29ce484222325" and rows[1]["h"] == "af63dc4c8601ec8c" and rows[0]["d"] == "00001505"


def test_every_query_reads_a_table(spark):
    """No query runs on rows of its own alone: each plan, or a file that it made, comes from the tables."""
    for name in ("list_kinds", "list_languages", "list_maps"):
        plan = q.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" in plan, name


def test_kinds_are_the_languages_own():
    from tagloom.plans.languages import KINDS, kinds_of

    for lang in KINDS:
        letters = [k.letter for k in kinds_of(lang)]
        assert len(set(letters)) == len(letters) and {k.canonical for k in kinds_of(lang)} <= set(letters)
    assert [k.names for k in kinds_of("rust") if k.letter == "c"] == [("impl", "implementation")] and not kinds_of("cobol")


def test_files_made_from_a_small_table_are_dealt_to_many_tasks(spark, monkeypatch):
    from tagloom import session

    cores = spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{SF}/part.parquet").rdd.getNumPartitions() < cores
    assert q.source_files(spark, SF, ["python"]).rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "SPREAD_ROWS", 100)
    files = q.source_files(spark, SF, ["python", "go"])
    parts = files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert len(parts) == max(cores, -(-2 * n // 100)) and sum(parts) == 2 * n and max(parts) < 400


def test_unreadable_files_are_found_by_more_tasks_as_files_grow(spark, monkeypatch, tmp_path):
    from pyspark.sql import functions as F

    from tagloom import session

    part = spark.read.parquet(f"{SF}/part.parquet")
    n, shift = part.count(), part.agg(F.max("p_partkey")).first()[0] + 1
    copies = part.join(spark.range(3).select(F.col("id").alias("copy"))).withColumn("p_partkey", F.col("p_partkey") + F.col("copy") * shift).drop("copy")
    copies.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert q.unreadable_files(spark, SF).rdd.getNumPartitions() == cores
    monkeypatch.setattr(session, "SPREAD_ROWS", n // 4)
    parts = q.unreadable_files(spark, str(tmp_path)).rdd.mapPartitions(lambda rows: [[r["file_name"] for r in rows]]).collect()
    assert len(parts) == -(-3 * n // (n // 4)) > cores and max(map(len, parts)) < n // 4
    want = [f"parts/p{r['p_partkey']}.py" for r in spark.read.parquet(f"{tmp_path}/part.parquet").filter("p_partkey % 3 = 0").select("p_partkey").collect()]
    assert sorted(name for names in parts for name in names) == sorted(want) and len(want) >= n - 1


def test_only_trees_that_are_asked_for_are_made(spark):
    assert {r["lang"] for r in q._tree_nodes(spark, SF, ["kotlin"]).select("lang").distinct().collect()} == {"kotlin"}


def test_plugins_files_are_dealt_to_many_tasks_and_start_no_threads(spark, monkeypatch):
    import threading

    from tagloom.extract.base import Options, Source
    from tagloom.extract.sandbox import PluginProcess

    assert q.isolated_plugins(spark, SF).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(threading.Thread, "start", lambda self: 1 / 0)
    plugin = PluginProcess(q.ODD_MODULE)
    try:
        # more than a pipe holds, both ways
        long = "define " + "é" * 300_000
        [tag] = plugin.extract(Source(long), Options())
        assert tag.name == "_" * 300_000
        assert [t.name for t in plugin.extract(Source("define a b"), Options())] == ["a_b"]
    finally:
        plugin.close()
