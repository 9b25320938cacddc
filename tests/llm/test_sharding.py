"""Operator 8: rows survive whatever their columns are called, writers that die or race, and changed schemas."""

import threading

import pytest

from tagloom.llm import queries, sharding

ROWS = [(i if i % 5 else None, None if i % 7 == 0 else "x" * i, i % 3, f"s{i}") for i in range(60)] + [(1, "x", 1, "s1")] * 3
SCHEMA = "doc_id long, text string, run int, shard string"


@pytest.fixture(scope="module")
def docs(spark):
    # names that an implementation might use itself, and one that needs quotes
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "run as path", "run as _metadata", "shard as `a.b`").coalesce(2)


def key(frame):
    return sorted(map(repr, frame.collect()))


def test_rows_survive(spark, tmp_path, docs):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    assert store.read().count() == 0 and store.compact()["version"] == 0 and store.vacuum() == 0
    for k in range(5):
        store.append(docs.filter(f"coalesce(doc_id, 0) % 5 = {k}").coalesce(1))
    before = store.manifest()
    assert before["version"] == 5 and key(store.read()) == key(docs)
    after = store.compact(target=1 << 20)
    assert after["version"] == 6 and len(store.manifest()["shards"]) < len(before["shards"])
    assert key(store.read()) == key(docs) == key(store.read(5))
    assert store.vacuum() == len(before["shards"]) and key(store.read()) == key(docs) and store.versions() == [6]
    store.append(docs.limit(0))
    assert store.read().count() == len(ROWS)
    with pytest.raises(sharding.Conflict):
        store._commit({"version": 5}, [], after["schema"])
    assert store.read().count() == len(ROWS)


def test_many_runs_keep_to_their_files(spark, tmp_path, docs, monkeypatch):
    monkeypatch.setattr(sharding, "PART_SHARDS", 6)
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    for k in range(12):
        store.append(docs.filter(f"pmod(hash(text, shard), 12) = {k}").coalesce(1))
    size = max(s["bytes"] for s in store.manifest()["shards"])
    done = store.compact(target=3 * size, fanout=2)
    assert done["version"] > 13 and key(store.read()) == key(docs)
    assert len(store.manifest()["shards"]) < 12 and all(p["shards"] <= 6 for p in done["parts"])
    store.compact(target=3 * size, fanout=2)
    assert key(store.read()) == key(docs)


def test_schema_changes_are_refused_and_order_is_not(spark, tmp_path, docs):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(docs)
    for other in (docs.drop("run"), docs.withColumn("more", docs["run"]), docs.withColumn("run", docs["run"].cast("string"))):
        with pytest.raises(ValueError):
            store.append(other)
    store.append(docs.select(*[f"`{c}`" for c in reversed(docs.columns)]))
    assert key(store.read()) == sorted(key(docs) * 2)


def test_a_writer_that_died_blocks_nobody_for_good(spark, tmp_path, docs):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", lock_seconds=1.0)
    store.append(docs)
    (tmp_path / "s/manifests/v000000000002.lock").touch()
    with pytest.raises(sharding.Conflict):
        store._commit(store._head(), [], store._head()["schema"])
    assert store.append(docs)["version"] == 2 and key(store.read()) == sorted(key(docs) * 2)
    assert not list((tmp_path / "s/manifests").glob("*.lock"))


def test_orphans_go_after_a_while(spark, tmp_path, docs):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    store.append(docs)
    docs.write.parquet(f"file://{tmp_path}/s/data/lost")
    assert store.vacuum() == 0 and store.vacuum(grace_seconds=0) >= 1
    assert not list((tmp_path / "s/data/lost").glob("*.parquet")) and key(store.read()) == key(docs)


def test_writers_race(spark, tmp_path, docs):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s", lock_seconds=5.0)
    failed = []

    def write():
        try:
            sharding.ShardStore(spark, f"file://{tmp_path}/s", lock_seconds=5.0).append(docs)
        except Exception as e:
            failed.append(e)

    writers = [threading.Thread(target=write) for _ in range(4)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not failed and store.versions() == [1, 2, 3, 4] and store.read().count() == 4 * len(ROWS)


def test_a_merge_of_replaced_shards_is_a_conflict(spark, tmp_path, docs, monkeypatch):
    store = sharding.ShardStore(spark, f"file://{tmp_path}/s")
    for _ in range(5):
        store.append(docs.coalesce(1))
    runs = sharding.plan(store.manifest()["shards"], 1 << 20)
    schema = store.manifest()["schema"]
    store.compact(target=1 << 20)
    with pytest.raises(sharding.Conflict):
        store._merge(runs, schema, 1 << 20)
    assert key(store.read()) == sorted(key(docs) * 5)


def test_query_merges(spark, tmp_path, monkeypatch):
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t, _, _ in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    seen, compact = [], sharding.ShardStore.compact

    def spy(store, *a, **k):
        seen.append(len(store.manifest()["shards"]))
        out = compact(store, *a, **k)
        seen.append(len(store.manifest()["shards"]))
        return out

    monkeypatch.setattr(sharding.ShardStore, "compact", spy)
    assert queries.op8_sharding(spark, str(tmp_path)).count() == len(ROWS)
    assert seen[0] >= 8 and seen[1] < seen[0]


def test_compaction_plan():
    shards = [{"path": f"p{i}", "bytes": 10} for i in range(10)] + [{"path": "big", "bytes": 95}]
    runs = sharding.plan(shards, 100)
    assert all(sum(s["bytes"] for s in r) <= 100 and "big" not in {s["path"] for s in r} for r in runs)
    assert sum(len(r) for r in runs) == 10 and sharding.plan(shards[:2], 100) == [] and sharding.plan([], 100) == []
