from datetime import timedelta

import pytest

from lodestar.operators.search import DimensionMismatch
from lodestar.sources.store import EmptyCommit, Keys, Store, StoreError, build_params
from lodestar.streaming.ingest import OPERATIONS, apply_batch, start

OTHER = ("other", [0.0, 1.0], {})


@pytest.fixture
def index(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    store.create_bucket("b")
    store.create_index("b", "i", 2, "COSINE")
    return store.index("b", "i")


def shown(index, x="x"):
    return sum(r["id"] == x for r in index.query([1.0, 0.0], 100).collect())


def put(index, n="1"):
    index.put([("x", [1.0, 0.0], {"n": n})])


def commit(index):
    index.put([OTHER])
    return index.commit()


def test_visibility(index):
    put(index)
    assert (shown(index), index.get("x")["found"]) == (0, False)
    commit(index)
    assert (shown(index), index.get("x")["found"]) == (1, True)
    put(index, "2")
    commit(index)
    assert shown(index) == 2 and index.get("x")["attributes"] == {"n": "1"}  # the oldest
    index.delete(["x", "never seen"])
    assert (shown(index), index.get("x")["found"]) == (0, False)
    with pytest.raises(EmptyCommit):
        index.commit()
    commit(index)
    assert shown(index) == 0 and index.staged() is None
    put(index)
    commit(index)
    assert (shown(index), index.get("x")["found"]) == (1, False)  # seen by queries, its first match is still dead
    assert index.stats()["vector_count"] == 7 and index.manifest()["version"] == 4
    assert index.rows(version=1).count() == 2


@pytest.mark.parametrize("first", ["put", "delete"])
def test_delete_reaches_the_segment_of_its_commit(index, first):
    (put(index), index.delete(["x"])) if first == "put" else (index.delete(["x"]), put(index))
    commit(index)
    assert shown(index) == 0


def test_failed_commit_loses_the_buffer_and_keeps_deletes(index):
    put(index)
    commit(index)
    index.delete(["x"])
    index.put([("y", [1.0, 0.0], {})])

    def fail(phase):
        if phase == "catalog":
            raise OSError(phase)

    with pytest.raises(OSError):
        index.commit(fail=fail)
    assert index.pending() == 0 and shown(index) == 0 and shown(index, "y") == 0 and index.manifest()["version"] == 1
    commit(index)
    assert shown(index) == 0 and index.staged() is None


def test_filters_ties_promoted_keys_and_empty_index(index):
    assert index.query([1.0, 0.0]).count() == 0 and index.get("x")["found"] is False
    index.put([(f"v-{n:02d}", [1.0, float(n % 3)], {"c": "ABC"[n % 3]} if n % 4 else {}) for n in range(24)])
    index.commit(promote=["c"])
    got = index.query([1.0, 0.0], 5, {"$not": {"c": "A"}}).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: (-r["score"], r["id"]))] == ["v-00", "v-12", "v-01", "v-04", "v-07"]
    assert "attr_c" in index.query([1.0, 0.0], 5, {"c": "B"})._jdf.queryExecution().toString()
    assert [r["ordinal"] for r in index.rows().orderBy("id").collect()] == list(range(24))
    with pytest.raises(DimensionMismatch):
        index.query([1.0])
    with pytest.raises(StoreError):
        index.query([1.0, 0.0], 0)
    assert set(index.strategy({"c": "A"}, cap=2).values()) == {"scan"} and set(index.strategy({"c": "A"}, cap=3).values()) == {"posting"}


def test_zero_vectors_and_limits(index):
    index.put([("zero", [0.0, 0.0], {}), OTHER])
    index.commit()
    assert [r["id"] for r in index.query([1.0, 0.0]).collect()] == ["other"]
    for bad in ([], [("", [1.0, 0.0], {})], [("x", [1.0, 0.0], {"k": None})]):
        with pytest.raises(StoreError):
            index.put(bad)
    with pytest.raises(DimensionMismatch):
        index.put([("x", [1.0], {})])


def test_lifecycle(index):
    store = index.store
    put(index)
    commit(index)
    index.delete(["x"])
    with pytest.raises(StoreError, match="bucket_not_empty"):
        store.delete_bucket("b")
    store.delete_index("b", "i")
    with pytest.raises(StoreError, match="index_in_retention"):
        store.create_index("b", "i", 2, "COSINE")
    store.delete_bucket("b")
    store.restore_index("b", "i")
    assert [x["id"] for x in store.buckets()] == ["b"] and shown(store.index("b", "i")) == 1  # staged deletes are gone
    with pytest.raises(StoreError, match="already_active"):
        store.restore_bucket("b")
    store.delete_index("b", "i")
    store.delete_bucket("b")
    assert store.sweep(timedelta(days=1)) == {"indexes": 0, "buckets": 0, "failed": 0}
    assert store.sweep(timedelta(days=-1)) == {"indexes": 1, "buckets": 1, "failed": 0}
    assert store.buckets() == [] and not index.files.exists(index.base)


def test_names_params_and_keys(index):
    for bad in ("", "-a", "A", "a" * 129):
        with pytest.raises(StoreError):
            index.store.create_bucket(bad)
    assert build_params({"m": 8, "unknown": 1})["m"] == 8 and "unknown" not in build_params({"unknown": 1})
    with pytest.raises(StoreError):
        build_params({"pqSubspaceClusters": 257})
    keys = Keys(lambda s: s[::-1])
    keys.add("k", "s.ecret", "b")
    assert keys.authenticate("Bearer k.s.ecret", "b").bucket == "b"
    for header, bucket, admin, status in [(None, None, False, 401), ("k", None, False, 401), (".x", None, False, 401), ("k.", None, False, 401), ("k.no", None, False, 401), ("k.s.ecret", "c", False, 403), ("k.s.ecret", None, True, 403)]:
        with pytest.raises(StoreError) as e:
            keys.authenticate(header, bucket, admin)
        assert e.value.status == status


def test_stream(spark, index, tmp_path):
    def write(rows):
        spark.createDataFrame(rows, OPERATIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/ops")

    write([("put", "x", [1.0, 0.0], {"n": "1"}), ("put", "y", [0.0, 1.0], None)])
    source = spark.readStream.schema(OPERATIONS).parquet(f"{tmp_path}/ops")
    start(index, source, f"{tmp_path}/ck").awaitTermination()
    assert index.manifest()["version"] == 1 and shown(index) == 1
    write([("delete", "x", None, None), ("put", "z", [1.0, 1.0], {})])
    start(index, source, f"{tmp_path}/ck").awaitTermination()
    assert index.manifest()["version"] == 2 and shown(index) == 0 and shown(index, "z") == 1
    apply_batch(index, spark.read.parquet(f"{tmp_path}/ops"), 1)  # run again: nothing happens
    assert index.manifest()["version"] == 2


def test_replay_after_a_manual_commit(spark, tmp_path):
    """A batch that runs again is known as done, whatever was committed in between."""
    from lodestar.streaming.ingest import OPERATIONS, apply_batch

    store = Store(spark, f"file://{tmp_path}/replay")
    store.create_bucket("b")
    store.create_index("b", "i", 2, "COSINE")
    index = store.index("b", "i")
    batch = spark.createDataFrame([("put", "x", [1.0, 0.0], None)], OPERATIONS)
    apply_batch(index, batch, 5)
    index.put([("y", [0.0, 1.0], None)])
    index.commit()
    apply_batch(index, batch, 5)
    assert index.stats()["vector_count"] == 2


def test_resident_rows_are_read(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/resident")
    store.create_bucket("b")
    store.create_index("b", "i", 2, "COSINE")
    index = store.index("b", "i")
    index.put([("x", [1.0, 0.0], {"a": "1"})])
    index.commit()
    index.cache("RESIDENT")
    plan = index.query([1.0, 0.0], 1)._jdf.queryExecution().executedPlan().toString()
    assert "InMemoryTableScan" in plan
    index.put([("y", [0.0, 1.0], None)])
    index.commit()
    assert {r["id"] for r in index.query([1.0, 0.0], 5).collect()} == {"x", "y"}
    index.cache("MINIMAL")


def test_lost_race_is_told(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/race")
    assert store.files.write_once(f"{tmp_path}/race/m/1.json", {"a": 1}) and not store.files.write_once(f"{tmp_path}/race/m/1.json", {"a": 2})
    assert store.files.read(f"{tmp_path}/race/m/1.json") == {"a": 1} and store.files.names(f"{tmp_path}/race/m") == ["1.json"]


def test_ragged_and_null_vectors(spark):
    from lodestar.operators.search import nearest, search_many

    rows = spark.createDataFrame([("a", "s", 0, [1.0, 0.0]), ("b", "s", 1, [1.0, 0.0, 0.0]), ("c", "s", 2, [1.0]), ("d", "s", 3, None), ("e", "s", 4, [None, 1.0]), ("f", "s", 5, [0.0, 0.0])], "id string, segment_id string, ordinal long, vector array<float>")
    assert [r["id"] for r in nearest(rows, [1.0, 0.0], 5).collect()] == ["a"]
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, vector array<float>")
    assert [r["id"] for r in search_many(rows, queries, 5).where("score is not null").collect()] == ["a"]
