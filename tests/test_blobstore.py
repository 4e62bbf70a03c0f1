"""The store object: what is put is found, whatever happens between."""

import glob
import logging
import os
import shutil
import threading
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slabwise import blobstore, config, recover
from slabwise.blobstore import Store
from slabwise.functions import columns as K
from slabwise.operators import bloom


def options(**more):
    return config.StoreConfig(**{"bloom_keys": 1000, "flush_concurrency": 2, "segment_bytes": 1 << 16, "slab_bytes": 1 << 14, "large_threshold": 1 << 13} | more)


def rows(spark, blobs):
    return spark.createDataFrame([(k.encode(), v) for k, v in blobs.items()], "key binary, value binary")


def keys(spark, *names):
    return spark.createDataFrame([(n.encode(),) for n in names], "key binary")


def found(store, spark, *names):
    return {bytes(r.key).decode(): bytes(r.value) if r.found else None for r in store.get(keys(spark, *names)).collect()}


def test_puts_are_read_overwritten_and_still_there_after_a_restart(spark, tmp_path):
    blobs = {f"key-{i}": bytes((i + j) % 256 for j in range(n)) for i, n in enumerate([1024, 5000, 20_000, 999, 0, 4096])}
    with Store(spark, str(tmp_path), options(shards=2)) as store:
        assert not any(found(store, spark, "key-0").values())
        store.put(rows(spark, blobs))
        assert found(store, spark, *blobs, "miss") == blobs | {"miss": None}
        store.put(rows(spark, {"key-1": b"value-v2"}))
        assert found(store, spark, "key-1") == {"key-1": b"value-v2"}
        assert store.size == sum(map(len, blobs.values())) - 5000 + 8
        assert store.stats().first().blob_count == 6
        lengths = store.view(keys(spark, *blobs), lambda bs: (pa.RecordBatch.from_arrays([pa.array([len(v.as_py()) for v in b.column(3)], pa.int64())], names=["n"]) for b in bs), "n long")
        assert lengths.agg(F.sum("n")).first()[0] == store.size
    store.close()
    with pytest.raises(ValueError, match="closed"):
        store.put(rows(spark, blobs))
    assert sorted(os.listdir(tmp_path / "segments")) == ["0000", "0001"] and (tmp_path / ".initialized").exists()
    with Store(spark, str(tmp_path), options(shards=2)) as store:
        assert found(store, spark, *blobs) == blobs | {"key-1": b"value-v2"} and store.size > 0


@pytest.mark.parametrize("policy", ["fifo", "sieve"])
def test_eviction_keeps_the_limit(spark, tmp_path, policy):
    with Store(spark, str(tmp_path), options(max_size=20 << 10, policy=policy, bloom_keys=0)) as store:
        for part in range(3):
            if part == 2:
                assert found(store, spark, "k-0")["k-0"]
            store.put(rows(spark, {f"k-{part * 8 + i}": bytes(1024) for i in range(8)}))
        assert store.size <= 20 << 10 and store.index().count() == store.size >> 10
        left = found(store, spark, *(f"k-{i}" for i in range(24)))
        assert sum(v is not None for v in left.values()) == store.size >> 10
        assert {k for k, v in left.items() if v is None} <= {f"k-{i}" for i in range(policy == "sieve", 8)}
        assert store.evict() == {"victims": 0, "bytes": 0, "punchable": 0}
        store.put(rows(spark, {"small": b"x"}))
        assert found(store, spark, "small")["small"] == b"x"


def test_the_filter_is_rebuilt_when_stale(spark, tmp_path):
    with Store(spark, str(tmp_path), options(bloom_keys=0)) as store:
        store.put(rows(spark, {f"k-{i}": b"v" for i in range(30)}))
        store._delete(store.index().limit(10))
        assert store.rebuild_due()
        store.rebuild_bloom()
        assert not store.rebuild_due() and store.deleted == 0 and store.index().count() == 20


def test_degraded_store_serves_its_newest_batches(spark, tmp_path):
    with Store(spark, str(tmp_path), options(degraded_keep_batches=2)) as store:
        store.put(rows(spark, {"old": b"durable"}))

        def fail(step):
            if step == "write":
                raise OSError(28, "no space")

        store.fault = fail
        for i in range(4):
            store.put(rows(spark, {f"new-{i}": b"%d" % i, "same": b"%d" % i}))
        store.fault = lambda step: None
        store.report(RuntimeError("later"))
        assert store.degraded and isinstance(store.error, OSError) and len(store.pending) == 2
        assert found(store, spark, "old", "new-0", "new-1", "new-2", "new-3", "same") == {"old": b"durable", "new-0": None, "new-1": None, "new-2": b"2", "new-3": b"3", "same": b"3"}


def test_lost_files_are_misses_and_heal(spark, tmp_path):
    with Store(spark, str(tmp_path), options()) as store:
        store.put(rows(spark, {"healing-key": b"v"}))
        store.put(rows(spark, {"other": b"w"}))
        lost = glob.glob(f"{tmp_path}/segments/*/*.seg")[0]
        os.remove(lost)
        assert store.missing_segments().count() == 1
        assert list(found(store, spark, "healing-key", "other").values()).count(None) == 1
        assert (store.deleted, store.ghosts, store.hits) == (1, 1, 2) and store.missing_segments().count() == 0 and store.size == 1


def test_ghost_keys_are_counted(spark, tmp_path):
    with Store(spark, str(tmp_path), options()) as store:
        ghost = keys(spark, "ghost-key").withColumn("h", F.xxhash64("key").bitwiseAND(F.lit((1 << 63) - 1)))
        store.filter = bloom.merge(store.filter, bloom.build(ghost, "h", store.geometry))
        assert found(store, spark, "ghost-key") == {"ghost-key": None} and (store.hits, store.ghosts) == (1, 1)
        store.filter._slabwise_path = str(tmp_path / "none")


@pytest.mark.parametrize("own", [None, lambda v: F.crc32(F.reverse(v.cast("string")).cast("binary"))])
def test_checksums_are_verified_on_read(spark, tmp_path, own):
    with Store(spark, str(tmp_path), options(checksum=True, verify=True, checksum_of=own, key_hash=K.portable_hash)) as store:
        store.put(rows(spark, {"a": b"hello world", "b": b"bye"}))
        wrong = rows(spark, {"c": b"test"}).withColumn("checksum", F.lit(zlib.crc32(b"test") ^ 1))
        store.put(wrong)
        assert found(store, spark, "a", "b", "c") == {"a": b"hello world", "b": b"bye", "c": None}


def test_compaction_puts_live_blobs_again(spark, tmp_path):
    with Store(spark, str(tmp_path), options(flush_concurrency=1)) as store:
        store.put(rows(spark, {f"k-{i}": bytes([i]) * 100 for i in range(12)}))
        store.put(rows(spark, {f"k-{i}": bytes([i]) * 100 for i in range(11)}))
        assert len(store.compact()) == 1 and store.compact() == []
        assert len(glob.glob(f"{tmp_path}/segments/*/*.seg")) == 2
        assert found(store, spark, "k-11", "k-3") == {"k-11": bytes([11]) * 100, "k-3": bytes([3]) * 100}
        gone = store.index().groupBy("segment_id").count().where("count = 1").first().segment_id
        assert store.delete_segment(gone) == 1 and found(store, spark, "k-11") == {"k-11": None}


def test_recovery(spark, tmp_path, capsys):
    blobs = {f"key{i}": b"value%d" % i for i in range(30)}
    with Store(spark, str(tmp_path), options()) as store:
        store.put(rows(spark, blobs))
        store.put(rows(spark, {"key3": b"newer"}))
    shutil.rmtree(tmp_path / "index")
    (tmp_path / "segments/0000/invalid.seg").write_bytes(b"garbage")
    assert recover.main(["--path", str(tmp_path)]) == 1 and recover.main(["--recover"]) == 1
    assert recover.main(["--recover", "--path", str(tmp_path / "nowhere")]) == 1
    assert blobstore.recover(spark, str(tmp_path)) == {"valid": 3, "corrupt": 1, "recovered": 30}
    with Store(spark, str(tmp_path), options()) as store:
        assert found(store, spark, *blobs) == blobs | {"key3": b"newer"}
        store.put(rows(spark, {"key4": b"again"}))
        assert found(store, spark, "key4", "key5") == {"key4": b"again", "key5": b"value5"}
    for f in glob.glob(f"{tmp_path}/segments/*/*.seg"):
        os.truncate(f, 10)
    assert blobstore.recover(spark, str(tmp_path)) == {"valid": 0, "corrupt": 5, "recovered": 0}


def test_the_log_is_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blobstore, "MERGE_AFTER", 2)
    with Store(spark, str(tmp_path), options()) as store:
        for i in range(4):
            store.put(rows(spark, {"same": b"%d" % i, f"k-{i}": b"v"}))
        assert len(store._batches()) <= 2
        assert found(store, spark, "same", "k-0") == {"same": b"3", "k-0": b"v"}


def test_worker_and_stream(spark, tmp_path, caplog):
    caplog.set_level(logging.ERROR, "slabwise")
    with Store(spark, str(tmp_path / "s"), options(max_size=50)) as store:
        rows(spark, {f"k-{i}": bytes(10) for i in range(5)}).write.parquet(str(tmp_path / "in"))
        q = store.ingest(spark.readStream.schema("key binary, value binary").parquet(str(tmp_path / "in")), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
        assert store.size == 50
        object.__setattr__(store.config, "max_size", 20)
        stop, trigger = threading.Event(), threading.Event()
        t = threading.Thread(target=store.work, args=(stop, 60.0, trigger))
        t.start()
        trigger.set()
        while store.size > 20 and t.is_alive():
            stop.wait(0.1)
        stop.set()
        t.join(30)
        assert store.size <= 20 and not caplog.records


def test_long_segments_are_parts_that_tasks_write_side_by_side(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(config, "PART_BYTES", 10_000, raising=False)
    blobs = {f"k-{i}": bytes((i + j) % 256 for j in range(n)) for i, n in enumerate([700, 0, 3000, 4096, 1, 25_000] * 8)}
    with Store(spark, str(tmp_path), options(flush_concurrency=1, slab_bytes=1 << 15, segment_bytes=1 << 40, large_threshold=20_000)) as store:
        store.put(rows(spark, blobs))
        place = {r.key_hash: (r.segment_id, r.pos, r.size) for r in store.index().collect()}
        (segment,) = {seg for seg, _, _ in place.values()}
        parts = glob.glob(f"{tmp_path}/segments/*/{segment}.*.part")
        assert len(parts) > 10 and max(map(os.path.getsize, parts)) < 10_000 + 25_000 and store.files().count() == 1
        ends = sorted((pos, pos + size) for _, pos, size in place.values() if size)
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False)) and ends[-1][1] > 200_000
        assert found(store, spark, *blobs) == blobs
        assert [r.status for r in blobstore.segfile.footers(store.files()).collect()] == ["valid"]
        store.put(rows(spark, {k: v for k, v in blobs.items() if k not in ("k-0", "k-1", "k-2")}))
        assert store.compact() == [segment] and not glob.glob(f"{tmp_path}/segments/*/{segment}.*")
        assert found(store, spark, *blobs) == blobs and store.files().count() == 2


def test_lost_files_of_long_segments_heal_and_the_rest_is_recovered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(config, "PART_BYTES", 10_000, raising=False)
    blobs = {f"k-{i}": bytes([i]) * 1500 for i in range(60)}
    with Store(spark, str(tmp_path), options(segment_bytes=1 << 40, bloom_keys=0)) as store:
        store.put(rows(spark, blobs))
        place = {r.key_hash: (r.segment_id, r.pos) for r in store.index().collect()}
        gone, cut = sorted({seg for seg, _ in place.values()})
        assert len(glob.glob(f"{tmp_path}/segments/*/{cut}.*.part")) > 2
        os.remove(f"{tmp_path}/segments/0000/{gone}.seg")
        os.remove(f"{tmp_path}/segments/0000/{cut}.000001.part")
        lost = sum(seg == gone or 10_000 <= pos < 20_000 for seg, pos in place.values())
        got = found(store, spark, *blobs)
        assert (store.hits, store.ghosts, store.deleted, store.size) == (60, lost, lost, (60 - lost) * 1500)
        assert sum(v is None for v in got.values()) == lost and all(v in (None, blobs[k]) for k, v in got.items())
    shutil.rmtree(tmp_path / "index")
    assert blobstore.recover(spark, str(tmp_path)) == {"valid": 1, "corrupt": 0, "recovered": sum(seg == cut for seg, _ in place.values())}
