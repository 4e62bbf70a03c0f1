"""Behaviour of the blob-store operators on small fixtures."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from slabwise import config as C
from slabwise.functions import columns as K
from slabwise.operators import bloom, evict, layout, maintain, store
from slabwise.operators.ordered import last_before, running
from slabwise.sources import compression, corpus, segfile
from slabwise.streaming import ingest


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_put_and_overwrite(spark):
    t = spark.createDataFrame([(f"key-{i}".encode(), i, f"value-{i}-data".encode()) for i in range(1000)], "key binary, seq long, value binary")
    t = store.put(t, spark.createDataFrame([(b"key-7", 5000, b"value-v2")], t.schema))
    got = {bytes(r.key): bytes(r.value) for r in t.collect()}
    assert len(got) == 1000 and got[b"key-7"] == b"value-v2" and got[b"key-8"] == b"value-8-data"


def test_get_marks_misses(spark):
    t = spark.createDataFrame([("a", 1)], "key string, size long")
    asked = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    assert sorted((r.key, r.found) for r in store.get(asked, t).collect()) == [("a", True), ("a", True), ("b", False)]


def test_flags_round_trip(spark):
    rows = [(0xFFFFFFFF, True, 3), (None, False, 0), (0, False, 1), (12345, True, 7)]
    d = spark.createDataFrame(rows, "s long, d boolean, c int").withColumn("f", K.pack_flags(F.col("s"), F.col("d"), F.col("c")))
    for r in d.select("s", "d", "c", K.has_checksum(d.f).alias("has"), K.checksum(d.f).alias("sum"), K.is_deleted(d.f).alias("del"), K.codec(d.f).alias("codec"), K.codec(K.set_codec(d.f, F.lit(2))).alias("c2"), K.is_deleted(K.set_deleted(d.f)).alias("d2")).collect():
        assert (r.has, r["del"], r.codec, r.c2, r.d2) == (r.s is not None, r.d, r.c, 2, True)
        assert r.s is None or r["sum"] == r.s


def test_pages_and_metadata(spark):
    assert [one(spark, K.page_round(F.lit(n).cast("long"))) for n in (0, 1, 4096, 4097)] == [0, 4096, 4096, 8192]
    assert [one(spark, K.metadata_bytes(F.lit(n).cast("long"))) for n in (100, 5000)] == [4096, 200_704]


def test_chunk_keys_sort_as_their_numbers(spark):
    pairs = [(3, 0), (0, 5), (256, 1), (2, 300), (2**62, 7), (2, 2)]
    d = spark.createDataFrame(pairs, "s long, c long").select("s", "c", K.chunk_key(F.col("s"), F.col("c")).alias("k"))
    rows = d.orderBy("k").select("s", "c", K.chunk_of_key(F.col("k")).alias("p"), F.octet_length("k").alias("n")).collect()
    assert [(r.s, r.c) for r in rows] == sorted(pairs) == [tuple(r.p) for r in rows] and {r.n for r in rows} == {16}


@pytest.mark.parametrize("pos,size,want", [(0, 8192, (0, 8192, True)), (100, 4096, (0, 0, False)), (100, 12_000, (4096, 4096, True)), (4096, 4095, (0, 0, False))])
def test_hole_punch_keeps_neighbours(spark, pos, size, want):
    assert tuple(one(spark, K.punchable(F.lit(pos).cast("long"), F.lit(size).cast("long")))) == want


def test_checksums(spark):
    assert one(spark, F.crc32(F.lit(b"hello world"))) == 222957957
    d = spark.createDataFrame([(b"test", zlib.crc32(b"test")), (b"test", 1), (b"", zlib.crc32(b"")), (b"x", None)], "v binary, s long")
    assert [r.verified for r in store.verified(d, d.v, d.s).collect()] == [True, False, True, None]
    with pytest.raises(Exception, match="checksum mismatch"):
        store.verify_or_fail(d, d.v, d.s).collect()


def test_xxh64_seed0(spark):
    import xxhash

    assert one(spark, K.xxh64_seed0(F.lit("abc"))) % (1 << 64) == xxhash.xxh64_intdigest(b"abc")


def test_overlay_and_self_heal(spark):
    layers = spark.createDataFrame([("a", 2, 1, 10), ("a", 0, 2, 20), ("a", 0, 3, 30), ("b", 2, 1, 5)], "key string, layer int, seq long, size long")
    assert sorted((r.key, r.layer, r.size) for r in store.overlay(layers, order=["seq"], keep=["layer", "size"]).collect()) == [("a", 0, 30), ("b", 2, 5)]
    assert [r.key for r in store.self_heal(layers.where("key = 'b'"), spark.createDataFrame([("a",)], "key string"), "key").collect()] == ["b"]


def test_bloom_geometry_and_errors(spark):
    g = bloom.Geometry.of(1_000_000, 0.01)
    assert (g.bits, g.probes, g.blocks) == (11_022_848, 7, 21_529)
    g = bloom.Geometry.of(20_000, 0.01)
    keys = spark.range(20_000).select(F.col("id"), K.portable_hash(F.concat(F.lit("k"), F.col("id"))).alias("h"))
    absent = spark.range(20_000, 60_000).select(F.col("id"), K.portable_hash(F.concat(F.lit("k"), F.col("id"))).alias("h"))
    words = bloom.build(keys, "h", g).cache()
    assert bloom.test(keys, "id", "h", words, g).where("NOT maybe").count() == 0
    assert bloom.test(absent, "id", "h", words, g).where("maybe").count() / 40_000 <= 0.012


def test_bloom_merge_is_union(spark):
    g = bloom.Geometry.of(100, 0.01)
    rows = lambda a, b: spark.range(a, b).select(K.portable_hash(F.col("id").cast("string")).alias("h"))
    merged = bloom.merge(bloom.build(rows(0, 50), "h", g), bloom.build(rows(50, 100), "h", g))
    assert sorted(merged.collect()) == sorted(bloom.build(rows(0, 100), "h", g).collect())


def stepped(entries, hand, needed):
    policy = evict.SieveList()
    for pos, size, seen in entries:
        policy.put(pos, size)
        policy.bit[pos] = seen
    later = [p for p, _, _ in entries if hand is not None and p >= hand]
    policy.hand = later[0] if later else None
    out, freed, size = [], 0, {p: s for p, s, _ in entries}
    while freed < needed and policy.order:
        out.append(policy.evict())
        freed += size[out[-1]]
    return out, dict(policy.bit), policy.hand


@pytest.mark.parametrize("seed", range(6))
def test_sieve_batch_is_the_stepwise_policy(spark, seed):
    r = random.Random(seed)
    entries = [(i, r.randint(1, 9), r.random() < r.choice([0.0, 0.3, 1.0, 0.7])) for i in sorted(r.sample(range(200), r.randint(1, 40)))]
    hand = r.choice([None, 0, 50, 120, 300])
    needed = r.randint(0, sum(s for _, s, _ in entries))
    live = spark.createDataFrame([(p, p // 10, s, v) for p, s, v in entries], "pos long, bucket long, size long, visited boolean")
    victims = evict.sieve(live, needed, "bucket", "pos", hand)
    want, bits, at = stepped(entries, hand, needed)
    assert [x.pos for x in victims.orderBy("ord").collect()] == want
    after = {x.pos: (x.visited, x.is_hand) for x in evict.sieve_after(live, victims, "pos", hand).collect()}
    assert {p: v for p, (v, _) in after.items()} == bits
    if want:
        assert [p for p, (_, h) in after.items() if h] == ([at] if at is not None else [])


def test_sieve_odd_even():
    policy = evict.SieveList()
    for i in range(1000):
        policy.put(i, 1)
    for i in range(0, 1000, 2):
        policy.read(i)
    assert all(policy.evict() % 2 for _ in range(500))


def test_sieve_full_cycle_clears_bits():
    policy = evict.SieveList()
    for i in range(100):
        policy.put(i, 1)
        policy.read(i)
    assert policy.evict() == 0 and not any(policy.bit.values())
    assert [policy.evict() for _ in range(2)] == [1, 2]


def test_sieve_put_replaces():
    policy = evict.SieveList()
    policy.put("a", 5)
    policy.put("a", 7)
    assert policy.total == 7 and policy.order == ["a"] and policy.shrink(5) == ["a"]


def test_fifo_reaches_the_limit(spark):
    live = spark.range(30).select(F.col("id").alias("pos"), F.floor(F.col("id") / 4).alias("bucket"), F.lit(1024).cast("long").alias("size"))
    need = one(spark, evict.need(F.lit(30 * 1024), F.lit(20 * 1024)))
    victims = [r.pos for r in evict.fifo(live, need, "bucket", "pos").orderBy("ord").collect()]
    assert victims == list(range(len(victims))) and (30 - len(victims)) * 1024 <= 20 * 1024
    assert one(spark, evict.need(F.lit(10), F.lit(10))) == 0


def test_running_matches_a_loop(spark):
    r = random.Random(3)
    rows = [(i // 7, i, r.randint(0, 5)) for i in range(100)]
    got = {x.i: x.s for x in running(spark.createDataFrame(rows, "b long, i long, n long"), ["b"], [F.col("i")], {"s": F.col("n")}).collect()}
    total = 0
    for _, i, n in rows:
        assert got[i] == total
        total += n


def test_last_before_carries_over_buckets(spark):
    rows = [("k", 0, 1, 10), ("k", 1, 2, None), ("k", 3, 3, None), ("k", 3, 4, 20), ("k", 4, 5, None), ("j", 0, 6, None)]
    got = {x.o: x.now for x in last_before(spark.createDataFrame(rows, "key string, b long, o long, v long"), "key", "b", [F.col("o")], F.col("v"), "now").collect()}
    assert got == {1: 10, 2: 10, 3: 10, 4: 20, 5: 20, 6: None}


def test_repack_leaves_fewest_chunks(spark):
    i = spark.range(25).select(F.lit(1).cast("long").alias("seg"), "id").unionByName(spark.range(100, 103).select(F.lit(2).cast("long").alias("seg"), "id"))
    gone = i.where("id BETWEEN 0 AND 19 OR seg = 2")
    assert sorted(tuple(r) for r in maintain.repack(i, gone, ["seg", "id"], "seg", ["id"], 10).collect()) == [(1, 0, 5), (2, 0, 0)]


def test_degraded_keeps_newest(spark):
    b = spark.range(20).select(F.floor(F.col("id") / 2).alias("batch"), "id")
    assert sorted({r.batch for r in maintain.retained_batches(b, "batch", 6).collect()}) == [4, 5, 6, 7, 8, 9]
    log = spark.createDataFrame([(3, "c"), (1, "a")], "seq long, error string")
    assert maintain.first_error(log, ["seq"], ["seq", "error"]).collect()[0].error == "a" and not maintain.first_error(log.where("seq > 9"), ["seq"], ["seq"]).collect()


def test_segment_files(spark, tmp_path):
    raw = segfile.encode_segment(777, 5, [[(1, bytes(17), 0)], [(2**64 - 1, bytes(17), 1 << 33)]])
    seg, ctime, records = segfile.read_metadata(io.BytesIO(raw), len(raw), 777)
    assert (seg, ctime, records["pos"].tolist()) == (777, 5, [0, 4096]) and int(records["hash"][1]) == 2**64 - 1
    assert len(segfile.encode_metadata(1, 0, np.zeros(100, records.dtype))) == 4096 and len(segfile.encode_metadata(1, 0, np.zeros(5000, records.dtype))) == 200_704
    for bad, said in ((raw[:10], "too short"), (raw[:-1] + b"x", "magic"), (raw[:8210] + b"?" + raw[8211:], "checksum")):
        with pytest.raises(segfile.SegmentError, match=said):
            segfile.read_metadata(io.BytesIO(bad), len(bad))
    with pytest.raises(segfile.SegmentError, match="named 1"):
        segfile.read_metadata(io.BytesIO(raw), len(raw), 1)


def test_recovery_and_data_source(spark, tmp_path):
    rows = spark.range(40).select(F.floor(F.col("id") / 10).alias("segment_id"), F.lit(0).cast("long").alias("slab"), F.col("id").alias("pos_order"), F.col("id").alias("hash"), F.concat(F.lit("v"), F.col("id")).cast("binary").alias("value"), F.lit(0).cast("long").alias("flags"))
    paths = {r.segment_id: r.path for r in segfile.write_segments(rows, str(tmp_path), 2).collect()}
    open(paths[1], "r+b").truncate(10)
    open(f"{tmp_path}/segments/0000/junk.seg", "wb").write(b"not a segment")
    files = segfile.scan_files(spark, str(tmp_path))
    assert sorted(r.status for r in segfile.footers(files).collect()) == ["corrupt", "corrupt", "valid", "valid", "valid"]
    index = segfile.recovered_index(files, spark.createDataFrame([(0,)], "hash long"))
    assert sorted(r.hash for r in index.collect()) == [h for h in range(1, 40) if h // 10 != 1]
    assert all(bytes(r.value) == f"v{r.hash}".encode() for r in segfile.read_range(index, str(tmp_path), 2).collect())
    spark.dataSource.register(segfile.SegmentDataSource)
    assert spark.read.format("slabwise_segments").load(str(tmp_path)).count() == 30


def test_compression_round_trip(spark):
    d = spark.createDataFrame([(b"abc" * 1000,), (b"",), (None,)], "v binary")
    for codec in ("zstd", "zlib", "lz4", "s2"):
        packed = d.select("v", compression.compress(d.v, codec, "best").alias("p"))
        assert [r.v for r in packed.select(compression.decompress(packed.p, codec).alias("v")).collect()] == [r.v for r in d.collect()]
    with pytest.raises(ValueError):
        compression.compress(d.v, "s3")


def test_records_of_a_long_segment_are_read_by_pieces(spark, tmp_path):
    n = 200_000
    each = np.zeros(n, segfile._RECORD)
    each["hash"], each["pos"] = np.arange(n), np.arange(n) * 3
    raw = segfile.encode_metadata(4, 9, each)
    (tmp_path / "4.seg").write_bytes(raw)
    (tmp_path / "5.seg").write_bytes(raw)
    (tmp_path / "6.seg").write_bytes(raw[:5000] + b"?" + raw[5001:])
    (tmp_path / "7.seg").write_bytes(segfile.encode_segment(7, 9, []))
    batches = list(segfile._record_batches(str(tmp_path / "4.seg")))
    assert len(batches) == 4 and pa.Table.from_batches(batches).column("pos").to_pylist() == list(range(0, 3 * n, 3))
    files = segfile.scan_files(spark, str(tmp_path))
    said = {r.path[-5:]: (r.status, r.n, r.error) for r in segfile.footers(files).collect()}
    assert said["4.seg"] == ("valid", n, None) and said["7.seg"] == ("valid", 0, None)
    assert "named 5" in said["5.seg"][2] and said["6.seg"][2] == "checksum mismatch" and segfile.records(files).count() == n


def test_batches_for_segments_are_bounded_in_bytes(spark, tmp_path):
    b = pa.RecordBatch.from_pylist([{"physical_size": n} for n in [1 << 20] * 10 + [9 << 20, 1] + [0] * 300])
    sizes = [sum(x.column(0).to_pylist()) for x in segfile._slices(b)]
    assert sum(sizes) == 19 * (1 << 20) + 1 and sorted(sizes)[-2] <= 4 << 20 and max(x.num_rows for x in segfile._slices(b)) <= 256
    kept = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = spark.range(4).select(F.lit(0).cast("long").alias("segment_id"), F.lit(0).alias("slab"), F.col("id").alias("pos_order"), F.col("id").alias("hash"), F.lit(b"v").alias("value"), F.lit(0).cast("long").alias("flags"), F.col("id").alias("pos"), F.lit(1).cast("long").alias("physical_size"))
    for plan in (lambda: segfile.write_segments(rows, str(tmp_path)), lambda: segfile.read_range(rows.select("segment_id", "pos", "physical_size"), str(tmp_path)), lambda: layout.packed(rows.select("slab", "hash", "physical_size"), "slab", ["hash"], 8, "physical_size")):
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        plan()
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", kept)


def test_batches_for_compression_are_bounded_in_bytes(spark):
    kept = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    try:
        d = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("x"), 8000).cast("binary").alias("v"))
        compression.compress(d.v)
        rows = F.pandas_udf(lambda v: v.map(lambda _: len(v)), "long")
        assert d.select(rows("v").alias("n")).agg(F.max("n")).first()[0] < 1000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", kept)


def test_packing_and_rotation(spark):
    d = spark.range(20).select(F.lit(0).alias("w"), "id", F.lit(102_400).cast("long").alias("size"))
    p = layout.packed(d, "w", ["id"], 524_288)
    assert [r.slab for r in p.orderBy("id").collect()] == [i // 5 for i in range(20)]
    slabs = p.groupBy("w", "slab").agg(F.sum("size").alias("bytes"))
    assert [r.segment for r in layout.rotated(slabs, "w", 1 << 20).orderBy("slab").collect()] == [0, 0, 0, 1]


def test_stream_replay_equals_batch(spark, tmp_path):
    ops = corpus.ops(spark, "/root/testdata/sf0.001").select((F.xxhash64("key") % 2).cast("int").alias("shard"), "ts", "seq", "op", "key", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    ops.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "in"))
    q = ingest.sieve_stream(s, 200_000).writeStream.format("memory").queryName("victims").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.table("victims").collect())
    want = []
    for shard in {r.shard for r in ops.select("shard").distinct().collect()}:
        policy = evict.SieveList()
        for r in ops.where(F.col("shard") == shard).orderBy("ts", "seq").collect():
            if r.op == "get":
                policy.read(r.key)
            else:
                policy.put(r.key, r.size)
                want += [(shard, r.seq, v) for v in policy.shrink(200_000)]
    assert got == sorted(want) and got


def test_workload_mix(spark):
    w = corpus.generated_workload(spark, 5000)
    n = {r.op: r["count"] for r in w.groupBy("op").count().collect()}
    assert 400 < n["put"] < 600 and w.where("key LIKE 'miss-%'").count() > 2000


def test_config_rejects_nonsense():
    for bad in ({"policy": "lru"}, {"shards": 0}, {"bloom_fp_rate": 0.0}, {"max_size": -1}):
        with pytest.raises(ValueError):
            C.StoreConfig(**bad)
