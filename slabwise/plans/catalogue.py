"""Registered queries of the blob-store operators, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from slabwise import blobstore
from slabwise.config import StoreConfig
from slabwise.functions import columns as K
from slabwise.operators import bloom, evict, layout, maintain, store
from slabwise.operators.ordered import last_before, running
from slabwise.sources import compression, corpus, segfile
from slabwise.streaming import ingest
from slabwise.tables import drop, scratch, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SLAB, SEGMENT, LARGE, SHARDS, HAND, LIMIT_PERCENT, CHUNK, BATCH = 65_536, 262_144, 16_384, 4, 100, 60, 20, 100
WRITER_DOCS = 1000
FP_RATE = 0.01

IDX = "idx AS (SELECT doc_id, doc_id // 50 AS segment_id, doc_id % 50 // 20 AS chunk, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size, doc_id % 11 = 0 AS deleted, doc_id % 3 = 0 AS visited, doc_id AS ingest_seq FROM documents)"
LIVE = IDX + ", live AS (SELECT * FROM idx WHERE NOT deleted)"
OPS = "ops AS (SELECT event_id AS seq, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 'put' ELSE 'get' END AS op, CASE WHEN event_type = 'error' THEN 'miss-' || event_id ELSE 'u-' || user_id END AS key, CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(floor(value * 1000) AS BIGINT) END AS size FROM events)"
PUTS = OPS + ", puts AS (SELECT * FROM ops WHERE op = 'put'), latest AS (SELECT key, seq, size FROM puts QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, seq DESC) = 1)"
REQ = "req AS (SELECT 'doc-' || doc_id AS key FROM documents UNION SELECT 'miss-' || item_id FROM benchmark)"
HASH = "CAST(('0x' || substr(md5({0}), 1, 15)) AS BIGINT)"
ROUND = "(({0}) + 4095) // 4096 * 4096"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).where(~F.col("deleted"))


def _puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.ops(spark, sf_dir).where("op = 'put'")


def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.newest(_puts(spark, sf_dir), "key", ["ts", "seq"], ["seq", "size"])


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = corpus.table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("key"))
    absent = corpus.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("miss-"), F.col("item_id")).alias("key"))
    return own.unionByName(absent).distinct()


def _numbered_puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts with ``before``, how many came earlier, and ``bytes`` of those."""
    return running(_puts(spark, sf_dir), ["hour"], [F.col("ts"), F.col("seq")], {"before": F.lit(1), "bytes": F.col("size")})


# Keyed reads and writes.


@query(f"WITH {REQ} SELECT req.key, d.doc_id IS NOT NULL AS found, CAST(strlen(coalesce(d.text, '')) * (CASE WHEN d.doc_id IS NULL THEN NULL ELSE 1 END) AS BIGINT) AS size FROM req LEFT JOIN documents d ON req.key = 'doc-' || d.doc_id")
def get_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get(_requests(spark, sf_dir), corpus.blobs(spark, sf_dir).select("key", "size")).select("key", "found", "size")


@query(f"WITH {PUTS} SELECT key, seq, size FROM latest")
def put_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _latest(spark, sf_dir)


_SUPPLIED = "CASE WHEN doc_id % 2 = 0 THEN doc_id * 7919 % 4294967296 END"


@query(f"SELECT 'doc-' || doc_id AS key, doc_id % 2 = 0 AS has_checksum, coalesce({_SUPPLIED}, 4294967296) AS flags FROM documents")
def put_checksummed(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = corpus.blobs(spark, sf_dir).select("key", "seq", "size")
    supplied = F.when(F.col("seq") % 2 == 0, F.col("seq") * 7919 % (1 << 32))
    return store.make_entry(blobs, supplied, F.col("size")).select("key", K.has_checksum(F.col("flags")).alias("has_checksum"), "flags")


@query(f"WITH {IDX} SELECT doc_id, CAST(coalesce(sum(size) OVER (PARTITION BY segment_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos, size, doc_id % 2 = 0 AS has_checksum FROM idx")
def make_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.offsets(corpus.index(spark, sf_dir), ["segment_id"], ["doc_id"])
    supplied = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") * 7919 % (1 << 32))
    return store.make_entry(placed, supplied, F.col("size")).select("doc_id", "pos", "size", K.has_checksum(F.col("flags")).alias("has_checksum"))


@query(f"WITH {IDX} SELECT doc_id, CASE WHEN size > {LARGE} THEN 'large' ELSE 'slab' END AS route FROM idx")
def large_write_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).select("doc_id", layout.route(F.col("size"), LARGE).alias("route"))


@query(f"SELECT doc_id, {HASH.format(chr(39) + 'doc-' + chr(39) + ' || doc_id')} AS key_hash FROM documents")
def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    return d.select("doc_id", K.portable_hash(F.concat(F.lit("doc-"), F.col("doc_id"))).alias("key_hash"))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE doc_id * 7919 % 4294967296 END AS checksum, doc_id % 5 <> 0 AS has_checksum, doc_id % 11 = 0 AS deleted, doc_id % 4 AS codec FROM documents")
def flag_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir)
    kept = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") * 7919 % (1 << 32))
    f = F.col("flags")
    packed = i.select("doc_id", K.pack_flags(kept, F.col("deleted"), F.col("doc_id") % 4).alias("flags"))
    return packed.select("doc_id", K.checksum(f).alias("checksum"), K.has_checksum(f).alias("has_checksum"), K.is_deleted(f).alias("deleted"), K.codec(f).alias("codec"))


@query(f"WITH {IDX} SELECT doc_id, CASE WHEN size = 0 THEN 0.0 ELSE CAST(size * 7 // 8 AS DOUBLE) / size END AS ratio FROM idx")
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir)
    return i.select("doc_id", K.compression_ratio(F.col("size"), F.floor(F.col("size") * 7 / 8)).alias("ratio"))


@query(f"WITH {IDX} SELECT doc_id, CASE WHEN size * (6 + doc_id % 3) // 8 * 8 <= size * 7 THEN 'zstd' ELSE 'none' END AS codec FROM idx")
def compress_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir)
    physical = F.floor(F.col("size") * (6 + F.col("doc_id") % 3) / 8)
    return i.select("doc_id", K.chosen_codec(F.col("size"), physical).alias("codec"))


@query("SELECT lang, codec, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS logical, true AS saves, true AS restored FROM documents, (VALUES ('zstd'), ('zlib'), ('lz4'), ('s2')) t(codec) GROUP BY lang, codec")
def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each language and codec, whether compression saves bytes and gives back what went in."""
    d = corpus.table(spark, sf_dir, "documents").select("lang", F.coalesce("text", F.lit("")).cast("binary").alias("v"))
    packed = d.select("lang", "v", *(compression.compress(F.col("v"), c).alias(c) for c in compression.LEVELS))
    sized = packed.select("lang", F.explode(F.array(*(F.struct(F.lit(c).alias("codec"), F.octet_length("v").cast("long").alias("logical"), F.octet_length(c).cast("long").alias("physical"), (compression.decompress(F.col(c), c) == F.col("v")).alias("same")) for c in compression.LEVELS))).alias("x")).select("lang", "x.*")
    return sized.groupBy("lang", "codec").agg(F.sum("logical").alias("logical"), (F.sum("physical") < F.sum("logical")).alias("saves"), F.bool_and("same").alias("restored"))


@query(f"WITH {IDX} SELECT doc_id, {ROUND.format('size')} AS aligned FROM idx")
def page_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).select("doc_id", K.page_round(F.col("size")).alias("aligned"))


_LAYOUT = f"""{IDX},
slab AS (SELECT segment_id, chunk, {ROUND.format('sum(size)')} AS bytes FROM idx GROUP BY ALL),
start AS (SELECT segment_id, chunk, coalesce(sum(bytes) OVER (PARTITION BY segment_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM slab),
placed AS (SELECT idx.*, CAST(begins + coalesce(sum(size) OVER (PARTITION BY segment_id, chunk ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM idx JOIN start USING (segment_id, chunk))"""


@query(f"WITH {_LAYOUT}, x AS (SELECT *, {ROUND.format('pos')} AS up FROM placed WHERE deleted), y AS (SELECT *, size - (up - pos) AS rest FROM x) SELECT doc_id, CASE WHEN rest >= 4096 THEN up ELSE 0 END AS off, CASE WHEN rest >= 4096 THEN rest // 4096 * 4096 ELSE 0 END AS len, rest >= 4096 AS can_punch FROM y")
def hole_punch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = layout.slab_layout(corpus.index(spark, sf_dir), "segment_id", "chunk", ["doc_id"]).where("deleted")
    return placed.select("doc_id", K.punchable(F.col("pos"), F.col("size")).alias("p")).select("doc_id", "p.*")


@query(f"WITH {IDX} SELECT DISTINCT segment_id, format('segments/{{:04d}}/{{:d}}.seg', segment_id % {SHARDS}, segment_id) AS path FROM idx")
def segment_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).select("segment_id").distinct().select("segment_id", K.segment_path(F.col("segment_id"), SHARDS).alias("path"))


_NAMES = ("12.seg", "0007.seg", "abc.seg", "12x.seg", ".seg", "-3.seg", "99", "")


@query("SELECT name, coalesce(TRY_CAST(regexp_extract(name, '^([+-]?[0-9]+)', 1) AS BIGINT), 0) AS id FROM (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") t(name)")
def segment_id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _NAMES], "name string").select("name", K.segment_id_of(F.col("name")).alias("id"))


@query(f"WITH {IDX} SELECT segment_id, count(*) AS n, {ROUND.format('16 + 40 * count(*) + 20')} AS bytes FROM idx GROUP BY segment_id")
def segment_footer_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).groupBy("segment_id").agg(F.count(F.lit(1)).alias("n")).withColumn("bytes", K.metadata_bytes(F.col("n")))


_ERRORS = ("EINTR", "EAGAIN", "EBUSY", "EMFILE", "ENFILE", "ENOMEM", "ETIMEDOUT", "ENOENT", "EIO", "EACCES", "")


@query("SELECT code, code IN ('EINTR', 'EAGAIN', 'EBUSY', 'EMFILE', 'ENFILE', 'ENOMEM', 'ETIMEDOUT') AS transient FROM (VALUES " + ", ".join(f"('{n}')" for n in _ERRORS) + ") t(code)")
def error_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in _ERRORS], "code string").select("code", K.is_transient(F.col("code")).alias("transient"))


# Index scans and statistics.


@query(f"WITH {LIVE} SELECT doc_id, size FROM live")
def live_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("doc_id", "size")


@query(f"WITH {LIVE} SELECT count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM live")
def open_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


@query(f"WITH {LIVE}, {PUTS} SELECT key, seq, size FROM latest UNION ALL SELECT 'doc-' || doc_id, ingest_seq, size FROM live")
def index_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _live(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("key"), F.col("ingest_seq").alias("seq"), F.lit(None).cast("timestamp").alias("ts"), "size")
    return store.newest(_puts(spark, sf_dir).select("key", "seq", "ts", "size").unionByName(own), "key", ["ts", "seq"], ["seq", "size"])


@query(f"WITH {IDX}, {REQ} SELECT doc_id, segment_id, size FROM req JOIN idx ON req.key = 'doc-' || doc_id WHERE NOT deleted")
def index_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _live(spark, sf_dir).select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("key"), "doc_id", "segment_id", "size")
    return store.get(_requests(spark, sf_dir), keyed).where("found").select("doc_id", "segment_id", "size")


@query(f"WITH {LIVE} SELECT count(*) AS blob_count, count(DISTINCT segment_id) AS segment_count FROM live")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.stats(_live(spark, sf_dir))


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select(K.portable_hash(F.concat(F.lit("doc-"), F.col("doc_id"))).alias("key_hash"), "doc_id")


_HASHED = HASH.format("'doc-' || doc_id")


@query(f"WITH {LIVE} SELECT {_HASHED} AS key_hash, doc_id FROM live ORDER BY 1")
def list_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hashed(spark, sf_dir).orderBy("key_hash")


@query(f"WITH {LIVE} SELECT {_HASHED} AS key_hash, doc_id FROM live ORDER BY 1 LIMIT 100")
def list_blobs_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iteration that its consumer stops after 100 entries."""
    return _hashed(spark, sf_dir).orderBy("key_hash").limit(100)


@query(f"WITH {IDX} SELECT chunk, doc_id FROM idx WHERE segment_id = 3")
def scan_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).where(F.col("segment_id") == 3).select("chunk", "doc_id")


@query(f"WITH {IDX} SELECT segment_id, chunk, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM idx GROUP BY ALL ORDER BY ALL")
def scan_all_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).groupBy("segment_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).orderBy("segment_id", "chunk")


@query(f"WITH {IDX} SELECT segment_id, count(DISTINCT chunk) AS chunks, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM idx GROUP BY ALL")
def list_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = corpus.index(spark, sf_dir).groupBy("segment_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return per.groupBy("segment_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


@query("SELECT conv_id, count(*) AS n, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, md5(coalesce(string_agg(text, chr(10) ORDER BY turn, text), '')) AS digest FROM conversations GROUP BY conv_id")
def segment_reassemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    joined = F.array_join(F.transform(turns, lambda t: t.text), "\n")
    c = corpus.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("bytes"), F.md5(joined).alias("digest"))


def _segment_files(spark: SparkSession, sf_dir: str, base: str) -> DataFrame:
    """Writes the corpus as segment files, a slab for each chunk; (segment_id, path, bytes)."""
    d = corpus.table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rows = d.select(F.floor(i / corpus.SEGMENT_DOCS).alias("segment_id"), F.floor(i % corpus.SEGMENT_DOCS / corpus.CHUNK_DOCS).alias("slab"), i.alias("pos_order"), F.xxhash64("doc_id").alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("value"), F.lit(0).cast("long").alias("flags"))
    return written(segfile.write_segments(rows, base, SHARDS), "files")


@query(f"WITH {IDX} SELECT DISTINCT segment_id FROM idx WHERE segment_id % 2 = 0")
def known_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of the index whose files are there; those with odd numbers are removed before."""
    base = scratch(spark, "known")
    for r in _segment_files(spark, sf_dir, base).where("segment_id % 2 = 1").toLocalIterator():
        drop(spark, r.path)
    there = segfile.scan_files(spark, f"{base}/segments").select(K.segment_id_of(F.element_at(F.split("path", "/"), -1)).alias("segment_id"))
    return corpus.index(spark, sf_dir).select("segment_id").distinct().join(there, "segment_id", "left_semi")


@query(f"WITH {IDX}, slab AS (SELECT segment_id, chunk, {ROUND.format('sum(size)')} AS bytes FROM idx GROUP BY ALL), start AS (SELECT segment_id, chunk, coalesce(sum(bytes) OVER (PARTITION BY segment_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM slab), placed AS (SELECT idx.*, CAST(begins + coalesce(sum(size) OVER (PARTITION BY segment_id, chunk ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM idx JOIN start USING (segment_id, chunk)) SELECT doc_id, pos, md5(coalesce(text, '')) AS digest FROM placed JOIN documents USING (doc_id)")
def read_blob_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each blob by its place in its segment file."""
    base = scratch(spark, "ranges")
    files = _segment_files(spark, sf_dir, base)
    ids = corpus.index(spark, sf_dir).select("doc_id", F.xxhash64("doc_id").alias("hash"))
    entries = segfile.records(files.select("path")).join(ids, "hash").select("doc_id", "segment_id", "pos", "physical_size")
    return segfile.read_range(entries, base, SHARDS).select("doc_id", "pos", F.md5("value").alias("digest"))


@query(f"WITH {IDX} SELECT segment_id, count(*) AS n, md5(string_agg(doc_id || ':' || size, ',' ORDER BY chunk, doc_id)) AS digest FROM idx GROUP BY segment_id")
def segment_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's record from its chunks."""
    whole = layout.segment_records(corpus.index(spark, sf_dir), "segment_id", "chunk", ["doc_id"], ["doc_id", "size"])
    said = F.array_join(F.transform("records", lambda r: F.concat_ws(":", r.doc_id, r["size"])), ",")
    return whole.select("segment_id", F.size("records").cast("long").alias("n"), F.md5(said).alias("digest"))


@query("SELECT doc_id, md5(CASE WHEN doc_id % 13 = 0 THEN coalesce(text, '') || '!' ELSE coalesce(text, '') END) = md5(coalesce(text, '')) AS ok FROM documents")
def verify_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    d = corpus.table(spark, sf_dir, "documents").select("doc_id", F.crc32(text.cast("binary")).alias("kept"), F.when(F.col("doc_id") % 13 == 0, F.concat(text, F.lit("!"))).otherwise(text).cast("binary").alias("value"))
    return store.verified(d, F.col("value"), F.col("kept")).select("doc_id", F.col("verified").alias("ok"))


@query(f"WITH {IDX} SELECT doc_id, size FROM idx WHERE doc_id % 17 <> 0")
def self_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir)
    gone = i.select("doc_id").where(F.col("doc_id") % 17 == 0)
    return store.self_heal(i, gone, "doc_id").select("doc_id", "size")


# Layers, reads and replay.

_LAYERS = PUTS + f", n AS (SELECT *, (row_number() OVER (ORDER BY ts, seq) - 1) // {BATCH} AS batch FROM puts), l AS (SELECT key, ts, seq, size, CAST(least(2, max(batch) OVER () - batch) AS INTEGER) AS layer FROM n), top AS (SELECT key, layer, size FROM l QUALIFY row_number() OVER (PARTITION BY key ORDER BY layer, ts DESC, seq DESC) = 1)"


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts with their layer: 0 the active slab, 1 the one being flushed, 2 the index."""
    p = _numbered_puts(spark, sf_dir).withColumn("batch", F.floor(F.col("before") / BATCH))
    newest = _puts(spark, sf_dir).agg(F.floor((F.count(F.lit(1)) - 1) / BATCH).alias("newest"))
    return p.withColumn("layer", F.least(F.lit(2).cast("long"), newest.scalar() - F.col("batch")).cast("int"))


@query(f"WITH {_LAYERS} SELECT key, layer, size FROM top")
def overlay_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.overlay(_layers(spark, sf_dir), order=["ts", "seq"], keep=["layer", "size"])


def _geometry(keys: DataFrame) -> bloom.Geometry:
    return bloom.Geometry.of(keys.count(), FP_RATE)


def _blocks_sql(keys: str) -> str:
    return f"(SELECT greatest(1, CAST(ceil(floor(ceil(-count(*) * ln({FP_RATE}::DOUBLE) / (ln(2) * ln(2))) * 1.15::DOUBLE) / 512) AS BIGINT)) FROM {keys})"


def _probes_sql(keys: str, built: str, col: str = "key") -> str:
    """Probes of ``keys`` into a filter for as many keys as ``built`` has."""
    h = HASH.format(col)
    low = f"({h} & 4294967295)"
    return f"SELECT {col} AS key, (low * {_blocks_sql(built)} >> 32) * 16 + ((low + i * (((low >> 17) | ((low << 15) & 4294967295)))) & 511) // 32 AS word_idx, CAST(1 AS BIGINT) << CAST((low + i * ((low >> 17) | ((low << 15) & 4294967295))) & 31 AS INTEGER) AS mask FROM (SELECT {col}, {low} AS low, unnest(range({bloom.Geometry.of(1, FP_RATE).probes})) AS i FROM {keys})"


_FILTER = f"docs AS (SELECT 'doc-' || doc_id AS key FROM documents), bloom AS (SELECT word_idx, bit_or(mask) AS word FROM ({_probes_sql('docs', 'docs')}) GROUP BY word_idx)"
_ABSENT = "absent AS (SELECT 'miss-' || item_id AS key FROM benchmark UNION SELECT 'page-' || page_id FROM pages), asked AS (SELECT key FROM docs UNION ALL SELECT key FROM absent)"
_TESTED = _FILTER + ", " + _ABSENT + f", tested AS (SELECT key, bool_and(coalesce(word & mask, 0) <> 0) AS maybe FROM ({_probes_sql('asked', 'docs')}) p LEFT JOIN bloom USING (word_idx) GROUP BY key)"


def _doc_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("doc-"), F.col("doc_id"))
    return corpus.table(spark, sf_dir, "documents").select(key.alias("key"), K.portable_hash(key).alias("h"))


def _asked_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    miss = corpus.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("miss-"), F.col("item_id")).alias("key"))
    page = corpus.table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id")).alias("key"))
    absent = miss.unionByName(page).distinct()
    return _doc_keys(spark, sf_dir).unionByName(absent.select("key", K.portable_hash(F.col("key")).alias("h")))


def _tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _doc_keys(spark, sf_dir)
    g = _geometry(keys)
    return bloom.test(_asked_keys(spark, sf_dir), "key", "h", bloom.build(keys, "h", g), g)


_TIERS = _LAYERS + f", filt AS (SELECT word_idx, bit_or(mask) AS word FROM ({_probes_sql('latest', 'latest')}) GROUP BY word_idx), gets AS (SELECT key, count(*) AS n FROM ops WHERE op = 'get' GROUP BY key), seen AS (SELECT key, bool_and(coalesce(word & mask, 0) <> 0) AS maybe FROM ({_probes_sql('gets', 'latest')}) p LEFT JOIN filt USING (word_idx) GROUP BY key)"


@query(f"WITH {_TIERS} SELECT CASE WHEN NOT maybe THEN 'bloom_reject' WHEN layer < 2 THEN 'memtable' WHEN layer = 2 THEN 'index' ELSE 'ghost' END AS tier, CAST(sum(n) AS BIGINT) AS n FROM gets JOIN seen USING (key) LEFT JOIN top USING (key) GROUP BY 1")
def lookup_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    gets = corpus.ops(spark, sf_dir).where("op = 'get'").groupBy("key").agg(F.count(F.lit(1)).alias("n")).withColumn("h", K.portable_hash(F.col("key")))
    keys = _puts(spark, sf_dir).select("key").distinct().select(K.portable_hash(F.col("key")).alias("h"))
    g = _geometry(keys)
    maybe = bloom.test(gets, "key", "h", bloom.build(keys, "h", g), g)
    top = overlay_lookup(spark, sf_dir).select("key", "layer")
    tier = F.when(~F.col("maybe"), "bloom_reject").when(F.col("layer") < 2, "memtable").when(F.col("layer") == 2, "index").otherwise("ghost")
    return gets.join(maybe, "key").join(top, "key", "left").groupBy(tier.alias("tier")).agg(F.sum("n").alias("n"))


@query(f"WITH {PUTS} SELECT key, key IN (SELECT key FROM ops WHERE op = 'get') AS visited FROM latest")
def mark_visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = corpus.ops(spark, sf_dir).where("op = 'get'")
    return store.visited(_latest(spark, sf_dir), reads).select("key", "visited")


@query(f"WITH {OPS}, r AS (SELECT seq, op, key, last_value(size IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS size FROM ops) SELECT seq, key, size IS NOT NULL AS found, size FROM r WHERE op = 'get'")
def replay_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = last_before(corpus.ops(spark, sf_dir), "key", "hour", [F.col("ts"), F.col("seq")], F.col("size"), "now")
    return seen.where("op = 'get'").select("seq", "key", F.col("now").isNotNull().alias("found"), F.col("now").alias("size"))


@query(f"WITH {IDX} SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN size + 1 ELSE size END AS size FROM idx")
def ingest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir).select("doc_id", F.col("ingest_seq").alias("seq"), "size")
    batch = i.where(F.col("doc_id") % 10 == 0).select("doc_id", (F.col("seq") + (1 << 40)).alias("seq"), (F.col("size") + 1).alias("size"))
    return store.put(i, batch, "doc_id", "seq").select("doc_id", "size")


@query(f"WITH {OPS} SELECT op, count(*) AS n, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM ops GROUP BY op")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = scratch(spark, "stream")
    static = corpus.table(spark, sf_dir, "events")
    ingest.ingest(spark, f"{sf_dir}/events.parquet*", static.schema, f"{base}/ops", f"{base}/state")
    return ingest.totals(spark.read.parquet(f"{base}/ops"))


@query(f"WITH {PUTS}, t AS (SELECT CAST(sum(size) AS BIGINT) * {LIMIT_PERCENT} // 100 AS cap FROM puts), r AS (SELECT seq, CAST(sum(size) OVER (ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes FROM puts) SELECT seq, bytes, bytes > cap AS over FROM r, t")
def running_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    cap = _puts(spark, sf_dir).agg(F.floor(F.sum("size") * LIMIT_PERCENT / 100).alias("cap"))
    placed = _numbered_puts(spark, sf_dir).withColumn("bytes", F.col("bytes") + F.col("size"))
    return placed.select("seq", "bytes", (F.col("bytes") > cap.scalar()).alias("over"))


# Layout.


@query(f"WITH {IDX}, c AS (SELECT segment_id, (row_number() OVER (PARTITION BY segment_id ORDER BY doc_id) - 1) // {CHUNK} AS chunk FROM idx) SELECT segment_id, chunk, count(*) AS n FROM c GROUP BY ALL")
def chunk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir).select("segment_id", "doc_id")
    return layout.chunked(i, "segment_id", ["doc_id"], CHUNK).groupBy("segment_id", "chunk").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LAYOUT} SELECT doc_id, pos FROM placed")
def slab_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.slab_layout(corpus.index(spark, sf_dir), "segment_id", "chunk", ["doc_id"]).select("doc_id", "pos")


_PACKED = f"""{IDX}, w AS (SELECT doc_id // {WRITER_DOCS} AS writer, doc_id, size, row_number() OVER (PARTITION BY doc_id // {WRITER_DOCS} ORDER BY doc_id) AS i FROM idx WHERE size <= {LARGE}),
f AS (SELECT writer, i, doc_id, size AS at, CAST(0 AS BIGINT) AS slab, size FROM w WHERE i = 1
UNION ALL SELECT w.writer, w.i, w.doc_id, CASE WHEN f.at + w.size > {SLAB} THEN w.size ELSE f.at + w.size END, CASE WHEN f.at + w.size > {SLAB} THEN f.slab + 1 ELSE f.slab END, w.size FROM f JOIN w ON w.writer = f.writer AND w.i = f.i + 1)"""


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir).where(layout.route(F.col("size"), LARGE) == "slab")
    return layout.packed(i.select(F.floor(F.col("doc_id") / WRITER_DOCS).alias("writer"), "doc_id", "size"), "writer", ["doc_id"], SLAB)


@query(f"WITH RECURSIVE {_PACKED} SELECT doc_id, writer, slab FROM f")
def slab_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("doc_id", "writer", "slab")


@query(f"""WITH RECURSIVE {_PACKED}, s AS (SELECT writer, slab, {ROUND.format('sum(size)')} AS bytes FROM f GROUP BY ALL),
g AS (SELECT writer, slab, CAST(0 AS BIGINT) AS segment, CASE WHEN bytes >= {SEGMENT} THEN 0 ELSE bytes END AS at, CASE WHEN bytes >= {SEGMENT} THEN 1 ELSE 0 END AS nxt FROM s WHERE slab = 0
UNION ALL SELECT s.writer, s.slab, g.nxt, CASE WHEN g.at + s.bytes >= {SEGMENT} THEN 0 ELSE g.at + s.bytes END, CASE WHEN g.at + s.bytes >= {SEGMENT} THEN g.nxt + 1 ELSE g.nxt END FROM g JOIN s ON s.writer = g.writer AND s.slab = g.slab + 1)
SELECT writer, slab, segment FROM g""")
def segment_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    slabs = _packed(spark, sf_dir).groupBy("writer", "slab").agg(F.sum("size").alias("bytes"))
    return layout.rotated(slabs, "writer", SEGMENT)


# Deletion, eviction, compaction.


@query(f"WITH {IDX}, l AS (SELECT segment_id, (row_number() OVER (PARTITION BY segment_id ORDER BY doc_id) - 1) // {CHUNK} AS chunk FROM idx WHERE doc_id % 4 <> 0) SELECT segment_id, chunk, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT DISTINCT segment_id, 0, 0 FROM idx WHERE segment_id NOT IN (SELECT segment_id FROM l)")
def repack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir).select("segment_id", "doc_id")
    return maintain.repack(i, i.where(F.col("doc_id") % 4 == 0).select("segment_id", "doc_id"), ["segment_id", "doc_id"], "segment_id", ["doc_id"], CHUNK)


@query(f"WITH {IDX} SELECT doc_id FROM idx WHERE doc_id % 4 <> 0")
def delete_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir).select("segment_id", "doc_id")
    return maintain.delete(i, i.where(F.col("doc_id") % 4 == 0), ["segment_id", "doc_id"]).select("doc_id")


@query(f"WITH {IDX} SELECT segment_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM idx WHERE doc_id % 4 = 0 GROUP BY segment_id")
def delete_by_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.delete_by_segment(corpus.index(spark, sf_dir).where(F.col("doc_id") % 4 == 0))


@query(f"WITH {IDX} SELECT doc_id FROM idx WHERE segment_id <> 3")
def delete_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.index(spark, sf_dir).where(F.col("segment_id") != 3).select("doc_id")


_NEED = LIVE + f", need AS (SELECT total, CASE WHEN total > cap THEN total - cap * 95 // 100 ELSE 0 END AS need FROM (SELECT total, total * {LIMIT_PERCENT} // 100 AS cap FROM (SELECT CAST(sum(size) AS BIGINT) AS total FROM live)))"
_FIFO = _NEED + ", fifo AS (SELECT doc_id, ord FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS ord, coalesce(sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM live), need WHERE before < need)"
_TURN = f"visited, doc_id < {HAND}, doc_id"
_SIEVE = _NEED + f", sieve AS (SELECT doc_id, size, visited, ord FROM (SELECT *, row_number() OVER (ORDER BY {_TURN}) AS ord, coalesce(sum(size) OVER (ORDER BY {_TURN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM live), need WHERE before < need)"


def _needed(live: DataFrame) -> tuple[int, int | None]:
    row = evict.limits(live, LIMIT_PERCENT, "segment_id").first()
    return row.need or 0, row.buckets


def _victims(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir)
    needed, buckets = _needed(live)
    return evict.sieve(live, needed, "segment_id", "doc_id", HAND, buckets)


@query(f"WITH {_FIFO} SELECT doc_id, ord FROM fifo")
def evict_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir)
    needed, buckets = _needed(live)
    return evict.fifo(live, needed, "segment_id", "doc_id", buckets).select("doc_id", "ord")


@query(f"WITH {_SIEVE} SELECT doc_id, ord FROM sieve")
def evict_sieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _victims(spark, sf_dir).select("doc_id", "ord")


@query(f"WITH {LIVE} SELECT doc_id FROM live ORDER BY {_TURN} LIMIT 1")
def evict_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).orderBy("visited", F.col("doc_id") < HAND, "doc_id").limit(1).select("doc_id")


@query(f"""WITH {_SIEVE}, v AS (SELECT * FROM sieve ORDER BY ord DESC LIMIT 1), l AS (SELECT live.* FROM live ANTI JOIN sieve USING (doc_id)),
h AS (SELECT min(l.doc_id) AS hand FROM l, v WHERE l.doc_id > v.doc_id)
SELECT l.doc_id, CASE WHEN v.visited THEN false ELSE l.visited AND NOT ((l.doc_id < {HAND}, l.doc_id) < (v.doc_id < {HAND}, v.doc_id)) END AS visited, coalesce(l.doc_id = hand, false) AS is_hand FROM l, v, h""")
def sieve_post_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    victims = written(_victims(spark, sf_dir), "victims")  # read three times
    return evict.sieve_after(_live(spark, sf_dir), victims, "doc_id", HAND).select("doc_id", "visited", "is_hand")


@query(f"WITH {_SIEVE} SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(any_value(total) - sum(size) AS BIGINT) AS remaining FROM sieve, need")
def evict_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _live(spark, sf_dir).agg(F.sum("size").alias("total"))
    gone = _victims(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    return gone.select("n", "bytes", (total.scalar() - F.col("bytes")).alias("remaining"))


REPLAY_KEYS = 100_000


@query(f"""WITH RECURSIVE {OPS}, cap AS (SELECT CAST(floor(sum(size) * 5 / 100) AS BIGINT) AS cap, greatest({SHARDS}, count(DISTINCT key) // {REPLAY_KEYS}) AS shards FROM ops),
o AS (SELECT CAST({HASH.format('key')} % shards AS INTEGER) AS shard, cap // shards AS share, ts, seq, op, key, coalesce(size, 0) AS size FROM ops, cap),
n AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY ts, seq) AS i FROM o),
s AS (SELECT shard, share, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS seq, CAST([] AS STRUCT(k VARCHAR, b BOOLEAN, z BIGINT)[]) AS q, CAST(0 AS BIGINT) AS h, CAST(0 AS BIGINT) AS total, false AS over, CAST(NULL AS VARCHAR) AS victim FROM n WHERE i = 1
UNION ALL SELECT shard, share, i, seq, q, h, total, share > 0 AND len(q) > 0 AND total > CASE WHEN evicting THEN share * 95 // 100 ELSE share END, victim FROM (
SELECT shard, share, i, seq, true AS evicting,
list_transform(list_filter(q, lambda e, x: x <> p), lambda e, x: CASE WHEN f IS NULL OR (CASE WHEN p >= a THEN x >= a AND x < p ELSE x >= a - 1 OR x < p END) THEN {{'k': e.k, 'b': false, 'z': e.z}} ELSE e END) AS q,
CASE WHEN p < len(q) THEN p ELSE 0 END AS h, total - q[p].z AS total, q[p].k AS victim
FROM (SELECT *, coalesce(f, a) AS p FROM (SELECT *, coalesce(list_min(list_filter(list_transform(q, lambda e, x: CASE WHEN NOT e.b AND x >= a THEN x END), lambda x: x IS NOT NULL)), list_min(list_filter(list_transform(q, lambda e, x: CASE WHEN NOT e.b THEN x END), lambda x: x IS NOT NULL))) AS f FROM (SELECT *, greatest(h, 1) AS a FROM s WHERE over)))
UNION ALL SELECT shard, share, i, seq, false, CASE WHEN op = 'get' THEN list_transform(q, lambda e: CASE WHEN e.k = key THEN {{'k': e.k, 'b': true, 'z': e.z}} ELSE e END) ELSE list_append(list_filter(q, lambda e: e.k <> key), {{'k': key, 'b': false, 'z': size}}) END,
CASE WHEN op = 'get' OR w IS NULL OR w > h THEN h WHEN w < h THEN h - 1 WHEN w < len(q) THEN h ELSE 0 END,
CASE WHEN op = 'get' THEN total ELSE total + size - coalesce(q[w].z, 0) END, NULL
FROM (SELECT s.shard, s.share, n.i, n.seq, n.op, n.key, n.size, s.q, s.h, s.total, list_position(list_transform(s.q, lambda e: e.k), n.key) AS w FROM s JOIN n ON n.shard = s.shard AND n.i = s.i + 1 WHERE NOT s.over)))
SELECT shard, seq, victim FROM s WHERE victim IS NOT NULL""")
def sieve_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = corpus.ops(spark, sf_dir)
    row = ops.agg(F.floor(F.sum("size") * 5 / 100).alias("cap"), F.countDistinct("key").alias("keys")).first()
    return ingest.sieve_replay(ops, int(row.cap or 0), max(SHARDS, row["keys"] // REPLAY_KEYS))


@query(f"WITH {OPS}, n AS (SELECT (row_number() OVER (ORDER BY ts, seq) - 1) // {BATCH} AS batch FROM ops), b AS (SELECT batch, count(*) AS n FROM n GROUP BY batch) SELECT batch, n FROM b ORDER BY batch DESC LIMIT 6")
def degraded_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = running(corpus.ops(spark, sf_dir), ["hour"], [F.col("ts"), F.col("seq")], {"before": F.lit(1)})
    kept = maintain.retained_batches(placed.select(F.floor(F.col("before") / BATCH).alias("batch")), "batch", 6)
    return kept.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts, event_id LIMIT 1")
def first_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.first_error(corpus.table(spark, sf_dir, "events").where("event_type = 'error'"), ["ts", "event_id"], ["event_id", "ts"])


@query(f"WITH {IDX} SELECT segment_id, CASE WHEN sum(size) = 0 THEN 0.0 ELSE CAST(sum(CASE WHEN NOT deleted THEN size ELSE 0 END) AS DOUBLE) / sum(size) END AS fullness FROM idx GROUP BY segment_id")
def segment_fullness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.fullness(corpus.index(spark, sf_dir))


@query(f"WITH {IDX}, f AS (SELECT segment_id, CAST(sum(CASE WHEN NOT deleted THEN size ELSE 0 END) AS DOUBLE) / sum(size) AS fullness FROM idx GROUP BY segment_id) SELECT segment_id FROM f WHERE fullness < 0.9 ORDER BY fullness, segment_id LIMIT 2")
def compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintain.compaction_candidates(corpus.index(spark, sf_dir), 0.9, 2)


# Bloom filters.

_GRID = [(n, p) for n in (1, 1000, 20_000, 1_000_000) for p in (0.5, 0.01, 0.001, 0.0001)]


@query("WITH g AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({n} AS BIGINT), CAST({p} AS DOUBLE))" for n, p in _GRID) + ") t(n, p)), b AS (SELECT n, p, greatest(1, CAST(ceil(floor(ceil(-n * ln(p) / (ln(2) * ln(2))) * 1.15::DOUBLE) / 512) AS BIGINT)) AS blocks FROM g) SELECT n, p, blocks * 512 AS m, greatest(1, CAST(ceil(-log2(p)) AS BIGINT)) AS k, blocks, blocks * 64 AS bytes FROM b")
def bloom_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(_GRID, "n long, p double").select("n", "p", *bloom.sizing(F.col("n"), F.col("p")))


@query(f"WITH {_FILTER} SELECT CAST(word_idx AS INTEGER) AS word_idx, word FROM bloom")
def bloom_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _doc_keys(spark, sf_dir)
    return bloom.build(keys, "h", _geometry(keys))


@query(f"WITH {_TESTED} SELECT key, maybe FROM tested")
def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(spark, sf_dir)


@query(f"WITH {_TESTED} SELECT key FROM tested WHERE maybe AND key NOT IN (SELECT key FROM docs)")
def bloom_ghosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tested(spark, sf_dir).where("maybe").join(_doc_keys(spark, sf_dir), "key", "left_anti").select("key")


_COUNTED = _TESTED + ", c AS (SELECT count(*) FILTER (maybe) AS hits, count(*) FILTER (maybe AND key NOT IN (SELECT key FROM docs)) AS ghosts, count(*) FILTER (key NOT IN (SELECT key FROM docs)) AS absent FROM tested)"


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _doc_keys(spark, sf_dir).select("key", F.lit(True).alias("known"))
    t = _tested(spark, sf_dir).join(known, "key", "left")
    absent = F.col("known").isNull()
    return t.agg(F.count_if("maybe").alias("hits"), F.count_if(F.col("maybe") & absent).alias("ghosts"), F.count_if(absent).alias("absent"))


@query(f"WITH {_COUNTED} SELECT hits, ghosts, CASE WHEN absent = 0 THEN 0.0 ELSE CAST(ghosts AS DOUBLE) / absent END AS fpr FROM c")
def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("hits", "ghosts", F.when(F.col("absent") == 0, F.lit(0.0)).otherwise(F.col("ghosts") / F.col("absent")).alias("fpr"))


@query(f"WITH {_COUNTED}, d AS (SELECT count(*) FILTER (doc_id % 11 = 0) AS deleted, count(*) AS keys FROM documents) SELECT deleted > keys * 0.1 AS stale, hits > 2000 AND CAST(ghosts AS DOUBLE) / greatest(hits, 1) > 0.05 AS fpr_bad, deleted > keys * 0.1 OR (hits > 2000 AND CAST(ghosts AS DOUBLE) / greatest(hits, 1) > 0.05) AS rebuild FROM c, d")
def bloom_rebuild_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = corpus.index(spark, sf_dir).agg(F.count_if("deleted").alias("deleted"), F.count(F.lit(1)).alias("keys"))
    counted = _counted(spark, sf_dir).withColumn("deleted", i.select("deleted").scalar()).withColumn("keys", i.select("keys").scalar())
    return counted.select(*bloom.rebuild_due(F.col("deleted"), F.col("keys"), F.col("hits"), F.col("ghosts"), FP_RATE))


@query(f"WITH {PUTS}, keys AS (SELECT 'doc-' || doc_id AS key FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT key FROM latest) SELECT CAST(word_idx AS INTEGER) AS word_idx, bit_or(mask) AS word FROM ({_probes_sql('keys', 'keys')}) GROUP BY word_idx")
def bloom_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = _live(spark, sf_dir).select(K.portable_hash(F.concat(F.lit("doc-"), F.col("doc_id"))).alias("h"))
    delta = _puts(spark, sf_dir).select("key").distinct().select(K.portable_hash(F.col("key")).alias("h"))
    g = bloom.Geometry.of(live.count() + delta.count(), FP_RATE)
    return bloom.merge(bloom.build(live, "h", g), bloom.build(delta, "h", g))


# Files, callbacks, reports.


@query(f"WITH {IDX}, f AS (SELECT min(segment_id) AS lost FROM idx) SELECT 'valid' AS status, count(DISTINCT segment_id) - 1 AS n FROM idx HAVING count(DISTINCT segment_id) > 1 UNION ALL SELECT 'corrupt', 1 UNION ALL SELECT 'recovered', count(*) FILTER (segment_id <> lost) FROM idx, f")
def recover_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the corpus as segment files, damages the first, and counts what recovery finds."""
    base = scratch(spark, "recover")
    first = _segment_files(spark, sf_dir, base).orderBy("segment_id").first()
    fs, at = segfile.file_system(first.path)
    with fs.open_output_stream(at) as f:
        f.write(b"too short")
    files = segfile.scan_files(spark, f"{base}/segments")
    counts = segfile.footers(files).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(segfile.recovered_index(files).agg(F.lit("recovered").alias("status"), F.count(F.lit(1)).alias("n")))


# The store as a whole: the corpus goes in, and what comes back is compared.


def _store(spark: SparkSession, name: str, **more) -> blobstore.Store:
    return blobstore.Store(spark, scratch(spark, name), StoreConfig(**{"shards": SHARDS, "flush_concurrency": 4, "large_threshold": LARGE, "slab_bytes": SLAB, "segment_bytes": SEGMENT, "bloom_keys": 1000, "key_hash": K.portable_hash} | more))


def _blob_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("doc-"), F.col("doc_id")).cast("binary").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("value"), "doc_id")


def _known(got: DataFrame) -> DataFrame:
    return got.select(F.col("key").cast("string").alias("key"), "found", "tier", F.md5("value").alias("digest"))


@query(f"WITH {REQ} SELECT key, doc_id IS NOT NULL AS found, CASE WHEN doc_id IS NOT NULL THEN 'index' END AS tier, CASE WHEN doc_id IS NULL THEN NULL WHEN doc_id % 10 = 0 THEN md5(coalesce(text, '') || '!') ELSE md5(coalesce(text, '')) END AS digest FROM req LEFT JOIN documents ON key = 'doc-' || doc_id")
def store_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Puts the corpus, puts a tenth of it anew, opens the store again and asks for all of it and for absent keys."""
    rows = _blob_rows(spark, sf_dir)
    with _store(spark, "store", checksum=True) as s:
        s.put(rows.select("key", "value"))
        s.put(rows.where(F.col("doc_id") % 10 == 0).select("key", F.concat("value", F.lit(b"!")).alias("value")))
    with blobstore.Store(spark, s.path, StoreConfig(**vars(s.config) | {"verify": True})) as again:
        return _known(again.get(_requests(spark, sf_dir)))


@query("SELECT 'doc-' || doc_id AS key, doc_id % 5 >= 1 AS found, CASE WHEN doc_id % 5 >= 3 THEN 'memtable' WHEN doc_id % 5 >= 1 THEN 'index' END AS tier, CASE WHEN doc_id % 5 >= 1 THEN md5(coalesce(text, '')) END AS digest FROM documents")
def store_degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches are written, then writing fails: of three more, the newest two stay in memory and are read."""
    rows = _blob_rows(spark, sf_dir)
    with _store(spark, "degraded", degraded_keep_batches=2) as s:
        for part in (1, 2, 0, 3, 4):
            if part == 0:
                s.report(OSError("no space"))
            s.put(rows.where(F.col("doc_id") % 5 == part).select("key", "value"))
        return _known(s.get(rows.select("key")))


@query(f"WITH {IDX}, k AS (SELECT {HASH.format(chr(39) + 'doc-' + chr(39) + ' || doc_id')} % 4 = 1 AS lost, size FROM idx) SELECT count(*) AS hits, count(*) FILTER (lost) AS ghosts, count(*) FILTER (lost) AS deleted, CAST(coalesce(sum(size) FILTER (NOT lost), 0) AS BIGINT) AS bytes FROM k")
def store_self_heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of one writer are lost; reads find out, drop its entries and count them."""
    rows = _blob_rows(spark, sf_dir)
    with _store(spark, "heal", segment_bytes=1 << 40) as s:
        s.put(rows.select("key", "value"))
        seen = s.index().select("segment_id").distinct().where(F.col("segment_id") % 4 == 1).collect()
        for r in seen:
            drop(spark, segfile.path_of(s.path, r.segment_id, SHARDS))
        s.get(rows.select("key"))
        return spark.createDataFrame([(s.hits, s.ghosts, s.deleted, s.size)], "hits long, ghosts long, deleted long, bytes long")


@query(f"""WITH {IDX}, k AS (SELECT {HASH.format(chr(39) + 'doc-' + chr(39) + ' || doc_id')} AS h, size FROM idx), t AS (SELECT CAST(sum(size) AS BIGINT) AS total FROM k),
c AS (SELECT total, total * {LIMIT_PERCENT} // 100 AS cap FROM t), r AS (SELECT size, coalesce(sum(size) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT CAST(count(*) AS BIGINT) AS victims, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, CAST(any_value(total) - coalesce(sum(size), 0) AS BIGINT) AS remaining FROM r, c WHERE before < total - cap * 95 // 100""")
def store_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of the policy: the oldest go until the store is at 95 % of its limit."""
    rows = _blob_rows(spark, sf_dir)
    total = rows.agg(F.sum(F.octet_length("value")).cast("long")).first()[0] or 0
    with _store(spark, "evict", policy="fifo", flush_concurrency=1, large_threshold=1 << 40) as s:
        s.put(rows.select("key", "value"))
        s.config = StoreConfig(**vars(s.config) | {"max_size": total * LIMIT_PERCENT // 100})
        done = s.evict()
        return spark.createDataFrame([(done["victims"], done["bytes"], s.size)], "victims long, bytes long, remaining long")


@query("SELECT CAST(1 AS BIGINT) AS compacted, count(*) AS n, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS bytes, CAST(2 AS BIGINT) AS segments FROM documents")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearly all of a segment is replaced; what is left of it is put again and the segment goes."""
    rows = _blob_rows(spark, sf_dir)
    with _store(spark, "compact", flush_concurrency=1, slab_bytes=1 << 40, segment_bytes=1 << 40, large_threshold=1 << 40) as s:
        s.put(rows.select("key", "value"))
        s.put(rows.where(F.col("doc_id") % 50 != 0).select("key", "value"))
        gone = len(s.compact())
        got = s.get(rows.select("key")).where("found").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value")).cast("long").alias("bytes")).first()
        return spark.createDataFrame([(gone, got.n, got.bytes, s.files().count())], "compacted long, n long, bytes long, segments long")


@query(f"WITH {IDX} SELECT doc_id, -row_number() OVER (PARTITION BY doc_id // {WRITER_DOCS} ORDER BY doc_id) AS slab FROM idx WHERE size > {LARGE}")
def large_slabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each large blob is a slab of its own."""
    i = corpus.index(spark, sf_dir).where(layout.route(F.col("size"), LARGE) == "large")
    return layout.large_slabs(i.withColumn("writer", F.floor(F.col("doc_id") / WRITER_DOCS)), "writer", ["doc_id"]).select("doc_id", "slab")


@query(f"WITH {IDX} SELECT DISTINCT segment_id, 1000 + segment_id // {SHARDS} * {SHARDS} + segment_id % {SHARDS} AS id FROM idx")
def segment_open_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of segments that writers open side by side."""
    i = corpus.index(spark, sf_dir).select("segment_id").distinct()
    return i.select("segment_id", layout.segment_ids(F.floor(F.col("segment_id") / SHARDS), F.col("segment_id") % SHARDS, 1000, SHARDS).alias("id"))


@query(f"WITH {IDX} SELECT DISTINCT segment_id, chunk, lower(lpad(to_hex(segment_id), 16, '0') || lpad(to_hex(chunk), 16, '0')) AS key FROM idx")
def chunk_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of chunks, and what is read out of them."""
    keys = corpus.index(spark, sf_dir).select(K.chunk_key(F.col("segment_id"), F.col("chunk")).alias("k")).distinct()
    return keys.select(K.chunk_of_key(F.col("k")).alias("p"), F.lower(F.hex("k")).alias("key")).select("p.*", "key")


@query(f"WITH k AS (SELECT DISTINCT 'doc-' || doc_id AS key, {HASH.format(chr(39) + 'doc-' + chr(39) + ' || doc_id')} % 4 AS writer FROM documents) SELECT count(DISTINCT writer) AS valid, CAST(1 AS BIGINT) AS corrupt, count(*) AS recovered FROM k")
def store_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of a store is lost and a file that is no segment lies beside the others; recovery counts what it finds."""
    with _store(spark, "recover-store", segment_bytes=1 << 40) as s:
        s.put(_blob_rows(spark, sf_dir).select("key", "value"))
    drop(spark, f"{s.path}/index")
    fs, at = segfile.file_system(f"{s.path}/segments/0000/junk.seg")
    with fs.open_output_stream(at) as f:
        f.write(b"no segment")
    done = blobstore.recover(spark, s.path, s.config)
    return spark.createDataFrame([(done["valid"], done["corrupt"], done["recovered"])], "valid long, corrupt long, recovered long")


_SLAB_SIZES = (0, 1 << 20, 100 << 20, 128 << 20, 64 << 30)


@query("SELECT bytes, least(1048576, greatest(4096, bytes // 8192)) AS slots FROM (VALUES " + ", ".join(f"(CAST({n} AS BIGINT))" for n in _SLAB_SIZES) + ") t(bytes)")
def slab_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index slots of slabs of several sizes."""
    return spark.createDataFrame([(n, K.slab_slots(n)) for n in _SLAB_SIZES], "bytes long, slots long")


@query(f"WITH {REQ} SELECT req.key, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM req JOIN documents ON req.key = 'doc-' || doc_id")
def view_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = corpus.blobs(spark, sf_dir).select("key", F.col("text").cast("binary").alias("value"))

    def sized(frames):
        for f in frames:
            yield pd.DataFrame({"key": f["key"], "n": [len(v) for v in f["value"]]})

    return store.view(store.get(_requests(spark, sf_dir), blobs), sized, "key string, n long")


@query(f"""WITH {OPS}, r AS (SELECT *, last_value(size IGNORE NULLS) OVER (PARTITION BY key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) IS NOT NULL AS found FROM ops),
p AS (SELECT size, row_number() OVER (ORDER BY size, seq) AS i, count(*) OVER () AS n FROM ops WHERE op = 'put')
SELECT 'puts' AS metric, CAST(count(*) FILTER (op = 'put') AS DOUBLE) AS value FROM r
UNION ALL SELECT 'gets', CAST(count(*) FILTER (op = 'get') AS DOUBLE) FROM r
UNION ALL SELECT 'hits', CAST(count(*) FILTER (op = 'get' AND found) AS DOUBLE) FROM r
UNION ALL SELECT 'hit_rate', CAST(count(*) FILTER (op = 'get' AND found) AS DOUBLE) / greatest(count(*) FILTER (op = 'get'), 1) FROM r
UNION ALL SELECT 'put_bytes', CAST(coalesce(sum(size), 0) AS DOUBLE) FROM ops
UNION ALL SELECT 'size_p50', CAST(quantile_disc(size, 0.5) AS DOUBLE) FROM ops WHERE op = 'put'
UNION ALL SELECT 'size_p99', CAST(quantile_disc(size, 0.99) AS DOUBLE) FROM ops WHERE op = 'put'""")
def workload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = corpus.ops(spark, sf_dir)
    reads = replay_reads(spark, sf_dir).agg(F.count(F.lit(1)).alias("gets"), F.count_if("found").alias("hits"))
    puts = ops.where("op = 'put'").agg(F.count(F.lit(1)).alias("puts"), F.coalesce(F.sum("size"), F.lit(0)).alias("put_bytes"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY size)").alias("size_p50"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY size)").alias("size_p99"))
    row = puts.withColumn("gets", reads.select("gets").scalar()).withColumn("hits", reads.select("hits").scalar())
    rate = F.col("hits") / F.greatest(F.col("gets"), F.lit(1))
    values = {"puts": F.col("puts"), "gets": F.col("gets"), "hits": F.col("hits"), "hit_rate": rate, "put_bytes": F.col("put_bytes"), "size_p50": F.col("size_p50"), "size_p99": F.col("size_p99")}
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in values.items()))).alias("x")).select("x.*")
