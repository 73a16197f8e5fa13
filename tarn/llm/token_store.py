"""Token ids in a content-addressed store.

Each document's ids (with an end id) are cut into chunks where a rolling hash over the last ``WINDOW`` ids
hits a fixed pattern, so equal passages give equal chunks wherever they stand.  Files under ``path``:

``objects/kind=0``  one row per different chunk: SHA-256 of its ids, number of ids, compressed ids
``objects/kind=1``  one row per document: its id and its recipe, the list of its chunks' SHA-256 and sizes
``index``           in ascending doc_id order (null first, repeated ids in any fixed order), by shard:
                    doc_id, number of ids, ids before it within the shard, Merkle root over the recipe
``manifest``        one row per shard: number of documents and of ids, Merkle root over the documents' roots

Reading goes through the files alone: every chunk is unpacked and checked against its address, every
document's root is made anew from its recipe and checked against the index.

Cost: one pass of encoding; chunks cross the network once (copies within a task only once) and are written
once.  Texts are never shuffled.  A document's recipe is as long as its own text, nothing grows with groups.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, crc32_join, mix64, named, pieces, prefix_sums, saved, scratch, small_batches
from .encoding import default_path, encoder

WINDOW, LEAST, MOST = 16, 256, 8192
_BASE = 0x9E3779B97F4A7C15 | 1
_OBJECT = "kind int, key binary, doc_id {id}, n bigint, data binary"
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for at, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[at : at + 1] = [np.cumprod(p)]
    return _POWERS[0][:n], _POWERS[1][:n]


def rolling(ids: np.ndarray) -> np.ndarray:
    """Polynomial hash of the WINDOW ids that end at each place (fewer at the start)."""
    up, down = _powers(len(ids))
    sums = np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * down)
    sums[WINDOW:] = sums[WINDOW:] - sums[:-WINDOW]  # the right side is made before it is stored
    return mix64(sums * up)


def cuts(ids: np.ndarray, bits: int = 10) -> list[int]:
    """Ends of the chunks of one document."""
    ends, last = [], 0
    for at in (np.flatnonzero(rolling(ids) >> np.uint64(64 - bits) == 0) + 1).tolist() if len(ids) > LEAST else ():
        while at - last > MOST:
            last += MOST
            ends.append(last)
        if at - last >= LEAST:
            ends.append(last := at)
    while len(ids) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(ids) or not ends:
        ends.append(len(ids))
    return ends


@cache
def _zstd():
    """(compressor, decompressor) of this process."""
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(ids: np.ndarray) -> bytes:
    small = bool(len(ids)) and int(ids.max()) < 1 << 16
    return (b"\2" if small else b"\4") + _zstd()[0].compress(ids.astype("<u2" if small else "<u4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(data[1:]), "<u2" if data[:1] == b"\2" else "<u4").astype("<u4")


def merkle(hashes: list[bytes]) -> bytes:
    """Root of a binary Merkle tree; leaves and inner nodes are hashed apart, an odd node moves up."""
    level = [hashlib.sha256(b"\0" + h).digest() for h in hashes] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _encode(path: str, end_id: int, bits: int, remember: int):
    def run(batches):
        from pyspark import TaskContext

        part, place, seen = TaskContext.get().partitionId(), 0, set()
        for batch in pieces(batches, 256, "encoder"):
            schema, rows = arrow_schema(_OBJECT, doc_id=batch.schema.field(0).type), []
            for doc_id, raw in zip(batch.column(0).to_pylist(), encoder(path).ids([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype("<u4")
                recipe, last = [], 0
                for end in cuts(ids, bits):
                    chunk = ids[last:end]
                    key = hashlib.sha256(chunk.tobytes()).digest()
                    recipe.append(key + struct.pack(">I", end - last))
                    if key not in seen:
                        if len(seen) < remember:
                            seen.add(key)
                        rows.append((0, key, None, end - last, packed(chunk)))
                    last = end
                rows.append((1, struct.pack(">qq", part, place), doc_id, len(ids), b"".join(recipe)))
                place += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _index(batches):
    """Rows of one shard, in order, with the ids before each and its root."""
    at = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        roots = [merkle([d[i : i + 32] for i in range(0, len(d), 36)]) for d in batch.column("data").to_pylist()]
        starts = at + np.cumsum(n) - n
        at += int(n.sum())
        yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("doc_id"), batch.column("key"), batch.column("n"), pa.array(starts, pa.int64()), pa.array(roots, pa.binary())], ["shard", "doc_id", "key", "n", "local_start", "root"])


def _shard_roots(index: DataFrame, fan: int = 1024) -> DataFrame:
    """(shard, root, documents, ids): roots are hashed level by level, at most ``fan`` together."""
    level = index.select("shard", F.struct("local_start", "key").alias("at"), F.hex("root").alias("root"), F.lit(1).cast("long").alias("documents"), F.col("n").alias("ids"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("shard").orderBy("at")) - 1
    level = level.select("shard", place.cast("long").alias("place"), "root", "documents", "ids")
    most = max([1, *[r["n"] for r in index.groupBy("shard").count().agg(F.max("count").alias("n")).collect() if r["n"]]])
    while True:
        listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "root"))), lambda x: x["root"]), "")
        level = level.groupBy("shard", F.expr(f"place div {fan}").alias("place")).agg(F.sha2(listed, 256).alias("root"), F.sum("documents").alias("documents"), F.sum("ids").alias("ids"))
        most = -(-most // fan)
        if most <= 1:
            return level.drop("place")


def _shard_count(recipes: DataFrame) -> int:
    """Shards of 2 MB of recipes, no more than shuffle partitions until each has 128 MB: small files cost, too."""
    size = recipes.agg(F.sum(F.octet_length("data") + 64)).first()[0] or 0
    most = int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(-(-size // (2 << 20)), most), -(-size // (128 << 20)))


def write_store(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0, bits: int = 10, remember: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode docs into a store at ``path``.

    Null text is empty; texts of any length are encoded whole.  Repeated ids stay separate documents, in any
    fixed order.  Ids have any type that sorts.  Other columns are ignored whatever their names.  An empty table
    gives an empty store.  ``remember`` bounds the chunk addresses a task holds to send each chunk only once.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_encode(tokenizer or default_path("byte_bpe_50k.json"), end_id, bits, remember), _OBJECT.format(id=kind))
    with small_batches(spark):
        rows.groupBy("kind", "key").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("data").alias("data")).write.partitionBy("kind").parquet(f"{path}/objects")
        recipes = objects(spark, path, kind).where("kind = 1").drop("kind")
        ordered = recipes.repartitionByRange(_shard_count(recipes), F.col("doc_id").asc_nulls_first(), "key").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "key")
        index = ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(_index, f"shard int, doc_id {kind}, key binary, n bigint, local_start bigint, root binary")
        _shard_roots(saved(index, f"{path}/index")).write.parquet(f"{path}/manifest")
    return path


def objects(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    kind = kind or dict(index_of(spark, path).dtypes)["doc_id"]
    return spark.read.schema(f"key binary, doc_id {kind}, n bigint, data binary, kind int").parquet(f"{path}/objects")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/index")


def _check_chunks(batches):
    """Unpack every chunk, check it against its address, return size and CRC-32."""
    for batch in batches:
        crcs = []
        for key, n, data in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "data")), strict=True):
            raw = unpacked(data).tobytes()
            if hashlib.sha256(raw).digest() != key or len(raw) != 4 * n:
                raise ValueError(f"chunk {key.hex()} does not hold what its address says")
            crcs.append(zlib.crc32(raw))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(crcs, pa.int64())], ["chunk", "crc"])


def _parts(recipes: DataFrame) -> DataFrame:
    """A row per chunk of each recipe: key, doc_id, place, chunk, size."""
    at = "int(i) * 36"
    size = f"bigint(conv(hex(substring(data, {at} + 33, 4)), 16, 10))"
    split = f"transform(sequence(0, octet_length(data) div 36 - 1), i -> struct(int(i) AS place, substring(data, {at} + 1, 32) AS chunk, {size} AS size))"
    return recipes.where("octet_length(data) >= 36").select("key", "doc_id", F.inline(F.expr(split)))


def _join_crcs(batches):
    for batch in batches:
        totals, roots, ns = [], [], []
        for parts in batch.column("parts").to_pylist():
            crc, n = 0, 0
            for p in parts:
                crc, n = crc32_join(crc, p["crc"], 4 * p["size"]), n + p["size"]
            totals.append(crc)
            ns.append(n)
            roots.append(merkle([p["chunk"] for p in parts]))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ns, pa.int64()), pa.array(totals, pa.int64()), pa.array(roots, pa.binary())], ["key", "n_tokens", "ids_crc32", "made_root"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, all from the files, in no order.

    The CRC of a document is joined from those of its chunks' bytes, so no ids are moved.  Raises where the
    index does not fit the manifest, or a chunk, a recipe or a root does not fit the index.
    """
    if not verify_manifest(spark, path):
        raise ValueError(f"the index differs from the manifest: {path}")
    all_objects = objects(spark, path)
    chunks = all_objects.where("kind = 0").select("key", "n", "data").mapInArrow(_check_chunks, "chunk binary, crc bigint")
    parts = _parts(all_objects.where("kind = 1"))
    per_doc = parts.join(chunks, "chunk").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "size", "crc", "chunk"))).alias("parts"))
    made = per_doc.mapInArrow(_join_crcs, "key binary, n_tokens bigint, ids_crc32 bigint, made_root binary")
    index = index_of(spark, path)
    offsets = prefix_sums(index.groupBy("shard").agg(F.sum("n").alias("n")), "shard", "n", "before")
    out = index.join(offsets, "shard").join(made, "key", "left")
    fits = F.col("n_tokens").eqNullSafe(F.col("n")) & F.col("made_root").eqNullSafe(F.col("root"))
    n = F.when(fits, F.col("n_tokens")).otherwise(F.raise_error(F.concat(F.lit("document differs from the index: "), F.col("doc_id").cast("string"))).cast("long"))
    return out.select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), n.alias("n_tokens"), "ids_crc32", F.hex("root").alias("root"))


def verify_manifest(spark: SparkSession, path: str) -> bool:
    """Whether the manifest's shard roots, counts and sums are those of the index."""
    columns = ["shard", "root", "documents", "ids"]
    stored = spark.read.schema("shard int, root string, documents bigint, ids bigint").parquet(f"{path}/manifest")
    index = spark.read.schema("shard int, key binary, n bigint, local_start bigint, root binary").parquet(f"{path}/index")  # all its files may be lost
    both = _shard_roots(index).select(*columns, F.lit(1).alias("side")).unionAll(stored.select(*columns, F.lit(-1).alias("side")))
    return both.groupBy(*columns).agg(F.sum("side").alias("side")).where("side <> 0").isEmpty()


def reconstruct(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the asked documents, from recipes and chunks."""
    kind = dict(objects(spark, path).dtypes)["doc_id"]
    parts = _parts(objects(spark, path, kind).where("kind = 1").where(F.col("doc_id").isin(doc_ids)))
    chunks = objects(spark, path).where("kind = 0").select(F.col("key").alias("chunk"), "data")
    whole = parts.join(chunks, "chunk").groupBy("key", "doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "data"))).alias("parts"))

    def put(batches):
        for batch in batches:
            ids = [np.concatenate([unpacked(p["data"]) for p in parts]).astype(np.int64) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "ids"])

    return whole.mapInArrow(put, f"doc_id {kind}, ids array<bigint>")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of the whole table ``documents``, read back; the rules are those of ``write_store``."""
    path = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch(spark, "tokens"))
    return read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "root")
