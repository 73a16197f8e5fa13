"""Exact duplicates through an extendible-hash index on shared files.  DataFrame functions only.

Keys are 64-bit hashes of the normalised text (all ASCII white space deleted).  The directory maps the
leading bits of a key to a bucket; a bucket with more than ``capacity`` keys is split on its next bit, and
the directory doubles whenever the bucket was as deep as the directory itself, up to ``max_depth`` bits.  A
bucket that is still too full then gets a directory of its own, of the key's next bits.  So a bucket is a
range of keys, and there are always several for every task.

Each bucket has one owner task.  A key that a single row has comes there as its entry; the rows of other keys
come with their texts, combined on the way (at most ``SALTS`` rows of each text, however many copies there
are).  The owner chains the texts of a key, compares their bytes, counts, and chooses the row that stays.  Its
file holds the chains, and the result is read from those files.

Cost: entries of fixed size, and the texts of keys with more than one row.  The driver sees one count per
directory prefix (at most 2**max_depth).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, rows_of, saved, scratch, text_or_empty, without

WHITE = r"[\x20\x09-\x0D]+"
SALTS = 4  # rows of one text that reach its owner at most


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def hash64(norm: Column) -> Column:
    return F.xxhash64(norm)


def split_buckets(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[list[int], list[tuple[int, int]]]:
    """(directory, buckets) from the number of keys per prefix of ``max_depth`` bits.

    ``directory[i]`` is the bucket of the global-depth prefix i; ``buckets[b]`` is (prefix, local depth).
    """
    levels = [dict(counts)]
    for _ in range(max_depth):
        up: dict[int, int] = {}
        for prefix, n in levels[-1].items():
            up[prefix >> 1] = up.get(prefix >> 1, 0) + n
        levels.append(up)
    levels.reverse()  # levels[d][prefix of d bits]
    buckets, todo = [], [(0, 0)]
    while todo:
        prefix, depth = todo.pop()
        if depth < max_depth and levels[depth].get(prefix, 0) > capacity:
            todo += [(2 * prefix + 1, depth + 1), (2 * prefix, depth + 1)]
        else:
            buckets.append((prefix, depth))
    top = max(depth for _, depth in buckets)
    directory = [0] * (1 << top)
    for b, (prefix, depth) in enumerate(buckets):
        first = prefix << (top - depth)
        directory[first : first + (1 << (top - depth))] = [b] * (1 << (top - depth))
    return directory, buckets


def _nested(overfull: DataFrame, keys: DataFrame, capacity: int, max_depth: int) -> list[tuple[int, int]]:
    """(prefix, bits) of the directory of each overfull prefix: the fewest bits that keep its buckets in capacity."""
    deep = keys.join(F.broadcast(overfull), F.shiftrightunsigned("key", 64 - max_depth) == F.col("p"))
    fine = deep.groupBy("p", F.shiftrightunsigned(F.shiftleft("key", max_depth), 48).alias("q")).count()
    each = fine.select("p", "count", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(16)), lambda bits: F.call_function("shiftrightunsigned", F.col("q"), 16 - bits))).alias("bits", "q"))
    most = each.groupBy("p", "bits", "q").agg(F.sum("count").alias("n")).groupBy("p", "bits").agg(F.max("n").alias("n"))
    least = most.groupBy("p").agg(F.coalesce(F.min(F.when(F.col("n") <= capacity, F.col("bits") + 1)), F.lit(16)).alias("bits"))
    return [tuple(r) for r in least.collect()]


class ExtendibleIndex:
    """The index: ``entries`` has a row per document, ``table`` one per different text.

    ``table``: bucket, key, text_sha256, chain (place among the texts of a key), keep_id, keep_row (f, i),
    group_size.  ``rows`` has doc_id, text, f, i.
    """

    def __init__(self, rows: DataFrame, capacity: int, max_depth: int, hasher, broadcast_keys: int):
        if not 1 <= max_depth <= 16:
            raise ValueError("max_depth must be 1..16: the directory is broadcast")
        spark, self.path = rows.sparkSession, scratch(rows.sparkSession, "exact")
        text = text_or_empty("text")
        norm = rows.select("doc_id", F.struct("f", "i").alias("row"), F.length(text).alias("points"), normalised(text).alias("norm")).withColumn("key", hasher(F.col("norm")))
        self.entries = saved(norm.select("doc_id", "row", "points", "key", F.sha2("norm", 256).alias("text_sha256")), f"{self.path}/entries")

        best = F.min(F.struct((-F.col("points")).alias("points"), F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
        keys = saved(self.entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), best, F.min("text_sha256").alias("text_sha256")), f"{self.path}/keys")
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        per_prefix = {r["p"]: r["count"] for r in keys.groupBy(F.shiftrightunsigned("key", 64 - max_depth).alias("p")).count().collect()}
        capacity = max(1, min(capacity, -(-sum(per_prefix.values()) // (8 * parts))))
        self.directory, self.buckets = split_buckets(per_prefix, capacity, max_depth)
        depth = (len(self.directory) - 1).bit_length()
        bits = [0] * len(self.buckets)
        overfull = [p for p, n in per_prefix.items() if n > capacity]
        if overfull:
            listed = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(overfull)), "array<bigint>")).alias("p"))
            for p, own in _nested(listed, keys, capacity, max_depth):
                bits[self.directory[p]] = own
        listed = F.from_json(F.lit(json.dumps([{"b": b, "e": bits[b]} for b in self.directory])), "array<struct<b:bigint,e:int>>")
        directory = spark.range(1).select(F.posexplode(listed).alias("slot", "d")).select("slot", "d.*")
        slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
        inner = F.when(F.col("e") > 0, F.expr(f"shiftrightunsigned(shiftleft(key, {max_depth}), 64 - e)")).otherwise(0)

        several = keys.where("n > 1").select("key")
        several = F.broadcast(several) if several.count() <= broadcast_keys else several
        salted = norm.join(several, "key", "left_semi").groupBy("key", "norm", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt")).agg(F.count(F.lit(1)).alias("n"), best)
        routed = salted.select("key", "norm", "n", "best", F.sha2("norm", 256).alias("text_sha256"))
        routed = routed.unionByName(keys.where("n = 1").withColumn("norm", F.lit(None).cast("string")))
        routed = routed.withColumn("slot", slot.cast("int")).join(F.broadcast(directory), "slot").withColumn("bucket", F.col("b") * 65536 + inner)
        # From here on everything happens in the bucket's owner: no exchange follows.
        owned = routed.repartition(parts, "bucket").groupBy("bucket", "key", "norm").agg(F.min("text_sha256").alias("text_sha256"), F.sum("n").alias("group_size"), F.min("best").alias("best"))
        chain = Window.partitionBy("bucket", "key").orderBy("text_sha256", "norm")
        twice = F.lag("text_sha256").over(chain) == F.col("text_sha256")
        size = F.when(twice, F.raise_error(F.lit("two texts share a key and a SHA-256")).cast("long")).otherwise(F.col("group_size"))
        owned = owned.select("bucket", "key", "text_sha256", F.row_number().over(chain).alias("chain"), F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), size.alias("group_size"))
        self.table = saved(owned, f"{self.path}/buckets")
        remove(spark, f"{self.path}/keys")

    def lookup(self) -> DataFrame:
        """One row per document with what the index has for its text."""
        found = self.entries.join(self.table, ["key", "text_sha256"])
        return found.select("doc_id", F.col("row").alias("row_id"), "keep_id", "group_size", F.col("row").eqNullSafe(F.col("keep_row")).alias("kept"), "text_sha256", "bucket", "chain")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 16384, max_depth: int = 16, hasher=hash64, key: str | None = None, broadcast_keys: int = 500_000) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256 (and row_id, bucket, chain).

    Of equal texts the row with the most code points stays, then the smallest id (a null id comes last), then the
    first of repeated rows, so exactly one row of each group is kept.  Ids have any type that sorts.  Null text
    counts as empty, and empty texts are a group of their own.  Texts of any length are hashed and compared
    whole.  An empty table gives an empty result.  ``key`` names a column of docs made by ``common.keyed``;
    else one is made.  Other columns are ignored whatever their names.

    ``capacity`` is the most keys of a bucket; small tables have smaller buckets, eight for every task.
    """
    return ExtendibleIndex(rows_of(docs, key, doc_id=id_col, text=text_col), capacity, max_depth, hasher, broadcast_keys).lookup()


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs that stay by ``exact_duplicates``, with docs' columns; all its rules hold here."""
    def gone(small, key):
        return exact_duplicates(small, key=key, **how).where(~F.col("kept")).select("row_id.*")

    return without(docs, gone, doc_id=id_col, text=text_col)


def op7(spark, sf_dir: str) -> DataFrame:
    """``exact_duplicates`` of the whole table ``documents``, by its rules."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
       CAST(count(*) OVER (PARTITION BY norm) AS BIGINT) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
