"""Line dedup: lines that many documents share are dropped everywhere.

Each document gives its different normalised lines as 128-bit hashes, counted per task, then summed per hash
(a hot line arrives as one row per task).  Lines at or over the threshold are the frequent ones.  If their
measured number is within ``broadcast_lines``, the set goes to the workers and each document is rebuilt in one
pass, without a shuffle of texts.  Beyond it, (row, place, hash) of every line is joined to the frequent
hashes, places to drop are gathered per document and joined to the texts; skewed hashes are split by AQE.
Both ways give the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, fresh, keyed, named, numbered, saved, scratch


def line_key(line: bytes) -> bytes:
    """strip() and lower() of bytes are ASCII only: [\\x20\\x09-\\x0D] and A-Z."""
    return line.strip().lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or sum(b & 0xC0 != 0x80 for b in key) >= least)


def _count(least: int):
    def run(batches):
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            counts: dict[bytes, int] = {}
            for text in as_bytes(batch.column(0)):
                for key in {line_key(x) for x in text.split(b"\n")}:
                    if key and long_enough(key, least):
                        h = digest(key)
                        counts[h] = counts.get(h, 0) + 1
            both = np.frombuffer(b"".join(counts), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(list(counts.values()), pa.int64())], ["hi", "lo", "n"])

    return run


def frequent_lines(docs: DataFrame, text_col: str = "text", documents: int = 10, least: int = 1) -> DataFrame:
    """(hi, lo, n): hashes of the keys found in at least ``documents`` rows, with that number."""
    counted = docs.select(named(text_col).cast("string")).mapInArrow(_count(least), "hi bigint, lo bigint, n bigint")
    return counted.groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= documents)


def _rebuilt(text: bytes | None, drop) -> tuple[int, int, bytes]:
    """drop: line, place -> whether it goes."""
    lines = (text or b"").split(b"\n")
    kept = [x for i, x in enumerate(lines) if not drop(x, i)]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _columns(batch, texts, decide, at, keep, names):
    made = [_rebuilt(t, d) for t, d in zip(texts, decide, strict=True)]
    columns = batch.columns[:keep]
    columns[at] = pa.array([None if t is None and not gone else new.decode() for t, (_, gone, new) in zip(texts, made, strict=True)], pa.string())
    return pa.RecordBatch.from_arrays([*columns, pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.int64())], names=[*batch.schema.names[:keep], *names])


def drop_frequent_lines(docs: DataFrame, text_col: str = "text", documents: int = 10, least: int = 1, broadcast_lines: int = 500_000) -> DataFrame:
    """docs with the text rebuilt, and two more columns, the last: lines (before dropping) and lines dropped.

    Those are named _n_lines and _n_dropped, with underscores added where docs has such a name.  Lines end at \\n.
    A key is a line without ASCII white space at its ends, A-Z lower-cased; keys of fewer than ``least`` code
    points never count.  Null or empty text is one empty line; null stays null.  Texts of any length are whole.
    Repeated rows are documents of their own; an empty table gives an empty result.  Other columns pass through
    unchanged whatever their names.
    """
    spark = docs.sparkSession
    frequent = saved(frequent_lines(docs, text_col, documents, least), scratch(spark, "lines"))
    at, width, outside = docs.columns.index(text_col), len(docs.columns), [*docs.columns, *fresh(docs.columns, "_n_lines", "_n_dropped")]
    docs, text_col, names = numbered(docs), f"c{at}", ("n_lines", "n_dropped")
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    out_schema = docs.withColumns({n: F.lit(0).cast("long") for n in names}).schema
    if frequent.count() <= broadcast_lines:
        pairs = np.array([(r["hi"], r["lo"]) for r in frequent.select("hi", "lo").collect()], "<i8").reshape(-1, 2)
        known = spark.sparkContext.broadcast(frozenset(p.tobytes() for p in pairs))

        def run(batches):
            from xxhash import xxh3_128_digest as digest

            gone = known.value

            def drop(line, _):
                key = line_key(line)
                return bool(key) and long_enough(key, least) and digest(key) in gone

            for batch in batches:
                texts = batch.column(at).cast(pa.binary()).to_pylist()
                yield _columns(batch, texts, [drop] * len(texts), at, width, names)

        return docs.mapInArrow(run, out_schema).toDF(*outside)

    rows = keyed(docs, "row")

    def places(batches):
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            files, rows_, place, hashes = [], [], [], []
            for f, i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                for p, line in enumerate(text.split(b"\n")):
                    if (key := line_key(line)) and long_enough(key, least):
                        files.append(f)
                        rows_.append(i)
                        place.append(p)
                        hashes.append(digest(key))
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int64()), pa.array(rows_, pa.int64()), pa.array(place, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["f", "i", "place", "hi", "lo"])

    lines = rows.select(F.col("row.f").alias("f"), F.col("row.i").alias("i"), text_col).mapInArrow(places, "f bigint, i bigint, place int, hi bigint, lo bigint")
    gone = lines.join(frequent.select("hi", "lo"), ["hi", "lo"]).groupBy("f", "i").agg(F.collect_list("place").alias("gone")).select(F.struct("f", "i").alias("row"), "gone")
    joined = rows.join(gone, "row", "left").select(*docs.columns, "gone")

    def rebuild(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            decide = [(lambda _, i, g=frozenset(g or ()): i in g) for g in batch.column(width).to_pylist()]
            yield _columns(batch, texts, decide, at, width, names)

    return joined.mapInArrow(rebuild, out_schema).toDF(*outside)


def op3(spark, sf_dir: str) -> DataFrame:
    """``drop_frequent_lines`` of the whole table ``documents``, by its rules, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return drop_frequent_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), kept.alias("kept_sha256"))


OP3_SQL = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
f AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE f.k IS NOT NULL) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k GROUP BY doc_id
"""
