"""Benchmark decontamination: benchmark word n-grams against every token window of the corpus.

The windows of the benchmark (13 words; a shorter item is one window) become sorted arrays of rolling
hashes, broadcast to the workers.  A document's words become vocabulary numbers; only places where all words
of a window are benchmark words are hashed, looked up and then compared word by word, so a hash alone never
makes a hit.

The benchmark is broadcast in blocks of ``block_bytes`` of text, so what a worker holds does not grow with
it; a long item is cut into segments that overlap by a window.  One block is one pass over the documents.  With
more, each is a scan that writes the hits it finds (row key, words, items) and nothing of the documents; the hits
are joined to the documents at the end.  No shuffle by content, no skew: every document is decided by itself.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_TABLE, alnum_words, as_bytes, keyed, mix64, named, numbered, pieces, saved, scratch, small_batches, small_side

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Windows:
    """The windows of some benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        numbers, by_length, at = [], {}, 0
        for name, text in items:
            words = alnum_words(text)
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            length = min(width, len(ids))
            for i in range(len(ids) - length + 1):
                by_length.setdefault(length, []).append((at + i, len(self.names)))
            numbers.append(np.array(ids, np.uint32))
            self.names.append(name)
            at += len(ids)
        self.numbers = np.concatenate([np.empty(0, np.uint32), *numbers])
        self.lengths = []
        for length, found in sorted(by_length.items()):
            places, owners = np.array(found, np.int64).T
            hashes = self.hash(self.numbers, places, length)
            order = np.argsort(hashes, kind="stable")
            self.lengths.append((length, hashes[order], places[order], owners[order].astype(np.int32)))

    @staticmethod
    def hash(numbers: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
        h = np.zeros(len(places), np.uint64)
        for k in range(length):
            h = h * _BASE + mix64(numbers[places + k].astype(np.uint64))
        return h

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """(mask of hit words, names of the items with windows here)."""
        n = len(words)
        hit, owners_hit = np.zeros(n, bool), set()
        if not n or not self.lengths:
            return hit, owners_hit
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint32, n)
        known = np.append(0, np.cumsum(ids > 0))
        for length, hashes, places, owners in self.lengths:
            if n < length:
                break
            at = np.flatnonzero(known[length:] - known[:-length] == length)
            if not len(at):
                continue
            h = self.hash(ids, at, length)
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            count = high - low
            if not count.any():
                continue
            start, which = np.repeat(at, count), np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            same = np.ones(len(start), bool)
            for k in range(length):
                same &= ids[start + k] == self.numbers[places[which] + k]
            owners_hit.update(self.names[o] for o in np.unique(owners[which[same]]).tolist())
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, start[same], 1)
            np.add.at(edge, start[same] + length, -1)
            hit |= np.cumsum(edge[:-1]) > 0
        return hit, owners_hit


def _spans(hit: np.ndarray) -> list[int]:
    """Mask -> flat [first, end, first, end, ...]."""
    return np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).tolist()


def _segments(width: int, words: int):
    """Items as texts of at most ``words`` words each; every window lies whole in one of them."""

    def run(batches):
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), as_bytes(batch.column("t")), strict=True):
                all_words = alnum_words(text)
                firsts = range(0, max(1, len(all_words) - width + 1), max(1, words - width + 1))
                cut = [b" ".join(all_words[i : i + words]) for i in firsts] if all_words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(cut), pa.string()), pa.array(cut, pa.binary())], ["item", "t"])

    return run


_FOUND = "f bigint, i bigint, n_words bigint, hits array<int>, items array<string>"


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["f", "i", "n_words", "hits", "items"])


def _find(windows):
    """The documents with hits: key, number of words, hit words, items."""

    def run(batches):
        found = windows.value
        for batch in pieces(batches):
            rows = []
            for f, i, text in zip(batch.column("f").to_pylist(), batch.column("i").to_pylist(), as_bytes(batch.column("text")), strict=True):
                words = alnum_words(text)
                hit, owners = found.find(words)
                if owners:
                    rows.append((f, i, len(words), _spans(hit), sorted(owners)))
            yield _found(rows)

    return run


def _merge(batches):
    """What several blocks found in a document, as one."""
    for batch in batches:
        rows = []
        for f, i, n, spans, names in zip(*(batch.column(c).to_pylist() for c in ("f", "i", "n_words", "hits", "items")), strict=True):
            hit = np.zeros(n, bool)
            for own in spans:
                for a, b in zip(own[::2], own[1::2], strict=True):
                    hit[a:b] = True
            rows.append((f, i, n, _spans(hit), sorted(set().union(*names))))
        yield _found(rows)


def _mark(windows, schema: pa.Schema):
    """(doc_id, text) -> doc_id, words, hit words, items."""

    def run(batches):
        for batch in pieces(batches):
            counts, hits, items = [], [], []
            for text in as_bytes(batch.column("text")):
                words = alnum_words(text)
                hit, owners = windows.value.find(words) if windows else (np.zeros(len(words), bool), ())
                counts.append(len(words))
                hits.append(_spans(hit))
                items.append(sorted(owners))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=schema.names)

    return run


class Benchmark:
    """The benchmark's windows, in blocks that can be broadcast."""

    def __init__(self, benchmark: DataFrame, width: int, block_bytes: int, segment_words: int):
        items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("t")).where("t IS NOT NULL")
        self.width, self.spark = width, benchmark.sparkSession
        self.segments = items.mapInArrow(_segments(width, segment_words), "item string, t binary")
        self.blocks = max(1, -(-(self.segments.agg(F.sum(F.length("t"))).head()[0] or 0) // block_bytes))

    def windows(self, b: int):
        part = self.segments if self.blocks == 1 else self.segments.where(F.pmod(F.xxhash64("item", "t"), F.lit(self.blocks)) == b)
        return self.spark.sparkContext.broadcast(Windows([(r["item"], bytes(r["t"])) for r in part.collect()], self.width))

    def found(self, rows: DataFrame) -> DataFrame:
        """A row per document with hits (f, i, n_words, hits, items), written; rows: f, i, text."""
        path = scratch(self.spark, "decontamination")
        with small_batches(self.spark):
            for b in range(self.blocks):
                held = self.windows(b)
                rows.select("f", "i", "text").mapInArrow(_find(held), _FOUND).write.mode("append").parquet(path)
                held.unpersist()
        found = self.spark.read.schema(_FOUND).parquet(path)
        if self.blocks == 1:
            return found
        found = found.groupBy("f", "i").agg(F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
        return saved(found.mapInArrow(_merge, _FOUND), f"{path}-all")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13, share: int = 20, block_bytes: int = 8 << 20, segment_words: int = 1 << 17) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hit_words.

    A document is contaminated if ``share * n_hit >= n_words`` and something was hit.  Null and empty text has
    no words; texts of any length are scanned whole.  Benchmark rows without words are ignored; an item without
    id counts under the empty string; rows with one item_id are one item.  Repeated documents give a row each;
    an empty table gives none, an empty benchmark no hits.  Other columns are ignored whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    bench = Benchmark(benchmark, width, block_bytes, segment_words)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    if bench.blocks == 1:
        schema = rows.select("doc_id").withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}).schema
        out = rows.mapInArrow(_mark(bench.windows(0), to_arrow_schema(schema)), schema)
    else:
        rows = keyed(rows, "row").select("doc_id", "row.f", "row.i", "text")
        found = bench.found(rows).drop("n_words")
        schema = rows.select("doc_id", "f", "i").withColumns({"n_words": F.lit(0).cast("long"), "none": F.array().cast("array<int>"), "nothing": F.array().cast("array<string>")}).schema
        words = rows.select("doc_id", "f", "i", "text").mapInArrow(_mark(None, to_arrow_schema(schema)), schema)
        out = words.join(found, ["f", "i"], "left").select("doc_id", "n_words", *(F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("hits", "array<int>"), ("items", "array<string>"))))
    out = out.withColumn("n_hit", _n_hit("hits"))
    sha = F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256")
    dirty = (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha, dirty.alias("contaminated"), F.col("hits").alias("hit_words"))


def _n_hit(hits: str):
    signed = F.transform(named(hits), lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)


def cut_words(text: bytes, spans: list[int]) -> bytes:
    """The text without the word intervals; each reaches from its first word's start to its last word's end."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(ALNUM_TABLE))]
    out, last = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join(out) + text[last:]


def _cut(text_at: int, counted: int | None):
    """Documents, the last column their hit words -> documents with cut texts."""

    def run(batches):
        for batch in pieces(batches):
            columns, texts = batch.columns[:-1], batch.column(text_at).to_pylist()
            texts = [cut_words(t.encode(), spans).decode() for t, spans in zip(texts, batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns[text_at] = pa.array(texts, pa.string())
            if counted is not None:
                columns[counted] = pa.array([len(t) for t in texts], columns[counted].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", width: int = 13, share: int = 20, block_bytes: int = 8 << 20, length_col: str | None = None, segment_words: int = 1 << 17) -> DataFrame:
    """docs without contaminated documents, and without the hit spans of the others; columns as in docs.

    All rules of ``contamination`` hold; null text stays null.  Where a text changes, ``length_col`` (if docs has
    it) gets its new number of code points; other columns pass through whatever their names.  Only the texts
    with hits come back from Python; documents are shuffled only where those are too many to broadcast.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    counted = names.index(length_col) if length_col in names else None
    rows = keyed(numbered(docs), "row").withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    found = Benchmark(benchmark, width, block_bytes, segment_words).found(rows.select("row.f", "row.i", F.col(f"c{at}").alias("text")))
    dirty = share * _n_hit("hits") >= F.col("n_words")
    found = saved(found.select(F.struct("f", "i").alias("row"), dirty.alias("dirty"), F.when(~dirty, F.col("hits")).alias("hits")), scratch(docs.sparkSession, "hits"))
    clean = rows.join(small_side(found.select("row")), "row", "left_anti").drop("row")
    cut = rows.join(small_side(found.where("NOT dirty").select("row", "hits")), "row").drop("row")
    return clean.unionByName(cut.mapInArrow(_cut(at, counted), clean.schema)).toDF(*names)


def op1(spark, sf_dir: str) -> DataFrame:
    """``contamination`` of the whole table ``documents`` by ``benchmark``, by its rules."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("hit_words")


OP1_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bl AS (SELECT item_id, ws, least(13, len(ws)) AS l FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(ws[i:i + l - 1], ' ') AS k FROM (SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM bl)),
ls AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT doc_id, l, i, array_to_string(ws[i:i + l - 1], ' ') AS k FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM w, ls WHERE len(ws) >= l)),
hit AS (SELECT doc_id, item_id, i, dw.l AS l FROM dw JOIN bw ON dw.l = bw.l AND dw.k = bw.k),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
