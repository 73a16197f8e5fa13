"""Packing documents into sequences of fixed length: cutting stock by column generation.

Each document's ids (with an end id) are cut into full pieces, which are sequences of their own, and one
remainder.  Remainders are the items of a cutting-stock problem: lengths rounded up to classes of ``unit``
ids, at most ``length / unit`` classes.  The linear program over patterns (which classes share a sequence) is
solved by column generation: the simplex duals price the classes, a knapsack by dynamic programming finds the
best new pattern, until none improves.  Patterns are rounded down, what is left is placed greedily, still by
class counts.  Ranks then assign documents: the r-th document of a class takes the r-th slot of that class.

The driver sees one count per class.  Rounding up leaves a few ids free in each sequence.  The remainders of
one document in ``filler`` are therefore kept out, laid end to end, and cut to fill those gaps exactly; what
remains of them makes full sequences and at last sequences whose lengths are powers of two.

Ranks come from counters within a task plus sums over tasks, so nothing is sorted globally.  Texts are read
once and never shuffled; only fillers' ids move.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, claim, give_back, named, rows_of, saved, scratch, small_batches
from .encoding import default_path, encoder

_TOKENS = "doc_id {id}, f bigint, i bigint, part int, n bigint, crcs array<bigint>, n_full bigint, full_before bigint, rest bigint, rest_crc bigint, class int, rank bigint, fill_before bigint, ids binary"
_PIECE = "doc_id {id}, f bigint, i bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, place bigint"


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: (best value, how many of each item)."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    own, price = sizes[order], values[order]
    fits = np.searchsorted(own, np.arange(capacity + 1), "right")
    for w in range(1, capacity + 1):
        best[w], choice[w] = best[w - 1], -1
        if fits[w]:
            c = best[w - own[: fits[w]]] + price[: fits[w]]
            k = int(c.argmax())
            if c[k] > best[w] + 1e-12:
                best[w], choice[w] = c[k], k
    counts, w = np.zeros(len(sizes)), capacity
    while w > 0:
        if choice[w] < 0:
            w -= 1
        else:
            counts[order[choice[w]]] += 1
            w -= own[choice[w]]
    return float(best[capacity]), counts


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns as columns, how often each is used) of the linear program's solution."""
    m = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.linalg.inv(basis)
    for step in range(rounds):
        value, pattern = knapsack(inverse.sum(axis=0), sizes, capacity)  # duals: the costs are all 1
        if value <= 1 + 1e-9:
            break
        x, d = inverse @ demand, inverse @ pattern
        ratio = np.where(d > 1e-10, x / np.where(d > 1e-10, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / d[out]
            inverse = inverse - np.outer(d, row)
            inverse[out] = row
    return basis, np.maximum(0, np.linalg.solve(basis, demand.astype(float))) if m else np.zeros(0)


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """[(times, items of each class)] that has a slot for every item: rounded patterns, then a greedy rest."""
    if not len(sizes):
        return []
    basis, used = column_generation(sizes, demand, capacity)
    plan, left = [], demand.astype(np.int64).copy()
    for k, times in enumerate(np.floor(used + 1e-7).astype(int)):
        column = np.rint(basis[:, k]).astype(np.int64)
        if times > 0:
            plan.append((int(times), column))
            left -= times * column
    left = np.maximum(left, 0)
    order = np.argsort(-sizes)
    while left.any():
        room, column = capacity, np.zeros(len(sizes), np.int64)
        for c in order:
            column[c] = min(left[c], room // sizes[c])
            room -= column[c] * sizes[c]
        times = int((left[column > 0] // column[column > 0]).min())
        plan.append((times, column))
        left -= times * column
    return plan


class Slots:
    """Where the r-th document of a class goes."""

    def __init__(self, classes: list[int], plan: list[tuple[int, np.ndarray]]):
        self.of: dict[int, tuple[np.ndarray, ...]] = {}
        firsts = np.cumsum([0, *(t for t, _ in plan)])
        self.sequences = int(firsts[-1])
        for k, c in enumerate(classes):
            own = [(int(firsts[p]), t, int(a[k])) for p, (t, a) in enumerate(plan) if a[k]]
            first, times, each = np.array(own, np.int64).reshape(-1, 3).T
            self.of[c] = (np.cumsum(times * each) - times * each, first, each)

    def place(self, c: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place in its order) of ranks of class c."""
        before, first, each = self.of[c]
        p = np.searchsorted(before, ranks, "right") - 1
        own = ranks - before[p]
        return first[p] + own // each[p], c * 65536 + own % each[p]


def _encode(path: str, end_id: int, length: int, unit: int, filler: int):
    def run(batches):
        from pyspark import TaskContext

        claim("encoder")
        part, fulls, fills, ranks, at = TaskContext.get().partitionId(), 0, 0, {}, 0
        for batch in batches:
            for b in range(0, batch.num_rows, 64):
                some, rows = batch.slice(b, 64), []
                texts = [t or "" for t in some.column("text").to_pylist()]
                for doc_id, f, i, raw in zip(some.column("doc_id").to_pylist(), some.column("f").to_pylist(), some.column("i").to_pylist(), encoder(path).ids(texts), strict=True):
                    raw += end_id.to_bytes(4, "little")
                    n = len(raw) // 4
                    n_full = n // length
                    crcs = [zlib.crc32(raw[4 * length * k : 4 * length * (k + 1)]) for k in range(n_full)]
                    rest = n - n_full * length
                    tail = raw[4 * length * n_full :]
                    fill = rest > 0 and (at + part) % filler == 0
                    c = 0 if fill or not rest else -(-rest // unit)
                    rank = ranks.get(c, 0)
                    rows.append((doc_id, f, i, part, n, crcs, n_full, fulls, rest, zlib.crc32(tail), c, rank, fills, tail if fill else None))
                    if c:
                        ranks[c] = rank + 1
                    fulls, fills, at = fulls + n_full, fills + rest * fill, at + 1
                yield _batch(rows, _TOKENS, some.schema.field("doc_id").type)
        give_back()

    return run


def _batch(rows: list[tuple], ddl: str, doc_id: pa.DataType | None = None) -> pa.RecordBatch:
    schema = arrow_schema(ddl, doc_id=doc_id)
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _assign(slots: Slots, length: int):
    """Remainders with their global rank -> pieces."""

    def run(batches):
        for batch in batches:
            c, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, place = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
            for k in np.unique(c).tolist():
                sequence[c == k], place[c == k] = slots.place(k, rank[c == k])
            n, rest = batch.column("n").to_numpy(), batch.column("rest").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("f"), batch.column("i"), pa.array(n - rest), pa.array(rest), batch.column("rest_crc"), pa.array(n), pa.array(sequence), pa.array(place)], ["doc_id", "f", "i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "place"])

    return run


def _cut(batches):
    """Fillers with their cuts -> pieces with the CRC of their ids; place is the offset."""
    for batch in batches:
        rows = []
        for doc_id, f, i, n, rest, ids, cuts in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "f", "i", "n", "rest", "ids", "cuts")), strict=True):
            for c in cuts:
                rows.append((doc_id, f, i, n - rest + c["at"], c["length"], zlib.crc32(ids[4 * c["at"] : 4 * (c["at"] + c["length"])]), n, c["sequence_id"], c["offset"]))
        yield _batch(rows, _PIECE, batch.schema.field("doc_id").type)


def _spread(df: DataFrame, a: str, b: str, width: int) -> DataFrame:
    """A row for each stretch of ``width`` that [a, b) touches; an interval is never much longer than that."""
    return df.withColumn("stretch", F.explode(F.sequence(F.expr(f"{a} div {width}"), F.expr(f"({b} - 1) div {width}"))))


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2, length: int = 4096, unit: int = 16, filler: int = 48, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and row_id).

    Null or empty text is the end id alone; texts of any length are encoded whole.  Every id lies in exactly one
    piece.  Repeated rows are packed each on its own; documents of equal length are told apart by their rows.
    An empty table gives no piece.  Sequences shorter than ``length`` are to be padded, unless their length is a
    power of two.  ``key`` names a column of docs made by ``common.keyed``; else one is made.  Other columns are
    ignored whatever their names.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "packing")
    rows = rows_of(docs, key, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = dict(rows.dtypes)["doc_id"]
    token_ddl, piece_ddl = _TOKENS.format(id=kind), _PIECE.format(id=kind)
    with small_batches(spark):
        tokens = saved(rows.mapInArrow(_encode(tokenizer or default_path("word_bpe_49k.json"), end_id, length, unit, filler), token_ddl), f"{path}/tokens")

    items = tokens.where("class > 0")
    per_part = items.groupBy("class", "part").count()
    counts = {r["class"]: r["n"] for r in per_part.groupBy("class").agg(F.sum("count").alias("n")).collect()}
    classes = sorted(counts)
    slots = Slots(classes, whole_patterns(np.array(classes, np.int64), np.array([counts[c] for c in classes], np.int64), length // unit))
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("class", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    placed = items.join(offsets, ["class", "part"]).mapInArrow(_assign(slots, length), piece_ddl)
    inside = Window.partitionBy("sequence_id").orderBy("place")
    placed = placed.withColumn("offset", F.sum("length").over(inside) - F.col("length")).drop("place")
    placed = saved(placed, f"{path}/placed")

    # Full pieces: a sequence each, numbered after those of the patterns.
    sums = tokens.groupBy("part").agg(F.sum("n_full").alias("fulls"), F.sum(F.when(F.col("ids").isNotNull(), F.col("rest")).otherwise(0)).alias("fills"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = saved(sums.select("part", "fulls", "fills", F.coalesce(F.sum("fulls").over(order), F.lit(0)).alias("fulls_at"), F.coalesce(F.sum("fills").over(order), F.lit(0)).alias("fills_at")), f"{path}/sums")
    total = sums.agg(F.coalesce(F.sum("fulls"), F.lit(0)), F.coalesce(F.sum("fills"), F.lit(0))).head()
    full = tokens.where("n_full > 0").join(sums.select("part", "fulls_at"), "part").select("*", F.posexplode("crcs").alias("k", "crc"))
    full = full.select("doc_id", "f", "i", (F.col("k") * length).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), (slots.sequences + F.col("fulls_at") + F.col("full_before") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # Gaps and fillers on one axis.
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < length)
    used = saved(used.withColumn("block", F.expr("sequence_id div 4096")).withColumn("gap", length - F.col("used")), f"{path}/gaps")
    blocks = used.groupBy("block").agg(F.sum("gap").alias("gap"))
    at_block = blocks.select("block", F.coalesce(F.sum("gap").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("block_at"))
    within = Window.partitionBy("block").orderBy("sequence_id")
    gaps = used.withColumn("own", F.sum("gap").over(within) - F.col("gap")).join(at_block, "block")
    gaps = gaps.select("sequence_id", F.col("used").alias("base"), (F.col("block_at") + F.col("own")).alias("a"), (F.col("block_at") + F.col("own") + F.col("gap")).alias("b"))
    gap_total = blocks.agg(F.coalesce(F.sum("gap"), F.lit(0))).head()[0]
    tail = max(0, total[1] - gap_total)
    first, whole, rest = slots.sequences + total[0], tail // length, tail % length
    more = spark.range(whole).select((first + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("base"), (gap_total + F.col("id") * length).alias("a"), (gap_total + (F.col("id") + 1) * length).alias("b"))
    at, number = gap_total + whole * length, first + whole
    for bit in reversed(range(length.bit_length())):
        if rest >> bit & 1:
            more = more.union(spark.range(1).select(F.lit(number).cast("long"), F.lit(0).cast("long"), F.lit(at).cast("long"), F.lit(at + (1 << bit)).cast("long")))
            at, number = at + (1 << bit), number + 1
    fills = tokens.where("ids IS NOT NULL").join(sums.select("part", "fills_at"), "part").select("f", "i", (F.col("fills_at") + F.col("fill_before")).alias("c"), (F.col("fills_at") + F.col("fill_before") + F.col("rest")).alias("d"))
    met = _spread(gaps.union(more), "a", "b", length).join(_spread(fills, "c", "d", length), "stretch")
    lo, hi = F.greatest("a", "c"), F.least("b", "d")
    met = met.where((lo < hi) & (F.expr(f"greatest(a, c) div {length}") == F.col("stretch")))
    cuts = met.select("f", "i", F.struct((lo - F.col("c")).alias("at"), (hi - lo).alias("length"), "sequence_id", (F.col("base") + lo - F.col("a")).alias("offset")).alias("cut")).groupBy("f", "i").agg(F.collect_list("cut").alias("cuts"))
    cut = tokens.where("ids IS NOT NULL").select("doc_id", "f", "i", "n", "rest", "ids").join(cuts, ["f", "i"]).mapInArrow(_cut, piece_ddl).withColumnRenamed("place", "offset")
    order_ = ["doc_id", "f", "i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    out = placed.select(order_).union(full.select(order_)).union(cut.select(order_))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.struct("f", "i").alias("row_id"))


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer: str | None = None, end_id: int = 2, text_col: str = "text", key: str = "row_id") -> DataFrame:
    """(sequence_id, ids): the packed ids.  docs holds the key that was given to ``pack``; null text is empty."""
    cuts = pieces.groupBy("row_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    path = tokenizer or default_path("word_bpe_49k.json")

    def run(batches):
        for batch in batches:
            rows = []
            for raw, cuts in zip(encoder(path).ids([t or "" for t in batch.column("text").to_pylist()]), batch.column("cuts").to_pylist(), strict=True):
                ids = np.append(np.frombuffer(raw, "<u4"), end_id).astype(np.int64)
                rows += [(c["sequence_id"], c["offset"], ids[c["start"] : c["start"] + c["length"]].tolist()) for c in cuts]
            yield _batch(rows, "sequence_id bigint, offset bigint, ids array<bigint>")

    parts = docs.select(named(key).alias("row_id"), named(text_col).cast("string").alias("text")).join(cuts, "row_id").select("text", "cuts").mapInArrow(run, "sequence_id bigint, offset bigint, ids array<bigint>")
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def op8(spark, sf_dir: str) -> DataFrame:
    """``pack`` of the whole table ``documents``, by its rules."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")
