"""Toxicity scores from a factorization machine over hashed terms.

A document's terms are its different words and their prefixes of 4, 5 and 6 bytes, as 64-bit hashes.  Terms
whose document frequency differs between the classes (G-test) become features; the machine has a bias, a
weight and a short vector per feature, so a pair of terms (an insult and a group, say) can weigh more, or
less, than the sum of both.

Fitting uses a bounded sample: at most ``per_class`` labelled documents of each class, those with the smallest
hashes of their ids.  The sample's ids (bounded) are broadcast to pick the texts in one scan, one for each id;
term counts are aggregated by Spark; the driver gets at most ``features`` terms and the sample's feature numbers.  Scoring
covers every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, as_bytes, fresh, give_back, named, numbered, pieces, remove, saved, scratch, small_batches, text_or_empty, without

PREFIXES = (4, 5, 6)


def word_terms(word: bytes) -> list[int]:
    """64-bit hashes of a word and of its prefixes."""
    from xxhash import xxh3_64_intdigest

    return [xxh3_64_intdigest(word)] + [xxh3_64_intdigest(word[:n], seed=n) for n in PREFIXES if len(word) > n]


class _TermBytes(dict):
    """Word -> hashes of its terms as bytes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> bytes:
        out = np.array(word_terms(word), "<u8").tobytes()
        if len(self) >= 200_000:
            self.clear()
        self[word] = out
        return out


class _Numbers(dict):
    """Word -> feature numbers of its terms as bytes (mostly none)."""

    def __init__(self, known: dict[int, int]):
        super().__init__()
        self.known = known

    def __missing__(self, word: bytes) -> bytes:
        out = np.array([self.known[t] for t in word_terms(word) if t in self.known], "<i4").tobytes()
        if len(self) >= 200_000:
            self.clear()
        self[word] = out
        return out

    def of(self, text: bytes) -> np.ndarray:
        return np.unique(np.frombuffer(b"".join(map(self.__getitem__, set(alnum_words(text)))), "<i4"))


class FactorizationMachine:
    """y = b + sum w_i + sum over pairs <v_i, v_j>, on sets of feature numbers; logistic loss, Adagrad."""

    def __init__(self, features: int, rank: int = 8, seed: int = 7):
        self.b = 0.0
        self.w = np.zeros(features + 1)
        self.v = np.random.default_rng(seed).normal(0, 0.03, (features + 1, rank))

    def raw(self, flat: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(value of each of n documents, sum of the vectors of each)."""
        linear = np.bincount(owner, self.w[flat], n)
        sums = np.stack([np.bincount(owner, self.v[flat, k], n) for k in range(self.v.shape[1])], axis=1)
        squares = np.bincount(owner, (self.v[flat] ** 2).sum(axis=1), n)
        return self.b + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, flat: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(flat, owner, n)[0], -30, 30)))

    def gradients(self, flat: np.ndarray, owner: np.ndarray, sums: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features used, gradient of their weights, of their vectors) for the error of each document."""
        used, slot = np.unique(flat, return_inverse=True)
        step = error[owner][:, None] * (sums[owner] - self.v[flat])
        return used, np.bincount(slot, error[owner], len(used)), np.stack([np.bincount(slot, step[:, k], len(used)) for k in range(step.shape[1])], axis=1)

    def fit(self, sets: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 40, batch: int = 256, rate: float = 0.1, l2: float = 1e-4, seed: int = 7) -> None:
        rng, state = np.random.default_rng(seed), [0.0, np.zeros_like(self.w), np.zeros_like(self.v)]
        prior = np.average(labels, weights=weights)
        self.b = float(np.log(prior / (1 - prior)))
        for _ in range(epochs):
            order = rng.permutation(len(sets))
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                sizes = np.array([len(sets[d]) for d in some])
                flat = np.concatenate([np.empty(0, np.int32), *(sets[d] for d in some)]).astype(np.int64)
                owner = np.repeat(np.arange(len(some)), sizes)
                y, sums = self.raw(flat, owner, len(some))
                error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[some]) * weights[some] / weights[some].sum()
                g = error.sum()
                state[0] += g * g
                self.b -= rate * g / (1e-8 + state[0] ** 0.5)
                if not len(flat):
                    continue
                used, gw, gv = self.gradients(flat, owner, sums, error)
                gw, gv = gw + l2 * self.w[used], gv + l2 * self.v[used]
                state[1][used] += gw**2
                state[2][used] += gv**2
                self.w[used] -= rate * gw / (1e-8 + np.sqrt(state[1][used]))
                self.v[used] -= rate * gv / (1e-8 + np.sqrt(state[2][used]))


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 3, is 1 (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _terms(batches):
    known = _TermBytes()
    for part in pieces(batches, 64):
        found = [np.unique(np.frombuffer(b"".join(map(known.__getitem__, set(alnum_words(t)))), "<i8")) for t in as_bytes(part.column(1))]
        label = np.repeat(np.array(part.column(0).to_pylist(), np.int32), [len(f) for f in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *found])), pa.array(label, pa.int32())], ["term", "label"])
    known.clear()
    give_back()


def _g_test(a, b, na: int, nb: int):
    """G statistic of a of na against b of nb, as a Column."""
    share = (a + b) / F.lit(float(na + nb))
    part = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    return 2 * (part(a, na * share) + part(b, nb * share) + part(na - a, na * (1 - share)) + part(nb - b, nb * (1 - share)))


class Model:
    def __init__(self, terms: list[int], machine: FactorizationMachine | None, prior: float):
        self.known, self.machine, self.prior = {t: i for i, t in enumerate(terms)}, machine, prior


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 6000, features: int = 4096, least_g: float = 10.0, least_df: int = 3, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from labelled documents that are not held out (see ``held_out``).

    Rows of labels with a null doc_id or label are ignored; of repeated ones the largest label counts.  Of
    documents that repeat an id one is an example, the one whose text has the smallest hash.  Ties in the choice
    of terms go by their hashes.  With no example of one of the classes, or with empty tables, the model gives
    every text the share of toxic examples (0.5 without any).  Other columns are ignored whatever their names.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "toxicity")
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label")).where(~held_out())
    totals = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    if len(totals) < 2:
        return Model([], None, 0.5 if not totals else float(next(iter(totals))))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = [marks.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    chosen = [tuple(r) for c in chosen for r in c.collect()]
    sample = spark.createDataFrame(chosen, marks.schema)
    rows = docs.select(named(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    with small_batches(spark):
        rows = saved(rows.select("label", "text"), path)  # at most per_class documents a class
    n = {k: 0 for k in (0, 1)} | {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    counts = rows.mapInArrow(_terms, "term bigint, label int").groupBy("term").agg(F.sum((F.col("label") == 1).cast("double")).alias("a"), F.sum((F.col("label") == 0).cast("double")).alias("b")).where(F.col("a") + F.col("b") >= least_df)
    best = counts.withColumn("g", _g_test(F.col("a"), F.col("b"), n[1], n[0])).where(F.col("g") >= least_g).orderBy(F.desc("g"), "term").limit(features)
    terms = [r["term"] & 0xFFFFFFFFFFFFFFFF for r in best.select("term").collect()]
    known = {t: i for i, t in enumerate(terms)}

    def number(batches):
        find = _Numbers(known)
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([find.of(t) for t in as_bytes(batch.column(1))], pa.list_(pa.int32()))], ["label", "terms"])

    got = rows.mapInArrow(number, "label int, terms array<int>").collect()
    remove(spark, path)
    got = sorted((r["label"], tuple(r["terms"])) for r in got)
    y = np.array([label for label, _ in got], float)
    weights = np.where(y == 1, totals[1] / max(1, (y == 1).sum()), totals[0] / max(1, (y == 0).sum()))
    machine = FactorizationMachine(len(terms))
    if len(got) and 0 < y.sum() < len(y):
        machine.fit([np.array(t, np.int32) for _, t in got], y, weights)
        return Model(terms, machine, 0.5)
    return Model([], None, float(y.mean()) if len(y) else 0.5)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", out: str = "_score") -> DataFrame:
    """docs with one more column, the last: scores from 0 to 1.

    It is named ``out``, with underscores added where docs has such a name.  Null text is scored as empty text,
    texts of any length whole.  Equal texts have equal scores, repeated rows each their own; an empty table gives
    an empty result.  Other columns pass through whatever their names.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text_col), [*docs.columns, *fresh(docs.columns, out)]
    docs = numbered(docs)

    def run(batches):
        own = held.value
        find = _Numbers(own.known)
        for batch in pieces(batches):
            if own.machine is None:
                scores = np.full(batch.num_rows, own.prior)
            else:
                sets = [find.of(t) for t in as_bytes(batch.column(at))]
                flat = np.concatenate([np.empty(0, np.int32), *sets]).astype(np.int64)
                scores = own.machine.score(flat, np.repeat(np.arange(len(sets)), [len(s) for s in sets]), len(sets))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])
        find.clear()
        give_back()

    return docs.mapInArrow(run, docs.withColumn("score", F.lit(0.0)).schema).toDF(*names)


def drop_toxic(docs: DataFrame, labels: DataFrame, reject: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that score ``reject`` or more; columns as in docs, rules as in ``fit`` and ``with_scores``."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    return without(docs, lambda small, _: with_scores(small, model).where(F.col("_score") >= reject).select("key.*"), text=text_col)


def op9(spark, sf_dir: str) -> DataFrame:
    """Scores of the whole table ``documents``, learnt from ``labels``, by the rules of ``fit`` and ``with_scores``."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = with_scores(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.7).cast("int").alias("predicted"))
