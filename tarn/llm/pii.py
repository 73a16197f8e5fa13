"""Personal data: base patterns, and terms that give a protected entity away.

Base spans (email, ip, card, phone) are found in whole texts, left to right, each kind without overlaps.
Every different value found is a protected entity c.  Terms are the words of three letters or more of the
documents that hold c, wherever they stand.  Over the corpus, PMI(c; t) = log2(N * n(c, t) / (n(c) * n(t)))
bits tell how strongly t reveals c, where n(c, t) counts documents with t and c, and n(c), n(t) documents with
c or t.  It is at most IC(c) = log2(N / n(c)).  A term that reaches ``alpha * IC(c)`` is disclosing, also when
c stands in a single document; ``support`` can ask for more documents, the default asks for none.  All
occurrences of a disclosing term in the documents that hold c become spans of kind ``term``.  Sanitising
generalises base spans to their kind and removes disclosing terms.

Only documents that hold a value have candidates.  As n(c, t) <= n(c), a term can reach the limit only where
n(t) <= n(c)^alpha * N^(1 - alpha): others are left out before pairs are made, which changes no result.  All
counts are pre-aggregated per task; n(t) needs one more pass over the texts, for candidate terms only while
their measured number fits a broadcast, else for all terms.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, numbered, pieces, remove, rows_of, saved, scratch

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> list[tuple[int, int]]:
    """The pattern's leftmost matches: a local part always starts where its run of characters does."""
    out, limit, at = [], 0, text.find("@")
    while at >= 0:
        j = at
        while j > limit and text[j - 1] in _LOCAL:
            j -= 1
        m = _DOMAIN.match(text, at + 1) if j < at else None
        if m:
            out.append((j, m.end()))
        limit = m.end() if m else at + 1
        at = text.find("@", limit)
    return out


def addresses(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        groups, at, k = [], m.start(), 0
        for g in m[0].split("."):
            groups.append((at, g))
            at += len(g) + 1
        while k + 3 < len(groups):
            four = groups[k : k + 4]
            if all(g for _, g in four):
                if all(len(g.lstrip("0")) <= 3 and int(g[-4:]) <= 255 for _, g in four):
                    out.append((four[0][0], four[3][0] + len(four[3][1])))
                k += 4
            else:
                k += 1
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT.findall(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s) for s in addresses(text)] + [("card", *s) for s in cards(text)]
        if "+" in text:
            out += [("phone", *s) for s in phones(text)]
    return out


def entity(kind: str, value: str) -> int:
    """A signed 64-bit name of a protected value."""
    from xxhash import xxh3_64_intdigest

    value = value.lower() if kind in ("email", "ip") else "".join(_DIGIT.findall(value))
    h = xxh3_64_intdigest(f"{kind}:{value}")
    return h - (1 << 64) if h >= 1 << 63 else h


def words_beside(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """All words of a text with base spans: term and places.  Words that touch a base span are none."""
    places: dict[str, list[dict]] = {}
    taken, k, last = sorted((a, b) for _, a, b in spans), 0, 0
    for m in _WORD.finditer(text):
        x, y = m.span()
        while k < len(taken) and taken[k][0] < y:  # the spans that start before the word's end
            last = max(last, taken[k][1])
            k += 1
        if last <= x:
            places.setdefault(m[0].lower(), []).append({"a": x, "b": y})
    return [{"t": t, "at": at} for t, at in places.items()]


_WORDS = pa.list_(pa.struct([("t", pa.string()), ("at", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))
_FOUND = "f bigint, i bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, base_sha256 string, entities array<bigint>, words array<struct<t:string,at:array<struct<a:int,b:int>>>>"


def _find(batches):
    for batch in pieces(batches):
        rows = []
        for text in batch.column("text").to_pylist():
            spans = base_spans(text or "")
            base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            n = [sum(k == kind for k, _, _ in spans) for kind in KINDS] if spans else [0, 0, 0, 0]
            rows.append((*n, base, hashlib.sha256(base.encode()).hexdigest(), sorted({entity(k, text[a:b]) for k, a, b in spans}) if spans else [], words_beside(text, spans) if spans else []))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.list_(pa.int64()), _WORDS]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("f"), batch.column("i"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "f", "i", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "entities", "words"])


def _document_counts(wanted):
    """Per batch: in how many documents each (wanted) term stands."""

    def run(batches):
        own = wanted.value if wanted is not None else None
        for batch in batches:
            counts: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                words = {w.lower() for w in set(_WORD.findall(text or ""))}
                for w in words & own if own is not None else words:
                    counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["t", "n_t"])

    return run


def personal_data(docs: DataFrame, support: int = 1, alpha: float = 0.75, broadcast_terms: int = 500_000, id_col: str = "doc_id", text_col: str = "text", key: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, row_id.

    ``spans`` lists ``kind:start:end`` by kind (term last), then start, comma-joined.  Null and empty text has
    no spans; texts of any length are scanned whole.  Repeated rows are documents of their own, each counted.
    Terms of equal weight are all kept or all left out.  An empty table gives an empty result.  ``key`` names a
    column of docs made by ``common.keyed``; else one is made.  Other columns are ignored whatever their names.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "pii")
    rows = rows_of(docs, key, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = dict(rows.dtypes)["doc_id"]
    found = saved(rows.mapInArrow(_find, f"doc_id {kind}, {_FOUND}"), f"{path}/found")

    n = float(found.count())
    n_c = found.select(F.explode("entities").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n_c"))
    n_c = saved(n_c, f"{path}/n_c")
    most = n_c.agg(F.max("n_c")).first()[0] or 0
    words = found.where(F.size("entities") > 0).select("f", "i", F.explode("words").alias("w")).select("f", "i", "w.*")
    terms = words.select("t").distinct()
    wanted = None
    if terms.count() <= broadcast_terms:
        wanted = spark.sparkContext.broadcast(frozenset(r["t"] for r in terms.collect()))
    n_t = rows.select("text").mapInArrow(_document_counts(wanted), "t string, n_t bigint").groupBy("t").agg(F.sum("n_t").alias("n_t"))
    limit = lambda c: F.pow(c, F.lit(alpha)) * n ** (1 - alpha) * (1 + 1e-9)
    rare = saved(words.join(n_t.where(F.col("n_t") <= limit(F.lit(float(most)))), "t"), f"{path}/rare")

    held = found.select("f", "i", F.explode("entities").alias("c")).join(n_c, "c")
    both = rare.select("f", "i", "t", "n_t").join(held, ["f", "i"]).where(F.col("n_t") <= limit(F.col("n_c")))
    both = saved(both, f"{path}/both")
    scored = both.groupBy("c", "t", "n_c", "n_t").agg(F.count(F.lit(1)).alias("n_ct")).where(F.col("n_ct") >= support)
    pmi = F.log2(F.lit(n) * F.col("n_ct") / (F.col("n_c") * F.col("n_t")))
    bits = F.log2(F.lit(n) / F.col("n_c"))
    disclosing = scored.where((bits > 0) & (pmi >= alpha * bits - 1e-9)).select("c", "t")

    marked = both.join(disclosing, ["c", "t"]).select("f", "i", "t").distinct()
    places = rare.join(marked, ["f", "i", "t"]).select("f", "i", F.explode("at").alias("x"))
    spans = places.groupBy("f", "i").agg(F.sort_array(F.collect_list("x")).alias("terms"))
    spans = saved(spans, f"{path}/spans")
    remove(spark, *(f"{path}/{x}" for x in ("n_c", "rare", "both")))
    out = found.join(spans, ["f", "i"], "left")
    more = F.transform(F.coalesce("terms", F.array()), lambda x: F.concat(F.lit("term:"), x["a"].cast("string"), F.lit(":"), x["b"].cast("string")))
    listed = F.array_join(F.filter(F.concat(F.array("base"), more), lambda x: x != ""), ",")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", listed.alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"), F.struct("f", "i").alias("row_id"))


def sanitised_text(text: str, spans: str) -> str:
    """Base spans become <KIND>, disclosing terms go; where spans overlap the one that starts first rules."""
    out, last = [], 0
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if a >= last:
            out += [text[last:a], "" if kind == "term" else f"<{kind.upper()}>"]
            last = b
        elif b > last:
            last = b
    return "".join(out) + text[last:]


def sanitise(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs with sanitised texts; columns as in docs, null text stays null.

    The spans are those of ``personal_data``, whose rules hold here; other columns pass through whatever their
    names.
    """
    at, names = docs.columns.index(text_col), docs.columns
    rows = keyed(numbered(docs), "row")
    small = rows.select(F.col(f"c{at}").alias("text"), F.lit(0).alias("doc_id"), F.col("row").alias("key"))
    spans = personal_data(small, key="key", **how).where("spans <> ''").select(F.col("row_id").alias("row"), "spans")
    joined = rows.join(spans, "row", "left").drop("row")

    def run(batches):
        for batch in batches:
            texts = [t if not s or t is None else sanitised_text(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, joined.drop("spans").schema).toDF(*names)


def op6(spark, sf_dir: str) -> DataFrame:
    """``personal_data`` of the whole table ``documents``, by its rules."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")
