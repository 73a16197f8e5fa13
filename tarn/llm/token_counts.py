"""Token counts by field and section.

A document's fields are put together and encoded once, as training would see them.  The byte lengths of a
byte-level tokenizer's tokens give every token's span without a second pass; spans are joined to the sorted
section boundaries by binary search.  A token that crosses a boundary is given by an explicit rule:

``majority``  to the section that holds most of its bytes, the first of equals
``start``     to the section that holds its first byte

Counts therefore add up to the document's tokens.  The joiner between fields belongs to the field before it,
the line end to the line that it ends.  Rows are independent: no shuffle.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, pieces
from .encoding import default_path, encoder

RULES = ("majority", "start")
_LENGTHS: dict[str, np.ndarray] = {}


def token_bytes(path: str) -> np.ndarray:
    """Bytes of each id of a byte-level vocabulary: a letter stands for a byte."""
    if path not in _LENGTHS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec.get("decoder") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError("a byte-level tokenizer without normaliser is needed")
        vocabulary = dict(spec["model"]["vocab"])
        out = np.zeros(max([*vocabulary.values(), *(t["id"] for t in spec["added_tokens"])]) + 1, np.int64)
        for token, i in vocabulary.items():
            out[i] = len(token)
        for t in spec["added_tokens"]:
            out[t["id"]] = len(t["content"].encode())
        _LENGTHS[path] = out
    return _LENGTHS[path]


def owners(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary).  ``bounds`` are the sections' ends, ascending."""
    first = np.searchsorted(bounds, starts, "right")
    last = np.searchsorted(bounds, ends - 1, "right")
    crossing = last > first
    if rule == "majority":
        for k in np.flatnonzero(crossing).tolist():
            edges = np.concatenate([[starts[k]], bounds[first[k] : last[k]], [ends[k]]])
            first[k] += int(np.diff(edges).argmax())
    return first, crossing


def _attribute(path: str, fields: tuple[str, ...], lines_of: str, joiner: bytes, rule: str):
    def run(batches):
        sizes = token_bytes(path)
        for batch in pieces(batches, 512, "encoder"):
            columns = [[(x or "").encode() for x in batch.column(f"_{k}").to_pylist()] for k in range(len(fields))]
            texts = [joiner.join(parts) for parts in zip(*columns, strict=True)]
            counts: list[list[int]] = [[] for _ in fields]
            lines, crossings, totals = [], [], []
            for b in range(0, len(texts), 256):
                raws = encoder(path).ids([t.decode() for t in texts[b : b + 256]])
                for d, raw in enumerate(raws, b):
                    ids = np.frombuffer(raw, "<u4")
                    ends = np.cumsum(sizes[ids])
                    starts = ends - sizes[ids]
                    bounds, at, kind, line_range = [], 0, [], (0, 0)
                    for k, name in enumerate(fields):
                        value = columns[k][d]
                        whole = len(value) + (len(joiner) if k < len(fields) - 1 else 0)
                        if name == lines_of:
                            own = np.flatnonzero(np.frombuffer(value, np.uint8) == 10) + 1 + at
                            own = [*own.tolist(), at + whole]
                            line_range = (len(bounds), len(bounds) + len(own))
                        else:
                            own = [at + whole]
                        bounds += own
                        kind += [k] * len(own)
                        at += whole
                    section, crossing = owners(starts, ends, np.array(bounds, np.int64), rule)
                    per = np.bincount(section, minlength=len(bounds)) if len(ids) else np.zeros(len(bounds), np.int64)
                    by_field = np.bincount(kind, per, len(fields)).astype(np.int64)
                    for k in range(len(fields)):
                        counts[k].append(int(by_field[k]))
                    lines.append(per[line_range[0] : line_range[1]].astype(np.int64))
                    crossings.append(int(crossing.sum()))
                    totals.append(len(ids))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(totals, pa.int64()), *(pa.array(c, pa.int64()) for c in counts), pa.array(lines, pa.list_(pa.int64())), pa.array(crossings, pa.int64())], ["doc_id", "n_tokens", *(f"{c}_tokens" for c in fields), "line_tokens", "n_crossing"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("source", "lang", "text"), lines_of: str = "text", joiner: str = " ", rule: str = "majority", tokenizer: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_tokens, <field>_tokens for each field, line_tokens, n_crossing.

    ``line_tokens`` has a count for each line of ``lines_of`` (null or empty: one line).  Null fields are
    empty; texts of any length are encoded whole.  A token that several sections hold equal parts of belongs to
    the first.  Repeated rows each give a row; an empty table gives none; other columns are ignored whatever
    their names.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, n_tokens bigint, {', '.join(f'{c}_tokens bigint' for c in fields)}, line_tokens array<bigint>, n_crossing bigint"
    rows = docs.select(named(id_col).alias("_id"), *(named(c).cast("string").alias(f"_{k}") for k, c in enumerate(fields)))
    return rows.mapInArrow(_attribute(tokenizer or default_path("byte_bpe_50k.json"), tuple(fields), lines_of, joiner.encode(), rule), schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """``token_counts`` of the whole table ``documents``, by its rules."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
