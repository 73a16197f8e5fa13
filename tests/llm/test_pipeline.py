"""The pipeline against what its stages promise, on the smallest tables."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tarn.llm import decontamination, encoding, exact_dedup, near_dedup, toxicity
from tarn.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    model, ids = toxicity.fit(docs, labels), {}
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, current, SF)
        assert after.columns == docs.columns
        ids[name] = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "toxicity":
            assert ids[name] == {r.doc_id for r in toxicity.with_scores(docs, model).where("_score < 0.7").collect()}
        elif name == "exact_dedup":
            assert ids[name] == {r.doc_id for r in exact_dedup.exact_duplicates(current).where("kept").collect()}
        elif name == "near_dedup":
            assert ids[name] == {r.doc_id for r in near_dedup.near_duplicates(current).where("kept").collect()}
        else:
            assert ids[name] == {r.doc_id for r in decontamination.contamination(current, bench).where("NOT contaminated").collect()}
            assert decontamination.contamination(after, bench).where("contaminated").isEmpty()
        current = corpus_pipeline.saved(after, corpus_pipeline.scratch(spark, "test"))
    texts = {r.doc_id: r.text for r in current.collect()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    whole = encoding.encoder(encoding.default_path("word_bpe_49k.json"))
    tokens = Counter()
    for p in pieces:
        ids_ = whole.tokenizer.encode(texts[p.doc_id], add_special_tokens=False).ids + [2]
        assert zlib.crc32(np.array(ids_[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        tokens[p.doc_id] += p.length
    assert tokens == {i: len(whole.tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


@pytest.mark.parametrize("name", SQL)
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    theirs = con.sql(SQL[name])
    ours = QUERIES[name](spark, SF).select(*theirs.columns)
    assert Counter(map(tuple, ours.collect())) == Counter(theirs.fetchall())
