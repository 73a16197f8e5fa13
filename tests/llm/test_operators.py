"""Operators against brute force on small odd tables: nulls, empty and long texts, ties, repeated rows, clashing names."""

import hashlib
import math
import os
import random
import re
import struct
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from tarn.llm import common, decontamination, encoding, exact_dedup, line_dedup, near_dedup, packing, pii, token_counts, token_store, toxicity, warc_zip

RNG = random.Random(3)
WORDS = ["alpha", "beta", "Gamma", "delta", "Épsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "ñu", "xi"]
LONG = " ".join(RNG.choice(WORDS) + str(RNG.randrange(500)) for _ in range(12000))
BASE = " ".join(RNG.choice(WORDS) + str(RNG.randrange(90)) for _ in range(120))
EDITED = BASE.replace(BASE.split()[60], "changed", 1)
PASSAGE = " ".join(f"bench{i}" for i in range(20))
TEXTS = [
    None, "", " \t\n", "one", "One\n", "  o n e ", BASE, BASE, EDITED, BASE.upper(), LONG, LONG + " tail", f"before {PASSAGE} after", PASSAGE.upper(),
    "mail a.b@c.de and 10.1.2.3, +1 (555) 123-4567, 4111 1111 1111 1111", "x@y a@b.c_d@e.f.g 1.2.3.4.5.6.7.8 999.1.1.1 1..2.3.4 +12", "line\n\n Shared Line \nend", "héllo — wörld “q” 日本語 x", "<|endoftext|> tok", "a  b   c \n \n d",
] + [f"text {i}\nshared line\t\nSHARED LINE\nend {i % 3}" for i in range(12)]
ROWS = [(None if i == 4 else 7 if i == 5 else i, t, "en", "text", 1) for i, t in enumerate(TEXTS)] + [(6, BASE, "en", "again", 2)]
SCHEMA = "doc_id long, text string, lang string, norm string, n int"


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """Columns norm and n clash with names that operators use inside."""
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(got, expected):
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def strip_white(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact_dedup(docs, empty):
    got = exact_dedup.exact_duplicates(docs, capacity=2).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[strip_white(r[1])].append(r)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((r[0], min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0], len(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for r in g)
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(empty).collect() == []


def test_exact_dedup_of_made_rows_and_colliding_keys(spark):
    from pyspark.sql import functions as F

    made = spark.createDataFrame([(i, f"t{i % 7}") for i in range(50)], "doc_id long, text string").withColumn("text", F.col("text"))
    got = exact_dedup.exact_duplicates(made, capacity=1, hasher=lambda norm: F.length(norm).cast("long")).collect()
    assert {(r.doc_id, r.keep_id) for r in got} == {(i, i % 7) for i in range(50)} and {r.chain for r in got} == set(range(1, 8))


def test_owners_choose_in_their_buckets(spark, docs):
    rows = common.rows_of(docs, None, doc_id="doc_id", text="text")
    for capacity, depth, broadcast in ((16384, 16, 500_000), (1, 2, 0), (2, 3, 500_000)):
        index = exact_dedup.ExtendibleIndex(rows, capacity, depth, exact_dedup.hash64, broadcast)
        table = index.table.collect()
        owners = {r.bucket: r.file for r in index.table.selectExpr("bucket", "_metadata.file_path AS file").collect()}
        assert len({(r.bucket, r.file) for r in index.table.selectExpr("bucket", "_metadata.file_path AS file").collect()}) == len(owners)
        assert len({r.text_sha256 for r in table}) == len(table) and sum(r.group_size for r in table) == len(ROWS)
        assert max(Counter(r.bucket for r in table).values()) <= max(capacity, 1)  # also where two bits are far too few
    plan = spark.read.parquet(f"{index.path}/buckets")
    assert plan.columns == index.table.columns


def test_exact_dedup_starts_no_python(spark, docs):
    plan = exact_dedup.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_directory_doubles():
    directory, buckets = exact_dedup.split_buckets({0: 5, 1: 5, 2: 1, 7: 1}, 4, 3)
    assert len(directory) == 8 and sorted(d for _, d in buckets) == [1, 2, 3, 3]
    assert all(directory[p << (3 - d)] == b for b, (p, d) in enumerate(buckets))
    assert exact_dedup.split_buckets({}, 4, 3) == ([0], [(0, 0)])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return (t or "").encode().lower().decode()


def test_contamination(spark, docs, empty):
    items = [(1, PASSAGE), (2, "one"), (3, None), (4, "..."), (None, PASSAGE), (11, " ".join(LONG.split()[5000:5030])), (1, "alpha1 beta2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall(ascii_lower(t))
        for k in range(max(0, len(w) - min(13, len(w)) + 1) if w else 0):
            windows[tuple(w[k : k + min(13, len(w))])].add("" if i is None else str(i))
    expected = []
    for r in ROWS:
        w, hit, own = WORD.findall(ascii_lower(r[1])), set(), set()
        for size in {len(k) for k in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit.update(range(k, k + size))
                    own |= windows[tuple(w[k : k + size])]
        expected.append((r[0], len(w), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for block, words in ((8 << 20, 1 << 17), (60, 1 << 17), (100, 14), (8 << 20, 15)):
        got = decontamination.contamination(docs, bench, block_bytes=block, segment_words=words).drop("hit_words").collect()
        same([tuple(r) for r in got], expected)
    clean = decontamination.decontaminate(docs, bench, length_col="n").collect()
    assert len(clean) == sum(not e[5] for e in expected)
    long = next(r for r in clean if r.doc_id == 10)
    assert " ".join(LONG.split()[5000:5030]) not in long.text and long.n == len(long.text) and len(LONG) - len(long.text) > 100
    assert decontamination.contamination(empty, bench).collect() == []
    assert all(not r.n_hit for r in decontamination.contamination(docs, bench.limit(0)).collect())


def test_lines(docs, empty):
    key = lambda x: ascii_lower(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x))
    counts = Counter(k for r in ROWS for k in {key(x) for x in (r[1] or "").split("\n")} if k)
    expected = []
    for r in ROWS:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if counts[key(x)] < 10]
        expected.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    for bound in (500_000, 0):
        out = line_dedup.drop_frequent_lines(docs, broadcast_lines=bound)
        assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
        same([(r.doc_id, r._n_lines, r._n_dropped, r.text or "") for r in out.collect()], expected)
    assert sum(e[2] for e in expected) >= 25
    assert line_dedup.drop_frequent_lines(empty).collect() == []


def test_line_key_length(docs):
    assert {r._n_dropped for r in line_dedup.drop_frequent_lines(docs, least=12).collect()} == {0}


SAMPLES = ["".join(RNG.choice("  \n\t\r aAbBé'sñ.,!19ßΣ—“’×日́") for _ in range(RNG.randrange(30))) for _ in range(400)] + [t or "" for t in TEXTS]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    enc = encoding.Encoder(encoding.default_path(name), bound=50)
    assert enc.rule == name[:4]
    for t, got in zip(SAMPLES, enc.ids(SAMPLES), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def ids_of(name, text, end):
    enc = encoding.encoder(encoding.default_path(name))
    return enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_token_store(spark, docs, empty):
    path = token_store.write_store(docs, common.scratch(spark, "t"), bits=6)
    got = token_store.read_store(spark, path).collect()
    sizes = Counter()
    expected = Counter()
    for r in ROWS:
        ids = ids_of("byte_bpe_50k.json", r[1], 0)
        expected[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        sizes[r[0]] += len(ids)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_store.verify_manifest(spark, path)
    whole = token_store.reconstruct(spark, path, [10, 11]).collect()
    assert {r.doc_id: r.ids for r in whole} == {i: ids_of("byte_bpe_50k.json", TEXTS[i], 0) for i in (10, 11)}
    chunks = token_store.objects(spark, path).where("kind = 0")
    assert chunks.count() == chunks.select("key").distinct().count()
    stored, used = chunks.selectExpr("sum(n)").head()[0], sum(sizes.values())
    assert stored < 0.75 * used  # LONG and its longer copy share their chunks
    none = token_store.write_store(empty, common.scratch(spark, "t"))
    assert token_store.read_store(spark, none).collect() == [] and token_store.verify_manifest(spark, none)


def test_broken_chunk_is_found(spark, docs):
    path = token_store.write_store(docs.limit(3), common.scratch(spark, "t"))
    bad = token_store.objects(spark, path).selectExpr("key", "doc_id", "n + if(kind = 0, 1, 0) AS n", "data", "kind").collect()
    spark.createDataFrame(bad, token_store.objects(spark, path).schema).write.partitionBy("kind").mode("overwrite").parquet(f"{path}/objects")
    with pytest.raises(Exception, match="does not hold what its address says"):
        token_store.read_store(spark, path).collect()


def test_crc_join_and_cuts():
    a, b = RNG.randbytes(31), RNG.randbytes(70001)
    assert common.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    ids = np.array([RNG.randrange(50000) for _ in range(60000)], np.uint32)
    ends, moved = token_store.cuts(ids), token_store.cuts(np.concatenate([ids[:100], ids]))
    assert ends[-1] == len(ids) and len({e + 100 for e in ends} & set(moved)) > len(ends) // 2
    assert token_store.cuts(ids[:0]) == [0] or token_store.cuts(ids[:0]) == []


@pytest.fixture(scope="module")
def pages(spark):
    same_ = "<p>" + "ä" * 120
    rows = [(1, "http://a b\n", same_, 0), (5, None, same_, 0), (0, "u", same_, 0), (None, "v", same_, 0), (2, "w", None, 0), (3, "w", "", 0), (4, "x", "short", 0), (6, "x", "short", 0), (0, "again", same_, 0), (8, "y", LONG * 3, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_warc(spark, pages):
    folder = common.scratch(spark, "w")
    manifest = warc_zip.write_archives(pages, folder, roll_bytes=300)
    got = warc_zip.read_archives(spark, folder).collect()
    assert len(got) == 10 == sum(r.records for r in manifest.collect())
    by = Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got)
    n = 3 + 240
    assert by == Counter([(1, n, "revisit", 0), (5, n, "revisit", 0), (0, n, "response", None), (0, n, "revisit", 0), (None, n, "revisit", 0), (2, 0, "response", None), (3, 0, "response", None), (4, 5, "response", None), (6, 5, "response", None), (8, 3 * len(LONG.encode()), "response", None)])
    archive = manifest.collect()[0].archive
    for headers, payload, entry in warc_zip.read_archive(folder, archive):
        assert headers["WARC-Type"] == entry["type"] and (entry["type"] == "revisit" or hashlib.sha256(payload).hexdigest() == headers["WARC-Payload-Digest"][7:])
    none = common.scratch(spark, "w")
    assert warc_zip.write_archives(pages.limit(0), none).collect() == [] and warc_zip.read_archives(spark, none).collect() == []


def test_zip64_directory(tmp_path):
    path = tmp_path / "many.zip"
    with zipfile.ZipFile(path, "w") as z:  # more members than a plain directory can count
        for i in range(65540):
            z.writestr(f"m{i}", b"")
        z.writestr("last", b"payload")
        z.comment = b"PK\5\6 not the end"
    with open(path, "rb") as f:
        reader = warc_zip.ZipReader(f, path.stat().st_size)
        at, size = reader.place("last")
        assert len(reader.members) == 65541 and reader.read(at, size) == b"payload"
    deflated = tmp_path / "d.zip"
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    with open(deflated, "rb") as f, pytest.raises(ValueError, match="not stored"):
        warc_zip.ZipReader(f, deflated.stat().st_size).place("a")


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_token_counts(docs, empty, rule):
    fields = ("lang", "text")
    got = token_counts.token_counts(docs, fields=fields, rule=rule).collect()
    enc = encoding.encoder(encoding.default_path("byte_bpe_50k.json"))
    expected = []
    for r in ROWS:
        text = (r[1] or "").encode()
        whole = b"en " + text
        owner = ["lang"] * 3 + [k for k, line in enumerate(text.split(b"\n")) for _ in range(len(line) + 1)][: len(text)]
        counts, at, crossing = Counter(), 0, 0
        ids = enc.tokenizer.encode(whole.decode(), add_special_tokens=False).ids
        sizes = token_counts.token_bytes(encoding.default_path("byte_bpe_50k.json"))
        for i in ids:
            own = owner[at : at + int(sizes[i])]
            at += int(sizes[i])
            crossing += len(set(map(str, own))) > 1
            best = Counter(own)
            counts[own[0] if rule == "start" else max(best, key=lambda k: (best[k], -own.index(k)))] += 1
        assert at == len(whole)
        lines = [counts[k] for k in range(text.count(b"\n") + 1)]
        expected.append((r[0], len(ids), counts["lang"], sum(lines), lines, crossing))
    same([tuple(r) for r in got], expected)
    assert token_counts.token_counts(empty, fields=fields).collect() == []


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, p in PATTERNS:
        for m in re.finditer(p, text):
            digits = re.sub(r"\D", "", m[0])
            bad = kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15
            if not bad:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_patterns():
    for _ in range(4000):
        t = "".join(RNG.choice(["a", "b.", "@", ".", "-", "_", " ", "1", "22", "4111 1111 1111 1111", "+1", "(5) ", "255", "300", "c.de", "é", "%"]) for _ in range(RNG.randrange(16)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("1" * 50000 + "@" + "a" * 50000 + "@" * 300) == plain_spans("1" * 10)


def test_personal_data(spark, docs, empty):
    got = pii.personal_data(docs).collect()
    same([(r.doc_id, r.base_sha256) for r in got], [(r[0], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in plain_spans(r[1] or "")).encode()).hexdigest()) for r in ROWS])
    assert pii.personal_data(empty).collect() == []
    told = [(i, f"the agent zorro{'x' * (i % 2)} wrote to us from me@home.org about the thing {i}" if i < 8 else f"the thing {i} about us from the agent") for i in range(40)]
    people = spark.createDataFrame(told, "doc_id long, text string")
    for bound in (500_000, 0):
        spans = {r.doc_id: r.spans for r in pii.personal_data(people, support=5, broadcast_terms=bound).collect()}
        for i, t in told:
            terms = {t[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans[i].split(",") if s.startswith("term")}
            assert terms == ({"wrote"} if i < 8 else set()), (i, spans[i])
    clean = {r.doc_id: r.text for r in pii.sanitise(people, support=5).collect()}
    assert "<EMAIL>" in clean[0] and "wrote" not in clean[0] and "me@home" not in clean[0] and clean[20] == told[20][1]


def test_rare_values_have_terms(spark):
    told = [(i, "the agent zorro wrote from me@home.org" if i == 3 else f"the agent wrote thing {i}") for i in range(40)]
    spans = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(told, "doc_id long, text string")).collect()}
    assert spans[3] == "email:27:38,term:10:15,term:22:26" and not any(v for i, v in spans.items() if i != 3)


def test_lost_or_changed_index_is_an_error(spark, docs, tmp_path):
    at = token_store.write_store(docs, str(tmp_path / "store"))
    index = tmp_path / "store" / "index"
    assert token_store.read_store(spark, at).count() == len(ROWS)
    whole = {p: p.read_bytes() for p in index.iterdir() if p.name.endswith(".parquet") or p.name.endswith(".crc")}
    lost = max((p for p in whole if p.suffix == ".parquet"), key=lambda p: len(whole[p]))
    lost.unlink()
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, at)
    lost.write_bytes(whole[lost])
    assert token_store.read_store(spark, at).count() == len(ROWS)
    twice = index / ("part-more-" + lost.name)
    twice.write_bytes(whole[lost])
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_store(spark, at)


def plain_terms(texts, alpha=0.75):
    """Per text the spans of words whose PMI with a value of that text reaches alpha of its information."""
    words = [[(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", t or "")] for t in texts]
    spans = [plain_spans(t or "") for t in texts]
    values = [{pii.entity(k, t[a:b]) for k, a, b in s} for t, s in zip(texts, spans, strict=True)]
    free = [[w for w in ws if all(w[2] <= a or b <= w[1] for _, a, b in s)] for ws, s in zip(words, spans, strict=True)]
    n_t, n_c = Counter(w for ws in words for w in {x[0] for x in ws}), Counter(c for own in values for c in own)
    n_ct = Counter((c, w) for own, ws in zip(values, free, strict=True) for c in own for w in {x[0] for x in ws})
    bits = lambda c: math.log2(len(texts) / n_c[c])
    told = {(c, w) for (c, w), n in n_ct.items() if bits(c) > 0 and math.log2(len(texts) * n / (n_c[c] * n_t[w])) >= alpha * bits(c) - 1e-9}
    return [{(a, b) for w, a, b in ws if any((c, w) in told for c in own)} for own, ws in zip(values, free, strict=True)]


def term_places(spans):
    return {(int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s) if k == "term"}


def test_terms_of_whole_documents(spark):
    far = "zorro " + "the thing was " * 60 + "1234567890 " * 30 + "me@home.org" + " the thing was" * 20 + " zorro"
    texts = [far if i in (2, 9) else f"the thing was here {i}" for i in range(40)]
    got = {r.doc_id: term_places(r.spans) for r in pii.personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: {(0, 5), (len(far) - 5, len(far))} if i in (2, 9) else set() for i in range(40)}
    assert [got[i] for i in range(40)] == plain_terms(texts)


@pytest.mark.parametrize("bound", [500_000, 0])
def test_terms_equal_brute_force(spark, bound):
    at = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    table = spark.read.parquet(at)
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    got = {r.doc_id: term_places(r.spans) for r in pii.personal_data(table, broadcast_terms=bound).collect()}
    assert got == dict(zip(texts, plain_terms(list(texts.values())), strict=True)) and any(got.values())


def test_packing(spark, docs, empty):
    from tarn.llm.common import keyed

    rows = keyed(docs, "row_id")
    for length, filler in ((256, 5), (256, 1 << 30), (64, 2)):
        pieces = packing.pack(rows, length=length, unit=4, filler=filler, key="row_id").collect()
        by_row, by_seq = defaultdict(list), defaultdict(list)
        for p in pieces:
            by_row[p.row_id].append(p)
            by_seq[p.sequence_id].append(p)
        texts = Counter()
        for own in by_row.values():
            own.sort(key=lambda p: p.start)
            assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own[:-1]]).tolist() and sum(p.length for p in own) == own[0].doc_tokens
            texts[own[0].doc_id, own[0].doc_tokens] += 1
        assert texts == Counter((r[0], len(ids_of("word_bpe_49k.json", r[1], 2))) for r in ROWS)
        for own in by_seq.values():
            own.sort(key=lambda p: p.offset)
            assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own[:-1]]).tolist() and sum(p.length for p in own) <= length
        made = {r.sequence_id: r.ids for r in packing.sequences(rows, spark.createDataFrame(pieces)).collect()}
        for p in pieces:
            assert zlib.crc32(np.array(made[p.sequence_id][p.offset : p.offset + p.length], "<u4").tobytes()) == p.ids_crc32
        total = sum(len(v) for v in made.values())
        assert total == sum(len(ids_of("word_bpe_49k.json", r[1], 2)) for r in ROWS)
    assert packing.pack(empty).collect() == []


def test_padding_is_small(spark):
    at = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(at):
        pytest.skip("no test tables")
    used = Counter()
    for p in packing.pack(spark.read.parquet(at)).collect():
        used[p.sequence_id] += p.length
    padding = sum(4096 - n for n in used.values() if n & (n - 1))
    assert max(used.values()) <= 4096 and padding <= 0.002 * sum(used.values())


def test_column_generation_is_optimal():
    # 9 of size 5, 9 of size 3, 9 of size 2 in bins of 10: volume bound 9
    sizes, demand = np.array([2, 3, 5]), np.array([9, 9, 9])
    _, used = packing.column_generation(sizes, demand, 10)
    assert abs(used.sum() - 9) < 1e-6
    plan = packing.whole_patterns(sizes, demand, 10)
    assert all((c * sizes).sum() <= 10 for _, c in plan) and (sum(t * c for t, c in plan) >= demand).all() and sum(t for t, _ in plan) <= 11
    assert packing.whole_patterns(sizes[:0], demand[:0], 10) == []


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(spark, docs, empty):
    chain, words = [], [f"w{i}" for i in range(80)]
    for i in range(40):  # neighbours are alike, ends are not
        chain.append((100 + i, " ".join(words)))
        words[2 * i] = f"v{i}"
    rows = [(r[0], r[1]) for r in ROWS] + chain
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_dedup.near_duplicates(made).collect()
    sets, parent = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and sum(r.first for r in got) == len(groups)
    assert sorted(r.doc_id for r in got if r.kept and not r.first) == [6]  # the id that two rows have
    assert max(len(g) for g in groups.values()) >= 20
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    assert near_dedup.near_duplicates(empty).collect() == []


def test_near_dedup_blocks(spark, monkeypatch):
    """A crowd just under the limit, with chains over it, gives the groups of brute force however it is cut into blocks."""
    rng = np.random.default_rng(3)
    shared, rows = [f"s{i}" for i in range(120)], []
    for i in range(90):
        own = [f"o{rng.integers(1 << 40)}" for _ in range(rng.integers(12, 34))]
        rows.append((i, " ".join(shared + own)))
        if i % 9 == 0:
            rows.append((1000 + i, " ".join(shared + own[:-6] + [f"p{i}"])))
    sets = [shingle_set(t) for _, t in rows]
    group = [r[0] for r in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    want = {r[0]: g for r, g in zip(rows, group, strict=True)}
    assert 10 < len(set(group)) < 90
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for sizes in ({}, {"QUERY_BLOCK": 7, "DATA_BLOCK": 5, "QUERY_WEIGHT": 2000, "DATA_WEIGHT": 900}, {"CROWD": 2}):
        for name, value in sizes.items():
            monkeypatch.setattr(near_dedup, name, value)
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(made).collect()} == want
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(made, exact=True).collect()} == want


def test_prefix_lengths_lose_no_pair():
    for n in range(1, 140):
        for m in range(n, 190):
            need = -(-75 * (n + m) // 175)
            if need > n:
                continue
            classes = [int(np.searchsorted(near_dedup._CLASSES, x, "right")) - 1 for x in (n, m)]
            for own, other in ((n, classes[1]), (m, classes[0])):
                assert dict(near_dedup.prefix_lengths(own, 75))[other] >= own - need + 1


def test_crowds_grow_with_the_texts(spark, monkeypatch):
    """Members of one bucket that are alike by a template alone: rows that enter comparison grow about linearly."""
    monkeypatch.setattr(near_dedup, "CROWD", 64)
    core, met, blocks = " ".join(f"core{i}" for i in range(64)), [], near_dedup._blocks

    def counted(*how):
        out = blocks(*how)
        met.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "_blocks", counted)
    rows, most = {}, {}
    for n in (700, 1400, 2800):
        met.clear()
        made = spark.range(n).selectExpr("id AS doc_id", f"concat('{core}', concat_ws(' ', transform(sequence(1, 40), k -> concat(' u', id, '_', k)))) AS text")
        got = near_dedup.near_duplicates(made).collect()
        assert all(r.kept and r.component_id == r.doc_id for r in got)
        rows[n] = sum(met)
        signs = [near_dedup.superminhash(near_dedup.shingles(f"{core} {' '.join(f'u{d}_{k}' for k in range(1, 41))}".encode())) for d in range(0, n, 20)]
        keys = near_dedup.band_keys(np.stack([near_dedup.mix64(s).astype("<u4") for s in signs]), near_dedup.ROWS)
        most[n] = max(np.unique(keys, return_counts=True)[1]) * 20
    assert most[700] > 64  # there is such a bucket
    assert rows[2800] <= 5 * rows[700] + 100


def test_superminhash_estimates_and_equals_one_by_one():
    rng = np.random.default_rng(1)

    def one_by_one(elements, slots):
        best = [float("inf")] * slots
        for e in elements:
            order = list(range(slots))
            for j in range(slots):
                x = int(common.mix64(np.array([e], np.uint64) + near_dedup._STEP * np.array([j + 1], np.uint64))[0])
                k = j + ((x & 0xFFFFFFFF) * (slots - j) >> 32)
                order[j], order[k] = order[k], order[j]
                best[order[j]] = min(best[order[j]], (j << 32) | (x >> 32))
        return best

    # one hash at a time, as an array: scalars warn when they wrap
    for n in (1, 3, 20, 200):
        e = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        assert near_dedup.superminhash(e, 16).tolist() == near_dedup.superminhash(e, 16, block=7).tolist() == one_by_one(e, 16)
    errors = []
    for _ in range(60):
        e = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        errors.append((near_dedup.superminhash(e[:350]) == near_dedup.superminhash(e[50:])).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 200)] + [(500, 700), (600, 700), (900, 901)]
    RNG.shuffle(links)
    for most in (1_000_000, 20):
        got = dict(near_dedup.components(spark.createDataFrame(links, "a long, b long").repartition(7), task_links=most).collect())
        assert all(got[i] == 0 for i in range(201)) and got[700] == got[600] == 500 and got[901] == 900 and len(got) == 206


def test_toxicity(spark, docs, empty):
    rng = random.Random(5)
    rows, marks = [], []
    for i in range(1200):
        insult, group = rng.random() < 0.4, rng.random() < 0.4  # only both together are toxic
        words = [rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(30)] + ["grumblish"] * insult + ["zorbians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, int(insult and group)))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(made, labels)
    scored = {r.doc_id: r._score for r in toxicity.with_scores(made, model).collect()}
    held = [(scored[i], y) for i, y in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((s >= 0.7) == bool(y) for s, y in held) / len(held) > 0.97
    odd = toxicity.with_scores(docs, model)
    assert odd.columns == [*docs.columns, "_score"] and odd.count() == len(ROWS) and odd.where("_score IS NULL OR _score < 0 OR _score > 1").isEmpty()
    assert toxicity.with_scores(empty, model).collect() == []
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r._score for r in toxicity.with_scores(docs, toxicity.fit(made, none)).collect()} in ({0.5}, {0.0})
    assert toxicity.drop_toxic(made, labels).columns == made.columns


def test_machine_equals_double_loop_and_numeric_gradient():
    rng = np.random.default_rng(2)
    machine = toxicity.FactorizationMachine(12, rank=3, seed=4)
    machine.b, machine.w = 0.3, rng.normal(0, 1, 13)
    sets = [np.array(x, np.int32) for x in ([0, 3, 5, 11], [], [2], [1, 2, 3, 4, 5, 6])]
    labels, flat, owner = np.array([1.0, 0, 1, 0]), np.concatenate(sets).astype(np.int64), np.repeat(np.arange(4), [len(s) for s in sets])

    def plain(own):
        y = machine.b + sum(machine.w[i] for i in own)
        return y + sum(machine.v[i] @ machine.v[j] for k, i in enumerate(own) for j in own[k + 1 :])

    def loss():
        return sum(math.log1p(math.exp(plain(own))) - label * plain(own) for own, label in zip(sets, labels, strict=True))

    y, sums = machine.raw(flat, owner, 4)
    assert np.allclose(y, [plain(own) for own in sets])
    assert np.allclose(machine.score(flat, owner, 4), [1 / (1 + math.exp(-plain(own))) for own in sets])
    used, gw, gv = machine.gradients(flat, owner, sums, machine.score(flat, owner, 4) - labels)
    assert used.tolist() == sorted(set(flat.tolist()))
    for k, i in enumerate(used.tolist()):
        for array, at, got in [(machine.w, i, gw[k])] + [(machine.v, (i, r), gv[k, r]) for r in range(3)]:
            before, ends = array[at], []
            for step in (1e-6, -1e-6):
                array[at] = before + step
                ends.append(loss())
            array[at] = before
            assert abs((ends[0] - ends[1]) / 2e-6 - got) < 1e-5


def test_repeated_documents_are_one_example(spark):
    rows = [(i, "signal here" if i % 2 else "noise here") for i in range(300)]
    marks = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    one = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), marks)
    many = toxicity.fit(spark.createDataFrame(rows + rows[1:2] * 400 + rows[3:4] * 7, "doc_id long, text string"), marks)
    assert one.known == many.known and np.array_equal(one.machine.w, many.machine.w)


def test_held_out_is_not_learnt(spark):
    rows = [(i, "signal" if i % 2 else "noise") for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    marks = [(i, i % 2) for i, _ in rows]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in marks]
    one, two = (toxicity.with_scores(made, toxicity.fit(made, spark.createDataFrame(m, "doc_id long, toxic int"))) for m in (marks, flipped))
    same([tuple(r) for r in one.collect()], [tuple(r) for r in two.collect()])


def test_row_key_is_stable(docs, empty):
    assert isinstance(common.keyed(docs, "row_id").schema["row_id"].dataType, T.StructType)
    first, again = ({(r.row_id, r.text) for r in common.keyed(docs, "row_id").collect()} for _ in range(2))
    assert first == again and len({k for k, _ in first}) == len(ROWS)
    assert struct.calcsize("<I") == 4 and common.keyed(empty, "row_id").count() == 0
