"""Near duplicates: SuperMinHash signatures, banding, verification on full sets, union-find groups.

1. Each document's word sequence is hashed; equal sequences are one node from here on.
2. SuperMinHash with ``SLOTS`` slots, cut into ``SLOTS / ROWS`` bands: a pair at Jaccard 0.75 shares a band
   with probability 1 - 2e-5.
3. In each band bucket all members are compared with its smallest node (an edge a member, never all pairs).
   Edges are first screened by signature (agreement under ``SCREEN`` is over four standard deviations below
   0.75), then confirmed on the full shingle sets.  Confirmed links are merged.
4. A bucket that still spans several groups is resolved in full, so no link is lost to the choice of centres.
   Up to ``CROWD`` members outside its largest group are compared with all members of other groups.  Where there
   are more, members meet only under a second key they share: a shingle among the rarest of both, as many as
   two sets of their sizes need to have enough in common (prefix filter, by the document frequency of shingles
   in the crowd).  Texts that are alike by a common template alone share none, so the rows grow with the texts
   and not with the square of the bucket.  Both kinds are cut into blocks of bounded size.  A first pass over
   signatures finds the members that have a screened pair (a pair counts in the first band it shares only); a
   second one takes the full shingle sets of those and confirms inside the block, so only links leave a task,
   never the pairs that were looked at.

``exact=True`` sends all nodes through the prefix filter and skips the signature screen: that finds every link
by construction, at the price of all shingles in a shuffle.

Rows that move are small (a signature is 448 bytes); texts are read again only for nodes with screened pairs and
crowds.  Skewed buckets: counts are pre-aggregated, joins are split by AQE, blocks bound what a task holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FORGET, WordIds, as_bytes, give_back, mix64, pieces, remove, rows_of, saved, scratch, small_batches, space_words, without

SLOTS, ROWS, SCREEN = 112, 4, 0.58
#: Members in a block of signatures; shingles in a block of sets, where a member counts ROW_WEIGHT more.
QUERY_BLOCK, DATA_BLOCK = 4096, 1024
#: Members outside a bucket's largest group, in one block of queries at most: then its rows stay under six a member.
CROWD = QUERY_BLOCK
QUERY_WEIGHT, DATA_WEIGHT, ROW_WEIGHT = 1_000_000, 500_000, 64
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xD1B54A32D192ED03)
_WORDS = WordIds()
FORGET["words"] = [_WORDS.clear]
#: Sizes at which a class of set sizes starts, five per cent apart.
_CLASSES = np.array([1], np.int64)
while _CLASSES[-1] < 1 << 40:
    _CLASSES = np.append(_CLASSES, max(_CLASSES[-1] + 1, int(_CLASSES[-1] * 1.05)))


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words (the whole sequence if it is shorter)."""
    words = space_words(text)
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    ids, width, h = _WORDS.ids(words), min(width, n), None
    for k in range(width):
        part = ids[k : n - width + 1 + k]
        h = part if h is None else h * _BASE + part
    return np.unique(mix64(h + np.uint64(width)))


def superminhash(elements: np.ndarray, slots: int = SLOTS, block: int = 8192) -> np.ndarray:
    """The signature of a set of 64-bit hashes: per slot the least of step + fraction, as step << 32 | fraction.

    At step j an element visits the j-th slot of its own random permutation with the value j + a fraction.
    Steps run for ``block`` elements together and end as soon as no slot holds a value of the next step or
    more, which gives the signature that going through the elements one by one with early stopping gives.
    """
    best = np.full(slots, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(elements), block):
        _lower(best, elements[i : i + block])
    return best


def _lower(best: np.ndarray, elements: np.ndarray) -> None:
    """Lower the slots of ``best`` to what the elements give."""
    slots, low, full = len(best), np.uint64(0xFFFFFFFF), np.uint64(32)
    order = rows = None
    steps = _STEP * np.arange(1, slots + 1, dtype=np.uint64)
    for j in range(slots):
        x = mix64(elements + steps[j])
        k = j + (((x & low) * np.uint64(slots - j)) >> full).astype(np.int64)
        if j == 0:
            at = k
        else:
            if order is None:  # the permutations so far: step 0 swapped slot 0 and the slot it chose
                rows = np.arange(len(elements))
                order = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
                order[rows, first] = 0
                order[:, 0] = first
            at = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
            order[:, j] = at
        first = at if j == 0 else first
        np.minimum.at(best, at, (np.uint64(j) << full) | (x >> full))
        if int(best.max()) >> 32 <= j:
            break


def _profile(width: int, slots: int):
    def run(batches):
        from xxhash import xxh3_128_digest

        for batch in pieces(batches, owner="words"):
            sizes, keys, signs = [], [], []
            for text in as_bytes(batch.column("text")):
                words = space_words(text)
                found = shingles(text, width)
                sizes.append(len(found))
                keys.append(xxh3_128_digest(b" ".join(words)))
                signs.append(mix64(superminhash(found, slots)).astype("<u4").tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("f"), batch.column("i"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], ["doc_id", "f", "i", "n", "seq", "sign"])

    return run


def band_keys(signs: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key per signature and band of ``rows`` slots; keys of different bands differ."""
    per = signs.shape[1] // rows
    h = np.broadcast_to(np.arange(per, dtype=np.uint64) + np.uint64(1), (len(signs), per)).copy()
    for r in range(rows):
        h = mix64(h * _BASE + signs[:, r : per * rows : rows].astype(np.uint64))
    return h


def _bands(rows: int):
    def run(batches):
        for batch in batches:
            nodes = batch.column("node").to_numpy()
            if not len(nodes):
                continue
            h = band_keys(np.frombuffer(b"".join(batch.column("sign").to_pylist()), "<u4").reshape(len(nodes), -1), rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(np.repeat(nodes, h.shape[1]))], ["band", "node"])
        give_back()

    return run


def _agree(screen: float):
    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1)) for c in ("sign_a", "sign_b"))
            keep = (a == b).mean(axis=1) >= screen if batch.num_rows else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep)), batch.column("b").filter(pa.array(keep))], ["a", "b"])

    return run


def _sets(width: int):
    def run(batches):
        for batch in pieces(batches, owner="words"):
            found = [shingles(x, width).astype("<u8").tobytes() for x in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])

    return run


def _tokens(batches):
    """A row per shingle of each set."""
    for batch in pieces(batches, 64, "words"):
        sets = batch.column("shingles").to_pylist()
        sizes = [len(x) // 8 for x in sets]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), sizes)), pa.array(np.frombuffer(b"".join(sets), "<i8"))], ["node", "token"])


def prefix_lengths(n: int, percent: int) -> list[tuple[int, int]]:
    """(class, length): how many of its rarest shingles a set of size n must show to sets of each size class.

    Two sets of sizes n and m with 100 * both >= percent * union have at least a = ceil(percent * (n + m) /
    (100 + percent)) in common, so the first n - a + 1 and m - a + 1 in any order share one.
    """
    least, most = -(-percent * n // 100), 100 * n // percent
    out = []
    for c in range(int(np.searchsorted(_CLASSES, least, "right")) - 1, int(np.searchsorted(_CLASSES, most, "right"))):
        m = max(int(_CLASSES[c]), least)
        out.append((c, n + percent * (n + m) // -(100 + percent) + 1))
    return out


def _prefixes(percent: int):
    """Sets' shared shingles, rarest first -> a key for each shingle that a set shows to a class."""

    def run(batches):
        for batch in pieces(batches, 64, "words"):
            nodes, keys = [], [np.empty(0, np.uint64)]
            for node, n, shared in zip(batch.column("node").to_pylist(), batch.column("n").to_pylist(), batch.column("shared").to_pylist(), strict=True):
                tokens = np.array(shared, np.int64).view(np.uint64)
                own, alone = int(np.searchsorted(_CLASSES, n, "right")) - 1, n - len(shared)  # shingles of one set alone come first
                for c, length in prefix_lengths(n, percent):
                    some = tokens[: max(0, length - alone)]
                    pair = np.uint64(min(own, c) << 20 | max(own, c))
                    keys.append(mix64(some * _BASE + mix64(np.full(1, pair))[0]))
                    nodes.append(np.full(len(some), node, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate([np.empty(0, np.int64), *nodes]))], ["band", "node"])
        give_back()

    return run


def prefix_keys(sets: DataFrame, percent: int, path: str, broadcast_tokens: int = 500_000) -> DataFrame:
    """(band, node): two nodes whose sets are linked share a band here.  sets: node, n, shingles."""
    tokens = sets.select("node", "shingles").mapInArrow(_tokens, "node bigint, token bigint")
    common = saved(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), f"{path}/common-shingles")
    held = tokens.join(F.broadcast(common) if common.count() <= broadcast_tokens else common, "token")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("df", "token"))), lambda x: x["token"])
    shared = held.groupBy("node").agg(listed.alias("shared")).join(sets.select("node", "n"), "node")
    return shared.select("node", "n", "shared").mapInArrow(_prefixes(percent), "band bigint, node bigint")


def _confirm(width: int, percent: int):
    def run(batches):
        last, own = None, None
        for batch in pieces(batches, owner="words"):
            keep = []
            for a, text_a, text_b in zip(batch.column("a").to_pylist(), as_bytes(batch.column("text_a")), as_bytes(batch.column("text_b")), strict=True):
                if a != last:
                    last, own = a, shingles(text_a, width)
                other = shingles(text_b, width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(own) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(keep, pa.bool_())), batch.column("b").filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return run


def _forest(batches):
    """Union-find over the links of one task: (node, root), fewer rows than links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > 2_000_000:  # what a task holds is bounded
            yield _pairs([(x, find(x)) for x in parent])
            parent.clear()
    yield _pairs([(x, find(x)) for x in parent])


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    a = np.array([r for r in rows if r[0] != r[1]], np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], ["a", "b"])


def components(links: DataFrame, name: str = "components", task_links: int = 1_000_000) -> DataFrame:
    """(node, component) of the linked nodes; the component is its smallest node.

    Union-find inside each task, over at most about ``task_links`` links.  If one task holds them all that is
    the answer; else rounds of large-star and small-star joins until nothing changes, each written to the
    shared folder.
    """
    spark, path = links.sparkSession, scratch(links.sparkSession, name)
    tasks = -(-links.count() // task_links)
    forest = links.coalesce(max(1, tasks)).mapInArrow(_forest, "a bigint, b bigint")
    edges = saved(forest.distinct() if tasks > 1 else forest, f"{path}/0")
    if tasks <= 1:
        return saved(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct()), f"{path}/done")
    before = None
    for step in range(1, 200):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = large.where("a <> b").groupBy("a").agg(F.min("b").alias("m"))
        star = large.where("a <> b").join(small, "a").select(F.col("b").alias("x"), "m", "a")
        star = star.select("a", F.col("m").alias("b")).union(star.where("x <> m").select("x", "m")).distinct()
        edges = saved(star, f"{path}/{step}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return saved(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(heads), f"{path}/done")


def _suspects(screen: float, slots: int, rows: int):
    """Members of one block of queries and one of members that have a screened pair across groups there.

    A pair counts in the first band it shares, so it is looked at once however many buckets it meets in.
    """

    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False)
        node, group = table.column("node").to_numpy(), table.column("component").to_numpy()
        signs = np.frombuffer(b"".join(table.column("sign").to_pylist()), "<u4").reshape(len(node), slots)
        keys, band = band_keys(signs, rows), table.column("band").to_numpy()[0]
        found, data = np.zeros(len(node), bool), np.flatnonzero(~query)
        places = np.flatnonzero(keys[0].view(np.int64) == band)
        place = int(places[0]) if len(places) else 0  # a prefix key is no band: nothing comes before it
        for q in np.flatnonzero(query):
            other = data[group[data] != group[q]]
            near = other[(signs[other] == signs[q]).sum(axis=1) >= screen * slots]
            near = near[~(keys[near, :place] == keys[q, :place]).any(axis=1)]
            found[near] = True
            found[q] = len(near) > 0
        node = np.unique(node[found])
        del signs, keys
        give_back()
        return pa.table({"band": np.full(len(node), band, np.int64), "node": node})

    return run


def _resolve(percent: int):
    """Links across groups of one block of queries and one of members, by their full shingle sets.

    Shingles are ranked, rarest in the block first; two sets with enough in common share one of the first
    n - ceil(n * percent / 100) + 1.  Sets that do are intersected in full, unless links found before have
    joined their groups: at most one link a merge leaves the task.
    """

    def run(table: pa.Table) -> pa.Table:
        query = table.column("query").to_numpy(zero_copy_only=False)
        node = table.column("node").to_numpy()
        group = np.unique(table.column("component").to_numpy(), return_inverse=True)[1]
        sets = table.column("shingles").to_pylist()
        size = np.array([len(x) // 8 for x in sets], np.int64)
        owner, start = np.repeat(np.arange(len(node)), size), np.cumsum(size) - size
        _, ids, counts = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
        ids = rank[ids]
        ids = ids[np.lexsort((ids, owner))]
        first = size + (-percent * size // 100) + 1
        held = (np.arange(len(ids)) - start[owner] < first[owner]) & ~query[owner]
        order = np.argsort(ids[held], kind="stable")
        holders, at = owner[held][order], np.searchsorted(ids[held][order], np.arange(len(counts) + 1))
        mark, links = np.zeros(len(counts), bool), []
        for q in np.flatnonzero(query):
            own = ids[start[q] : start[q] + size[q]]
            left = np.unique(np.concatenate([holders[at[i] : at[i + 1]] for i in own[: first[q]]]))
            left = left[100 * np.minimum(size[left], size[q]) >= percent * np.maximum(size[left], size[q])]
            mark[own], take = True, 8
            while len(left := left[group[left] != group[q]]):
                some, left, take = left[:take], left[take:], 512
                ends = np.cumsum(size[some])
                both = np.add.reduceat(mark[ids[np.arange(ends[-1]) + np.repeat(start[some] - ends + size[some], size[some])]], ends - size[some], dtype=np.int64)
                for x in some[100 * both >= percent * (size[q] + size[some] - both)]:
                    if group[x] != group[q]:
                        links.append((min(node[q], node[x]), max(node[q], node[x])))
                        group[group == group[x]] = group[q]
            mark[own] = False
        del sets, owner, ids, counts, rank, held, order, holders, at, mark
        give_back()
        a = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": a[:, 0], "b": a[:, 1]})

    return run


def _blocks(rows: DataFrame, weight: Column, q_most: int, d_most: int) -> DataFrame:
    """Blocks (band, qb, db) of queries and members of the buckets in ``rows`` that span several groups.

    Queries are the members outside the largest group; each meets every member in exactly one block.
    """
    counts = rows.groupBy("band", "component").agg(F.sum(weight).alias("w"))
    mixed = counts.groupBy("band").agg(F.max(F.struct("w", "component")).alias("top"), F.sum("w").alias("total"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    mixed = mixed.select("band", F.col("top.component").alias("main"), F.ceil((F.col("total") - F.col("top.w")) / q_most).cast("int").alias("qs"), F.ceil(F.col("total") / d_most).cast("int").alias("ds"))
    rows = rows.join(mixed, "band")
    mine = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    data = rows.select("band", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), mine(F.col("ds")).alias("db"), F.lit(False).alias("query"), "node", "component")
    queries = rows.where("component <> main").select("band", mine(F.col("qs")).alias("qb"), F.explode(F.sequence(F.lit(0), F.col("ds") - 1)).alias("db"), F.lit(True).alias("query"), "node", "component")
    return queries.union(data)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, slots: int = SLOTS, rows: int = ROWS, screen: float = SCREEN, broadcast_nodes: int = 200_000, key: str | None = None, exact: bool = False) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept (and row_id, first, n_copies).

    Words are runs without ASCII white space, A-Z lower-cased; a set holds distinct shingles of ``width``
    words, or the whole sequence if it is shorter.  Documents with 100 * intersection >= percent * union are
    linked; component_id is the smallest doc_id reachable (null ids come last).  Null, empty or blank text has
    an empty set and links with nothing.  ``kept`` is doc_id = component_id (two nulls are equal), so rows that
    repeat the kept id are kept with it; ``first`` marks exactly one row of each group, and every row without
    words.  ``n_copies`` is the number of documents with that word sequence.  Texts of any length are whole.  An
    empty table gives an empty result.  ``key`` names a column of docs made by ``common.keyed``; else one is
    made.  Other columns are ignored whatever their names.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "near")
    docs = rows_of(docs, key, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = dict(docs.dtypes)["doc_id"]
    with small_batches(spark):
        labelled, profile = _labelled(docs, path, kind, width, percent, slots, rows, screen, broadcast_nodes, exact)
    out = profile.drop("sign").join(labelled, "seq", "left")
    alone = F.col("head").isNull()
    first = alone | (F.col("head.f").eqNullSafe(F.col("f")) & F.col("head.i").eqNullSafe(F.col("i")))
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return out.select("doc_id", F.struct("f", "i").alias("row_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), first.alias("first"), F.coalesce("n_copies", F.lit(1)).alias("n_copies"))


def _labelled(docs: DataFrame, path: str, kind: str, width: int, percent: int, slots: int, rows: int, screen: float, broadcast_nodes: int, exact: bool) -> tuple[DataFrame, DataFrame]:
    """((seq, head, n_copies) of all word sequences, the documents' profiles), both written under path."""
    spark = docs.sparkSession
    profile = saved(docs.mapInArrow(_profile(width, slots), f"doc_id {kind}, f bigint, i bigint, n bigint, seq binary, sign binary"), f"{path}/profile")

    # A node per different word sequence.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "f", "i")
    nodes = profile.where("n > 0").groupBy("seq").agg(F.min(place).alias("first"), F.first("n").alias("n"), F.first("sign").alias("sign"), F.count(F.lit(1)).alias("n_copies"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), f"{path}/nodes")
    signs = nodes.select("node", "sign")

    bands = signs.mapInArrow(_bands(rows), "band bigint, node bigint")
    shared = bands.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi")
    members = saved(bands.join(shared.select("band", "lo", "m"), "band"), f"{path}/members")
    edges = members.select(F.col("lo").alias("a"), F.col("node").alias("b")).where("a < b").distinct()

    def texts_of(needed: DataFrame, name: str) -> DataFrame:
        places = saved(nodes.join(needed, "node").select("node", "first.f", "first.i"), f"{path}/{name}-places")
        few = places.count() <= broadcast_nodes
        return docs.join(F.broadcast(places) if few else places, ["f", "i"]).select("node", "text")

    def sets_of(needed: DataFrame, name: str) -> DataFrame:
        return saved(texts_of(needed, name).mapInArrow(_sets(width), "node bigint, shingles binary"), f"{path}/{name}-sets")

    screened = edges.join(signs.select(F.col("node").alias("a"), F.col("sign").alias("sign_a")), "a").join(signs.select(F.col("node").alias("b"), F.col("sign").alias("sign_b")), "b")
    pairs = saved(screened.select("a", "b", "sign_a", "sign_b").mapInArrow(_agree(screen), "a bigint, b bigint"), f"{path}/star-pairs")
    texts = saved(texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "star"), f"{path}/star-texts")
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    links = saved(both.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(width, percent), "a bigint, b bigint"), f"{path}/star-links")
    remove(spark, f"{path}/star-texts", f"{path}/star-pairs")
    groups = components(links)

    def grouped(rows: DataFrame) -> DataFrame:
        return rows.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))

    # What is still apart, in full: the members that may have links by signature, then their sets.
    within = grouped(members.select("band", "node"))
    sizes = grouped(members.where(F.col("m") > CROWD).select("band", "node")).groupBy("band", "component").count()
    large = sizes.groupBy("band").agg((F.sum("count") - F.max("count")).alias("outside")).where(F.col("outside") > CROWD)
    large = saved(large.select("band"), f"{path}/crowds")
    if exact:
        suspects = prefix_keys(sets_of(nodes.select("node"), "all").join(nodes.select("node", "n"), "node"), percent, path)
    else:
        candidates = within
        if not large.isEmpty():
            crowd = sets_of(members.join(large, "band").select("node").distinct(), "crowd").join(nodes.select("node", "n"), "node")
            met = saved(prefix_keys(crowd, percent, path), f"{path}/prefix-keys")
            candidates = within.join(large, "band", "left_anti").unionByName(grouped(met))
        blocks = _blocks(candidates, F.lit(1), QUERY_BLOCK, DATA_BLOCK).join(signs, "node")
        suspects = blocks.groupBy("band", "qb", "db").applyInArrow(_suspects(screen, slots, rows), "band bigint, node bigint").distinct()
    suspects = saved(suspects, f"{path}/suspects")
    sets = sets_of(suspects.select("node").distinct(), "rest")
    weighed = grouped(suspects).join(nodes.select("node", "n"), "node")
    blocks = _blocks(weighed, F.col("n") + ROW_WEIGHT, QUERY_WEIGHT, DATA_WEIGHT).join(sets, "node")
    new = saved(blocks.groupBy("band", "qb", "db").applyInArrow(_resolve(percent), "a bigint, b bigint").distinct(), f"{path}/rest-links")
    if not new.isEmpty():
        groups = components(links.union(new), "components-all")

    labelled = nodes.select("node", "seq", "first", "n_copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = labelled.groupBy("component").agg(F.min("first").alias("head"))
    labelled = saved(labelled.join(heads, "component").select("seq", "head", "n_copies"), f"{path}/labelled")
    remove(spark, *(f"{path}/{x}" for x in ("nodes", "members", "star-places", "star-links", "crowds", "all-places", "all-sets", "crowd-places", "crowd-sets", "common-shingles", "prefix-keys", "suspects", "rest-places", "rest-sets", "rest-links")))
    return labelled, profile


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each group of ``near_duplicates`` stays: the first row of the smallest id.  Columns as in docs."""
    def gone(small, key):
        return near_duplicates(small, key=key, **how).where(~F.col("first")).select("row_id.*")

    return without(docs, gone, doc_id=id_col, text=text_col)


def op10(spark, sf_dir: str) -> DataFrame:
    """``near_duplicates`` of the whole table ``documents``, by its rules."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id", "first")
