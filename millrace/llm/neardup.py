"""Near-duplicate groups: minima of many universal hashes, banding, signature verification, full sets, connected components.

A document's set is its distinct shingles. Documents with equal sets form one class, which from then on is one node; so
thousands of exact copies cost as much as one. Each node has HASHES minima in BANDS bands of ROWS. Nodes that share a band's
bucket are candidates; with 4 rows and 32 bands two nodes of similarity 0.8 share no bucket once in 20 million pairs.

A bucket is never expanded into all its pairs. It is settled in rounds: a few of its nodes become hubs and are compared with the
bucket's nodes of other components, and are then done with. Nodes found linked fall into one component, so in a group of near
copies most nodes are never compared with each other. A bucket is settled when its nodes that are not done lie in one
component: then each pair in it was compared, is connected, or can't be linked. Each round takes 16 times as many hubs, least connected nodes first, and
pairs that failed are not tried again. So no link between different texts is lost, and no cap is needed.

Candidates are screened inside the join that finds them: by set sizes (exact), by the minima that agree (5 standard deviations below
the threshold), and, after the first round, by what both share with a hub that both were compared with, and the most they can
share beside (exact). So a group of many near copies, some too far apart, makes few pairs. Pairs are confirmed on
full sets, made again from the texts of the few nodes that need them. Links go into components by alternating large-star and
small-star steps. Nothing but counts reaches the driver.

Defined cases: null texts and texts without words have empty sets, are linked with nothing and stay; a text of fewer words
than a shingle is one shingle; rows with equal sets are one group, be their doc_ids equal or null; a component's id is
its smallest doc_id that is not null; an empty table gives no rows; other columns are ignored, and kept by deduplicate().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bounded_batches, forget, keep, scan
from millrace.llm.components import components

WORDS = 5
PERCENT = 80
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
SEED = 11
#: Hubs of a bucket in the first round; buckets of one node more are settled by it.
HUBS = 3
#: Most rows of 8 bytes that are broadcast to pick out texts; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 2_000_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
_C = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles, A-Z in lower case."""
    import xxhash

    w = text.translate(_LOWER).split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, w)), np.uint64)
    n = min(words, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = (s ^ h[k : len(h) - n + 1 + k]) * _C[k % 64]
        s ^= s >> np.uint64(32)
    return np.unique(_mix(s))


def minima(s: np.ndarray) -> np.ndarray:
    """HASHES minima of multiply-shift hashes, a universal family."""
    out = np.full(HASHES, np.uint64(2**64 - 1))
    for i in range(0, len(s), 4096):
        np.minimum(out, (s[i : i + 4096, None] * _A + _B).min(0), out=out)
    return out >> np.uint64(32)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """row, doc_id, n, key (of the set; null if empty), bands (bucket numbers), sketch (four bits of each minimum)."""

    def one(batch: pa.RecordBatch) -> dict:
        import xxhash

        out = {"row": batch["row"], "doc_id": batch["doc_id"], "n": [], "key": [], "bands": [], "sketch": []}
        for text in batch["text"].to_pylist():
            s = shingles(text, words)
            out["n"].append(len(s))
            if not len(s):
                for c in ("key", "bands", "sketch"):
                    out[c].append(None)
                continue
            m = minima(s)
            b = np.arange(BANDS, dtype=np.uint64)
            for column in m.reshape(BANDS, ROWS).T:
                b = _mix((b + column) * _C[0])
            out["key"].append(xxhash.xxh3_128_digest(s.tobytes()))
            out["bands"].append(b.view(np.int64))
            half = (m & np.uint64(15)).reshape(-1, 16)
            out["sketch"].append((half << np.arange(0, 64, 4, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64))
        return out

    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return scan(docs.select("row", "doc_id", F.col("text").cast("binary").alias("text")), one, f"row bigint, doc_id {kind}, n bigint, key binary, bands array<bigint>, sketch array<bigint>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, s: the full set of each node, made again from one of its texts. nodes: (node, row, key)."""
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_ROWS else nodes
    own = docs.select("row", F.col("text").cast("binary").alias("text")).join(nodes, "row").select("node", "key", "text")

    def one(batch: pa.RecordBatch) -> dict:
        import xxhash

        sets = [shingles(t, words) for t in batch["text"].to_pylist()]
        ok = [xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, batch["key"].to_pylist(), strict=True)]
        return {"node": batch["node"].filter(pa.array(ok, pa.bool_())), "s": [s.view(np.int64) for s, good in zip(sets, ok, strict=True) if good]}

    # A row that is repeated in the table gives its set as often; one is enough.
    return scan(own, one, "node bigint, s array<bigint>").groupBy("node").agg(F.first("s").alias("s"))


def _may_link(percent: int):
    """Condition on two members (n, s0 ... of a; hub_n, hub_s0 ... of the hub) that no linked pair fails: sizes (exact), and minima that agree.

    An equal minimum agrees in its four bits; 5 standard deviations are left below the threshold.
    """
    t = percent / 100
    least = int(np.floor((t - 5 * np.sqrt(t * (1 - t) / HASHES)) * HASHES))
    ones = F.lit(0x1111111111111111)
    apart = F.lit(0)
    for k in range(HASHES // 16):
        d = F.col(f"s{k}").bitwiseXOR(F.col(f"hub_s{k}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        apart = apart + F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(ones))
    return (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")) & (HASHES - apart >= least)


def _not_apart(percent: int):
    """Condition on two members that were both compared with one hub: no linked pair fails it.

    What two nodes share lies in the hub's set, where bits tell exactly, or outside, where only shingles count that some other node
    compared with that hub has too (loose: how many).
    """
    inside = F.aggregate(F.zip_with("bits", "hub_bits", lambda a, b: F.bit_count(a.bitwiseAND(b))), F.lit(0), lambda n, x: n + x)
    most = inside + F.least("loose", "hub_loose")
    known = (F.col("ref") == F.col("hub_ref")) & F.col("loose").isNotNull() & F.col("hub_loose").isNotNull()
    return F.when(known, (100 + percent) * most >= percent * (F.col("n") + F.col("hub_n"))).otherwise(True)


def groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """row, doc_id, n (set size), component (smallest doc_id reachable), first_row (of the component: the one with that doc_id).

    docs: as numbered() gives them.
    """
    rows = keep(signatures(docs, words), "signatures")
    nodes = rows.where("key is not null").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), *(F.first(c).alias(c) for c in ("n", "bands", "sketch")))
    nodes = keep(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    info = nodes.select("node", "n", "sketch", "key", F.col("first.row").alias("row"))

    bucket = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("bucket")
    members = bucket.join(shared, "bucket")
    # Nodes of many buckets first: they lie in the middle of their group and link most of it at once.
    busy = members.groupBy("node").agg((-F.count(F.lit(1))).alias("weight"))
    own = busy.join(info, "node").select("node", "weight", "n", *(F.get("sketch", F.lit(k)).alias(f"s{k}") for k in range(HASHES // 16)))
    null = F.lit(None).cast("bigint")
    members = keep(members.join(own, "node").withColumns({"component": F.col("node"), "ref": null, "bits": F.lit(None).cast("array<bigint>"), "loose": null}), "members")
    links = failed = labels = None
    hubs = HUBS
    while not members.isEmpty():
        members = keep(_ranked(members, hubs), "ranked")
        pairs = _candidates(members, percent)
        if failed is not None:
            pairs = pairs.join(failed, ["u", "v"], "left_anti")
        close = keep(pairs, "close")
        wanted = close.select(F.col("u").alias("node")).unionByName(close.select(F.col("v").alias("node"))).distinct()
        sets = keep(_sets(docs, keep(wanted.join(info.select("node", "row", "key"), "node"), "wanted"), words), "sets")
        both = close.join(sets.withColumnsRenamed({"node": "u", "s": "us"}), "u").join(sets.withColumnsRenamed({"node": "v", "s": "vs"}), "v")
        same = F.size(F.array_intersect("us", "vs"))
        tried = keep(both.select("u", "v", same.alias("i"), (F.size("us") + F.size("vs") - same).alias("all")).select("u", "v", (100 * F.col("i") >= percent * F.col("all")).alias("linked")), "tried")
        new, wrong = tried.where("linked").select("u", "v"), tried.where("not linked").select("u", "v")
        links, failed = (new, wrong) if links is None else (links.unionByName(new), failed.unionByName(wrong))
        if labels is None or not new.isEmpty():
            labels = keep(components(links), "labels")
        left = _unsettled(members, labels)
        before, members = members, keep(_seen_from_hubs(left, tried, sets) if hubs == HUBS else left, "members")
        for x in (before, close, sets):
            forget(x)
        hubs *= 16
    return _result(rows, nodes, labels)


def _ranked(members: DataFrame, hubs: int) -> DataFrame:
    """members with hub (true for the bucket's first few by weight). The rank filter works before the shuffle too, so no bucket is gathered."""
    order = Window.partitionBy("bucket").orderBy("weight", F.xxhash64("node"), "node")
    first = members.select("bucket", "node", "weight").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hubs).select("bucket", "node", "rank")
    return members.join(first, ["bucket", "node"], "left")


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (u < v) of a hub and a node of its bucket that isn't in its component and may be linked with it."""
    hub = members.where("rank is not null").drop("rank", "weight")
    hub = hub.select("bucket", *(F.col(c).alias(f"hub_{c}") for c in hub.columns if c != "bucket"))
    apart = (F.col("node") != F.col("hub_node")) & (F.col("component") != F.col("hub_component"))
    pairs = members.join(hub, "bucket").where(apart & _may_link(percent) & _not_apart(percent))
    return pairs.select(F.least("hub_node", "node").alias("u"), F.greatest("hub_node", "node").alias("v")).distinct()


def _unsettled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes that were no hubs, in buckets where such nodes lie in two components or more, with their component and its number of nodes; ref is the bucket's first hub."""
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("weight"))
    named = labels.join(sizes, "component").select("node", F.col("component").alias("new"), F.col("weight").alias("many"))
    first = members.where("rank = 1").select("bucket", F.col("node").alias("first"))
    left = members.where("rank is null").drop("rank").join(named, "node", "left")
    left = left.withColumns({"component": F.coalesce("new", "node"), "weight": F.coalesce("many", F.lit(1).cast("long"))}).drop("new", "many")
    several = left.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("bucket")
    return left.join(several.join(first, "bucket"), "bucket").withColumn("ref", F.coalesce("ref", "first")).drop("first")


def _seen_from_hubs(members: DataFrame, tried: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds, for nodes that were compared with ref: bits (which of ref's shingles the node has) and loose (how many of its others some other node compared with ref has)."""
    refs = members.select("ref").distinct()
    ends = lambda a, b: tried.select(F.col(a).alias("ref"), F.col(b).alias("node"))
    compared = ends("u", "v").unionByName(ends("v", "u")).join(refs, "ref", "left_semi")
    both = compared.join(sets.withColumnsRenamed({"node": "ref", "s": "rs"}), "ref").join(sets, "node").select("ref", "node", "rs", "s")

    def one(batch: pa.RecordBatch) -> dict:
        bits, others = [], []
        for rs, s in zip(batch["rs"], batch["s"], strict=True):
            r, x = (np.asarray(v.values) for v in (rs, s))
            packed = np.packbits(np.isin(r, x))
            bits.append(np.pad(packed, (0, -len(packed) % 8)).view(np.int64))
            others.append(x[~np.isin(x, r)])
        return {"ref": batch["ref"], "node": batch["node"], "bits": bits, "others": others}

    compared = keep(scan(both, one, "ref bigint, node bigint, bits array<bigint>, others array<bigint>"), "compared")
    single = compared.select("ref", "node", F.explode("others").alias("shingle")).groupBy("ref", "shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    own = single.groupBy("ref", "node").agg(F.count(F.lit(1)).alias("own"))
    known = compared.join(own, ["ref", "node"], "left").select("ref", "node", F.col("bits").alias("new_bits"), (F.size("others") - F.coalesce("own", F.lit(0))).cast("long").alias("new_loose"))
    return members.join(known, ["ref", "node"], "left").withColumns({"bits": F.col("new_bits"), "loose": F.col("new_loose")}).select(*members.columns)


def _result(rows: DataFrame, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    own = nodes.select("key", "node", "first")
    if labels is not None:
        # Only nodes with a link are in labels; the others are components by themselves.
        named = own.join(labels, "node")
        least = named.groupBy("component").agg(F.min("first").alias("least"))
        linked = named.join(least, "component").select("node", "least")
        own = own.join(linked, "node", "left").select("key", F.coalesce("least", "first").alias("first"))
    base = rows.select("row", "doc_id", "n", "key")
    alone = base.where("key is null").select("row", "doc_id", "n", F.col("doc_id").alias("component"), F.col("row").alias("first_row"))
    return base.where("key is not null").join(own.select("key", "first"), "key").select("row", "doc_id", "n", F.col("first.doc_id").alias("component"), F.col("first.row").alias("first_row")).unionByName(alone)


def numbered(docs: DataFrame) -> DataFrame:
    """docs with a column row that follows from the row's doc_id and text alone: any later read, in whatever partitions, gives it alike."""
    return docs.withColumn("row", F.xxhash64("doc_id", "text"))


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with one row of each near-duplicate group: that of the smallest doc_id. Rows that repeat both doc_id and text are one document."""
    plain = numbered(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), "doc_id", "text"))
    found = groups(plain.select("row", "doc_id", "text"), words, percent)
    other = F.col("row") != F.col("first_row")
    marks = found.groupBy("row", "doc_id").agg(F.bool_or(other).alias("gone"), F.count(F.lit(1)).alias("times")).where("gone or times > 1")
    marks = keep(marks.select("row", F.col("doc_id").alias("id"), "gone"), "marks")
    small = marks.count() <= BROADCAST_ROWS
    out = plain.join(F.broadcast(marks) if small else marks, (plain["row"] == marks["row"]) & plain["doc_id"].eqNullSafe(marks["id"]), "left").drop(marks["row"]).where("gone is null or not gone")
    once = out.where("gone is null").select("whole")
    if not marks.where("not gone").isEmpty():
        once = once.unionByName(out.where("not gone").dropDuplicates(["row", "doc_id"]).select("whole"))
    return once.select("whole.*")
