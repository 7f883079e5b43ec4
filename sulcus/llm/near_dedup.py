"""Near-duplicate classes with ProbMinHash signatures, banding and exact verification.

A document is a weighted set: its SHINGLE-word shingles with their counts.  Each shingle is a Poisson process whose rate
is its weight; a document keeps, for each of REGISTERS registers, the shingle that arrives there first, and a process
stops as soon as its next arrival is later than every register's first.  Two documents agree in a register with the
probability Jaccard similarity of their weights.  Documents that agree in all registers of a band are compared:

* documents with equal words are one node from the start (they meet by a 128-bit digest);
* in each band bucket, and in each pair of neighbouring buckets, members are compared with the bucket's two extreme
  members by a fixed hash order.  The order is the same everywhere, so the same few pairs turn up again and are
  compared once; the count of pairs is linear in bucket sizes;
* compared pairs of exact similarity LEAST or more are links; classes are the connected components of links, named by
  their smallest doc_id;
* a bucket is open while its members are of several classes.  Which members of open buckets can still link classes is
  said by an exact prefix filter (see `prefixes`): shingles that one class has to itself count against a member, and two
  members meet only at a shingle that is rare enough in both, and only if counts of their shingles by remainder leave room
  for enough in common.  First each shingle's most promising member meets the others, which merges most of what belongs
  together; then all pairs that the filter leaves are compared.

So two documents that share a bucket are in one class if they are similar enough, whatever the first step met.  Pairs are
never made by bucket: what the filter leaves is what may be similar by weight.  Aggregates are map-side combined and ways
back are equi-joins, which adaptive execution splits when one key is hot.  Nothing is dropped, capped or sampled.

Defined cases: a text with fewer words than a shingle is one shingle of all its words; texts without words (null, empty)
are each a class of their own; null doc_ids are classes of their own and stay; rows that repeat a doc_id are one document,
which belongs with the near copies of each of its texts; a long text is one row and is hashed in one pass, its shingles in
proportion to its length; an empty table has no classes; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import clear, hash_words, materialize, mix, normal_words, range_hash, slices, text_slices

SHINGLE = 5
LEAST = 0.8
#: Sums of hundreds of equal shares miss an exact LEAST by this much at most.
ROUNDING = 1e-9
BANDS = 20
ROWS = 5
#: Remainders by which a text's shingles are counted.
SKETCH = 128
REGISTERS = BANDS * ROWS


# ---------------------------------------------------------------------------------------------
# Kernels.


def shingles(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle hash, count) of the texts' distinct shingles, in order of document and hash."""
    n = np.diff(first)
    size = np.minimum(n, SHINGLE)
    many = np.where(n > 0, n - size + 1, 0)
    own = np.repeat(np.arange(len(n)), many)
    start = np.repeat(first[:-1], many) + np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    h = range_hash(words, start, start + size[own])
    order = np.lexsort((h, own))
    own, h = own[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(new)
    return own[at], h[at], np.diff(np.append(at, len(h)))


def prob_min_hash(own: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures [n, registers]: the shingle of the first arrival at each register.  Rounds take the k-th arrival of all live processes at once."""
    first = np.full((n, registers), np.inf)
    sign = np.zeros((n, registers), dtype=np.uint64)
    flat, signs = first.reshape(-1), sign.reshape(-1)
    t, live = np.zeros(len(h)), np.arange(len(h))
    latest = np.full(n, np.inf)
    k = 0
    while len(live):
        k += 1
        draw = mix(h[live] + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64))
        gap = -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53))
        t[live] += gap / weight[live]
        live = live[t[live] < latest[own[live]]]
        if not len(live):
            break
        draw = mix(mix(h[live] + np.uint64((k * 0x9E3779B97F4A7C15) % 2**64)) ^ np.uint64(0xA0761D6478BD642F))
        at = own[live] * registers + ((draw >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(flat, at, t[live])
        won = flat[at] == t[live]
        signs[at[won]] = h[live[won]]
        some = np.unique(own[live])
        latest[some] = first[some].max(axis=1)
    return sign


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (sorted hashes, counts): sum over common d of 1 / sum over all e of max(x_e/x_d, y_e/y_d)."""
    both, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    cx, cy = x[ia], y[ib]
    ratio, inv = np.unique(cx / cy, return_inverse=True)
    only = (x.sum() - cx.sum(), y.sum() - cy.sum())
    # With r = x_d / y_d the inner sum is (1 / x_d) * sum over e of max(x_e, r * y_e).
    total = np.array([np.maximum(cx, r * cy).sum() + only[0] + r * only[1] for r in ratio])
    return float((cx / total[inv]).sum())


# ---------------------------------------------------------------------------------------------
# Documents to signatures.

_SIGNED = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64())), ("rank", pa.int64())])


def digests(norms: list[bytes]) -> np.ndarray:
    """128-bit digests of texts as two long columns."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in norms), dtype=np.int64).reshape(-1, 2)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in text_slices(batches):
        norms = normal_words(b.column("text").to_pylist())
        ids = b.column("doc_id")
        for lo, hi in slices(norms):
            words, first = hash_words(norms[lo:hi])
            own, h, n = shingles(words, first)
            sign = prob_min_hash(own, h, n.astype(np.float64), hi - lo)
            # One 64-bit key a band; the band's number is in it, so buckets of different bands don't meet.
            bands = range_hash(sign.reshape(-1), np.arange(0, sign.size, ROWS), np.arange(ROWS, sign.size + 1, ROWS)).reshape(-1, BANDS)
            bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            keys = digests(norms[lo:hi])
            words_in = np.diff(first) > 0
            flat = pa.array(bands[words_in].view(np.int64).reshape(-1))
            sizes = np.where(words_in, BANDS, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), flat)
            rank = mix(keys[:, 0].view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)).view(np.int64)
            yield pa.record_batch([ids.slice(lo, hi - lo), pa.array(keys[:, 0]), pa.array(keys[:, 1]), lists, pa.array(rank)], _SIGNED)


def signatures(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_signed, "doc_id long, d1 long, d2 long, bands array<long>, rank long")


# ---------------------------------------------------------------------------------------------
# Candidate pairs, verification, classes.


def candidate_pairs(signs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of nodes: members of buckets with the buckets' extremes by rank."""
    size = F.size("bands")
    keys = F.concat(F.col("bands"), F.transform(F.col("bands"), lambda x, i: F.xxhash64(x, F.get(F.col("bands"), (i + 1) % size))))
    members = signs.where(size > 0).select(F.col("node").alias("b"), "rank", F.explode(keys).alias("key"))
    # Written first, so that the join has an exchange on either side and a hot bucket's members can be split.
    ends = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min_by("b", "rank").alias("low"), F.max_by("b", "rank").alias("high")).where("n > 1").drop("n")
    paths: list[str] = []
    met = members.drop("rank").join(materialize(ends, "near-dedup-buckets", paths), "key")
    pairs = met.select("b", F.explode(F.array("low", "high")).alias("a")).where("a <> b")
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-dedup-pairs")
    clear(signs.sparkSession, paths)
    return pairs


def open_members(members: DataFrame) -> DataFrame:
    """The rows (b, class, key) of buckets that hold several classes."""
    several = members.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
    return members.join(several, "key", "left_semi").select("b", "class", "key")


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        norms = [unpack.decompress(x) for x in b.column("z").to_pylist()]
        ids = b.column("node").to_numpy()
        for lo, hi in slices(norms):
            own, h, n = shingles(*hash_words(norms[lo:hi]))
            size = np.bincount(own, n, hi - lo).astype(np.int64)
            spot = own * SKETCH + (h % np.uint64(SKETCH)).astype(np.int64)
            counts = np.bincount(spot, minlength=(hi - lo) * SKETCH).reshape(-1, SKETCH).astype(np.int32)
            first = np.diff(own, prepend=-1) > 0  # the sketch stands at a text's first shingle only
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(first, SKETCH, 0))]).astype(np.int32)), pa.array(counts[own[first]].reshape(-1)))
            yield pa.record_batch([pa.array(ids[lo:hi][own]), pa.array(h.view(np.int64)), pa.array(n), pa.array(size[own]), lists], names=["b", "h", "n", "size", "sketch"])


def weights(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(b, h, n, size, sketch): each member's shingles, their counts, and the sum of its counts; once a member, how many of its shingles have each remainder of h."""
    here = texts.join(members.select(F.col("b").alias("node")).distinct().hint("merge"), "node", "left_semi")
    return here.mapInArrow(_weights, "b long, h long, n long, size long, sketch array<int>")


def prefixes(members: DataFrame, weighted: DataFrame) -> DataFrame:
    """(h, class, b, a, size, left, extra, sketch): the shingles at which a member can meet a similar member of another class.

    Let D be what members x and y of different classes have in common, and f(x) D's share of x's weight.  With weights
    scaled to a sum of 1, the inner sum of `similarity` is (1 - f(x)) / x_d + (1 - f(y)) / y_d and the largest of the two
    at least; its inverse is concave and homogeneous in (x_d, y_d), so the sum over D is at most
    1 / (1 / f(x) + 1 / f(y) - 1), and LEAST asks that f(x) and f(y) be LEAST or more (see `may_link` for both at once).

    Shingles are put in one order for all: by number of members, those that only one class has left out, as D has none of
    them.  D's first shingle in that order has before it only what x or y has alone, so a share a of LEAST's complement at
    most; a counts the shingles left out.  From there on x has `left` shingles, whose counts add up to `extra` more.
    """
    mine = members.select("b", "class").distinct()
    rows = weighted.drop("sketch").join(mine, "b")
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("of"), F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("h", "of")
    rows = rows.join(shared, "h")
    # These windows hold one document's own shingles.
    whole, upto = Window.partitionBy("b"), Window.partitionBy("b").orderBy("of", "h").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.sum("n").over(whole) - F.sum("n").over(upto) + F.col("n")
    rows = rows.withColumn("rest", rest).withColumn("left", F.count(F.lit(1)).over(whole) - F.count(F.lit(1)).over(upto) + 1)
    rows = rows.select("h", "class", "b", (1 - F.col("rest") / F.col("size")).alias("a"), "size", "left", (F.col("rest") - F.col("left")).alias("extra"))
    rows = rows.where(F.col("a") <= 1 - LEAST + ROUNDING)
    return rows.join(weighted.where(F.size("sketch") > 0).select("b", "sketch").hint("merge"), "b").select("h", "class", "b", "a", "size", "left", "extra", "sketch")


def may_link(x: str, y: str) -> Column:
    """Whether members may be similar enough whose first common shingle is this one: prefixes of the columns of both sides.

    D is at most what either has from here on, and has no more of y's weight than the shingles that x has left can carry.  Nor has
    it more shingles of a remainder than the one of x and y that has fewer of them; counts above 1 may all be in it.
    """
    def small(shares: list[Column]) -> Column:
        return 1 / shares[0] + 1 / shares[1] <= 1 + 1 / LEAST + ROUNDING

    total = lambda v: F.aggregate(v, F.lit(0), lambda a, n: a + n)
    sides = ((x, y), (y, x))
    share = [F.least(1 - F.col(f"{p}a"), (F.col(f"{q}left") + F.col(f"{p}extra")) / F.col(f"{p}size")) for p, q in sides]
    both = total(F.zip_with(f"{x}sketch", f"{y}sketch", lambda a, b: F.least(a, b)))
    again = [F.least(s, (both + F.col(f"{p}size") - total(f"{p}sketch")) / F.col(f"{p}size")) for s, (p, _) in zip(share, sides)]
    return small(share) & small(again)


def _sided(rows: DataFrame, side: str) -> DataFrame:
    return rows.select("h", *[F.col(c).alias(f"{side}{c}") for c in rows.columns if c != "h"])


def _met(x: DataFrame, y: DataFrame) -> DataFrame:
    met = _sided(x, "x_").join(_sided(y, "y_").hint("merge"), "h").where((F.col("x_class") != F.col("y_class")) & may_link("x_", "y_"))
    return met.select(F.least("x_b", "y_b").alias("a"), F.greatest("x_b", "y_b").alias("b")).distinct()


def least_pairs(rows: DataFrame) -> DataFrame:
    """Distinct pairs of each shingle's member with the least weight before it with the members of other classes: linear."""
    best = rows.groupBy("h").agg(F.min(F.struct("a", "class", "b", "size", "left", "extra", "sketch")).alias("best")).select("h", "best.*")
    return _met(best, rows)


def filtered_pairs(rows: DataFrame) -> DataFrame:
    """All distinct pairs of different classes that the filter leaves.  One of the two has no more than half of what both may have before."""
    half = 2 / (1 + 1 / LEAST)
    return _met(rows.where(F.col("a") <= 1 - half + ROUNDING), rows)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for b in text_slices(batches):
        norms = normal_words(b.column("text").to_pylist())
        keys = digests(norms)
        yield pa.record_batch([b.column("doc_id"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([squeeze.compress(x) for x in norms], pa.binary())], names=["doc_id", "d1", "d2", "z"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs with both texts, in order of a: those that are similar enough."""
    unpack = zstandard.ZstdDecompressor()

    def weighted(z: bytes) -> tuple[np.ndarray, np.ndarray]:
        words, first = hash_words([unpack.decompress(z)])
        return shingles(words, first)[1:]

    last, mine = None, None
    for b in batches:
        a, ids, za, zb = (b.column(c).to_pylist() for c in ("a", "b", "za", "zb"))
        keep = []
        for i in range(len(a)):
            if a[i] != last:
                last, mine = a[i], weighted(za[i])
            keep.append(similarity(mine, weighted(zb[i])) >= LEAST - ROUNDING)
        yield pa.record_batch([b.column("a").filter(pa.array(keep)), b.column("b").filter(pa.array(keep))], names=["a", "b"])


def packed_texts(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The words of the nodes that pairs name: node, z."""
    needed = nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    needed = needed.select(F.col("rep").alias("doc_id"), "d1", "d2", "node")
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_packed, "doc_id long, d1 long, d2 long, z binary")
    # The same plan at every size: the ids needed grow with the documents, so they are not broadcast while they are few.
    # Rows of equal doc_id and words have equal z.
    return packed.join(needed.hint("merge"), ["doc_id", "d1", "d2"]).groupBy("node").agg(F.min("z").alias("z"))


def links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of exact similarity LEAST or more.

    The same plan at every size: pairs grow with the documents, so they are not broadcast while they are few.
    """
    met = pairs.join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")).hint("merge"), "b")
    met = met.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")).hint("merge"), "a")
    return met.select("a", "b", "za", "zb").mapInArrow(_verified, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b): alternating large-star and small-star steps until nothing changes.

    Each step is a combined minimum and an equi-join with it; both are written, so a hub's edges can be split.  What a round
    has written is deleted when the next one's edges are there.
    """
    spark = edges.sparkSession
    old: list[str] = []
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components", old)
    before = None
    for _ in range(most_rounds):
        paths: list[str] = []
        # Large star: neighbours above a node are linked to the least node of its neighbourhood.
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-low", old)
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: neighbours below a node, and the node, are linked to the least of them.
        large = materialize(large, "components-large", old)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "components-least", old)
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(small, "components", paths)
        clear(spark, old)
        old = paths
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))  # each node has one edge by now
        before = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _between(found: DataFrame, members: DataFrame) -> DataFrame:
    """Links of nodes as links of their classes."""
    of = members.select("b", "class").distinct()
    found = found.join(of.select(F.col("b").alias("a"), F.col("class").alias("ca")), "a").join(of.select("b", F.col("class").alias("cb")), "b")
    return found.select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def _moved(df: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """df with its classes as they are after the merge (node, root) of classes."""
    to = merged.select(F.col("node").alias("_from"), F.col("root").alias("_to"))
    return df.join(to, F.col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def _merged(root: DataFrame, merged: DataFrame) -> DataFrame:
    """(node, root) after a merge of classes; a node without links is a class under its own name."""
    lone = merged.join(root.select("node"), "node", "left_anti")
    return _moved(root, merged, "root").unionByName(lone)


def distinct_texts(known: DataFrame, paths: list[str]) -> DataFrame:
    """(d1, d2, rep, node): each text with words, the smallest doc_id that has it, and the text's node.

    The node is rep, or for a doc_id that is the smallest of several texts a negative hash of the digest.
    """
    reps = materialize(known.where(F.size("bands") > 0).groupBy("d1", "d2").agg(F.min("doc_id").alias("rep")), "near-dedup-reps", paths)
    several = reps.groupBy("rep").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    node = F.when(F.col("texts").isNotNull(), -1 - F.shiftrightunsigned(F.xxhash64("d1", "d2"), 1)).otherwise(F.col("rep"))
    return materialize(reps.join(several, "rep", "left").select("d1", "d2", "rep", node.alias("node")), "near-dedup-nodes", paths)


def classes(docs: DataFrame) -> DataFrame:
    """One row per distinct doc_id (and per row of null doc_id): doc_id, class_id, kept."""
    paths: list[str] = []

    def put(df: DataFrame, label: str) -> DataFrame:
        return materialize(df, f"near-dedup-{label}", paths)

    signed = put(signatures(docs), "signatures")
    known = signed.where("doc_id is not null")
    nodes = distinct_texts(known, paths)
    member = put(known.select("doc_id", "d1", "d2").join(nodes, ["d1", "d2"]).select("doc_id", "node"), "members")
    # The representative's own row carries the signature.
    carried = known.join(nodes.withColumnRenamed("rep", "doc_id"), ["doc_id", "d1", "d2"])
    signs = put(carried.groupBy("node").agg(F.min("rank").alias("rank"), F.min("bands").alias("bands")), "signs")
    pairs = candidate_pairs(signs)
    # A doc_id of several texts has several nodes; that links them.
    first = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    several = member.join(first, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    texts = put(packed_texts(docs, nodes, pairs), "texts")
    root = components(links(texts, pairs).unionByName(several))
    # Whoever shares a bucket was in a pair above, so its text is at hand.
    members = signs.join(root, "node", "left").select(F.col("node").alias("b"), F.coalesce("root", "node").alias("class"), F.explode("bands").alias("key"))
    weighted = None
    for find in (least_pairs, filtered_pairs):
        members = put(open_members(members), "open")
        if members.isEmpty():
            break
        weighted = weighted or put(weights(members, texts), "weights")
        found = put(find(put(prefixes(members, weighted), "prefixes")), "pairs")
        merged = components(_between(links(texts, found), members))
        members, root = _moved(members, merged, "class"), put(_merged(root, merged), "roots")
    out = member.join(root, "node", "left").select("doc_id", F.coalesce("root", "node").alias("class")).distinct()
    name = out.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    out = out.join(name, "class").select("doc_id", "class_id")
    bare = known.where(F.size("bands") == 0).select("doc_id").distinct().join(member.select("doc_id").distinct(), "doc_id", "left_anti")
    out = out.unionByName(bare.select("doc_id", F.col("doc_id").alias("class_id"))).withColumn("kept", F.col("doc_id") == F.col("class_id"))
    alone = signed.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(True).alias("kept"))
    out = materialize(out.unionByName(alone), "near-dedup")
    clear(docs.sparkSession, paths)
    return out


def filter_documents(docs: DataFrame) -> DataFrame:
    """The rows of one doc_id of each class, and rows of null doc_id, with their own columns; rows that repeat a doc_id stay together."""
    kept = classes(docs).where("kept and doc_id is not null").select(F.col("doc_id").alias("_near_dedup_id"))
    some = docs.where(F.col("doc_id").isNull())
    return docs.join(kept, F.col("doc_id").cast("long") == F.col("_near_dedup_id"), "left_semi").select(*docs.columns).unionByName(some)
