"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Texts are words of ASCII letters (lower-cased), digits and all characters beyond ASCII.  A window is WINDOW consecutive
words of a benchmark item, or all words of a shorter item; it contaminates a document that contains it word by word.

1. A window is the set of its shingles, SHINGLE consecutive words each, or all words of a shorter window.  How often each of
   them occurs in all documents is counted, and a window's shingles are ordered by rarity.  A document holds the window
   only if it holds every shingle of it, so a window with a shingle that no document has is done, and for the others the
   prefix that must meet is one token: the rarest shingle, the window's anchor.
2. Documents' shingles meet the anchors by an equi-join on hashes.  The anchor's place in the window says where the window
   would start (positional bound) and where it would end (length bound); what lies within the document is compared word by
   word with the window.
3. What occurs is combined by document: the words under windows by merging overlapping spans, and the items by sets.
   Windows of the same items stand for one set of items, and documents that met the same sets share one list, so a passage
   that many items or documents have in common is listed once.

The corpus is never shuffled: it is read once for the counts and once for the meeting, block by block against the
benchmark's shingles.  A block is dealt by hash and has about BLOCK rows, which bounds what is broadcast; a larger benchmark
has more blocks, each with its own pass.  What is shuffled are counts of the benchmark's shingles, what occurs, and one
small row per document.

Defined cases: null and empty texts have no words; a null doc_id is a document like others; rows that repeat a doc_id and a
text each get their row; long texts are one row whose shingles are taken one at a time; an empty table of documents gives an
empty result, and an empty benchmark hits nothing; items without words have no window; rows that repeat an item_id are one
item with the windows of all its texts; windows of a null item_id hit words, but that item is neither counted nor listed;
columns other than doc_id, text and item_id are not read by `contamination` and pass through `filter_documents`.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear, materialize

WINDOW = 10
SHINGLE = 5
#: Benchmark rows (about 60 bytes for a shingle, 250 for an anchor with its window) that are broadcast at once.
BLOCK = 200_000
#: Everything in ASCII but digits and letters parts words.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same after lower-casing, as characters.
EDGES = "".join(map(chr, [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_words(df: DataFrame) -> DataFrame:
    """Adds the text's words; null has none."""
    t = F.coalesce("text", F.lit(""))
    # lower() also changes letters beyond ASCII, which must stay.
    lower = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, UPPER.lower()))
    bare = df.withColumn("_bare", F.btrim(lower, F.lit(EDGES)))
    return bare.withColumn("words", F.when(F.length("_bare") == 0, F.array().cast("array<string>")).otherwise(F.split("_bare", APART))).drop("_bare")


def shingle(of: Column, at: Column, size: int) -> Column:
    """Hash of the words of[at : at + size]; those outside are left out, so it is never null."""
    return F.xxhash64(F.lit(size), *[F.get(of, at + k) for k in range(size)])


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (item_id, window): each item's windows as arrays of words."""
    w = with_words(benchmark.select("item_id", "text")).where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    w = w.select("item_id", "words", "length", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at"))
    return w.select("item_id", F.slice("words", F.col("at") + 1, F.col("length")).alias("window")).distinct()


def window_shingles(found: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(window, place, size, h) of distinct windows."""
    w = found.select("window").distinct().withColumn("size", F.least(F.size("window"), F.lit(size)))
    w = w.select("window", "size", F.explode(F.sequence(F.lit(0), F.size("window") - F.col("size"))).alias("place"))
    h = F.coalesce(*[F.when(F.col("size") == k, shingle(F.col("window"), F.col("place"), k)) for k in range(1, size + 1)])
    return w.select("window", "place", "size", h.alias("h"))


def _places(texts: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(keep, words, at, h): every text's shingles of those sizes, and one at -1 of each text."""
    d = texts.select(*keep, "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    made = [shingle(F.col("words"), F.col("at"), k) for k in sizes]
    every = F.when(F.col("at") == -1, F.array(made[0])).otherwise(F.array(*made))
    return d.withColumn("h", made[0] if len(made) == 1 else F.explode(every))


def _blocks(table: DataFrame, block: int) -> list[DataFrame]:
    """The table's rows dealt by hash into parts of about `block` rows; none of an empty table."""
    parts = -(-table.count() // block)
    return [table.where(F.pmod(F.xxhash64(*table.columns), F.lit(parts)) == k) for k in range(parts)]


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def occurrences(texts: DataFrame, known: DataFrame, sizes: list[int], block: int = BLOCK) -> DataFrame:
    """(h, n): how often each known shingle (h, distinct) occurs in all texts."""
    places = _places(texts, sizes).select("h")
    return _all([places.join(F.broadcast(b), "h", "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n")) for b in _blocks(known, block)])


def anchors(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """(window, place, h): the rarest shingle of each window all of whose shingles occur."""
    n = F.col("n")
    w = shingles.join(counts, "h", "left").groupBy("window").agg(F.bool_and(n.isNotNull()).alias("all"), F.min(F.struct("n", "h", "place")).alias("rare"))
    return w.where("all").select("window", "rare.place", "rare.h")


def _met(texts: DataFrame, anchored: DataFrame, sizes: list[int], *keep: str) -> DataFrame:
    """(keep, words, at, span, items): each occurrence of a window, and a row of null span at -1 of each text."""
    start = F.col("at") - F.col("place")
    length = F.size("window")
    inside = (start >= 0) & (start + length <= F.size("words"))
    same = F.slice("words", F.greatest(start, F.lit(0)) + 1, length) == F.col("window")
    met = _places(texts, sizes, *keep).join(F.broadcast(anchored.withColumnRenamed("h", "_h")), (F.col("h") == F.col("_h")) & inside & same, "left")
    span = F.when(F.col("window").isNotNull(), F.struct(start.alias("start"), (start + length).alias("stop")))
    return met.where(F.col("window").isNotNull() | (F.col("at") == -1)).select(*keep, "words", "at", span.alias("span"), "items")


def item_sets(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(window, items) and (items, item_id): windows of equal items have one name of their set of items.

    A set's name adds up hashes over its items, so no list is gathered; its items are those of one window that has it.
    """
    listed = found.where("item_id is not null").select("window", F.col("item_id").cast("string").alias("item_id")).distinct()
    marks = [F.bit_xor(F.xxhash64(F.lit(1), "item_id")), F.bit_xor(F.xxhash64(F.lit(2), "item_id")), F.count(F.lit(1))]
    named = listed.groupBy("window").agg(F.concat_ws(".", *[m.cast("string") for m in marks]).alias("items"))
    return named, named.groupBy("items").agg(F.min("window").alias("window")).join(listed, "window").select("items", "item_id")


def _texts(docs: DataFrame, benchmark: DataFrame, window: int, size: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest, n, copies, spans, sets), one row per distinct doc_id and text, and (items, item_id); both are written."""
    paths: list[str] = []
    size = min(size, window)
    found = materialize(windows(benchmark, window), "decontamination-windows", paths)
    shingles = materialize(window_shingles(found, size), "decontamination-shingles", paths)
    sizes = sorted(r["size"] for r in shingles.select("size").distinct().collect())  # 1 to `size`
    named, items = item_sets(found)
    keep = ("doc_id", "digest")
    texts = with_words(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), "text"))
    parts = []
    if sizes:
        known = materialize(shingles.select("h").distinct(), "decontamination-known", paths)
        counts = materialize(occurrences(with_words(docs.select("text")), known, sizes, block), "decontamination-counts", paths)
        anchored = materialize(anchors(shingles, counts).join(named, "window", "left"), "decontamination-anchors", paths)
        parts = [_met(texts, b, sizes, *keep) for b in _blocks(anchored, block)]
    none = [F.lit(-1).alias("at"), F.lit(None).cast("struct<start:int,stop:int>").alias("span"), F.lit(None).cast("string").alias("items")]
    parts = [p if k == 0 else p.where("at >= 0") for k, p in enumerate(parts)] or [texts.select(*keep, "words", *none)]
    own = F.col("at") == -1
    rows = _all([p.select(*keep, F.when(own, F.size("words")).alias("n"), own.cast("long").alias("copy"), "span", "items") for p in parts])
    # What is gathered of a text is bounded by its own length; the digest tells texts of one doc_id apart.
    out = rows.groupBy(*keep).agg(F.max("n").alias("n"), F.sum("copy").alias("copies"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("items")).alias("sets"))
    out = materialize(out, "decontamination")
    items = materialize(items, "decontamination-items")
    clear(docs.sparkSession, paths)
    return out, items


def _lists(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(signature, n_items, items_sha256) of each combination of sets that a text met."""
    met = texts.where(F.size("sets") > 0).groupBy("signature").agg(F.min("sets").alias("sets")).select("signature", F.explode("sets").alias("items"))
    ids = met.join(items, "items").groupBy("signature").agg(F.array_sort(F.collect_set("item_id")).alias("ids"))
    return ids.select("signature", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans [start, stop), in words, of what occurs."""
    texts, items = _texts(docs, benchmark, window, size, block)
    texts = texts.withColumn("signature", F.when(F.size("sets") > 0, F.sha2(F.array_join("sets", ","), 256)))
    # Spans in order of start: each adds the words beyond the furthest stop so far.
    add = lambda a, s: F.struct((a["hit"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["upto"]))).alias("hit"), F.greatest(a["upto"], s["stop"]).alias("upto"))
    hit = F.aggregate("spans", F.struct(F.lit(0).alias("hit"), F.lit(0).alias("upto")), add, lambda a: a["hit"].cast("long"))
    counted = texts.withColumn("n_hit", hit)
    # Texts that met no set have no signature; in the join they would all meet in one task.
    listed = counted.where("signature IS NOT NULL").join(_lists(texts, items), "signature", "left")
    bare = counted.where("signature IS NULL").withColumns({"n_items": F.lit(0).cast("long"), "items_sha256": F.lit(None).cast("string")})
    out = listed.unionByName(bare).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_words"), "n_hit", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans",
    )


def filter_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, size: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The documents without any occurrence, with their own columns."""
    texts, _ = _texts(docs, benchmark, window, size, block)
    hit = texts.where(F.size("spans") > 0).select(F.col("doc_id").alias("_hit_id"), F.col("digest").alias("_hit_digest"))
    digest = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("_hit_id")) & (digest == F.col("_hit_digest")), "left_anti")
