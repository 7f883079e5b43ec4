"""Exact deduplication by skew-safe combining, comparing full content at every stage.

1. Locally: the map side of an aggregation on (digest, content, salt) leaves one winner of each content per task and salt.
2. Salted: the reduce side merges (digest, content, salt), so a hot content is spread over SALTS groups, by task.
3. Globally: salt winners, at most SALTS of a content, are merged on (digest, content).

Content is the text without white space, and is itself a grouping key, so equal digests alone never make a group.  The
way back to documents goes by SHA-256; should step 3 ever show two contents of one digest, it goes by a second digest
(SHA-512 of the reversed content) as well.

Defined cases: a null text counts as empty; a null doc_id loses to any other; rows that repeat a doc_id and text are
members of one group of which one row stays; equal lengths go to the smaller doc_id; a long text is a key of its own
length in each merge; an empty table gives an empty result; other columns, of whatever names, are not read by `assign` and
pass through `filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS, materialize

SALTS = 16


def content(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", "")


def _keyed(docs: DataFrame, p: str) -> DataFrame:
    out = docs.withColumns({f"{p}content": content(F.col("text")), f"{p}len": F.length(F.coalesce("text", F.lit(""))).cast("long")})
    return out.withColumn(f"{p}sha", F.sha2(F.col(f"{p}content"), 256))


def groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per content: its sha, winner (length, doc_id) and number of rows; `shared` where a digest has several contents."""
    k = _keyed(docs.select("doc_id", "text"), "")
    best = F.struct((-F.col("len")).alias("len"), F.col("doc_id").isNull().alias("none"), F.col("doc_id"))
    salted = (
        # One salt a task: a task's rows of a content meet in it, whatever their doc_ids, and go on as one.
        k.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("sha", "content", "salt")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("sha", "content").agg(F.min("best").alias("best"), F.sum("n").alias("group_size"))


def _winners(docs: DataFrame, salts: int) -> tuple[DataFrame, DataFrame | None]:
    """Winners by digest, written once; and those of digests of several contents, with their content, if there are any."""
    found = groups(docs, salts).select("sha", (-F.col("best.len")).alias("keep_len"), F.col("best.doc_id").alias("keep_id"), "group_size", F.sha2(F.reverse("content"), 512).alias("proof"))
    found = materialize(found, "exact-dedup")
    twice = found.groupBy("sha").count().where("count > 1").select("sha")
    return found, twice if twice.limit(1).count() else None


def _marked(docs: DataFrame, salts: int, p: str) -> DataFrame:
    """The documents with sha and their group's winner and size, under prefixed names."""
    won, twice = _winners(docs, salts)
    won = won.select(*[F.col(c).alias(f"{p}{c}") for c in won.columns])
    keyed = _keyed(docs, p)
    if twice is None:
        return keyed.drop(f"{p}content").join(won.drop(f"{p}proof"), f"{p}sha")
    keyed = keyed.withColumn(f"{p}proof", F.sha2(F.reverse(f"{p}content"), 512)).drop(f"{p}content")
    return keyed.join(won, [f"{p}sha", f"{p}proof"]).drop(f"{p}proof")


def assign(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    # Rows of one doc_id, content and length have equal results but for which of them stays, so they are counted, also where their key is hot.
    m = _marked(docs.select("doc_id", "text"), salts, "").groupBy("doc_id", "sha", "len", "keep_id", "keep_len", "group_size").agg(F.count(F.lit(1)).alias("copies"))
    m = m.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len")) & (F.col("nth") == 1)
    return m.select("doc_id", "keep_id", "group_size", first.alias("kept"), F.col("sha").alias("text_sha256"))


def filter_documents(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents that stay, with their own columns."""
    p = "_exact_dedup_"
    m = _marked(docs, salts, p).where(F.col("doc_id").eqNullSafe(F.col(f"{p}keep_id")) & (F.col(f"{p}len") == F.col(f"{p}keep_len")))
    return m.dropDuplicates([f"{p}sha", f"{p}len"]).select(*docs.columns)
