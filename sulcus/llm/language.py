"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of other characters than letters become one space, one space stands at either end, and every 1-
to MOST_GRAM-gram of the result is hashed into BUCKETS.  Fitting sums n-gram counts by language and bucket over about
PER_LANGUAGE labelled documents of each language (those of the smallest hashes) in one aggregation, and takes as prior each
language's share of labelled documents.  The matrix of log-probabilities (languages x BUCKETS) is broadcast; more than
MAX_LANGUAGES languages are an error, so its size has a bound.  A batch is scored as a sparse matrix of counts, document by
bucket, times the log-probabilities.

Defined cases: null texts and texts without a letter are `und` with score 0; null languages are not learned from; without any
training document everything is `und`; equal scores go to the first language in code point order; repeated rows teach once
and are each predicted; a long text is read in slices that give the n-grams of the whole; an empty table gives an empty
result; columns other than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, text_slices

MOST_GRAM = 3
BUCKETS = 1 << 14
#: Training documents of a language, about; languages at most; entries of a product at a time.
PER_LANGUAGE, MAX_LANGUAGES, MOST_CELLS = 1_500, 256, 1 << 21
ALPHA = 0.5
UNKNOWN = "und"
SLICE_CHARS = 1 << 18

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def _hashes(x: np.ndarray, carried: int) -> np.ndarray:
    """Buckets of the n-grams of x that end after its first `carried` characters."""
    out, h = [], np.zeros(len(x), dtype=np.uint64)
    for n in range(1, MOST_GRAM + 1):
        if len(x) < n:
            break
        h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :]
        out.append((mix(h[max(0, carried - n + 1) :] + np.uint64(n << 56)) >> np.uint64(64 - 14)).astype(np.int64))
    return np.concatenate(out)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams, in slices; nothing if it has no letter."""
    text = text.lower()
    some, spaced = False, True
    last = np.empty(0, dtype=np.uint64)  # the end of what was read, and whether it ends with a space
    fresh = np.array([32], dtype=np.uint64)
    for at in range(0, len(text), SLICE_CHARS):
        c = np.frombuffer(text[at : at + SLICE_CHARS].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        ok = _is_letter()[c]
        keep = ok.copy()
        keep[0] |= not spaced
        keep[1:] |= ok[:-1]
        if not keep.any():
            continue
        x = np.concatenate([last, fresh, np.where(ok, c, 32)[keep].astype(np.uint64)])
        some, spaced = some or bool(ok.any()), not ok[-1]
        if some:
            yield _hashes(x, len(last))
            last, fresh = x[len(x) - MOST_GRAM + 1 :], fresh[:0]
    if some and not spaced:
        yield _hashes(np.append(last, np.uint64(32)), len(last))


def counts(text: str | None) -> np.ndarray | None:
    """N-grams of a text by bucket, None if it has no letter."""
    total = None
    for g in grams(text or ""):
        some = np.bincount(g, minlength=BUCKETS)
        total = some if total is None else total + some
    return total


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sums: dict[str, np.ndarray] = {}
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
            if (x := counts(text)) is not None:
                sums[lang] = sums[lang] + x if lang in sums else x
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(total[at])], names=["lang", "bucket", "n"])


def is_held_out(doc_id=None):
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


class Model(NamedTuple):
    langs: list[str]
    prior: np.ndarray  # [languages], logarithms
    table: np.ndarray  # [BUCKETS, languages], logarithms


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """From documents that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # How many documents each language has decides which share of the hashes it takes; one row per language comes to the driver.
    sizes = known.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0)))
    n = {r["lang"]: max(1, r["n"]) for r in sizes}
    spark = docs.sparkSession
    shares = spark.createDataFrame([(x, min(1.0, per_language / n[x])) for x in langs], "lang string, share double")
    place = F.pmod(F.col("h"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    seen = known.join(F.broadcast(shares), "lang").where(place < F.col("share")).dropDuplicates(["lang", "h"]).select("text", "lang")
    # At most languages x BUCKETS rows.
    rows = seen.mapInArrow(_counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    table = np.full((BUCKETS, len(langs)), ALPHA)
    at = {x: i for i, x in enumerate(langs)}
    for r in rows:
        table[r["bucket"], at[r["lang"]]] += r["n"]
    prior = np.log(np.array([n[x] for x in langs], dtype=np.float64) / sum(n.values()))
    return Model(langs, prior, np.log(table / table.sum(axis=0, keepdims=True)))


def sparse_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counts of texts, document by bucket, as compressed rows: (first, bucket, count); a text without letters has an empty row."""
    first, bucket, count = [0], [], []
    for t in texts:
        if (x := counts(t)) is not None:
            at = np.flatnonzero(x)
            bucket.append(at)
            count.append(x[at])
            first.append(first[-1] + len(at))
        else:
            first.append(first[-1])
    return np.array(first), np.concatenate([np.empty(0, dtype=np.int64), *bucket]), np.concatenate([np.empty(0, dtype=np.int64), *count])


def score_batch(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text: sparse counts times the matrix, MOST_CELLS products at a time."""
    first, bucket, count = sparse_counts(texts)
    langs = len(model.langs)
    totals = np.zeros((len(texts), langs))
    full = np.flatnonzero(np.diff(first)) if langs else np.empty(0, dtype=np.int64)
    at = 0
    while at < len(full):
        upto = max(at + 1, int(np.searchsorted(first[full + 1], first[full[at]] + MOST_CELLS // langs, side="right")))
        some = full[at:upto]
        lo, hi = first[some[0]], first[some[-1] + 1]
        totals[some] = np.add.reduceat(model.table[bucket[lo:hi]] * count[lo:hi, None], first[some] - lo, axis=0) + model.prior
        at = upto
    if not len(full):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    best = totals.argmax(axis=1)
    score = 1.0 / np.exp(np.clip(totals - totals.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
    none = np.diff(first) == 0
    return [UNKNOWN if no else model.langs[k] for no, k in zip(none, best)], np.where(none, 0.0, score)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in text_slices(batches, SLICE_CHARS * 4):
            langs, score = score_batch(b.column("text").to_pylist(), m)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text")
    return some.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
