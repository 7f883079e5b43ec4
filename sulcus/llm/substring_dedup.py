"""Substring deduplication with difference-cover anchors.

A window is WINDOW consecutive words of one document.  Modulo PERIOD, every difference of two positions is a difference
of two members of COVER; so any two equal windows contain, at one same offset below PERIOD, two equal anchors of
WINDOW - PERIOD + 1 words that both begin at cover positions.  The steps:

1. anchors: hash the anchors at cover positions only; meet by hash; tell each document which of its anchors recur.
2. extension: a window whose span holds a recurring anchor is a candidate; hash candidates (96 bits); meet by hash.
3. removal: drop the words that recurring windows cover, on the input as it was.

Whole documents with equal words meet in step 1 by one digest: all their words go, and only one of them is extended.
Equal hashes of a batch are combined before each shuffle, so a passage that a third of all documents hold sends two
occurrences per batch to its hash's bucket; the others are known to recur and are dealt evenly.  Occurrences travel packed
by bucket, in compressed columns.  Nothing is sampled.

Defined cases: null and empty texts have no words and keep none; texts shorter than a window lose nothing; rows that
repeat a doc_id and text recur like any copies; of equal documents the smallest doc_id is extended; null doc_ids are told
apart by their text; a long text is hashed whole, alone in its slice; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, hash_words, mix, normal_words, range_hash, slices, text_slices

WINDOW = 35
PERIOD = 21
#: A perfect difference cover modulo PERIOD.
COVER = (0, 1, 6, 8, 18)
ANCHOR = WINDOW - PERIOD + 1

#: Values of `at` in answers that speak of a whole document: it has copies and stands for them; it has copies and another stands for them.
LEADER, COPY = -1, -2

MEET = "bucket int, packed binary"
ANSWER = "doc_id long, ck int, at int, z binary"


def _key_of(norm: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(norm)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:12], "little", signed=True)


_ANSWER = pa.schema([("doc_id", pa.int64()), ("ck", pa.int32()), ("at", pa.int32()), ("z", pa.binary())])


#: Columns of an occurrence as it travels: key, second key, doc_id, whether there is one, text key, place.
_FIELDS = (("key", "<u8"), ("key2", "<u4"), ("doc_id", "<i8"), ("known", "u1"), ("ck", "<i4"), ("at", "<i4"))
_WIDTH = sum(np.dtype(t).itemsize for _, t in _FIELDS)


def _planes(rows: np.ndarray, squeeze: zstandard.ZstdCompressor) -> bytes:
    """Rows of bytes, transposed and compressed: equal high bytes of a column then lie together."""
    return squeeze.compress(np.ascontiguousarray(rows.T).tobytes())


def _columns(raw: bytes, n: int) -> dict[str, np.ndarray]:
    rows = np.frombuffer(raw, dtype=np.uint8).reshape(_WIDTH, n)
    out, at = {}, 0
    for name, kind in _FIELDS:
        size = np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(rows[at : at + size].T).view(kind).reshape(n)
        at += size
    return out


def combine(cols: dict[str, np.ndarray], bits: int) -> pa.RecordBatch:
    """One batch's occurrences by bucket (the key's first bits), packed.

    Of each key two occurrences at most go to its bucket to meet those of other batches; further ones recur for certain, so
    they are dealt evenly by place and are marked by a bucket's own count of them.
    """
    key, key2, n = cols["key"], cols["key2"], len(cols["key"])
    order = np.lexsort((key2, key))
    same = np.zeros(n, dtype=bool)
    same[1:] = (key[order][1:] == key[order][:-1]) & (key2[order][1:] == key2[order][:-1])
    sure = same.copy()
    sure[1:] &= same[:-1]
    meet, rest = order[~sure], order[sure]
    place = mix(rest.astype(np.uint64) + np.uint64(n))
    rest, place = rest[np.argsort(place)], np.sort(place)
    rows = np.empty((n, _WIDTH), dtype=np.uint8)
    at = 0
    for name, kind in _FIELDS:
        size = np.dtype(kind).itemsize
        rows[:, at : at + size] = np.ascontiguousarray(cols[name], dtype=kind).view(np.uint8).reshape(n, size)
        at += size
    of_meet, of_rest = (x >> np.uint64(64 - bits) for x in (key[meet], place))
    buckets = np.union1d(of_meet, of_rest)
    cuts = [np.searchsorted(x, buckets, side) for x in (of_meet, of_rest) for side in ("left", "right")]
    squeeze, packed = zstandard.ZstdCompressor(level=1), []
    for a, b, c, d in zip(*cuts):
        packed.append(struct.pack("<II", b - a, d - c) + _planes(rows[np.concatenate([meet[a:b], rest[c:d]])], squeeze))
    return pa.record_batch([pa.array(buckets.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "packed"])


def _owners(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)


def _anchor_rows(bits: int):
    cover = np.zeros(PERIOD, dtype=bool)
    cover[list(COVER)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            norms = normal_words(b.column("text").to_pylist())
            if not norms:
                continue
            keys = np.array([_key_of(x) for x in norms], dtype=np.int64).reshape(-1, 2)
            hs, owners, ats = [], [], []
            for lo, hi in slices(norms):
                words, first = hash_words(norms[lo:hi])
                n = np.diff(first)
                own = np.repeat(np.arange(lo, hi), n)
                pos = np.arange(len(words)) - np.repeat(first[:-1], n)
                size = np.repeat(n, n)
                start = np.flatnonzero(cover[pos % PERIOD] & (pos + ANCHOR <= size) & (size >= WINDOW))
                hs.append(range_hash(words, start, start + ANCHOR))
                owners.append(own[start])
                ats.append(pos[start])
                long = np.flatnonzero(n >= WINDOW)  # whole documents meet by digest
                hs.append(keys[lo + long, 0].view(np.uint64))
                owners.append(lo + long)
                ats.append(np.full(len(long), LEADER))
            owner, at = np.concatenate(owners), np.concatenate(ats)
            ids, known = _owners(b.column("doc_id"))
            # Digests and anchors don't meet each other, for their second keys differ.
            cols = {"key": np.concatenate(hs), "key2": (at == LEADER), "doc_id": ids[owner], "known": known[owner], "ck": keys[owner, 1], "at": at}
            if len(at):
                yield combine(cols, bits)

    return run


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket, the occurrences whose key is another's too.  One bucket is in memory at a time."""
    unpack = zstandard.ZstdDecompressor()

    def told(parts: list[bytes]) -> pa.RecordBatch:
        found, sure = [], []
        for x in parts:
            m, r = struct.unpack("<II", x[:8])
            found.append(_columns(unpack.decompress(x[8:]), m + r))
            sure.append(np.arange(m + r) >= m)
        c = {name: np.concatenate([f[name] for f in found]) for name, _ in _FIELDS}
        sure = np.concatenate(sure)
        # The smallest doc_id leads, in whatever order the rows came, so a task that runs again names the same leader.
        order = np.lexsort((c["doc_id"], c["known"], c["key2"], c["key"], sure))
        c, sure = {k: v[order] for k, v in c.items()}, sure[order]
        same = np.zeros(len(order), dtype=bool)  # as the row before
        same[1:] = (c["key"][1:] == c["key"][:-1]) & (c["key2"][1:] == c["key2"][:-1]) & ~sure[1:]
        more = same.copy()
        more[:-1] |= same[1:]
        at = np.where((c["at"] == LEADER) & (same | sure), COPY, c["at"])
        keep = more | sure
        return pa.record_batch([pa.array(c["doc_id"][keep], mask=c["known"][keep] == 0), pa.array(c["ck"][keep]), pa.array(at[keep].astype(np.int32)), pa.nulls(int(keep.sum()), pa.binary())], _ANSWER)

    bucket, parts = None, []
    for b in batches:
        for k, x in zip(b.column("bucket").to_pylist(), b.column("packed").to_pylist()):
            if k != bucket and parts:
                yield told(parts)
                parts = []
            bucket = k
            parts.append(x)
    if parts:
        yield told(parts)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for b in text_slices(batches):
        norms = normal_words(b.column("text").to_pylist())
        ck = np.array([_key_of(x)[1] for x in norms], dtype=np.int32)
        yield pa.record_batch([b.column("doc_id"), pa.array(ck), pa.nulls(len(norms), pa.int32()).fill_null(2**31 - 1), pa.array([squeeze.compress(x) for x in norms], pa.binary())], _ANSWER)


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, int, np.ndarray, bytes]]:
    """(doc_id, ck, places told, packed words) of each document; its answers come before its row, which sorts last.

    Answers to documents without a row here (copies' representatives, once they are done) are passed over.
    """
    who, places = None, []
    for b in batches:
        z, at, cks = b.column("z"), b.column("at").to_numpy(), b.column("ck").to_numpy()
        ids, some = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)

        def told(begin: int, end: int, me: int, ids=ids, some=some, cks=cks, at=at) -> None:
            """Adds the answers among begin..end that are for row me."""
            nonlocal who, places
            mine = (ids[begin:end] == ids[me]) & (some[begin:end] == some[me]) & (cks[begin:end] == cks[me])
            name = (int(ids[me]) if some[me] else None, int(cks[me]))
            if who != name:
                who, places = name, []
            places.append(at[begin:end][mine])

        begin = 0
        for end in map(int, np.flatnonzero(z.is_valid().to_numpy(zero_copy_only=False))):
            told(begin, end, end)
            yield who[0], who[1], np.concatenate(places), z[end].as_py()  # a row that repeats it gets the same answers
            begin = end + 1
        if begin < len(at):
            told(begin, len(at), len(at) - 1)


def candidates(places: np.ndarray, n: int) -> np.ndarray:
    """Starts of the windows whose span holds a recurring anchor at an offset below PERIOD."""
    a = np.unique(places[places >= 0])
    edge = np.zeros(n + 2, dtype=np.int64)
    np.add.at(edge, np.maximum(a - (PERIOD - 1), 0), 1)
    np.add.at(edge, a + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[: max(0, n - WINDOW + 1)] > 0)


STEP2 = "kind int, doc_id long, ck int, n_words long, n_removed long, kept_sha256 string, z binary, bucket int"
_STEP2 = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("ck", pa.int32()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("z", pa.binary()), ("bucket", pa.int32())])
DONE, PENDING, WINDOWS = 0, 1, 2
_EMPTY = hashlib.sha256(b"").hexdigest()


def _extend(bits: int):
    """Of each document: the result if nothing can recur or all does; else its words; and its candidate windows, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        rows: list[tuple] = []
        todo: list[tuple[object, int, np.ndarray, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, todo, size
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip([*zip(*rows), [None] * len(rows)], _STEP2)], _STEP2)
            h1, h2, owners, ats = [], [], [], []
            norms = [x[3] for x in todo]
            for lo, hi in slices(norms):
                words, first = hash_words(norms[lo:hi])
                own = [candidates(todo[i][2], int(first[i - lo + 1] - first[i - lo])) for i in range(lo, hi)]
                start = np.concatenate([x + first[i] for i, x in enumerate(own)])
                h1.append(range_hash(words, start, start + WINDOW))
                h2.append(range_hash(words, start, start + WINDOW, 2))
                owners += [np.full(len(x), lo + i) for i, x in enumerate(own)]
                ats += own
            if sum(map(len, ats)):
                owner = np.concatenate(owners)
                ids, known = _owners(pa.array([x[0] for x in todo], pa.int64()))
                cks = np.array([x[1] for x in todo], dtype=np.int32)
                met = combine({"key": np.concatenate(h1), "key2": np.concatenate(h2) >> np.uint64(32), "doc_id": ids[owner], "known": known[owner], "ck": cks[owner], "at": np.concatenate(ats)}, bits)
                n = met.num_rows
                named = {"kind": pa.array(np.full(n, WINDOWS, dtype=np.int32)), "z": met.column("packed"), "bucket": met.column("bucket")}
                yield pa.record_batch([named.get(f.name, pa.nulls(n, f.type)) for f in _STEP2], _STEP2)
            rows, todo, size = [], [], 0

        for doc_id, ck, places, z in _per_document(batches):
            norm = unpack.decompress(z)
            n = norm.count(b" ") + 1 if norm else 0
            copy, leads = bool((places == COPY).any()), bool((places == LEADER).any())
            if copy or leads:  # all its windows start in a copy too
                rows.append((DONE, doc_id, ck, n, n, _EMPTY, None))
            elif not (places >= 0).any():
                rows.append((DONE, doc_id, ck, n, 0, hashlib.sha256(norm).hexdigest(), None))
            else:
                rows.append((PENDING, doc_id, ck, n, None, None, z))
            if (leads or not copy) and (places >= 0).any():  # rows that repeat a doc_id and text hear both
                todo.append((doc_id, ck, places, norm))
                size += len(norm)
            if size > 4 * SLICE_BYTES or len(rows) >= 8192:
                yield from flush()
        yield from flush()

    return run


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def kept_words(norm: bytes, starts: np.ndarray) -> tuple[int, int, bytes]:
    """Number of words, number removed, and the kept words joined by a space, when windows at these starts go."""
    words = norm.split()
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, len(words)), -1)
    keep = np.cumsum(edge)[:-1] == 0
    return len(words), len(words) - int(keep.sum()), b" ".join([words[i] for i in np.flatnonzero(keep)])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack, rows = zstandard.ZstdDecompressor(), []
    for doc_id, _, places, z in _per_document(batches):
        n, gone, kept = kept_words(unpack.decompress(z), np.unique(places[places >= 0]))
        rows.append((doc_id, n, gone, hashlib.sha256(kept).hexdigest()))
        if len(rows) >= 4096:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], _RESULT)
            rows = []
    if rows:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _RESULT)], _RESULT)


def _bits(spark) -> int:
    """Buckets are this power of two: 4 or more to a shuffle partition, so that one in memory is a part of a task's input."""
    return max(6, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def _meet(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, ANSWER)


def _gather(rows: DataFrame) -> DataFrame:
    return rows.repartition("doc_id", "ck").sortWithinPartitions("doc_id", "ck", "at")


def removals(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    bits = _bits(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    answers = _meet(texts.mapInArrow(_anchor_rows(bits), MEET))
    # The three uses of step2 read one exchange: extending is cheaper to repeat than its windows are to write.
    step2 = _gather(answers.unionByName(texts.mapInArrow(_pack, ANSWER))).mapInArrow(_extend(bits), STEP2)
    windows = step2.where(F.col("kind") == WINDOWS).select("bucket", F.col("z").alias("packed"))
    pending = step2.where(F.col("kind") == PENDING).select("doc_id", "ck", F.lit(2**31 - 1).alias("at"), "z")
    removed = _gather(_meet(windows).unionByName(pending)).mapInArrow(_remove, RESULT)
    return step2.where(F.col("kind") == DONE).select("doc_id", "n_words", "n_removed", "kept_sha256").unionByName(removed)
