"""Token ids in binary files of independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds documents in ascending doc_id, one frame each: its ids as little-endian unsigned 32-bit integers.  Then come
a skippable frame with the documents' doc_ids (an index) and one with the seek table of the zstandard seekable format:
for each frame its compressed size, its size, and the low 32 bits of the XXH64 of its content, then the number of
frames, a descriptor byte and the magic number.  Any zstandard reader can read the ids; a reader of one document reads
the tail, then only that document's bytes.

Encoding looks up each distinct space-separated word in a bounded table of the worker: the tokenizer drops white space before
it splits, so no token spans it.  New words are split and merged together in numpy, by the tokenizer's own rules and merges.

Order: documents are range-partitioned by doc_id (ties by text hash), and file k holds the k-th range.  Files are written
under a name of the attempt and renamed, so a lost executor's repetition leaves one whole file.

Defined cases: null and empty texts hold the end id alone; null doc_ids come first; rows that repeat a doc_id follow one
another; a long text is one frame, encoded whole; an empty table gives files without frames and an empty result; columns
other than doc_id and text, of whatever names, are not read.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LongTable, new_path, spread, text_slices, word_codes

#: Fixed values of the zstandard seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEK_MAGIC, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
#: Words in a worker's table, ids that they may have, and characters of a word that is kept.
MOST_WORDS, MOST_IDS, LONGEST_WORD = 1_000_000, 4_000_000, 48
END_ID = 2
LEVEL = 3
#: Bytes of text and documents of a file, about; there are as many files as that takes, and as shuffle partitions at least.
FILE_BYTES, FILE_DOCS = 256 << 20, 1 << 20


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Words for which splitting and lower-casing here is certain to be the tokenizer's: printable ASCII but apostrophes, and Latin-1 letters.
_PLAIN = r"\A[!-&(-~À-ÖØ-öø-ÿ]+\z"
#: Classes of the bytes of plain lower-case words: letters, digits (each a pre-token of its own), the rest.
_CLASS = np.full(256, 2, dtype=np.int8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58] = 1


def byte_names() -> list[str]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


class Merges:
    """Byte pair merges of many pre-tokens at once: in each round every pre-token makes its first merge of the lowest rank."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
            raise ValueError("merges of this kind are not made here")
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        names = byte_names()
        self.inside, self.last = (np.array([vocab[c + x] for c in names], dtype=np.int64) for x in ("", end))
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.ranks = LongTable(left << 32 | right, np.arange(len(pairs)))

    def _ranks(self, sym: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place; a number above all ranks where there is none."""
        none = len(self.made)
        nxt = np.minimum(at + 1, len(sym) - 1)
        r = self.ranks.get(sym[at] << 32 | sym[nxt])
        return np.where((r >= 0) & (own[nxt] == own[at]) & (at + 1 < len(sym)), r, none)

    def encode(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each and the end) of the pre-tokens data[first[k]:first[k + 1]], none of them empty."""
        n, none = len(first) - 1, len(self.made)
        sym = self.inside[data]
        sym[first[1:] - 1] = self.last[data[first[1:] - 1]]
        own = np.repeat(np.arange(n), np.diff(first))
        rank = self._ranks(sym, own, np.arange(len(sym)))
        done_own, done_sym = [], []
        while len(sym):
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(sym)), begin)  # of equal ranks the first place
            going = (best >> 32) < none
            at = best[going] & 0xFFFFFFFF
            size = np.diff(begin, append=len(sym))
            live = np.repeat(going, size)
            done_own.append(own[~live])
            done_sym.append(sym[~live])
            sym[at] = self.made[rank[at]]
            live[at + 1] = False
            moved = (np.cumsum(live) - 1)[at]
            sym, own, rank = sym[live], own[live], rank[live]
            if not len(sym):
                break
            rank[moved] = self._ranks(sym, own, moved)
            before = moved[(moved > 0) & (own[np.maximum(moved - 1, 0)] == own[moved])] - 1
            rank[before] = self._ranks(sym, own, before)
        own, sym = np.concatenate([*done_own, own]), np.concatenate([*done_sym, sym])
        return sym[np.argsort(own, kind="stable")], np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])


class WordTable:
    """Ids of words; words are cut at the six ASCII white space characters only, which no token spans.

    Plain words are split and merged here, all others by the library.  A full table keeps the words of the texts at hand, so
    frequent words stay.
    """

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        with open(tokenizer, encoding="utf-8") as f:
            spec = json.load(f)
        steps = spec["normalizer"]["normalizers"] if spec.get("normalizer") else []
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or steps[1]["pattern"] != {"Regex": r"\s+"} or any(re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            raise ValueError("this tokenizer may put white space into tokens")
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        self.tok = Tokenizer.from_file(tokenizer)
        self.merges = Merges(spec["model"])
        self.clear()
        probe = ["don#t", "ab12é...", "x"]
        if [self.ids(p) for p in probe] != [self.tok.encode(p, add_special_tokens=False).ids for p in probe]:
            raise ValueError("this tokenizer splits words in another way")
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def ids(self, text: str) -> list[int]:
        return self.encode(pa.array([text], pa.string()))[0].tolist()

    def _plain(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words and how many each has: cut where the class of bytes changes and at digits, then merged by distinct pre-token."""
        size = pc.binary_length(words).to_numpy().astype(np.int64)
        data = np.frombuffer("".join(words.to_pylist()).lower().encode(), dtype=np.uint8)  # these letters keep their length
        kind = _CLASS[data]
        cut = np.ones(len(data), dtype=bool)
        cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        cut[np.cumsum(size) - size] = True
        first = np.append(np.flatnonzero(cut), len(data))
        pres = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        codes, distinct = pres.indices.to_numpy(), pres.dictionary
        offsets = np.frombuffer(distinct.buffers()[1], dtype=np.int64)[distinct.offset : distinct.offset + len(distinct) + 1]
        ids, at = self.merges.encode(np.frombuffer(distinct.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])
        many = np.diff(at)[codes]
        of = np.searchsorted(np.cumsum(size), first[:-1], side="right")
        return ids[spread(at[:-1][codes], many)].astype(np.uint32), np.bincount(of, many, len(size)).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        """Puts new words at the end of the table."""
        array = pa.array(words, pa.string())
        plain = pc.match_substring_regex(array, _PLAIN).to_numpy(zero_copy_only=False).copy()
        for k in np.flatnonzero(pc.match_substring(array, "<").to_numpy(zero_copy_only=False) & plain):
            plain[k] = not self.added.search(words[k])
        other = np.flatnonzero(~plain)
        found = [self.tok.encode(words[k], add_special_tokens=False).ids for k in other]
        size = np.zeros(len(words), dtype=np.int64)
        size[other] = [len(x) for x in found]
        own = np.empty(0, dtype=np.uint32)
        if plain.any():
            own, size[plain] = self._plain(array.filter(pa.array(plain)))
        start = np.zeros(len(words), dtype=np.int64)
        for some, base in ((plain, len(self.flat)), (~plain, len(self.flat) + len(own))):
            start[some] = base + np.cumsum(size[some]) - size[some]
        rest = np.array([i for x in found for i in x], dtype=np.uint32)
        self.row.update(zip(words, range(len(self.start), len(self.start) + len(words))))
        self.flat, self.start, self.size = np.concatenate([self.flat, own, rest]), np.concatenate([self.start, start]), np.concatenate([self.size, size])

    def _keep(self, words: list[str], rows: np.ndarray) -> None:
        """Leaves in the table these words alone, but for long ones."""
        some = [k for k, w in enumerate(words) if len(w) <= LONGEST_WORD]
        start, size = self.start[rows[some]], self.size[rows[some]]
        self.row = {words[k]: i for i, k in enumerate(some)}
        self.flat, self.start, self.size = self.flat[spread(start, size)], np.cumsum(size) - size, size

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        first, codes, words = word_codes(texts)
        rows = np.fromiter((self.row.get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(rows < 0)
        if len(new):
            rows[new] = len(self.start) + np.arange(len(new))
            self._learn([words[k] for k in new])
        size = self.size[rows][codes]
        ids = self.flat[spread(self.start[rows][codes], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[first]
        if len(self.row) > MOST_WORDS or len(self.flat) > MOST_IDS:
            self._keep(words, rows)
        return np.split(ids, ends[1:-1]) if len(texts) else []


_TABLES: dict[str, WordTable] = {}


def table_of(tokenizer: str) -> WordTable:
    """The worker's table, which its next tasks find filled."""
    if tokenizer not in _TABLES:
        _TABLES[tokenizer] = WordTable(tokenizer)
    return _TABLES[tokenizer]


class FrameWriter:
    """Writes one file of frames to a binary stream."""

    def __init__(self, out, level: int = LEVEL):
        self.out, self.squeeze, self.table, self.ids, self.at = out, zstandard.ZstdCompressor(level=level), [], [], 0

    def add(self, doc_id: int | None, data: bytes) -> None:
        frame = self.squeeze.compress(data)
        self.out.write(frame)
        self.table.append((len(frame), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.ids.append(doc_id)

    def close(self) -> None:
        known = np.array([i is not None for i in self.ids], dtype=np.uint8)
        index = zstandard.ZstdCompressor().compress(known.tobytes() + np.array([i or 0 for i in self.ids], dtype="<i8").tobytes())
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEK_MAGIC)
        # The index is followed by its own length, so it can be found from the seek table's start.
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index) + 8) + index + struct.pack("<Q", len(index)))
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek)


class FrameReader:
    """Reads frames of one file by number; nothing but the tail and the frames asked for is read."""

    def __init__(self, f):
        self.f, size = f, f.size()
        n, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_MAGIC or flags != CHECKSUMS:
            raise ValueError("not a file of seekable frames with checksums")
        begin = size - 9 - 12 * n - 8
        self.table = np.frombuffer(self._read(begin + 8, 12 * n), dtype="<u4").reshape(n, 3)
        length = struct.unpack("<Q", self._read(begin - 8, 8))[0]
        raw = zstandard.ZstdDecompressor().decompress(self._read(begin - 8 - length, length), max_output_size=9 * n)
        known = np.frombuffer(raw[:n], dtype=np.uint8)
        self.doc_ids = [int(i) if k else None for i, k in zip(np.frombuffer(raw[n:], dtype="<i8"), known)]
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0].astype(np.int64))])
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def __len__(self) -> int:
        return len(self.table)

    def frame(self, k: int) -> bytes:
        packed, plain, check = map(int, self.table[k])
        data = self.unpack.decompress(self._read(int(self.offsets[k]), packed), max_output_size=max(1, plain))
        if len(data) != plain or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def find(self, doc_id: int) -> list[bytes]:
        return [self.frame(k) for k, i in enumerate(self.doc_ids) if i == doc_id]


def _writer(path: str, tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = pafs.FileSystem.from_uri(path)
        part = TaskContext.get().partitionId()
        name, mine = f"{root}/part-{part:06d}.zst", f"{root}/.attempt-{uuid.uuid4().hex}"
        words, total = table_of(tokenizer), 0
        end = struct.pack("<I", END_ID)
        with fs.open_output_stream(mine) as out:
            to = FrameWriter(out)
            for b in text_slices(batches):
                for doc_id, ids in zip(b.column("doc_id").to_pylist(), words.encode(b.column("text"))):
                    total += len(ids) + 1
                    to.add(doc_id, ids.astype("<u4").tobytes() + end)
            to.close()
        fs.move(mine, name)
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([name.rpartition("/")[2]]), pa.array([len(to.table)], pa.int64()), pa.array([total], pa.int64())], names=["part", "file", "n_docs", "n_ids"])

    return run


def write(docs: DataFrame, path: str, tokenizer: str | None = None) -> list[tuple[str, int, int]]:
    """Writes the files; returns (file, first id's place, number of documents) of each, in order.  One short row per file comes to the driver."""
    fs, root = pafs.FileSystem.from_uri(path)
    fs.create_dir(root, recursive=True)
    spark = docs.sparkSession
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    size = some.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, size["bytes"] // FILE_BYTES, size["n"] // FILE_DOCS)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ranged = some.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text").drop("tie")
    rows = sorted(ranged.mapInArrow(_writer(path, tokenizer or default_tokenizer()), "part int, file string, n_docs long, n_ids long").collect())
    out, at = [], 0
    for _, file, n_docs, n_ids in rows:
        out.append((file, at, n_docs))
        at += n_ids
    return out


def _reader(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for b in batches:
            for file, at in zip(b.column("file").to_pylist(), b.column("start").to_pylist()):
                with fs.open_input_file(f"{root}/{file}") as f:
                    frames = FrameReader(f)
                    rows = []
                    for k in range(len(frames)):
                        data = frames.frame(k)
                        rows.append((frames.doc_ids[k], at, len(data) // 4, zlib.crc32(data)))
                        at += len(data) // 4
                    if rows:
                        yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read(spark: SparkSession, path: str, files: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    df = spark.createDataFrame([(f, at) for f, at, _ in files], "file string, start long").repartition(max(1, len(files)), "file")
    return df.mapInArrow(_reader(path), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    return read(spark, path, write(docs, path, tokenizer))
