"""What the corpus operators share: inputs, the shared folder, and word hashing.

Words are maximal runs of characters other than space and U+0009..U+000D.  ``bytes.split()`` of the
UTF-8 text cuts at exactly these six characters, so the Python kernels use it.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

#: Bytes of text that one numpy pass takes; temporaries are about fifty times as large.
SLICE_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, one machine gets a new folder and a cluster an error."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:  # the setting can't be changed in a running session, so the folder is remembered here
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own_dir = _own_dir or "file://" + tempfile.mkdtemp(prefix="sulcus-")
        found = _own_dir
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sulcus/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str, paths: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so a lost executor costs no recomputation.

    The folder is added to `paths`, if given, for `clear` once nothing reads from it any more.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    if paths is not None:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        delete(spark, paths.pop())


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, WS + "+"))).cast("long")


# ---------------------------------------------------------------------------------------------
# Vectorised hashing of words and of windows of words (uint64 arithmetic wraps on purpose).

_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = {1: (0x9E3779B97F4A7C15, 0), 2: (0xD6E8FEB86659FD93, 0)}
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the largest n so far, up to a bound."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(max(n, 4096), b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = (out[0], out[1])
        if n <= 4 * SLICE_BYTES:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def range_hash(values: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int = 1) -> np.ndarray:
    """Hash of values[start:stop] for each pair, by differences of one running polynomial sum."""
    up, down = _powers(_BASES[which][0], len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64))


def hash_words(norms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts whose words are joined by one space, and the first word's index of each text (and the end)."""
    buf = np.frombuffer(b" ".join(norms) + b" ", dtype=np.uint8)
    space = buf == 32
    stop = np.flatnonzero(space)
    start = np.empty_like(stop)
    start[0:1] = 0
    start[1:] = stop[:-1] + 1
    full = stop > start  # an empty text gives an empty word
    hashes = range_hash(_TABLE[buf], start[full], stop[full])
    sizes = np.fromiter((len(x) + 1 for x in norms), dtype=np.int64, count=len(norms))
    ends = np.cumsum(sizes)
    first = np.zeros(len(norms) + 1, dtype=np.int64)
    first[1:] = np.searchsorted(start[full], ends, side="left")
    return hashes, first


def slices(norms: list[bytes]) -> list[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES each; a longer text is alone in its range."""
    out, at, size = [], 0, 0
    for i, x in enumerate(norms):
        if size and size + len(x) > SLICE_BYTES:
            out.append((at, i))
            at, size = i, 0
        size += len(x)
    if at < len(norms):
        out.append((at, len(norms)))
    return out


def normal_words(texts: list[str | None]) -> list[bytes]:
    """The words of each text joined by one space."""
    return [b" ".join((t or "").encode().split()) for t in texts]


def text_slices(batches: Iterator[pa.RecordBatch], most: int = 8 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about `most` bytes of text; a longer text is alone."""
    for b in batches:
        size = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy().astype(np.int64)
        at = 0
        for k in np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1 if len(size) else ():
            yield b.slice(at, k - at)
            at = int(k)
        if at < len(size):
            yield b.slice(at)


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(first, codes, words): text k has the words numbered codes[first[k]:first[k + 1]], an empty one wherever white space begins or ends it."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))  # cuts at the same six characters as bytes.split()
    found = lists.flatten().dictionary_encode()
    first = lists.offsets.to_numpy().astype(np.int64)
    return first - first[0], found.indices.to_numpy(), found.dictionary.to_pylist()


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[k], start[k] + 1, ... (size[k] of them) for each k in turn."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class LongTable:
    """Values of distinct non-negative 64-bit keys, looked up by numpy: open addressing, whoever finds its slot taken goes on to the next."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << (4 * len(keys) + 1).bit_length()) - 1
        self.keys, self.values = np.full(self.mask + 1, -1), np.zeros(self.mask + 1, dtype=np.int64)
        slot = self._home(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            rest = np.ones(len(keys), dtype=bool)
            rest[free] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return mix(keys.view(np.uint64)).view(np.int64) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Each key's value, or -1."""
        slot = self._home(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], -1)
        at = np.flatnonzero((have != keys) & (have >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & self.mask
            have = self.keys[slot[at]]
            hit = have == keys[at]
            out[at[hit]] = self.values[slot[at[hit]]]
            at = at[~hit & (have >= 0)]
        return out
