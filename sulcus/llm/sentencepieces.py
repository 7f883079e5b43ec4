"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of a fitting model has a white space marker after another character, so no merge crosses the start of a run of
markers.  A text is therefore cut before each run; each distinct chunk (its markers and the word after them) is segmented
once by the library and kept in a bounded table of the worker; a document's ids are its chunks' ids in order.  Decoding
goes chunk by chunk in the same way.

Defined cases: null counts as empty; an empty text has no ids and decodes to an empty text; U+2581 in a text is a marker
like a space, as in the library; repeated rows are each encoded; a long text is encoded whole, and a chunk longer than
LONGEST_CHUNK is not kept; an empty table gives an empty result; extra columns stay out of `encode`'s result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks in a worker's table and characters of a chunk that is kept; the table is emptied when full.
MOST_CHUNKS, LONGEST_CHUNK = 300_000, 48
_CUT = re.compile(" +[^ ]*")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """Segments chunks with the library and remembers (ids as text, number of ids, decoded text)."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in pieces) or self.sp.normalize("a  b ") != f"{MARK}a{MARK}{MARK}b{MARK}":
            raise ValueError("pieces of this model cross white space markers, or its normaliser changes texts")
        self.lone = self.sp.piece_to_id(MARK)
        self.known: dict[str, tuple[str, int, str]] = {}

    def look(self, chunk: str) -> tuple[str, int, str]:
        """chunk: one or more spaces and the characters up to the next space."""
        got = self.known.get(chunk)
        if got is None:
            # The library puts a marker in front, which is the chunk's first space; a lone space would be an empty text.
            ids = self.sp.encode(chunk[1:], num_threads=1) if len(chunk) > 1 else [self.lone]
            text = " " + self.sp.decode(ids) if len(chunk) > 1 else " "
            got = (",".join(map(str, ids)), len(ids), text)
            if len(chunk) <= LONGEST_CHUNK:
                if len(self.known) >= MOST_CHUNKS:
                    self.known.clear()
                self.known[chunk] = got
        return got

    def parts(self, text: str) -> list[tuple[str, int, str]]:
        if not text:
            return []
        look, known = self.look, self.known
        return [known.get(c) or look(c) for c in _CUT.findall(" " + text.replace(MARK, " "))]


_TABLES: dict[str, ChunkTable] = {}


def table_of(model: str) -> ChunkTable:
    """The worker's table, which its next tasks find filled."""
    if model not in _TABLES:
        _TABLES[model] = ChunkTable(model)
    return _TABLES[model]


_SCHEMA = "doc_id long, n_tokens long, ids string, decoded string"


def _encoder(model: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model)
        for b in batches:
            texts = b.column("text").to_pylist()
            for lo in range(0, len(texts), 512):
                counts, ids, back = [], [], []
                for t in texts[lo : lo + 512]:
                    parts = table.parts(t or "")
                    counts.append(sum([p[1] for p in parts]))
                    a, d = ",".join([p[0] for p in parts]), "".join([p[2] for p in parts])[1:]
                    ids.append(hashlib.sha256(a.encode()).hexdigest() if digests else a)
                    back.append(hashlib.sha256(d.encode()).hexdigest() if digests else d)
                yield pa.record_batch([b.column("doc_id").slice(lo, 512), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids", "decoded"])

    return run


def encode(docs: DataFrame, model: str | None = None, digests: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (decimals joined by commas), decoded; the last two as SHA-256 if digests."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(_encoder(model or default_model(), digests), _SCHEMA)
