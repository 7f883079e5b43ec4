"""Token counts under a unigram model, by dynamic programming on a trie of distinct pre-tokens.

A pre-token is a word with a white space marker in front.  The distinct new pre-tokens of a slice of texts are put into a trie,
which is built level by level: in their order, words of one prefix are neighbours, and each prefix is one node.  A node
keeps the best forward score of its prefix, the number of tokens on that path, and the places of its prefix from which a
piece may still be read (states of the pieces' own trie); these are made once from its parent's, for a whole level at a
time.  A terminal's count is its word's token count; terminals stay in a table of the worker, which its next tasks find
filled.  A document's count is the sum over its words.

The unigram scores are fixed by the vocabulary's order, which is by falling frequency: the piece of rank r scores
-log(r + 2), Zipf's law.  A character outside the vocabulary is its UTF-8 bytes, one token each.  Equal scores go to the
longer last piece.

Defined cases: null and empty texts have no tokens; words longer than LONGEST are computed by the same recurrence without
being inserted; the table of terminals is emptied when it has MOST_WORDS words, which changes no count; repeated rows are
each counted; a long text is split and counted whole; an empty table gives an empty result; columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LongTable, spread, text_slices, word_codes

MARK = "▁"
MOST_WORDS = 800_000
LONGEST = 64
#: Words of one trie; the levels' arrays have some ten entries a node.
TRIE_WORDS = 1 << 16


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(model: str) -> tuple[dict[str, float], float]:
    """Scores of pieces, and the score of a byte token."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {p: -math.log(r + 2) for r, p in enumerate(pieces)}, -math.log(len(pieces) + 2)


def utf8_sizes(chars: np.ndarray) -> np.ndarray:
    return 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800) + (chars >= 0x10000)


class Pieces:
    """The pieces as a trie: numbered states, whose children are in a table by state and character."""

    def __init__(self, scores: dict[str, float]):
        child: dict[int, int] = {}
        ends: dict[int, float] = {}
        for p, score in scores.items():
            at = 0
            for c in p:
                at = child.setdefault(at << 21 | ord(c), len(child) + 1)
            ends[at] = score
        self.child = child
        self.score = np.full(len(child) + 1, -np.inf)
        self.score[list(ends)] = list(ends.values())
        keys, values = (np.fromiter(x, dtype=np.int64, count=len(child)) for x in (child.keys(), child.values()))
        self.inner = np.zeros(len(child) + 1, dtype=bool)
        self.inner[keys >> 21] = True
        self.table = LongTable(keys, values)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Each state's child by a character, or -1."""
        return self.table.get(state << 21 | char)


class Trie:
    def __init__(self, scores: dict[str, float], byte_score: float):
        self.scores, self.byte, self.pieces = scores, byte_score, Pieces(scores)
        self.terminal: dict[str, int] = {}

    def forward(self, words: list[str]) -> np.ndarray:
        """Token counts of distinct non-empty pre-tokens in ascending order, from one trie."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        longest = int(size.max(initial=0))
        chars = np.array(words, dtype=f"U{max(longest, 1)}").view(np.uint32).reshape(len(words), -1).astype(np.int64)
        counts, node = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        # The root's prefix is empty; a piece may begin after it.  Entries of a node stand together, those of longer pieces first.
        best, n = np.zeros(1), np.zeros(1, dtype=np.int64)
        first, state, base, upto = np.array([0, 1]), np.zeros(1, dtype=np.int64), best, n
        for level in range(1, longest + 1):
            row = np.flatnonzero(size >= level)
            up, c = node[row], chars[row, level - 1]
            new = np.ones(len(row), dtype=bool)
            new[1:] = (up[1:] != up[:-1]) | (c[1:] != c[:-1])
            node[row] = np.cumsum(new) - 1
            up, c = up[new], c[new]
            # Each node takes over its parent's entries, as far as its character goes on with them.
            many = first[up + 1] - first[up]
            own = np.repeat(np.arange(len(up)), many)
            at = spread(first[up], many)
            state = self.pieces.step(state[at], c[own])
            ok = state >= 0
            own, at, state = own[ok], at[ok], state[ok]
            base, upto = base[at], upto[at]
            score = self.pieces.score[state] + base
            many = np.bincount(own, minlength=len(up))
            some, top = many > 0, np.full(len(up), -np.inf)
            if len(own):
                top[some] = np.maximum.reduceat(score, (np.cumsum(many) - many)[some])
            win = np.flatnonzero(score == top[own])
            win = win[np.diff(own[win], prepend=-1) > 0]
            count = np.zeros(len(up), dtype=np.int64)
            count[own[win]] = upto[win] + 1
            # A character that is no piece may be its bytes.
            alone = self.pieces.step(np.zeros(len(up), dtype=np.int64), c)
            width = utf8_sizes(c)
            spelt = np.where((alone >= 0) & np.isfinite(self.pieces.score[alone]), -np.inf, best[up] + self.byte * width)
            count = np.where(spelt > top, n[up] + width, count)
            best, n = np.maximum(top, spelt), count
            done = size[row] == level
            counts[row[done]] = n[node[row[done]]]
            # Entries that no piece goes on with end here; a piece may begin after each node.
            ok = self.pieces.inner[state]
            own, state, base, upto = own[ok], state[ok], base[ok], upto[ok]
            first = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=len(best)) + 1)])
            to = np.arange(len(own)) + own
            last = first[1:] - 1
            state, base, upto = (self._joined(len(to) + len(last), to, x, last, y) for x, y in ((state, 0), (base, best), (upto, n)))
        return counts

    @staticmethod
    def _joined(size: int, to: np.ndarray, x: np.ndarray, last: np.ndarray, y) -> np.ndarray:
        out = np.empty(size, dtype=x.dtype)
        out[to], out[last] = x, y
        return out

    def count_long(self, word: str) -> int:
        """The same recurrence along one pre-token."""
        best, n = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
        child, score = self.pieces.child, self.pieces.score
        for i, c in enumerate(word):
            if c not in self.scores:
                k = len(c.encode())
                if best[i] + self.byte * k > best[i + 1]:
                    best[i + 1], n[i + 1] = best[i] + self.byte * k, n[i] + k
            state = 0
            # Places are left in ascending order, so of equal scores the one that came first is the longer piece's.
            for j in range(i, len(word)):
                state = child.get(state << 21 | ord(word[j]))
                if state is None:
                    break
                x = best[i] + float(score[state])
                if x > best[j + 1]:
                    best[j + 1], n[j + 1] = x, n[i] + 1
        return n[-1]

    def learn(self, words: list[str]) -> list[int]:
        """Token counts of new words, which go into the table of terminals."""
        if len(self.terminal) + len(words) > MOST_WORDS:
            self.terminal.clear()
        got = {w: self.count_long(MARK + w) for w in words if len(w) >= LONGEST}
        short = sorted(MARK + w for w in words if len(w) < LONGEST)
        for at in range(0, len(short), TRIE_WORDS):
            some = short[at : at + TRIE_WORDS]
            got.update(zip([w[1:] for w in some], self.forward(some).tolist()))
        self.terminal.update(got)
        return list(map(got.__getitem__, words))

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words and tokens of each text."""
        first, codes, words = word_codes(texts)
        known = list(map(self.terminal.get, words))
        known = [0 if w == "" else x for w, x in zip(words, known)]
        new = [k for k, x in enumerate(known) if x is None]
        for k, x in zip(new, self.learn([words[k] for k in new])):
            known[k] = x
        tokens = np.array(known, dtype=np.int64)
        full = np.array([w != "" for w in words], dtype=np.int64)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[codes])])[first])
        return total(full), total(tokens)


_TRIES: dict[str, Trie] = {}


def trie_of(model: str) -> Trie:
    """The worker's trie, whose terminals its next tasks find."""
    if model not in _TRIES:
        _TRIES[model] = Trie(*vocabulary(model))
    return _TRIES[model]


def _counter(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(model)
        for b in text_slices(batches):
            words, tokens = trie.counts(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(words), pa.array(tokens)], names=["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(_counter(model or default_model()), "doc_id long, n_words long, n_tokens long")
