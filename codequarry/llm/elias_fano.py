"""A two-level n-gram trie in Elias-Fano form: monotone sequences in few bits, read from memory-mapped files.

A sorted sequence keeps the low bits of every value as they are and the high bits as a unary bit
vector, in which the i-th one stands at place high(i) + i. Level 1 holds the words of a shard and, as
further monotone sequences, their running counts and the pointers to their contexts; level 2 holds
each word's contexts relative to that word (its rank, then up to 48 bits of the context), so that one
monotone sequence serves all words and a search stays within one word's range. Level 2's payload is a
16-bit code of the smoothed numerator.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

CONTEXT_BITS = 48


class EliasFano:
    """Reads the byte form that `encode` makes. All methods take and give arrays."""

    def __init__(self, data: np.ndarray):
        n, width, high_bytes = (int(x) for x in data[:24].view(np.int64))
        self.n, self.width = n, width
        self.low = data[24 : 24 + n * width].reshape(n, width)
        bits = np.unpackbits(data[24 + n * width : 24 + n * width + high_bytes], bitorder="little")
        # Select directory: where the ones are, less how many came before.
        self.high = (np.flatnonzero(bits)[:n] - np.arange(n)).astype(np.uint64)
        self.decoded: np.ndarray | None = None

    @staticmethod
    def encode(values: np.ndarray) -> bytes:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        # Whole bytes of low bits, so that they can be read in place; the high bits then take 2n bits at most.
        spare = max(0, (max(top, 1) // max(n, 1)).bit_length())
        width = min(8, -(-spare // 8))
        low = values.view(np.uint8).reshape(n, 8)[:, :width]
        high = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, dtype=np.int64)
        bits = np.zeros(int(high[-1]) + n if n else 0, dtype=np.uint8)
        bits[high + np.arange(n)] = 1
        packed = np.packbits(bits, bitorder="little")
        return np.array([n, width, len(packed)], dtype=np.int64).tobytes() + np.ascontiguousarray(low).tobytes() + packed.tobytes()

    def get(self, at: np.ndarray) -> np.ndarray:
        full = np.zeros((len(at), 8), dtype=np.uint8)
        full[:, : self.width] = self.low[at]
        low = full.view("<u8")[:, 0]
        return low if self.width == 8 else low | (self.high[at] << np.uint64(8 * self.width))

    def successor(self, values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """First place in [low, high) whose value isn't below the one asked for; high if there is none.

        Few values are searched in place. For many, the sequence is decoded once, front to back, and
        searched as a whole; as it is sorted, the place within the range is the same.
        """
        if self.decoded is None and len(values) * 16 >= self.n:
            self.decoded = self.get(np.arange(self.n))
        if self.decoded is not None:
            return np.clip(np.searchsorted(self.decoded, values), low, high)
        low, high = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            below = self.get(middle) < values[open_]
            low[open_[below]] = middle[below] + 1
            high[open_[~below]] = middle[~below]


def _framed(parts: list[bytes]) -> bytes:
    """Parts one after the other, each padded to eight bytes, after a table of their lengths."""
    table = np.array([len(parts), *[len(p) for p in parts]], dtype=np.int64).tobytes()
    return table + b"".join(p + bytes(-len(p) % 8) for p in parts)


def _unframed(data: np.ndarray) -> list[np.ndarray]:
    n = int(data[:8].view(np.int64)[0])
    at, parts = 8 * (n + 1), []
    for size in data[8 : 8 * (n + 1)].view(np.int64).tolist():
        parts.append(data[at : at + size])
        at += size + (-size % 8)
    return parts


def kept_bits(words: int) -> int:
    """Bits of a context beside the rank of its word in 64; with 65,000 words or fewer that is all of it."""
    return min(CONTEXT_BITS, 64 - max(1, words).bit_length())


def build(words: np.ndarray, counts: np.ndarray, word_of: np.ndarray, contexts: np.ndarray, weights: np.ndarray) -> bytes:
    """The byte form of a trie: sorted words with counts; (rank of word, context) sorted, with the logs of their numerators."""
    pointers = np.searchsorted(word_of, np.arange(len(words) + 1))
    bits = kept_bits(len(words))
    joined = (word_of.astype(np.uint64) << np.uint64(bits)) | (contexts >> np.uint64(CONTEXT_BITS - bits))
    low = float(weights.min()) if len(weights) else 0.0
    step = (float(weights.max()) - low) / 65535 if len(weights) else 0.0
    codes = np.zeros(len(weights), dtype=np.uint16) if step == 0 else np.rint((weights - low) / step).astype(np.uint16)
    return _framed([
        EliasFano.encode(words), EliasFano.encode(np.cumsum(counts)), EliasFano.encode(pointers), EliasFano.encode(joined),
        codes.tobytes(), np.array([low, step]).tobytes(),
    ])


class Trie:
    """A trie whose levels are mapped from a file that is gone once the task is over."""

    def __init__(self, data: bytes):
        handle, path = tempfile.mkstemp(prefix="trie-")
        try:
            with os.fdopen(handle, "wb") as file:
                file.write(data)
            mapped = np.memmap(path, dtype=np.uint8, mode="r")
        finally:
            # The mapping keeps the pages; no file is left behind, whatever becomes of the task.
            os.unlink(path)
        words, totals, pointers, contexts, codes, scale = _unframed(mapped)
        self.words, self.totals, self.pointers, self.contexts = (EliasFano(x) for x in (words, totals, pointers, contexts))
        self.codes = codes.view(np.uint16)
        self.low, self.step = scale.view(np.float64)

    def counts(self, ranks: np.ndarray) -> np.ndarray:
        upto = self.totals.get(ranks).astype(np.int64)
        before = np.where(ranks > 0, self.totals.get(np.maximum(ranks - 1, 0)).astype(np.int64), 0)
        return upto - before

    def ranks(self, words: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 of unknown ones."""
        n = self.words.n
        if not n:
            return np.full(len(words), -1)
        at = self.words.successor(words, np.zeros(len(words), dtype=np.int64), np.full(len(words), n, dtype=np.int64))
        found = (at < n) & (self.words.get(np.minimum(at, n - 1)) == words)
        return np.where(found, at, -1)

    def numerators(self, ranks: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether (word, context) is in the trie, and the log10 of its numerator, by a search among the word's own contexts."""
        n = self.contexts.n
        if not n:
            return np.zeros(len(ranks), dtype=bool), np.zeros(len(ranks))
        known = np.maximum(ranks, 0)
        low, high = self.pointers.get(known).astype(np.int64), self.pointers.get(known + 1).astype(np.int64)
        bits = kept_bits(self.words.n)
        wanted = (known.astype(np.uint64) << np.uint64(bits)) | (contexts >> np.uint64(CONTEXT_BITS - bits))
        at = self.contexts.successor(wanted, low, np.where(ranks >= 0, high, low))
        found = (ranks >= 0) & (at < high) & (self.contexts.get(np.minimum(at, n - 1)) == wanted)
        return found, np.where(found, self.low + self.step * self.codes[np.minimum(at, n - 1)], 0.0)
