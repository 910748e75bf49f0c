"""Language identification by prediction by partial matching over bytes.

Each language has a context tree: after every context of up to ORDER bytes, how often each byte
followed. A byte's probability is its share after the longest context in the tree that knows the
byte; leaving a longer context costs its escape probability (method C: distinct followers over
followers plus distinct followers). Below the shortest context all bytes are equal. The statistics
are frozen after training, so every (context, byte) has one code length, and a text's score under a
language is the exact sum over its bytes. The language with the shortest code wins; `score` is one
minus the ratio of its code length to the mean length under all languages, put between 0 and 1.

Frozen trees are laid out as one table of code lengths: a row for each context that some language
knows, shorter contexts for the rest, so whole texts are scored by two look-ups per byte.

Training uses a bounded sample: per language the ROWS labelled documents with the smallest digest of
id and text, whole. The languages must be fewer than MAX_LANGUAGES. All else covers every row.

Letters are folded by ASCII case, digits and white space to one byte each, so that they say nothing.

Defined results: null texts and texts without a letter are `und` with score 0; without training rows
every text is; ties go to the first language by name; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import pick, row_key
from codequarry.operators.topk import top_k
from codequarry.session import cut

ORDER = 3
ROWS = 400
MAX_LANGUAGES = 200

_FOLD = bytes(32 if c <= 32 else 48 if 48 <= c <= 57 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def fold(text: str) -> np.ndarray:
    """Bytes of a text after folding; runs of folded white space and digits are one byte each."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), dtype=np.uint8)
    same = np.zeros(len(raw), dtype=bool)
    same[1:] = (raw[1:] == raw[:-1]) & ((raw[1:] == 32) | (raw[1:] == 48))
    return raw[~same]


def _codes(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte the number made of the `order` bytes before it; texts begin after white space."""
    padded = np.concatenate([np.full(order, 32, dtype=np.uint8), data]).astype(np.int64)
    code = np.zeros(len(data), dtype=np.int64)
    for d in range(order):
        code = (code << 8) | padded[d : d + len(data)]
    return code


class ContextTrees:
    """Frozen trees of all languages as code-length tables, in bits."""

    def __init__(self, counts: dict[str, dict[int, dict[int, np.ndarray]]], order: int):
        """counts[language][length][context] is an array of 256 follower counts."""
        self.languages = sorted(counts)
        self.order = order
        n = len(self.languages)
        # Row 0 is the empty context; every known longer context gets a row, in order of length.
        self.table = np.full((1, 256, n), 8.0, dtype=np.float32)
        self.table[0] = self._after(0, np.zeros(1, dtype=np.int64), counts, np.full((1, 256, n), 8.0))[0]
        tables, rows = [self.table], [{0: 0}]
        for length in range(1, order + 1):
            known = np.array(sorted({c for language in counts.values() for c in language[length]}), dtype=np.int64)
            suffix = known & ((1 << (8 * (length - 1))) - 1)
            shorter = np.concatenate(tables)[[self._row(rows, int(s), length - 1) for s in suffix]] if len(known) else np.zeros((0, 256, n))
            tables.append(self._after(length, known, counts, shorter).astype(np.float32))
            base = sum(len(t) for t in tables[:-1])
            rows.append({int(c): base + i for i, c in enumerate(known)})
        self.table = np.concatenate(tables)
        self.known = [np.array(sorted(r), dtype=np.int64) for r in rows]
        self.row_of = [np.array([r[c] for c in sorted(r)], dtype=np.int64) for r in rows]

    @staticmethod
    def _row(rows: list[dict[int, int]], context: int, length: int) -> int:
        while context not in rows[length]:
            length -= 1
            context &= (1 << (8 * length)) - 1
        return rows[length][context]

    def _after(self, length: int, contexts: np.ndarray, counts: dict, shorter: np.ndarray) -> np.ndarray:
        """Code lengths after these contexts, given those after the contexts one byte shorter."""
        bits = np.array(shorter, dtype=np.float64)
        for k, language in enumerate(self.languages):
            own = counts[language][length]
            for i, context in enumerate(contexts.tolist()):
                seen = own.get(context)
                if seen is None:
                    continue
                total, distinct = seen.sum(), np.count_nonzero(seen)
                known = seen > 0
                bits[i, known, k] = -np.log2(seen[known] / (total + distinct))
                bits[i, ~known, k] += -np.log2(distinct / (total + distinct))
        return bits

    def lengths(self, text: str) -> np.ndarray:
        """Exact code length of a text under every language, in bits."""
        data = fold(text)
        total = np.zeros(len(self.languages))
        for at in range(0, len(data), 1 << 18):
            part = data[max(0, at - self.order) : at + (1 << 18)]
            skip = min(at, self.order)
            code = _codes(part, self.order)[skip:]
            row = np.zeros(len(code), dtype=np.int64)
            open_ = np.arange(len(code))
            for length in range(self.order, 0, -1):
                wanted = code[open_] & ((1 << (8 * length)) - 1)
                known = self.known[length]
                if not len(known):
                    continue
                place = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[place] == wanted
                row[open_[hit]] = self.row_of[length][place[hit]]
                open_ = open_[~hit]
                if not len(open_):
                    break
            total += self.table[row, part[skip:]].sum(axis=0, dtype=np.float64)
        return total


def _sample(docs: DataFrame, learn: Callable[[Column], Column], rows: int) -> DataFrame:
    """(lang, text) of the rows with the smallest digests of each language.

    Only digests are ranked, `rows` per language and task; texts are then read for the digests below
    each language's bound.
    """
    plain = pick(docs, "doc_id", "text", "lang").filter(learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    keyed = plain.withColumn("digest", F.xxhash64(row_key(F.col("doc_id"), F.col("text")), F.lit("sample")))
    bounds = cut(top_k(keyed.select("lang", "digest"), ["lang"], [F.col("digest")], rows).groupBy("lang").agg(F.max("digest").alias("bound")))
    return keyed.join(bounds, "lang").filter("digest <= bound").select("lang", "text")


def _count(sample: DataFrame, order: int) -> DataFrame:
    """(lang, length, context, byte, n) over the sample, combined per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(fold(text))
            for lang, own in texts.items():
                for length in range(order + 1):
                    grams = np.concatenate([(_codes(t, length) << 8) | t for t in own])
                    value, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(value)), pa.array([length] * len(value), pa.int32()), pa.array(value >> 8), pa.array(value & 255), pa.array(n)],
                        ["lang", "length", "context", "byte", "n"],
                    )

    counted = sample.mapInArrow(run, "lang string, length int, context bigint, byte bigint, n bigint")
    return counted.groupBy("lang", "length", "context", "byte").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, learn: Callable[[Column], Column], order: int = ORDER, rows: int = ROWS) -> ContextTrees:
    """Trees of all languages from the bounded sample of rows for whose id `learn` holds."""
    counts: dict[str, dict[int, dict[int, np.ndarray]]] = {}
    # At most one row per distinct gram of the sample, whose size is bounded by rows and languages.
    for r in _count(_sample(docs, learn, rows), order).toLocalIterator():
        levels = counts.setdefault(r["lang"], {length: {} for length in range(order + 1)})
        levels[r["length"]].setdefault(r["context"], np.zeros(256, dtype=np.int64))[r["byte"]] = r["n"]
        if len(counts) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages among the labels")
    return ContextTrees(counts, order)


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            names, scores = [], []
            for item in batch.column(1):
                text = item.as_py()
                if not text or not own.languages or not any(map(str.isalpha, text)):
                    names.append("und")
                    scores.append(0.0)
                    continue
                bits = own.lengths(text)
                best = int(np.argmin(bits))
                others = (bits.sum() - bits[best]) / max(1, len(bits) - 1)
                names.append(own.languages[best])
                scores.append(float(min(1.0, max(0.0, 1.0 - bits[best] / others))) if len(bits) > 1 and others > 0 else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return plain.mapInArrow(run, "doc_id bigint, lang_pred string, score double")
