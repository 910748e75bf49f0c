"""Language-model scores from a distributed n-gram trie in Elias-Fano form.

The model is a bigram model with a Dirichlet prior. With c(w) the training count of a token, N all
training tokens, V distinct ones, p1(w) = (c(w) + 1) / (N + V + 1) and a prior weight m,

    p(w | u) = (c(u, w) + m * p1(w)) / (c(u) + m),

which sums to 1 over all known words and one unknown. The numerator needs only counts of w, the
denominator only the count of u, so if every token travels once to the shard of its own word, with
the word before it, that one shuffle counts the corpus, builds the tries and scores every text.

 1. Words are counted, combined per task. From the table come N, V and the hot words, at most HOT
    many; pairs of hot words are counted apart, at most HOT * HOT. Only these go to the driver.
 2. Tasks pack the tokens of a few thousand documents into one block per shard: sorted words, 48 bits
    of each context, and the documents. Pairs of hot words are scored on the spot; another token of a
    hot word goes to a shard by word and context, so no shard holds a large part of all tokens.
 3. A shard builds its trie from the training tokens and looks all tokens up. Sums per document go
    back by block of documents, and are added there.

`train` writes the tries as a table and `score` uses such a table; `score_corpus` does both at once.

Defined results: a null text is an empty one, whose only token is its end; held-out documents are
scored but not learned from; null ids are learned from; repeated rows are learned from and scored
each; texts of any length are taken whole; without training tokens every probability is 1 / 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import pick
from codequarry.llm.elias_fano import CONTEXT_BITS, Trie, build
from codequarry.session import cut

#: Weight of the prior in tokens.
PRIOR = 200.0
#: A word with this part of all tokens or more is hot, so there are HOT of them at most.
HOT = 256
#: A block of documents ends at so many tokens or documents.
BLOCK_TOKENS = 2_000_000
BLOCK_DOCS = 30_000
TRAIN_BIT = 1 << 15
# White space can't be in a word, so these two are none.
END, BEGIN = xxhash.xxh64_intdigest(b"\n"), xxhash.xxh64_intdigest(b" ")
CONTEXT_MASK = np.uint64((1 << CONTEXT_BITS) - 1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, key: bytes) -> int:
        self[key] = number = len(self)
        return number


def _hashes(vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in vocabulary), dtype=np.uint64, count=len(vocabulary))


def _rows(docs: DataFrame, held_out: Column) -> DataFrame:
    """(doc_id, train, text) of every row."""
    plain = pick(docs, "doc_id", "text")
    return plain.select(F.col("doc_id").cast("bigint").alias("doc_id"), (~F.coalesce(held_out, F.lit(False))).alias("train"), "text")


def default_held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 2


# --- 1: counts of words, and of pairs of hot words


def _count_words(rows: DataFrame) -> DataFrame:
    """(word, train, everything): counts of word hashes over training documents and over all, ends included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, train, every = _Numbers(), [], []

        def flush() -> pa.RecordBatch:
            n = len(numbers)
            counted = [np.bincount(np.concatenate(part), minlength=n) if part else np.zeros(n, dtype=np.int64) for part in (train, every)]
            return pa.RecordBatch.from_arrays(
                [pa.array(_hashes(numbers).view(np.int64)), pa.array(counted[0].astype(np.int64)), pa.array(counted[1].astype(np.int64))], ["word", "train", "everything"]
            )

        for batch in batches:
            for in_train, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = [*words(text.as_py()), b"\n"]
                ids = np.fromiter(map(numbers.__getitem__, own), dtype=np.int32, count=len(own))
                every.append(ids)
                if in_train:
                    train.append(ids)
            if len(numbers) > 400_000 or sum(map(len, every)) > BLOCK_TOKENS:
                yield flush()
                numbers, train, every = _Numbers(), [], []
        yield flush()

    counted = rows.mapInArrow(run, "word bigint, train bigint, everything bigint")
    return counted.groupBy("word").agg(F.sum("train").alias("train"), F.sum("everything").alias("everything"))


def _count_pairs(rows: DataFrame, hot: list[int]) -> np.ndarray:
    """Training counts of (context, word) with both hot; the row after the last hot word is for beginnings."""
    if not hot:
        return np.zeros((1, 0), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {h: i for i, h in enumerate(hot)}
        end, size = place.get(END, -1), len(hot)
        # Rarer words are all one number here, so the table doesn't grow with the vocabulary.
        known: dict[bytes, int] = {}
        counts: Counter[int] = Counter()
        for batch in batches:
            for in_train, text in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if not in_train:
                    continue
                own = words(text.as_py())
                if len(known) > 400_000:
                    known = {w: i for w, i in known.items() if i >= 0}
                for w in own:
                    if w not in known:
                        known[w] = place.get(xxhash.xxh64_intdigest(w), -1)
                ids = np.fromiter(map(known.__getitem__, own), dtype=np.int64, count=len(own))
                before, after = np.append(size, ids), np.append(ids, end)
                both = (before >= 0) & (after >= 0)
                counts.update(dict(zip(*(x.tolist() for x in np.unique(before[both] * size + after[both], return_counts=True)), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])

    table = np.zeros((len(hot) + 1) * len(hot), dtype=np.int64)
    for row in rows.mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[row["pair"]] = row["n"]
    return table.reshape(len(hot) + 1, len(hot))


@dataclass(frozen=True)
class Statistics:
    """What every task needs to know; its size doesn't depend on the corpus."""

    tokens: int
    distinct: int
    documents: int
    hot: tuple[int, ...]
    hot_counts: tuple[int, ...]
    pairs: np.ndarray
    shards: int
    prior: float

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """p1 of words with these training counts."""
        return (counts + 1.0) / (self.tokens + self.distinct + 1.0)


def statistics(rows: DataFrame, prior: float = PRIOR) -> Statistics:
    counted = cut(_count_words(rows))
    total = counted.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("n"), F.count(F.when(F.col("train") > 0, 1)).alias("v"), F.coalesce(F.sum("everything"), F.lit(0)).alias("all")
    ).first()
    hot = counted.filter(F.col("everything") * HOT >= total["all"]).filter(F.lit(total["all"]) > 0).orderBy("word").collect()
    ends = counted.filter(F.col("word") == int(np.uint64(END).view(np.int64))).first()
    names = [int(np.int64(r["word"]).view(np.uint64)) for r in hot]
    # One shard for each task of a shuffle; blocks of tokens are as large as the cluster's setting makes them.
    shards = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Statistics(
        total["n"], total["v"], ends["train"] if ends else 0, tuple(names), tuple(r["train"] for r in hot), _count_pairs(rows, names), shards, prior
    )


# --- 2: blocks of tokens for the shards

META = "chunk bigint, meta boolean, data binary"


def _pack_pairs(word: np.ndarray, context: np.ndarray, doc: np.ndarray) -> bytes:
    """Tokens sorted by word and context: each word and each context once, then the documents of every pair."""
    new_word = np.append(True, word[1:] != word[:-1])
    new_pair = new_word | np.append(True, context[1:] != context[:-1])
    pairs = np.flatnonzero(new_pair)
    per_pair = np.diff(np.append(pairs, len(word)))
    firsts = np.flatnonzero(new_word[pairs])
    per_word = np.diff(np.append(firsts, len(pairs)))
    wide = np.uint16 if per_pair.max() < 65536 else np.uint32
    head = np.array([len(firsts), len(pairs), len(word), np.dtype(wide).itemsize], dtype=np.int64)
    contexts = np.ascontiguousarray(context[pairs].view(np.uint8).reshape(-1, 8)[:, : CONTEXT_BITS // 8])
    return b"".join(x.tobytes() for x in (head, word[pairs[firsts]], per_word.astype(np.uint32), contexts, per_pair.astype(wide), doc.astype(np.uint16)))


def _unpack_pairs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words and their numbers of pairs; per pair the context and its number of tokens; per token the document with its training bit."""
    n_words, n_pairs, n_tokens, width = np.frombuffer(data, np.int64, 4).tolist()
    at = 32
    word = np.frombuffer(data, np.uint64, n_words, at)
    at += 8 * n_words
    per_word = np.frombuffer(data, np.uint32, n_words, at)
    at += 4 * n_words
    size = CONTEXT_BITS // 8
    full = np.zeros((n_pairs, 8), dtype=np.uint8)
    full[:, :size] = np.frombuffer(data, np.uint8, n_pairs * size, at).reshape(n_pairs, size)
    at += n_pairs * size
    per_pair = np.frombuffer(data, np.uint16 if width == 2 else np.uint32, n_pairs, at).astype(np.int64)
    at += n_pairs * width
    return word, per_word, full.view("<u8")[:, 0], per_pair, np.frombuffer(data, np.uint16, n_tokens, at)


@dataclass
class _Sums:
    """Sums per document of a block: log10 of the model, log10 of the base, and known tokens."""

    score: np.ndarray
    base: np.ndarray
    known: np.ndarray

    def add(self, doc: np.ndarray, score: np.ndarray, base: np.ndarray, known: np.ndarray) -> None:
        n = len(self.score)
        self.score += np.bincount(doc, weights=score, minlength=n)
        self.base += np.bincount(doc, weights=base, minlength=n)
        self.known += np.bincount(doc, weights=known, minlength=n).astype(np.int64)


def _empty_sums(n: int) -> _Sums:
    return _Sums(np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64))


def _route(rows: DataFrame, own) -> DataFrame:
    """Blocks: one row per shard with tokens to count and score, one row per block with its documents."""

    def block(chunk: int, ids: list, train: list[bool], texts: list[np.ndarray], numbers: _Numbers, stats: Statistics) -> Iterator[tuple]:
        hashes = _hashes(numbers)
        hashes[[numbers[b" "], numbers[b"\n"]]] = [BEGIN, END]
        begin = numbers[b" "]
        sequence = np.concatenate(texts)
        lengths = np.array([len(t) for t in texts])
        doc = np.repeat(np.arange(len(texts)), lengths)
        real = sequence[1:] != begin
        before, word, doc = sequence[:-1][real], sequence[1:][real], doc[1:][real]
        sums = _empty_sums(len(texts))
        place = {h: i for i, h in enumerate(stats.hot)}
        hot_of = np.fromiter((place.get(h, -1) for h in hashes.tolist()), dtype=np.int64, count=len(hashes))
        hot_counts = np.array([*stats.hot_counts, 0], dtype=np.int64)
        context_of = hot_of.copy()
        context_of[begin] = len(stats.hot)
        # Hot words' own parts: base, and the denominator for the token after them.
        hot = hot_of[word] >= 0
        count = hot_counts[hot_of[word[hot]]]
        ends = word[hot] == numbers[b"\n"]
        p1 = stats.unigram(count)
        sums.add(doc[hot], np.where(ends, 0.0, -np.log10(count + stats.prior)), np.log10(p1), count > 0)
        sums.score -= np.log10(stats.documents + stats.prior)
        # Pairs of hot words are known here; all others are somebody else's.
        here = hot & (context_of[before] >= 0)
        if here.any():
            pair = stats.pairs[context_of[before[here]], hot_of[word[here]]]
            numerator = np.log10(pair + stats.prior * stats.unigram(hot_counts[hot_of[word[here]]]))
            sums.score += np.bincount(doc[here], weights=numerator, minlength=len(texts))
        before, word, doc = before[~here], word[~here], doc[~here]
        spread = np.where(hot_of[word] >= 0, hashes[before], np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15)
        shard = ((hashes[word] ^ spread) >> np.uint64(11)) % np.uint64(stats.shards)
        by_hash = np.empty(len(hashes), dtype=np.int64)
        by_hash[np.argsort(hashes)] = np.arange(len(hashes))
        by_context = np.empty(len(hashes), dtype=np.int64)
        by_context[np.argsort(hashes & CONTEXT_MASK, kind="stable")] = np.arange(len(hashes))
        bits = len(hashes).bit_length()
        if 2 * bits + stats.shards.bit_length() <= 63:
            key = (shard.astype(np.int64) << (2 * bits)) | (by_hash[word] << bits) | by_context[before]
            order = np.argsort(key, kind="stable")
        else:
            order = np.lexsort((by_context[before], by_hash[word], shard))
        before, word, doc, shard = before[order], word[order], doc[order], shard[order]
        flagged = doc | np.where(np.array(train)[doc], TRAIN_BIT, 0)
        heads = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)])
        for a, b in zip(heads, np.append(heads[1:], len(shard)) if len(shard) else heads, strict=True):
            yield int(shard[a]), chunk, False, _pack_pairs(hashes[word[a:b]], hashes[before[a:b]] & CONTEXT_MASK, flagged[a:b])
        table = pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([not t for t in train]), "n_tokens": pa.array(lengths - 1, pa.int64()),
            "score": sums.score, "base": sums.base, "known": sums.known,
        })
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        yield chunk % stats.shards, chunk, True, sink.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        stats = own.value
        # The task's partition and a counter name a block, the same way if the task runs again.
        chunk = TaskContext.get().partitionId() << 24
        ids, train, texts, numbers, size = [], [], [], _Numbers({b" ": 0, b"\n": 1}), 0

        def flush() -> pa.RecordBatch:
            made = list(zip(*block(chunk, ids, train, texts, numbers, stats), strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(made[0], pa.int64()), pa.array(made[1], pa.int64()), pa.array(made[2]), pa.array(made[3], pa.binary())], ["shard", "chunk", "meta", "data"]
            )

        for batch in batches:
            for doc_id, in_train, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                whole = [b" ", *words(text.as_py()), b"\n"]
                ids.append(doc_id)
                train.append(in_train)
                texts.append(np.fromiter(map(numbers.__getitem__, whole), dtype=np.int64, count=len(whole)))
                size += len(whole)
                if size >= BLOCK_TOKENS or len(ids) >= BLOCK_DOCS:
                    yield flush()
                    chunk += 1
                    ids, train, texts, numbers, size = [], [], [], _Numbers({b" ": 0, b"\n": 1}), 0
        if ids:
            yield flush()

    return rows.mapInArrow(run, "shard bigint, " + META)


# --- 3: shards


def _grow(blocks: list[tuple], stats: Statistics) -> bytes:
    """The trie of a shard from its training tokens."""
    word = np.concatenate([np.repeat(b[0], b[1]) for b in blocks]) if blocks else np.zeros(0, dtype=np.uint64)
    context = np.concatenate([b[2] for b in blocks]) if blocks else np.zeros(0, dtype=np.uint64)
    counts = [np.add.reduceat((b[4] & TRAIN_BIT) > 0, np.cumsum(b[3]) - b[3], dtype=np.int64) for b in blocks]
    count = np.concatenate(counts) if blocks else np.zeros(0, dtype=np.int64)
    word, context, count = word[count > 0], context[count > 0], count[count > 0]
    order = np.lexsort((context, word))
    word, context, count = word[order], context[order], count[order]
    if len(word):
        heads = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])))
        count = np.add.reduceat(count, heads)
        word, context = word[heads], context[heads]
    names, rank = np.unique(word, return_inverse=True)
    totals = np.bincount(rank, weights=count, minlength=len(names)).astype(np.int64)
    # A hot word's tokens are spread over shards, but its count is known.
    hot = dict(zip(stats.hot, stats.hot_counts, strict=True))
    for i in np.flatnonzero(np.isin(names, np.array(stats.hot, dtype=np.uint64))):
        totals[i] = hot[int(names[i])]
    weights = np.log10(count + stats.prior * stats.unigram(totals)[rank]) if len(names) else np.zeros(0)
    return build(names, totals, rank, context, weights)


def _look_up(blocks: list[tuple], chunks: list[int], trie: Trie, stats: Statistics) -> Iterator[tuple[int, bytes]]:
    """Sums of every block's documents over the tokens in this shard."""
    hot = np.array(sorted(stats.hot), dtype=np.uint64)
    counts_of_hot = dict(zip(stats.hot, stats.hot_counts, strict=True))
    end = np.uint64(END)
    for chunk, (word, per_word, context, per_pair, docs) in zip(chunks, blocks, strict=True):
        # What depends on the word alone is found once per word of the block.
        ranks = trie.ranks(word)
        count = np.where(ranks >= 0, trie.counts(np.maximum(ranks, 0)) if trie.words.n else 0, 0)
        is_hot = np.isin(word, hot)
        # A hot word may have no training token with a rare context in this shard.
        for i in np.flatnonzero(is_hot & (ranks < 0)):
            count[i] = counts_of_hot[int(word[i])]
        p1 = stats.unigram(count)
        # A hot word's own parts were added where its block was made.
        rest = np.where(is_hot, 0.0, np.where(word == end, 0.0, -np.log10(count + stats.prior)))
        base = np.where(is_hot, 0.0, np.log10(p1))
        known = np.where(is_hot, False, count > 0)
        found, numerator = trie.numerators(np.repeat(ranks, per_word), context)
        numerator = np.where(found, numerator, np.repeat(np.log10(stats.prior * p1), per_word))
        doc = (docs & (TRAIN_BIT - 1)).astype(np.int64)
        touched = np.flatnonzero(np.bincount(doc))
        local = np.zeros(int(doc.max()) + 1, dtype=np.int64)
        local[touched] = np.arange(len(touched))
        sums = _empty_sums(len(touched))
        # The pairs of a word follow each other, and so do the tokens of a pair.
        tokens = np.add.reduceat(per_pair, np.cumsum(per_word, dtype=np.int64) - per_word, dtype=np.int64)
        sums.add(local[doc], np.repeat(numerator, per_pair) + np.repeat(rest, tokens), np.repeat(base, tokens), np.repeat(known, tokens))
        head = np.array([len(touched)], dtype=np.int64)
        yield chunk, b"".join(x.tobytes() for x in (head, sums.base, sums.score.astype(np.float32), sums.known.astype(np.uint32), touched.astype(np.uint16)))


def _answers(table: pa.Table, made: Iterator[tuple[int, bytes]]) -> pa.Table:
    """A shard's answers, with the blocks' own rows passed on."""
    passed = table.filter(table.column("meta")).select(["chunk", "meta", "data"])
    pairs = list(made)
    answered = pa.table({"chunk": pa.array([c for c, _ in pairs], pa.int64()), "meta": pa.array([False] * len(pairs), pa.bool_()), "data": pa.array([d for _, d in pairs], pa.binary())})
    return pa.concat_tables([passed.cast(answered.schema), answered])


def _blocks_of(table: pa.Table) -> tuple[list[int], list[tuple]]:
    tokens = table.filter(pc.invert(table.column("meta")))
    return tokens.column("chunk").to_pylist(), [_unpack_pairs(d.as_py()) for d in tokens.column("data")]


def _added(table: pa.Table) -> pa.Table:
    """One block's documents with the sums of all shards added."""
    rows = pa.ipc.open_stream(table.filter(table.column("meta")).column("data")[0].as_py()).read_all()
    score, base, known = (rows.column(n).to_numpy().copy() for n in ("score", "base", "known"))
    for item in table.filter(pc.invert(table.column("meta"))).column("data"):
        data = item.as_py()
        n = int(np.frombuffer(data, np.int64, 1)[0])
        doc = np.frombuffer(data, np.uint16, n, 8 + 16 * n).astype(np.int64)
        base[doc] += np.frombuffer(data, np.float64, n, 8)
        score[doc] += np.frombuffer(data, np.float32, n, 8 + 8 * n)
        known[doc] += np.frombuffer(data, np.uint32, n, 8 + 12 * n)
    return pa.table({
        "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": rows.column("n_tokens"),
        "n_known": pa.array(known, pa.int64()), "base_score": base, "score": score,
    })


RESULT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score_corpus(docs: DataFrame, held_out: Column | None = None, prior: float = PRIOR) -> DataFrame:
    """Learns from the documents that aren't held out and scores all, with one shuffle of the tokens."""
    rows = _rows(docs, default_held_out() if held_out is None else held_out)
    stats = statistics(rows, prior)
    own = docs.sparkSession.sparkContext.broadcast(stats)

    def shard(table: pa.Table) -> pa.Table:
        chunks, blocks = _blocks_of(table)
        return _answers(table, _look_up(blocks, chunks, Trie(_grow(blocks, own.value)), own.value))

    answered = _route(rows, own).groupBy("shard").applyInArrow(shard, META)
    scored = answered.groupBy("chunk").applyInArrow(_added, RESULT)
    return scored.withColumn("train_tokens", F.lit(stats.tokens).cast("bigint"))


def train(docs: DataFrame, held_out: Column | None = None, prior: float = PRIOR) -> tuple[Statistics, DataFrame]:
    """The model: bounded statistics, and a written table of one trie per shard."""
    rows = _rows(docs, F.lit(False) if held_out is None else held_out).filter("train")
    stats = statistics(rows, prior)
    own = docs.sparkSession.sparkContext.broadcast(stats)

    def shard(table: pa.Table) -> pa.Table:
        _, blocks = _blocks_of(table)
        return pa.table({"shard": table.column("shard").slice(0, 1), "trie": pa.array([_grow(blocks, own.value)], pa.binary())})

    return stats, cut(_route(rows, own).groupBy("shard").applyInArrow(shard, "shard bigint, trie binary"))


def score(docs: DataFrame, stats: Statistics, tries: DataFrame) -> DataFrame:
    """Scores documents by a trained model; none of them is learned from."""
    rows = _rows(docs, F.lit(True))
    own = docs.sparkSession.sparkContext.broadcast(stats)
    nothing = build(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0))

    def shard(tokens: pa.Table, tries: pa.Table) -> pa.Table:
        chunks, blocks = _blocks_of(tokens)
        trie = Trie(tries.column("trie")[0].as_py() if tries.num_rows else nothing)
        return _answers(tokens, _look_up(blocks, chunks, trie, own.value))

    answered = _route(rows, own).groupBy("shard").cogroup(tries.groupBy("shard")).applyInArrow(shard, META)
    return answered.groupBy("chunk").applyInArrow(_added, RESULT).withColumn("train_tokens", F.lit(stats.tokens).cast("bigint"))
