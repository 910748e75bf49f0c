"""Edit-aware token counts over pre-token segment trees.

A tokenizer of byte pairs works on pre-tokens, pieces that a pattern cuts the text into, and never
across them. A document's pre-tokens with their token counts are the leaves of a segment tree whose
inner nodes hold sums of characters and tokens, so an edit's place is found from the root down. Only
pre-tokens that the edit touches are cut and encoded anew, with two before them as boundary context:
the pattern looks ahead, never back, so from the first new boundary that falls on an old one the old
pre-tokens are right again. Sums are updated on the way back to the root.

Edits are (start, stop, text) in code points of the text as it is when the edit is applied.

Defined results: a null text is an empty one and stays without edits; edits beyond the end are cut to
the end; repeated rows are counted each; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import pick

#: Pre-tokens in one slot of the tree.
SLOT = 32
CONTEXT = 2
#: Counts of pre-tokens are remembered up to this many; the memory is then emptied.
REMEMBERED = 200_000


class Encoder:
    """Token counts of pre-tokens from a vocabulary file's content."""

    def __init__(self, vocabulary: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern)
        self.memory: dict[str, int] = {}
        self.encoded = 0

    def counts(self, pieces: list[str]) -> list[int]:
        memory = self.memory
        if len(memory) > REMEMBERED:
            memory.clear()
        for piece in pieces:
            if piece not in memory:
                memory[piece] = len(self.encoding.encode_ordinary(piece))
        self.encoded += len(pieces)
        return [memory[p] for p in pieces]

    def pieces(self, text: str) -> list[str]:
        return self.cut.findall(text)


class TokenTree:
    """Segment tree over slots of pre-tokens; every node has the sums of characters and tokens below it."""

    def __init__(self, text: str, encoder: Encoder):
        self.encoder = encoder
        pieces = encoder.pieces(text)
        self._arrange(pieces, encoder.counts(pieces))

    def _arrange(self, pieces: list[str], counts: list[int]) -> None:
        self.slots = [(pieces[i : i + SLOT], counts[i : i + SLOT]) for i in range(0, len(pieces), SLOT)] or [([], [])]
        self.width = 1 << (len(self.slots) - 1).bit_length()
        self.chars = np.zeros(2 * self.width, dtype=np.int64)
        self.tokens = np.zeros(2 * self.width, dtype=np.int64)
        for i, (own, n) in enumerate(self.slots):
            self.chars[self.width + i] = sum(map(len, own))
            self.tokens[self.width + i] = sum(n)
        level = self.width
        while level > 1:
            for sums in (self.chars, self.tokens):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(axis=1)
            level //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tokens[1])

    @property
    def n_chars(self) -> int:
        return int(self.chars[1])

    def text(self) -> str:
        return "".join(p for own, _ in self.slots for p in own)

    def _slot_at(self, place: int) -> tuple[int, int]:
        """The slot that holds a character, and where the slot begins; from the root down."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place - begin >= self.chars[node] and self.chars[node + 1] > 0:
                begin += int(self.chars[node])
                node += 1
        return node - self.width, begin

    def _set(self, i: int, pieces: list[str], counts: list[int]) -> None:
        self.slots[i] = (pieces, counts)
        node = self.width + i
        self.chars[node], self.tokens[node] = sum(map(len, pieces)), sum(counts)
        while node > 1:
            node //= 2
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def _leaves_from(self, i: int) -> Iterator[tuple[int, int, str]]:
        for slot in range(i, len(self.slots)):
            for k, piece in enumerate(self.slots[slot][0]):
                yield slot, k, piece

    def edit(self, start: int, stop: int, text: str) -> None:
        """Replaces characters [start, stop) and re-encodes what that touches."""
        start = min(max(start, 0), self.n_chars)
        stop = min(max(stop, start), self.n_chars)
        first, begin = self._slot_at(start)
        # Boundary context: some pre-tokens before the one that holds the edit.
        while first > 0 and start - begin <= sum(map(len, self.slots[first][0][:CONTEXT])) + CONTEXT:
            first -= 1
            begin -= int(self.chars[self.width + first])
        k, at = 0, begin
        own = self.slots[first][0]
        while k < len(own) and at + len(own[k]) < start:
            at += len(own[k])
            k += 1
        back = max(0, k - CONTEXT)
        at -= sum(map(len, own[back:k]))
        left = back
        # Old boundaries at or after the edit's end, read only as far as needed.
        leaves = self._leaves_from(first)
        for _ in range(left):
            next(leaves)
        old, position, last = [], at, (first, left)
        fresh: list[str] = []
        shift = len(text) - (stop - start)
        tail, met = "", False
        while not met:
            # Read some more old pre-tokens, cut the region anew, and look for a common boundary.
            grown = False
            for slot, j, piece in leaves:
                old.append(piece)
                position += len(piece)
                last = (slot, j + 1)
                grown = True
                if position >= stop + 1 and len(old) % 8 == 0:
                    break
            region = "".join(old)
            edited = region[: start - at] + text + region[stop - at :]
            fresh = self.encoder.pieces(edited)
            if not grown or position >= self.n_chars:
                break
            # A cut before the region's end could change with what follows, so the last pieces don't count.
            ends_old = set(np.cumsum([len(p) for p in old]).tolist())
            upto = 0
            for n, piece in enumerate(fresh[: -2 * CONTEXT]):
                upto += len(piece)
                before = upto - shift
                if before >= stop - at and before in ends_old:
                    kept, total = [], 0
                    for p in old:
                        total += len(p)
                        if total > before:
                            kept.append(p)
                    fresh, tail, met = fresh[: n + 1], "".join(kept), True
                    break
        # The slots read so far are rewritten: untouched beginning, new pre-tokens, untouched rest.
        head, head_n = own[:left], self.slots[first][1][:left]
        slot, j = last
        rest, rest_n = self.slots[slot][0][j:], self.slots[slot][1][j:]
        keep = self._tail(old, len(tail)) if met else []
        pieces = [*head, *fresh, *keep, *rest]
        numbers = [*head_n, *self.encoder.counts(fresh), *self.known(keep), *rest_n]
        for i in range(first + 1, slot + 1):
            self._set(i, [], [])
        if len(pieces) > 8 * SLOT:
            self._set(first, pieces, numbers)
            whole = [(p, n) for own, n in self.slots for p, n in zip(own, n, strict=True)]
            self._arrange([p for p, _ in whole], [n for _, n in whole])
        else:
            self._set(first, pieces, numbers)

    @staticmethod
    def _tail(old: list[str], size: int) -> list[str]:
        """The last old pre-tokens, of `size` characters together."""
        kept: list[str] = []
        while size > 0:
            kept.append(old[-1 - len(kept)])
            size -= len(kept[-1])
        return kept[::-1]

    def known(self, pieces: list[str]) -> list[int]:
        """Counts of pre-tokens that are in the tree already."""
        memory = self.encoder.memory
        return [memory[p] if p in memory else len(self.encoder.encoding.encode_ordinary(p)) for p in pieces]


RESULT = "doc_id bigint, n_pretokens bigint, n_tokens bigint, n_edits bigint, n_reencoded bigint, n_chars_after bigint, n_tokens_after bigint"


def count(docs: DataFrame, edits: Column, vocabulary: str, pattern: str) -> DataFrame:
    """Counts before and after each row's edits, an array<struct<start, stop, text>> column over the row.

    Edits that come as a table of their own are first collected per document and joined to it. The
    vocabulary file is read once, here; its content, of fixed size, goes to the tasks.
    """
    plain = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint"), "text")
    rows = plain.select("doc_id", "text", F.when(F.col("text").isNotNull(), edits).alias("edits"))
    with open(vocabulary, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast((file.read(), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            made: list[tuple] = []
            for text, changes in zip(batch.column(1), batch.column(2), strict=True):
                tree = TokenTree(text.as_py() or "", encoder)
                pretokens, before = sum(len(own) for own, _ in tree.slots), tree.n_tokens
                encoder.encoded = 0
                own = changes.as_py() or []
                for change in own:
                    tree.edit(change["start"], change["stop"], change["text"] or "")
                made.append((pretokens, before, len(own), encoder.encoded, tree.n_chars, tree.n_tokens))
            columns = zip(*made, strict=True) if made else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_chars_after", "n_tokens_after"],
            )

    return rows.mapInArrow(run, RESULT)


def derived_edits(text: Column) -> Column:
    """Three edits of a whole text, from the text itself: a cut in its first quarter, an insertion in
    its middle of its own first characters, and a replacement in its last quarter."""
    n = F.length(text)
    place = lambda part: F.floor(n * part).cast("bigint")
    edit = lambda start, length, new: F.struct(start.alias("start"), (start + F.lit(length)).alias("stop"), new.alias("text"))
    return F.array(
        edit(place(0.25), 5, F.lit("")), edit(place(0.5), 0, F.left(text, F.lit(20))), edit(place(0.75), 3, F.lit(" edited")),
    )
