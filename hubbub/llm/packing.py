"""Packing documents into sequences by minimum bin slack.

A document's full windows are sequences of their own. Of the remaining lengths each task keeps a
histogram. Seeded by the longest, a subset-sum search over the histogram, a bitset of reachable sums, picks
the multiset that comes closest to the capacity; backtracking over the stored bitsets gives how many
of each length. A multiset without slack is used as often as the counts allow. A seed that no multiset completes is
set aside and the search goes on with the next longest; what was set aside waits for the next block. When half a
block waits, and at the end of a task, the closest multiset is used with its slack: one more remainder is cut to
fill it, and what is left of that goes back to the histogram. When everything left is shorter than a window, the
same search fills sequences of powers of two, so no sequence needs padding. Each piece tells how it was placed: whole
(a full window of its document), search (a remainder in a multiset that was found), cut (what fills a slack).

A task holds at most one block of remaining ids beside the document at hand and works alone: nothing is shuffled,
whatever the sizes of documents or sources. Nulls and empty texts are the end id alone. Equal rows are packed one by
one. An empty table gives no pieces. Columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubbub.llm.common import few_at_once, whole_text
from hubbub.llm.tokens import MEMORY, word_encoder

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, placed string"
_PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("placed", pa.string()),
])


def closest_fill(counts: dict[int, int], capacity: int) -> tuple[dict[int, int], int]:
    """The multiset with the longest length in it whose sum is closest to capacity, and its slack."""
    seed = max(counts)
    need, reach, steps = capacity - seed, 1, []
    mask = (1 << (need + 1)) - 1
    for length in sorted((x for x in counts if x <= need), reverse=True):
        most = min(counts[length] - (length == seed), need // length)
        steps.append((length, most, reach))
        left, part = most, 1
        while left > 0:
            take = min(part, left)
            reach |= reach << (take * length)
            left, part = left - take, part * 2
        reach &= mask
        if reach >> need & 1:
            break
    total = reach.bit_length() - 1
    slack, chosen = need - total, {seed: 1}
    for length, most, before in reversed(steps):
        k = next(k for k in range(most + 1) if total >= k * length and before >> (total - k * length) & 1)
        if k:
            chosen[length] = chosen.get(length, 0) + k
            total -= k * length
    return chosen, slack


class _Packer:
    """Pieces of one task. held: length -> remainders (doc_id, start, ids, doc_tokens), tokens of them in all."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.held: dict[int, list[tuple]] = {}
        self.tokens = 0
        self.out: list[tuple] = []

    def _put(self, part: tuple, offset: int, how: str) -> int:
        doc_id, start, ids, doc_tokens = part
        n = len(ids) // 4
        self.out.append((doc_id, start, n, ids, doc_tokens, self.sequence, offset, how))
        return offset + n

    def _hold(self, part: tuple) -> None:
        n = len(part[2]) // 4
        self.held.setdefault(n, []).append(part)
        self.tokens += n

    def _take(self, length: int) -> tuple:
        part = self.held[length].pop()
        if not self.held[length]:
            del self.held[length]
        self.tokens -= length
        return part

    def _window(self, chosen: dict[int, int]) -> int:
        offset = 0
        for length, k in chosen.items():
            for _ in range(k):
                offset = self._put(self._take(length), offset, "search")
        return offset

    def add(self, doc_id: int, ids: bytes) -> None:
        n, size = len(ids) // 4, self.capacity
        for start in range(0, n - n % size, size):
            self._put((doc_id, start, ids[4 * start : 4 * (start + size)], n), 0, "whole")
            self.sequence += 1
        if n % size:
            self._hold((doc_id, n - n % size, ids[4 * (n - n % size) :], n))

    def fill(self) -> None:
        """Windows without slack, longest seed first. A seed that cannot be completed is in no full window of what is
        left, as all shorter lengths were tried with it; so its length leaves the search and stays in held."""
        counts = {k: len(v) for k, v in self.held.items()}
        while counts:
            chosen, slack = closest_fill(counts, self.capacity)
            if slack:
                del counts[max(counts)]
                continue
            for _ in range(min(counts[x] // k for x, k in chosen.items())):
                self._window(chosen)
                self.sequence += 1
            for length in chosen:
                counts[length] = len(self.held.get(length, ()))
                if not counts[length]:
                    del counts[length]

    def _close(self, size: int) -> None:
        """One sequence of size tokens, of which so many are held: the closest multiset, a remainder cut to fill its
        slack. Every remainder outside the multiset is longer than that slack."""
        counts = {k: len(v) for k, v in self.held.items() if k <= size}
        chosen, slack = closest_fill(counts, size) if counts else ({}, size)
        offset = self._window(chosen)
        if slack:
            doc_id, start, ids, doc_tokens = self._take(max(self.held))
            self._put((doc_id, start, ids[: 4 * slack], doc_tokens), offset, "cut")
            self._hold((doc_id, start + slack, ids[4 * slack :], doc_tokens))
        self.sequence += 1

    def settle(self, most: int) -> None:
        """The closest windows until at most `most` tokens or less than a window are held."""
        while self.tokens > most and self.tokens >= self.capacity:
            self._close(self.capacity)

    def finish(self) -> None:
        """Everything: what is shorter than a window goes to sequences of powers of two."""
        self.settle(0)
        while self.tokens:
            self._close(1 << (self.tokens.bit_length() - 1))


def pack(docs: DataFrame, *, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, block_tokens: int = 1 << 22, memory: int = MEMORY) -> DataFrame:
    """Pieces of docs (doc_id, text): each with its ids, its place in its document and in its sequence.
    capacity must be a power of two. sequence_id is unique; a task's sequences are numbered on from
    its partition number times 2**36. A Python worker remembers what up to `memory` words of a kind encode to."""
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def pieces(batches):
        encoder, end = word_encoder(tokenizer_path, memory), int(end_id).to_bytes(4, "little")
        packer = _Packer(capacity, TaskContext.get().partitionId() << 36)

        def done():
            rows, packer.out = packer.out, []
            for i in range(0, len(rows), 1024):
                columns = zip(*rows[i : i + 1024])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)

        for batch in few_at_once(batches):
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encoder.each(batch["text"])):
                packer.add(doc_id, ids + end)
                if packer.tokens >= block_tokens:
                    packer.fill()
                    packer.settle(block_tokens // 2)
                if len(packer.out) >= 1024:
                    yield from done()
        packer.fill()
        packer.finish()
        yield from done()

    rows = docs.select("doc_id", whole_text(F.col("text")).alias("text"))
    return rows.mapInArrow(pieces, PIECE_SCHEMA)
