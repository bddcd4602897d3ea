"""Packing: vector bin packing of tokenised documents under limits on tokens, segments and loss-bearing tokens.

An example is a vector (tokens, one segment, loss-bearing tokens), each in parts of its limit. A window of examples is placed
from the largest on; each goes to the open sequence whose remaining room has the largest dot product with it, weighted by
the window's demand. Where no sequence has room for a whole example, it is cut: the first part fills the sequence with the
most room. Sequences that can't be filled (the end of a partition, or the segment limit) are cut into powers of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, pieces
from .wordpieces import chunk_encoder


@dataclass
class Limits:
    """Of one sequence. loss may be smaller than tokens: then prompts and responses have to be mixed."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Packer:
    """Places examples in sequences. add() and finish() yield pieces (key, start, length, sequence, offset).

    An example is (key, tokens, loss_from): its tokens from number loss_from on bear loss. Each token lies in exactly one
    piece; a sequence's pieces are gapless from offset 0 and keep all limits. The work kept is one window and `open_most`
    sequences, whatever the input's size.
    """

    def __init__(self, limits: Limits, window: int = 1024, open_most: int = 24, first_sequence: int = 0) -> None:
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.window, self.open_most = limits, window, open_most
        self.next = first_sequence
        self.waiting: list[tuple] = []  # (key, start, length, loss_from)
        self.bins: list[list[tuple]] = []
        self.room = np.zeros((open_most, 3))
        self.size = np.array([limits.tokens, limits.segments, limits.loss], float)

    @staticmethod
    def _loss(item) -> int:
        key, start, length, loss_from = item
        return max(0, start + length - max(start, loss_from))

    def add(self, key, tokens: int, loss_from: int = 0) -> Iterator[tuple]:
        start = 0
        whole = min(self.limits.tokens, self.limits.loss)
        while tokens - start >= whole and whole == self.limits.tokens:  # full by itself
            yield from self._emit([(key, start, whole, loss_from)])
            start += whole
        while tokens - start > 0:
            length = min(whole, tokens - start)
            self.waiting.append((key, start, length, loss_from))
            start += length
        if len(self.waiting) >= self.window:
            yield from self._place()

    def finish(self) -> Iterator[tuple]:
        """Places what is left; only here, and at the segment or loss limit, sequences are shorter than the token limit."""
        yield from self._place()
        rest = [x for b in self.bins for x in b]
        self.bins = []
        here: list[tuple] = []
        for item in rest:  # refill: what is left of all open sequences is joined
            while item:
                room = self._room(here)
                part, item = self._split(item, room)
                if part:
                    here.append(part)
                if item or not part:
                    yield from self._emit(here)
                    here = []
        if here:
            yield from self._emit(here)

    def _room(self, bin_) -> np.ndarray:
        return self.size - [sum(x[2] for x in bin_), len(bin_), sum(map(self._loss, bin_))]

    def _split(self, item, room):
        """The part that fits into room (None: nothing does) and the rest (None: it fits whole)."""
        key, start, length, loss_from = item
        if room[1] < 1:
            return None, item
        fits = min(length, int(room[0]))
        fits = min(fits, max(0, loss_from - start) + int(room[2]))
        if fits <= 0:
            return None, item
        return (key, start, fits, loss_from), ((key, start + fits, length - fits, loss_from) if fits < length else None)

    def _place(self) -> Iterator[tuple]:
        items = self.waiting
        self.waiting = []
        if not items:
            return
        need = np.array([[x[2], 1, self._loss(x)] for x in items], float) / self.size
        weight = need.sum(0) / need.sum()
        order = np.argsort(-(need @ weight), kind="stable")
        todo = [items[i] for i in order[::-1]]
        while todo:
            item = todo.pop()
            vector = np.array([item[2], 1, self._loss(item)], float)
            room = self.room[: len(self.bins)]
            fits = np.flatnonzero((room >= vector).all(1))
            if len(fits):
                at = int(fits[((room[fits] / self.size) @ (weight * vector / self.size)).argmax()])
                part, rest = item, None
            elif len(self.bins) < self.open_most:
                at = len(self.bins)
                self.bins.append([])
                self.room[at] = self.size
                part, rest = self._split(item, self.room[at])
            else:
                at = int(np.where((room[:, 1] >= 1) & (room[:, 2] >= 1), room[:, 0], -1).argmax())
                part, rest = self._split(item, room[at])
            if part:
                self.bins[at].append(part)
                self.room[at] -= [part[2], 1, self._loss(part)]
            if rest:
                todo.append(rest)
            if (self.room[at] < 1).any():
                yield from self._emit(self.bins[at])
                self.bins.pop(at)
                self.room[at:-1] = self.room[at + 1 :].copy()

    def _emit(self, bin_) -> Iterator[tuple]:
        """One full sequence, or several whose lengths are powers of two, the largest first."""
        total = sum(x[2] for x in bin_)
        queue = list(bin_)[::-1]
        while total:
            length = total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
            at = 0
            while at < length:
                key, start, n, loss_from = queue.pop()
                take = min(n, length - at)
                if take < n:
                    queue.append((key, start + take, n - take, loss_from))
                yield key, start, take, self.next, at
                at += take
            total -= length
            self.next += 1


SCHEMA = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, limits: Limits | None = None, prompt_tokens: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32 (of the piece's ids, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    docs: any columns with doc_id and text; a null text is an empty one, which still has its end id. tokenizer: path of the
    file. prompt_tokens: a column with the number of leading tokens that bear no loss (null or absent: none). Each partition
    packs its own documents, so nothing is shuffled and a lost task repeats by itself; sequence ids are the partition's number
    times 2**40, counted on. Rows with equal ids are packed apart. An empty table gives an empty result.
    """
    limits = limits or Limits()
    prompt = F.coalesce(F.col(prompt_tokens).cast("long"), F.lit(0)) if prompt_tokens else F.lit(0).cast("long")

    def run(batches):
        encoder = chunk_encoder(tokenizer)
        packer = Packer(limits, first_sequence=TaskContext.get().partitionId() << 40)
        kept: dict[int, list] = {}  # number of the row: doc_id, ids, tokens still to place
        rows: list[tuple] = []
        number = 0

        def take(found):
            for key, start, length, sequence, offset in found:
                doc = kept[key]
                rows.append((doc[0], start, length, zlib.crc32(doc[1][4 * start : 4 * (start + length)]), len(doc[1]) // 4, sequence, offset))
                doc[2] -= length
                if not doc[2]:
                    del kept[key]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(7)], SCHEMA.names)
            rows.clear()
            return out

        for batch in pieces(batches):
            tokens, at = encoder.encode_column(batch.column(1), end_id)
            coded = tokens.astype("<u4").tobytes()
            for k, (doc_id, free) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                own = coded[4 * at[k] : 4 * at[k + 1]]
                kept[number] = [doc_id, own, len(own) // 4]
                take(packer.add(number, len(own) // 4, free))
                number += 1
            if len(rows) > 5000:
                yield flush()
        take(packer.finish())
        yield flush()

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", prompt.alias("p")), run, SCHEMA)
