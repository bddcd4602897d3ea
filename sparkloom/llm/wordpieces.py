"""Ids of a tokenizer file of the ``tokenizers`` library, word by word, with a bounded memo of words."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import Words, release, same_bytes, span_hashes


class ChunkEncoder:
    """encode_column gives the ids of every row, as Tokenizer.encode with add_special_tokens=False.

    Only for tokenizers that lower-case, never join characters across ASCII white space, and drop it, and that set a full
    stop or comma after a letter apart (such as the file word_bpe_49k.json): there the ids of a text are the ids of its
    words, of which a batch has far fewer different ones. A file that breaks this on a probe text raises ValueError. Special
    tokens in a text (exact bytes, before lower-casing) become their ids, as in the library, and part the text there. The
    memo is a sorted table of the hashes of up to ``most`` words with the places of their bytes and ids in one array each: a word
    is known only if its bytes are the same. Words beyond that are encoded whenever they come.
    """

    def __init__(self, path: str, most: int = 300_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError(f"{path}: added tokens that are normalised, stripped or whole words only")
        self.special = {t.content: i for i, t in added.items()}
        self.parts = re.compile("(" + "|".join(re.escape(c) for c in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        probe = "Ab cD.\tEf, g's\n12x\x0b é." + "".join(self.special)
        want = self.tokenizer.encode(probe, add_special_tokens=False).ids
        # from here on texts come without special tokens: what lower-casing makes look like one is none
        self.tokenizer.encode_special_tokens = True
        self.most, self.calls = most, 0
        # two tables (hash, place and number of the ids, place and number of the bytes): a large one, and a small one of what came since it was last merged
        self.tables = [(np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4))) for _ in range(2)]
        self.ids, self.bytes = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        one = lambda c: self.tokenizer.encode(c, add_special_tokens=False).ids
        self.ends = [np.array(one(c), np.uint32) for c in ".,"]
        # marks to stand between words, so that many are encoded at once: rare characters that are one id by themselves
        self.marks = [(c, i[0]) for c in "¯¢×«®" if len(i := one(c)) == 1]
        if np.frombuffer(self.encode(probe), "<u4").tolist() != want:
            raise ValueError(f"{path}: ids of a text aren't the ids of its words")

    def _learn(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, at_once: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words from begin to end, one after the other, and how many each has."""
        parts = [self._encoded(data, begin[k : k + at_once], end[k : k + at_once]) for k in range(0, len(begin), at_once)]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _encoded(self, data, begin, end) -> tuple[np.ndarray, np.ndarray]:
        size = end - begin
        within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        own = data[np.repeat(begin, size) + within]
        for mark, mark_id in self.marks:
            gap = np.frombuffer(f" {mark} ".encode(), np.uint8)
            place = np.cumsum(size + len(gap)) - size - len(gap)
            joined = np.zeros(int(place[-1] + size[-1]), np.uint8)
            for k, byte in enumerate(gap):
                joined[place[1:] - len(gap) + k] = byte
            joined[np.repeat(place, size) + within] = own
            text = joined.tobytes().decode()
            if text.count(mark) == len(size) - 1:
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                at = np.flatnonzero(ids == mark_id)
                if len(at) == len(size) - 1:
                    return np.delete(ids, at), np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1
        words = [data[a:b].tobytes().decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        got = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for g in got for i in g], np.uint32), np.array([len(g) for g in got], np.int64)

    def _place(self, hashes, data, begin, end) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of known words begin and how many there are; -1 for unknown ones."""
        start, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        for known, starts, counts, places, sizes in self.tables:
            if len(known):
                at = np.searchsorted(known, hashes).clip(max=len(known) - 1)
                hit = np.flatnonzero(known[at] == hashes)
                at = at[hit]
                same = same_bytes(data, begin[hit], end[hit], self.bytes, places[at], places[at] + sizes[at])
                hit, at = hit[same], at[same]
                start[hit], count[hit] = starts[at], counts[at]
        return start, count

    def _keep(self, hashes, start, count, data, begin, end) -> None:
        size = end - begin
        own = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        place = len(self.bytes) + np.cumsum(size) - size
        self.bytes = np.concatenate([self.bytes, data[own]])
        large, small = self.tables
        merged = [np.concatenate(x) for x in zip(small, (hashes, start, count, place, size), strict=True)]
        if len(merged[0]) > 1 << 17:
            merged = [np.concatenate(x) for x in zip(large, merged, strict=True)]
            order = np.argsort(merged[0])
            self.tables = [tuple(m[order] for m in merged), tuple(m[:0] for m in merged)]
        else:
            order = np.argsort(merged[0])
            self.tables = [large, tuple(m[order] for m in merged)]

    def encode_column(self, column, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of the rows of an Arrow string column, one after the other, and the n + 1 offsets; nulls have none. end_id is added to each row."""
        self.calls += 1
        if self.calls % 32 == 0:
            release()  # the library leaves much freed memory behind
        out, offsets = self._whole(column)
        if end_id is not None:
            out = np.insert(out, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
        return out, offsets

    def _whole(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets; rows with special tokens are cut there, and their pieces encoded as rows of their own."""
        hit = np.zeros(len(column), bool)
        for c in self.special:
            hit |= pc.match_substring(column, c).fill_null(False).to_numpy(zero_copy_only=False)
        if not hit.any():
            return self._plain(column)
        pieces, first = [], [0]
        for row, special in zip(column.to_pylist(), hit.tolist(), strict=True):
            pieces += self.parts.split(row) if special else [row]  # every second one is a special token
            first.append(len(pieces))
        first = np.array(first)
        own = np.full(len(pieces), -1, np.int64)
        for r in np.flatnonzero(hit).tolist():
            own[first[r] + 1 : first[r + 1] : 2] = [self.special[p] for p in pieces[first[r] + 1 : first[r + 1] : 2]]
        ids, offsets = self._plain(pa.array([p if o < 0 else "" for p, o in zip(pieces, own.tolist(), strict=True)], pa.large_string()))
        at = np.flatnonzero(own >= 0)
        out = np.insert(ids, offsets[at], own[at].astype(np.uint32))
        before = np.concatenate([[0], np.cumsum(own >= 0)])
        return out, (offsets + before)[first]

    def _plain(self, column) -> tuple[np.ndarray, np.ndarray]:
        w = Words(column)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(w.first), np.int64)
        last, before = w.data[w.end - 1], w.data[np.maximum(w.end - 2, 0)]
        letter = (w.end - w.start > 1) & (before >= 97) & (before <= 122)
        mark = np.where(letter & (last == 46), 0, np.where(letter & (last == 44), 1, -1))
        end = w.end - (mark >= 0)
        hashes, first, codes = np.unique(span_hashes(w.data, w.start, end), return_index=True, return_inverse=True)
        if not same_bytes(w.data, w.start, end, w.data, w.start[first[codes]], end[first[codes]]).all():  # different words of one hash
            seen: dict[bytes, int] = {}
            codes = np.array([seen.setdefault(w.data[a:b].tobytes(), len(seen)) for a, b in zip(w.start.tolist(), end.tolist(), strict=True)])
            first = np.unique(codes, return_index=True)[1]
            hashes = span_hashes(w.data, w.start[first], end[first])
        start, count = self._place(hashes, w.data, w.start[first], end[first])
        new = np.flatnonzero(start < 0)
        pool = self.ids
        if len(new):
            begin, stop = w.start[first[new]], end[first[new]]
            ids, counts = self._learn(w.data, begin, stop)
            count[new], start[new] = counts, len(pool) + np.cumsum(counts) - counts
            pool = np.concatenate([pool, ids])
            if sum(len(t[0]) for t in self.tables) < self.most:
                self.ids = pool
                self._keep(hashes[new], start[new], counts, w.data, begin, stop)
        start, count = start[codes], count[codes]
        extra = np.array([len(e) for e in self.ends] + [0])[mark]
        ends = np.cumsum(count + extra)
        out = np.zeros(int(ends[-1]), np.uint32)
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out[np.repeat(ends - count - extra, count) + at] = pool[np.repeat(start, count) + at]
        for k, ids in enumerate(self.ends):
            own = ends[mark == k]
            for j, i in enumerate(ids):
                out[own - len(ids) + j] = i
        return out, np.concatenate([[0], ends])[w.first]

    def encode(self, text: str) -> bytes:
        return self.encode_column(pa.array([text], pa.large_string()))[0].astype("<u4").tobytes()


@lru_cache(maxsize=1)
def chunk_encoder(path: str) -> ChunkEncoder:
    """One encoder for each Python worker, so that its memo serves all of the worker's tasks."""
    return ChunkEncoder(path)
