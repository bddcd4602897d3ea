"""Byte-level BPE encoding and decoding by a rank file, in time linear in a text's length.

Bytes are mapped to Latin-1 characters, so that pyahocorasick finds the vocabulary's tokens in them. A piece is covered from
left to right by the longest token that starts at each place; where a token cannot stand beside the one before it, the next
shorter one is tried, and if there is none, the token before is taken back. Two tokens can stand side by side exactly if
merging their bytes by the ranks gives these two tokens again; that is remembered per pair. A cover whose neighbours are all
compatible is the one that the merges give.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_map, pieces


def read_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: one token in base64 and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merged(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: again and again, the leftmost adjacent pair whose join has the lowest rank is merged."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            break
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


class ByteBPE:
    """encode(text) gives ids as bytes (little-endian unsigned 32-bit); decode(those) gives the text's bytes.

    Memos over pieces and pairs of tokens are emptied when they hold ``most`` entries; pieces over 64 characters are not kept.
    """

    def __init__(self, path: str, pattern: str, most: int = 300_000) -> None:
        self.ranks = read_ranks(path)
        missing = [i for i in range(256) if bytes([i]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks bytes {missing[:5]}")
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        # for each token the longest other token that it begins with
        self.shorter = [-1] * len(self.tokens)
        for token, rank in self.ranks.items():
            for n in range(len(token) - 1, 0, -1):
                if (found := self.ranks.get(token[:n])) is not None:
                    self.shorter[rank] = found
                    break
        self.sizes = [len(t) for t in self.tokens]
        self.pattern = regex.compile(pattern)
        self.most = most
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            a, b = self.tokens[left], self.tokens[right]
            known = merged(a + b, self.ranks) == [a, b]
            if len(self.pairs) >= self.most:
                self.pairs.clear()
            self.pairs[left, right] = known
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        n, sizes = len(data), self.sizes
        longest = [-1] * n
        for end, rank in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - sizes[rank]
            if longest[start] < 0 or sizes[longest[start]] < sizes[rank]:
                longest[start] = rank
        dead = bytearray(n + 1)  # places where no cover from the left can end
        out: list[int] = []
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + sizes[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
                continue
            token = self.shorter[token]
            while token < 0:
                dead[at] = 1
                token = out.pop()
                at -= sizes[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        matches = self.pattern.findall(text)
        memo = self.memo
        try:
            return b"".join([memo[m] for m in matches])
        except KeyError:
            pass
        out = []
        for m in matches:
            ids = memo.get(m)
            if ids is None:
                ids = array("I", self.piece(m.encode())).tobytes()
                if len(m) <= 64:
                    if len(memo) >= self.most:
                        memo.clear()
                    memo[m] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        table = self.tokens
        return b"".join([table[i] for i in array("I", ids)])


@lru_cache(maxsize=1)
def byte_bpe(path: str, pattern: str) -> ByteBPE:
    """One coder for each Python worker, so that its memos serve all of the worker's tasks."""
    return ByteBPE(path, pattern)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])


def encode(docs: DataFrame, path: str, pattern: str, digests: bool = False) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and decoded (the bytes that the ids stand for) of every whole text.

    With digests doc_id, n_tokens, ids_sha256 and decoded_sha256 instead, so that long results don't leave the task.
    A null or empty text has no ids. Repeated rows give repeated rows; other columns are ignored; an empty table stays empty.
    """
    schema = T.StructType([SCHEMA[0], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]) if digests else SCHEMA

    def run(batches):
        coder = byte_bpe(path, pattern)
        for batch in pieces(batches):
            ids = [coder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            back = [coder.decode(i) for i in ids]
            first = batch.column(0)
            if digests:
                columns = [first, pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(b).hexdigest() for b in back])]
            else:
                columns = [first, pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return arrow_map(docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text"), run, schema)
