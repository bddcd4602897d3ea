"""Helpers shared by the operators of this folder: reading tables, checkpoints and vectorised word hashing."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoint import cut, forget, shared_dir  # noqa: F401

#: Bytes that separate words: space and \t \n \v \f \r.
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id", remainder: int = 0):
    """True where crc32 of the id as text leaves that remainder by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose bits all depend on all bits (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[list(WHITE)] = True


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return utf8_of(column)


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the rows of an Arrow string column, A-Z lower-cased.

    data: the lower-cased bytes. start, end: of each word in data. first: n + 1 numbers, the rows' places among the words.
    """

    def __init__(self, column) -> None:
        data, offsets = utf8(column)
        self.data = _LOWER[data]
        n = len(self.data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_IS_WHITE[self.data]
        edge = inside[1:] != inside[:-1]
        # a row's end ends its last word, even where the next row begins with a word
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        joined = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
        self.start, self.end = np.flatnonzero(edge & inside[1:]), np.flatnonzero(edge & inside[:-1])
        if len(joined):
            self.start, self.end = np.sort(np.concatenate([self.start, joined])), np.sort(np.concatenate([self.end, joined]))
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as one number; a place for every byte and one more, with zeros after the end."""
    wide = np.zeros(len(data) + 8, np.uint8)
    wide[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", wide, strides=(1,))


def packed(view: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> np.ndarray:
    """Up to k bytes (8 at most) from start on, before end, as one number; view: eights of the data."""
    return view[start] & _KEEP[np.clip(end - start, 0, k)]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, longest: int = 64) -> np.ndarray:
    """64-bit hashes of the bytes from start to end: a chain of mix() over 8 bytes at a time; XXH3 for spans over longest."""
    view, size = eights(data), end - start
    out = mix(packed(view, start, end, 8) + mix(size))
    left = np.flatnonzero(size > 8)
    for k in range(8, longest, 8):
        if not len(left):
            break
        out[left] = mix(out[left] * np.uint64(0x9E3779B97F4A7C15) + packed(view, start[left] + k, end[left], 8))
        left = left[size[left] > k + 8]
    for i in left.tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    return out


def utf8_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a large_binary column without nulls."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def same_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, first: np.ndarray, last: np.ndarray, longest: int = 64) -> np.ndarray:
    """Whether data[start:end] is other[first:last], span by span."""
    view, peer, size = eights(data), eights(other), end - start
    out = size == last - first
    left = np.flatnonzero(out & (size > 0))
    for k in range(0, longest, 8):
        if not len(left):
            break
        out[left] = packed(view, start[left] + k, end[left], 8) == packed(peer, first[left] + k, last[left], 8)
        left = left[out[left] & (size[left] > k + 8)]
    for i in left.tolist():
        out[i] = np.array_equal(data[start[i] : end[i]], other[first[i] : last[i]])
    return out


def pieces(batches, max_bytes: int = 1 << 19, text: str = "text"):
    """Splits Arrow batches by rows so that texts of about max_bytes are worked on at once (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(text)
        column = batch.column(at)
        sizes = np.asarray(pc.binary_length(column).fill_null(0).cast(pa.int64()))
        total = np.cumsum(sizes)
        begin = 0
        while begin < batch.num_rows:
            before = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, before + max_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow in batches of few rows, so that long texts take little memory at once.

    Where the session still has Spark's default of 10000 rows in an Arrow batch, it is lowered to 500 from here on. What a
    task has freed goes back to the system at its end, as its worker lives on beside the next task's.
    """
    spark = df.sparkSession
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, "500")

    def run(batches):
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fresh(df: DataFrame, name: str) -> str:
    """name, or a name like it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
