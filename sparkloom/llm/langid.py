"""Language identification with language-bitmask n-gram filters.

Every language has a Bloom filter of its byte n-grams. The filters are bit-sliced: slot i holds one 64-bit word whose bit l
is slot i of language l, so one look-up per hash function, and one AND of the words, gives all languages that contain an
n-gram; every further 64 languages add a word to each slot. The languages' bit counts over a text, corrected for the filters'
false positives, decide.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, arrow_map, fresh, held_out, pieces, release, utf8

SIZE = 4  # bytes of an n-gram
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of every row that hold part of a letter, and the n + 1 offsets of the rows.

    A-Z are lower-cased; every row counts as if two blanks stood before and after it, so short texts have n-grams too.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    blanks, none = pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pc.binary_join_element_wise(blanks, column.cast(pa.large_string()).fill_null(""), blanks, none)
    data, offsets = utf8(padded)
    data = _LOWER[data]
    n = len(data)
    if n < SIZE:
        return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
    wide = data.astype(np.uint32)
    code = wide[: n - 3] | wide[1 : n - 2] << np.uint32(8) | wide[2 : n - 1] << np.uint32(16) | wide[3:] << np.uint32(24)
    letter = _LETTER[data]
    valid = letter[: n - 3] | letter[1 : n - 2] | letter[2 : n - 1] | letter[3:]
    for k in range(1, SIZE):  # those that reach into the next row
        valid[np.clip(offsets[1:-1] - k, 0, n - 4)] = False
    running = np.zeros(n - 2, np.int64)
    np.cumsum(valid, out=running[1:])
    return code[valid], running[np.clip(offsets, 0, n - 3)]


@dataclass
class LanguageFilters:
    """slots: uint64 by word and slot, bit l of word w for languages[64 * w + l]. hashes: look-ups per n-gram. false: false-positive rate by language."""

    languages: list[str]
    slots: np.ndarray
    hashes: int
    false: np.ndarray

    @classmethod
    def build(cls, by_language: dict[str, np.ndarray], bits: int = 19, hashes: int = 2) -> LanguageFilters:
        languages = sorted(by_language)
        self = cls(languages, np.zeros((max(1, -(-len(languages) // 64)), 1 << bits), np.uint64), hashes, np.zeros(len(languages)))
        for at, name in enumerate(languages):
            for place in self._places(by_language[name].astype(np.uint32)):
                self.slots[at // 64, place] |= np.uint64(1 << at % 64)
        for at in range(len(languages)):
            self.false[at] = ((self.slots[at // 64] >> np.uint64(at % 64)) & np.uint64(1)).mean() ** hashes
        return self

    def _places(self, codes: np.ndarray):
        shift = np.uint64(64 - (self.slots.shape[1].bit_length() - 1))
        wide = codes.astype(np.uint64)
        for k in range(self.hashes):
            yield (wide * _MULTIPLIERS[k]) >> shift

    def masks(self, codes: np.ndarray, word: int = 0) -> np.ndarray:
        """For each n-gram the bits of all of a word's languages that contain it (and, rarely, of others)."""
        out = None
        for place in self._places(codes):
            got = self.slots[word][place]
            out = got if out is None else np.bitwise_and(out, got, out=out)
        return out

    def shares(self, column) -> np.ndarray:
        """Rows by languages: the share of a row's n-grams that the language contains, corrected for false positives."""
        codes, first = grams(column)
        counts = np.diff(first)
        out = np.zeros((len(counts), len(self.languages)))
        full = np.flatnonzero(counts > 0)
        if len(full) and self.languages:
            for at in range(len(self.languages)):
                if at % 64 == 0:
                    masks = self.masks(codes, at // 64)
                hits = np.add.reduceat((masks >> np.uint64(at % 64)).astype(np.uint8) & 1, first[:-1][full], dtype=np.int64)
                out[full, at] = hits / counts[full]
        return np.clip((out - self.false) / np.maximum(1 - self.false, 1e-9), 0, 1)

    def predict(self, column) -> tuple[np.ndarray, np.ndarray]:
        """For each row the place of its language (ties: the first name) and its share; -1 where no language was learned."""
        shares = self.shares(column)
        if not self.languages:
            return np.full(len(shares), -1), np.zeros(len(shares))
        best = shares.argmax(1)
        return best, shares[np.arange(len(best)), best]


def _even_shares(counts: dict[str, int], sample: int) -> dict[str, float]:
    """The share of each language's rows to read, so that all get equally many, about sample together."""
    out, left = {}, sample
    for at, name in enumerate(sorted(counts, key=lambda k: (counts[k], k))):
        take = min(counts[name], left / (len(counts) - at))
        out[name] = take / counts[name]
        left -= take
    return out


def fit(docs: DataFrame, sample: int = 12_000, least: int = 3, relative: float = 0.02, bits: int = 19, hashes: int = 2) -> LanguageFilters:
    """Learns filters from text and non-null lang of documents that are not held out.

    About sample documents are read: every language gets an equal part, and what a language is too small to use goes to the
    others, so a rare language is learned whole however large the table is. They are chosen by a hash of doc_id from all. A
    language contains an n-gram that occurs least times in it, and at no less than relative times the rate of the language
    where it is commonest.
    """
    known = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = known.groupBy("lang").count().toPandas()  # one row per language
    limit = F.lit(0)
    if shares := _even_shares(dict(zip(counts["lang"], counts["count"], strict=True)), sample):
        limit = F.coalesce(F.element_at(F.create_map(*[x for k, v in shares.items() for x in (F.lit(k), F.lit(math.ceil((1 << 40) * v)).cast("long"))]), F.col("lang")), F.lit(0))
    part = known.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 40)) < limit)

    def count(batches):
        for batch in pieces(batches):
            codes, first = grams(batch.column(1))
            names = batch.column(0).to_pylist()
            owner = np.repeat(np.arange(len(names)), np.diff(first))
            for name in sorted(set(names)):
                rows = np.array([x == name for x in names])
                u, n = np.unique(codes[rows[owner]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])

    found = arrow_map(part.select("lang", "text"), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rows = found.toArrow().to_pandas()  # bounded by the sample
    rows["rate"] = rows["n"] / rows.groupby("lang")["n"].transform("sum")
    rows = rows[(rows["n"] >= least) & (rows["rate"] >= relative * rows.groupby("code")["rate"].transform("max"))]
    out = LanguageFilters.build({str(k): g["code"].to_numpy() for k, g in rows.groupby("lang")}, bits, hashes)
    del rows
    release()
    return out


def identify(docs: DataFrame, filters: LanguageFilters, pred: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """docs with the language of every whole text, and its score from 0 to 1 (the corrected share of its n-grams).

    Texts that are null or have no letter are ``und`` with score 0; so are all where no language was learned. All columns
    stay; a column that already has one of the two new names is replaced. An empty table stays empty.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(filters)
    names = [c for c in docs.columns if c not in (pred, score)]
    schema = docs.select(*names).withColumns({pred: F.lit("").cast("string"), score: F.lit(0.0)}).schema
    ask = docs.select(*names).withColumn(fresh(docs, "__letter"), F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    at = names.index("text")

    def run(batches):
        model = shared.value
        for batch in pieces(batches):
            best, share = model.predict(batch.column(at))
            known = batch.column(len(names)).to_numpy(zero_copy_only=False).astype(bool) & (best >= 0)
            labels = [model.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(np.where(known, share, 0.0))], [*names, pred, score])

    return arrow_map(ask, run, schema)


def keep_identified(docs: DataFrame, filters: LanguageFilters, least: float = 0.3) -> DataFrame:
    """docs, all columns as they were, without those of unknown language or whose best language covers too few n-grams."""
    names = docs.columns
    pred, score = fresh(docs, "__lang_pred"), fresh(docs, "__lang_score")
    out = identify(docs, filters, pred, score)
    return out.where((F.col(pred) != "und") & (F.col(score) >= least)).select(*names)
