"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Every word has three hashed features (the word, its first 4 and its first 6 bytes), whose embeddings are summed. Filters of
widths 1, 2 and 3 pass over the whole text, the largest response of each is kept (max pooling), and a logistic layer scores.
A threshold per language, which is told from the text itself, is chosen on a part of the labelled sample that trains nothing;
the score is shifted so that the language's threshold lies at 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import langid
from .common import Words, arrow_map, eights, fresh, held_out, mix, packed, pieces, release, span_hashes

FEATURES = 3
WIDTHS = (1, 2, 3)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b".,;:!?\"')(|")] = True


def features(column, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets (words by FEATURES, from 1 on) and the n + 1 offsets of the rows. A-Z count as a-z; the last two marks of a word and one before it don't count."""
    w = Words(column)
    start, end = w.start, w.end
    for _ in range(2):
        end = end - ((end > start + 1) & _PUNCTUATION[w.data[end - 1]])
    start = start + ((end > start + 1) & _PUNCTUATION[w.data[start]])
    view = eights(w.data)
    raw = (span_hashes(w.data, start, end), packed(view, start, end, 4) + np.uint64(1 << 61), packed(view, start, end, 6) + np.uint64(1 << 62))
    out = np.stack([np.maximum(mix(x) >> np.uint64(64 - bits), np.uint64(1)) for x in raw], 1)
    return out.astype(np.uint16 if bits <= 16 else np.uint32), w.first


def _padded(buckets: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bucket 0, whose embedding is zero, after each text, as many as the widest filter, so that an empty text has a window as well; and the texts' starts."""
    gap = max(WIDTHS)
    n = len(first) - 1
    out = np.zeros((len(buckets) + gap * n, FEATURES), np.int64)
    owner = np.repeat(np.arange(n), np.diff(first))
    out[np.arange(len(buckets)) + gap * owner] = buckets
    return out, first[:-1] + gap * np.arange(n)


@dataclass
class ToxicityModel:
    bits: int = 16
    size: int = 8
    filters: int = 8
    seed: int = 7
    thresholds: dict[str, float] = field(default_factory=dict)
    default: float = 0.0
    languages: langid.LanguageFilters | None = None

    def __post_init__(self) -> None:
        r = np.random.default_rng(self.seed)
        self.e = r.normal(0, 0.1, (1 << self.bits, self.size)).astype(np.float32)
        self.e[0] = 0
        self.k = [r.normal(0, 0.5 / np.sqrt(w * self.size), (w, self.size, self.filters)).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(self.filters, np.float32) for _ in WIDTHS]
        self.v = r.normal(0, 0.3, len(WIDTHS) * self.filters).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def _pooled(self, buckets: np.ndarray, first: np.ndarray, places: bool = False):
        """Pooled responses (rows by filters), and with places where the largest responses begin."""
        ids, starts = _padded(buckets, first)
        x = self.e[ids].sum(1)
        m, pooled, where = len(x), [], []
        if not len(starts):
            return np.zeros((0, len(WIDTHS) * self.filters), np.float32), [], ids
        for w, k, b in zip(WIDTHS, self.k, self.b, strict=True):
            out = np.full((m, self.filters), -np.inf, np.float32)
            out[: m - w + 1] = b
            for j in range(w):
                out[: m - w + 1] += x[j : m - w + 1 + j] @ k[j]
            ends = np.append(starts[1:], m)
            for j in range(1, w):  # windows that reach into the next text
                out[ends - j] = -np.inf
            best = np.maximum.reduceat(out, starts, axis=0)
            pooled.append(best)
            if places:
                where.append(np.stack([[s + out[s:e, f].argmax() for f in range(self.filters)] for s, e in zip(starts, ends, strict=True)]))
        return np.maximum(np.concatenate(pooled, 1), 0), where, ids

    def logits(self, column) -> np.ndarray:
        return self._logits(*features(column, self.bits))

    def _logits(self, buckets, first) -> np.ndarray:
        return (self._pooled(buckets, first)[0] @ self.v + self.c).astype(np.float64)

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 6, batch: int = 32, rate: float = 0.05) -> None:
        """Adagrad on the logistic loss; the rarer label weighs more, up to 4 times."""
        if not len(texts) or labels.min() == labels.max():
            return
        r = np.random.default_rng(self.seed + 1)
        weight = np.where(labels == 1, min(4.0, max(1.0, (labels == 0).sum() / (labels == 1).sum())), 1.0)
        state = {"e": np.full(len(self.e), 1e-6, np.float32), "k": [np.full(k.shape, 1e-6, np.float32) for k in self.k], "b": [np.full(b.shape, 1e-6, np.float32) for b in self.b], "v": np.full(self.v.shape, 1e-6, np.float32), "c": np.full(1, 1e-6, np.float32)}

        def step(value, seen, gradient, by=rate):
            seen += gradient**2
            value -= by * gradient / np.sqrt(seen)

        for epoch in range(epochs):
            for part in np.array_split(r.permutation(len(texts)), max(1, len(texts) // batch)):
                buckets = np.concatenate([texts[i] for i in part])
                first = np.concatenate([[0], np.cumsum([len(texts[i]) for i in part])])
                pooled, where, ids = self._pooled(buckets, first, True)
                p = 1 / (1 + np.exp(-np.clip(pooled @ self.v + self.c, -30, 30)))
                d = ((p - labels[part]) * weight[part]).astype(np.float32) / len(part)
                back = d[:, None] * self.v * (pooled > 0)
                rows, sums = [], []
                for at, w in enumerate(WIDTHS):
                    g = back[:, at * self.filters : (at + 1) * self.filters]
                    gk = np.zeros_like(self.k[at])
                    for j in range(w):
                        x = self.e[ids[where[at] + j]].sum(2)  # texts, filters, size
                        gk[j] = np.einsum("tf,tfs->sf", g, x)
                        rows.append(ids[where[at] + j].reshape(-1, FEATURES))
                        sums.append((g[:, :, None] * self.k[at][j].T[None]).reshape(-1, self.size))
                    step(self.k[at], state["k"][at], gk, rate / 2)
                    step(self.b[at], state["b"][at], g.sum(0), rate / 2)
                step(self.v, state["v"], pooled.T @ d)
                step(self.c, state["c"], d.sum(keepdims=True))
                flat, grads = np.concatenate(rows), np.concatenate(sums)
                used, place = np.unique(flat, return_inverse=True)
                total = np.zeros((len(used), self.size), np.float32)
                place = place.reshape(-1, FEATURES)
                for q in range(FEATURES):
                    np.add.at(total, place[:, q], grads)
                state["e"][used] += (total**2).mean(1)
                self.e[used] -= rate * total / np.sqrt(state["e"][used])[:, None]
                self.e[0] = 0

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, names: list[str]) -> None:
        """The logit with the fewest weighted errors; a language of fewer than 15 toxic texts takes the threshold of all."""

        def threshold(x, y):
            if y.min(initial=1) == y.max(initial=0) or not len(y):
                return 0.0
            order = np.argsort(x, kind="stable")
            x, y = x[order], y[order]
            missed = np.concatenate([[0], np.cumsum(y)])
            wrong = np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
            errors = missed + wrong
            best = np.flatnonzero(errors == errors.min())
            at = best[len(best) // 2]
            low, high = (x[at - 1] if at else x[0] - 2), (x[at] if at < len(x) else x[-1] + 2)
            return float((low + high) / 2)

        self.default = threshold(logits, labels)
        for name in sorted(set(names)):
            own = np.array([n == name for n in names])
            if labels[own].sum() >= 15 and (1 - labels[own]).sum() >= 15:
                self.thresholds[name] = threshold(logits[own], labels[own])

    def scores(self, column) -> np.ndarray:
        """0 to 1 for each row; 0.5 is its language's threshold. Null and empty texts get the score of no words."""
        logits = self.logits(column)
        shift = np.full(len(logits), self.default)
        if self.languages is not None and self.thresholds:
            best, _ = self.languages.predict(column)
            for at, name in enumerate(self.languages.languages):
                if name in self.thresholds:
                    shift[best == at] = self.thresholds[name]
        return 1 / (1 + np.exp(-np.clip(logits - shift, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, most_bytes: int = 64 << 20, bits: int = 16) -> ToxicityModel:
    """Trains on whole labelled documents that are not held out.

    Of all labelled rows, a bounded sample is chosen by a hash of doc_id: about sample rows, and fewer where their texts
    would have more than most_bytes together. A fifth of it sets the thresholds and trains nothing. Null labels and documents
    without a label teach nothing; null, empty and blank texts are texts without words.
    """
    known = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out())
    slot = F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1 << 20))
    share = min(1.0, sample / max(known.count(), 1))
    # the sample bounds what is broadcast: ids and labels
    chosen = lambda share: docs.select("doc_id", "text").join(F.broadcast(known.where(slot < int((1 << 20) * share))), "doc_id").select("doc_id", "toxic", "text")
    size = chosen(share).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    share *= min(1.0, most_bytes / max(size, 1))

    def read(batches):
        for batch in pieces(batches):
            buckets, first = features(batch.column(2), bits)
            wide = FEATURES * buckets.itemsize
            buckets = buckets.tobytes()
            out = [buckets[wide * a : wide * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "toxic", "words"])

    model = ToxicityModel(bits=bits)
    got = arrow_map(chosen(share), read, "doc_id long, toxic int, words binary").toArrow().sort_by("doc_id")
    ids = got.column("doc_id").to_numpy()
    y = got.column("toxic").to_numpy().astype(np.int64)
    narrow = np.uint16 if bits <= 16 else np.uint32
    words = [np.frombuffer(x.as_buffer(), narrow).reshape(-1, FEATURES) for x in got.column("words")]
    aside = ids % 5 == 2 if len(ids) >= 200 else np.zeros(len(ids), bool)
    model.train([w for w, a in zip(words, aside, strict=True) if not a], y[~aside])
    if len(ids):
        check = aside if aside.any() else ~aside
        logits = np.array([model._logits(w, np.array([0, len(w)]))[0] for w, a in zip(words, check, strict=True) if a])
        del words, got
        release()
        model.languages = langid.fit(docs)
        tried = docs.sparkSession.createDataFrame([(int(i),) for i in ids[check]], "doc_id long").distinct()
        asked = docs.select("doc_id", "text").join(F.broadcast(tried), "doc_id")
        said = {r.doc_id: r.lang_pred for r in langid.identify(asked, model.languages).select("doc_id", "lang_pred").collect()}
        model.calibrate(logits, y[check], [said.get(int(i), "und") for i in ids[check]])
    release()
    return model


def score(docs: DataFrame, model: ToxicityModel, name: str = "toxicity") -> DataFrame:
    """docs with the score of every whole text under that name (a column of that name is replaced). An empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != name]
    at = names.index("text")

    def run(batches):
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.scores(batch.column(at)))], [*names, name])

    return arrow_map(docs.select(*names), run, docs.select(*names).withColumn(name, F.lit(0.0)).schema)


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs, all columns as they were, without those that score 0.5 or more."""
    names = docs.columns
    name = fresh(docs, "__toxicity")
    return score(docs, model, name).where(F.col(name) < 0.5).select(*names)
