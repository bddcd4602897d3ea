"""Language-model scoring with a hashed maximum-entropy model.

Words are the leaves of a tree of classes: a class groups words by their endings, so that endings found among the same
neighbours share a class, and within a class words are dealt into groups by their hash. The softmax is factored along the
tree: p(word | before) = p(digit 1 | before) p(digit 2 | before, digit 1) ... p(word | leaf). Every digit is predicted by a
log-linear model over hashed n-gram and skip features of the tokens and classes before it, and only the word within its leaf,
which few frequent words share, by its count. Weights come from distributed gradient updates: each partition follows its own
gradients from shared weights, and what the partitions learned is averaged, row by row of the table. Texts are scored in
sparse numpy batches: per token and digit, four rows of the weight table.
"""

from __future__ import annotations

import gc
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, cut, eights, mix, packed, pieces, Words

FEATURES = 4
DIGIT = 8  # branches of a node
CLASS_DIGITS, WORD_DIGITS = 2, 1  # levels of the tree: those of the class, and those of the word's hash within it
LEVELS = CLASS_DIGITS + WORD_DIGITS
CLASSES, GROUPS = DIGIT**CLASS_DIGITS, DIGIT**WORD_DIGITS
LEAVES = CLASSES * GROUPS
ENDINGS = 2048  # hashed endings of up to 3 bytes; the last is the end token's own
NEIGHBOURS = 128
BATCH = 16384  # positions of one gradient step
_SALT = mix(np.arange(1, FEATURES + 1, dtype=np.uint64))
_END, _START = np.uint64(0x0E4D0E4D0E4D0E4D), np.uint64(0x57A4757A4757A475)
#: Of each level, the number of its first node; nodes are counted level by level.
_FIRST = np.cumsum([0] + [DIGIT**k for k in range(LEVELS)])
_NODE = mix(np.arange(1, _FIRST[-1] + 1, dtype=np.uint64))


class Tokens:
    """Tokens of the rows of an Arrow string column: words, then one end. h: hashes, ending: hashed endings, group: within the class, first: the rows' places."""

    def __init__(self, column) -> None:
        w = Words(column)
        n = len(w.first) - 1
        self.first = w.first + np.arange(n + 1)
        words = np.ones(self.first[-1], bool)
        words[self.first[1:] - 1] = False
        self.h = np.full(self.first[-1], _END, np.uint64)
        self.h[words] = w.hashes()
        self.ending = np.full(self.first[-1], ENDINGS - 1, np.int64)
        stop = w.end - ((w.end > w.start + 1) & np.isin(w.data[w.end - 1], np.frombuffer(b".,;:!?", np.uint8))) if len(w.end) else w.end
        self.ending[words] = (mix(packed(eights(w.data), np.maximum(w.start, stop - 3), stop, 3)) % np.uint64(ENDINGS - 1)).astype(np.int64)
        self.group = (mix(self.h) >> np.uint64(17)).astype(np.int64) % GROUPS
        self.row = np.repeat(np.arange(n), np.diff(self.first))
        self.place = np.arange(self.first[-1]) - self.first[self.row]

    def before(self, values: np.ndarray, k: int, start) -> np.ndarray:
        """For each token the value of the one k places before it in its text."""
        out = np.full(len(values), start, values.dtype)
        out[k:] = values[: len(values) - k]
        out[self.place < k] = start
        return out

    def features(self, classes: np.ndarray) -> np.ndarray:
        """Hashes of each token's features (features by tokens): the word before, the word before that (a skip), a bigram of classes and a skip of classes."""
        w1, w2 = (self.before(self.h, k, _START) for k in (1, 2))
        c = classes[self.ending].astype(np.uint64)
        c1, c2, c3 = (self.before(c, k, np.uint64(len(classes))) for k in (1, 2, 3))
        b = np.uint64(1 << 20)
        raw = (w1, w2, c1 * b + c2, c2 * b + c3 + np.uint64(1 << 50))
        return np.stack([mix(x + _SALT[k]) for k, x in enumerate(raw)])


def rows_of(features: np.ndarray, nodes: np.ndarray, bits: int) -> np.ndarray:
    """Rows of the weight table (features by tokens) for the features at a node of each token."""
    return (((features ^ _NODE[nodes]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def path(leaves: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The node and the digit of each leaf, level by level."""
    return [(_FIRST[k] + leaves // DIGIT ** (LEVELS - k), leaves // DIGIT ** (LEVELS - 1 - k) % DIGIT) for k in range(LEVELS)]


def _classes(neighbours: np.ndarray, levels: int) -> np.ndarray:
    """A class from 0 to 2**levels - 1 for each ending: the set of endings is halved by weight, again and again, along its widest direction."""
    weight = neighbours.sum(1).astype(float)
    x = np.sqrt((neighbours + 1e-9) / np.maximum(weight, 1)[:, None])
    out = np.zeros(len(neighbours), np.int64)
    for _ in range(levels):
        low = np.zeros(len(out), bool)
        for c in np.unique(out):
            own = np.flatnonzero(out == c)
            w = weight[own] + 1e-6
            centred = x[own] - np.average(x[own], 0, w)
            _, axes = np.linalg.eigh((centred * w[:, None]).T @ centred)
            along = centred @ axes[:, -1]
            along = along * (1 if along[np.abs(along).argmax()] >= 0 else -1)
            order = np.argsort(along, kind="stable")
            total = np.cumsum(w[order])
            low[own[order[total - w[order] / 2 < total[-1] / 2]]] = True
        out = 2 * out + ~low
    return out


@dataclass
class MaxEnt:
    """classes: of each ending. bias: of each node's digits. weights, seen: the table and its squared gradients. size, kinds: training tokens and types of each leaf. top, top_count: the commonest types."""

    classes: np.ndarray
    bits: int
    bias: np.ndarray
    weights: np.ndarray
    seen: np.ndarray
    size: np.ndarray
    kinds: np.ndarray
    top: np.ndarray
    top_count: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.size.sum())

    @property
    def unknown(self) -> float:
        """The probability of the one type that stands for all that training doesn't have."""
        return 0.5 / (self.tokens + 0.5 * (int(self.kinds.sum()) + 1))

    def leaves(self, t: Tokens) -> np.ndarray:
        return self.classes[t.ending] * GROUPS + t.group

    def logits(self, rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Of all digits of a node of each token, less the largest (digits by tokens)."""
        out = self.bias.take(nodes, 0)
        for own in rows:
            out += self.weights.take(own, 0)
        out = np.ascontiguousarray(out.T)
        out -= out.max(0)
        return out

    def terms(self, t: Tokens, at_once: int = 4096) -> np.ndarray:
        """For each token, log10 of (1 - unknown) p(leaf | before) / (size + kinds / 2 of the leaf), to be added to log10(count + 0.5)."""
        leaves, features = self.leaves(t), t.features(self.classes)
        out = np.zeros(len(leaves))
        for a in range(0, len(leaves), at_once):
            part = slice(a, a + at_once)
            for nodes, digits in path(leaves[part]):
                x = self.logits(rows_of(features[:, part], nodes, self.bits), nodes)
                out[part] += x[digits, np.arange(len(digits))]
                out[part] -= np.log(np.exp(x, out=x).sum(0))
        return (out + np.log1p(-self.unknown) - np.log(np.maximum(self.size + 0.5 * self.kinds, 0.5))[leaves]) / np.log(10)

    def step(self, features: np.ndarray, leaves: np.ndarray, used: np.ndarray, rate: float) -> None:
        """One Adagrad step of the log loss on a batch, feature by feature, on the rows of the table that it uses."""
        rows, errors, b = [], [], len(leaves)
        for nodes, digits in path(leaves):
            own = rows_of(features, nodes, self.bits)
            p = np.exp(self.logits(own, nodes))
            p /= p.sum(0)
            p[digits, np.arange(b)] -= 1
            rows.append(own)
            errors.append(p.T)
        rows, errors = np.stack(rows, 1).reshape(FEATURES, -1), np.concatenate(errors)
        shift = (LEVELS * BATCH - 1).bit_length()
        place, mean = np.arange(LEVELS * b), np.full(DIGIT, 1 / DIGIT, np.float32)
        whole = self.weights.view(f"V{4 * DIGIT}")[:, 0]  # rows as single values, which are stored faster
        for own in rows:
            both = np.sort(own << shift | place)  # faster than argsort
            own, order = both >> shift, both & ((1 << shift) - 1)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            at, n = own[starts], np.diff(np.append(starts, len(order)))
            g = errors.take(order[starts], 0)
            many = n > 1  # most rows are used once in a batch
            if many.any():
                size = n[many]
                g[many] = np.add.reduceat(errors.take(order[np.repeat(many, n)], 0), np.cumsum(size) - size, axis=0)
            used[at] += n.astype(used.dtype)
            g *= (1 / np.sqrt(n.astype(np.float32)))[:, None]
            seen = self.seen[at] + (g * g) @ mean
            self.seen[at] = seen
            g *= (np.float32(rate) / np.sqrt(seen + np.float32(1e-3)))[:, None]
            whole[at] = (self.weights.take(at, 0) - g).view(whole.dtype)[:, 0]


def _counted(docs: DataFrame) -> DataFrame:
    """Rows (kind, h, e, n). Kind 0: a type of the training tokens, its ending and group, its count. Kind 1: how often an ending has a hashed neighbour (h: the cell)."""

    def count(batches):
        kept, counts, ends, parts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
        near = np.zeros(ENDINGS * NEIGHBOURS, np.int64)

        def out(kind, h, e, n):
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(e.astype(np.int32)), pa.array(n)], ["kind", "h", "e", "n"])

        def merge(parts):
            h, e, n = (np.concatenate(x) for x in zip((kept, ends, counts), *parts, strict=True))
            u, first, place = np.unique(h, return_index=True, return_inverse=True)
            return u, e[first], np.bincount(place, n, len(u)).astype(np.int64)

        for batch in pieces(batches):
            t = Tokens(batch.column(0))
            u, first, n = np.unique(t.h, return_index=True, return_counts=True)
            parts.append((u, t.ending[first] * GROUPS + t.group[first], n))
            same = t.row[1:] == t.row[:-1]
            a, b = t.ending[:-1][same], t.ending[1:][same]
            for x, y in ((a, b), (b, a)):
                near += np.bincount(x * NEIGHBOURS + y % NEIGHBOURS, minlength=len(near))
            if sum(len(p[0]) for p in parts) > 1 << 18:
                kept, ends, counts = merge(parts)
                parts = []
                if len(kept) > 1 << 19:
                    yield out(0, kept, ends, counts)
                    kept, counts, ends = kept[:0], counts[:0], ends[:0]
        if parts:
            kept, ends, counts = merge(parts)
        yield out(0, kept, ends, counts)
        full = np.flatnonzero(near)
        yield out(1, full, np.zeros(len(full), np.int64), near[full])

    found = arrow_map(docs.select("text"), count, "kind int, h long, e int, n long")
    return found.groupBy("kind", "h").agg(F.min("e").alias("e"), F.sum("n").alias("n"))


def _round(docs: DataFrame, model: MaxEnt, rate: float, chunk: int = 1024) -> None:
    """Every partition follows the gradients of its own texts, BATCH positions at a time; changes are averaged by use, row by row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    wide = DIGIT + 1  # weights and squared gradients

    def learn(batches):
        start = shared.value
        mine = MaxEnt(start.classes, start.bits, start.bias, start.weights.copy(), start.seen.copy(), start.size, start.kinds, start.top[:0], start.top_count[:0])
        used = np.zeros(len(mine.weights), np.int32)
        features, leaves = np.zeros((FEATURES, 0), np.uint64), np.zeros(0, np.int64)
        for batch in pieces(batches):
            t = Tokens(batch.column(0))
            # what is left of one batch begins the next step, so steps don't depend on how rows come in batches
            features, leaves = np.concatenate([features, t.features(mine.classes)], 1), np.concatenate([leaves, mine.leaves(t)])
            whole = len(leaves) // BATCH * BATCH
            for a in range(0, whole, BATCH):
                mine.step(features[:, a : a + BATCH], leaves[a : a + BATCH], used, rate)
            features, leaves = features[:, whole:], leaves[whole:]
        if len(leaves):
            mine.step(features, leaves, used, rate)
        for c in range(0, len(used), chunk):
            own = slice(c, c + chunk)
            if used[own].any():
                change = np.concatenate([mine.weights[own] - start.weights[own], (mine.seen[own] - start.seen[own])[:, None]], 1) * used[own, None]
                yield pa.RecordBatch.from_arrays([pa.array([c // chunk], pa.int32()), pa.array([used[own].tobytes()], pa.binary()), pa.array([change.astype(np.float32).tobytes()], pa.binary())], ["c", "used", "change"])

    def add(batches):
        """One sum per chunk within a task, so that what leaves a task is bounded by the table's size."""
        sums: dict[int, list] = {}
        for batch in batches:
            for c, u, x in zip(*(batch.column(i) for i in range(3)), strict=True):
                u, x = np.frombuffer(u.as_buffer(), np.int32), np.frombuffer(x.as_buffer(), np.float32)
                if (k := c.as_py()) in sums:
                    sums[k][0] += u
                    sums[k][1] += x
                else:
                    sums[k] = [u.astype(np.int64), x.copy()]
        for k, (u, x) in sums.items():
            x = x.reshape(-1, wide) / np.maximum(u, 1)[:, None].astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["c", "change"])

    found = arrow_map(docs.select("text"), learn, "c int, used binary, change binary").repartition("c")
    got = arrow_map(found, add, "c int, change binary").toArrow()  # one row per chunk of the table
    for c, x in zip(got.column("c").to_pylist(), got.column("change"), strict=True):
        x = np.frombuffer(x.as_buffer(), np.float32).reshape(-1, wide)
        own = slice(c * chunk, c * chunk + len(x))
        model.weights[own] += x[:, :DIGIT]
        model.seen[own] += x[:, DIGIT]
    shared.destroy()


def fit(docs: DataFrame, bits: int = 18, rounds: int = 3, rate: float = 0.1, top: int = 1 << 18) -> tuple[MaxEnt, DataFrame]:
    """The model, and the table of all types (h, n), which grows with the corpus and stays distributed.

    docs: text of the training documents. Counts, classes and their sizes cover all tokens, and every token gives one
    gradient: a round takes whole documents, one of rounds parts of them by a hash of their text. The model depends on how
    rows lie in partitions, but not on how they come in batches. Its size is bounded by its parameters: 2**bits rows of
    DIGIT weights, and the top commonest types.
    """
    counted = cut(_counted(docs))
    types = counted.where("kind = 0")
    near = np.zeros(ENDINGS * NEIGHBOURS, np.int64)
    got = counted.where("kind = 1").select("h", "n").toArrow()  # at most ENDINGS * NEIGHBOURS rows
    near[got.column("h").to_numpy()] = got.column("n").to_numpy()
    classes = _classes(near.reshape(ENDINGS, NEIGHBOURS), CLASS_DIGITS * (DIGIT.bit_length() - 1))
    got = types.groupBy("e").agg(F.sum("n").alias("n"), F.count("*").alias("k")).toArrow()  # one row per ending and group
    e = got.column("e").to_numpy()
    leaves = classes[e // GROUPS] * GROUPS + e % GROUPS
    size, kinds = (np.bincount(leaves, got.column(c).to_numpy(), LEAVES).astype(np.int64) for c in ("n", "k"))
    # branches without a type get no probability
    below = [size.reshape(DIGIT ** (k + 1), -1).sum(1).reshape(-1, DIGIT) for k in range(LEVELS)]
    n = np.concatenate(below)
    bias = np.where(n > 0, np.log(np.maximum(n, 1) / np.maximum(n.sum(1, keepdims=True), 1)), -1e4).astype(np.float32)
    common = types.orderBy(F.desc("n"), "h").limit(top).select("h", "n").toArrow()
    h, n = common.column("h").to_numpy().view(np.uint64), common.column("n").to_numpy()
    order = np.argsort(h)
    model = MaxEnt(classes, bits, bias, np.zeros((1 << bits, DIGIT), np.float32), np.zeros(1 << bits, np.float32), size, kinds, h[order], n[order])
    for turn in range(rounds):
        _round(docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == turn), model, rate)
        gc.collect()
        docs.sparkSession.sparkContext._jvm.System.gc()  # else each round's shuffle files stay until the driver happens to collect its garbage
    return model, types.select("h", "n")


def score(docs: DataFrame, model: MaxEnt, types: DataFrame) -> DataFrame:
    """docs (doc_id, held_out, text) as doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens: words, A-Z as a-z, then one end; a null or empty text has the end alone. base_score: sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))). score: the model's log10 probability; both give tokens that training doesn't have
    the same probability, so both sum to 1 over all types. The commonest types' counts are broadcast; the others' are joined.
    Repeated rows give repeated rows; an empty table gives an empty result; without training tokens all are unknown.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    unknown = float(np.log10(model.unknown))
    scale = float(np.log10(model.tokens + 0.5 * (int(model.kinds.sum()) + 1)))

    def run(batches):
        m = shared.value
        number = TaskContext.get().partitionId() << 40
        for batch in pieces(batches):
            t = Tokens(batch.column(2))
            rows = batch.num_rows
            at = np.searchsorted(m.top, t.h).clip(max=max(len(m.top) - 1, 0))
            hit = m.top[at] == t.h if len(m.top) else np.zeros(len(t.h), bool)
            log_count = np.log10(m.top_count[at[hit]] + 0.5) if len(m.top) else np.zeros(0)
            terms = m.terms(t)
            known = np.bincount(t.row[hit], minlength=rows)
            base = np.bincount(t.row[hit], log_count, rows).astype(np.float64)
            model_sum = np.bincount(t.row[hit], log_count + terms[hit], rows).astype(np.float64)
            rare = np.flatnonzero(~hit)
            first = np.searchsorted(t.row[rare], np.arange(rows + 1))
            lists = pa.array(first, pa.int32())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(number, number + rows)), batch.column(0), batch.column(1), pa.array(np.diff(t.first), pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(model_sum),
                pa.ListArray.from_arrays(lists, pa.array(t.h[rare].view(np.int64))), pa.ListArray.from_arrays(lists, pa.array(terms[rare].astype(np.float32)))],
                ["rid", "doc_id", "held_out", "n_tokens", "known", "base", "model", "h", "term"])
            number += rows

    schema = "rid long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, h array<long>, term array<float>"
    told = cut(arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text"), run, schema))
    rare = told.select("rid", F.explode(F.arrays_zip("h", "term")).alias("x")).select("rid", F.col("x.h").alias("h"), F.col("x.term").alias("term"))
    log_count = F.log10(F.col("n") + 0.5)
    rare = rare.join(types, "h").groupBy("rid").agg(F.count("*").alias("k"), F.sum(log_count).alias("b"), F.sum(log_count + F.col("term")).alias("s"))
    out = told.drop("h", "term").join(rare, "rid", "left")
    known = F.col("known") + F.coalesce("k", F.lit(0))
    missing = F.col("n_tokens") - F.col("n_known")
    out = out.withColumn("n_known", known)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_known") * scale + missing * unknown).alias("base_score"),
        (F.col("model") + F.coalesce("s", F.lit(0.0)) + missing * unknown).alias("score"))
