"""N-gram Jaccard join: components of documents whose sets of word shingles overlap enough, without comparing all pairs.

Method (token-group matrix): documents with equal sets count once. Every document indexes a prefix of its set in one
global order of shingles, so that two linked documents share an indexed shingle. Documents are first tied to one leader
per shingle (linear in the index); what is tied becomes a group. A group's row of the matrix is the union of its
members' indexed shingles. A document meets another group only where it shares a shingle with that row; the overlap
bound closes most groups, and only the members of those that qualify are compared, exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import arrow_map, cut, forget, fresh, mix, pieces, Words

_STEPS = mix(np.arange(101, 165, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(column, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each row, ascending as unsigned numbers, and the n + 1 offsets of the rows.

    A row with fewer words has its whole sequence as its one shingle; a row without words has none.
    """
    w = Words(column)
    h, rows = w.hashes(), w.rows()
    n, count = len(h), np.diff(w.first)
    parts, owners = [], []
    if n >= words:
        same = rows[: n - words + 1] == rows[words - 1 :]
        total = np.zeros(n - words + 1, np.uint64)
        for j in range(words):
            total += h[j : n - words + 1 + j] * _STEPS[j]
        parts.append(mix(total[same]))
        owners.append(rows[: n - words + 1][same])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for j in range(words - 1):
            has = count[short] > j
            total[has] += h[w.first[:-1][short[has]] + j] * _STEPS[j]
        parts.append(mix(total + count[short].astype(np.uint64) * _STEPS[words]))
        owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(count) + 1, np.int64)
    values, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[keep], owner[keep]
    return values, np.searchsorted(owner, np.arange(len(count) + 1))


def _required(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap that a set of n needs with any set it links to: ceil(percent * n / 100)."""
    return -(-percent * n // 100)


def frequent(docs: DataFrame, words: int, share: int, most: int = 1 << 20) -> np.ndarray:
    """Shingles in at least one of share documents or so, rarest first: the most frequent `most` of them.

    Every document counts. A task reports shingles that it meets in one of 2 * share of its own documents, twice at least.
    """

    def heavy(batches):
        parts, docs_seen, waiting = [], 0, 0
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in pieces(batches):
            v, _ = shingle_sets(batch.column(0), words)
            docs_seen += batch.num_rows
            parts.append(v)
            waiting += len(v)
            if waiting > 1 << 17:
                values, counts = _merge(values, counts, parts)
                parts, waiting = [], 0
                if len(values) > 1 << 19:  # as in lossy counting, what is rare so far may go
                    keep = counts > 1 + docs_seen // (4 * share)
                    values, counts = values[keep], counts[keep]
        values, counts = _merge(values, counts, parts)
        keep = counts >= max(2, docs_seen // (2 * share))
        table = pa.table({"s": values[keep].view(np.int64), "n": counts[keep]})
        yield from table.to_batches(max_chunksize=50_000)

    found = arrow_map(docs.select("text"), heavy, "s long, n long").groupBy("s").agg(F.sum("n").alias("n"))
    total = docs.count()
    # the order may be any; a parameter bounds what is sent around
    rows = found.where(F.col("n") >= max(3, total // (2 * share))).orderBy(F.desc("n"), "s").limit(most).toArrow()
    s, n = rows.column("s").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    return s[np.lexsort((s, n))]


def _merge(values, counts, parts):
    u, c = np.unique(np.concatenate(parts), return_counts=True) if parts else (values[:0], counts[:0])
    both = np.concatenate([values, u])
    out, place = np.unique(both, return_inverse=True)
    return out, np.bincount(place, np.concatenate([counts, c]), len(out)).astype(np.int64)


def _signatures(hot, words: int, percent: int):
    hot_sorted, hot_rank = np.sort(hot.value), np.argsort(hot.value)

    def rank(values):
        """0 for most shingles, from 1 up to the most frequent."""
        out = np.zeros(len(values), np.int64)
        if len(hot_sorted):
            at = np.searchsorted(hot_sorted, values).clip(max=len(hot_sorted) - 1)
            hit = hot_sorted[at] == values
            out[hit] = hot_rank[at[hit]] + 1
        return out

    def run(batches):
        for batch in pieces(batches):
            values, first = shingle_sets(batch.column(1), words)
            n = np.diff(first)
            owner = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((values, rank(values), owner))
            length = np.where(n > 0, n - _required(n, percent) + 1, 0)
            place = np.arange(len(values)) - first[owner]
            kept = order[place < length[owner]]
            one = np.add.reduceat(mix(values), first[:-1].clip(max=max(len(values) - 1, 0))) if len(values) else np.zeros(len(n), np.uint64)
            two = np.add.reduceat(mix(values ^ np.uint64(0x5851F42D4C957F2D)), first[:-1].clip(max=max(len(values) - 1, 0))) if len(values) else one
            offsets = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
            prefix = pa.ListArray.from_arrays(offsets, pa.array(values[kept].view(np.int64)))
            ids = batch.column(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), prefix], ["doc_id", "n", "d1", "d2", "prefix"])

    return run


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap that has a bit for the hash of each id, and few others. Its size is bounded by 2**27 bits; beyond, it only lets more through."""
    count = ids.count()
    bits = min(27, max(16, (16 * count).bit_length()))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits)) + 1  # these functions count from 1
    rows = ids.groupBy(F.bitmap_bucket_number(slot).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("b"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.collect():  # one row of 4 KB per 32768 bits
        at = (r.k - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(r.b, np.uint8)[: len(out) - at]
    return out


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """doc_id and set of just these ids, made again from the texts. All texts are read, but a bitmap of ids spares their shuffle."""
    ids = cut(ids.distinct())
    marks = docs.sparkSession.sparkContext.broadcast(_marks(ids))

    def run(batches):
        seen = marks.value
        for batch in pieces(batches, text="text"):
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array(seen[slot >> 3] >> (slot & 7).astype(np.uint8) & 1 == 1))
            if batch.num_rows:
                values, first = shingle_sets(batch.column(1), words)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values.view(np.int64)))], ["doc_id", "set"])

    slot = F.pmod(F.xxhash64("doc_id"), F.lit(8 * len(marks.value)))
    out = cut(arrow_map(docs.select("doc_id", "text", slot.alias("slot")), run, "doc_id long, set array<long>").join(ids, "doc_id", "left_semi"))
    marks.destroy()
    forget(ids)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b), those whose sets overlap enough."""
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _sizes_fit(n, m, percent: int):
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) if not isinstance(n, str) else _sizes_fit(F.col(n), F.col(m), percent)


def _bound(c, n, m, percent: int):
    """False where sets of sizes n and m that share c indexed shingles cannot link.

    What is not indexed of a set of n is less than percent * n / 100; the set whose index ends first shares nothing
    before that end but what both index.
    """
    rest = F.greatest(F.ceil(percent * n / 100) - 1, F.ceil(percent * m / 100) - 1)
    return (c + F.least(rest, n, m)) * (100 + percent) >= percent * (n + m)


def similar(docs: DataFrame, words: int = 5, percent: int = 80, share: int = 16000, rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, n_shingles (set size) and component_id, the smallest doc_id reachable by links.

    docs: any columns with doc_id (whole numbers, distinct) and text. Two documents link when 100 * (shingles in both)
    >= percent * (shingles in either). Null, empty and blank texts have an empty set and link with nothing; equal texts
    with words link; an empty table gives an empty result; rows with a null doc_id are dropped; repeated rows give repeated
    results. Other columns, whatever their names, are ignored. share and rounds change the work, never the result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    hot = spark.sparkContext.broadcast(frequent(docs, words, share))
    sig = cut(arrow_map(docs, _signatures(hot, words, percent), "doc_id long, n long, d1 long, d2 long, prefix array<long>"))
    hot.destroy()
    reps = sig.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    one_each = sig.where("n > 0").join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    posts = one_each.select("doc_id", "n", F.explode("prefix").alias("s"))
    shared = posts.groupBy("s").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("s")
    posts = cut(posts.join(shared, "s"))

    groups = None
    for k in range(rounds):
        now = posts.withColumn("g", F.col("doc_id")) if groups is None else _labelled(posts, groups)
        pick = F.min(F.struct(F.xxhash64("doc_id", F.lit(k)).alias("h"), "doc_id", "n", "g")) if k else F.min(F.struct("doc_id", "n", "g"))
        leaders = now.groupBy("s").agg(pick.alias("p")).select("s", F.col("p.doc_id").alias("b"), F.col("p.n").alias("m"), F.col("p.g").alias("h"))
        pairs = now.join(leaders, "s").where("g <> h").where(_sizes_fit("n", "m", percent)).groupBy(F.col("doc_id").alias("a"), "b").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("m").alias("m"))
        pairs = cut(pairs.where(_bound(F.col("c"), F.col("n"), F.col("m"), percent)).select("a", "b"))
        sets = _sets(docs, _ends(pairs), words)
        found = cut(_verified(pairs, sets, percent))
        forget(sets, pairs)
        groups = _joined(groups, found)

    reach = math.ceil(math.log(100 / percent) / math.log(1.1)) + 1  # bands that sets which may link lie apart at most
    # the rest, exactly: a document against each other group of like size that shares an indexed shingle with it
    now = _labelled(posts, groups).withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.1))).cast("long"))
    whole = groups.groupBy(F.col("component").alias("g")).agg(F.count("*").alias("whole"))
    now = cut(now.join(whole, "g", "left").fillna(1, ["whole"]))
    members = now.select("g", "whole", "band", "doc_id", "n").distinct()
    matrix = now.select("s", "g", "whole", "band").distinct()
    extent = members.groupBy("g", "band").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    asks = now.select("s", "doc_id", "n", F.col("g").alias("own"), F.col("whole").alias("own_whole"), F.col("band").alias("own_band"))
    # of two groups the smaller one asks
    met = asks.join(matrix, "s").where("struct(own_whole, own) < struct(whole, g)").where(F.abs(F.col("band") - F.col("own_band")) <= reach)
    met = met.groupBy("doc_id", "n", "g", "whole", "band").agg(F.count("*").alias("c")).join(extent, ["g", "band"])
    met = met.where((100 * F.col("hi") >= percent * F.col("n")) & (percent * F.col("lo") <= 100 * F.col("n")))
    least = F.greatest(F.col("lo"), F.ceil(percent * F.col("n") / 100))
    enough = lambda c: c * (100 + percent) >= percent * (F.col("n") + least)
    rest = F.greatest(F.ceil(percent * F.col("n") / 100), F.ceil(percent * F.col("hi") / 100)) - 1
    met = cut(met.where(enough(F.col("c") + F.least(rest, "n"))).select("doc_id", "n", "g", "whole", "band", "lo"))
    # a group of several opens only if the union of its members' whole sets has enough of the document
    many = met.where("whole > 1")
    inside = members.join(met.select("g", "band").distinct(), ["g", "band"], "left_semi")
    sets = _sets(docs, met.select("doc_id").unionByName(inside.select("doc_id")), words)
    union = inside.where("whole > 1").join(sets, "doc_id").select("g", "band", F.explode("set").alias("s")).distinct()
    asked = many.join(sets, "doc_id").select("doc_id", "n", "g", "band", "lo", F.explode("set").alias("s"))
    open_ = asked.join(union, ["g", "band", "s"]).groupBy("doc_id", "n", "g", "band", "lo").agg(F.count("*").alias("c")).where(enough(F.col("c"))).select("doc_id", "n", "g", "band")
    open_ = open_.unionByName(met.where("whole = 1").select("doc_id", "n", "g", "band"))
    pairs = open_.join(members.select("g", "band", F.col("doc_id").alias("b"), F.col("n").alias("m")), ["g", "band"])
    pairs = cut(pairs.where(_sizes_fit("n", "m", percent)).select(F.col("doc_id").alias("a"), "b").distinct())
    found = cut(_verified(pairs, sets, percent))
    forget(sets, pairs, met, now, posts)
    groups = _joined(groups, found)

    classes = reps.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component_id"))
    some = sig.where("n > 0").drop("prefix").join(classes, ["d1", "d2"]).select("doc_id", "n", "component_id")
    return some.unionByName(sig.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _joined(groups: DataFrame | None, links: DataFrame) -> DataFrame:
    """groups (node, component) after further links (a, b), whose table goes: only groups that a link joins are looked at anew."""
    if groups is None:
        out = cut(components(links, "a", "b"))
        forget(links)
        return out
    ends = links
    for end in ("a", "b"):
        named = groups.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        ends = ends.join(named, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    ends = cut(ends.select("ca", "cb").distinct())
    joined = cut(components(ends, "ca", "cb").select(F.col("node").alias("old"), F.col("component").alias("new")))
    moved = groups.join(joined, F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
    # documents that had no group before are their own
    alone = joined.join(groups, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
    out = cut(moved.unionByName(alone))
    forget(links, groups, ends, joined)
    return out


def _labelled(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """posts of shingles that more than one group has, with g, the document's group."""
    g = posts.join(groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("s", "doc_id", "n", F.coalesce("component", "doc_id").alias("g"))
    mixed = g.groupBy("s").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("s")
    return g.join(mixed, "s", "left_semi")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns as they were, with one document of each component: the one with the smallest doc_id.

    Documents without words, and rows without a doc_id, stay.
    """
    name = fresh(docs, "__gone")
    gone = similar(docs, words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == F.col(name), "left_anti")
