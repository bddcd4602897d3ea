"""Exact top-k inner-product search with vector-approximation files.

Vectors lie in blocks. A block holds, beside its exact vectors, an approximation: every dimension's range is cut into 16
quantised cells, which stand for their middles. One product of a query with the middles bounds its scores with all vectors
from both sides, as no value lies farther from its middle than the dimension's largest deviation. Then exact vectors are
read in the order of their bounds, until the kth best score is at least every bound that is left. A query searches one block
first: the kth score found there closes most of all other blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CELLS = 16


class Block:
    """The cells and exact vectors of one block: ids (int64) and vectors (int64, rows by dimensions)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors, self.read = ids, vectors, 0
        low, high = (vectors.min(0), vectors.max(0)) if len(vectors) else (np.zeros(vectors.shape[1]),) * 2
        self.low, self.width = low.astype(float), np.maximum((high - low).astype(float) / CELLS, 1e-9)
        self.cells = np.minimum((vectors - self.low) / self.width, CELLS - 1).astype(np.uint8)
        self.middles = (self.low + (self.cells + 0.5) * self.width).astype(np.float32)
        self.deviation = np.abs(vectors - self.middles.astype(float)).max(0, initial=0)
        # what rounding may add to a product in single precision
        self.rounding = (vectors.shape[1] + 2) * 2.0**-23 * np.abs(self.middles.astype(float)).max(0, initial=0)

    def approximate(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores by the cells' middles (queries by vectors), and how far each query's exact scores may lie from them."""
        return queries.astype(np.float32) @ self.middles.T, np.abs(queries).astype(float) @ (self.deviation + self.rounding) + 1e-3

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray | None = None, at_once: int = 128):
        """Yields (query's place, vec_ids, scores): its k best vectors but its own, by score, then by the smaller vec_id. Also counts reads.

        floors: scores that k vectors elsewhere are known to reach; vectors below may be left out.
        """
        for begin in range(0, len(ids), at_once):
            part = queries[begin : begin + at_once]
            about, error = self.approximate(part)
            for row in range(len(part)):
                scores_near, slack = about[row].astype(float), error[row]
                own = np.flatnonzero(self.ids == ids[begin + row])
                scores_near[own] = -np.inf
                want = min(k, len(self.ids) - len(own))
                if not want:
                    continue
                floor = -np.inf if floors is None else floors[begin + row]
                if not np.isfinite(floor):
                    floor = np.partition(scores_near, len(scores_near) - want)[len(scores_near) - want] - slack  # the kth score is no less
                order = np.flatnonzero(scores_near + slack >= floor)
                order = order[np.argsort(-scores_near[order], kind="stable")]
                seen, scores, step = 0, np.zeros(0, np.int64), max(4 * k, 64)
                while seen < len(order):
                    if seen >= want and np.partition(scores, len(scores) - want)[len(scores) - want] > scores_near[order[seen]] + slack:
                        break
                    take = order[seen : seen + step]
                    scores = np.concatenate([scores, self.vectors[take] @ part[row]])
                    seen += len(take)
                    step *= 2
                self.read += seen
                found = self.ids[order[:seen]]
                best = np.lexsort((found, -scores))[:want]
                best = best[scores[best] >= floor]
                if len(best):
                    yield begin + row, found[best], scores[best]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, block: int = 16384, query_block: int = 2048) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest integer inner products (all, if fewer).

    vectors, queries: vec_id (whole numbers) and v, an array of whole numbers (below 2**24 in size, so that sums stay exact);
    other columns are ignored. Ties go to the smaller vec_id; a query's own vec_id is no candidate of it. Rows with a null id
    or a null v, or with nulls in v, take no part; vectors meet only queries of the same length (an empty one scores 0 with
    empty ones). Repeated vec_ids are separate candidates, and repeated queries get k rows each, with ranks of their own.
    Without vectors or queries the result is empty.

    Vectors and queries are dealt in turn into blocks of bounded size, and each pair of blocks is one row of work; what
    a pair returns is k rows per query at most, so nothing grows with a vector's popularity, and a lost task repeats by
    itself. First each block of queries meets one block of vectors, then all, with the kth scores found in the first.
    """
    whole = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<long>").alias("v"), F.size("v").alias("d")).where("vec_id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    base, asked = whole(vectors), whole(queries)
    n, m = base.count(), asked.count()
    blocks = max(1, math.ceil(n / max(1024, min(block, n // 12 or 1))))
    parts = max(1, math.ceil(m / query_block))

    def dealt(df, count, key):
        def one(table: pa.Table) -> pa.Table:
            ids = table.column("vec_id").to_numpy()
            flat = table.column("v").combine_chunks()
            flat = (pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat).flatten().to_numpy()
            most = int(np.abs(flat).max(initial=0))
            kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
            return pa.table({key: table.column(key)[:1], "d": table.column("d")[:1], f"{key}_ids": [ids.astype("<i8").tobytes()], f"{key}_v": [flat.astype(kind).tobytes()], f"{key}_kind": [kind]})

        dealt_out = df.withColumn(key, F.pmod(F.monotonically_increasing_id(), F.lit(count)).cast("int"))
        return dealt_out.groupBy("d", key).applyInArrow(one, f"{key} int, d int, {key}_ids binary, {key}_v binary, {key}_kind string")

    left = cut(dealt(base, blocks, "b"))
    right = cut(dealt(asked, parts, "q"))

    def read(row, key):
        ids = np.frombuffer(row[f"{key}_ids"], "<i8")
        return ids, np.frombuffer(row[f"{key}_v"], row[f"{key}_kind"]).astype(np.int64).reshape(len(ids), row["d"])

    def first(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        q, asked_for = read(row, "q")
        floors = np.full(len(q), -np.inf)
        for place, _, scores in Block(*read(row, "b")).search(q, asked_for, k):
            if len(scores) == k:
                floors[place] = scores[-1]
        return pa.table({"q": table.column("q")[:1], "d": table.column("d")[:1], "floors": [floors.astype("<f8").tobytes()]})

    def pair(table: pa.Table) -> pa.Table:
        row = table.to_pylist()[0]
        q, asked_for = read(row, "q")
        floors = np.frombuffer(row["floors"], "<f8") if row["floors"] else None
        out = list(Block(*read(row, "b")).search(q, asked_for, k, floors))
        place = np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64) if out else q[:0]
        join = lambda i: np.concatenate([o[i] for o in out]) if out else q[:0]
        fixed = lambda c, kind: pa.array(np.full(len(place), row[c]), kind)
        return pa.table({"q": fixed("q", pa.int32()), "d": fixed("d", pa.int32()), "place": place, "query_id": q[place], "vec_id": join(1), "score": join(2)})

    # a pair of blocks is a group of one row, so that a worker holds one pair at a time
    known = left.join(right.withColumn("b", F.pmod("q", F.lit(blocks))), ["b", "d"]).groupBy("b", "q", "d").applyInArrow(first, "q int, d int, floors binary")
    every = right.join(cut(known), ["q", "d"], "left").withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = left.join(every, ["b", "d"]).groupBy("b", "q", "d").applyInArrow(pair, "q int, d int, place long, query_id long, vec_id long, score long")
    order = Window.partitionBy("q", "d", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
