"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

Vectors are dealt into blocks of bounded size; each block of candidates keeps, for every
dimension, its list sorted by component. A query walks down the lists of a block, from the
top where its own component is positive and from the bottom where it is negative, scores
what it meets, and stops once the bound on all it has not met, the sum of its components
times the lists' values at the present depth, is below the kth score so far. Depth doubles
with each step. The best of each block are ranked together by query.

Query blocks are sent to the candidate blocks, as queries are far fewer: the work is that of
each query against all rows, in blocks, and what one task holds is one block of either kind.

Defined results: vectors that are null, empty, or hold a null or a non-finite component (before or after scaling) take
no part; vectors of different lengths are not compared; components and scores of any other size are exact, and a score beyond 64 bits is returned as the
nearest long; ties go to the smaller id; candidates that repeat an id and a vector are ranked each, a query that does is answered once; rows with the query's own id
are no candidates for it; a null id takes no part; an empty table gives an empty result;
further columns are not read. Rows are dealt by what they hold, repeats as one row with a number, so a task that runs again gets the same.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm import vectors
from noticeflow.llm.common import small_batches

CANDIDATES, QUERIES = 4096, 1024  # rows in a block, about
#: Query blocks whose kth scores a task carries from one candidate block to the next; without them it searches on as if it met them first.
MAX_FLOORS = 256
#: Tasks of the search; a task gets whole candidate blocks.
MAX_TASKS = 10_000


exact_type = vectors.exact_type


class Lists:
    """A block of candidates with its sorted list for every dimension."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data  # in order of id, so that ties are settled by place
        if data.dtype != object:
            self.order = np.argsort(self.data, axis=0, kind="stable")
            self.values = np.take_along_axis(self.data, self.order, axis=0)
        self.met = 0  # rows scored, for all queries

    def best(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf, first: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best, best first, rows with the id ``own`` left out."""
        places, scores = self.places(query, own, k, floor, first)
        return self.ids[places], scores

    def places(self, query: np.ndarray, own: int, k: int, floor: float = -np.inf, first: int = 16) -> tuple[np.ndarray, np.ndarray]:
        """(places in the block, scores) of the k best.

        ``floor`` is a score that k rows of other blocks are known to reach; what is below it may be left out.
        """
        m = len(self.ids)
        if self.data.dtype == object:  # numbers too large for any other type: all are scored
            self.met += m
            scores = self.data @ query
            order = sorted(np.flatnonzero(self.ids != own).tolist(), key=lambda i: (-scores[i], i))[:k]
            return np.array(order, np.int64), scores[order]
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        met = np.zeros(m, bool)
        scores = np.empty(0, query.dtype)
        places = np.empty(0, np.int64)
        depth = min(first, m)
        if not len(up) + len(down):
            depth = m
        elif m and self.values[-1, up] @ query[up] + self.values[0, down] @ query[down] < floor:
            return places, scores  # not even the heads of all lists together reach what others have
        while True:
            before = met.copy()
            if depth >= m:
                met[:] = True
            else:
                met[self.order[m - depth :, up].ravel()] = True
                met[self.order[:depth, down].ravel()] = True
            new = np.flatnonzero(met & ~before)
            new = new[self.ids[new] != own]
            places, scores = np.concatenate([places, new]), np.concatenate([scores, self.data[new] @ query])
            if len(places) > k:  # keep the k best; places are in order of id
                least = -np.partition(-scores, k - 1)[k - 1]
                some = np.flatnonzero(scores >= least)
                some = some[np.lexsort((places[some], -scores[some]))[:k]]
                places, scores = places[some], scores[some]
            if depth >= m:
                break
            bound = self.values[m - depth, up] @ query[up] + self.values[depth - 1, down] @ query[down]
            if bound < floor or (len(places) >= k and bound < scores.min()):  # what is unseen can't tie either
                break
            depth = min(m, depth * 2)
        self.met += int(met.sum())
        rank = np.lexsort((places, -scores))
        return places[rank], scores[rank]


def _search(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    at, lists = None, None
    floors: dict[tuple, np.ndarray] = {}  # of the query blocks met last: each query's kth score so far
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            q_ids, ids, times = (np.frombuffer(b, np.int64) for b in (r.q_ids, r.ids, r.tags))
            queries, data = vectors.matrix(r.q_data, r.dim), vectors.matrix(r.data, r.dim)
            kind = vectors.exact_type(queries, data)
            if at != (r.dim, r.wide, r.block, kind):
                lists, at = Lists(ids, vectors.converted(data, kind)), (r.dim, r.wide, r.block, kind)
            floor = floors.pop((r.dim, r.q_wide, r.q_block), np.full(len(q_ids), -np.inf))
            found = [lists.places(q, own, k, f) for q, own, f in zip(vectors.converted(queries, kind), q_ids, floor, strict=True)]
            if kind is not object:  # a floor is a double, and may be a little less than the score
                reached = [np.nextafter(float(s[k - 1]), -np.inf) if len(s) >= k else -np.inf for _, s in found]
                floor = np.maximum(floor, np.array(reached, float))
            floors[r.dim, r.q_wide, r.q_block] = floor
            if len(floors) > MAX_FLOORS:
                floors.pop(next(iter(floors)))
            sizes = [len(p) for p, _ in found]
            places = np.concatenate([p for p, _ in found] or [np.empty(0, np.int64)]).astype(np.int64)
            scores = [int(s) for _, some in found for s in some]
            yield pd.DataFrame({
                "query_id": np.repeat(q_ids, sizes), "query_no": np.repeat(np.arange(len(q_ids)), sizes) + (r.q_block << 32) + (r.q_wide << 31),
                "vec_id": ids[places], "times": times[places], "key": [vectors.order_key(s) for s in scores], "score": vectors.as_long(np.array(scores, object)),
            })


def search(
    candidates: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each row of ``queries`` among ``candidates``."""
    small_batches(candidates.sparkSession)

    def rows(df: DataFrame) -> DataFrame:
        """Different rows; tag says how often each is there."""
        v = F.col(vector)
        fine = df.where(vectors.sound(v) & F.col(vec_id).isNotNull()).select(
            F.col(vec_id).cast("long").alias("id"), vectors.whole(v, scale).alias("v"), F.size(v).alias("dim")
        ).where(vectors.sound(F.col("v")))
        return fine.groupBy("id", "v", "dim").agg(F.count("*").alias("tag"))

    n_candidates, n_queries = candidates.count(), queries.count()
    n_blocks = max(1, -(-n_candidates // CANDIDATES))
    asked = vectors.blocks(rows(queries), n_queries, QUERIES)
    asked = asked.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("wide", "block", "ids", "data")])
    sent = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    n_tasks = min(n_blocks, MAX_TASKS)
    lists = vectors.blocks(rows(candidates), n_candidates, CANDIDATES)
    pairs = lists.repartition(n_tasks, "dim", "block").join(sent.repartition(n_tasks, "dim", "block"), ["dim", "block"])
    found = pairs.mapInPandas(partial(_search, k=k), "query_id long, query_no long, vec_id long, times long, key binary, score long")
    order = Window.partitionBy("query_id", "query_no").orderBy(F.desc("key"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    return (
        each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
