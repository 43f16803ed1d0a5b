"""Hard-negative mining: lists of candidates by angular upper bound, one for each cluster of anchors, walked until nothing can follow.

Anchors are put to the nearest of a set of directions, and a cluster's anchors are kept together in packs. For a pack with the
middle direction c whose members lie within an angle f of it, no member u can score higher with a candidate i than
|u| |i| cos(max(0, angle(i, c) - f)). Each block of candidates is sorted by that bound once for a pack; every member walks the
list from its top and stops where the bound on all that follow certifies that nothing of them can be among its results. Candidates are
blocked by the same directions, so that the lists of far blocks end at once.

Three passes over the blocks:

1. each pack with the blocks of its own cluster: a first kth score of each anchor, only a floor for the next pass,
2. each pack with all blocks: the anchor's positives, the first ``n_positives`` rows of its label,
3. each pack with all blocks: for each positive with score p the first ``n_negatives`` rows of other labels
   whose score s has ``low * p <= 100 * s <= high * p``. A walk ends where the bound falls below the least of ``low * p / 100``, or
   below the last kept score where there are as many.

The anchors are sent to the blocks, as they are the smaller side: the work is that of the anchors against all rows, in blocks. A pack goes once to each group
of blocks that it has to meet, and what is sent is exchanged, never broadcast: it grows as anchors times groups, whatever the size of the table of packs.

Defined results: rows without an id or a label, and vectors that are null, empty, or hold a null or a non-finite component (before or after
scaling) take no part; vectors of different lengths are not compared; components and scores of any other size are exact, and a score beyond 64 bits is returned as
the nearest long; ties go to the smaller id; rows that repeat id, label and vector count once; rows with the anchor's own id are no
candidates for it, and anchors that share an id but not a vector or label are mined each. An anchor with a negative best
score has no negatives for it, as no number is both over half and under 0.95 of it. An empty table gives an empty result; further columns are not read.
Labels are whole numbers. The directions are those of up to ``MAX_CLUSTERS`` anchors; they decide on time only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm import vectors
from noticeflow.llm.common import small_batches, written

CANDIDATES, ANCHORS = 4096, 512  # rows of a block and of a pack, about
#: Directions that anchors and candidates are put to, and the most numbers that all of them hold together.
MAX_CLUSTERS, MAX_NUMBERS = 1024, 1 << 20
MAX_TASKS = 10_000
#: Packs whose scores so far a task carries from one block to the next; without them it searches on as if it met them first.
MAX_FLOORS = 64
#: Blocks that get a pack together, at most; a task holds as many at a time. There are fewer where that would leave less than so many groups for each core.
GROUP, GROUPS_PER_CORE = 8, 4
_FOUND = "pack long, place int, part int, anchor_id long, vec_id long, key binary, score long"


class Anchors:
    """A pack of anchors: its axis, its angle, and the members."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, labels: np.ndarray):
        self.ids, self.data, self.labels = ids, data, labels
        self.norms = vectors.lengths(data)
        ways = vectors.directions(data)
        self.axis = vectors.directions(ways.sum(axis=0)[None, :])[0]
        self.angle = float(np.arccos(np.clip(ways @ self.axis, -1, 1)).max(initial=0))


def bounds(data: np.ndarray, anchors: Anchors) -> np.ndarray:
    """For each candidate, what no member's score over its own length exceeds."""
    norms = vectors.lengths(data)
    angles = np.arccos(np.clip(vectors.directions(data) @ anchors.axis, -1, 1))
    # the slack is far above the error of an arc cosine
    return norms * np.cos(np.maximum(0.0, angles - anchors.angle - 1e-6)) + norms * 1e-9


def walk(
    anchors: Anchors, ids: np.ndarray, data: np.ndarray, labels: np.ndarray, bands: list[list[tuple]], same: bool, k: int, first: int = 64, floors: np.ndarray | None = None,
) -> tuple[list, int]:
    """((place, part, candidate's place, score) of what is kept, scores computed).

    ``bands`` has for each member the (least, greatest) scores asked for, a part each; the k highest of each are kept.
    ``same`` asks for the member's label, else for other labels. Candidates are in order of id.
    ``floors``, members by parts, has scores that k candidates of other blocks are known to reach, and gets those that k of this one do: what is below may be left out.
    """
    kind = vectors.exact_type(anchors.data, data)
    rows, members = vectors.converted(data, kind), vectors.converted(anchors.data, kind)
    if kind not in (np.float32, np.float64):
        return _walk_singly(anchors, ids, data, labels, rows, members, bands, same, k, first, kind is object)
    m, n, n_parts = len(ids), len(bands), max(map(len, bands), default=0)
    if floors is None:
        floors = np.full((n, n_parts), -np.inf)
    asked = np.array([p * n_parts + no for p in range(n) for no in range(len(bands[p]))], np.int64)
    near = lambda x: min(max(x, -(2.0**60)), 2.0**60)  # noqa: E731  scores of these types are below 2**53, and a double is too small for some bands
    least, most = np.full(n * n_parts, np.inf), np.full(n * n_parts, -np.inf)
    least[asked], most[asked] = [near(b[0]) for some in bands for b in some], [near(b[1]) for some in bands for b in some]
    floors = floors.reshape(-1)
    least[asked] = np.maximum(least, floors)[asked]
    upper = bounds(data, anchors)
    order = np.argsort(-upper, kind="stable")
    kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)  # part of a member, candidate's place, score
    active = np.unique(asked // max(1, n_parts))
    greatest = most.reshape(n, n_parts).max(axis=1, initial=-np.inf)
    at, step, computed = 0, first, 0
    while at < m and len(active):
        need = least.reshape(n, n_parts).min(axis=1, initial=np.inf)  # one that ties may still win by its id
        active = active[upper[order[at]] * anchors.norms[active] >= need[active]]
        part = order[at : at + step]
        scores = rows[part] @ members[active].T
        computed += scores.size
        i, column = np.nonzero((scores >= need[active].astype(kind)) & (scores <= greatest[active].astype(kind)))
        p, place, s = active[column], part[i], scores[i, column].astype(np.float64)
        fit = np.flatnonzero(((labels[place] == anchors.labels[p]) == same) & (ids[place] != anchors.ids[p]))
        p, place, s = p[fit], place[fit], s[fit]
        met = [kept]
        for no in range(n_parts):
            of = p * n_parts + no
            some = np.flatnonzero((s >= least[of]) & (s <= most[of]))
            met.append((of[some], place[some], s[some]))
        if any(len(x[0]) for x in met[1:]):
            of, place, s = (np.concatenate(x) for x in zip(*met, strict=True))
            best = np.lexsort((place, -s, of))
            of, place, s = of[best], place[best], s[best]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            full = rank == k - 1
            least[of[full]] = s[full]
            kept = of[rank < k], place[rank < k], s[rank < k]
        at, step = at + step, step * 2
    floors[asked] = np.maximum(floors, np.where(np.isfinite(least), least, -np.inf))[asked]
    return [(int(of) // n_parts, int(of) % n_parts, int(i), int(s)) for of, i, s in zip(*kept, strict=True)], computed


def _walk_singly(anchors: Anchors, ids, data, labels, rows, members, bands: list[list[tuple]], same: bool, k: int, first: int, exact: bool) -> tuple[list, int]:
    """The walk in numbers that a double doesn't hold: a member and a part at a time."""
    m = len(ids)
    upper = np.full(m, np.inf) if exact else bounds(data, anchors)
    order = np.argsort(-upper, kind="stable")
    kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    active = np.array([p for p in range(len(anchors.ids)) if bands[p]], np.int64)
    low = {p: min(b[0] for b in bands[p]) for p in active.tolist()}
    at, step, computed = 0, m if exact else first, 0
    while at < m and len(active):
        if not exact:
            ahead = upper[order[at]] * anchors.norms[active]
            active = active[np.array([b >= _least(kept, bands[p], p, k, low[p]) for b, p in zip(ahead, active.tolist(), strict=True)], bool)]
            if not len(active):
                break
        part = order[at : at + step]
        scores = rows[part] @ members[active].T
        computed += scores.size
        for column, p in enumerate(active.tolist()):
            fit = ((labels[part] == anchors.labels[p]) == same) & (ids[part] != anchors.ids[p])
            s = scores[:, column]
            for no, (least, most) in enumerate(bands[p]):
                some = np.flatnonzero(fit & (s >= least) & (s <= most))
                if len(some):
                    before = kept.get((p, no))
                    places, values = part[some], s[some]
                    if before:
                        places, values = np.concatenate([before[0], places]), np.concatenate([before[1], values])
                    best = np.lexsort((places, -values)) if not exact else np.array(sorted(range(len(places)), key=lambda i: (-values[i], places[i])), np.int64)
                    kept[p, no] = places[best[:k]], values[best[:k]]
        at, step = at + step, step * 2
    return [(p, no, int(i), int(s)) for (p, no), (places, values) in kept.items() for i, s in zip(places, values, strict=True)], computed


def _least(kept: dict, bands: list[tuple], p: int, k: int, low: float) -> float:
    """The score that a candidate has to reach to be among a member's results of any part; one that ties may still win by its id."""
    least = np.inf
    for no, band in enumerate(bands):
        have = kept.get((p, no))
        least = min(least, have[1][-1] if have and len(have[1]) >= k else band[0])
    return max(low, least)


def _asked(limits, n: int, role: str, low: int, high: int) -> tuple[list[list[tuple]], dict]:
    """Bands of each member, and the positives that they belong to."""
    if role != "negatives":
        floor = {r["place"]: vectors.from_key(bytes(r["key"])) for r in limits if r["key"] is not None}
        return [[(floor.get(p, -np.inf), np.inf)] for p in range(n)], {}
    bands: list[list[tuple]] = [[] for _ in range(n)]
    parts = {}
    for r in limits:
        score = vectors.from_key(bytes(r["key"]))
        least, most = -(-low * score // 100), high * score // 100
        if least <= most:
            parts[r["place"], len(bands[r["place"]])] = r["part"]
            bands[r["place"]].append((least, most))
    return bands, parts


def _search(batches: Iterator[pd.DataFrame], role: str, k: int, low: int, high: int) -> Iterator[pd.DataFrame]:
    floors: dict[int, np.ndarray] = {}  # of the packs met last: what each member's parts have reached so far
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            anchors = Anchors(np.frombuffer(r.a_ids, np.int64), vectors.matrix(r.a_data, r.dim), np.frombuffer(r.a_tags, np.int64))
            ids, labels = np.frombuffer(r.ids, np.int64), np.frombuffer(r.tags, np.int64)
            bands, parts = _asked(r.limits if r.limits is not None else [], len(anchors.ids), role, low, high)
            floor = floors.pop(r.pack, None)
            if floor is None:
                floor = np.full((len(bands), max(map(len, bands), default=0)), -np.inf)
            floors[r.pack] = floor
            if len(floors) > MAX_FLOORS:
                floors.pop(next(iter(floors)))
            found, _ = walk(anchors, ids, vectors.matrix(r.data, r.dim), labels, bands, role != "negatives", k, floors=floor)
            if found:
                p, no, place, score = zip(*found, strict=True)
                yield pd.DataFrame({
                    "pack": r.pack, "place": np.array(p, np.int32), "part": np.array([parts.get(x, 0) for x in zip(p, no, strict=True)], np.int32),
                    "anchor_id": anchors.ids[list(p)], "vec_id": ids[list(place)], "key": [vectors.order_key(s) for s in score],
                    "score": vectors.as_long(np.array(score, object)),
                })


def _nearest(ways: np.ndarray):
    """A Pandas UDF: the number of the nearest direction; 0 for vectors of another length."""
    @F.pandas_udf("int")
    def near(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), np.int32)
        fits = np.flatnonzero(v.map(len).to_numpy() == ways.shape[1]) if len(v) and ways.size else []
        if len(fits):
            out[fits] = (vectors.directions(np.stack(v.iloc[fits].to_numpy())) @ ways.T).argmax(axis=1)
        return pd.Series(out)

    return near


def _directions(anchors: DataFrame, n_anchors: int) -> np.ndarray:
    """Directions of some anchors of the commonest length, those with the least hashes: a bounded number."""
    common = anchors.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if not common:
        return np.empty((0, 0))
    most = max(1, min(MAX_CLUSTERS, MAX_NUMBERS // common["dim"], -(-n_anchors // ANCHORS)))
    some = anchors.where(F.col("dim") == common["dim"]).groupBy("v").agg(F.first(F.xxhash64("v")).alias("h")).orderBy("h").limit(most).collect()
    return vectors.directions(np.array([r["v"] for r in some], np.float64))


def _packs(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Rows in packs of about ``size`` of one cluster, numbered from 0 on, and their number; a large cluster is cut by a hash."""
    wide = F.exists("v", lambda x: F.abs(x) >= float(1 << 23)).cast("int")
    rows = rows.withColumn("wide", wide)
    counts = rows.groupBy("dim", "wide", "cluster").count().collect()  # a row for each direction, and length of vectors
    plan, start = [], 0
    for r in sorted(counts, key=lambda r: (r["dim"], r["wide"], r["cluster"])):
        parts = -(-r["count"] // size)
        plan.append((r["dim"], r["wide"], r["cluster"], parts, start))
        start += parts
    spark = rows.sparkSession
    plan_of = F.broadcast(spark.createDataFrame(plan, "dim int, wide int, cluster int, parts int, start int"))
    dealt = rows.join(plan_of, ["dim", "wide", "cluster"]).withColumn("block", (F.col("start") + F.pmod(F.xxhash64("id", "v", "tag"), F.col("parts"))).cast("int"))
    schema = vectors.PACKED + ", cluster int"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return vectors.pack(pdf).assign(cluster=pdf["cluster"].iloc[0])

    return written(dealt.select("dim", "wide", "block", "cluster", "id", "v", "tag").groupBy("dim", "wide", "block").applyInPandas(pack, schema), "packs"), start


def _group_size(n_blocks: int, cores: int) -> int:
    return max(1, min(GROUP, n_blocks // (GROUPS_PER_CORE * cores)))


def _meetings(sent: DataFrame, lists: DataFrame, n_tasks: int, own: bool) -> DataFrame:
    """Each pack beside each block of its length of vectors, with ``own`` those of its own cluster alone.

    Only the numbers of groups are broadcast. The join's hint says that neither side may be: Spark would judge the packs by
    the size of their file, and what is sent is that many times over. On its right a sort-merge join holds the rows of a key, here the blocks of a group.
    """
    groups = lists.select("dim", "group", *["cluster"] * own).distinct()
    to = groups.withColumnRenamed("cluster", "own") if own else groups
    sent = sent.join(F.broadcast(to), ["dim", "own"] if own else "dim")
    met = sent.repartition(n_tasks, "dim", "group").hint("merge").join(lists.repartition(n_tasks, "dim", "group"), ["dim", "group"])
    return met.where("own = cluster") if own else met


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("pack", "place", "part").orderBy(F.desc("key"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _limits(best: DataFrame) -> DataFrame:
    """The entries of each pack, a bounded number, in one order: place, part, score."""
    entry = F.struct("place", "part", "key")
    return best.groupBy("pack").agg(F.sort_array(F.collect_list(entry)).alias("limits"))


def mine(
    rows: DataFrame, anchors: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of which ``anchors`` is true.

    ``low`` and ``high`` are the percentages of the positive's score that a negative's lies between.
    """
    spark = rows.sparkSession
    small_batches(spark)
    v = F.col(vector)
    whole = rows.where(vectors.sound(v) & F.col(vec_id).isNotNull() & F.col(label).isNotNull()).select(
        F.col(vec_id).cast("long").alias("id"), vectors.whole(v, scale).alias("v"), F.size(v).alias("dim"), F.col(label).cast("long").alias("tag"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
    ).where(vectors.sound(F.col("v")))
    known = written(whole.groupBy("id", "v", "dim", "tag").agg(F.max("asked").alias("asked")), "vectors")
    asked = known.where("asked")
    ways = _directions(asked, asked.count())
    near = known.withColumn("cluster", _nearest(ways)("v"))
    blocks, n_blocks = _packs(near.drop("asked"), CANDIDATES)
    packs, n_packs = _packs(near.where("asked").drop("asked"), ANCHORS)
    packs = packs.select("dim", F.col("block").cast("long").alias("pack"), F.col("cluster").alias("own"), *[F.col(c).alias(f"a_{c}") for c in ("ids", "data", "tags")])
    size = _group_size(n_blocks, spark.sparkContext.defaultParallelism)
    n_tasks = max(1, min(-(-n_blocks // size), MAX_TASKS))
    lists = blocks.select("dim", F.expr(f"block div {size}").cast("int").alias("group"), "cluster", "ids", "data", "tags")

    def searched(limits: DataFrame | None, role: str, k: int) -> DataFrame:
        if limits is None:
            sent = packs.withColumn("limits", F.lit(None).cast("array<struct<place:int,part:int,key:binary>>"))
        else:
            sent = packs.join(limits.hint("merge"), "pack", "inner" if role == "negatives" else "left")
        return _meetings(sent, lists, n_tasks, own=role == "floors").mapInPandas(partial(_search, role=role, k=k, low=low, high=high), _FOUND)

    floors = _best(searched(None, "floors", n_positives), n_positives).where(F.col("rank") == n_positives)
    positives = written(_best(searched(_limits(floors), "positives", n_positives), n_positives).withColumn("part", F.col("rank")), "positives")
    negatives = _best(searched(_limits(positives), "negatives", n_negatives), n_negatives)
    named = positives.select("pack", "place", "part", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(named.hint("merge"), ["pack", "place", "part"]).select(  # in memory the positives are some eight times their file
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
