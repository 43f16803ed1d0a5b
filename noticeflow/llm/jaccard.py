"""N-gram Jaccard join: a size-aware heavy-light join, up to connected components.

A document's set holds the hashes of its distinct five-word shingles. Two documents link when
their sets' Jaccard similarity reaches the threshold; the join finds every link between different sets
that matters for the components, without writing all pairs of a group of copies.

1. Each row's set gets a 128-bit signature; equal sets are one class, and only one document of
   a class goes on. A counting sketch of fixed size, summed over all rows, estimates how many
   documents hold a shingle; shingles are ordered by that estimate, then by hash. Any order that
   all tasks share is right; rarest first makes lists short.
2. Two sets that link share at least one of their first n - ceil(t n) + 1 shingles in this order,
   and at least two of the first n - ceil(t n) + 2. Small (light) sets put out a key for every pair
   of shingles among the latter; large (heavy) sets, and those small ones that a heavy set may link
   with, put out the former, which are the inverted lists that heavy sets scan. The size where light
   ends is where the sum of both costs, estimated from the sizes of all sets and the
   sketch, is least.
3. A pair is a candidate if sizes and places in the order allow a link. Parity sketches (the bits
   that differ between two are never more than the shingles that differ) drop most false candidates
   without their texts; the rest are decided on whole sets, recomputed from the texts.
4. In every list each set is first held against one hub, the list's member with the least hash;
   links found that way join sets to components. Then only lists whose members are still in several
   components are scanned for pairs between components: short lists by joining them with themselves,
   long ones in blocks inside the tasks, where short sketches let through only what may link, first
   each set's nearest partner, and in a last round whatever is then still apart.

Defined results: words are cut at ASCII white space after A-Z are lower-cased; fewer than five
words are one shingle; null and empty texts, and texts of white space, have no shingles, link with
nothing and are components of their own; rows that repeat a doc_id are one document: what links
with one of them links with all; a row without doc_id takes no part, and its component is null;
component_id is the least doc_id in reach; an empty table gives an empty result; further columns
are not read by ``join`` and pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import MAX_BLOCKS, bloom_blocks, bloom_build, bloom_test, fresh, iterated, sliced, small_batches, written, written_measured

WORDS = 5
#: Counters of the sketch of shingle frequencies; one byte each where tasks get it.
COUNTERS = 1 << 21
SLICES = 32
#: Words whose hash a task keeps; beyond that it starts anew.
MAX_CACHED = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_word_hashes: dict[bytes, int] = {}


# ------------------------------------------------------------------ sets


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    if len(_word_hashes) > MAX_CACHED:
        _word_hashes.clear()
    get, out = _word_hashes.get, []
    for w in words:
        h = get(w)
        if h is None:
            h = _word_hashes[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    w = np.array(out, np.uint64)
    n = min(k, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for i in range(n):
        h = h * _BASE + w[i : len(w) - n + 1 + i]
    return np.unique(_mixed(h))


def needed(n: int, threshold: Fraction) -> int:
    """Shingles that a set of n must share with any set it links with: ceil(t n)."""
    return -(-threshold.numerator * n // threshold.denominator)


def prefix_length(n: int, threshold: Fraction) -> int:
    return n - needed(n, threshold) + 1


def tiny(threshold: Fraction) -> int:
    """The size up to which two sets may link by a single shingle, so that pairs of shingles don't find them all."""
    return threshold.denominator // threshold.numerator


#: Bits of the short sketches that long lists are scanned with.
SHORT = 512


def parity(h: np.ndarray) -> bytes:
    """A bit for each residue of the hashes: whether an odd number of them has it. Two to four bits a shingle."""
    bits = max(SHORT, 1 << int(2 * len(h) - 1).bit_length())
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A sketch of fewer bits from one of more."""
    while len(x) > words:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def differing(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one of the two sets only; the longer sketch is folded to the shorter."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())


def _first_pass(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each document, and at the end this task's counters in slices."""
    counts = np.zeros(COUNTERS, np.uint32)
    some = False
    for batch in sliced(batches):
        sizes, signatures, sketches, shorts, places = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            h = shingle_set(text, k)
            sizes.append(len(h))
            signatures.append(xxhash.xxh128_digest(h.tobytes()))
            sketches.append(parity(h) if len(h) else b"")
            shorts.append(folded(np.frombuffer(sketches[-1], np.uint64), SHORT // 64).tobytes())
            places.append((h >> np.uint64(40)).astype(np.int32) & (COUNTERS - 1))
        some = True
        at, n = np.unique(np.concatenate(places), return_counts=True)
        counts[at] += n.astype(np.uint32)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n": pa.array(sizes, pa.int32()), "signature": pa.array(signatures, pa.binary()),
            "sketch": pa.array(sketches, pa.binary()), "short": pa.array(shorts, pa.binary()), "slice": pa.nulls(len(sizes), pa.int32()), "counts": pa.nulls(len(sizes), pa.binary()),
        })
    if some:
        # squeezed: most counters are small, and in a small task most are zero
        import zlib

        parts = [zlib.compress(c.tobytes(), 1) for c in np.split(counts, SLICES)]
        yield pa.RecordBatch.from_pydict({
            "doc_id": pa.nulls(SLICES, pa.int64()), "n": pa.nulls(SLICES, pa.int32()), "signature": pa.nulls(SLICES, pa.binary()),
            "sketch": pa.nulls(SLICES, pa.binary()), "short": pa.nulls(SLICES, pa.binary()), "slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array(parts, pa.binary()),
        })


def _add_counts(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import zlib

    total = np.zeros(COUNTERS // SLICES, np.uint32)
    for pdf in batches:
        for b in pdf["counts"]:
            total += np.frombuffer(zlib.decompress(b), np.uint32)
    yield pd.DataFrame({"slice": [key[0]], "counts": [zlib.compress(total.tobytes(), 1)]})


def frequencies(first: DataFrame) -> np.ndarray:
    """The counters of all tasks added up, in two steps, so that no task reads those of all others."""
    import zlib

    add = iterated(_add_counts)
    parts = first.where("slice is not null").select("slice", "counts", F.pmod(F.xxhash64("counts"), F.lit(64)).alias("part"))
    some = parts.groupBy("slice", "part").applyInPandas(add, "slice int, counts binary")
    counts = np.zeros(COUNTERS, np.uint64)
    for r in some.groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():  # COUNTERS numbers in all
        size = COUNTERS // SLICES
        counts[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    return counts


def rarity(counts: np.ndarray) -> np.ndarray:
    """A byte for each counter: its excess over what chance puts there, on a log scale; 0 is as rare as most."""
    mean = counts.mean()
    usual = mean + 4 * np.sqrt(mean) + 1
    return np.clip(np.ceil(4 * np.log2(np.maximum(counts, usual) / usual)), 0, 255).astype(np.uint8)


def ordered(h: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The hashes, rarest first, then by hash."""
    return h[np.argsort(rare[(h >> np.uint64(40)).astype(np.int64) & (COUNTERS - 1)], kind="stable")]


# ------------------------------------------------------------------ cost


#: What a list entry that a scan meets costs, where an entry written and shuffled costs 1.
MEET = 0.02


def boundary(sizes: dict[int, int], share: float, threshold: Fraction, most: int = 400) -> int:
    """The size up to which sets are light.

    A light set costs a key for each pair of its first p + 1 shingles. A heavy one, or a light one that a heavy
    set may link with, costs a row for each of its first p, and for each of those a scan of the
    ``share`` of further entries that a shingle's list has on average.
    """
    def light(n: int) -> int:
        p = prefix_length(n, threshold)
        return (p + 1) * p // 2

    def heavy(n: int) -> float:
        return prefix_length(n, threshold) * (1 + MEET * share)

    best, at = None, 0
    for x in (0, *[n for n in range(2, most + 1)]):
        cost = sum(c * light(n) for n, c in sizes.items() if n <= x) + sum(c * heavy(n) for n, c in sizes.items() if n >= threshold * x)
        if best is None or cost < best:
            best, at = cost, x
    return at


#: Entries of one key that one task should read.
PART = 2_000


def _keys(batches: Iterator[pa.RecordBatch], k: int, threshold: Fraction, light: int, rare, unit: float, members) -> Iterator[pa.RecordBatch]:
    """List entries (key, node, n, at, parts): a key is a shingle, or a pair of them.

    ``at`` is the place of its (second) shingle in the order. ``parts`` says over how many parts a long list is dealt, by
    the estimate of its shingle; ``unit`` is the count that the rarity 0 stands for. ``members`` is a filter of the
    documents that take part; None: all do.
    """
    table, few = rare.value, tiny(threshold)
    few = few if few > 1 else 0  # at more than one half, such sets are equal ones

    def parts_of(hashes: np.ndarray) -> np.ndarray:
        about = unit * 2.0 ** (table[(hashes >> np.uint64(40)).astype(np.int64) & (COUNTERS - 1)] / 4.0)
        return np.where(about > unit, np.ceil(about / PART), 1).astype(np.int32)

    for batch in sliced(batches):
        if members is not None:
            batch = batch.filter(pa.array(bloom_test(members.value, batch.column("h").to_numpy(zero_copy_only=False))))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        keys, nodes, ns, ats, parts = [], [], [], [], []
        for text, node in zip(batch.column("text").to_pylist(), ids, strict=True):
            h = shingle_set(text, k)
            n = len(h)
            if n < 2 and n > few or not n:
                continue  # a set of one links with none but its like
            p = prefix_length(n, threshold)
            first = ordered(h, table)[: p + 1]
            if 2 <= n <= light:
                i, j = np.triu_indices(len(first), 1)
                pair = _mixed(first[i] * _BASE + first[j]) | np.uint64(1)
                keys.append(pair)
                parts.append(np.minimum(parts_of(first[i]), parts_of(first[j])))
                ats.append(j.astype(np.int32))
                nodes.append(np.full(len(pair), node))
                ns.append(np.full(len(pair), n, np.int32))
            if n >= threshold * light or n <= few:
                one = first[:p] & ~np.uint64(1)
                keys.append(one)
                parts.append(parts_of(first[:p]))
                ats.append(np.arange(p, dtype=np.int32))
                nodes.append(np.full(p, node))
                ns.append(np.full(p, n, np.int32))
        if keys:
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.concatenate(keys).view(np.int64)), "node": pa.array(np.concatenate(nodes).astype(np.int64)),
                "n": pa.array(np.concatenate(ns)), "at": pa.array(np.concatenate(ats)), "parts": pa.array(np.concatenate(parts)),
            })


# ------------------------------------------------------------ candidates


def _may_link(a: str, b: str, threshold: Fraction, light: int) -> Column:
    """Whether sizes and places of a shared key allow a link.

    For the first shingle that two linked sets share, what is behind it in both has to make up the overlap.
    """
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    t, u = threshold.numerator, threshold.denominator
    sizes = (u * na >= t * nb) & (u * nb >= t * na)
    overlap = F.ceil(F.lit(t) * (na + nb) / F.lit(t + u))
    single = F.bitwise_not(F.col("key")).bitwiseAND(F.lit(1)) == 1
    behind = F.least(na - F.col(f"{a}.at"), nb - F.col(f"{b}.at"))
    most = F.greatest(na, nb)
    # pairs of light sets are found by their pair keys, all others and those of tiny ones by single ones; a pair key counts one shingle more
    alone = (most > light) | (most <= tiny(threshold))
    return sizes & F.when(single, alone & (behind >= overlap)).otherwise((most <= light) & (behind + 1 >= overlap))


def _sketch_test(batches: Iterator[pd.DataFrame], threshold: Fraction) -> Iterator[pd.DataFrame]:
    t, u = threshold.numerator, threshold.denominator
    for pdf in batches:
        # |A and B| >= t/(t+u) (|A|+|B|), so at most (u-t)/(t+u) (|A|+|B|) shingles differ
        keep = [
            differing(x, y) * (t + u) <= (u - t) * (na + nb)
            for x, y, na, nb in zip(pdf["sa"], pdf["sb"], pdf["na"], pdf["nb"], strict=True)
        ]
        yield pdf.loc[keep, ["a", "b"]]


def _links(x: np.ndarray, y: np.ndarray, t: int, u: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return u * both >= t * (len(x) + len(y) - both) and both > 0


def _exact_test(batches: Iterator[pa.RecordBatch], k: int, threshold: Fraction) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (a, bucket, role): the text of a, then those of all b of the bucket to hold against it."""
    t, u = threshold.numerator, threshold.denominator
    at, own = None, []
    for batch in sliced(batches):
        left, right = [], []
        for a, bucket, b, text in zip(*[batch.column(c).to_pylist() for c in ("a", "bucket", "b", "text")], strict=True):
            h = shingle_set(text, k)
            if b is None:
                own = [*own, h] if (a, bucket) == at else [h]  # rows that repeat an id are one document
                at = a, bucket
            elif (a, bucket) == at and any(_links(x, h, t, u) for x in own):
                left.append(a)
                right.append(b)
        yield pa.RecordBatch.from_pydict({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _filter_of(nodes: DataFrame):
    """A broadcast filter of the nodes; None where one of bounded size could not tell them apart."""
    count = nodes.count()
    if count * 16 > MAX_BLOCKS * 256:
        return None
    words = bloom_build(nodes.select(F.xxhash64("node").alias("h")), "h", bloom_blocks(count))
    return nodes.sparkSession.sparkContext.broadcast(words)


def _only(batches: Iterator[pa.RecordBatch], members) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        kept = batch.filter(pa.array(bloom_test(members.value, batch.column("h").to_numpy(zero_copy_only=False))))
        if kept.num_rows:
            yield kept


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, threshold: Fraction) -> DataFrame:
    """The pairs (a, b) that link: by parity sketches first, then by whole sets."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    likely = written(
        pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(partial(_sketch_test, threshold=threshold), "a long, b long"), "likely"
    )
    ids = written(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ids")
    # with a filter only texts that it may hold are shuffled; the join that follows is exact
    members = _filter_of(ids)
    texts = docs.where("doc_id is not null")
    if members is not None:
        texts = texts.withColumn("h", F.xxhash64("doc_id"))
        texts = texts.mapInArrow(partial(_only, members=members), texts.schema)
    # a hub may have any number of partners: they are dealt over buckets of bounded size, and the hub's text goes to each
    numbered = likely.withColumn("bucket", F.pmod(F.xxhash64("b"), F.lit(1 << 20)))
    fan = likely.groupBy("a").agg(F.ceil(F.count("*") / F.lit(64)).cast("int").alias("buckets"))
    partners = numbered.join(fan, "a").select("a", (F.col("bucket") % F.col("buckets")).alias("bucket"), "b")
    hubs = fan.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets").cast("long") - 1)).alias("bucket"), F.lit(None).cast("long").alias("b"))
    wanted = hubs.unionByName(partners).withColumn("doc_id", F.coalesce("b", "a"))
    rows = (
        texts.join(wanted, "doc_id").select("a", "bucket", "b", "text")
        .repartition("a", "bucket").sortWithinPartitions("a", "bucket", F.col("b").asc_nulls_first())
    )
    return rows.mapInArrow(partial(_exact_test, k=k, threshold=threshold), "a long, b long")


# ------------------------------------------------------------ components


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b); root is the least node in reach.

    Alternating large-star and small-star steps, a logarithm of the longest path in number; a
    node's neighbours are never gathered, only their least is.
    """
    edges = written(edges.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    previous = None
    while True:
        # both directions from one row: a union would double all that is planned and scanned before it
        both = edges.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        # large star: every greater neighbour of u goes to the least node around u
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = edges.join(least, "u").select(F.col("v"), F.col("m"))
        large = large.where("v <> m").distinct()
        # small star: u's lesser neighbours and u itself go to the least of them
        lesser = large.select(F.greatest("v", "m").alias("v"), F.least("v", "m").alias("m"))
        root = lesser.groupBy("v").agg(F.min("m").alias("r"))
        ends = F.array(F.struct(F.col("r").alias("u"), F.col("m").alias("v")), F.struct(F.col("r").alias("u"), F.col("v")))
        new = lesser.join(root, "v").select(F.inline(ends)).where("u <> v").distinct()
        new = new.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        edges, state = written_measured(new, "edges", n=F.count("*"), s=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
        if state == previous:
            break
        previous = state
    leaves = edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return leaves.unionByName(roots.join(leaves.select("node"), "node", "left_anti"))


# ------------------------------------------------------------------ join

#: Lists up to this size are joined with themselves.
LONG = 32
#: Members of a long list that one task holds of each of two blocks.
BLOCK = 4096


def _star(lists: DataFrame, threshold: Fraction, light: int) -> DataFrame:
    """Candidate pairs (a, b) of each entry with its list's hub."""
    e = lists.alias("e").where(F.col("e.node") != F.col("hub.node")).where(_may_link("e", "hub", threshold, light))
    return e.select(F.least("e.node", "hub.node").alias("a"), F.greatest("e.node", "hub.node").alias("b"))


def _short_pairs(lists: DataFrame, threshold: Fraction, light: int) -> DataFrame:
    """Candidate pairs (a, b) of members of a short list in different components."""
    x, y = lists.alias("x"), lists.alias("y")
    found = x.join(y, "key").where((F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _may_link("x", "y", threshold, light))
    return found.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def _long_pairs(lists: DataFrame, classes: DataFrame, nearest: bool, threshold: Fraction, light: int) -> DataFrame:
    """The same for long lists: members are dealt over blocks, and each two blocks of a list are compared in one task."""
    n_blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    dealt = (
        lists.join(classes.select("node", "short"), "node")
        .withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "n", "at", "root", "short")
    )
    together = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return together.mapInArrow(partial(_scan_lists, nearest=nearest, threshold=threshold, light=light), "a long, b long")


def _scan_lists(batches: Iterator[pa.RecordBatch], nearest: bool, threshold: Fraction, light: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j); each such group is two blocks of a list, or one block twice."""
    held: list[pa.RecordBatch] = []

    def groups(rows: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        ids = np.stack([rows.column(c).to_numpy() for c in ("key", "i", "j")])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1), rows.num_rows]
        whole = cuts if last else cuts[:-1]
        return [rows.slice(a, b - a) for a, b in zip(whole[:-1], whole[1:], strict=True)], rows.slice(whole[-1])

    def found(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        pairs = [_near(g, nearest, threshold, light) for g in parts]
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_pydict({"a": pa.array(both[0]), "b": pa.array(both[1])})

    for batch in batches:
        held.append(batch)
        parts, rest = groups(pa.Table.from_batches(held), False)
        yield from found(parts)
        held = rest.combine_chunks().to_batches()
    if held:
        yield from found(groups(pa.Table.from_batches(held), True)[0])


def _near(group: pa.Table, nearest: bool, threshold: Fraction, light: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one group in different components that sizes, places and short sketches let through.

    With ``nearest`` only the closest partner of each member that is not in the group's largest component.
    """
    t, u = threshold.numerator, threshold.denominator
    own, node, n, at, root = (group.column(c).to_numpy().astype(np.int64) for c in ("own", "node", "n", "at", "root"))
    sketch = np.frombuffer(b"".join(group.column("short").to_pylist()), np.uint64).reshape(len(node), -1)
    one_block = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    single = group.column("key")[0].as_py() & 1 == 0
    _, inverse, counts = np.unique(root, return_inverse=True, return_counts=True)
    small = np.flatnonzero(inverse != counts.argmax())
    rows = np.flatnonzero(np.isin(np.arange(len(node)), small))
    left, right = [], []
    for k in range(0, len(rows), 64):
        x = rows[k : k + 64, None]
        n2, least = n[x] + n, np.minimum(n[x] - at[x], n - at)
        most = np.maximum(n[x], n)
        alone = (most > light) | (most <= tiny(threshold))
        fine = (root[x] != root) & (u * n[x] >= t * n) & (u * n >= t * n[x])
        # the same rule as _may_link: pair keys count for light sets, single ones for the others
        fine &= (alone & (least * (t + u) >= t * n2)) if single else ((most <= light) & ((least + 1) * (t + u) >= t * n2))
        if not one_block:
            fine &= own[x] != own
        bits = np.bitwise_count(sketch[x[:, 0], None, :] ^ sketch[None, :, :]).sum(axis=2, dtype=np.int64)
        fine &= bits * (t + u) <= (u - t) * n2
        if nearest:
            bits[~fine] = 1 << 30
            best = bits.argmin(axis=1)
            ok = fine[np.arange(len(x)), best]
            left.append(node[x[ok, 0]])
            right.append(node[best[ok]])
        else:
            i, j = np.nonzero(fine)
            left.append(node[x[i, 0]])
            right.append(node[j])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _open_lists(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries, with their component's root and the list's size, of the lists whose members lie in several components.

    Only one row for each part of a list is dealt by the key alone.
    """
    member = lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).select("key", "part", "node", "n", "at", "root")
    parts = written(member.groupBy("key", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")), "parts")
    apart = parts.groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("size")).where("lo <> hi")
    return member.join(parts.select("key", "part").join(apart.select("key", "size"), "key"), ["key", "part"])


def join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    spark, threshold = docs.sparkSession, Fraction(percent, 100)
    small_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    first = written(
        docs.mapInArrow(partial(_first_pass, k=k), "doc_id long, n int, signature binary, sketch binary, short binary, slice int, counts binary"), "sets"
    )
    rows = first.where("slice is null").select("doc_id", "n", "signature", "sketch", "short")
    counts = frequencies(first)
    classes = written(
        rows.where("n > 0 and doc_id is not null").groupBy("signature").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("short").alias("short")),
        "classes",
    )
    histogram = {r["n"]: r["count"] for r in classes.groupBy("n").count().collect()}  # sizes, not documents
    if not histogram:
        return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    total, mean = float(counts.sum()), float(counts.mean())
    share = max(0.0, float((counts.astype(float) ** 2).sum()) / max(total, 1.0) - 1 - mean)
    light = boundary(histogram, min(share, 100.0), threshold)
    rare = spark.sparkContext.broadcast(rarity(counts))
    unit = mean + 4 * mean**0.5 + 1
    # entries of documents that stand for their class; of a few others that the filter lets through, the copies do no harm
    members = _filter_of(classes.select("node"))
    texts = docs.where("doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    if members is None:
        texts = texts.join(classes.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    entries = texts.mapInArrow(
        partial(_keys, k=k, threshold=threshold, light=light, rare=rare, unit=unit, members=members), "key long, node long, n int, at int, parts int"
    ).withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    in_part = Window.partitionBy("key", "part")
    entry = lambda seed: F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), "node", "n", "at")
    listed = written(
        entries.withColumn("hub", F.min(entry(0)).over(in_part)).withColumn("last", F.max(F.xxhash64("node", F.lit(0))).over(in_part))
        .where("parts > 1 or hub.h <> last").drop("last"), "lists",
    )
    # the hubs of a long list's parts are held against the least of them
    tops = listed.where("parts > 1").select("key", "hub").distinct()
    tops = tops.select("key", "hub.*").withColumn("hub", F.min(F.struct("h", "node", "n", "at")).over(Window.partitionBy("key")))
    star = written(_star(listed, threshold, light).unionByName(_star(tops, threshold, light)).distinct(), "star")
    # rows that repeat an id with other texts are one document
    mine = rows.where("doc_id is not null").join(classes.select("signature", "node"), "signature").select("doc_id", "node")
    several = mine.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    same = several.join(mine, "doc_id").select("a", F.col("node").alias("b"))
    root_of = written(components(_verified(docs, star, classes, k, threshold).unionByName(same)), "roots")

    # lists whose members still lie in several components
    lists = listed.select("key", "part", "node", "n", "at")
    for nearest in (True, False):
        lists = written(_open_lists(lists, root_of), "open")
        pairs = _long_pairs(lists.where(F.col("size") > LONG), classes, nearest, threshold, light)
        if nearest:
            pairs = pairs.unionByName(_short_pairs(lists.where(F.col("size") <= LONG), threshold, light))
        lists = lists.where(F.col("size") > LONG).drop("root", "size")
        pairs = written(pairs.distinct().join(star, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            continue
        star = star.unionByName(pairs)
        # links between sets are links between the components found so far
        to_root = lambda c: root_of.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        links = _verified(docs, pairs, classes, k, threshold).join(to_root("a"), "a", "left").join(to_root("b"), "b", "left")
        links = links.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        joined = written(components(links), "joined").select(F.col("node").alias("root"), F.col("root").alias("top"))
        known = root_of.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        alone = joined.join(root_of.select(F.col("node").alias("root")), "root", "left_anti").select(F.col("root").alias("node"), F.col("top").alias("root"))
        root_of = written(known.unionByName(alone), "roots")

    root = classes.select("signature", "node").join(root_of, "node", "left").select("signature", F.coalesce("root", "node").alias("root"))
    out = rows.join(root, "signature", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("root")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    return out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = WORDS, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component: the one with the least id. Rows without id stay; of rows that repeat an id, all do."""
    (gone,) = fresh(docs.columns, "gone")
    linked = join(docs, doc_id=doc_id, text=text, k=k, percent=percent).where("component_id <> doc_id").select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(written(linked, "gone"), F.col(doc_id) == F.col(gone), "left_anti")
