"""Interpolated modified Kneser-Ney language model, counted in Spark, stored as sorted hash arrays that workers map into memory.

Words are hashed a batch at a time, each word one polynomial of its bytes. Tasks count what they read as sorted arrays, cut them by hash into
shards and send each piece packed (differences, byte by byte, squeezed), so a frequent word or n-gram is one entry of a task, whatever
its count; shards are added up by hash, so no key can make one large. Of the counts of the highest order follow, by the same exchange, those of the lower
ones (how many different words precede), and of each the sums by context. The model is a folder of files, for each table and
shard its sorted 64-bit hashes and their counts, which scoring tasks map and search, a window of tokens at a time in sorted order.

A word's probability after its context u: the discounted count over u's sum, plus u's share of discounts times the probability
after u without its first word; at the bottom one over V + 1, so that unknown words have a probability too. There are three discounts for each order, of counts one, two and
more, from the counts of counts; where those don't give any (a small corpus), 0.5, 1 and 1.5. A text begins with a mark that is never predicted and ends with an end
that is; n-grams that begin with the mark keep their own counts, as nothing can precede.

The number of shards follows the corpus's bytes; no word, n-gram or text is left out. Files are written beside their final name and then
renamed, and hold the same when a task runs again. The folder has to be one that workers open as files: a ``file:`` path or a mounted one, in
``spark.checkpoint.dir`` unless given. Words are numbered in 32 bits; more than 2**32 - 2 different ones are an error.

Defined results: a null or empty text is the end alone; white space is 0x20 and 0x09 to 0x0D, any other character belongs to words; A-Z count as a-z; texts of any length are scored
whole; rows that repeat count each, ids are not read; with nothing to learn from every word has probability one;
an empty table gives an empty result; other columns stay as they are, and the new ones take names that none has if told to (``out``). Two words of one 64-bit hash
count as one.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import arrow_columns, iterated, scratch_dir, small_batches, with_fields, written

#: Bytes of text hashed at a time, and tokens counted or scored at a time.
PIECE, WINDOW = 1 << 20, 1 << 19
#: Different entries that a task holds before it sends them.
HELD = 1 << 21
#: Bytes of the corpus for each shard; shards are a power of two, 2**MAX_BITS at most.
SHARD_BYTES, MAX_BITS = 16 << 20, 16
COLUMNS = ("n_tokens", "n_known", "base_score", "score")
_BASE = np.uint64(0xD1342543DE82EF95)  # odd, so that it has an inverse
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_PACKS = "kind int, shard int, data binary"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


#: Stands for the end of a text among the hashes of words.
END = mixed(np.array([1], np.uint64))[0]

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        steps = np.full(max(n, 1), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.cumprod(steps)
    return _powers[name][:n]


def _piece(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words, place of each in ``data``); a word ends at white space, and before each of ``starts``."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts[starts < len(data)]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(low.astype(np.uint64) * _power(_BASE, "up", len(data)), out=sums[1:])
    h = (sums[end] - sums[begin]) * _power(_INVERSE, "down", len(data) + 1)[begin]
    return mixed(h + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), begin


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text)."""
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint64), np.zeros(len(column), np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    hashes, places = [], []
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + PIECE)
        while to < end:  # cut at white space or between two texts, never within a word
            look = data[to : to + PIECE]
            gap = np.flatnonzero((look == 32) | ((look >= 9) & (look <= 13)))
            text = np.searchsorted(offsets, to)
            stop = min(int(gap[0]) + to if len(gap) else end, int(offsets[text]))
            if len(gap) or stop <= to + len(look):
                to = stop
                break
            to += len(look)
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to)] - at
        h, begin = _piece(data[at:to], inner)
        hashes.append(h)
        places.append(begin + at)
        at = to
    places = np.concatenate(places)
    return np.concatenate(hashes), np.diff(np.searchsorted(places, offsets))


def texts(batches: Iterator[pa.RecordBatch], text: str, size: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """Batches of about ``size`` bytes of text; a longer text is one by itself."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


# ------------------------------------------------------------ sorted counts


def added(m: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in order, each once, with the sums of their counts. m: [n, width] of 32-bit numbers, c: [n, columns]."""
    if not len(m):
        return m, c
    key = _key(m)
    order = np.argsort(key) if m.shape[1] <= 2 else np.lexsort((*m[:, :1:-1].T, key))
    m, key = m[order], key[order]
    new = np.ones(len(m), bool)
    new[1:] = key[1:] != key[:-1]
    for k in range(2, m.shape[1]):
        new[1:] |= m[1:, k] != m[:-1, k]
    at = np.flatnonzero(new)
    return m[at], np.add.reduceat(c[order], at, axis=0)


def _key(m: np.ndarray) -> np.ndarray:
    """The first two columns as one number."""
    key = m[:, 0].astype(np.uint64)
    return (key << np.uint64(32)) | m[:, 1] if m.shape[1] > 1 else key


def _halves(key: np.ndarray) -> np.ndarray:
    return np.stack([key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def _bytewise(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(len(x), 8).T).tobytes()


def packed(m: np.ndarray, c: np.ndarray) -> bytes:
    """Rows in order and their counts, as differences, byte by byte, squeezed."""
    columns = [np.diff(_key(m), prepend=np.uint64(0)), *m[:, 2:].T, *c.T]
    return np.array([*m.shape, c.shape[1]], np.int64).tobytes() + zlib.compress(b"".join(_bytewise(x) for x in columns), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, width, columns = np.frombuffer(data[:24], np.int64).tolist()
    x = np.frombuffer(zlib.decompress(data[24:]), np.uint8).reshape(-1, 8, n)
    x = np.ascontiguousarray(x.transpose(0, 2, 1)).view(np.uint64)[:, :, 0]
    key = np.cumsum(x[0])
    first = _halves(key) if width > 1 else key.astype(np.uint32)[:, None]
    rest = len(x) - columns
    return np.concatenate([first, x[1:rest].T.astype(np.uint32)], axis=1), x[rest:].T.astype(np.int64)


def gram_hash(m: np.ndarray) -> np.ndarray:
    h = np.full(len(m), m.shape[1], np.uint64)
    for k in range(m.shape[1]):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + m[:, k])
    return h


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of each run of equal values."""
    at = np.flatnonzero(np.diff(values, prepend=-1)).tolist()
    return list(zip(at, [*at[1:], len(values)], strict=True)) if at else []


def _sent(kind: int, m: np.ndarray, c: np.ndarray, hashes: np.ndarray, bits: int) -> pa.RecordBatch:
    """A packed row for each shard of rows in order."""
    shard = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(m), np.int64)
    order = np.argsort(shard, kind="stable")
    parts = [order[a:b] for a, b in _runs(shard[order])]
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([kind] * len(parts), pa.int32()), "shard": pa.array([int(shard[p[0]]) for p in parts], pa.int32()), "data": pa.array([packed(m[p], c[p]) for p in parts], pa.binary()),
    })


class Counter:
    """What a task has counted of one kind, sent on when it is much."""

    def __init__(self, kind: int, bits: int, hashed=gram_hash):
        self.kind, self.bits, self.hashed = kind, bits, hashed
        self.new: list[tuple] = []
        self.sum: tuple | None = None

    def add(self, m: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(m):
            self.new.append((m, c))
        if sum(len(m) for m, _ in self.new) >= HELD // 2:
            self._fold()
            if len(self.sum[0]) >= HELD:
                yield from self.rest()

    def _fold(self) -> None:
        parts = [*([self.sum] if self.sum else []), *self.new]
        self.sum = added(np.concatenate([m for m, _ in parts]), np.concatenate([c for _, c in parts]))
        self.new.clear()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.new:
            self._fold()
        if self.sum:
            m, c = self.sum
            self.sum = None
            yield _sent(self.kind, m, c, self.hashed(m), self.bits)


def _summed(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The counts of one shard of one kind, added up as they come."""
    total, new, n = None, [], 0
    for pdf in batches:
        for data in pdf["data"]:
            new.append(unpacked(data))
            n += len(new[-1][0])
            if n >= HELD:
                parts = [*([total] if total else []), *new]
                total, new, n = added(np.concatenate([m for m, _ in parts]), np.concatenate([c for _, c in parts])), [], 0
    parts = [*([total] if total else []), *new]
    m, c = added(np.concatenate([m for m, _ in parts]), np.concatenate([c for _, c in parts]))
    yield pd.DataFrame({"kind": [key[0]], "shard": [key[1]], "data": [packed(m, c)]})


def _merged(packs: DataFrame, name: str) -> DataFrame:
    """(kind, shard, data): a row for each shard, its counts exact."""
    return written(packs.groupBy("kind", "shard").applyInPandas(iterated(_summed), _PACKS), name)


# ------------------------------------------------------------ files


def _store(folder: str, name: str, hashes: np.ndarray, values: np.ndarray) -> None:
    """Sorted hashes and the columns of their values, in the narrowest type."""
    order = np.argsort(hashes)
    kind = np.uint32 if values.max(initial=0) < 1 << 32 else np.int64
    path = f"{folder}/{name}"
    beside = f"{path}.{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    with open(beside, "wb") as f:
        f.write(np.array([len(hashes), values.shape[1], np.dtype(kind).itemsize], np.int64).tobytes())
        f.write(hashes[order].tobytes())
        for column in values.T:
            f.write(column[order].astype(kind).tobytes())
    os.replace(beside, path)


def _stored(batches: Iterator[pa.RecordBatch], folder: str, name: str, hashed) -> Iterator[pa.RecordBatch]:
    """Writes a file for each shard; (shard, entries, sum of the first count, entries of count one to four)."""
    out = []
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data"), strict=True):
            m, c = unpacked(data.as_py())
            _store(folder, f"{name}-{shard}", hashed(m), c)
            out.append((shard, len(m), int(c[:, 0].sum()), *[int((c[:, 0] == k).sum()) for k in (1, 2, 3, 4)]))
    names = ("shard", "entries", "sum", "n1", "n2", "n3", "n4")
    yield pa.RecordBatch.from_pydict({n: pa.array([r[k] for r in out], pa.int64()) for k, n in enumerate(names)})


_STORED = "shard long, entries long, sum long, n1 long, n2 long, n3 long, n4 long"


class Tables:
    """The files of a model, each mapped when it is first searched."""

    def __init__(self, folder: str, bits: int):
        self.folder, self.bits = folder, bits
        self.open: dict[tuple[str, int], tuple | None] = {}

    def _table(self, name: str, shard: int) -> tuple | None:
        if (name, shard) not in self.open:
            path = f"{self.folder}/{name}-{shard}"
            if len(self.open) > 1000:
                self.open.clear()
            if os.path.exists(path):
                n, columns, width = np.fromfile(path, np.int64, 3).tolist()
                kind = np.uint32 if width == 4 else np.int64
                self.open[name, shard] = (
                    np.memmap(path, np.uint64, "r", 24, (n,)), np.memmap(path, kind, "r", 24 + 8 * n, (columns, n)),
                )
            else:
                self.open[name, shard] = None
        return self.open[name, shard]

    def find(self, name: str, hashes: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
        """(place in its shard or -1, values) of each of some hashes in order."""
        place, values = np.full(len(hashes), -1, np.int64), np.zeros((len(hashes), columns), np.int64)
        shard = (hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), np.int64)
        for a, b in _runs(shard):
            table = self._table(name, int(shard[a]))
            if table:
                known, counts = table
                k = np.minimum(np.searchsorted(known, hashes[a:b]), len(known) - 1)
                hit = np.flatnonzero(known[k] == hashes[a:b])
                place[a + hit], values[a + hit] = k[hit], counts[:, k[hit]].T
        return place, values

    def values(self, name: str, m: np.ndarray, columns: int) -> np.ndarray:
        """Values of rows in any order, zeros for what the model lacks."""
        h, back = np.unique(gram_hash(m), return_inverse=True)
        return self.find(name, h, columns)[1][back]


def _word_key(m: np.ndarray) -> np.ndarray:
    return _key(m)


# ------------------------------------------------------------ the model


@dataclass
class Order:
    """Of one order: the discounts of counts one, two, three and more."""

    discounts: tuple[float, float, float]


@dataclass
class Model:
    folder: str
    order: int
    bits: int
    n_tokens: int = 0  # tokens learned from
    n_words: int = 0  # different ones
    starts: list[int] = field(default_factory=list)  # the first word number of each shard
    orders: list[Order] = field(default_factory=list)
    total: int = 0  # of the lowest order: sum of counts, and how many are one, two, three and more
    kinds: tuple[int, int, int] = (0, 0, 0)

    @property
    def begin(self) -> int:
        return self.n_words

    @property
    def unknown(self) -> int:
        return self.n_words + 1


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Of counts one, two, three and more, from how many entries have count one to four."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = tuple(k - (k + 1) * y * b / a for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
    return d if all(0 < x <= k for k, x in zip((1, 2, 3), d, strict=True)) else (0.5, 1.0, 1.5)


def _count_words(batches: Iterator[pa.RecordBatch], text: str, bits: int) -> Iterator[pa.RecordBatch]:
    counter, n = Counter(0, bits, _word_key), 0
    for batch in texts(batches, text):
        h, _ = word_hashes(batch.column(text))
        n += batch.num_rows
        word, c = np.unique(h, return_counts=True)
        yield from counter.add(_halves(word), c[:, None])
    if n:
        yield from counter.add(_halves(np.array([END])), np.array([[n]]))
    yield from counter.rest()


def _numbered(h: np.ndarray, tables: Tables, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of the different words, their counts, index of each word of ``h`` in them); unknown words get a number of their own."""
    word, back = np.unique(h, return_inverse=True)
    place, count = tables.find("w", word, 1)
    shard = (word >> np.uint64(64 - model.bits)).astype(np.int64) if model.bits else np.zeros(len(word), np.int64)
    number = np.where(place >= 0, np.array(model.starts, np.int64)[shard] + place, model.unknown) if model.starts else np.full(len(word), model.unknown)
    return number, count[:, 0], back


def _sequence(h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with a begin, here 0, before each text and an end after it, place of each begin)."""
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    out = np.empty(len(h) + 2 * len(sizes), np.uint64)
    inner = np.ones(len(out), bool)
    inner[starts] = inner[starts + sizes + 1] = False
    out[inner], out[starts], out[starts + sizes + 1] = h, 0, END
    return out, starts


def _count_grams(batches: Iterator[pa.RecordBatch], text: str, model: Model) -> Iterator[pa.RecordBatch]:
    """The n-grams of the highest order, and shorter ones that begin a text; kind is their length."""
    tables = Tables(model.folder, model.bits)
    counters = {k: Counter(k, model.bits) for k in range(2, model.order + 1)} if model.order > 1 else {1: Counter(1, model.bits)}
    for batch in texts(batches, text):
        flat, starts = _sequence(*word_hashes(batch.column(text)))
        number, _, back = _numbered(flat, tables, model)
        ids = number.astype(np.uint32)[back]
        ids[starts] = model.begin
        is_begin = np.zeros(len(ids), bool)
        is_begin[starts] = True
        for k, counter in counters.items():
            at = np.arange(len(ids) - k + 1) if k == model.order else starts[starts <= len(ids) - k]
            if k == 1:
                at = at[~is_begin]
            for j in range(1, k):
                at = at[~is_begin[at + j]]
            m, c = added(np.stack([ids[at + j] for j in range(k)], axis=1), np.ones((len(at), 1), np.int64))
            yield from counter.add(m, c)
    for counter in counters.values():
        yield from counter.rest()


def _derive(batches: Iterator[pa.RecordBatch], kind: int, bits: int, of: str) -> Iterator[pa.RecordBatch]:
    """Of n-grams: ``suffix``, how many words precede each of their ends; ``context``, sum and numbers of counts one, two, more of each beginning."""
    counter = Counter(kind, bits)
    for batch in batches:
        for data in batch.column("data"):
            m, c = unpacked(data.as_py())
            if of == "suffix":
                yield from counter.add(*added(m[:, 1:], np.ones((len(m), 1), np.int64)))
            else:
                c = c[:, 0]
                yield from counter.add(*added(m[:, :-1], np.stack([c, c == 1, c == 2, c >= 3], axis=1).astype(np.int64)))
    yield from counter.rest()


def model_folder(spark: SparkSession, folder: str | None = None) -> str:
    """A new folder that workers open as files."""
    root = folder or scratch_dir(spark)
    if root.startswith("file:"):
        root = "/" + root[len("file:") :].lstrip("/")
    if "://" in root or root.startswith(("hdfs:", "s3:", "s3a:")):
        raise ValueError("the model's folder has to be one that workers open as files; pass ``folder``")
    return f"{os.path.abspath(root)}/lm-{uuid.uuid4().hex}"


def fit(docs: DataFrame, order: int = 2, text: str = "text", folder: str | None = None) -> Model:
    """Counts all of ``docs`` and writes the model's files."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(text).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = min(MAX_BITS, max(0, -(-n_bytes // SHARD_BYTES) - 1).bit_length())
    model = Model(model_folder(spark, folder), order, bits)

    def store(table: DataFrame, name: str, hashed=gram_hash) -> list:
        """A row of figures for each file."""
        return table.select("shard", "data").mapInArrow(partial(_stored, folder=model.folder, name=name, hashed=hashed), _STORED).collect()

    words = store(_merged(rows.mapInArrow(partial(_count_words, text="text", bits=bits), _PACKS), "words"), "w", _word_key)
    entries = np.zeros(1 << bits, np.int64)
    for r in words:
        entries[r["shard"]] = r["entries"]
    model.starts = (np.cumsum(entries) - entries).tolist()
    model.n_words, model.n_tokens = int(entries.sum()), sum(r["sum"] for r in words)
    if model.unknown >= 1 << 32:
        raise ValueError("more different words than 32 bits number")
    counted = _merged(rows.mapInArrow(partial(_count_grams, text="text", model=model), _PACKS), "grams")
    of_order = counted.where(F.col("kind") == order)
    for k in range(order, 0, -1):
        if k < order:
            suffixes = of_order.mapInArrow(partial(_derive, kind=k, bits=bits, of="suffix"), _PACKS)
            of_order = _merged(suffixes.unionByName(counted.where(F.col("kind") == k)), f"order-{k}")
        figures = store(of_order, f"g{k}")
        total = {n: sum(r[n] for r in figures) for n in ("entries", "sum", "n1", "n2", "n3", "n4")}
        model.orders.insert(0, Order(discounts(*[total[n] for n in ("n1", "n2", "n3", "n4")])))
        if k > 1:
            store(_merged(of_order.mapInArrow(partial(_derive, kind=k, bits=bits, of="context"), _PACKS), f"contexts-{k}"), f"x{k}")
        else:
            model.total, model.kinds = total["sum"], (total["n1"], total["n2"], total["entries"] - total["n1"] - total["n2"])
    return model


def _less(c: np.ndarray, order: Order) -> np.ndarray:
    """Counts less their discounts."""
    return np.maximum(c - np.array([0.0, *order.discounts])[np.minimum(c, 3)], 0.0)


def probabilities(ids: np.ndarray, before: np.ndarray, words: np.ndarray, back: np.ndarray, tables: Tables, model: Model) -> np.ndarray:
    """Of each token of ``ids`` but the first ``order - 1``. before: how many tokens of its text precede it, the begin among them.

    ``words`` are the different tokens, and ``back`` the index of each in them.
    """
    lead = model.order - 1
    at = np.arange(lead, len(ids))
    bottom = 1 / (model.n_words + 1)
    if model.total:
        spread = sum(d * n for d, n in zip(model.orders[0].discounts, model.kinds, strict=True)) / model.total
        c = tables.values("g1", words[:, None].astype(np.uint32), 1)[:, 0]
        p = (_less(c, model.orders[0]) / model.total + spread * bottom)[back[at]]
    else:
        p = np.full(len(at), bottom)
    for k in range(2, model.order + 1):
        some = np.flatnonzero(before[at] >= k - 1)
        if k == 2:  # contexts of one word: looked up once for each different word
            context = tables.values("x2", words[:, None].astype(np.uint32), 4)[back[at[some] - 1]]
        else:
            context = tables.values(f"x{k}", np.stack([ids[at[some] - j] for j in range(k - 1, 0, -1)], axis=1).astype(np.uint32), 4)
        known = np.flatnonzero(context[:, 0] > 0)
        some, context = some[known], context[known]
        c = tables.values(f"g{k}", np.stack([ids[at[some] - j] for j in range(k - 1, -1, -1)], axis=1).astype(np.uint32), 1)[:, 0]
        order = model.orders[k - 1]
        spread = (context[:, 1:] * np.array(order.discounts)).sum(axis=1)
        p[some] = (_less(c, order) + spread * p[some]) / context[:, 0]
    return p


def _score(batches: Iterator[pa.RecordBatch], text: str, model: Model, out: tuple[str, ...], drop: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    tables = Tables(model.folder, model.bits)
    smooth = model.n_tokens + 0.1 * (model.n_words + 1)
    lead = model.order - 1
    for batch in texts(batches, text):
        h, sizes = word_hashes(batch.column(text))
        flat, starts = _sequence(h, sizes)
        n_rows = len(sizes)
        known, base, score = np.zeros(n_rows, np.int64), np.zeros(n_rows), np.zeros(n_rows)
        row = np.repeat(np.arange(n_rows), sizes + 2)
        before = np.arange(len(flat)) - starts[row]
        for a in range(0, len(flat), WINDOW):
            window = slice(max(0, a - lead), min(len(flat), a + WINDOW))
            number, count, back = _numbered(flat[window], tables, model)
            is_begin = before[window] == 0
            if is_begin.any():  # the begin is a number of its own
                number, count = np.append(number, model.begin), np.append(count, 0)
                back = np.where(is_begin, len(number) - 1, back)
            pad = lead - (a - window.start)  # before the first token of all
            ids, b = np.concatenate([np.full(pad, model.begin), number[back]]), np.concatenate([np.zeros(pad, np.int64), before[window]])
            p = probabilities(ids, b, number, np.concatenate([np.zeros(pad, np.int64), back]), tables, model)
            own = slice(a - window.start, None)
            real = ~is_begin[own]
            rows, c = row[a : window.stop][real], count[back[own]][real]
            known += np.bincount(rows, c > 0, n_rows).astype(np.int64)
            base += np.bincount(rows, np.log10((c + 0.1) / smooth), n_rows)
            score += np.bincount(rows, np.log10(p[real]), n_rows)
        columns = (sizes + 1, known, base, score)
        yield arrow_columns(batch, dict(zip(out, map(pa.array, columns), strict=True)), drop)


def score(docs: DataFrame, model: Model, text: str = "text", out: tuple[str, ...] = COLUMNS, keep_text: bool = False) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score and score of each whole text; without its text unless ``keep_text``."""
    kinds = dict(zip(out, (T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()), strict=True))
    drop = () if keep_text else (text,)
    return docs.mapInArrow(partial(_score, text=text, model=model, out=out, drop=drop), with_fields(docs, kinds, drop))
