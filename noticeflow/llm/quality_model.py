"""A quality classifier: random Fourier features, ridge scores, isotonic calibration.

Statistics of every whole text (lengths, character classes, repetition; never labels, ids, language
or source) are standardised and mapped by random Fourier features, whose inner products
approximate a Gaussian kernel. The ridge weights come from normal equations that each
partition sums over its rows and that are added up in a fixed order, so a rerun gives
the same model. Scores of the training rows are counted in narrow bins, and pooling adjacent
violators over the bins gives the calibration.

Defined results: a null text is empty; an empty text is scored by its statistics (all zero)
like any other; rows that repeat are scored each, and count each in training; labels that are
null are left out; without any label every score is 0.5; an empty table gives an empty result;
further columns pass through, and columns that have an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import arrow_columns, small_batches, with_fields, written

#: Sets of ASCII characters whose share of a text is a statistic.
CLASSES = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!", "?", "|", "#*$%&", "<>{}[]=\\/^~_@+", ".,;:", "\n", "\t ", "\"'()-")
N_STATS = 9 + len(CLASSES)


def _byte_weights() -> np.ndarray:
    w = np.zeros((256, len(CLASSES)))
    for k, chars in enumerate(CLASSES):
        w[list(chars.encode()), k] = 1
    return w


_WEIGHTS = _byte_weights()


def text_statistics(text: str) -> np.ndarray:
    """N_STATS numbers of one text, on scales that do not grow with its length beyond a logarithm."""
    out = np.zeros(N_STATS)
    words = text.split()
    n = len(words)
    if not n:
        return out
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    chars = max(1, len(text))
    lines = [x for x in text.split("\n") if x]
    pairs = max(1, n - 1)
    out[0] = np.log1p(n)
    out[1] = np.log(max(1, chars - n) / n)
    out[2] = np.log1p(len(set(words))) / np.log1p(n)
    out[3] = sum(map(eq, words, words[1:])) / pairs
    out[4] = len(set(zip(words, words[1:], strict=False))) / pairs
    out[5] = 1 - len(set(lines)) / max(1, len(lines))
    out[6] = np.log1p(n / max(1, len(lines)))
    out[7] = counts[128:].sum() / chars
    out[8] = np.log(max(map(len, words)))
    out[9:] = np.sqrt(counts @ _WEIGHTS / chars)
    return out


def _statistics(batches: Iterator[pa.RecordBatch], text: str, out: str, drop: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [text_statistics(t or "") for t in batch.column(text).to_pylist()]
        flat = np.concatenate([np.empty(0), *rows])
        ends = np.arange(len(rows) + 1, dtype=np.int32) * N_STATS
        yield arrow_columns(batch, {out: pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}, drop=drop)


def statistics(docs: DataFrame, text: str = "text", out: str = "stats", keep_text: bool = False) -> DataFrame:
    """``docs`` with an array of statistics in place of the text, or beside it."""
    small_batches(docs.sparkSession)
    drop = [] if keep_text else [text]
    schema = with_fields(docs, {out: T.ArrayType(T.DoubleType())}, drop=drop)
    return docs.mapInArrow(partial(_statistics, text=text, out=out, drop=drop), schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores
    levels: np.ndarray  # calibrated scores at the knots

    def mapped(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features of rows of statistics, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        f = np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases)
        return np.hstack([f, np.ones((len(f), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.mapped(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.knots, self.levels)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a row is never learned from: crc32 of the id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.empty((0, N_STATS))


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    n, s, q = 0, np.zeros(N_STATS), np.zeros(N_STATS)
    for pdf in batches:
        x = _matrix(pdf["stats"])
        n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
    if n:
        yield pd.DataFrame({"k": range(N_STATS), "n": n, "s": s, "q": q, "part": _partition()})


def _partition() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _normal(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    d = len(model.phases) + 1
    total = np.zeros((d, d + 1))
    n = 0
    for pdf in batches:
        f, y = model.mapped(_matrix(pdf["stats"])), pdf["y"].to_numpy(float)
        total += np.hstack([f.T @ f, (f.T @ y)[:, None]])
        n += len(y)
    if n:
        yield pd.DataFrame({"k": range(d), "row": list(total), "part": _partition()})


def _add_rows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")  # a fixed order, so that a rerun gives the same sum
    return pd.DataFrame({"k": [key[0]], "row": [np.stack(pdf["row"].to_numpy()).sum(axis=0)], "part": [pdf["part"].iloc[0]]})


def pooled(x: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (centre of each block, its mean), ascending."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, n, total, strict=True):
        blocks.append([a * b, b, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 1], b[:, 2] / b[:, 1]


BINS, LOW, HIGH = 2000, -1.0, 2.0


def _binned(batches: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        r = np.clip((model.raw(_matrix(pdf["stats"])) - LOW) / (HIGH - LOW) * BINS, 0, BINS - 1).astype(int)
        yield pdf.assign(bin=r).groupby("bin")["y"].agg(["count", "sum"]).reset_index()


def fit(
    stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", column: str = "stats", folds: int = 5,
    n_features: int = 256, width: float = 3.0, ridge: float = 1e-3, seed: int = 11,
) -> Model:
    """Learn from all labelled rows of ``stats`` (key, and statistics in ``column``) that are not held out."""
    rows = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("id"), F.col(label).cast("double").alias("y"))
    train = stats.select(F.col(key).alias("id"), F.col(column).alias("stats")).where(~held_out(F.col("id"), folds)).join(rows, "id").select("stats", "y")
    train = written(train, "train")
    sums = (
        train.mapInPandas(_moments, "k int, n long, s double, q double, part int")
        .groupBy("k").agg(F.array_sort(F.collect_list(F.struct("part", "n", "s", "q"))).alias("p")).orderBy("k").collect()
    )
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(N_STATS, n_features)) / width
    phases = rng.uniform(0, 2 * np.pi, n_features)
    if not sums:
        zero = np.zeros(n_features + 1)
        return Model(np.zeros(N_STATS), np.ones(N_STATS), directions, phases, zero, np.array([0.0, 1.0]), np.array([0.5, 0.5]))
    n, s, q = (np.array([sum(p[c] for p in r["p"]) for r in sums], float) for c in ("n", "s", "q"))
    mean = s / n
    scale = np.sqrt(np.maximum(q / n - mean**2, 0)) + 1e-3
    model = Model(mean, scale, directions, phases, np.zeros(n_features + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    got = (
        train.mapInPandas(partial(_normal, model=model), "k int, row array<double>, part int")
        .groupBy("k", F.expr("part % 64")).applyInPandas(_add_rows, "k int, row array<double>, part int")
        .groupBy("k").applyInPandas(_add_rows, "k int, row array<double>, part int").orderBy("k").collect()
    )
    total = np.array([r["row"] for r in got])
    penalty = ridge * n[0] * np.eye(n_features + 1) / n_features
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :-1] + penalty, total[:, -1])
    bins = (
        train.mapInPandas(partial(_binned, model=model), "bin int, count long, sum double")
        .groupBy("bin").agg(F.sum("count").alias("n"), F.sum("sum").alias("s")).orderBy("bin").collect()
    )
    x = LOW + (np.array([r["bin"] for r in bins]) + 0.5) * (HIGH - LOW) / BINS
    model.knots, model.levels = pooled(x, np.array([r["n"] for r in bins], float), np.array([r["s"] for r in bins]))
    return model


def _score(batches: Iterator[pa.RecordBatch], model: Model, text: str | None, stats: str, out: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if text:
            x = np.array([text_statistics(t or "") for t in batch.column(text).to_pylist()]).reshape(-1, N_STATS)
        else:
            x = batch.column(stats).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)
        yield arrow_columns(batch, {out: pa.array(np.clip(model.score(x), 0.0, 1.0))}, drop=[] if text else [stats])


def score(rows: DataFrame, model: Model, text: str | None = None, stats: str = "stats", out: str = "score") -> DataFrame:
    """``rows`` with a score from 0 to 1: from a column of statistics, or straight from a text."""
    schema = with_fields(rows, {out: T.DoubleType()}, drop=[] if text else [stats])
    return rows.mapInArrow(partial(_score, model=model, text=text, stats=stats, out=out), schema)
