import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent))
import compare

from noticeflow.llm import quality_model, queries


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(n)) + "."


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(1200):
        good = rng.random() < 0.8
        text = prose(rng, rng.randint(30, 200))
        rows.append((i, text if good else rng.choice([text.upper() + "!!", " ".join(w for w in text.split() for _ in range(4)), text.replace(" ", "$$$ ")])))
        if i % 5:
            labels.append((i, int(good)))
    labels += [(3, None), (5, 1)]
    docs = spark.createDataFrame([*rows, (5000, ""), (5001, None)], "doc_id int, text string")
    known = spark.createDataFrame(labels, "doc_id int, quality int")
    stats = quality_model.statistics(docs)
    model = quality_model.fit(stats, known)
    out = quality_model.score(stats, model).withColumn("held", quality_model.held_out(F.col("doc_id"))).collect()
    truth = {i: q for i, q in labels if q is not None}
    held = [(r["score"] >= 0.3, truth[r["doc_id"]] == 1) for r in out if r["held"] and r["doc_id"] in truth]
    assert len(held) > 100 and sum(a == b for a, b in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == len(rows) + 2
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    direct = {r["doc_id"]: r["score"] for r in quality_model.score(docs, model, text="text").collect()}
    assert all(abs(direct[r["doc_id"]] - r["score"]) < 1e-12 for r in out)
    again = quality_model.fit(stats, known)
    assert np.abs(again.weights - model.weights).max() < 1e-6
    none = quality_model.fit(stats, known.limit(0))
    assert {r["score"] for r in quality_model.score(stats, none).collect()} == {0.5}
    assert quality_model.score(stats.limit(0), model).count() == 0


def test_pooling_is_monotone():
    rng = np.random.default_rng(1)
    x = np.arange(300.0)
    n = rng.integers(1, 9, 300).astype(float)
    s = np.array([rng.binomial(int(k), p) for k, p in zip(n, np.linspace(0.1, 0.9, 300), strict=True)], float)
    knots, levels = quality_model.pooled(x, n, s)
    assert (np.diff(levels) > 0).all() and (np.diff(knots) > 0).all()
    assert hashlib.md5(levels.tobytes()).hexdigest() == hashlib.md5(quality_model.pooled(x, n, s)[1].tobytes()).hexdigest()


def isotonic(n, total):
    """Level of each bin: the greatest of the least means, over all stretches from before it to behind it."""
    n, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(total)])
    m = len(n) - 1
    mean = np.full((m, m), np.inf)
    for a in range(m):
        mean[a, a:] = (total[a + 1 :] - total[a]) / (n[a + 1 :] - n[a])
    least = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]  # over the ends from b on
    return np.array([least[: i + 1, i].max() for i in range(m)])


@pytest.mark.skipif(not compare.present, reason="no test tables")
def test_query_against_numpy(spark):
    """All scores of the query, from one matrix in memory: moments, features, normal equations, bins, isotonic levels."""
    docs = spark.read.parquet(f"{compare.SMALL}/documents.parquet").collect()
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{compare.SMALL}/labels.parquet").collect() if r["quality"] is not None}
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in docs}
    x = np.array([quality_model.text_statistics(r["text"] or "") for r in docs])
    use = np.array([r["doc_id"] in known and not held[r["doc_id"]] for r in docs])
    y = np.array([float(known.get(r["doc_id"], 0)) for r in docs])[use]
    mean, scale = x[use].mean(axis=0), x[use].std(axis=0) + 1e-3
    rng = np.random.default_rng(11)
    directions, phases = rng.normal(size=(x.shape[1], 256)) / 3.0, rng.uniform(0, 2 * np.pi, 256)
    z = np.clip((x - mean) / scale, -5, 5)
    f = np.hstack([np.sqrt(2 / 256) * np.cos(z @ directions + phases), np.ones((len(x), 1))])
    penalty = np.diag([1e-3 * use.sum() / 256] * 256 + [1e-9])
    raw = f @ np.linalg.solve(f[use].T @ f[use] + penalty, f[use].T @ y)
    bins = np.clip((raw[use] + 1) / 3 * 2000, 0, 1999).astype(int)
    some = np.unique(bins)
    n, total = np.array([(bins == b).sum() for b in some], float), np.array([y[bins == b].sum() for b in some])
    levels, centre = isotonic(n, total), -1 + (some + 0.5) * 3 / 2000
    flat = np.unique(levels)
    knots = [np.average(centre[levels == v], weights=n[levels == v]) for v in flat]
    want = dict(zip([r["doc_id"] for r in docs], np.interp(raw, knots, flat), strict=True))
    got = queries.op5_quality_model(spark, compare.SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        assert abs(r["score"] - want[r["doc_id"]]) < 1e-6 and r["held_out"] == held[r["doc_id"]] and r["predicted"] == (r["score"] >= 0.3)
