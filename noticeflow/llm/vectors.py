"""What the operators on vectors share: sound rows, whole components, packs of rows as matrices, exact inner products."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least and greatest number that a long holds; an exact score beyond them is returned as the nearer one.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
PACKED = "dim int, wide int, block int, ids binary, data binary, tags binary"


def sound(vector: Column) -> Column:
    """Whether a vector is there, has components, and all of them are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double: from 2**53 on every double is whole, so that no size is an error."""
    def one(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a block: ids, components as a matrix of the narrowest type, and tags (labels or repeats), in bytes."""
    data = np.stack(pdf["v"].to_numpy())
    most = np.abs(data).max()
    kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "f8"
    keys = (pdf["tag"].to_numpy(np.int64), pdf["id"].to_numpy(np.int64))
    if pdf["id"].duplicated().any():  # rows that share an id, in an order of their own
        keys = (*data.T[::-1], *keys)
    by_id = np.lexsort(keys)  # in order of id, so that ties are settled by place
    column = lambda name: pdf[name].to_numpy(np.int64)[by_id].tobytes()
    return pd.DataFrame({
        "dim": [pdf["dim"].iloc[0]], "wide": [pdf["wide"].iloc[0]], "block": [pdf["block"].iloc[0]],
        "ids": [column("id")], "data": [kind.encode() + data[by_id].astype(kind).tobytes()], "tags": [column("tag")],
    })


def matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data[2:], data[:2].decode()).reshape(-1, dim)


def blocks(rows: DataFrame, n_rows: int, size: int) -> DataFrame:
    """Rows (id, v, dim, tag), each once, dealt by their content into packs of about ``size``; those with large components apart.

    The place depends on nothing but the row, so that a task that runs again deals it alike.
    """
    n = max(1, -(-n_rows // size))
    wide = F.exists("v", lambda x: F.abs(x) >= float(1 << 23)).cast("int")
    dealt = rows.withColumns({"wide": wide, "block": F.pmod(F.xxhash64("id", "v", "tag"), F.lit(n)).cast("int")})
    return dealt.groupBy("dim", "wide", "block").applyInPandas(pack, PACKED)


def exact_type(a: np.ndarray, b: np.ndarray):
    """The fastest number type in which all inner products of rows of a and b are exact; Python's own integers where no other is."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64 if most < 2**63 else object


def converted(m: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return m.astype(kind)
    return np.frompyfunc(int, 1, 1)(m) if m.size else m.astype(object)


def as_long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        return np.array([max(LEAST, min(MOST, int(s))) for s in scores], np.int64)
    return scores.astype(np.int64)


def order_key(score: int) -> bytes:
    """Bytes that sort as the integers do, of any size: sign and length, then the number, from its highest byte on."""
    n = (abs(score).bit_length() + 7) // 8
    return (32768 + n).to_bytes(2, "big") + score.to_bytes(n, "big") if score >= 0 else (32767 - n).to_bytes(2, "big") + (score + (1 << 8 * n)).to_bytes(n, "big")


def from_key(key: bytes) -> int:
    n = int.from_bytes(key[:2], "big") - 32768
    return int.from_bytes(key[2:], "big") if n >= 0 else int.from_bytes(key[2:], "big") - (1 << 8 * (-n - 1))


def lengths(m: np.ndarray) -> np.ndarray:
    """Euclidean lengths, also of rows whose squares are beyond a double."""
    m = m.astype(np.float64)
    most = np.abs(m).max(axis=1, initial=0)
    return np.sqrt(((m / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1)) * most


def directions(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.maximum(np.abs(m).max(axis=1, initial=0), 1e-300)[:, None]
    n = np.sqrt((m**2).sum(axis=1))
    return m / np.where(n > 0, n, 1)[:, None]
