"""Helpers shared by the operators: scratch tables, fresh column names, a blocked Bloom filter."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the word rules of this package know it: space and 0x09 to 0x0D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """Names that no column of the caller's table has, whatever its case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none, as in tests on one machine, a temporary folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir() or folder
    return f"{folder.rstrip('/')}/noticeflow"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to a new table in the shared folder and read it again.

    Parquet keeps column pruning and gives the planner a true size, so that a
    join with a table that turned out small can be broadcast by Spark's own limit.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_measured(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict]:
    """The written table and aggregates of its rows, taken by the tasks that write it: no job of their own, whose stages each cost the driver some MB."""
    seen = Observation()
    out = written(df.observe(seen, *[c.alias(k) for k, c in measures.items()]), name)
    return out, seen.get


def arrow_columns(batch: pa.RecordBatch, add: dict[str, pa.Array], drop: Iterable[str] = ()) -> pa.RecordBatch:
    """The batch with columns added or replaced, and some left out."""
    cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names) if n not in set(drop)}
    return pa.RecordBatch.from_pydict(cols | add)


#: Rows that a task works on at a time, so that what it makes of an Arrow batch stays small beside the batch.
ROWS = 256


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Lower the session's limits of an Arrow batch, where they are higher: whole texts are long, and each task holds several batches.

    They stay lowered for the session, as Spark reads them when a plan runs, which is after the operator returned.
    """
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        number = int(now.rstrip("bB")) if now and now.rstrip("bB").lstrip("-").isdigit() else 0
        if number <= 0 or number > most:
            spark.conf.set(key, str(most))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def with_fields(df: DataFrame, add: dict[str, T.DataType], drop: Iterable[str] = ()) -> T.StructType:
    """The schema that arrow_columns gives."""
    fields = {f.name: f for f in df.schema.fields if f.name not in set(drop)}
    return T.StructType([*(fields | {n: T.StructField(n, t) for n, t in add.items()}).values()])


# ------------------------------------------------------- blocked Bloom filter

#: Odd multipliers that pick one bit in each of a block's eight words.
SALTS = np.array(
    [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31], dtype=np.uint32
)
#: Blocks of 32 bytes; 2**18 of them are 8 MiB, which is the most that is ever broadcast.
MAX_BLOCKS = 1 << 18


def bloom_blocks(n_keys: int, bits_per_key: int = 16) -> int:
    """Blocks for so many keys, a power of two, never more than MAX_BLOCKS.

    Beyond that bound only the share of false positives rises; users of the
    filter remove those by an exact step.
    """
    want = max(1, n_keys * bits_per_key // 256)
    return min(MAX_BLOCKS, 1 << (want - 1).bit_length())


def bloom_places(hashes: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, masks) of 64-bit hashes: the upper half picks the block, the lower half a bit a word."""
    h = hashes.astype(np.int64, copy=False).view(np.uint64)
    block = ((h >> np.uint64(32)) & np.uint64(n_blocks - 1)).astype(np.int64)
    low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return block, np.uint32(1) << ((low[:, None] * SALTS[None, :]) >> np.uint32(27))


def bloom_build(keys: DataFrame, hash_col: str, n_blocks: int, slices: int = 16) -> np.ndarray:
    """Filter of a column of 64-bit hashes: each task ORs its own, slices are ORed again in a shuffle."""
    n_slices = min(slices, n_blocks)
    rows = n_blocks // n_slices

    def local(batches):
        import pandas as pd

        words = np.zeros((n_blocks, 8), np.uint32)
        some = False
        for pdf in batches:
            if len(pdf):
                block, masks = bloom_places(pdf.iloc[:, 0].to_numpy(), n_blocks)
                np.bitwise_or.at(words, block, masks)
                some = True
        if some:
            yield pd.DataFrame(
                {"slice": range(n_slices), "words": [words[i * rows : (i + 1) * rows].tobytes() for i in range(n_slices)]}
            )

    def merge(key, batches):
        import pandas as pd

        words = np.zeros(rows * 8, np.uint32)
        for pdf in batches:
            for b in pdf["words"]:
                words |= np.frombuffer(b, np.uint32)
        yield pd.DataFrame({"slice": [key[0]], "words": [words.tobytes()]})

    parts = (
        keys.select(F.col(hash_col).cast("long").alias("h")).where("h is not null")
        .mapInPandas(local, "slice int, words binary")
        .groupBy("slice").applyInPandas(iterated(merge), "slice int, words binary")
    )
    words = np.zeros((n_blocks, 8), np.uint32)
    for r in parts.collect():  # n_blocks * 32 bytes in all
        words[r["slice"] * rows : (r["slice"] + 1) * rows] = np.frombuffer(r["words"], np.uint32).reshape(rows, 8)
    return words


def iterated(fn):
    """A grouped function that gets its group in batches."""
    from collections.abc import Iterator

    import pandas as pd

    def run(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from fn(key, batches)

    run.__annotations__ = {"key": tuple, "batches": Iterator[pd.DataFrame], "return": Iterator[pd.DataFrame]}
    return run


def bloom_test(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    block, masks = bloom_places(hashes, len(words))
    return ((words[block] & masks) == masks).all(axis=1)
