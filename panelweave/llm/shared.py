"""What the operators share: reading tables, the shared folder, bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that Python handles at once; one longer text is still handled whole.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where the session did not set a path."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where all runs in one process, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, which cuts the lineage and outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """A fixed number of partitions, for work that is in the CPU and not in the bytes: those would be joined to a few by their size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` holds about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, done + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def pack_bits(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts codes of 1 to 32 bits one after another, the highest bit first.

    Returns the bytes and each code's bit offset, the end included. Codes that
    touch the same 32-bit word are added together, word by word.
    """
    ends = np.cumsum(lengths, dtype=np.int64)
    offsets = np.concatenate(([0], ends))
    if not len(values):
        return np.zeros(0, np.uint8), offsets
    at = offsets[:-1]
    word = at >> 5
    room = 64 - lengths.astype(np.int64) - (at & 31)
    both = values.astype(np.uint64) << room.astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words = np.zeros(int(word[-1]) + 2, np.uint64)
    words[word[first]] = np.add.reduceat(both >> np.uint64(32), first)
    words[word[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").view(np.uint8)[: (int(ends[-1]) + 7) // 8], offsets


def windows32(data: np.ndarray) -> np.ndarray:
    """For each byte offset the 32 bits from there on, zeros beyond the end."""
    x = np.concatenate((data, np.zeros(4, np.uint8))).astype(np.uint32)
    return (x[:-4] << 24) | (x[1:-3] << 16) | (x[2:-2] << 8) | x[3:-1]
