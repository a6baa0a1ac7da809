"""Shared helpers of the training-data operators: work tables and byte-level words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: The characters that end a word in the contracts that say ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"


#: For every open :func:`scratch`, the folders written within it.
_open_scratch: list[list[str]] = []


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` or, where the session names none, a part of the warehouse."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir')}/work-tables").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a read of files, not a recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if _open_scratch:
        _open_scratch[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Work tables written within are deleted at its end; what the yielded function writes stays."""
    made: list[str] = []
    _open_scratch.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        _open_scratch.pop()
        try:
            return materialize(df, name)
        finally:
            _open_scratch.append(made)

    try:
        yield keep
    finally:
        _open_scratch.remove(made)
        for path in made:
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def free_name(df_columns: list[str], wish: str) -> str:
    """``wish``, lengthened until no column of the table has that name."""
    taken = {c.lower() for c in df_columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def slices(batches, rows: int = 256):
    """Arrow batches cut small, so that a worker holds the Python objects of few texts at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


class WordHashes(dict):
    """64-bit hashes of words; words repeat, so they are kept, up to ``limit`` of them."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()
#: What this worker remembers for the operator that it works for.
_kept: list = []


def sole(remembered):
    """``remembered``, after what the worker remembers for other operators is forgotten: stages that follow each other share their workers."""
    if not _kept or _kept[0] is not remembered:
        for x in _kept:
            x.clear()
        _kept[:] = [remembered]
    return remembered


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(sole(_hashes).__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` words; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return out
