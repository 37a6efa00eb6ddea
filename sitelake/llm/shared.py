"""Helpers of the training-data operators: table access, files in the shared folder, vectorised text hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.session import ensure_checkpoint_dir

# Words of every contract: runs of anything but space, tab, LF, VT, FF, CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path under the folder that ``spark.checkpoint.dir`` names."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a table that this run wrote and no later plan reads."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


class Written:
    """A table written once to the shared folder, read back, and deletable when no plan needs it any more."""

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = shared_path(self.spark, label)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete_path(self.spark, self.path)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back."""
    return Written(df, label).df


def uniform(*parts: Column, salt: str) -> Column:
    """A reproducible uniform number in (0, 1) from the md5 of the parts (null as empty)."""
    return (hash52(*parts, salt=salt).cast("double") + 0.5) / float(1 << 52)


def hash52(*parts: Column, salt: str) -> Column:
    """52 bits of the md5 of ``salt|part|part...`` as a non-negative long (null parts as empty)."""
    text = F.concat_ws("|", F.lit(salt), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` as an Arrow task that gives freed memory back to the system when it ends: Python workers are kept between stages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
            trim(0)

    return task


# ---- vectorised hashing inside Arrow tasks -------------------------------------------------------------------

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of a UTF-8 text, all words at once.

    A word's hash is a polynomial over a random 64-bit number per byte, taken from prefix sums, so it depends on the
    word's bytes alone. ``words`` lower-cases A-Z first.
    """

    def __init__(self) -> None:
        self.byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        for b in range(65, 91):  # A-Z hash as a-z
            self.byte[b] = self.byte[b + 32]
        self.space = np.zeros(256, dtype=bool)
        self.space[[32, 9, 10, 11, 12, 13]] = True
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        power = np.empty(n, dtype=np.uint64)
        power[0] = 1
        power[1:] = np.uint64(_BASE)
        self.power = np.multiply.accumulate(power)
        inverse = np.empty(n, dtype=np.uint64)
        inverse[0] = 1
        inverse[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
        self.inverse = np.multiply.accumulate(inverse)

    def bounds(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of every word."""
        inside = np.empty(len(raw) + 2, dtype=np.int8)
        inside[0] = inside[-1] = 0
        np.logical_not(self.space[raw], out=inside[1:-1].view(bool))
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start byte and end byte of every word."""
        raw = np.frombuffer(text, dtype=np.uint8)
        if len(raw) >= len(self.power):
            self._grow(2 * len(raw))
        start, end = self.bounds(raw)
        total = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(self.byte[raw] * self.power[: len(raw)], out=total[1:])
        value = (total[end] - total[start]) * self.inverse[start]
        return mix64(value + (end - start).astype(np.uint64)), start, end


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` word hashes; the whole sequence as one when it is shorter; none without words."""
    if len(words) == 0:
        return words
    n = min(k, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        out = (out * np.uint64(_BASE)) ^ words[i : len(words) - n + 1 + i]
        out = out + (out >> np.uint64(29))
    return mix64(out)
