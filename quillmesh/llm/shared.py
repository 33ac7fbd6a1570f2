"""Pieces that several corpus operators share: tables, scratch space, words and hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import scratch as scratch
from ..scratch import stage as stage

#: A word is a longest run without ASCII white space; ``bytes.split()`` cuts at the same places.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_counted(rows: DataFrame, told: DataFrame, key: str, total: int, outer: bool = False) -> DataFrame:
    """rows with what ``told`` (key, n, ...: one row a key that n of ``total`` rows have) says of their key; outer keeps rows it does not name.

    Keys that more than a 256th of the rows have are 256 at most; they go to all executors, so that
    their rows stay where they are, and all others are shuffled.
    """
    told = told.withColumnRenamed(key, "_qm_key")
    often = F.col("n") * 256 > total
    hot, cold = told.where(often), told.where(~often)
    kept = rows.join(F.broadcast(hot.select("_qm_key")), F.col(key) == F.col("_qm_key"), "left_anti")
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("_qm_key")).unionByName(kept.join(cold, F.col(key) == F.col("_qm_key"), "left" if outer else "inner"))
    return out.drop("_qm_key", "n")


def words_of(text: Column) -> Column:
    """Array of the words of a text, empty for null; JVM only."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words met of late."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()
_MULTIPLIERS = np.random.default_rng(20).integers(0, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def rolling(words: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of each run of k words; the two families are independent of each other."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += _MULTIPLIERS[family, j] * words[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def release() -> None:
    """Gives back to the system what a Python worker no longer needs; workers live on from one operator to the next."""
    HASHES.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(run: Callable, forget: Callable[[], None] = lambda: None) -> Callable:
    """For ``mapInArrow``: ``run`` that forgets and releases when its partition ends."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()
            release()

    return mapped


def lean_group(run: Callable) -> Callable:
    """For ``applyInArrow`` of one table: ``run`` that releases after each group."""

    def applied(rows: pa.Table) -> pa.Table:
        try:
            return run(rows)
        finally:
            release()

    return applied


def lean_pair(run: Callable) -> Callable:
    """For ``applyInArrow`` of two tables: ``run`` that releases after each group."""

    def applied(rows: pa.Table, more: pa.Table) -> pa.Table:
        try:
            return run(rows, more)
        finally:
            release()

    return applied


def batches_of(rows: pa.Table | pa.RecordBatch, size: int = 64):
    """Slices of a few rows, so that what is made from long texts stays small."""
    for i in range(0, rows.num_rows, size):
        yield rows.slice(i, size)
