"""Reversible dedup of lines: exact reference counts behind sharded cuckoo filters.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys of fewer than
``least`` code points are never looked at.  ``LineIndex`` keeps three tables in the shared folder:

- postings, a row a key and document that holds it;
- refs, the exact count of documents and the largest doc_id of each key;
- filters, a cuckoo filter a shard with the keys that ``min_docs`` documents or more hold.

``insert`` and ``delete`` add and subtract references and touch the filters only for keys whose count
crosses ``min_docs``, upward or downward; an insertion that is deleted again leaves the counts, the
postings and what the filters answer as they were.  ``rewrite`` asks the filters about the distinct
keys of the documents given; nearly all keys end there, and those that pass are looked up in refs, so a
false positive costs a look-up and never a line.  Keys are told apart by hashes of 128 bits.

No group holds more than the distinct keys of a shard: shards are dealt anew, and filters rebuilt from
refs, when there are over ``FULL`` keys a shard.  A key that a third of all documents hold is one
row everywhere but in postings, which are counted with partial sums and joined by ``join_counted``.

Rows that share a doc_id are one document that holds the lines of all of them; a null doc_id is one
document, below all others.  A null or empty text is one empty line.  Each row is rewritten by
itself; repeated rows come out repeated, other columns are carried as they are, no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .shared import join_counted, lean, lean_pair, stage

SPACE = b" \t\n\x0b\x0c\r"
#: Keys a shard when shards are dealt, and from which on they are dealt anew.
KEYS, FULL = 1 << 17, 1 << 18
POSTINGS, REFS, FILTERS = "key binary, doc_id long", "key binary, n long, last long", "shard int, filter binary"


class Cuckoo:
    """A multiset of 16-bit fingerprints, each in one of two buckets.  A table that is full is followed by one more of the same size.

    All entries of one fingerprint and pair of buckets are alike, so it does not matter which of them goes.
    """

    BUCKETS, SLOTS, KICKS = 4096, 4, 200

    def __init__(self, packed: bytes = b""):
        self.tables = list(np.frombuffer(packed, np.uint16).reshape(-1, self.BUCKETS, self.SLOTS).copy())

    def __bytes__(self) -> bytes:
        return b"".join(t.tobytes() for t in self.tables)

    def _other(self, bucket, mark):
        return bucket ^ ((mark * 0x9E37) >> 3 & (self.BUCKETS - 1))

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        halves = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        marks = (halves[:, 0] % np.uint64(65535)).astype(np.int64) + 1
        first = (halves[:, 1] % np.uint64(self.BUCKETS)).astype(np.int64)
        return marks, first, self._other(first, marks)

    def holds(self, keys: list[bytes]) -> np.ndarray:
        marks, first, second = self.places(keys)
        found = np.zeros(len(keys), bool)
        for t in self.tables:
            found |= (t[first] == marks[:, None]).any(1) | (t[second] == marks[:, None]).any(1)
        return found

    def add(self, keys: list[bytes]) -> None:
        for mark, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            if not any(self._put(t, mark, at) for t in self.tables for at in (a, b)):
                self._force(mark, a)

    def _put(self, table: np.ndarray, mark: int, at: int) -> bool:
        free = np.flatnonzero(table[at] == 0)
        if len(free):
            table[at, free[0]] = mark
        return len(free) > 0

    def _force(self, mark: int, at: int) -> None:
        """Push entries of the last table to their other buckets; the one left over begins a new table."""
        for turn in range(self.KICKS if self.tables else 0):
            table, slot = self.tables[-1], (mark + turn) % self.SLOTS
            table[at, slot], mark = mark, int(table[at, slot])
            at = self._other(at, mark)
            if self._put(table, mark, at):
                return
        self.tables.append(np.zeros((self.BUCKETS, self.SLOTS), np.uint16))
        self._put(self.tables[-1], mark, at)

    def remove(self, keys: list[bytes]) -> None:
        """Keys must be held."""
        for mark, a, b in zip(*(x.tolist() for x in self.places(keys)), strict=True):
            table, at = next((t, at) for t in self.tables for at in (a, b) if (t[at] == mark).any())
            table[at, np.flatnonzero(table[at] == mark)[0]] = 0


def key_of(line: bytes, least: int) -> bytes | None:
    """Hash of a line's key, None if the key is shorter than ``least`` code points."""
    key = line.strip(SPACE).lower()
    if len(key) < least or (not key.isascii() and len(key.decode()) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def postings_of(docs: DataFrame, least: int = 20) -> DataFrame:
    """(key, doc_id): each key once a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = [], []
            for i, text in zip(b.column("doc_id").to_pylist(), _texts(b.column("text")), strict=True):
                own = {key_of(x, least) for x in text.split(b"\n")} - {None}
                keys += own
                ids += [i] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), POSTINGS).distinct()


class LineIndex:
    """An index version; ``insert`` and ``delete`` return the next one and leave this one as it is."""

    def __init__(self, spark: SparkSession, min_docs: int = 3, least: int = 20):
        self.spark, self.min_docs, self.least, self.shards = spark, min_docs, least, 0
        self.postings, self.refs, self.filters = (spark.createDataFrame([], s) for s in (POSTINGS, REFS, FILTERS))

    def _next(self, **tables) -> LineIndex:
        new = object.__new__(LineIndex)
        new.__dict__ = self.__dict__ | tables
        return new

    def _by_shard(self, keys: DataFrame):
        return keys.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(max(1, self.shards))).cast("int")).groupBy("shard")

    def _changed(self, keys: DataFrame, change: str) -> DataFrame:
        """Filters after adding or removing keys; the order of keys is fixed, so a task that runs again does the same."""

        def run(rows: pa.Table, state: pa.Table) -> pa.Table:
            held = Cuckoo(b"".join(state["filter"].to_pylist()))
            if rows.num_rows:
                getattr(held, change)(sorted(rows["key"].to_pylist()))
            shard = (rows if rows.num_rows else state)["shard"][0].as_py()
            return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([bytes(held)], pa.binary())})

        return stage(self._by_shard(keys.select("key")).cogroup(self.filters.groupBy("shard")).applyInArrow(lean_pair(run), FILTERS), "filters")

    def insert(self, docs: DataFrame) -> LineIndex:
        """Count the lines of docs(doc_id, text); lines that a document of that doc_id has already count no more."""
        new = stage(postings_of(docs, self.least), "postings")
        if self.shards:
            known = self.postings.select(F.col("key").alias("_qm_key"), F.col("doc_id").alias("_qm_id"))
            new = stage(new.join(known, (F.col("key") == F.col("_qm_key")) & F.col("doc_id").eqNullSafe(F.col("_qm_id")), "left_anti"), "postings")
        counts = new.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        every = self.refs.withColumn("was", F.col("n")).unionByName(counts.withColumn("was", F.lit(0).cast("long")))
        refs = stage(every.groupBy("key").agg(F.sum("n").alias("n"), F.max("last").alias("last"), F.sum("was").alias("was")), "refs")
        frequent = refs.where(F.col("n") >= self.min_docs)
        after = self._next(postings=self.postings.unionByName(new), refs=refs.drop("was"))
        total = refs.count()
        if total > self.shards * FULL or not self.shards:
            after.shards, after.filters = max(8, total // KEYS), self.spark.createDataFrame([], FILTERS)
        else:
            frequent = frequent.where(F.col("was") < self.min_docs)
        after.filters = after._changed(frequent, "add")
        return after

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take back what the documents of ids(doc_id) have added."""
        ids = ids.select(F.col("doc_id").cast("long").alias("_qm_id")).distinct()
        same = F.col("doc_id").eqNullSafe(F.col("_qm_id"))
        left = stage(self.postings.join(ids, same, "left_anti"), "postings")
        lost = self.postings.join(ids, same, "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("lost"))
        touched = stage(self.refs.join(lost, "key"), "touched")
        last = left.join(touched.select("key"), "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("last"))
        fewer = touched.where("n > lost").select("key", (F.col("n") - F.col("lost")).alias("n")).join(last, "key")
        refs = stage(self.refs.join(touched.select("key"), "key", "left_anti").unionByName(fewer), "refs")
        rare = touched.where((F.col("n") >= self.min_docs) & (F.col("n") - F.col("lost") < self.min_docs))
        return self._next(postings=left, refs=refs, filters=self._changed(rare, "remove"))

    def _passed(self, keys: DataFrame) -> DataFrame:
        """Rows (key, n) whose key the filters may hold."""

        def run(rows: pa.Table, state: pa.Table) -> pa.Table:
            rows = rows.select(["key", "n"])
            held = Cuckoo(b"".join(state["filter"].to_pylist())) if rows.num_rows else None
            return rows.filter(pa.array(held.holds(rows["key"].to_pylist()), pa.bool_())) if held and held.tables else rows.slice(0, 0)

        return self._by_shard(keys).cogroup(self.filters.groupBy("shard")).applyInArrow(lean_pair(run), "key binary, n long")

    def rewrite(self, docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
        """doc_id, *carry, n_lines, n_dropped, kept_text: frequent lines stay only in the largest doc_id that the index has for them.

        docs need not be in the index: a new document loses all its lines that are frequent there.
        """
        own = stage(postings_of(docs, self.least), "postings")
        keys = own.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        exact = self.refs.where(F.col("n") >= self.min_docs).select("key", "last")
        told = stage(self._passed(keys).join(exact, "key"), "frequent")
        held = join_counted(own, told, "key", own.count()).where(~F.col("doc_id").eqNullSafe(F.col("last")))
        gone = held.groupBy(F.col("doc_id").alias("_qm_id")).agg(F.collect_list("key").alias("_qm_gone"))
        carry = [c for c in carry or [] if c not in ("doc_id", "text", "n_lines", "n_dropped", "kept_text")]
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).join(gone, F.col("doc_id").eqNullSafe(F.col("_qm_id")), "left").drop("_qm_id")
        names, least = ["doc_id", *carry], self.least

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for text, drop in zip(_texts(b.column("text")), b.column("_qm_gone").to_pylist(), strict=True):
                    lines, drop = text.split(b"\n"), set(drop or [])
                    kept = [x for x in lines if key_of(x, least) not in drop] if drop else lines
                    out.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
                n, dropped, texts = zip(*out, strict=True) if out else ((), (), ())
                made = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*names, "n_lines", "n_dropped", "kept_text"])

        made = [StructField("n_lines", LongType()), StructField("n_dropped", LongType()), StructField("kept_text", StringType())]
        return rows.mapInArrow(lean(run), StructType([rows.schema[c] for c in names] + made))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 3, least: int = 20, carry: list[str] | None = None) -> DataFrame:
    """LineIndex.rewrite of documents by an index of them all."""
    return LineIndex(docs.sparkSession, min_docs, least).insert(docs).rewrite(docs, carry)
