"""Ranges of rows in the order of doc_id, of about equal bytes, found without sorting the rows themselves.

Rows are ordered by doc_id (null first) and then by a digest of their value, so a doc_id that a
third of all rows share is cut as well; only rows that are equal in both stay together.  The keys
alone are dealt into parts by Spark's sampled range partitioning; each part sums its bytes in order
and notes where a range ends.  A row finds its part by binary search among the parts' first keys, at
most ``PARTS``, and its range among that part's, which go to all executors: some 40 bytes a range,
so one of 8 MB makes them a 200,000th of the values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Parts at most, and keys in one at least while there are fewer.
PARTS, KEYS = 4096, 200_000


def digest(value: Column) -> Column:
    return F.md5(F.coalesce(value, F.lit("")))


def key_of(doc_id: Column, value: Column) -> Column:
    """Text that sorts as doc_id (null first) and then the digest do."""
    unsigned = F.lpad(F.hex(doc_id.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    return F.concat(F.coalesce(unsigned, F.lit("-")), digest(value))


def place_among(value: Column, cuts: Column, many: int) -> Column:
    """How many of the sorted cuts, an array of ``many`` at most, are not above a value, by binary search; 0 for null."""
    if not many:
        return F.lit(0)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(many.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))


class Ranges:
    """Ranges of docs(doc_id, value) of about ``size`` bytes each; ``n`` is their number, 1 at least.

    A row weighs its bytes and one mean row more, so that short ones count too: a range holds 2 *
    size bytes at most, or one value that is longer.
    """

    def __init__(self, docs: DataFrame, value: str, size: int):
        held = stage(docs.select(key_of(F.col("doc_id"), F.col(value)).alias("key"), F.coalesce(F.octet_length(value), F.lit(0)).cast("long").alias("bytes")), "keys")
        total, rows = held.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
        each = max(64, total // max(1, rows))
        self.n, self.firsts, self.fine, self.longest = 1, [], None, 0
        if total + each * rows <= 2 * size:
            return
        parts = held.repartitionByRange(max(1, min(PARTS, rows // KEYS)), "key").select("key", (F.col("bytes") + each).alias("weight"), F.spark_partition_id().alias("part"))
        before = Window.partitionBy("part").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        cut = F.floor(F.coalesce(F.sum("weight").over(before), F.lit(0)) / (2 * size))
        ends = stage(parts, "parts").select("part", "key", cut.alias("cut")).groupBy("part", "cut").agg(F.min("key").alias("key"))
        listed = ends.groupBy("part").agg(F.sort_array(F.collect_set("key")).alias("cuts"))
        start = F.coalesce(F.sum(F.size("cuts")).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.fine = stage(listed.withColumn("start", start.cast("int")), "ranges")
        seen = self.fine.select("part", F.get("cuts", F.lit(0)).alias("first"), F.size("cuts").alias("many")).orderBy("part").collect()
        self.firsts = [(r["first"], r["part"]) for r in seen]
        self.longest, self.n = max(r["many"] for r in seen), sum(r["many"] for r in seen)

    def with_number(self, rows: DataFrame, value: str, name: str) -> DataFrame:
        """rows with the number of each one's range, which rises with the order."""
        if self.fine is None:
            return rows.withColumn(name, F.lit(0))
        firsts = F.split(F.lit(",".join(k for k, _ in self.firsts)), ",")
        numbers = F.split(F.lit(",".join(str(p) for _, p in self.firsts)), ",").cast("array<int>")
        key = key_of(F.col("doc_id"), F.col(value))
        # a key below all that were seen cannot be, but counts as the first
        part = F.get(numbers, F.greatest(F.lit(0), place_among(key, firsts, len(self.firsts)) - 1))
        fine = F.broadcast(self.fine.select(F.col("part").alias("_qm_own"), F.col("cuts").alias("_qm_cuts"), F.col("start").alias("_qm_start")))
        joined = rows.withColumns({"_qm_key": key, "_qm_in": part}).join(fine, F.col("_qm_in") == F.col("_qm_own"))
        number = F.col("_qm_start") + F.greatest(F.lit(0), place_among(F.col("_qm_key"), F.col("_qm_cuts"), self.longest) - 1)
        return joined.select(*rows.columns, number.cast("int").alias(name))
