"""Weighted rendezvous hashing of record keys over shards.

Each shard draws a number for the key; the shard whose draw, scaled by its weight, is best takes
the record.  A shard that is added can only win records for itself, so no record moves between
the others.  Only the key and the shards decide; a null key is a key like any other (all of its
rows share a shard).  Places within a shard are numbered in two steps, counts of many small
cells first, so that no task ever orders a whole shard.  A row's cell comes from a digest of its
key and of the columns carried, so rows of one frequent key are dealt over all cells.

Repeated rows each get a slot; keys of any type that casts to text will do; input columns called
shard, slot or grown_shard are replaced; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of a row's digest that name its cell.
CELL_DIGITS = 2


def _text_of(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit("null"))


def _draw(key: Column, shard: int) -> Column:
    """Uniform in 0 to 1, from 52 bits of a digest."""
    digest = F.md5(F.concat_ws("/", _text_of(key), F.lit(str(shard))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins; weights are positive."""
    if not weights or min(weights) <= 0:
        raise ValueError("there must be shards, all of positive weight")
    entries = [F.struct((F.log(_draw(key, i)) / F.lit(float(w))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return (-(F.greatest(*entries) if len(entries) > 1 else entries[0])["shard"]).cast("int")


def with_slots(rows: DataFrame, key: str, shard: str = "shard", ties: list[str] | None = None) -> DataFrame:
    """Adds ``slot``, gapless from 0 within each shard: by the cell, then by key and ties."""
    cell = F.substring(F.md5(F.concat_ws("/", *[_text_of(F.col(c)) for c in [key, *(ties or [])]])), 1, CELL_DIGITS)
    rows = rows.drop("slot").withColumn("_qm_cell", cell)
    counts = rows.groupBy(shard, "_qm_cell").agg(F.count(F.lit(1)).alias("_qm_n"))
    before = Window.partitionBy(shard).orderBy("_qm_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, "_qm_cell", F.coalesce(F.sum("_qm_n").over(before), F.lit(0)).alias("_qm_start"))
    within = Window.partitionBy(shard, "_qm_cell").orderBy(key, *(ties or []))
    placed = rows.withColumn("_qm_at", F.row_number().over(within) - 1)
    return placed.join(starts, [shard, "_qm_cell"]).withColumn("slot", F.col("_qm_start") + F.col("_qm_at")).drop("_qm_cell", "_qm_start", "_qm_at")


def assign_shards(docs: DataFrame, key: str, weights: list[float], carry: list[str] | None = None) -> DataFrame:
    """key, *carry, shard, slot, grown_shard (the shard if one more of the last weight were added)."""
    carry = [c for c in carry or [] if c not in (key, "shard", "slot", "grown_shard")]
    grown = shard_of(F.col(key), [*weights, weights[-1]])
    rows = docs.select(key, *carry, shard_of(F.col(key), weights).alias("shard"), grown.alias("grown_shard"))
    return with_slots(rows, key, ties=carry)

