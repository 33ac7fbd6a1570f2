"""Mixing of sources to target weights, in DataFrame operations only.

Sizes are summed a source; targets share the whole by weight and stop at ``most`` times what the
source has, the excess going to the others by weight until none is above.  That is a water level:
with sources in the order of cap over weight, those whose cap lies under the level keep the cap.

A document is then taken floor(rate) times, and once more if a number that its key and a seed decide falls among
those that its source takes; a rerun, or a lost executor, takes the same.  For that the documents of a source lie on a circle in the order of their
numbers, each as long as its words.  What is taken once more is an arc as long as the rate's fraction of the
circle, from the document's edge nearest to a place that the source's name and the seed decide.  At its end the
document whose middle (moved by a twentieth of its words at most, by a coin of its own) the arc reaches is taken.

So a source's sum is off its target by some half of one document at most, whatever the number of documents, and
over the seeds a document is taken once more with a chance that is the fraction where it is short beside the
arc; one that is more than 2.3 times as long as all further words asked for is not.  One law holds for all documents;
there is no rank by size.  A document without words has no place on the circle, and its coin alone decides.

Sums are shuffled, and, in the two strips of numbers a source where an arc begins and ends, what lies in them (a
4096th each, so that no source is sorted as a whole); documents stay where they are.  Null sources are a source of
their own, null sizes count as 0, a null doc_id is a key like any other, rows with words that repeat a doc_id
are taken alike, and no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Bits of a number, and of the strip that it lies in.  Strips share out the work and change no result.
BITS, STRIP_BITS = 52, 12


def number(key: Column, seed: str, start: int = 1) -> Column:
    """52 bits of a key's digest, from a hexadecimal digit on; null is a key like any other."""
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, start, 13), 16, 10).cast("long")


def uniform(key: Column, seed: str, start: int = 1) -> Column:
    return number(key, seed, start).cast("double") / float(1 << BITS)


def _cut(places: DataFrame, strips: DataFrame, at: DataFrame) -> DataFrame:
    """at(_qm_s, _qm_at) -> _qm_s, edge, draw: words of the documents whose points lie up to there, and the number after the last of theirs.

    places(source, strip, draw, point, size); strips(source, strip, words, before).
    """
    own = at.join(strips, F.col("_qm_s").eqNullSafe(F.col("source"))).where((F.col("before") <= F.col("_qm_at")) & (F.col("_qm_at") < F.col("before") + F.col("words")))
    own = stage(own.select("_qm_s", "_qm_at", F.col("strip").alias("_qm_strip"), "before"), "strip")
    met = places.join(own, F.col("source").eqNullSafe(F.col("_qm_s")) & (F.col("strip") == F.col("_qm_strip")))
    met = met.groupBy("_qm_s", "_qm_strip", "_qm_at", "before", "draw").agg(F.sum("size").alias("size"), F.max("point").alias("point"))
    earlier = F.sum("size").over(Window.partitionBy("_qm_s").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("_qm_in", F.col("before") + F.coalesce(earlier, F.lit(0)) + F.col("point") * F.col("size") <= F.col("_qm_at"))
    edge = F.first("before") + F.coalesce(F.sum(F.when(F.col("_qm_in"), F.col("size"))), F.lit(0))
    draw = F.coalesce(F.max(F.when(F.col("_qm_in"), F.col("draw"))) + 1, F.first("_qm_strip") * (1 << BITS - STRIP_BITS))
    return met.groupBy("_qm_s").agg(edge.alias("edge"), draw.alias("draw"))


def with_arcs(sizes: DataFrame, plan: DataFrame, seed: str) -> DataFrame:
    """plan with ``_qm_from``, ``_qm_to``, the first number of its source's arc and the one after its last, and ``_qm_over``, whether it goes on from 0."""
    draw = number(F.col("doc_id"), seed)
    strip = F.shiftright(draw, BITS - STRIP_BITS)
    # a middle of its own breaks ties, so that the only document of a source is not always left out
    point = 0.45 + 0.1 * uniform(F.col("doc_id"), seed, 14)
    places = sizes.where("size > 0").select("source", strip.alias("strip"), draw.alias("draw"), point.alias("point"), "size")
    strips = places.groupBy("source", "strip").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1))
    strips = stage(strips.withColumn("before", F.coalesce(before, F.lit(0))), "strips")
    start = uniform(F.col("_qm_source"), f"{seed}/") * F.col("_qm_size")
    begun = _cut(places, strips, plan.select(F.col("_qm_source").alias("_qm_s"), start.alias("_qm_at")))
    begun = begun.withColumnsRenamed({"draw": "_qm_from"})
    plan = plan.join(begun, F.col("_qm_source").eqNullSafe(F.col("_qm_s")), "left").drop("_qm_s")
    end = F.col("edge") + (F.col("_qm_rate") - F.floor("_qm_rate")) * F.col("_qm_size")
    plan = stage(plan.withColumn("_qm_end", end).withColumn("_qm_over", F.col("_qm_end") >= F.col("_qm_size")).drop("edge"), "begun")
    end = F.when(F.col("_qm_over"), F.col("_qm_end") - F.col("_qm_size")).otherwise(F.col("_qm_end"))
    ended = _cut(places, strips, plan.select(F.col("_qm_source").alias("_qm_s"), end.alias("_qm_at")))
    return plan.join(ended.select("_qm_s", F.col("draw").alias("_qm_to")), F.col("_qm_source").eqNullSafe(F.col("_qm_s")), "left").drop("_qm_s", "_qm_end")


def once_more(size: Column, key: Column, seed: str) -> Column:
    """Whether a document is taken once more, from its source's row of ``with_arcs``."""
    draw = number(key, seed)
    since, until = draw >= F.col("_qm_from"), draw < F.col("_qm_to")
    met = F.when(F.col("_qm_over"), since | until).otherwise(since & until)
    alone = uniform(key, seed) < F.col("_qm_rate") - F.floor("_qm_rate")
    return F.coalesce(F.when(size > 0, met).otherwise(alone), F.lit(False))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights in turn, by the order of the sources' code points, null last.  One row a source."""
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle)
    return sources.withColumn("weight", F.array(*map(F.lit, cycle))[place].cast("double"))


def targets(sources: DataFrame, most: int = 3) -> DataFrame:
    """(source, source_size, weight) -> the same with target and rate.  One row a source, never one a document.

    Sources of size 0 get target and rate 0.
    """
    every = Window.orderBy(F.col("_qm_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    s = sources.withColumn("_qm_cap", F.lit(most) * F.col("source_size"))
    s = s.withColumn("_qm_total", F.sum("source_size").over(whole)).withColumn("_qm_weights", F.sum("weight").over(whole))
    upto = every.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("_qm_caps", F.sum("_qm_cap").over(upto)).withColumn("_qm_used", F.sum("weight").over(upto))
    # capped if the level from all that come before it, this one still open, would lift it over its cap
    left = F.col("_qm_total") - (F.col("_qm_caps") - F.col("_qm_cap"))
    open_ = F.col("_qm_weights") - (F.col("_qm_used") - F.col("weight"))
    s = s.withColumn("_qm_full", left * F.col("weight") >= F.col("_qm_cap") * open_)
    spent = F.coalesce(F.sum(F.when(F.col("_qm_full"), F.col("_qm_cap"))).over(whole), F.lit(0))
    still = F.coalesce(F.sum(F.when(~F.col("_qm_full"), F.col("weight"))).over(whole), F.lit(0.0))
    level = (F.col("_qm_total") - spent) * F.col("weight") / still
    s = s.withColumn("target", F.when(F.col("_qm_full"), F.col("_qm_cap").cast("double")).otherwise(level))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return s.withColumn("rate", F.least(rate, F.lit(float(most)))).select("source", "source_size", "weight", "target", "rate")


def mix(sized: DataFrame, most: int = 3, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, ...) -> the same with source_size, target, copies.

    Input columns of these three names are replaced.
    """
    sized = sized.drop("source_size", "target", "copies")
    sizes = stage(sized.select("doc_id", "source", F.col("size").cast("long").alias("size")), "sizes")
    sums = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    plan = targets(cyclic_weights(sums), most).withColumnsRenamed({"source": "_qm_source", "source_size": "_qm_size", "target": "_qm_target", "rate": "_qm_rate"}).drop("weight")
    # written, so that its size is known when the join is planned, and documents are not shuffled if it is small
    plan = stage(with_arcs(sizes, stage(plan, "targets"), seed), "plan")
    rows = sizes.select(sized.columns) if set(sized.columns) == set(sizes.columns) else sized
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("_qm_source")))
    copies = F.floor("_qm_rate") + once_more(F.col("size"), F.col("doc_id"), seed).cast("long")
    return joined.select(*sized.columns, F.col("_qm_size").alias("source_size"), F.col("_qm_target").alias("target"), copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row as often as its copies say, numbered from 0 in ``copy``, which replaces an input column of that name; none for 0."""
    often = F.when(F.col("copies") > 0, F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return mixed.select(*[c for c in mixed.columns if c != "copy"], F.explode(often).alias("copy"))
