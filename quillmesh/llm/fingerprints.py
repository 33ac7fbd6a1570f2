"""Threshold-scaled sketches of documents, in DataFrame operations only.

A text's fingerprint keeps the hashes of its distinct word n-grams that lie below a fixed
fraction of the hash range, in order, in hexadecimal.  Which are kept does not depend on the
text, so fingerprints of unequal texts can be intersected and merged: the sketch of a union is
the union of the sketches.  Where none lies below, the smallest is kept, so that only a text
without words has an empty fingerprint; a union drops it again once any lies below.

That smallest hash stands for its text only against others of its kind: a sketch with hashes below
the fraction does not hold it, so likeness and containment of a text of n shingles say 0 with a
chance of (1 - fraction) ** n, whatever the two have in common.

Words are cut at ASCII white space and kept as they are.  Texts of fewer words than n are one
n-gram; null is the empty text; equal texts have equal fingerprints, however often they occur.
Texts of any length are hashed whole.  Operators here add columns to expressions only, and
``with_next`` reads doc_id and the value, so other columns never clash; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import Ranges, digest
from .shared import words_of

#: Share of the hash range that is kept.
FRACTION = 0.25


def bind(value: Column, use) -> Column:
    """use(value), with value computed once a row even if it is used many times."""
    return F.transform(F.array(value), use)[0]


def shingle_hashes(text: Column, n: int = 5) -> Column:
    """Hashes of a text's n-grams at each place, with repeats; empty without words."""

    def of_words(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        return F.when(F.size(h) >= n, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(words_of(text), lambda w: F.xxhash64(w)), of_words)


def sketch(text: Column, n: int = 5, fraction: float = FRACTION) -> Column:
    """Sorted array of the hashes kept."""
    most = F.lit(int(-(2**63) + fraction * 2**64))

    def of_all(h: Column) -> Column:
        kept = F.array_sort(F.array_distinct(F.filter(h, lambda x: x < most)))
        return F.when(F.size(h) == 0, h).otherwise(bind(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.array_min(h)))))

    return bind(shingle_hashes(text, n), of_all)


def as_text(kept: Column) -> Column:
    """The fingerprint as a string: 16 hexadecimal digits a hash."""
    return F.concat_ws("", F.transform(kept, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")))


def likeness(a: Column, b: Column) -> Column:
    """Share of the two sketches' union that both have, 1 for two empty ones."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Share of a that b has too, 1 for an empty a."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def merge(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Sketch of the union of two documents, from their sketches."""
    most = F.lit(int(-(2**63) + fraction * 2**64))
    below = F.array_sort(F.filter(F.array_union(a, b), lambda x: x < most))
    least = F.array_min(F.array_union(a, b))
    return F.when(F.size(below) > 0, below).when(least.isNotNull(), F.array(least)).otherwise(F.array().cast("array<bigint>"))


def with_next(docs: DataFrame, value: str, size: int = 8 << 20) -> DataFrame:
    """doc_id, value -> these and ``next``: the value of the document after, by falling doc_id (the last meets the first).

    Rows are cut into ranges of about ``size`` bytes each, and the first row of the range below
    stands in as a guest at the end of each, so no task sorts more than a range.  Rows of one
    doc_id come in the falling order of a digest of their values, and a doc_id that many rows
    repeat is cut into several ranges by it; null doc_id is the last.
    """
    ranges = Ranges(docs, value, size)
    rows = ranges.with_number(docs.select("doc_id", value), value, "_qm_part")
    own = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("id"), digest(F.col(value)).alias("digest"))
    firsts = rows.select("_qm_part", own.alias("own")).groupBy("_qm_part").agg(F.max("own").alias("_qm_first"))
    # one row a range: as many as the text has pieces
    order = Window.orderBy("_qm_part")
    last = Window.partitionBy()
    above = firsts.withColumn("_qm_to", F.coalesce(F.lead("_qm_part").over(order), F.min("_qm_part").over(last))).withColumnRenamed("_qm_part", "_qm_from")
    first = F.col("doc_id").eqNullSafe(F.col("_qm_first.id")) & (digest(F.col(value)) == F.col("_qm_first.digest"))
    guests = rows.join(above, (F.col("_qm_part") == F.col("_qm_from")) & first)
    guests = guests.select("doc_id", value, F.col("_qm_to").alias("_qm_part"), F.lit(1).alias("_qm_guest"))
    every = rows.withColumn("_qm_guest", F.lit(0)).unionByName(guests)
    w = Window.partitionBy("_qm_part").orderBy("_qm_guest", F.col("doc_id").desc_nulls_last(), digest(F.col(value)).desc())
    return every.withColumn("next", F.lead(value).over(w)).where("_qm_guest = 0").drop("_qm_part", "_qm_guest")
