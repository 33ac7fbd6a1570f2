"""Joins of link targets with the file inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as fn
from ..scratch import stage


def link_table(files: DataFrame) -> DataFrame | None:
    """path, link of each link among the files; None if there is none, as in nearly every vault."""
    if "link" not in files.columns:
        return None
    links = files.where(F.col("link").isNotNull()).select("path", "link")
    return None if links.isEmpty() else stage(links, "links")


def follow(rows: DataFrame, column: str, links: DataFrame | None, rounds: int = 40) -> DataFrame:
    """rows with the links in a path column followed, the outermost first, until none is left; null where they go round.

    Each distinct path is followed once, in a join a round.
    """
    if links is None:
        return rows
    now, done = stage(rows.select(F.col(column).alias("start"), F.col(column).alias("now")).where("start IS NOT NULL").distinct(), "paths"), None
    for _ in range(rounds):
        parts = F.split("now", "/")
        prefixes = now.select("start", "now", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("parts"))
        prefixes = prefixes.withColumn("path", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/"))
        rest = F.array_join(F.slice("parts", F.col("k") + 1, F.greatest(F.lit(0), F.size("parts") - F.col("k"))), "/")
        first = prefixes.join(links, "path").groupBy("start").agg(F.min(F.struct("k", F.concat_ws("/", "link", rest).alias("to"))).alias("hit"))
        moved = stage(now.join(first, "start", "left").select("start", paths.normalize(F.coalesce("hit.to", "now")).alias("now"), F.col("hit").isNotNull().alias("again")), "paths")
        settled = moved.where("NOT again").drop("again")
        done, now = settled if done is None else done.unionByName(settled), moved.where("again").drop("again")
        if now.isEmpty():
            break
    told = done.select(F.col("start").alias(column), F.col("now").alias("_followed"))
    return rows.join(told, column, "left").drop(column).withColumnRenamed("_followed", column).select(rows.columns)


def first_hit(rows: DataFrame, candidates: Column, there: DataFrame, keys: list[str], links: DataFrame | None = None, alive: Column | None = None) -> DataFrame:
    """rows with ``resolved``: the first of the candidate paths that exists, null if none does.

    keys name a row.  ``there`` has paths; of those that ``alive``, on columns of both, holds for.  Rows are read once.
    """
    rest = [c for c in rows.columns if c not in keys]
    tried = follow(rows.select("*", F.posexplode(candidates).alias("_try", "_path")), "_path", links)
    there = there.withColumnRenamed("path", "_there")
    same = F.col("_path") == F.col("_there")
    hit = F.when(F.col("_there").isNotNull(), F.struct("_try", "_path"))
    found = tried.join(there, same if alive is None else same & alive, "left").groupBy(*keys).agg(F.first(F.struct(*rest)).alias("_row"), F.min(hit).alias("_hit"))
    return found.select(*[F.col(f"_row.{c}").alias(c) if c in rest else F.col(c) for c in rows.columns], F.col("_hit._path").alias("resolved"))


def wiki_targets(rows: DataFrame, there: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Local links with their target (no fragment) and what it resolves to: as written first, then decoded."""
    target = fn.strip_fragment(F.col("target"))
    local = rows.where(~fn.external_in_wiki(F.col("target"))).withColumn("target", target).where("target <> ''")
    parent = paths.parent(F.col("path"))
    tries = F.transform(F.array_distinct(F.array(F.col("target"), fn.percent_decode(F.col("target")))), lambda t: paths.resolve(parent, t))
    return first_hit(local, tries, there, ["path", "ord"], links)


def image_candidates(path: Column, target: Column) -> Column:
    """Each spelling beside the document and, if it is one name, in ``images`` there; absolute ones as they are."""
    parent = paths.parent(path)

    def of(t: Column) -> Column:
        beside, below = paths.resolve(parent, t), paths.resolve(F.concat(parent, F.lit("/images")), t)
        single = F.size(F.filter(F.split(t, "/"), lambda x: ~x.isin("", "."))) == 1
        return F.when(t.startswith("/") | ~single, F.array(beside)).otherwise(F.array(beside, below))

    return F.array_distinct(F.flatten(F.transform(fn.spellings(target), of)))


def image_targets(rows: DataFrame, there: DataFrame, links: DataFrame | None = None, alive: Column | None = None) -> DataFrame:
    return first_hit(rows, image_candidates(F.col("path"), F.col("target")), there, ["path", "start"], links, alive)
