"""Paths of a vault, relative to its root and with ``/`` between their parts, as Column expressions.

Resolving is lexical: ``.`` and ``..`` are folded without looking at directories or links.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Folded path; the root is ``.``, and parts above it stay as ``..``."""

    def fold(done: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(done) > 0) & (F.coalesce(F.get(done, F.size(done) - 1), F.lit("")) != "..")
        return F.when(part.isin("", "."), done).when(up, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)
    text = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(text == "", ".").otherwise(text)


def tidy(path: Column) -> Column:
    """Without empty parts and ``.``, but with each ``..`` as it is."""
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    text = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return F.when(text == "", ".").otherwise(text)


def resolve(parent: Column, target: Column) -> Column:
    return normalize(F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", parent, target)))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def order_key(path: Column) -> Column:
    """Sorts as paths do, part by part."""
    return F.split(path, "/")


def home_of(path: Column, home: str = "") -> Column:
    """The folder of a path's vault, with its slash, where one relation holds many vaults and ``home`` is the pattern of their folders; else nothing."""
    return F.regexp_extract(path, f"^{home}", 0) if home else F.lit("")


def inner(path: Column, home: str = "") -> Column:
    """A path within its vault."""
    return F.regexp_replace(path, f"^{home}", "") if home else path
