"""Normalising rewrites of image links: a plan of renames and new texts, and its application.

The plan is what a walk over the documents in the order of their paths, and in each from its last link to its first,
would do: each link that is not canonical renames its file, unless a file of the canonical name is there
already or the file is not; then all links of the document that lead nowhere at that moment are cut out.  What
one rename does another may see, so the order matters, but only among links that look at a common path:
all that come first at every path that they look at are decided at once, then those that now come first, until
none is left (``decide``).  A file's times at its places are then known, and texts are rewritten independently of each other.

A target that occurs again in one folder is decided where it occurs first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import paths
from ..functions import text as fn
from ..operators import extract, resolve, rules
from ..scratch import stage
from ..sources import vault
from ..sources.vault import chosen_files, inventory
from . import lint

EDIT = "path string, new_text string, fixed boolean, normalized_links int, removed_links int, renamed_files int, remaining array<struct<line:int,code:string,message:string>>"


def ways(links: DataFrame) -> DataFrame:
    """What each link that is not canonical would look at and do, once a folder and target: at its first occurrence, ``rank``.

    tries and canonical: the places looked at in order; folder and new make the destination.
    """
    target, new = F.col("target"), fn.canonical_target(F.col("target"))
    rows = links.where(fn.needs_normalization(target)).select(paths.parent(F.col("path")).alias("folder"), "target", F.struct(paths.order_key(F.col("path")).alias("doc"), (-F.col("target_start")).alias("turn")).alias("rank"))
    first = rows.groupBy("folder", "target").agg(F.min("rank").alias("rank"))
    own = F.concat(F.col("folder"), F.lit("/_"))
    single = F.size(F.filter(F.split(fn.percent_decode(target), "/"), lambda x: ~x.isin("", "."))) == 1
    return first.select("rank", "folder", new.alias("new"), single.alias("single"), resolve.image_candidates(own, target).alias("tries"), resolve.image_candidates(own, new).alias("canonical"))


def decide(waiting: DataFrame, there: DataFrame) -> DataFrame:
    """source, destination, doc, turn of the renames that all links together bring about; there is the inventory.  A round a link at most that others wait for."""
    looked = lambda rows: rows.select("rank", F.explode(F.array_union("tries", "canonical")).alias("path"))
    moves, waiting = None, stage(waiting, "waiting")
    now = stage(there.select("path").join(looked(waiting).select("path").distinct(), "path"), "there")
    while True:
        looks = looked(waiting)
        first = looks.groupBy("path").agg(F.min("rank").alias("first"))
        behind = stage(looks.join(first, "path").where("rank > first").select("rank").distinct(), "behind")
        ready = waiting.join(behind, "rank", "left_anti")
        seen = looked(ready).join(now, "path").groupBy("rank").agg(F.collect_set("path").alias("seen"))
        hit = F.filter("tries", lambda p: F.array_contains("seen", p))
        rows = ready.join(seen, "rank").where(~F.arrays_overlap("canonical", "seen")).select("rank", "folder", "new", "single", F.get(hit, F.lit(0)).alias("source")).where("source IS NOT NULL")
        beside = paths.resolve(paths.parent(F.col("source")), paths.name(F.col("new")))
        to = F.when(F.col("new").startswith("/"), F.col("new")).when(F.col("single"), beside).otherwise(paths.resolve(F.col("folder"), F.col("new")))
        made = stage(rows.select("source", to.alias("destination"), F.col("rank.doc").alias("doc"), F.col("rank.turn").alias("turn")).where("source <> destination"), "moves")
        moves = made if moves is None else moves.unionByName(made)
        if behind.isEmpty():
            return moves
        waiting = stage(waiting.join(behind, "rank", "left_semi"), "waiting")
        gone = made.select(F.col("source").alias("path"))
        now = stage(now.join(gone, "path", "left_anti").unionByName(made.select(F.col("destination").alias("path"))), "there")


def spans(there: DataFrame, moves: DataFrame) -> DataFrame:
    """path, born, died: what is where, from which document on and up to which; null for ever."""
    events = moves.select(F.col("destination").alias("path"), F.struct("doc", "turn").alias("at"), F.lit(True).alias("comes")).unionByName(moves.select(F.col("source").alias("path"), F.struct("doc", "turn").alias("at"), F.lit(False).alias("comes")))
    by_path = events.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("at", "comes"))).alias("e"))
    known = there.select("path", F.lit(True).alias("old")).join(by_path, "path", "full")
    none = F.lit(None).cast("array<string>")
    e, many = F.col("e"), F.coalesce(F.size("e"), F.lit(0))
    # comings and goings of a path take turns; an old one begins with a time that has no beginning
    first = F.when(F.col("old"), F.array(F.struct(none.alias("born"), F.get(e, F.lit(0))["at"]["doc"].alias("died")))).otherwise(F.array())
    later = F.filter(F.transform(F.coalesce(e, F.array()), lambda x, i: F.when(x["comes"], F.struct(x["at"]["doc"].alias("born"), F.when(i + 1 < many, F.get(e, i + 1)["at"]["doc"]).alias("died")))), lambda x: x.isNotNull())
    return known.select("path", F.inline(F.concat(first, later)))


def _alive(path: Column) -> Column:
    """Whether a span holds after all renames of the document of that path."""
    now = paths.order_key(path)
    return (F.col("born").isNull() | (F.col("born") <= now)) & (F.col("died").isNull() | (F.col("died") > now))


def rewritten(raw: str, new: str, kind: str) -> str:
    """A raw target with its path replaced.  Titles, brackets and aliases stay; a Markdown target loses its fragment."""
    if kind == "obsidian":
        path, bar, alias = raw.partition("|")
        _, mark, fragment = path.partition("#")
        return f"{new}{mark}{fragment}{bar}{alias}"
    body = raw.strip()
    before, after = raw[: len(raw) - len(raw.lstrip())], raw[len(raw.rstrip()) :]
    if body.startswith("<") and ">" in body:
        return f"{before}<{new}>{body[body.index('>') + 1 :]}{after}"
    path = re.match(r"\S+", body)
    rest = body[path.end() :] if path else ""
    return f"{before}{new}{rest if re.match(r'\s+[\'\"(]', rest) else ''}{after}"


def splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Edits (start, end, new) one after the other from the last start to the first, each on what the ones before it have left: in linear time.

    Where one reaches into another, it takes as many characters of what stands there now.
    """
    done, at = [], len(text)  # pieces behind ``at``, the first of them last
    for a, b, new in sorted(edits, reverse=True):
        done.append(text[a:at])
        drop = b - a
        while drop and done:
            piece = done.pop()
            if len(piece) > drop:
                done.append(piece[drop:])
            drop = max(0, drop - len(piece))
        done.append(new)
        at = a
    done.append(text[:at])
    return "".join(reversed(done))


def _edited(docs: DataFrame, edits: DataFrame, name: str, spliced) -> DataFrame:
    """docs with ``name`` in place of text, the text after each one's edits, changes, their number, and the image links of the new text: one pass, written."""
    rows = docs.join(edits, "path", "left")
    keep = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                each = [e or [] for e in part.column("edits").to_pylist()]
                new = [splice(t or "", [spliced(x) for x in e]) for t, e in zip(part.column("text").to_pylist(), each, strict=True)]
                made = [pa.array(new, pa.string()), pa.array([len(e) for e in each], pa.int32()), *extract.parts_array(["images"], new)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, name, "changes", "images"])

    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    return stage(rows.mapInArrow(run, ", ".join([f"{c} {types[c]}" for c in keep] + [f"{name} string, changes int, images {schemas.PARTS['images']}"])), "edited", "zstd")


def plan(files: DataFrame, chosen: list[str] | None = None, home: str = "") -> tuple[DataFrame, DataFrame]:
    """(renames, edits): source and destination of each file that ends elsewhere; and rows as in EDIT, with the findings that stay in each document.

    Three passes over texts: to find links, to make them canonical, and to cut out broken ones.
    """
    wanted = chosen_files(chosen or ["sources", "wiki"], ".md", home=home)
    rows = lint.whole(files).withColumn("wanted", wanted & F.col("error").isNull())
    held = stage(extract.parse(rows.withColumn("whole", F.when(F.col("wanted"), F.col("text"))), ["images"], ["path", "is_dir", "link", "wanted", "whole"], F.col("wanted")), "parsed", "zstd")
    there, links = stage(inventory(held), "inventory"), resolve.link_table(held)
    found = held.select("path", F.inline("images"))
    moves = decide(ways(found), there)
    alive = stage(spans(there, moves), "spans")

    new = fn.canonical_target(F.col("target"))
    edits = found.where(fn.needs_normalization(F.col("target"))).groupBy("path").agg(F.collect_list(F.struct("target_start", "target_end", "raw_target", new.alias("new"), "kind")).alias("edits"))
    # texts without image links stay as they are; of the others a digest tells whether they change
    plain, imaged = held.where("wanted AND size(images) = 0"), held.where("wanted AND size(images) > 0")
    docs = imaged.select("path", F.md5("whole").alias("old"), F.col("whole").alias("text"))
    mid = _edited(docs, edits, "mid", lambda x: (x["target_start"], x["target_end"], rewritten(x["raw_target"], x["new"], x["kind"])))
    cuts = _targets(mid, alive, links).where("resolved IS NULL").groupBy("path").agg(F.collect_list(F.struct("start", "end")).alias("edits"))
    kept = mid.select("path", "old", F.col("changes").alias("normalized_links"), F.col("mid").alias("text"))
    last = _edited(kept, cuts, "new_text", lambda x: (x["start"], x["end"], ""))
    stays = rules.emit(_targets(last, alive, links), rules.img002(), rules.img001()).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "place", "code", "message"))).alias("r"))
    stays = stays.select("path", F.transform("r", lambda x: F.struct(x["line"].alias("line"), x["code"].alias("code"), x["message"].alias("message"))).alias("remaining"))
    renamed = moves.groupBy(F.array_join("doc", "/").alias("path")).agg(F.count(F.lit(1)).cast("int").alias("renamed_files"))
    out = last.join(stays, "path", "left").join(renamed, "path", "left")
    none = F.array().cast("array<struct<line:int,code:string,message:string>>")
    changed = F.md5("new_text") != F.col("old")
    same = plain.select("path", F.coalesce("whole", F.lit("")).alias("new_text"), F.lit(False).alias("fixed"), *[F.lit(0).alias(c) for c in ("normalized_links", "removed_links", "renamed_files")], none.alias("remaining"))
    edited = out.select("path", "new_text", changed.alias("fixed"), "normalized_links", F.col("changes").alias("removed_links"), F.coalesce("renamed_files", F.lit(0)).alias("renamed_files"), F.coalesce("remaining", none).alias("remaining"))
    return net(moves), edited.unionByName(same)


def _targets(edited: DataFrame, alive: DataFrame, links: DataFrame | None) -> DataFrame:
    return resolve.image_targets(edited.select("path", F.inline("images")), alive, links, _alive(F.col("path")))


def remaining(edits: DataFrame) -> DataFrame:
    """Diagnostics that a plan leaves, as the linter would give them for each document once it is fixed."""
    rows = edits.select("path", F.posexplode("remaining").alias("at", "r"))
    return rows.select("path", "r.line", "r.code", "r.message", F.lit(False).alias("warning"), F.array("at").alias("place"))


def net(moves: DataFrame) -> DataFrame:
    """source, destination of each file from where it is to where it ends, however often it moves in between; a round a move."""
    every = moves.select(F.col("source").alias("_from"), F.col("destination").alias("_to"), F.struct("doc", "turn").alias("_at"))
    now = every.toDF("source", "destination", "at")
    onward = lambda rows: rows.join(every, (F.col("destination") == F.col("_from")) & (F.col("_at") > F.col("at"))).groupBy("source", "at").agg(F.min(F.struct("_at", "_to")).alias("n"))
    more = onward(now)
    if not more.isEmpty():
        now = stage(now.join(more.select(F.col("n._at").alias("at")).distinct(), "at", "left_anti"), "chains")
        while not (more := stage(onward(now), "onward")).isEmpty():
            now = stage(now.join(more, ["source", "at"], "left").select("source", F.coalesce("n._to", "destination").alias("destination"), F.coalesce("n._at", "at").alias("at")), "chains")
    return now.select("source", "destination").where("source <> destination")


def apply(root: str, renames: DataFrame, edits: DataFrame) -> dict[str, int]:
    """Carries out a plan on a directory that all executors reach: all of it or, if a task or the job fails, nothing (see sources.vault).

    Counts come from the plan, so that a task that runs again changes none.
    """
    moves, texts = stage(renames, "renames"), stage(edits, "edits")
    changes = moves.select(F.col("destination").alias("path"), F.lit(None).cast("string").alias("text"), "source")
    vault.write(changes.unionByName(texts.where("fixed").select("path", F.col("new_text").alias("text"), F.lit(None).cast("string").alias("source"))), root)
    sums = [F.coalesce(F.sum(c), F.lit(0)) for c in ("normalized_links", "renamed_files", "removed_links")]
    links, renamed, removed = texts.agg(*sums).first()
    return {"fixed_files": texts.where("fixed").count(), "normalized_links": links, "renamed_files": renamed, "removed_links": removed}
