"""``spark.read.format("vault").load(root)``: every file and directory below a root, empty ones too; and the way back.

Reading.  Paths are relative to the root.  Texts are strict UTF-8 with line feeds only; a file that is not, or
that cannot be opened, has a null text, keeps its size and says why in ``error``.  A symbolic link that stays within the root has its
target in ``link``, and is not entered; one that leads out is what it leads to; one that leads nowhere is left out.  Options: ``suffixes``
(comma-separated) limits the files whose texts are read, ``partitions`` the number of tasks.  With a schema that has no
``text`` no file is opened; filters on ``path`` and ``is_dir`` are decided before a file is opened, where the
session has ``spark.sql.python.filterPushdown.enabled``.

Writing.  ``changes.write.format("vault").mode("append").save(root)`` takes rows (path, text, source): a text
is the new content of its path, a source a file that moves to its path.  Tasks write new texts, and lists
of what is to be done, below ``.quillmesh-writes`` in the root; the commit first notes that it has begun, then moves
sources aside, moves them to their places, and puts each new text in place by one rename.  So a job that
fails changes nothing, a file is at all times whole, old or new, and ``recover`` ends a commit that was cut off, or
clears away what a lost job has left.  No path and no text passes through the driver's plan; messages name one list a task.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, Not, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import schemas
from ..functions import paths

WRITES = ".quillmesh-writes"
CHANGE = "path string, text string, source string"


class Part(InputPartition):
    """Directories, and whether all below each belongs to it or only its own files."""

    def __init__(self, units: list[tuple[str, bool]]):
        self.units = units


class VaultReader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str] | None = None):
        self.root = options["path"].removeprefix("file://")
        self.suffixes = tuple(s.strip() for s in options.get("suffixes", ".md,.html").split(","))
        self.count = int(options.get("partitions", "64"))
        self.columns = columns or [c.split()[0] for c in schemas.FILE.split(", ")]
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on path and is_dir; Spark keeps the others."""
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, (EqualTo, In, StringStartsWith, StringEndsWith)) and inner.attribute in (("path",), ("is_dir",)):
                self.filters.append(f)
            else:
                yield f

    def _kept(self, path: str, is_dir: bool) -> bool:
        row = {("path",): path, ("is_dir",): is_dir}

        def holds(f: Filter) -> bool:
            if isinstance(f, Not):
                return not holds(f.child)
            value = row[f.attribute]
            if isinstance(f, EqualTo):
                return value == f.value
            if isinstance(f, In):
                return value in f.value
            return value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value)

        return all(map(holds, self.filters))

    def _folders(self, name: str) -> list[str]:
        with os.scandir(os.path.join(self.root, name)) as found:
            return sorted(os.path.normpath(os.path.join(name, e.name)) for e in found if e.is_dir(follow_symlinks=False) and e.name != WRITES)

    def partitions(self) -> list[Part]:
        """The driver opens directories, the widest levels first, until there are enough for the tasks, which walk what is below."""
        opened, waiting = [], ["."]
        while waiting and len(opened) + len(waiting) < 4 * self.count:
            opened += waiting
            waiting = [f for name in waiting for f in self._folders(name)]
        units = [(name, False) for name in opened] + [(name, True) for name in waiting]
        return [Part(units[i :: self.count]) for i in range(min(self.count, len(units)))]

    def read(self, partition: Part) -> Iterator[tuple]:
        for row in self._rows(partition):
            yield tuple(row[c] for c in self.columns)

    def _rows(self, partition: Part) -> Iterator[dict]:
        for unit, whole in partition.units:
            for top, folders, files in os.walk(os.path.join(self.root, unit)):
                here = os.path.relpath(top, self.root)
                if WRITES in folders:
                    folders.remove(WRITES)
                links = [f for f in folders if os.path.islink(os.path.join(top, f))]
                for name, is_dir in [(here, True), *((os.path.normpath(os.path.join(here, f)), f in links) for f in [*files, *links])]:
                    if self._kept(name, is_dir) and (row := self._row(name, is_dir)):
                        yield row
                if not whole:
                    break

    def _row(self, name: str, is_dir: bool) -> dict | None:
        full = os.path.join(self.root, name)
        row = {"path": name, "is_dir": is_dir, "size": 0, "text": None, "link": None, "error": None}
        if os.path.islink(full):
            to = os.path.relpath(os.path.join(os.path.dirname(full), os.readlink(full)), self.root)
            if not to.startswith(".."):
                row["link"] = to
            elif not os.path.exists(full):
                return None
        if is_dir:
            return row
        try:
            row["size"] = os.path.getsize(full)
            if "text" in self.columns and name.endswith(self.suffixes):
                with open(full, encoding="utf-8") as f:
                    row["text"] = f.read()
        except UnicodeDecodeError as e:
            row["error"] = f"not UTF-8 from byte {e.start} on"
        except OSError as e:
            row["error"] = None if row["link"] else f"cannot be read: {e.strerror}"
        return row


@dataclass
class Written(WriterCommitMessage):
    todo: str
    changes: int


class VaultWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root.removeprefix("file://"), uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        """New texts and a list of changes, in a folder of this attempt: what a lost attempt has written is never looked at."""
        own = os.path.join(self.job, f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}")
        folder = os.path.join(self.root, WRITES, own)
        os.makedirs(folder)
        n = 0
        with open(os.path.join(folder, "todo"), "w", encoding="utf-8") as todo:
            for row in iterator:
                if row["text"] is not None:
                    with open(os.path.join(folder, f"text-{n}"), "w", encoding="utf-8", newline="") as f:
                        f.write(row["text"])
                todo.write(json.dumps([row["path"], row["source"], n if row["text"] is not None else None, n]) + "\n")
                n += 1
        return Written(own, n)

    def commit(self, messages: list[Written | None]) -> None:
        folder = os.path.join(self.root, WRITES, self.job)
        os.makedirs(folder, exist_ok=True)
        done = os.path.join(folder, "begun")
        with open(f"{done}.new", "w", encoding="utf-8") as f:
            f.write("".join(f"{m.todo}\n" for m in messages if m))
            f.flush()
            os.fsync(f.fileno())
        os.rename(f"{done}.new", done)
        _finish(self.root, self.job)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(os.path.join(self.root, WRITES, self.job), ignore_errors=True)
        _tidy(self.root)


def _todo(root: str, job: str) -> Iterator[tuple[str, str, str | None, int | None, int]]:
    with open(os.path.join(root, WRITES, job, "begun"), encoding="utf-8") as parts:
        for own in parts:
            folder = os.path.join(root, WRITES, own.rstrip("\n"))
            with open(os.path.join(folder, "todo"), encoding="utf-8") as rows:
                for row in rows:
                    yield (folder, *json.loads(row))


def _finish(root: str, job: str) -> None:
    """Carry out all that a begun commit lists; each step may have been done already."""
    at = lambda name: os.path.join(root, name)
    for folder, _, source, _, n in _todo(root, job):
        aside = os.path.join(folder, f"moved-{n}")
        if source is not None and not os.path.exists(aside) and not os.path.exists(f"{aside}.done") and os.path.exists(at(source)):
            os.rename(at(source), aside)
    for folder, path, source, text, n in _todo(root, job):
        os.makedirs(os.path.dirname(at(path)), exist_ok=True)
        aside = os.path.join(folder, f"moved-{n}")
        if source is not None and os.path.exists(aside):
            open(f"{aside}.done", "w").close()
            os.rename(aside, at(path))
        if text is not None and os.path.exists(os.path.join(folder, f"text-{text}")):
            os.replace(os.path.join(folder, f"text-{text}"), at(path))
    shutil.rmtree(os.path.join(root, WRITES, job))
    _tidy(root)


def _tidy(root: str) -> None:
    folder = os.path.join(root, WRITES)
    if os.path.isdir(folder) and not os.listdir(folder):
        os.rmdir(folder)


def recover(root: str) -> int:
    """End commits that were cut off and clear away jobs that never began one; call it when no job writes.  Gives the number of commits ended."""
    root, ended = root.removeprefix("file://"), 0
    folder = os.path.join(root, WRITES)
    for job in sorted(os.listdir(folder)) if os.path.isdir(folder) else []:
        if os.path.exists(os.path.join(folder, job, "begun")):
            _finish(root, job)
            ended += 1
        else:
            shutil.rmtree(os.path.join(folder, job))
    _tidy(root)
    return ended


class Vault(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return schemas.FILE

    def reader(self, schema: StructType) -> VaultReader:
        return VaultReader(dict(self.options), schema.fieldNames())

    def writer(self, schema: StructType, overwrite: bool) -> VaultWriter:
        if overwrite or sorted(schema.fieldNames()) != ["path", "source", "text"]:
            raise ValueError(f"append rows of ({CHANGE}) to a vault")
        return VaultWriter(self.options["path"])


def scan(spark: SparkSession, root: str, columns: list[str] | None = None, **options: str) -> DataFrame:
    """The files below root; of columns, the ones named (no ``text``: no file is opened)."""
    spark.dataSource.register(Vault)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("vault").options(**options)
    if columns:
        reader = reader.schema(", ".join(c for c in schemas.FILE.split(", ") if c.split()[0] in columns))
    return reader.load(root)


def write(changes: DataFrame, root: str) -> None:
    """changes as in CHANGE: no path twice, no source that is also rewritten in place."""
    changes.sparkSession.dataSource.register(Vault)
    changes.select("path", "text", "source").write.format("vault").mode("append").save(root)


def chosen_files(chosen: list[str], suffix: str, any_file: bool = False, home: str = "") -> Column:
    """Whether a file is named in chosen (of any suffix if any_file), or is of the suffix and below one of its directories, in its vault."""
    path, named = paths.inner(F.col("path"), home), [c.rstrip("/") for c in chosen]
    below = F.lit(False)
    for c in named:
        below = below | (path.startswith(f"{c}/") if c != "." else F.lit(True))
    picked = path.isin(*named) & (F.lit(any_file) | path.endswith(suffix))
    return ~F.col("is_dir") & ((below & path.endswith(suffix)) | picked)


def targets(files: DataFrame, chosen: list[str], suffix: str, any_file: bool = False) -> DataFrame:
    """The files chosen, each once."""
    return files.where(chosen_files(chosen, suffix, any_file)).dropDuplicates(["path"])


def inventory(files: DataFrame, *more: Column, keep: list[str] | None = None) -> DataFrame:
    """Distinct paths, with the directories that the files imply, and further aggregates of the columns of ``keep``."""
    made = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), F.lit(1), i), "/"))
    each = files.select("path", "is_dir", *(keep or []), F.explode(F.array_union(made, F.array(F.lit(".")))).alias("p"))
    return each.groupBy(F.col("p").alias("path")).agg(F.bool_and((F.col("p") != F.col("path")) | F.col("is_dir")).alias("is_dir"), *more)
