"""``python -m quillmesh.cli sources|wiki|images|html [paths] [options]`` in a vault's root."""

from __future__ import annotations

import argparse
import glob
import shutil
import sys
import uuid
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .plans import fixes, lint, report
from .scratch import scratch, stage
from .sources.vault import chosen_files, recover, scan


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quillmesh")
    p.add_argument("--root", default=".")
    p.add_argument("--jobs", default="*", help="tasks that run at once")
    kinds = p.add_subparsers(dest="kind", required=True)
    for kind in ("sources", "wiki", "images", "html"):
        k = kinds.add_parser(kind)
        k.add_argument("paths", nargs="*")
        if kind == "sources":
            k.add_argument("--template", default="_template/source.md")
        elif kind == "wiki":
            k.add_argument("--wiki", default="wiki")
            k.add_argument("--sources", default="sources")
            k.add_argument("--check-unreferenced", action="store_true")
        elif kind == "images":
            k.add_argument("--fix", action="store_true")
        else:
            k.add_argument("--candidates", action="store_true")
    a = p.parse_args(argv)
    spark = SparkSession.builder.master(f"local[{a.jobs}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    recover(a.root)
    files = scan(spark, a.root, suffixes=".md,.html" if a.kind == "html" else ".md")
    suffix, roots = ".md", {"images": ["sources", "wiki"]}.get(a.kind, [a.kind])
    if a.kind == "sources":
        with open(f"{a.root}/{a.template}", encoding="utf-8") as f:
            found = lint.lint_sources(files, a.paths, f.read())
    elif a.kind == "wiki":
        roots, found = [a.wiki], lint.lint_wiki(files, a.paths, a.wiki, a.sources, a.check_unreferenced)
    elif a.kind == "images":
        if a.fix:
            renames, edits = fixes.plan(files, a.paths)
            edits = stage(edits, "plan")
            print(", ".join(f"{k} {v}" for k, v in fixes.apply(a.root, renames, edits).items()))
            found = fixes.remaining(edits)
        else:
            found = lint.lint_images(files, a.paths)
    else:
        if a.candidates:
            rows = stage(lint.candidates(files), "candidates")
            print_lines(report.candidate_lines(rows).orderBy(paths.order_key(F.col("page"))), sys.stdout)
            n = report.pending(rows).first()
            print(f"{n['pending']} pending of {n['candidates']}")
            return 0
        suffix, found = ".html", lint.lint_html(files, a.paths)
    folder = f"{scratch(spark)}/quillmesh/report-{uuid.uuid4().hex}"
    counts = report.write(found, folder)
    copy_lines(folder, sys.stderr)
    checked = scan(spark, a.root, columns=["path", "is_dir"]).where(chosen_files(a.paths or roots, suffix, any_file=a.kind in ("sources", "wiki"))).count()
    print(f"{checked} files, {counts['findings']} findings")
    return int(counts["errors"] > 0)


def print_lines(rows: DataFrame, to: TextIO) -> None:
    folder = f"{scratch(rows.sparkSession)}/quillmesh/lines-{uuid.uuid4().hex}"
    rows.select("text").write.text(folder)
    copy_lines(folder, to)


def copy_lines(folder: str, to: TextIO) -> None:
    """The part files of a local folder, one after the other."""
    for name in sorted(glob.glob(f"{folder.removeprefix('file://')}/part-*")):
        with open(name, encoding="utf-8") as part:
            shutil.copyfileobj(part, to)


if __name__ == "__main__":
    sys.exit(main())
