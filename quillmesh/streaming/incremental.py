"""Rules on files that keep arriving (beyond batch checks): those that look at one file at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import extract, rules


def stream_sources(files: DataFrame) -> DataFrame:
    """Diagnostics of the source-note rules for a stream of files (path, text); no state is kept."""
    return rules.only(rules.emit(extract.frontmatter(files), *rules.sources()))


def stream_elements(files: DataFrame) -> DataFrame:
    """Diagnostics of the page rules that need no other file, from one pass over each text."""
    pages = extract.parse(files, ["elements", "placeholders"], ["path"])
    local = [rules.html001(), rules.html002(), rules.html003(), rules.html004(), rules.html005(), rules.html007()]
    return rules.only(rules.emit(rules.page_rows(pages), *local))
