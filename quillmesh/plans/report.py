"""Diagnostics and candidates as lines of text, and the exit status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as fn


def diagnostic_lines(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.select("path", "line", "code", F.format_string("%s:%d: [%s] %s%s", "path", "line", "code", F.when(F.col("warning"), "warning: ").otherwise(""), "message").alias("text"))


def write(diagnostics: DataFrame, folder: str) -> dict[str, int]:
    """The ordered lines as text files, each a range of them, whose names sort as the lines do; findings and errors, counted by the job that writes."""
    seen = Observation("report")
    # above the sort, which reads what is below it once more for its ranges
    rows = diagnostics.orderBy("path", "line", "place", "code", "message").observe(seen, F.count(F.lit(1)).alias("findings"), F.count_if(~F.col("warning")).alias("errors"))
    diagnostic_lines(rows).select("text").write.text(folder)
    return seen.get


def exit_status(diagnostics: DataFrame) -> int:
    return int(not diagnostics.where(~F.col("warning")).limit(1).isEmpty())


def candidate_lines(candidates: DataFrame) -> DataFrame:
    html = F.concat(F.lit("html="), F.when(F.size("html_pages") > 0, F.array_join("html_pages", ", ")).otherwise("-"))
    size = F.concat(F.lit("total="), fn.kilobytes(F.col("total_bytes")))
    return candidates.select("page", F.concat_ws("\t", "page", "state", F.concat(F.lit("sources="), "source_count"), size, html).alias("text"))


def pending(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count_if(F.col("state").isin("missing", "stale")).alias("pending"), F.count(F.lit(1)).alias("candidates"))
