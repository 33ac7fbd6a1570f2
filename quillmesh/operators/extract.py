"""Generators: one document in, rows of its parts out.

``parse`` reads each text once, for as many kinds of parts as are asked for; the generators of single
kinds are ``parse`` and an explode.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as fn

# The two ways to embed an image.
IMAGE = re.compile(r"!\[[^\]\n]*\]\(([^)\n]+)\)")
EMBED = re.compile(r"!\[\[([^\]\n]+)\]\]")

_MARKS, _STOPS = re.compile(r"[\[\]\\]"), re.compile(r"[)\s]")

_BARE = r"[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*---[\t\x1f \xa0\u1680\u2000-\u200a\u202f\u205f\u3000]*"
#: A text's first line, and all lines up to the first like it after that.
OPENING, HEAD = rf"^{_BARE}(?:{fn.LINE_END}|\z)", rf"(?s)^({_BARE}(?:{fn.LINE_END})(?:.*?(?:{fn.LINE_END}))??){_BARE}(?:{fn.LINE_END}|\z)"


def frontmatter(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """path, *keep, status (ok, missing or unterminated), entries: array of (key, line, value), last of a key only.

    Only the head is cut out of the text and split into lines.
    """
    text = F.coalesce("text", F.lit(""))
    keep = ["path", *(keep or [])]
    rows = files.select(*keep, text.rlike(OPENING).alias("opens"), F.regexp_extract(text, HEAD, 1).alias("head"))
    status = F.when(~F.col("opens"), "missing").when(F.col("head") == "", "unterminated").otherwise("ok")

    def entry(line: Column, i: Column) -> Column:
        return F.struct(fn.trim(F.substring_index(line, ":", 1)).alias("key"), (i + 1).alias("line"), fn.unquote_value(F.substring(line, F.instr(line, ":") + 1, F.length(line))).alias("value"), (~line.startswith("#") & line.contains(":")).alias("kept"))

    def last_of_keys(found: Column) -> Column:
        by_key = F.array_sort(F.transform(found, lambda e: F.struct(e["key"].alias("key"), e["line"].alias("line"), e["value"].alias("value"))))
        last = fn.once(by_key, lambda s: F.filter(s, lambda e, i: F.coalesce(F.get(s, i + 1)["key"] != e["key"], F.lit(True))))
        by_line = F.array_sort(F.transform(last, lambda e: F.struct(e["line"].alias("line"), e["key"].alias("key"), e["value"].alias("value"))))
        return F.transform(by_line, lambda e: F.struct(e["key"].alias("key"), e["line"].alias("line"), e["value"].alias("value")))

    found = F.filter(F.transform(F.transform(fn.split_lines(F.col("head")), fn.trim), entry), lambda e: e["kept"])
    none = F.array().cast("array<struct<key:string,line:int,value:string>>")
    return rows.select(*keep, status.alias("status"), F.when(status == "ok", last_of_keys(found)).otherwise(none).alias("entries"))


def frontmatter_entries(files: DataFrame) -> DataFrame:
    """path, key, line, value."""
    return frontmatter(files).select("path", F.inline("entries"))


def scan_links(line: str) -> list[tuple[str, str]]:
    """(label, target) of each link of a line, in time that grows with its length.

    A label is made of characters that are no brackets, of backslashes that make the next bracket
    one of these, and of bracketed parts without further brackets; a target stands between angle brackets, or is free of
    white space.  Where a label that has come so far ends does not depend on where it began, so ``ends``
    has that place for each bracket and backslash, found from the right to the left; -1 if there is none.
    """
    marks = [m.start() for m in _MARKS.finditer(line)]
    brackets = [i for i in marks if line[i] != "\\"]
    stops, angles = [m.start() for m in _STOPS.finditer(line)], [m.start() for m in re.finditer(">", line)]
    ends = [-1] * (len(marks) + 1)

    def end_from(place: int) -> int:
        return ends[bisect_left(marks, place)]

    def target(i: int) -> tuple[int, str] | None:
        """Place after the closing parenthesis, and the target that begins at i."""
        if line.startswith("<", i):
            k = bisect_left(angles, i)
            if k < len(angles) and angles[k] > i + 1 and line.startswith(")", angles[k] + 1):
                return angles[k] + 2, line[i + 1 : angles[k]]
        k = bisect_left(stops, i)
        if k < len(stops) and stops[k] > i and line[stops[k]] == ")":
            return stops[k] + 1, line[i : stops[k]]
        return None

    for k in range(len(marks) - 1, -1, -1):
        i = marks[k]
        if line[i] == "]":
            ends[k] = i if line.startswith("(", i + 1) and target(i + 2) else -1
        elif line[i] == "[":
            j = bisect_right(brackets, i)
            ends[k] = end_from(brackets[j] + 1) if j < len(brackets) and line[brackets[j]] == "]" else -1
        else:
            ends[k] = ends[k + 1]
            if ends[k] < 0 and line[i + 1 : i + 2] in ("[", "]"):
                ends[k] = end_from(i + 2)
    found, after = [], 0
    for i in brackets:
        if i >= after and line[i] == "[" and not line.startswith("!", i - 1, i) and (end := end_from(i + 1)) >= 0:
            after, aim = target(end + 2)
            found.append((line[i + 1 : end], aim))
    return found


def links_of(text: str) -> list[tuple]:
    """(ord, line, label, target) of a text's links."""
    rows = [(i, label, aim.strip()) for i, line in enumerate(text.split("\n"), 1) if "](" in line for label, aim in scan_links(line)]
    return [(k, *row) for k, row in enumerate(rows)]


def _line_starts(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer("\n", text))]


def image_links_of(text: str) -> list[tuple]:
    """(start, end, line, raw, target, target start and end, kind) of a text's local image links, by start."""
    found, starts = [], _line_starts(text) if "![" in text else []
    for pattern, kind in ((IMAGE, "markdown"), (EMBED, "obsidian")):
        for m in pattern.finditer(text):
            target = fn.raw_target(m[1], kind)
            if fn.local_image(target):
                found.append((m.start(), m.end(), bisect_right(starts, m.start()), m[1], target, m.start(1), m.end(1), kind))
    return sorted(found)


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []

    def handle_starttag(self, tag, attrs) -> None:
        self.rows.append((len(self.rows), tag, list({k: v or "" for k, v in attrs}.items()), self.getpos()[0]))


def elements_of(text: str) -> list[tuple]:
    """(ord, tag, attrs, line) of each start tag."""
    parser = _Tags()
    parser.feed(text)
    return parser.rows


def placeholders_of(text: str) -> list[tuple]:
    """(ord, line, placeholder): each occurrence, at the line of the first like it."""
    first, starts, found = {}, _line_starts(text) if "{{" in text else [], []
    for m in re.finditer(fn.PAGE_PLACEHOLDER, text):
        line = first.setdefault(m[0], bisect_right(starts, m.start()))
        found.append((len(found), line, m[0]))
    return found


#: Kind of parts: how they are found, their struct, and what a text must contain to have any.
PARTS: dict[str, tuple[Callable, list[tuple], str]] = {
    "links": (links_of, [("ord", pa.int32()), ("line", pa.int32()), ("label", pa.string()), ("target", pa.string())], "]("),
    "images": (image_links_of, [("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32()), ("raw_target", pa.string()), ("target", pa.string()), ("target_start", pa.int32()), ("target_end", pa.int32()), ("kind", pa.string())], "!["),
    "elements": (elements_of, [("ord", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("line", pa.int32())], "<"),
    "placeholders": (placeholders_of, [("ord", pa.int32()), ("line", pa.int32()), ("placeholder", pa.string())], "{{"),
}


def parts_array(kinds: list[str], texts: list[str | None]) -> list[pa.Array]:
    """For each kind an array of lists, one a text."""
    lists = []
    for kind in kinds:
        find, fields, needed = PARTS[kind]
        lists.append(pa.array([find(t) if t and needed in t else [] for t in texts], pa.list_(pa.struct(fields))))
    return lists


def parse(files: DataFrame, kinds: list[str], keep: list[str], wanted: Column | None = None) -> DataFrame:
    """keep, and an array for each kind of parts of the texts of the files wanted: one pass over the texts.

    Texts without anything that begins a part never leave the JVM.
    """
    some = F.lit(False)
    for kind in kinds:
        some = some | F.col("text").contains(PARTS[kind][2])
    rows = files.select(*keep, F.when(some if wanted is None else some & wanted, F.col("text")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                made = parts_array(kinds, part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=[*keep, *kinds])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, ", ".join([f"`{c}` {types[c]}" for c in keep] + [f"{k} {schemas.PARTS[k]}" for k in kinds]))


def _single(files: DataFrame, kind: str) -> DataFrame:
    return parse(files.where(F.col("text").contains(PARTS[kind][2])), [kind], ["path"]).select("path", F.inline(kind))


def markdown_links(files: DataFrame) -> DataFrame:
    """path, ord, line, label, target: in the order of the text."""
    return _single(files, "links")


def image_links(files: DataFrame) -> DataFrame:
    """Rows as in schemas.IMAGE_LINK; offsets are in code points."""
    return _single(files, "images")


def html_elements(files: DataFrame) -> DataFrame:
    """Rows as in schemas.ELEMENT: a start tag each, in order."""
    return _single(files, "elements")


def placeholders(files: DataFrame) -> DataFrame:
    """path, ord, line, placeholder: each occurrence, at the line of the first like it."""
    return _single(files, "placeholders")


def attribute(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def declared(content: Column) -> tuple[Column, Column]:
    """Path and date of a wiki-source declaration; null if it is malformed."""
    good = content.rlike(fn.provenance())
    return F.when(good, F.regexp_extract(content, fn.provenance(), 1)), F.when(good, F.regexp_extract(content, fn.provenance(), 2))


def provenance(elements: DataFrame) -> DataFrame:
    """path, ord, line, content, src_path, declared: a row each wiki-source meta; the last two null if malformed."""
    source, day = declared(attribute("content"))
    rows = elements.where((F.col("tag") == "meta") & (attribute("name") == "wiki-source"))
    return rows.select("path", "ord", "line", attribute("content").alias("content"), source.alias("src_path"), day.alias("declared"))


def source_list(text: Column) -> Column:
    """The block list under a bare ``sources:`` in the head; a line that is no item ends it."""
    rest = F.substring(text, 4, 2**31 - 1)
    head = F.when(text.startswith("---") & rest.contains("\n---"), F.concat(F.lit("---"), F.substring_index(rest, "\n---", 1)))
    opening, item = fn.java(r"^sources:\s*$"), fn.java(r"^\s+-\s*\"?([^\"]+?)\"?\s*$")

    def told(line: Column) -> Column:
        """1 where the list opens, 0 for an item, - for what ends it."""
        return F.struct(F.when(line.rlike(opening), "1").when(line.rlike(item), "0").otherwise("-").alias("kind"), F.regexp_extract(line, item, 1).alias("item"))

    def listed(lines: Column) -> Column:
        # all items that follow an opening, one match after the other
        marks = F.regexp_replace(F.array_join(F.transform(lines, lambda x: x["kind"]), ""), r"(1|(?!\A)\G)0", "$1x")
        kept = F.zip_with(lines, F.split(marks, ""), lambda x, mark: F.when(mark == "x", x["item"]))
        return F.filter(kept, lambda x: x.isNotNull())

    return fn.once(F.transform(fn.split_lines(head), told), listed)


def source_items(files: DataFrame) -> DataFrame:
    """path, ord, item of the source lists."""
    return files.select("path", F.posexplode(source_list(F.col("text"))).alias("ord", "item"))
