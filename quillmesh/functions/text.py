"""Scalar functions on link targets, values and lines: Column expressions, and plain ones for what is found with offsets."""

from __future__ import annotations

import re
from functools import cache
from urllib.parse import unquote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IMAGE_SUFFIXES = ["avif", "bmp", "gif", "jpeg", "jpg", "png", "svg", "webp"]
VALUE_PLACEHOLDER = r"\{\{[^}]+\}\}"
PAGE_PLACEHOLDER = r"\{\{[^}\n]*\}\}"

_SUFFIX = r"[^/.][^/]*(\.[^./]+)/*$"
#: Where a text is cut into lines that may end in other ways than by a line feed.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
#: A scheme as URL parsing finds it: leading control characters and spaces are no part of it, tabs and line ends nowhere count.
_SCHEME = r"^[\x00-\x20]*[A-Za-z](?:[A-Za-z0-9+.\-]|[\t\r\n])*:"
_HOST = r"^[\x00-\x20]*/[\t\r\n]*/[\t\r\n]*[^/?#\t\r\n]"


@cache
def members(kind: str, inverted: bool = False) -> str:
    """Java's character class of the code points that Python's ``\\s`` or ``\\d`` holds, found by asking Python about each."""
    every = "".join(map(chr, range(0x110000)))
    held = [ord(c) for c in re.findall(kind, every)]
    cuts = [i for i, c in enumerate(held) if i == 0 or held[i - 1] != c - 1]
    ranges = [(held[a], held[b - 1]) for a, b in zip(cuts, [*cuts[1:], len(held)], strict=True)]
    return f"[{'^' if inverted else ''}{''.join(rf'\x{{{a:x}}}-\x{{{b:x}}}' for a, b in ranges)}]"


def java(pattern: str) -> str:
    """A pattern as Python reads it, for Java: ``\\s``, ``\\S`` and ``\\d`` hold the same code points, ``.`` all but the line feed.

    ``^`` and ``$`` are taken as Python does without flags: the whole text's start, its end and the place before a last line feed;
    for lines write ``(?<![^\\n])`` and ``(?![^\\n])``.
    """
    known = {r"\s": lambda: members(r"\s"), r"\S": lambda: members(r"\s", True), r"\d": lambda: members(r"\d"), ".": lambda: r"[^\n]", "$": lambda: r"(?=\n?\z)", "^": lambda: r"\A"}
    parts = re.findall(r"\\.|\[(?:\\.|[^\]\\])*\]|\(\?<?[=!:]|.", pattern, re.DOTALL)
    return "".join(known[p]() if p in known else p for p in parts)


@cache
def file_name() -> str:
    """A note's file name; its date is the first group.  Nothing may follow, not even a line feed."""
    return rf"\A({java(r'\d{4}-\d{2}-\d{2}')})_[^\n]+\.md\z"


@cache
def provenance() -> str:
    return java(r"^(\S+) (\d{4}-\d{2}-\d{2})$")


def once(value: Column, use) -> Column:
    """use(value), with value computed once a row even if it is used many times."""
    return F.transform(F.array(value), use)[0]


def trim(value: Column) -> Column:
    space = members(r"\s")
    return F.regexp_replace(value, rf"\A{space}+|{space}+\z", "")


def split_lines(text: Column) -> Column:
    """Lines at any line end; a last empty one is none."""
    parts = F.split(text, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def unquote_value(value: Column) -> Column:
    v = trim(value)
    quoted = (F.length(v) >= 2) & ((v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'")))
    return F.when(quoted, F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)


def strip_fragment(target: Column) -> Column:
    return F.substring_index(target, "#", 1)


def has_scheme(target: Column) -> Column:
    return target.rlike(_SCHEME)


def external_in_wiki(target: Column) -> Column:
    """In-page anchors, schemes and hosts; ``//`` without a host is a path."""
    return target.startswith("#") | has_scheme(target) | target.rlike(_HOST)


def external_in_html(target: Column) -> Column:
    return target.startswith("//") | has_scheme(target)


def percent_decode(target: Column) -> Column:
    """Decodes once: plus signs and malformed escapes stay, bad UTF-8 becomes U+FFFD."""
    kept = F.regexp_replace(F.replace(target, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    return F.url_decode(kept)


def canonical_target(target: Column) -> Column:
    return F.translate(percent_decode(target), " ", "_")


def needs_normalization(target: Column) -> Column:
    return target != canonical_target(target)


def path_suffix(path: Column) -> Column:
    """With its dot; names that begin or end with their only dot have none."""
    return F.regexp_extract(path, _SUFFIX, 1)


def raw_target(raw: str, kind: str) -> str:
    """The target in an image's raw text: alias, angle brackets and fragment go, a title stays part of it."""
    if kind == "obsidian":
        raw = raw.partition("|")[0]
    t = raw.strip()
    if kind == "markdown" and t.startswith("<") and t.endswith(">"):
        t = t[1:-1].strip()
    return t.partition("#")[0]


def local_image(target: str) -> bool:
    """Whether a target names an image file here; ``//host/x`` and ``file:`` do, other schemes do not."""
    scheme = re.match(_SCHEME, target)
    if not target or (scheme and re.sub(r"[\x00-\x20]", "", scheme[0]).lower() != "file:"):
        return False
    suffix = re.search(_SUFFIX, unquote(target))
    return bool(suffix) and suffix[1][1:].lower() in IMAGE_SUFFIXES


def spellings(target: Column) -> Column:
    """Decoded, raw and canonical, each once."""
    return F.array_distinct(F.array(percent_decode(target), target, canonical_target(target)))


def page_updated(text: Column) -> Column:
    """The first bare or double-quoted date of ``updated:`` in the head; null without one."""
    rest = F.substring(text, 4, 2**31 - 1)
    closed = F.when(text.startswith("---") & rest.contains("\n---"), F.concat(F.lit("---"), F.substring_index(rest, "\n---", 1)))
    line = java(r"(?<![^\n])updated:\s*\"?(\d{4}-\d{2}-\d{2})\"?\s*(?![^\n])")
    return F.nullif(F.regexp_extract(closed, line, 1), F.lit(""))


def kilobytes(size: Column) -> Column:
    return F.format_string("%.1fKB", size / 1000)
