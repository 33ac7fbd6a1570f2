"""The 21 rules.

A rule is a Column over a row of what is judged (a head, a link, an element): an array of findings, each
null where it does not hold; ``emit`` evaluates any number of rules in one pass over the rows.  A
finding is line, code, message, warning, place, and for those that other files decide ``needs``, the
path that is looked up, and ``stamp``, the date that it should have; ``settle`` decides them all in one join.

``place`` is an array of integers: findings of one line are reported in its order, which is the
order in which a file's rules look at its keys, links and elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as fn
from . import resolve
from .extract import attribute, declared

# Fixed values.
RULES = {
    "SRC001": "missing-frontmatter", "SRC002": "unterminated-frontmatter", "SRC003": "missing-required-key", "SRC004": "empty-frontmatter-value",
    "SRC005": "unexpanded-placeholder", "SRC006": "invalid-filename", "SRC007": "created-mismatch", "IMG001": "missing-image",
    "IMG002": "noncanonical-image-target", "WIKI001": "unindexed-page", "WIKI002": "missing-link-target", "WIKI003": "emphasized-link-label",
    "WIKI004": "unreferenced-source", "HTML001": "external-resource", "HTML002": "disallowed-script", "HTML003": "iframe-forbidden",
    "HTML004": "stylesheet-mismatch", "HTML005": "missing-wiki-source", "HTML006": "missing-link-target", "HTML007": "unexpanded-placeholder", "HTML008": "stale-page",
}
REQUIRED, OPTIONAL = ["title", "created", "updated"], ["model"]
SPECIAL_PAGES = ["changelog.md", "index.md"]
RESOURCE_TAGS = ["audio", "embed", "iframe", "img", "link", "object", "script", "source", "video"]
URL_ATTRIBUTES = ["src", "href", "poster", "data"]
STYLESHEET, SCRIPT = "html/assets/style.css", "html/assets/theme.js"


DIAGNOSTIC = ["path", "line", "code", "message", "warning", "place"]


def _quoted(text: str, *values: Column | str) -> Column:
    return F.format_string(text, *[F.col(v) if isinstance(v, str) else v for v in values])


def finding(holds: Column, code: str, line: Column | int, message: Column | str, place: list[Column | int], warning: bool = False, needs: Column | None = None, stamp: Column | None = None) -> Column:
    """A finding where ``holds``, else null."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    none = F.lit(None).cast("string")
    order = F.array(*[as_column(x).cast("int") for x in place])
    made = F.struct(
        as_column(line).cast("int").alias("line"), F.lit(code).alias("code"), as_column(message).alias("message"), F.lit(warning).alias("warning"), order.alias("place"),
        (none if needs is None else needs).alias("needs"), (none if stamp is None else stamp).alias("stamp"),
    )
    return F.when(holds, made)


def emit(rows: DataFrame, *rules: Column) -> DataFrame:
    """path and the findings of all rules, in one pass; columns needs and stamp are still to be settled."""
    return rows.select("path", F.inline(F.filter(F.concat(*rules), lambda f: f.isNotNull())))


def only(found: DataFrame) -> DataFrame:
    """Findings that need no other file."""
    return found.select(*DIAGNOSTIC)


def settle(found: DataFrame, facts: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Findings that remain when what they need is looked up in facts (path, updated): in one left join.

    Without a stamp, a finding stands if the path is not there; with one, if the path has another date.
    Findings that need nothing stand, and meet nothing, each file's at a key of its own.
    """
    rows = resolve.follow(found, "needs", links)
    told = facts.select(F.col("path").alias("_key"), F.lit(True).alias("_there"), F.col("updated").alias("_now"))
    rows = rows.withColumn("_key", F.coalesce("needs", F.concat(F.lit("\0"), F.col("path")))).join(told, "_key", "left")
    stamped = F.col("stamp").isNotNull()
    stands = F.when(stamped, F.coalesce(F.col("_now") != F.col("stamp"), F.lit(False))).otherwise(F.col("_there").isNull())
    message = F.when(stamped, F.format_string("%s was updated on %s, after %s", "message", "_now", "stamp")).otherwise(F.col("message"))
    return rows.where(stands).withColumn("message", message).select(*DIAGNOSTIC)


# Source notes: rows are extract.frontmatter of the notes.


def src001() -> Column:
    return F.array(finding(F.col("status") == "missing", "SRC001", 1, "the text does not start with a `---` line", [0]))


def src002() -> Column:
    return F.array(finding(F.col("status") == "unterminated", "SRC002", 1, "no closing `---` line", [0]))


def _checked(required: list[str]) -> list[tuple[int, str, Column, Column]]:
    """(turn, key, whether it is checked, its entry or null); an optional key that is required comes twice."""
    ok = F.col("status") == "ok"
    entry = lambda key: F.get(F.filter("entries", lambda e: e["key"] == F.lit(key)), F.lit(0))
    keys = [(key, False) for key in required] + [(key, True) for key in sorted(OPTIONAL)]
    return [(turn, key, ok & entry(key).isNotNull() if optional else ok, entry(key)) for turn, (key, optional) in enumerate(keys)]


def src003(required: list[str] = REQUIRED) -> Column:
    return F.array(*[finding(due & e.isNull(), "SRC003", 1, f"`{key}` is absent", [0, turn, 0]) for turn, key, due, e in _checked(required)])


def src004(required: list[str] = REQUIRED) -> Column:
    return F.array(*[finding(due & (e["value"] == ""), "SRC004", e["line"], f"`{key}` is empty", [0, turn, 0]) for turn, key, due, e in _checked(required)])


def src005(required: list[str] = REQUIRED) -> Column:
    return F.array(*[finding(due & e["value"].rlike(fn.VALUE_PLACEHOLDER), "SRC005", e["line"], f"`{key}` holds an unexpanded placeholder", [0, turn, 1]) for turn, key, due, e in _checked(required)])


def _named() -> Column:
    return paths.name(F.col("path")).rlike(fn.file_name())


def src006() -> Column:
    return F.array(finding((F.col("status") == "ok") & ~_named(), "SRC006", 1, "the file name is not `YYYY-MM-DD_slug.md`", [1]))


def src007() -> Column:
    day = F.regexp_extract(paths.name(F.col("path")), fn.file_name(), 1)
    created = F.get(F.filter("entries", lambda e: e["key"] == "created"), F.lit(0))
    return F.array(finding((F.col("status") == "ok") & _named() & (created["value"] != day), "SRC007", created["line"], "`created` is not the file name's date", [1]))


def sources(required: list[str] = REQUIRED) -> list[Column]:
    """All rules on notes."""
    return [src001(), src002(), src003(required), src004(required), src005(required), src006(), src007()]


# Images: rows are resolve.image_targets.


def img001() -> Column:
    return F.array(finding(F.col("resolved").isNull(), "IMG001", F.col("line"), _quoted("image `%s` does not exist", "target"), [F.col("start"), 1]))


def img002() -> Column:
    return F.array(finding(fn.needs_normalization(F.col("target")), "IMG002", F.col("line"), _quoted("image target `%s` is not canonical", "target"), [F.col("start"), 0]))


# Wiki: rows are resolve.wiki_targets of all pages.


def _under(root: str, home: str) -> Column:
    return paths.inner(F.col("path"), home).startswith(f"{root}/") & F.col("path").endswith(".md")


def wiki001(files: DataFrame, targets: DataFrame, wiki: str = "wiki", links: DataFrame | None = None, home: str = "") -> DataFrame:
    """Diagnostics of pages that the index of their vault does not link; nothing if the index does not exist."""
    own, inner, index = paths.home_of(F.col("path"), home), paths.inner(F.col("path"), home), f"{wiki}/index.md"
    linked = targets.where((inner == index) & F.col("resolved").isNotNull()).select(own.alias("home"), F.col("resolved").alias("real"))
    pages = files.where(_under(wiki, home) & ~paths.name(F.col("path")).isin(*SPECIAL_PAGES)).select("path", F.col("path").alias("real"), own.alias("home"))
    there = files.where((inner == index) & ~F.col("is_dir")).select(own.alias("home")).distinct()
    pages = resolve.follow(pages, "real", links).join(there, "home", "left_semi")
    return only(emit(pages.join(linked, ["home", "real"], "left_anti"), F.array(finding(F.lit(True), "WIKI001", 1, "the index has no link to this page", [1]))))


def wiki002() -> Column:
    return F.array(finding(F.col("resolved").isNull(), "WIKI002", F.col("line"), _quoted("link target `%s` does not exist", "target"), [2, F.col("ord")]))


def wiki003() -> Column:
    to = F.col("resolved")
    emphasis = F.col("label").contains("*") | F.col("label").contains("\\_")
    holds = to.isNotNull() & (fn.path_suffix(paths.name(to)) == ".md") & paths.stem(to).contains("_") & emphasis
    return F.array(finding(holds, "WIKI003", F.col("line"), "the label reads as emphasis; write spaces for the file name's underscores", [3, F.col("ord")]))


def wiki004(files: DataFrame, targets: DataFrame, wiki: str = "wiki", sources: str = "sources", links: DataFrame | None = None, home: str = "") -> DataFrame:
    """Diagnostics of notes that no wiki page links."""
    linked = targets.where(paths.inner(F.col("path"), home).startswith(f"{wiki}/") & F.col("resolved").isNotNull()).select(F.col("resolved").alias("real"))
    notes = resolve.follow(files.where(_under(sources, home)).select("path", F.col("path").alias("real")), "real", links)
    return only(emit(notes.join(linked, "real", "left_anti"), F.array(finding(F.lit(True), "WIKI004", 1, "no wiki page links to this note", [4]))))


# Pages: rows are ``page_rows``: a row each element, and before them one of the page itself, whose tag is empty.


def page_rows(pages: DataFrame, home: str = "") -> DataFrame:
    """pages(path, elements, placeholders) -> path, home, ord, tag, attrs, line, marks, has_sheet, has_meta."""
    at = lambda e, name: F.coalesce(e["attrs"][name], F.lit(""))
    sheet = F.exists("elements", lambda e: (e["tag"] == "link") & F.lower(at(e, "rel")).contains("stylesheet") & ~fn.external_in_html(at(e, "href")))
    meta = F.exists("elements", lambda e: (e["tag"] == "meta") & (at(e, "name") == "wiki-source"))
    own = F.struct(F.lit(-1).alias("ord"), F.lit("").alias("tag"), F.create_map().cast("map<string,string>").alias("attrs"), F.lit(1).alias("line"))
    rows = pages.select("path", "placeholders", sheet.alias("has_sheet"), meta.alias("has_meta"), F.explode(F.concat(F.array(own), "elements")).alias("e"))
    marks = F.when(F.col("e.tag") == "", F.col("placeholders"))
    return rows.select("path", paths.home_of(F.col("path"), home).alias("home"), "e.*", marks.alias("marks"), "has_sheet", "has_meta")


def _resolves_to(target: Column, asset: str) -> Column:
    return paths.resolve(paths.parent(F.col("path")), fn.percent_decode(target)) == F.concat("home", F.lit(asset))


def _targets() -> Column:
    """What the attributes that name something name, with their turns."""
    return F.array(*[F.struct(F.lit(turn).alias("turn"), attribute(a).alias("target")) for turn, a in enumerate(URL_ATTRIBUTES)])


def html001() -> Column:
    made = lambda t: finding((t["target"] != "") & fn.external_in_html(t["target"]), "HTML001", F.col("line"), _quoted("external resource `%s`", t["target"]), [F.lit(0), F.col("ord"), t["turn"] + 2])
    return F.when(F.col("tag").isin(*RESOURCE_TAGS), F.transform(_targets(), made)).otherwise(F.array())


def html002() -> Column:
    src = attribute("src")
    shared = (src != "") & ~fn.external_in_html(src) & _resolves_to(src, SCRIPT)
    return F.array(finding((F.col("tag") == "script") & ~shared, "HTML002", F.col("line"), "only the shared script may be loaded", [0, F.col("ord"), 0]))


def html003() -> Column:
    return F.array(finding(F.col("tag") == "iframe", "HTML003", F.col("line"), "iframe is not allowed", [0, F.col("ord"), 1]))


def html004() -> Column:
    href = attribute("href")
    sheet = (F.col("tag") == "link") & F.lower(attribute("rel")).contains("stylesheet") & ~fn.external_in_html(href)
    return F.array(
        finding(sheet & ~_resolves_to(href, STYLESHEET), "HTML004", F.col("line"), _quoted("stylesheet `%s` is not the shared one", href), [1, F.col("ord")]),
        finding((F.col("tag") == "") & ~F.col("has_sheet"), "HTML004", 1, "the shared stylesheet is absent", [1, 0]),
    )


def _meta() -> tuple[Column, Column, Column]:
    return (F.col("tag") == "meta") & (attribute("name") == "wiki-source"), *declared(attribute("content"))


def _from_home(source: Column) -> Column:
    return paths.normalize(F.when(source.startswith("/"), source).otherwise(F.concat("home", source)))


def html005() -> Column:
    meta, source, _ = _meta()
    return F.array(
        finding(meta & source.isNull(), "HTML005", F.col("line"), _quoted("wiki-source `%s` is not `<path> <YYYY-MM-DD>`", attribute("content")), [2, F.col("ord")]),
        finding((F.col("tag") == "") & ~F.col("has_meta") & (paths.name(F.col("path")) != "index.html"), "HTML005", 1, "no wiki-source meta", [2, 0]),
    )


def html006() -> Column:
    def made(t: Column) -> Column:
        local = fn.strip_fragment(fn.percent_decode(t["target"]))
        holds = (t["target"] != "") & ~fn.external_in_html(t["target"]) & ~t["target"].startswith("#") & (local != "")
        return finding(holds, "HTML006", F.col("line"), _quoted("link target `%s` does not exist", t["target"]), [F.lit(3), F.col("ord"), t["turn"]], needs=paths.resolve(paths.parent(F.col("path")), local))

    meta, source, _ = _meta()
    gone = finding(meta & source.isNotNull(), "HTML006", F.col("line"), _quoted("wiki-source `%s` does not exist", source), [4, F.col("ord")], needs=_from_home(source))
    return F.concat(F.transform(_targets(), made), F.array(gone))


def html007() -> Column:
    """At the row of the page itself."""
    made = lambda m: finding(F.lit(True), "HTML007", m["line"], _quoted("unexpanded placeholder `%s`", m["placeholder"]), [F.lit(5), m["ord"]])
    return F.coalesce(F.transform("marks", made), F.array())


def html008() -> Column:
    meta, source, day = _meta()
    return F.array(finding(meta & source.isNotNull(), "HTML008", F.col("line"), _quoted("`%s`", source), [4, F.col("ord")], True, needs=_from_home(source), stamp=day))


def pages() -> list[Column]:
    """All rules on pages."""
    return [html001(), html002(), html003(), html004(), html005(), html006(), html007(), html008()]
