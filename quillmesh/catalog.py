"""Queries of the lint operators over the test tables, with their SQL.

``documents`` hold no Markdown, so vaults are derived from them, one of each hundred: SQL that Spark and
DuckDB both run makes notes, wiki pages, an index and images' inventory out of every document, with
faults that its id decides.  The raw web pages of ``pages`` get a head of our own by the same means, which
trips every rule in some of them.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths
from .functions import text as fn
from .operators import extract, resolve, rules
from .plans import fixes, lint, report
from .scratch import scratch, spread
from .sources.vault import scan, write

_HOME = "'v' || CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR(20)) || '/'"
HOME = r"v\d+/"
_DAY = "'2024-01-' || lpad(CAST(1 + doc_id % 28 AS VARCHAR(9)), 2, '0')"
_ID = "CAST(doc_id AS VARCHAR(20))"
_NL = "chr(10)"
_ARABIC = "'0123456789', '٠١٢٣٤٥٦٧٨٩'"
_NOTE = f"'sources/c' || CAST(doc_id % 7 AS VARCHAR(9)) || '/' || CASE WHEN doc_id % 11 = 3 THEN 'note-' WHEN doc_id % 31 = 8 THEN translate({_DAY}, {_ARABIC}) || '_n' ELSE {_DAY} || '_n' END || {_ID} || '.md'"
#: What a page's list of sources names: its own note, and for some two others', of which one may be its own again.
_OTHERS = [_NOTE.replace("doc_id", f"(doc_id - doc_id % {k})") for k in (10, 100)]
_INDENT = "CASE WHEN doc_id % 9 = 2 THEN '\u00a0\u2003' ELSE '  ' END"
_BODY = "coalesce(text, '')"

NOTES_SQL = f"""
SELECT doc_id, {_HOME} || {_NOTE} AS path,
  CASE WHEN doc_id % 13 = 5 THEN {_BODY}
       WHEN doc_id % 17 = 4 THEN '---' || {_NL} || 'title: open' || {_NL} || {_BODY}
       ELSE '---' || {_NL}
         || CASE WHEN doc_id % 19 = 2 THEN 'title: ""' WHEN doc_id % 19 = 7 THEN 'title: {{{{title}}}}' ELSE 'title: "T ' || {_ID} || '"' END || {_NL}
         || CASE WHEN doc_id % 23 = 1 THEN '# no date' ELSE 'created: ' || CASE WHEN doc_id % 29 = 3 THEN '2023-05-05' ELSE {_DAY} END END || {_NL}
         || 'updated: ' || {_DAY} || {_NL} || '---' || {_NL} || {_BODY} END AS text
FROM documents"""
WIKI_SQL = f"""
SELECT doc_id, {_HOME} || 'wiki/p' || CAST(doc_id % 5 AS VARCHAR(9)) || '/page_' || {_ID} || '.md' AS path,
  '---' || {_NL} || 'updated: "2024-05-0' || CAST(1 + doc_id % 2 AS VARCHAR(9)) || '"' || {_NL} || 'sources:' || {_NL} || {_INDENT} || '- ../../' || {_NOTE} || {_NL}
  || CASE WHEN doc_id % 8 = 0 THEN {_INDENT} || '- "../../' || {_OTHERS[0]} || '"' || {_NL} || '   -  ../../' || {_OTHERS[1]} || ' ' || {_NL} ELSE '' END
  || '---' || {_NL} || {_BODY} || {_NL}
  || CASE WHEN doc_id % 3 = 0 THEN 'see [note](../../' || {_NOTE} || ')' ELSE 'see ![a](b.md)' END || {_NL}
  || CASE WHEN doc_id % 9 = 4 THEN '[gone](missing%20page.md#top) and [out](https://example.org/x)' ELSE '[self](page_' || {_ID} || '.md)' END || {_NL}
  || CASE WHEN doc_id % 10 = 6 THEN '[page*' || {_ID} || '*](page_' || {_ID} || '.md)'
       WHEN doc_id % 7 = 3 THEN '![i](img%20' || {_ID} || '.png) ![[img ' || {_ID} || '.png#f|30]]' ELSE '![i](img%20' || {_ID} || '.png) ![[img_' || {_ID} || '.png|30]]' END AS text
FROM documents"""

#: Pages that declare a third of the wiki pages; some of these are declared twice, with a date long gone.
DECLARED_SQL = f"""
SELECT doc_id, {_HOME} || 'html/' || CASE WHEN turn = 1 THEN 'a' ELSE 'b' END || {_ID} || '.html' AS path,
  '<meta name="wiki-source" content="wiki/p' || CAST(doc_id % 5 AS VARCHAR(9)) || '/page_' || {_ID} || '.md ' || CASE WHEN turn = 1 THEN '2024-05-01' ELSE '2023-05-01' END || '">' AS text
FROM documents CROSS JOIN (SELECT 1 AS turn UNION ALL SELECT 2) turns WHERE doc_id % 3 = 0 AND (turn = 1 OR doc_id % 12 = 0)"""


_PAGE = "CAST(page_id AS VARCHAR(20))"
PAGES_SQL = f"""
SELECT page_id, 'html/' || {_PAGE} || '.html' AS path,
  '<!DOCTYPE html>' || {_NL}
  || CASE page_id % 3 WHEN 0 THEN '<link rel="stylesheet" href="assets/style.css">' WHEN 1 THEN '<link rel="stylesheet" href="assets/other.css">' ELSE '<link rel="stylesheet" href="https://cdn.example/x.css">' END || {_NL}
  || CASE page_id % 5 WHEN 0 THEN '<meta name="wiki-source" content="wiki/w' || {_PAGE} || '.md 2024-03-01">' WHEN 1 THEN '<meta name="wiki-source" content="wiki/w.md  2024">'
       WHEN 2 THEN '<meta name="wiki-source" content="wiki/w\u00a0' || {_PAGE} || '.md 2024-03-01">' WHEN 3 THEN '<meta name="wiki-source" content="wiki/w' || {_PAGE} || '.md ٢٠٢٤-٠٣-٠١">' ELSE '' END || {_NL}
  || CASE page_id % 7 WHEN 0 THEN '<script src="assets/theme.js"></script>' WHEN 1 THEN '<script src="//cdn.example/' || {_PAGE} || '.js"></script>'
       WHEN 2 THEN '<iframe src="' || {_PAGE} || '.html"></iframe>' WHEN 3 THEN '<p>{{{{title}}}}</p>' || {_NL} || '<p>{{{{title}}}} {{{{day}}}}</p>'
       WHEN 4 THEN '<a href="gone%20' || {_PAGE} || '.html#x">x</a><a href="#top">y</a>' WHEN 5 THEN '<video src="assets/theme.js" poster="https://cdn.example/p.png"></video>' ELSE '' END || {_NL}
  || coalesce(html, '') AS text
FROM pages"""
#: Wiki pages that some of the pages name, each fourth of them changed since.
NAMED_SQL = f"""
SELECT page_id, 'wiki/w' || {_PAGE} || '.md' AS path, '---' || {_NL} || 'updated:' || CASE WHEN page_id % 40 = 0 THEN '\u00a02024-04-01' ELSE ' ' || '"2024-03-01"' END || {_NL} || '---' || {_NL} AS text
FROM pages WHERE page_id % 10 = 0"""
_ASSETS = ["html/assets/style.css", "html/assets/theme.js"]


def _tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    name = re.search(r"FROM (\w+)", sql)[1]
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: _tables(spark, sf_dir, name)}).drop("doc_id", "page_id")


def _files(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.lit(False).alias("is_dir"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("size"), "text")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _derived(spark, sf_dir, NOTES_SQL)


def vault(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes, wiki pages, in each vault an index that links every fourth page by its id, and images of some pages."""
    docs = _tables(spark, sf_dir, "documents").select("doc_id", F.expr(_HOME).alias("home"))
    wiki = _derived(spark, sf_dir, WIKI_SQL)
    entry = F.format_string("- [p](p%d/page_%d.md)", F.col("doc_id") % 5, F.col("doc_id"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("row")))), lambda x: x["row"])
    index = docs.where("doc_id % 4 <> 1").groupBy("home").agg(F.concat_ws("\n", listed).alias("text")).select(F.concat("home", F.lit("wiki/index.md")).alias("path"), "text")
    images = docs.where("doc_id % 2 = 0").select(F.format_string("%swiki/p%d/img %d.png", "home", F.col("doc_id") % 5, F.col("doc_id")).alias("path"), F.lit(None).cast("string").alias("text"))
    files = notes(spark, sf_dir).unionByName(wiki).unionByName(index).unionByName(images)
    return _files(files)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(_derived(spark, sf_dir, PAGES_SQL))


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, the wiki pages that they name, and the two shared assets."""
    assets = spark.range(1).select(F.explode(F.array(*map(F.lit, _ASSETS))).alias("path"), F.lit("").alias("text"))
    return pages(spark, sf_dir).unionByName(_files(_derived(spark, sf_dir, NAMED_SQL).unionByName(assets)))


def _heads(rule) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rules.emit(extract.frontmatter(notes(spark, d)), rule()).select("path", "line", "code")


def _wiki(rule) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rule(*lint.wiki_relations(vault(spark, d), home=HOME)[:2]).select("path", "line", "code")


def _images(rule) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: rules.emit(lint.image_relations(vault(spark, d), home=HOME)[1], rule()).select("path", "line", "code")


def _html(*parts) -> Callable[[SparkSession, str], DataFrame]:
    """Rules on pages that need no other file."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = rules.page_rows(extract.parse(pages(spark, d), ["elements", "placeholders"], ["path"]))
        return rules.emit(rows, *[r() for r in parts]).select("path", "line", "code")

    return run


def _html_settled(rule) -> Callable[[SparkSession, str], DataFrame]:
    """Rules on pages that other files decide."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        held = lint.parsed(site(spark, d), ["elements", "placeholders"], F.col("path").endswith(".html"), dates=True)
        return rules.settle(rules.emit(rules.page_rows(held.where("wanted")), rule()), lint.facts(held)).select("path", "line", "code")

    return run


def _page_links(spark: SparkSession, d: str) -> DataFrame:
    return extract.markdown_links(_derived(spark, d, WIKI_SQL)).select("path", "line", "label", "target")


def _targets_normalized(spark: SparkSession, d: str) -> DataFrame:
    links = _page_links(spark, d)
    t = F.col("target")
    return links.select("path", "line", "target", fn.external_in_wiki(t).alias("external"), fn.percent_decode(fn.strip_fragment(t)).alias("decoded"), fn.canonical_target(t).alias("canonical"), paths.resolve(paths.parent(F.col("path")), fn.strip_fragment(t)).alias("resolved"))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return extract.html_elements(pages(spark, d)).select("path", "ord", "line", "tag", extract.attribute("href").alias("href"), F.size("attrs").alias("n_attrs"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    files = vault(spark, d).unionByName(_files(_derived(spark, d, DECLARED_SQL)))
    return lint.candidates(files, home=HOME).select("page", "source_count", "total_bytes", "state", F.size("html_pages").alias("n_pages"))


def _images_found(spark: SparkSession, d: str) -> DataFrame:
    return extract.image_links(vault(spark, d)).select("path", "line", "target", "kind")


def _vault_files(spark: SparkSession, d: str) -> DataFrame:
    """The pages written as files to a vault in the shared folder, and read again."""
    root = f"{scratch(spark)}/quillmesh/vault-{uuid.uuid4().hex}".removeprefix("file://")
    os.makedirs(root)
    write(pages(spark, d).select("path", "text", F.lit(None).cast("string").alias("source")), root)
    return scan(spark, root).where("path LIKE 'html/%'").select("path", "size", F.sha2("text", 256).alias("text_sha256"))


def page_summary(spark: SparkSession, d: str) -> DataFrame:
    return lint.summary(lint.lint_html(site(spark, d))).select("code", "findings", "files")


def _fix_plan(spark: SparkSession, d: str) -> DataFrame:
    return fixes.plan(vault(spark, d), home=HOME)[1].select("path", "new_text", "fixed", "normalized_links", "removed_links")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "src001": _heads(rules.src001), "src002": _heads(rules.src002), "src003": _heads(rules.src003), "src004": _heads(rules.src004),
    "src005": _heads(rules.src005), "src006": _heads(rules.src006), "src007": _heads(rules.src007),
    "frontmatter_entries": lambda s, d: extract.frontmatter_entries(notes(s, d)),
    "links": _page_links, "link_targets_normalized": _targets_normalized, "image_links": _images_found,
    "source_items": lambda s, d: extract.source_items(_derived(s, d, WIKI_SQL)).select("path", "item"),
    "wiki001": _wiki(lambda files, targets: rules.wiki001(files, targets, home=HOME)), "wiki002": _wiki(lambda _, targets: rules.emit(targets, rules.wiki002())),
    "wiki003": _wiki(lambda _, targets: rules.emit(targets, rules.wiki003())), "wiki004": _wiki(lambda files, targets: rules.wiki004(files, targets, home=HOME)),
    "img001": _images(rules.img001), "img002": _images(rules.img002),
    "html001": _html(rules.html001), "html002": _html(rules.html002), "html003": _html(rules.html003), "html004": _html(rules.html004),
    "html005": _html(rules.html005), "html006": _html_settled(rules.html006), "html007": _html(rules.html007), "html008": _html_settled(rules.html008),
    "elements": _elements, "candidates": _candidates, "diagnostic_summary": page_summary,
    "source_report": lambda s, d: report.diagnostic_lines(rules.only(rules.emit(extract.frontmatter(notes(s, d)), rules.src006()))),
    "rename_plan": lambda s, d: fixes.plan(vault(s, d), home=HOME)[0].select("source", "destination"), "fix_plan": _fix_plan,
    "vault_files": _vault_files,
}

_OK = "n.doc_id % 13 <> 5 AND n.doc_id % 17 <> 4"
_N = f"({NOTES_SQL}) n"
_STEM = "regexp_extract(path, '([^/]*)$', 1)"
_LINKS = f"""(SELECT path, doc_id, CAST(line AS INTEGER) AS line, unnest(regexp_extract_all(row, '(!?)\\[([^\\[\\]]*)\\]\\(([^)\\s]+)\\)', 1)) AS bang,
  unnest(regexp_extract_all(row, '(!?)\\[([^\\[\\]]*)\\]\\(([^)\\s]+)\\)', 2)) AS label, unnest(regexp_extract_all(row, '(!?)\\[([^\\[\\]]*)\\]\\(([^)\\s]+)\\)', 3)) AS target
  FROM (SELECT path, doc_id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({WIKI_SQL}) w) WHERE contains(row, ']('))"""

# A tag's row of text, in the order of the text; pages have no tag within a script or a comment.
_TAG = "<([a-zA-Z][a-zA-Z0-9]*)([^>]*)>"
_TAGS = f"""(SELECT page_id, path, CAST(line AS INTEGER) AS line, lower(regexp_extract(raw, '{_TAG}', 1)) AS tag, regexp_extract(raw, '{_TAG}', 2) AS attrs,
    CAST(row_number() OVER (PARTITION BY page_id ORDER BY line, turn) - 1 AS INTEGER) AS ord
  FROM (SELECT page_id, path, line, unnest(tags) AS raw, generate_subscripts(tags, 1) AS turn FROM (
    SELECT page_id, path, line, regexp_extract_all(row, '{_TAG}') AS tags FROM (
      SELECT page_id, path, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({PAGES_SQL}) p))))"""


def _attribute(name: str) -> str:
    return f"regexp_extract(attrs, '(?:^|\\s){name}=\"([^\"]*)\"', 1)"


_OUTSIDE = "(starts_with({0}, '//') OR regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*:'))"
_TARGETS = f"""(SELECT page_id, path, line, ord, tag, unnest([{", ".join(_attribute(a) for a in rules.URL_ATTRIBUTES)}]) AS target FROM {_TAGS})"""
_META = f"""(SELECT page_id, path, line, {_attribute("content")} AS content, regexp_matches({_attribute("content")}, '^[^\\s\\x{{A0}}]+ \\p{{Nd}}{{4}}-\\p{{Nd}}{{2}}-\\p{{Nd}}{{2}}$') AS good
  FROM {_TAGS} WHERE tag = 'meta' AND {_attribute("name")} = 'wiki-source')"""
_THERE = f"SELECT path FROM ({PAGES_SQL}) p0 UNION ALL SELECT path FROM ({NAMED_SQL}) n0 UNION ALL SELECT unnest({_ASSETS})"
_SHEETS = f"(SELECT * FROM (SELECT *, {_attribute('href')} AS href FROM {_TAGS}) WHERE tag = 'link' AND contains(lower({_attribute('rel')}), 'stylesheet') AND NOT {_OUTSIDE.format('href')})"
_RESOURCES = ", ".join(f"'{t}'" for t in rules.RESOURCE_TAGS)

HTML_SQL = {
    "html001": f"SELECT path, line, 'HTML001' AS code FROM {_TARGETS} WHERE tag IN ({_RESOURCES}) AND target <> '' AND {_OUTSIDE.format('target')}",
    "html002": f"SELECT path, line, 'HTML002' AS code FROM {_TAGS} WHERE tag = 'script' AND {_attribute('src')} <> 'assets/theme.js'",
    "html003": f"SELECT path, line, 'HTML003' AS code FROM {_TAGS} WHERE tag = 'iframe'",
    "html004": f"""SELECT path, line, 'HTML004' AS code FROM {_SHEETS} WHERE href <> 'assets/style.css'
      UNION ALL SELECT path, 1, 'HTML004' FROM ({PAGES_SQL}) p1 WHERE path NOT IN (SELECT path FROM {_SHEETS})""",
    "html005": f"""SELECT path, line, 'HTML005' AS code FROM {_META} WHERE NOT good
      UNION ALL SELECT path, 1, 'HTML005' FROM ({PAGES_SQL}) p1 WHERE path NOT IN (SELECT path FROM {_META})""",
    "html006": f"""SELECT path, line, 'HTML006' AS code FROM (
        SELECT path, line, CASE WHEN starts_with(target, '/') THEN target ELSE 'html/' || split_part(url_decode(target), '#', 1) END AS file
        FROM {_TARGETS} WHERE target <> '' AND NOT starts_with(target, '#') AND NOT {_OUTSIDE.format('target')}
        UNION ALL SELECT path, line, split_part(content, ' ', 1) FROM {_META} WHERE good) WHERE file NOT IN ({_THERE})""",
    "html007": f"""SELECT path, CAST(len(string_split(split_part(text, mark, 1), chr(10))) AS INTEGER) AS line, 'HTML007' AS code
      FROM (SELECT path, text, unnest(regexp_extract_all(text, '\\{{\\{{[^}}\\n]*\\}}\\}}')) AS mark FROM ({PAGES_SQL}) p1)""",
    "html008": f"""SELECT m.path, line, 'HTML008' AS code FROM {_META} m JOIN ({NAMED_SQL}) n ON split_part(content, ' ', 1) = n.path
      WHERE good AND split_part(content, ' ', 2) <> regexp_extract(n.text, 'updated:[ \\x{{A0}}]"?([0-9-]+)', 1)""",
}
_EVERY_FINDING = " UNION ALL ".join(f"SELECT path, code FROM ({sql}) f{i}" for i, sql in enumerate(HTML_SQL.values()))

# Images: the markdown ones and the embedded ones of a text's lines, with the page's folder.
_DECODED = "url_decode(target)"
_IMAGES = f"""(SELECT path, doc_id, CAST(line AS INTEGER) AS line, regexp_replace(path, '/[^/]*$', '') AS folder, target, kind FROM (
    SELECT path, doc_id, line, 'markdown' AS kind, unnest(regexp_extract_all(row, '!\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS target FROM rows_of
    UNION ALL SELECT path, doc_id, line, 'obsidian', split_part(split_part(unnest(regexp_extract_all(row, '!\\[\\[([^\\]]+)\\]\\]', 1)), '|', 1), '#', 1) FROM rows_of)
  WHERE ends_with(target, '.png'))""".replace("rows_of", f"(SELECT path, doc_id, unnest(string_split(text, chr(10))) AS row, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM ({WIKI_SQL}) w)")
_PICTURES = f"SELECT {_HOME} || 'wiki/p' || (doc_id % 5) || '/img ' || doc_id || '.png' FROM documents WHERE doc_id % 2 = 0"
_CANONICAL = f"replace({_DECODED}, ' ', '_')"
_MISSING = " AND ".join(f"folder || '{below}/' || {t} NOT IN ({_PICTURES})" for below in ("", "/images") for t in (_DECODED, "target", _CANONICAL))
_HEAD_LINES = f"(SELECT path, unnest(string_split(text, chr(10))[2:4]) AS row, unnest([2, 3, 4]) AS line FROM {_N} WHERE {_OK})"

_ITEMS = f"""(SELECT doc_id AS d, '../../' || {_NOTE} AS item FROM documents
  UNION ALL SELECT doc_id, '../../' || {_OTHERS[0]} FROM documents WHERE doc_id % 8 = 0 UNION ALL SELECT doc_id, '../../' || {_OTHERS[1]} FROM documents WHERE doc_id % 8 = 0)"""

_OWN = "regexp_extract(path, '^v[0-9]+/')"

ORACLE_SQL: dict[str, str] = HTML_SQL | {
    "src001": f"SELECT path, 1 AS line, 'SRC001' AS code FROM {_N} WHERE trim(string_split(text, chr(10))[1]) <> '---'",
    "src002": f"SELECT path, 1 AS line, 'SRC002' AS code FROM {_N} WHERE starts_with(text, '---') AND NOT regexp_matches(text, '\\n[ \\t]*---[ \\t]*(\\n|$)')",
    "src003": f"SELECT path, 1 AS line, 'SRC003' AS code FROM {_N} WHERE {_OK} AND NOT contains(text, chr(10) || 'created:')",
    "src004": f"SELECT path, 2 AS line, 'SRC004' AS code FROM {_N} WHERE starts_with(text, '---' || chr(10) || 'title: \"\"') ",
    "src005": f"SELECT path, 2 AS line, 'SRC005' AS code FROM {_N} WHERE {_OK} AND regexp_matches(string_split(text, chr(10))[2], '\\{{\\{{[^}}]+\\}}\\}}')",
    "src006": f"SELECT path, 1 AS line, 'SRC006' AS code FROM {_N} WHERE {_OK} AND NOT regexp_matches({_STEM}, '^\\p{{Nd}}{{4}}-\\p{{Nd}}{{2}}-\\p{{Nd}}{{2}}_.+\\.md$')",
    "src007": f"SELECT path, 3 AS line, 'SRC007' AS code FROM {_N} WHERE {_OK} AND regexp_matches({_STEM}, '^\\p{{Nd}}{{4}}-') AND starts_with(string_split(text, chr(10))[3], 'created: ') AND string_split(text, chr(10))[3] <> 'created: ' || substr({_STEM}, 1, 10)",
    "frontmatter_entries": f"""SELECT path, trim(split_part(row, ':', 1)) AS key, CAST(line AS INTEGER) AS line, regexp_replace(trim(substr(row, strpos(row, ':') + 1)), '^"(.*)"$', '\\1') AS value
      FROM {_HEAD_LINES} WHERE contains(row, ':') AND NOT starts_with(row, '#')""",
    "links": f"SELECT path, line, label, target FROM {_LINKS} WHERE bang = ''",
    "link_targets_normalized": f"""SELECT path, line, target, starts_with(target, '#') OR {_OUTSIDE.format("target")} AS external, url_decode(split_part(target, '#', 1)) AS decoded, {_CANONICAL} AS canonical,
      regexp_replace(CASE WHEN starts_with(target, '../../') THEN {_OWN} || substr(target, 7) ELSE regexp_replace(path, '/[^/]*$', '') || '/' || split_part(target, '#', 1) END, '/+', '/', 'g') AS resolved FROM {_LINKS} WHERE bang = ''""",
    "image_links": f"SELECT path, line, target, kind FROM {_IMAGES}",
    "img001": f"SELECT path, line, 'IMG001' AS code FROM {_IMAGES} WHERE {_MISSING}",
    "img002": f"SELECT path, line, 'IMG002' AS code FROM {_IMAGES} WHERE target <> {_CANONICAL}",
    "rename_plan": f"""SELECT DISTINCT folder || '/' || {_DECODED} AS source, folder || '/' || {_CANONICAL} AS destination FROM {_IMAGES}
      WHERE target <> {_CANONICAL} AND folder || '/' || {_DECODED} IN ({_PICTURES})""",
    "fix_plan": f"""SELECT path, new_text, new_text <> text AS fixed, CAST(changed AS INTEGER) AS normalized_links, CAST(gone AS INTEGER) AS removed_links FROM (
        SELECT path, text, CASE WHEN doc_id % 10 = 6 THEN 0 WHEN doc_id % 7 = 3 THEN 2 ELSE 1 END AS changed, CASE WHEN doc_id % 10 = 6 OR doc_id % 2 = 0 THEN 0 ELSE 2 END AS gone,
          CASE WHEN doc_id % 2 = 0 THEN replace(replace(text, '(img%20' || doc_id || '.png)', '(img_' || doc_id || '.png)'), '[[img ' || doc_id || '.png#f', '[[img_' || doc_id || '.png#f')
            ELSE replace(replace(replace(text, '![i](img%20' || doc_id || '.png)', ''), '![[img_' || doc_id || '.png|30]]', ''), '![[img ' || doc_id || '.png#f|30]]', '') END AS new_text FROM ({WIKI_SQL}) w
        UNION ALL SELECT path, text, 0, 0, text FROM {_N}
        UNION ALL SELECT {_HOME} || 'wiki/index.md', string_agg('- [p](p' || (doc_id % 5) || '/page_' || doc_id || '.md)', chr(10) ORDER BY doc_id) AS t, 0, 0, t FROM documents WHERE doc_id % 4 <> 1 GROUP BY {_HOME})""",
    "wiki001": f"SELECT {_HOME} || 'wiki/p' || (doc_id % 5) || '/page_' || doc_id || '.md' AS path, 1 AS line, 'WIKI001' AS code FROM documents WHERE doc_id % 4 = 1",
    "wiki002": f"SELECT path, line, 'WIKI002' AS code FROM {_LINKS} WHERE bang = '' AND starts_with(target, 'missing')",
    "wiki003": f"SELECT path, line, 'WIKI003' AS code FROM {_LINKS} WHERE bang = '' AND contains(label, '*')",
    "wiki004": f"SELECT path, 1 AS line, 'WIKI004' AS code FROM {_N} WHERE path NOT IN (SELECT {_OWN} || substr(target, 7) FROM {_LINKS} WHERE bang = '' AND starts_with(target, '../../'))",
    "elements": f"SELECT path, ord, line, tag, {_attribute('href')} AS href, CAST(len(regexp_extract_all(attrs, '=\"')) AS INTEGER) AS n_attrs FROM {_TAGS}",
    "diagnostic_summary": f"SELECT code, count(*) AS findings, count(DISTINCT path) AS files FROM ({_EVERY_FINDING}) GROUP BY code",
    "candidates": f"""SELECT page, count(size) AS source_count, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes,
        CASE WHEN doc_id % 3 <> 0 THEN 'missing' WHEN doc_id % 2 = 1 OR doc_id % 12 = 0 THEN 'stale' ELSE 'current' END AS state,
        CAST(CASE WHEN doc_id % 3 <> 0 THEN 0 WHEN doc_id % 12 = 0 THEN 2 ELSE 1 END AS INTEGER) AS n_pages
      FROM (SELECT w.doc_id, w.path AS page, strlen(n.text) AS size FROM ({WIKI_SQL}) w JOIN {_ITEMS} i ON i.d = w.doc_id LEFT JOIN {_N} ON n.path = regexp_extract(w.path, '^v[0-9]+/') || substr(i.item, 7))
      GROUP BY doc_id, page HAVING source_count >= 3 OR total_bytes >= 30000""",
    "vault_files": f"SELECT path, CAST(strlen(text) AS BIGINT) AS size, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_sha256 FROM ({PAGES_SQL}) p",
    "source_items": f"SELECT path, item FROM ({WIKI_SQL}) w0 JOIN {_ITEMS} i ON w0.doc_id = i.d",
    "source_report": f"""SELECT path, 1 AS line, 'SRC006' AS code, path || ':1: [SRC006] the file name is not `YYYY-MM-DD_slug.md`' AS text
      FROM {_N} WHERE {_OK} AND NOT regexp_matches({_STEM}, '^\\p{{Nd}}{{4}}-\\p{{Nd}}{{2}}-\\p{{Nd}}{{2}}_.+\\.md$')""",
}
