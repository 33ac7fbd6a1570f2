"""The four linters, as plans over a file relation: path, is_dir, size, text, and if they are known link and error.

Each path comes once.  One relation may hold many vaults: ``home`` is the pattern of their folders at the start of paths.  A linter scans the files once: one pass over the texts leaves a table of what
they hold, and all rules, the inventory and the look-ups read that table.  Files that cannot be read
are findings of the code UNREADABLE, and no rule looks at them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions import text as fn
from ..operators import extract, resolve, rules
from ..scratch import stage
from ..sources.vault import chosen_files, inventory


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def required_keys(template: str) -> list[str]:
    """Keys of a template's own frontmatter, in order; raises if it has none that is closed."""
    lines = [x.strip() for x in template.splitlines()]
    if not lines or lines[0] != "---" or "---" not in lines[1:]:
        raise ValueError("the template has no frontmatter")
    head = lines[1 : lines.index("---", 1)]
    return list(dict.fromkeys(x.partition(":")[0].strip() for x in head if x and not x.startswith("#") and ":" in x))


def whole(files: DataFrame) -> DataFrame:
    """files with link and error, null where the relation has none."""
    for name in ("link", "error"):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast("string"))
    return files


def parsed(files: DataFrame, kinds: list[str], wanted: Column, dates: bool = False) -> DataFrame:
    """path, is_dir, size, link, error, wanted, (updated,) and the parts of the texts of those wanted, written to a table: the only scan of the files."""
    rows = whole(files).withColumn("wanted", wanted & F.col("error").isNull())
    keep = ["path", "is_dir", "size", "link", "error", "wanted"]
    if dates:
        keep.append("updated")
        rows = rows.withColumn("updated", F.when(~F.col("is_dir"), fn.page_updated(F.col("text"))))
    return stage(extract.parse(rows, kinds, keep, F.col("wanted")), "parsed")


def unreadable(files: DataFrame, wanted: Column) -> DataFrame:
    rows = files.where(wanted & F.col("error").isNotNull())
    return rules.only(rules.emit(rows, F.array(rules.finding(F.lit(True), "UNREADABLE", 1, F.col("error"), [0]))))


def lint_sources(files: DataFrame, chosen: list[str] | None = None, template: str | None = None, home: str = "") -> DataFrame:
    """One pass, nothing is written: no rule on notes looks at another file."""
    keys = required_keys(template) if template is not None else rules.REQUIRED
    notes = whole(files).where(chosen_files(chosen or ["sources"], ".md", any_file=True, home=home))
    bad = F.col("error").isNotNull()
    heads = extract.frontmatter(notes, keep=["error"]).withColumn("status", F.when(bad, "unreadable").otherwise(F.col("status")))
    return rules.only(rules.emit(heads, F.array(rules.finding(bad, "UNREADABLE", 1, F.col("error"), [0])), *rules.sources(keys)))


def wiki_relations(files: DataFrame, chosen: list[str] | None = None, wiki: str = "wiki", home: str = "") -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(files without texts, links with their targets, symbolic links): both tables written, one scan.

    Links have ``chosen`` where their file was asked for, and are also those of all pages of the wiki.
    """
    asked, page = chosen_files(chosen or [wiki], ".md", any_file=True, home=home), chosen_files([wiki], ".md", home=home)
    held = parsed(files, ["links"], asked | page)
    links = resolve.link_table(held)
    rows = held.select("path", asked.alias("chosen"), page.alias("page"), F.inline("links"))
    return held.drop("links"), stage(resolve.wiki_targets(rows, inventory(held), links), "targets"), links


def lint_wiki(files: DataFrame, chosen: list[str] | None = None, wiki: str = "wiki", sources: str = "sources", check_unreferenced: bool = False, home: str = "") -> DataFrame:
    """chosen narrows the rules on links only, not those on the index and on notes."""
    held, targets, links = wiki_relations(files, chosen, wiki, home)
    whole = targets.where("page")
    parts = [rules.only(rules.emit(targets.where("chosen"), rules.wiki002(), rules.wiki003())), rules.wiki001(held, whole, wiki, links, home)]
    if check_unreferenced:
        parts.append(rules.wiki004(held, whole, wiki, sources, links, home))
    return _union([*parts, unreadable(held, chosen_files(chosen or [wiki], ".md", any_file=True, home=home))])


def image_relations(files: DataFrame, chosen: list[str] | None = None, home: str = "") -> tuple[DataFrame, DataFrame]:
    """(files without texts, written; image links with their targets)."""
    held = parsed(files, ["images"], chosen_files(chosen or ["sources", "wiki"], ".md", home=home))
    return held.drop("images"), resolve.image_targets(held.select("path", F.inline("images")), inventory(held), resolve.link_table(held))


def lint_images(files: DataFrame, chosen: list[str] | None = None, home: str = "") -> DataFrame:
    held, targets = image_relations(files, chosen, home)
    return _union([rules.only(rules.emit(targets, rules.img002(), rules.img001())), unreadable(held, chosen_files(chosen or ["sources", "wiki"], ".md", home=home))])


def facts(held: DataFrame) -> DataFrame:
    """path, updated of all files and directories."""
    return inventory(held, F.max(F.when(F.col("p") == F.col("path"), F.col("updated"))).alias("updated"), keep=["updated"])


def lint_html(files: DataFrame, chosen: list[str] | None = None, home: str = "") -> DataFrame:
    wanted = chosen_files(chosen or ["html"], ".html", home=home)
    held = parsed(files, ["elements", "placeholders"], wanted, dates=True)
    found = rules.emit(rules.page_rows(held.where("wanted"), home), *rules.pages())
    return rules.settle(found, facts(held), resolve.link_table(held)).unionByName(unreadable(held, wanted))


def ordered(diagnostics: DataFrame) -> DataFrame:
    """By path and line, then as the rules come."""
    return diagnostics.orderBy("path", "line", "place", "code", "message")


def summary(diagnostics: DataFrame) -> DataFrame:
    """code, rule, findings, files."""
    names = F.create_map(*[F.lit(x) for pair in rules.RULES.items() for x in pair])
    return diagnostics.groupBy("code").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("path").alias("files")).withColumn("rule", names[F.col("code")])


def candidates(files: DataFrame, least_sources: int = 3, least_bytes: int = 30_000, home: str = "") -> DataFrame:
    """page, source_count, total_bytes, state, html_pages of wiki pages that are worth a page of their own.

    A source named twice counts twice, and so does a page that declares twice.
    """
    special = paths.name(F.col("path")).isin(*rules.SPECIAL_PAGES)
    own = paths.home_of(F.col("path"), home)
    wiki = ~F.col("is_dir") & paths.inner(F.col("path"), home).startswith("wiki/") & F.col("path").endswith(".md") & ~special
    rows = files.withColumn("items", F.when(wiki, extract.source_list(F.col("text"))))
    held = _candidate_parts(rows, home)
    links = resolve.link_table(held)
    items = held.where("items IS NOT NULL").select("path", F.explode("items").alias("item"))
    items = resolve.follow(items.withColumn("resolved", paths.resolve(paths.parent(F.col("path")), fn.percent_decode(F.col("item")))), "resolved", links)
    sizes = held.where(~F.col("is_dir")).select(F.col("path").alias("resolved"), "size")
    sums = items.join(sizes, "resolved").groupBy("path").agg(F.count(F.lit(1)).alias("source_count"), F.sum("size").alias("total_bytes"))
    sums = held.where("items IS NOT NULL").select("path").join(sums, "path", "left").na.fill(0, ["source_count", "total_bytes"])
    kept = sums.where((F.col("source_count") >= least_sources) | (F.col("total_bytes") >= least_bytes))
    declared = extract.provenance(held.select("path", F.inline("elements"))).where("src_path IS NOT NULL")
    declared = resolve.follow(declared.withColumn("resolved", paths.normalize(F.when(F.col("src_path").startswith("/"), F.col("src_path")).otherwise(F.concat(own, "src_path")))), "resolved", links)
    now = held.select(F.col("path").alias("resolved"), F.col("updated").alias("now"))
    stale = F.coalesce(F.col("now") != F.col("declared"), F.lit(False))
    # a declaration is of the page that it names as written: one that climbs with .. names no page of the listing
    told = declared.join(now, "resolved", "left").select("path", "ord", F.concat(own, paths.tidy(F.col("src_path"))).alias("page"), stale.alias("stale"))
    told = told.groupBy("path").agg(F.bool_or("stale").alias("stale"), F.collect_list(F.struct("ord", "page")).alias("d")).select("path", "stale", F.inline("d"))
    pages = told.groupBy(F.col("page").alias("path")).agg(F.sort_array(F.collect_list(F.struct(paths.order_key(F.col("path")).alias("k"), "ord", "path"))).alias("p"), F.bool_or("stale").alias("stale"))
    state = F.when(F.col("p").isNull(), "missing").when(F.col("stale"), "stale").otherwise("current")
    html = F.coalesce(F.transform("p", lambda x: x["path"]), F.array().cast("array<string>"))
    return kept.join(pages, "path", "left").select(F.col("path").alias("page"), "source_count", "total_bytes", state.alias("state"), html.alias("html_pages"))


def _candidate_parts(files: DataFrame, home: str) -> DataFrame:
    """path, is_dir, size, link, items, updated, elements, written: the only scan of the files."""
    rows = whole(files).withColumn("updated", F.when(~F.col("is_dir"), fn.page_updated(F.col("text"))))
    return stage(extract.parse(rows, ["elements"], ["path", "is_dir", "size", "link", "items", "updated"], chosen_files(["html"], ".html", home=home)), "parsed")
