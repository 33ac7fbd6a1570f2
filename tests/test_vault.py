"""Python's character classes, one parse a linter, renames in document order, and the vault's reader and writer."""

import os
import random
import re
import time
from pathlib import PurePosixPath
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F
from test_lint import GOOD, PAGE, codes, make

from quillmesh import cli
from quillmesh.functions import text as fn
from quillmesh.operators import extract, resolve
from quillmesh.plans import fixes, lint, report
from quillmesh.sources import vault
from quillmesh.sources.vault import VaultReader, recover, scan

FILE = "path string, is_dir boolean, size long, text string"


@pytest.mark.parametrize("kind", [r"\s", r"\S", r"\d"])
def test_classes_hold_the_code_points_that_python_says(spark, kind):
    points = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343")
    char = F.decode(F.unhex(F.concat(F.lit("00000078"), F.lpad(F.hex("id"), 8, "0"))), "utf-32")
    got = {r[0] for r in points.where(char.rlike(rf"\Ax{fn.java(kind)}\z")).select("id").collect()}
    assert got == {c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and re.fullmatch(kind, chr(c))}


SPACES, DIGITS = [" ", " ", "\x1c", "\x85", "　", "\t"], "٠١٢٣"


def test_patterns_read_as_python_reads_them(spark):
    day = "".join(DIGITS[int(c)] if c in "0123" else c for c in "2023-01-02")
    names = ["2024-01-01_a.md", "2024-01-01_a\nb.md", "2024-01-01_a.md\n", f"{day}_a.md", "2024-01-01_.md", "2024-01-01_a .md", "a\n2024-01-01_a.md", "2024-01-01_a.mdx"]
    meant = re.compile(r"^(\d{4}-\d{2}-\d{2})_(.+)\.md$")
    rows = spark.createDataFrame([(f"sources/{n}", GOOD) for n in names], "path string, text string")
    found = {r["path"][8:] for r in extract.frontmatter(rows).select("path", F.element_at(F.split("path", "/"), -1).rlike(fn.file_name()).alias("ok")).where("ok").collect()}
    assert found == {n for n in names if meant.fullmatch(n)} and len(found) == 3

    contents = [f"wiki/a{s}b.md 2024-01-01" for s in SPACES] + [f"wiki/a.md {day}", "wiki/a.md 2024-01-01\n", "wiki/a.md 2024-01-01 ", "wiki/a.md  2024-01-01", " wiki/a.md 2024-01-01", "wiki/a.md 2024-01-01\r"]
    source, date = extract.declared(F.col("content"))
    meant = re.compile(r"^(\S+) (\d{4}-\d{2}-\d{2})$")
    got = {r["content"]: (r["s"], r["d"]) for r in spark.createDataFrame([(c,) for c in contents], "content string").select("content", source.alias("s"), date.alias("d")).collect()}
    assert got == {c: (m[1], m[2]) if (m := meant.match(c)) else (None, None) for c in contents} and sum(v[0] is not None for v in got.values()) == 2

    texts = [f"---\nupdated:{s}2024-01-01{t}\nx\n---\n" for s in [*SPACES, "", '"'] for t in [*SPACES, "", '"', "x"]]
    texts += ["---\na\x85updated: 2024-05-05\nupdated: 2024-01-01\n---", f"---\nupdated: {day}\n---", "---\nupdated:\n2024-01-01\n---", "---updated: 2024-01-01\n---", "---\nupdated: 2024-01-01\r\n---", "---\nupdated: 2024-01-01", "x---\nupdated: 2024-01-01\n---", "---\n---\nupdated: 2024-01-01\n---"]
    meant = re.compile(r"^updated:\s*\"?(\d{4}-\d{2}-\d{2})\"?\s*$", re.MULTILINE)

    def head(t):
        return t[: t.find("\n---", 3)] if t.startswith("---") and "\n---" in t[3:] else ""

    want = {t: m[1] if (m := meant.search(head(t))) else None for t in texts}
    got = {r["t"]: r["d"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", fn.page_updated(F.col("t")).alias("d")).collect()}
    assert got == want and sum(v is not None for v in want.values()) > 40


def items(text):
    if not text.startswith("---") or "\n---" not in text[3:]:
        return []
    out, inside = [], False
    for line in text[: text.find("\n---", 3)].splitlines():
        if re.match(r"^sources:\s*$", line):
            inside = True
        elif inside:
            m = re.match(r"^\s+-\s*\"?([^\"]+?)\"?\s*$", line)
            inside = bool(m)
            out += [m[1]] if m else []
    return out


def test_source_lists(spark):
    r = random.Random(3)
    lines = ["sources:", "sources: ", "sources: []", "  - a.md", " - b.md", " -　\"c d.md\"\x1c", "- x", "", "  -", '  - "e"f"', "title: y", "  - g\x85  - h", "---", "--- x"]
    texts = ["---\n" + "\n".join(r.choices(lines, k=r.randint(0, 12))) + r.choice(["\n---\n  - no", ""]) for _ in range(3000)] + ["---sources:\n  - a\n---", "sources:\n  - a", "", "---\nsources:\n" + "  - a.md\n" * 50_000 + "---\n"]
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {}
    for x in sorted(extract.source_items(rows).collect(), key=lambda x: x["ord"]):
        got.setdefault(x["path"], []).append(x["item"])
    want = {str(i): items(t) for i, t in enumerate(texts) if items(t)}
    assert got == want and len(want) > 200


def test_schemes_are_those_of_url_parsing(spark):
    from urllib.parse import urlparse

    alphabet = ["a", "B", "1", ":", "/", "//", "#", "?", "+", ".", "-", "\t", " ", "\x01", "é", "file:", "x y"]
    r = random.Random(5)
    targets = sorted({"".join(r.choices(alphabet, k=r.randint(1, 6))) for _ in range(4000)})
    rows = spark.createDataFrame([(t,) for t in targets], "t string")
    got = {x["t"]: (x["w"], x["h"]) for x in rows.select("t", fn.external_in_wiki(F.col("t")).alias("w"), fn.external_in_html(F.col("t")).alias("h")).collect()}
    for t in targets:
        u = urlparse(t)
        assert got[t] == (t.startswith("#") or bool(u.scheme) or bool(u.netloc), t.startswith("//") or bool(u.scheme)), t
        image = t + "x.png"
        scheme = urlparse(image).scheme
        assert fn.local_image(image) == (not scheme or scheme == "file"), t


def test_many_images_in_linear_time():
    text = "![](a%20b.png) ![[c.png]]\n" * 20_000
    began = time.perf_counter()
    links = extract.image_links_of(text)
    new = fixes.splice(text, [(x[5], x[6], "a_b.png") for x in links if x[7] == "markdown"])
    assert time.perf_counter() - began < 1.5 and len(links) == 40_000
    assert new == text.replace("a%20b", "a_b") and links[-1][2] == 20_000


def test_splice_is_one_edit_after_the_other():
    r = random.Random(8)
    for _ in range(3000):
        text = "".join(r.choices("abcdef", k=r.randint(0, 30)))
        edits = [(a, min(len(text), a + r.randint(0, 12)), r.choice(["", "X", "longer than before"])) for a in r.sample(range(len(text) + 1), min(len(text), r.randint(0, 6)))]
        want = text
        for a, b, new in sorted(edits, reverse=True):
            want = want[:a] + new + want[b:]
        assert fixes.splice(text, edits) == want


def counted(spark, rows, log):
    """Files whose every scan leaves a line in a log."""

    def run(batches):
        with open(log, "a") as f:
            f.write("scan\n")
        yield from batches

    return spark.createDataFrame(rows, FILE).coalesce(1).mapInArrow(run, FILE)


VAULT = [
    ("wiki/index.md", False, 1, "[a](a.md)"), ("wiki/a.md", False, 1, "---\nupdated: 2024-01-01\nsources:\n  - ../sources/n.md\n---\n[b](b.md) ![](x%20y.png) ![](gone.png)"),
    ("wiki/x y.png", False, 1, None), ("sources/n.md", False, 1, GOOD), ("html/a.html", False, 1, PAGE.format(src="wiki/a.md 2023-01-01", body="<a href='gone.html'>{{x}}")), ("html", True, 0, None),
]


@pytest.mark.parametrize("lint_all", [lint.lint_html, lambda f: lint.lint_wiki(f, check_unreferenced=True), lint.lint_images, lint.lint_sources, lambda f: lint.candidates(f, 1, 1), lambda f: fixes.plan(f)[1]])
def test_texts_are_read_and_parsed_once(spark, tmp_path, monkeypatch, lint_all):
    parses = []
    real = extract.parse
    monkeypatch.setattr(extract, "parse", lambda *a, **k: parses.append(1) or real(*a, **k))
    files = counted(spark, VAULT, f"{tmp_path}/log")
    assert lint_all(files).collect() or lint_all is lint.lint_sources
    with open(f"{tmp_path}/log") as f:
        assert f.read() == "scan\n" and len(parses) <= 1


# Renames, hand-run: documents in the order of their paths, the links of each from the last to the first.


def candidates(doc, target):
    out = []
    for t in dict.fromkeys([unquote(target), target, unquote(target).replace(" ", "_")]):
        folder = os.path.dirname(doc)
        for p in [f"{folder}/{t}"] + ([f"{folder}/images/{t}"] if len(PurePosixPath(t).parts) == 1 else []):
            out.append(os.path.normpath(p))
    return list(dict.fromkeys(out))


def canonical(target):
    return unquote(target).replace(" ", "_")


def hand_run(docs, there):
    there, out, seen = set(there), {}, set()
    origin = {p: p for p in there}
    for doc in sorted(docs, key=lambda p: p.split("/")):
        text, renamed, changed = docs[doc], 0, 0
        for start, end, _, raw, target, a, b, kind in sorted(extract.image_links_of(text), key=lambda x: -x[5]):
            new = canonical(target)
            if new == target:
                continue
            first = (os.path.dirname(doc), target) not in seen
            seen.add((os.path.dirname(doc), target))
            source = next((p for p in candidates(doc, target) if p in there), None)
            if first and source and not any(p in there for p in candidates(doc, new)):
                to = os.path.join(os.path.dirname(source), os.path.basename(new)) if len(PurePosixPath(unquote(target)).parts) == 1 else os.path.normpath(os.path.join(os.path.dirname(doc), new))
                if to != source:
                    there.remove(source)
                    there.add(to)
                    origin[to] = origin.pop(source)
                    renamed += 1
            text, changed = text[:a] + fixes.rewritten(raw, new, kind) + text[b:], changed + 1
        broken = [x for x in extract.image_links_of(text) if not any(p in there for p in candidates(doc, x[4]))]
        for start, end, *_ in sorted(broken, key=lambda x: -x[0]):
            text = text[:start] + text[end:]
        left = []
        for _, _, line, _, target, *_ in extract.image_links_of(text):
            left += [(line, "IMG002")] if canonical(target) != target else []
            left += [(line, "IMG001")] if not any(p in there for p in candidates(doc, target)) else []
        out[doc] = (text, text != docs[doc], changed, len(broken), renamed, sorted(left))
    return {(o, p) for p, o in origin.items() if o != p}, out


def random_vault(seed):
    r = random.Random(seed)
    names = ["a b.png", "a_b.png", "a%20b.png", "c d e.png", "c_d e.png", "c_d_e.png", "x.png", "a%2520b.png"]
    folders = ["wiki", "wiki/p", "wiki/p/images", "wiki/images", "sources"]
    images = {f"{r.choice(folders)}/{r.choice(names)}" for _ in range(r.randint(3, 14))}
    docs = {}
    for d in [f"{f}/{n}.md" for f in ("wiki", "wiki/p", "sources", "wiki/p-q") for n in ("one", "two")]:
        parts = []
        for _ in range(r.randint(0, 5)):
            t = r.choice([*names, "p/a%20b.png", "../wiki/a b.png", "images/c d e.png", "gone.png", "./a%20b.png", "a%2520b.png#f"])
            parts.append(r.choice([f"![]({t})", f"![x](<{t}>)", f"![[{t}]]", f"![[{t}|9]]", f'![]({t} "t")', "text\n"]))
        docs[d] = " ".join(parts)
    return docs, images


@pytest.mark.parametrize("seed", [4, 6, 10])
def test_renames_follow_the_order_of_documents(spark, seed):
    docs, images = random_vault(seed)
    rows = [(p, False, 1, t) for p, t in docs.items()] + [(p, False, 1, None) for p in images]
    there = {*docs, *images} | {"/".join(p.split("/")[:k]) for p in [*docs, *images] for k in range(1, 4)}
    moves, texts = hand_run(docs, there)
    renames, edits = fixes.plan(spark.createDataFrame(rows, FILE).repartition(3))
    assert {tuple(r) for r in renames.collect()} == moves
    got = {r["path"]: (r["new_text"], r["fixed"], r["normalized_links"], r["removed_links"], r["renamed_files"], sorted((x["line"], x["code"]) for x in r["remaining"])) for r in edits.collect()}
    assert got == texts


def test_two_pages_want_one_name(spark, tmp_path):
    """The first by path gets it; the other's link then leads to that file too, and its own stays as it is."""
    root = make(tmp_path, {"wiki/a.md": "![](x%20y.png)", "wiki/b.md": "![[images/x y.png]] ![](x%20y.png)", "wiki/x y.png": "first", "wiki/images/x y.png": "second"})
    assert fixes.apply(root, *fixes.plan(scan(spark, root))) == {"fixed_files": 2, "normalized_links": 3, "renamed_files": 2, "removed_links": 0}
    assert sorted(f for _, _, fs in os.walk(root) for f in fs) == ["a.md", "b.md", "x_y.png", "x_y.png"]
    with open(f"{root}/wiki/b.md") as f:
        assert f.read() == "![[images/x_y.png]] ![](x_y.png)"


def texts_below(root):
    out = {}
    for top, _, files in os.walk(root):
        for f in files:
            with open(os.path.join(top, f)) as x:
                out[os.path.relpath(os.path.join(top, f), root)] = x.read()
    return out


def test_a_job_that_fails_changes_nothing(spark, tmp_path):
    start = {f"wiki/{k}.md": f"old {k}" for k in range(40)} | {"wiki/a.png": "image"}
    root = make(tmp_path, start)
    changes = spark.createDataFrame([(f"wiki/{k}.md", f"new {k}", None) for k in range(40)] + [("wiki/b/c.png", None, "wiki/a.png")], vault.CHANGE).repartition(4)
    bad = changes.withColumn("text", F.when(F.col("path") == "wiki/39.md", F.raise_error(F.lit("lost"))).otherwise(F.col("text")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        vault.write(bad, root)
    assert texts_below(root) == start and not os.path.exists(f"{root}/{vault.WRITES}")
    vault.write(changes, root)
    assert texts_below(root) == {f"wiki/{k}.md": f"new {k}" for k in range(40)} | {"wiki/b/c.png": "image"}
    assert sorted(r["path"] for r in scan(spark, root).where("NOT is_dir").collect()) == sorted(texts_below(root))


@pytest.mark.parametrize("cut", range(14))
def test_a_commit_that_is_cut_off_is_ended(tmp_path, monkeypatch, cut):
    """Whatever call of the file system is the last one, each file is whole, and recovering ends the commit or clears it away."""
    start = {"a.md": "old a", "b.md": "old b", "x y.png": "1", "x_y.png": "2"}
    root = make(tmp_path, start)
    writer = vault.VaultWriter(root)
    monkeypatch.setattr(vault.TaskContext, "get", staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})()))
    rows = [{"path": "a.md", "text": "new a", "source": None}, {"path": "x_y.png", "text": None, "source": "x y.png"}, {"path": "z.png", "text": None, "source": "x_y.png"}, {"path": "b.md", "text": "new b", "source": None}]
    message = writer.write(iter(rows))
    assert {k: v for k, v in texts_below(root).items() if not k.startswith(vault.WRITES)} == start
    calls = []
    for name in ("rename", "replace"):
        real = getattr(os, name)

        def limited(*a, real=real):
            if len(calls) >= cut:
                raise OSError("lost")
            calls.append(a)
            return real(*a)

        monkeypatch.setattr(vault.os, name, limited)
    done = True
    try:
        writer.commit([message, None])
    except OSError:
        done = False
    now = {k: v for k, v in texts_below(root).items() if not k.startswith(vault.WRITES)}
    assert now.get("a.md") in ("old a", "new a") and now.get("b.md") in ("old b", "new b")
    calls.clear()
    cut = 99
    monkeypatch.undo()
    ended = recover(root)
    want = {"a.md": "new a", "b.md": "new b", "x_y.png": "1", "z.png": "2"}
    assert texts_below(root) == (want if done or ended else start) and not os.path.exists(f"{root}/{vault.WRITES}") and not (done and ended)


def test_files_are_opened_only_where_texts_are_asked_for(spark, tmp_path, monkeypatch):
    root = make(tmp_path, {"wiki/a.md": "a", "wiki/b.md": "b", "html/c.html": "c", "wiki/d.png": ""})
    opened = []
    real = open
    monkeypatch.setattr(vault, "open", lambda name, *a, **k: opened.append(os.path.relpath(name, root)) or real(name, *a, **k), raising=False)

    def read(columns=None, filters=(), **options):
        opened.clear()
        reader = VaultReader({"path": root, **options}, columns)
        left = list(reader.pushFilters(list(filters)))
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        return sorted(opened), len(rows), left

    assert read() == (["html/c.html", "wiki/a.md", "wiki/b.md"], 7, [])
    assert read(["path", "is_dir"]) == ([], 7, []) and read(suffixes=".html")[0] == ["html/c.html"]
    more = vault.EqualTo(("size",), 1)
    assert read(filters=[vault.StringStartsWith(("path",), "html/"), more]) == (["html/c.html"], 1, [more])
    assert read(filters=[vault.Not(vault.StringEndsWith(("path",), ".md")), vault.EqualTo(("is_dir",), False)])[:2] == (["html/c.html"], 2)
    assert read(filters=[vault.In(("path",), ("wiki/a.md", "x"))])[:2] == (["wiki/a.md"], 1)
    monkeypatch.undo()
    got = scan(spark, root).where("path LIKE 'wiki/%' AND path LIKE '%.md' AND NOT is_dir")
    assert sorted((r["path"], r["text"]) for r in got.collect()) == [("wiki/a.md", "a"), ("wiki/b.md", "b")]
    assert scan(spark, root, columns=["path", "is_dir"]).columns == ["path", "is_dir"] and scan(spark, root, columns=["path", "is_dir"]).count() == 7


def test_links_are_followed(spark, tmp_path):
    root = make(tmp_path, {
        "wiki/index.md": "[a](shelf/a.md) [b](twice/b.md) [c](round/c.md) [d](alias.md) [out](out/x.md) [gone](gone/x.md)", "store/a.md": "[i](../wiki/index.md)", "store/deep/b.md": "",
        "wiki/d_e.md": "[d*](alias.md)", "html/p.html": '<a href="../wiki/shelf/a.md"></a><a href="../wiki/shelf/n.md"></a><meta name="wiki-source" content="wiki/alias.md 2024-01-01">',
    })
    outside = make(tmp_path.parent / f"{tmp_path.name}-out", {"x.md": ""})
    for name, to in (("wiki/shelf", "../store"), ("wiki/twice", "shelf/deep"), ("wiki/round", "round2"), ("wiki/round2", "round"), ("wiki/alias.md", "d_e.md"), ("wiki/out", outside), ("wiki/gone", "nowhere")):
        os.symlink(to, os.path.join(root, name))
    files = scan(spark, root)
    held = {r["path"]: r["link"] for r in files.where("link IS NOT NULL").collect()}
    assert held == {"wiki/shelf": "store", "wiki/twice": "wiki/shelf/deep", "wiki/round": "wiki/round2", "wiki/round2": "wiki/round", "wiki/alias.md": "wiki/d_e.md", "wiki/gone": "wiki/nowhere"}
    links = resolve.link_table(files)
    tried = ["wiki/shelf/a.md", "wiki/twice/b.md", "wiki/round/c.md", "wiki/alias.md", "store/a.md", "wiki/shelf", None]
    got = {r["k"]: r["p"] for r in resolve.follow(spark.createDataFrame([(p, p) for p in tried], "k string, p string"), "p", links).collect()}
    assert got == dict(zip(tried, ["store/a.md", "store/deep/b.md", None, "wiki/d_e.md", "store/a.md", "store", None], strict=True))
    found = codes(lint.lint_wiki(files))
    # the reader does not enter folders that are links, so what an outer one holds is not known
    assert [x for x in found if x[2] == "WIKI002"] == [("wiki/index.md", 1, "WIKI002")] * 3 and not [x for x in found if x[2] == "WIKI001"]
    assert [x[0] for x in found if x[2] == "WIKI003"] == ["wiki/alias.md", "wiki/d_e.md"]
    assert [x for x in codes(lint.lint_html(files)) if x[2] == "HTML006"] == [("html/p.html", 1, "HTML006")]


def test_unreadable_files_are_reported_as_such(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    root = make(tmp_path, {"_template/source.md": GOOD, "sources/2024-01-02_a.md": GOOD, "sources/2024-01-02_b.md": "", "wiki/c.md": "", "html/d.html": "", "html/index.html": "<link rel=stylesheet href=assets/style.css>", "html/assets/style.css": ""})
    for name in ("sources/2024-01-02_b.md", "wiki/c.md", "html/d.html"):
        with open(os.path.join(root, name), "wb") as f:
            f.write(b"ab\xff")
    files = scan(spark, root)
    assert codes(lint.lint_sources(files)) == [("sources/2024-01-02_b.md", 1, "UNREADABLE")]
    assert codes(lint.lint_wiki(files)) == codes(lint.lint_images(files), "wiki/c.md") == [("wiki/c.md", 1, "UNREADABLE")] and codes(lint.lint_html(files)) == [("html/d.html", 1, "UNREADABLE")]
    assert cli.main(["--root", root, "sources"]) == 1 and "[UNREADABLE] not UTF-8 from byte 2 on" in capsys.readouterr().err
    assert fixes.plan(files)[1].where("path = 'wiki/c.md'").count() == 0


def test_report_is_written_in_order_and_counted_at_once(spark, tmp_path):
    rows = [(f"f{k:04}.md", k % 7, "HTML008" if k % 5 == 0 else "HTML001", "m", k % 5 == 0, [k]) for k in range(2000)]
    found = spark.createDataFrame(rows, "path string, line int, code string, message string, warning boolean, place array<int>").repartition(7)
    assert report.write(found, f"{tmp_path}/report") == {"findings": 2000, "errors": 1600}
    names = sorted(n for n in os.listdir(f"{tmp_path}/report") if n.startswith("part-"))
    lines = [x for n in names for x in open(f"{tmp_path}/report/{n}").read().splitlines()]  # noqa: SIM115
    assert lines == [f"{p}:{line}: [{c}] {'warning: ' if w else ''}m" for p, line, c, _, w, _ in rows]


def test_fix_tells_what_stays(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    root = make(tmp_path, {"wiki/p.md": "![](x%2520y.png)\n![](gone.png)![](a%20b.png)", "wiki/x%20y.png": "", "wiki/a b.png": ""})
    plan = fixes.plan(scan(spark, root))
    want = [("wiki/p.md", 1, "IMG002")]
    assert codes(fixes.remaining(plan[1])) == want
    assert cli.main(["--root", root, "images", "--fix"]) == 1 and "wiki/p.md:1: [IMG002]" in capsys.readouterr().err
    assert codes(lint.lint_images(scan(spark, root))) == want


def test_paths_and_parts(spark):
    """Texts of no kind, null and of a file that is not wanted give empty lists."""
    rows = spark.createDataFrame([("a", "[x](y)"), ("b", None), ("c", ""), ("d", "![](z.png)"), ("e", "[x](y)")], "path string, text string")
    got = {r["path"]: (len(r["links"]), len(r["images"])) for r in extract.parse(rows, ["links", "images"], ["path"], F.col("path") != "e").collect()}
    assert got == {"a": (1, 0), "b": (0, 0), "c": (0, 0), "d": (0, 1), "e": (0, 0)}


@pytest.mark.parametrize("run", [lint.lint_html, lambda f, **k: lint.lint_wiki(f, check_unreferenced=True, **k), lint.lint_images, lint.lint_sources, lambda f, **k: lint.candidates(f, 1, 1, **k).select(F.col("page").alias("path"), F.lit(1).alias("line"), F.col("state").alias("code"))])
def test_many_vaults_in_one_relation(spark, run):
    """Each is checked by itself: its index, its sources, its assets."""
    vaults = {"v1/": VAULT, "v22/": [r for r in VAULT if r[0] not in ("wiki/x y.png", "wiki/index.md")] + [("html/assets/style.css", False, 1, ""), ("wiki/gone.png", False, 1, ""), ("sources/2024-01-02_b.md", False, 1, "x")]}
    rows = [(home + p, *r) for home, files in vaults.items() for p, *r in files]
    want = sorted((home + p, line, code) for home, files in vaults.items() for p, line, code in codes(run(spark.createDataFrame(files, FILE))))
    assert codes(run(spark.createDataFrame(rows, FILE), home=r"v\d+/")) == want and want
