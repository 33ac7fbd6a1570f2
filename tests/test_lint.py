import os
import random
import re
import time

import duckdb
import pytest

from quillmesh import catalog, cli
from quillmesh.operators import extract
from quillmesh.plans import fixes, lint, report
from quillmesh.sources.vault import VaultReader, scan
from quillmesh.streaming import incremental

GOOD = '---\ntitle: "a"\ncreated: 2024-01-02\nupdated: 2024-01-02\n---\nbody'
PAGE = '<html><head><meta name="wiki-source" content="{src}"><link rel="stylesheet" href="assets/style.css"><script src="assets/theme.js"></script></head>{body}</html>'


def make(root, files):
    for name, text in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return str(root)


def codes(df, path=None):
    return sorted((r["path"], r["line"], r["code"]) for r in df.collect() if path is None or r["path"] == path)


def test_sources(spark, tmp_path):
    root = make(tmp_path, {
        "sources/2024-01-02_ok.md": GOOD, "sources/2024-01-03_empty.md": "", "sources/2024-01-02_open.md": "---\ntitle: x\n",
        "sources/2024-01-02_crlf.md": GOOD.replace("\n", "\r\n").replace("\r\n---\r\n", "\r\n  ---\r\n"),
        "sources/2024-01-02_twice.md": GOOD.replace("created: 2024-01-02", "created: 2020-01-01\ncreated: 2024-01-02"),
        "sources/bad.md": GOOD.replace("2024-01-02\nup", "2023-01-02\nup"), "sources/2024-01-04_late.md": GOOD,
        "sources/2024-01-02_gaps.md": '---\ntitle: ""\ncreated: 2024-01-02\nmodel: {{m}}\n---\n', "sources/2024-99-99_x.md": GOOD.replace("2024-01-02", "2024-99-99"),
    })
    assert codes(lint.lint_sources(scan(spark, root))) == [
        ("sources/2024-01-02_gaps.md", 1, "SRC003"), ("sources/2024-01-02_gaps.md", 2, "SRC004"), ("sources/2024-01-02_gaps.md", 4, "SRC005"),
        ("sources/2024-01-02_open.md", 1, "SRC002"), ("sources/2024-01-03_empty.md", 1, "SRC001"), ("sources/2024-01-04_late.md", 3, "SRC007"), ("sources/bad.md", 1, "SRC006"),
    ]


def test_links(spark):
    text = "[a](b.md) ![a](b.png) [a](<b c.md>) [a](b.md \"t\")\n[![i](i.png)](p.md) [x\\]y](q.md)"
    rows = extract.markdown_links(spark.createDataFrame([("p", text), ("long", "[" + "a" * 20000 + "](z.md)"), ("slash", "[" + "\\a" * 5000 + "](z.md)")], "path string, text string")).collect()
    found = {(r["path"], r["line"], r["label"][:9], r["target"]) for r in rows}
    assert found == {("p", 1, "a", "b.md"), ("p", 1, "a", "b c.md"), ("p", 2, "![i](i.pn", "p.md"), ("p", 2, "x\\]y", "q.md"), ("long", 1, "a" * 9, "z.md"), ("slash", 1, "\\a\\a\\a\\a\\", "z.md")}


# Fixed value: a link, as the checks of links define it; exponential in the backslashes of a line.
MEANT = re.compile(r"(?<!!)\[(?P<label>(?:[^\[\]\n]|\\.|\[[^\[\]\n]*\])*)\]\((?:<(?P<angle>[^>\n]+)>|(?P<plain>[^)\s\n]+))\)")


def test_scanner_finds_what_is_meant():
    r = random.Random(2)
    alphabet = ["[", "]", "](", "](", "\\", "\\]", "\\[", "(", ")", "<", ">", "!", " ", "a", "](b)", "[x]", "é\x0b", "\u00a0", "\u2003", "\x1c"]
    some = 0
    for _ in range(200_000):
        line = "".join(r.choices(alphabet, k=r.randint(0, 16)))
        wanted = [(m["label"], m["angle"] or m["plain"]) for m in MEANT.finditer(line)]
        assert extract.scan_links(line) == wanted, line
        some += len(wanted)
    assert some > 20_000


@pytest.mark.parametrize("line", ["[" + "[x]" * 300_000 + "](y)", "[" + "\\[" * 300_000 + "](y)", "[" + "\\[" * 300_000 + "](" * 100_000, "](<" * 300_000, "[](" * 300_000, "[a](b" * 200_000, "[" * 600_000 + "]" * 600_000 + "(x)", "[" + "a" * 1_000_000 + "](y)", "[a](<" + "b" * 1_000_000 + ">)"])
def test_scanner_is_linear(line):
    began = time.perf_counter()
    extract.scan_links(line)
    assert time.perf_counter() - began < 4


def test_links_of_long_labels(spark):
    cases = {"pairs": "[" + "[x]" * 300_000 + "](y)", "escaped": "[" + "\\[" * 300_000 + "](y)", "tex": "\\alpha " * 25 + "[set \\[x] of y](missing.md) [\\]](<  b c.md >)", "space": "[a](b<\u00a0>c.md) [b](c\u2003d) [c](e\x1cf)\n\n[d](g)"}
    got = extract.markdown_links(spark.createDataFrame(list(cases.items()), "path string, text string")).collect()
    assert sorted((x["path"], x["ord"], x["line"], x["label"][:6], x["target"]) for x in got) == [
        ("escaped", 0, 1, "\\[" * 3, "y"), ("pairs", 0, 1, "[x][x]", "y"), ("space", 0, 3, "d", "g"), ("tex", 0, 1, "set \\[", "missing.md"), ("tex", 1, 1, "\\]", "b c.md"),
    ]


def test_wiki(spark, tmp_path):
    root = make(tmp_path, {
        "wiki/index.md": "[a](a.md) [x](x_y.md)", "wiki/a.md": "[b](b.md) [g](gone.md) [h](sub) [s](../sources/n%201.md) [o](note:x) [l](a.md:12) [f](#x) [n](//h/p)\n[2024*01*](x_y.md)",
        "wiki/b.md": "[2024*01*](xy.md)", "wiki/x_y.md": "", "wiki/xy.md": "", "wiki/sub/changelog.md": "", "sources/n 1.md": "", "sources/n2.md": "",
    })
    assert codes(lint.lint_wiki(scan(spark, root), check_unreferenced=True)) == [
        ("sources/n2.md", 1, "WIKI004"), ("wiki/a.md", 1, "WIKI002"), ("wiki/a.md", 2, "WIKI003"), ("wiki/b.md", 1, "WIKI001"), ("wiki/xy.md", 1, "WIKI001"),
    ]


def test_images_and_fixes(spark, tmp_path):
    root = make(tmp_path, {"wiki/p.md": '![](a%20b.png#f) ![[pic.png|300]] ![](a.png "t") ![](none.png)\n![](x%2520y.png) ![](<c d.png> "t")', "wiki/a b.png": "", "wiki/images/pic.png": "", "wiki/x%20y.png": "", "wiki/c d.png": ""})
    assert codes(lint.lint_images(scan(spark, root))) == [("wiki/p.md", 1, "IMG001"), ("wiki/p.md", 1, "IMG002"), ("wiki/p.md", 2, "IMG002")]
    assert fixes.apply(root, *fixes.plan(scan(spark, root))) == {"fixed_files": 1, "normalized_links": 2, "renamed_files": 1, "removed_links": 1}
    with open(os.path.join(root, "wiki/p.md"), encoding="utf-8") as f:
        assert f.read() == '![](a_b.png) ![[pic.png|300]] ![](a.png "t") \n![](x%20y.png) ![](<c d.png> "t")'
    assert codes(lint.lint_images(scan(spark, root))) == [("wiki/p.md", 2, "IMG002")]


def test_html(spark, tmp_path):
    page = PAGE.format
    root = make(tmp_path, {
        "html/assets/style.css": "", "html/assets/theme.js": "", "wiki/a.md": '---\nupdated: "2024-02-02"\n---\n', "wiki/b.md": "---\nupdated: '2024-02-02'\n---\n",
        "html/ok.html": page(src="wiki/a.md 2024-02-02", body="<a href='ok.html#x'>"), "html/old.html": page(src="wiki/a.md 2024-01-01", body=""),
        "html/single.html": page(src="wiki/b.md 2024-01-01", body=""), "html/two.html": page(src="wiki/a.md  2024-02-02", body="\n{{x}}\n\n{{x}}"),
        "html/index.html": "<link rel=stylesheet href=assets/style.css>", "html/out.html": "<link rel=stylesheet href=https://x/y.css><script src='//x/y.js'></script><iframe></iframe><a href='gone.html'><script>var a='</p>'</script>",
    })
    found = lint.lint_html(scan(spark, root))
    assert codes(found) == [
        ("html/old.html", 1, "HTML008"), *[("html/out.html", 1, c) for c in ("HTML001", "HTML001", "HTML002", "HTML002", "HTML003", "HTML004", "HTML005", "HTML006")],
        ("html/two.html", 1, "HTML005"), ("html/two.html", 2, "HTML007"), ("html/two.html", 2, "HTML007"),
    ]
    assert report.exit_status(found.where("code = 'HTML008'")) == 0 and report.exit_status(found) == 1


def test_candidates(spark, tmp_path):
    note = "x" * 15_000
    listing = lambda *names: "---\nsources:\n" + "".join(f'  - "../sources/{n}"\n' for n in names) + "---\n"
    root = make(tmp_path, {
        "sources/a.md": note, "sources/b.md": note, "sources/c.md": note[:-1], "sources/s.md": "x" * 10, "wiki/two.md": listing("a.md", "b.md"), "wiki/less.md": listing("a.md", "c.md"),
        "wiki/three.md": listing("s.md", "s.md", "s.md").replace("---\ns", "---\nupdated: 2024-01-01\ns"), "wiki/none.md": "---\nsources: []\n- x\n---\n", "html/t.html": '<meta name="wiki-source" content="./wiki/three.md 2023-01-01">',
    })
    rows = lint.candidates(scan(spark, root))
    assert sorted((r["page"], r["source_count"], r["total_bytes"], r["state"], r["html_pages"]) for r in rows.collect()) == [("wiki/three.md", 3, 30, "stale", ["html/t.html"]), ("wiki/two.md", 2, 30_000, "missing", [])]
    assert report.candidate_lines(rows).orderBy("page").first()["text"] == "wiki/three.md\tstale\tsources=3\ttotal=0.0KB\thtml=html/t.html"


def lines_of(found):
    return [r["text"] for r in report.diagnostic_lines(lint.ordered(found)).collect()]


def test_findings_come_in_rule_order(spark, tmp_path):
    """Of one line: by key, link or element, and for each by rule; IMG002 before IMG001."""
    root = make(tmp_path, {
        "sources/x.md": "---\nmodel:\ntitle: {{a}}\nupdated: \n---\n", "wiki/p.md": "![](b%20c.png) ![[d.png]] ![](a%20b.png)",
        "html/p.html": "<iframe src='//x/y'></iframe><script></script><link rel=stylesheet href=o.css><meta name=wiki-source content='wiki/none.md 2024-01-01'><a href=gone.html>{{q}}</a>",
    })
    files = scan(spark, root)
    short = lambda found: [re.search(r":(\d+): \[(\w+)\]", x).groups() for x in lines_of(found)]
    assert short(lint.lint_images(files)) == [("1", c) for c in ("IMG002", "IMG001", "IMG001", "IMG002", "IMG001")]
    assert short(lint.lint_html(files)) == [("1", c) for c in ("HTML003", "HTML001", "HTML002", "HTML004", "HTML006", "HTML006", "HTML006", "HTML007")]
    assert short(lint.lint_sources(files)) == [("1", "SRC003"), ("1", "SRC006"), ("2", "SRC004"), ("3", "SRC005"), ("4", "SRC004")]


def test_warnings_are_marked_after_the_code(spark, tmp_path):
    root = make(tmp_path, {"wiki/a.md": "---\nupdated: 2024-02-02\n---\n", "html/index.html": "<link rel=stylesheet href=assets/style.css><meta name=wiki-source content='wiki/a.md 2024-01-01'>", "html/assets/style.css": ""})
    assert lines_of(lint.lint_html(scan(spark, root))) == ["html/index.html:1: [HTML008] warning: `wiki/a.md` was updated on 2024-02-02, after 2024-01-01"]


def test_frontmatter(spark):
    head = "\u3000---\r\n# c\r\nk: 'v'\r\n  a:b: c\x0bk:\tw \u2028\t--- \x85k: later"
    cases = [("whole", head), ("at once", "---\n---\nk: v"), ("open", "---\nk: v\n----\n"), ("none", "k: v\n---"), ("four", "----\n---"), ("empty", ""), ("null", None), ("long", "---\nk: v\n---\n" + "x\n" * 400_000), ("unclosed", "---\n" + "y: z\n" * 200_000)]
    got = {r["path"]: (r["status"], [tuple(e) for e in r["entries"]]) for r in extract.frontmatter(spark.createDataFrame(cases, "path string, text string")).collect()}
    assert got == {
        "whole": ("ok", [("a", 4, "b: c"), ("k", 5, "w")]), "at once": ("ok", []), "open": ("unterminated", []), "none": ("missing", []), "four": ("missing", []), "empty": ("missing", []),
        "null": ("missing", []), "long": ("ok", [("k", 2, "v")]), "unclosed": ("unterminated", []),
    }


def test_index_must_be_a_file(spark, tmp_path):
    root = make(tmp_path, {"wiki/index.md/a.md": "x", "wiki/b.md": "y"})
    assert codes(lint.lint_wiki(scan(spark, root))) == []


def test_declaration_counts_as_written(spark, tmp_path):
    listing = "---\nupdated: 2024-01-01\nsources:\n" + "  - ../sources/s.md\n" * 3 + "---\n"
    page = '<meta name="wiki-source" content="{} 2024-01-01">'
    root = make(tmp_path, {"sources/s.md": "s", "wiki/a.md": listing, "wiki/b.md": listing, "wiki/x/c.md": "", "html/a.html": page.format("wiki/x/../a.md"), "html/b.html": page.format("./wiki//b.md")})
    assert sorted((r["page"], r["state"], r["html_pages"]) for r in lint.candidates(scan(spark, root)).collect()) == [("wiki/a.md", "missing", []), ("wiki/b.md", "current", ["html/b.html"])]


def test_rename_stays_beside_its_file(spark, tmp_path):
    root = make(tmp_path, {"wiki/p.md": "![](./a%20b.png) ![](sub/c%20d.png) ![[e f.png#h|9]] ![](g%20h.png (t))", "wiki/images/a b.png": "", "wiki/sub/c d.png": "", "wiki/images/e f.png": "", "wiki/g h.png": ""})
    renames, edits = fixes.plan(scan(spark, root))
    moved = {tuple(r) for r in renames.collect()}
    assert moved == {("wiki/images/a b.png", "wiki/images/a_b.png"), ("wiki/sub/c d.png", "wiki/sub/c_d.png"), ("wiki/images/e f.png", "wiki/images/e_f.png")}
    assert fixes.rewritten("g%20h.png (t)", "g_h.png", "markdown") == "g_h.png (t)" and fixes.rewritten(" a b c ", "n", "markdown") == " n "
    counts = fixes.apply(root, *fixes.plan(scan(spark, root)))
    assert counts["renamed_files"] == 3 and os.path.exists(os.path.join(root, "wiki/images/a_b.png"))
    with open(os.path.join(root, "wiki/p.md"), encoding="utf-8") as f:
        assert f.read().startswith("![](a_b.png) ![](sub/c_d.png) ![[e_f.png#h|9]]".replace("a_b", "./a_b"))


def test_vault_reader(spark, tmp_path):
    """However few tasks there are, each file and directory comes once."""
    names = [f"d{i}/e{j}/f{k}.md" for i in range(6) for j in range(5) for k in range(3)] + ["top.txt", "d0/bad.md"]
    root = make(tmp_path, dict.fromkeys(names, "é\r\nx"))
    with open(os.path.join(root, "d0/bad.md"), "wb") as f:
        f.write(b"\xff\xfe")
    os.makedirs(os.path.join(root, "hollow/inner"))
    os.symlink(os.path.join(root, "d1"), os.path.join(root, "link"))
    want = {*names, ".", "hollow", "hollow/inner", "link", *(f"d{i}" for i in range(6)), *(f"d{i}/e{j}" for i in range(6) for j in range(5))}
    for n in (1, 3, 64):
        rows = scan(spark, root, partitions=str(n)).collect()
        assert sorted(r["path"] for r in rows) == sorted(want)
        held = {r["path"]: r for r in rows}
        assert held["d1/e1/f1.md"]["text"] == "é\nx" and held["d0/bad.md"]["text"] is None and held["top.txt"]["text"] is None and held["link"]["is_dir"] and held["d0/bad.md"]["size"] == 2
        assert len(VaultReader({"path": root, "partitions": str(n)}).partitions()) <= n


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark, "stop", lambda: None)
    root = make(tmp_path, {
        "_template/source.md": "---\ntitle:\n---\n", "sources/2024-01-02_a.md": "---\ntitle:\n---\n", "wiki/index.md": "[a](a.md)", "wiki/a.md": "![](b%20c.png)", "wiki/b c.png": "",
        "html/assets/style.css": "", "html/index.html": "<link rel=stylesheet href=assets/style.css>",
    })
    run = lambda *a: (cli.main(["--root", root, *a]), capsys.readouterr())
    status, said = run("sources")
    assert status == 1 and said.err.strip() == "sources/2024-01-02_a.md:2: [SRC004] `title` is empty" and said.out.strip() == "1 files, 1 findings"
    assert run("wiki")[0] == 0 and run("wiki", "--check-unreferenced")[0] == 1 and run("html")[0] == 0
    assert run("images")[0] == 1
    status, said = run("images", "--fix")
    assert status == 0 and "renamed_files 1" in said.out and os.path.exists(os.path.join(root, "wiki/b_c.png"))
    status, said = run("html", "--candidates")
    assert status == 0 and said.out.strip() == "0 pending of 0"


def test_stream(spark, tmp_path):
    """Files that arrive in two batches give what all of them give at once."""
    texts = [(f"sources/2024-01-0{k}_x.md", t) for k, t in enumerate([GOOD, "", "---\nx", GOOD.replace("title", "other")], 1)]
    pages = [("html/a.html", "<script></script>{{x}}"), ("html/b.html", "<iframe></iframe>")]
    for k in range(2):
        spark.createDataFrame([*texts[2 * k : 2 * k + 2], pages[k]], "path string, text string").write.parquet(f"{tmp_path}/in/{k}")
    arriving = spark.readStream.schema("path string, text string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for make_plan, name, rows in ((incremental.stream_sources, "found_sources", texts), (incremental.stream_elements, "found_pages", pages)):
        kept = arriving.where("path LIKE 'sources/%'" if rows is texts else "path LIKE 'html/%'")
        query = make_plan(kept).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination()
        whole = make_plan(spark.createDataFrame(rows, "path string, text string"))
        assert codes(spark.table(name)) == codes(whole) != []


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_equal_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = sorted(map(repr, want.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == rows and rows
