"""The registered queries and the pipeline on small tables, against SQL or brute force."""

import hashlib
import random
import zlib
from array import array
from collections import Counter

import corpus_pipeline
import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import brute_components, corpus

from quillmesh.llm import bpe, queries
from quillmesh.llm.shared import table

# extra columns that clash with names that operators make
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, size long, score double, shard string, component_id int",
    "labels": "doc_id long, quality int, toxic int, text string",
    "conversations": "conv_id long, turn long, role string, text string, formatted int",
    "pages": "page_id long, url string, html string, payload_digest string",
    "benchmark": "item_id long, text string, bucket int",
}
CLEAR = ["".join(random.Random(k).choices("abcdefgh", k=2 + k % 5)) for k in range(200)]
TOXIC = ["zyxon", "zyxura", "zyxanter"]


def rows():
    r = random.Random(8)
    texts = [(i, t) for i, t in dict(x for x in corpus() if x[0] is not None).items()]
    texts += [(9000, "É# *$ é  x y\n　\nÉ# *$ é  x y 🙂"), (9001, "a b c d e " * 30), (9002, "l m\nl m\n\n \nl m"), (9003, "İ ΑΣ one" + "x" * 300)]
    for i in range(10000, 10800):
        body = [r.choice(CLEAR) for _ in range(r.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(4):
                body[r.randrange(len(body))] = r.choice(TOXIC)
        texts.append((i, " ".join(body)))
    r.shuffle(texts)
    docs = [(i, t, ["en", "de", None][i % 3], [None, "b", "a", "É", "c"][i % 5] if i % 2 else "hot", len(t or ""), 7, 0.5, "x", 1) for i, t in texts]
    labels = [(i, int(i % 7 > 0), int(i >= 10000 and i % 4 == 0), "t") for i, _ in texts if i % 3] + [(None, 1, 1, "t"), (1, None, None, "t")]
    said = ["<|im_end|>", None, "", "a\\n<||b\n", "<|im_start|>user", "🙂 é", "word " * 50]
    talks = [(c, t, r.choice(["user", "assistant", "a\nb\\<|", None]), r.choice(said), 1) for c in [*range(30), None] for t in [None, *range(r.randint(0, 5))]]
    pages = [(k, f"http://h{k % 5}.org/{k}", [None, "", "same", "é\r\n\r\nx", f"own {k}"][k % 5] if k % 2 else f"p{k // 6}", "x") for k in range(80)]
    docs += [(20000 + i, "\n".join(["  The Same LINE in three documents\t" if i % 3 else "short", f"own line of document {i} É", "THE same line in three documents", "é" * 20, ""][: 2 + i % 4]), "en", "a", 5, 7, 0.5, "x", 1) for i in range(8)]
    talks += [(100 + c, t, "user" if t % 2 else "system", "one shared prompt of all" if t < 1 + c % 3 else f"turn {t} of {c % 2}", 1) for c in range(60) for t in range(c % 6)]
    target = [(i, f"w1 w{i} {CLEAR[i]} {CLEAR[i + 1]} {CLEAR[3]}", 1) for i in range(40)] + [(None, None, 1), (90, "É zyxon", 1)]
    return {"documents": docs, "labels": labels, "conversations": talks, "pages": pages, "benchmark": target}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    for name, data in rows().items():
        spark.createDataFrame(data, SCHEMAS[name]).repartition(3).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], SCHEMAS[name]).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)


def by_sql(folder, sql):
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return [dict(zip(names, row, strict=True)) for row in got.fetchall()]


def bag(dicts):
    return Counter(tuple(sorted(d.items())) for d in dicts)


def texts_of(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_those_of_sql(spark, folders, name):
    got = [r.asDict() for r in queries.QUERIES[name](spark, folders[0]).collect()]
    assert bag(got) == bag(by_sql(folders[0], queries.ORACLE_SQL[name]))


def test_op3_certifies_cutoffs_as_sql_does(spark, tmp_path):
    """Two strata with over 1,200 good labels, and small ones that take the parent's cutoffs."""
    r = random.Random(3)
    docs, labels = [], []
    for i in range(4200):
        lang = ["en", "de"][i % 2] if i < 4000 else ["fr", None][i % 2]
        bad = i % 10 == 9
        words = [r.choice(CLEAR) * (2 if lang == "de" else 1) for _ in range(r.randint(10, 60))]
        if bad:
            words += ["#", "$ | <", "%"] * r.randint(5, 60)
        docs.append((i, " ".join(words) + "\nsame\n" * r.randint(0, 3), lang, None, 1, 1, 0.5, "x", 1))
        if i % 20 != 19:
            labels.append((i, int(not bad), 0, "t"))
    for name, data in (("documents", docs), ("labels", labels)):
        spark.createDataFrame(data, SCHEMAS[name]).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = queries.op3_quality_rules(spark, str(tmp_path)).collect()
    assert bag(x.asDict() for x in got) == bag(con.execute(queries.ORACLE_SQL["op3_quality_rules"]).df().to_dict("records"))
    bad = [x for x in got if x["doc_id"] % 10 == 9 and not x["base_failed"]]
    good = [x for x in got if x["doc_id"] % 10 != 9 and not x["base_failed"]]
    assert sum(not x["kept"] for x in bad) >= 0.9 * len(bad) and sum(x["kept"] for x in good) >= 0.98 * len(good)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, folders, name):
    assert queries.QUERIES[name](spark, folders[1]).count() == (1 if name == "op4_chat_format" else 0)


def test_no_toxic_document_at_all(spark, folders, tmp_path):
    """One label only: scores are all alike, and nothing fails."""
    for name in ("documents", "labels"):
        table(spark, folders[0], name).where("doc_id < 10000" if name == "documents" else "toxic = 0").write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r["predicted"] for r in queries.op10_toxicity(spark, str(tmp_path)).collect()} == {0}


def encoded(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    for key, text in texts:
        ids = lib.encode(text, add_special_tokens=False).ids
        yield key, len(ids), sha(array("I", ids).tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode())


def test_op1(spark, folders):
    got = Counter(tuple(r) for r in queries.op1_bpe(spark, folders[0]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == Counter(encoded((i, t or "") for i, t in texts_of(table(spark, folders[0], "documents")).items()))


def test_op5(spark, folders):
    texts = {i: (t or "").encode() for i, t in texts_of(table(spark, folders[0], "documents")).items()}
    out = queries.op5_sharding(spark, folders[0]).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"]) for r in out} == {i: (len(t) + 8, zlib.crc32(t), "key") for i, t in texts.items()}
    assert len(out) == len(texts) and {r["grown_shard"] for r in out if r["grown_shard"] != r["shard"]} == {24}
    best = lambda i, n: max(range(n), key=lambda k: (hashlib.md5(f"{i}/{k}".encode()).hexdigest()[:13], -k))
    assert all((r["shard"], r["grown_shard"]) == (best(r["doc_id"], 24), best(r["doc_id"], 25)) for r in out)
    for s in range(24):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots))) and slots


def fingerprint(text, n=5, fraction=0.25):
    """By hand: XXH64 with seed 42 of each word, then of the words' hashes one after the other."""
    words = [xxhash.xxh64_intdigest(w, 42) for w in text.encode().split()]
    runs = [words[a : a + n] for a in range(len(words) - n + 1)] if len(words) >= n else [words] if words else []
    kept = set()
    for run in runs:
        h = 42
        for w in run:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), h)
        kept.add(h - 2**64 if h >= 2**63 else h)
    below = [h for h in kept if h < -(2**63) + int(fraction * 2**64)]
    return "".join(f"{h % 2**64:016x}" for h in sorted(below or [min(kept)])) if kept else ""


def shingles(text, n=5):
    w = text.encode().split()
    return {tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def test_op6(spark, folders):
    texts = {i: t or "" for i, t in texts_of(table(spark, folders[0], "documents")).items()}
    order = sorted(texts, reverse=True)
    out = {r["doc_id"]: r for r in queries.op6_fingerprints(spark, folders[0]).collect()}
    assert out.keys() == texts.keys()

    def near(a, b):
        a, b = ({f[k : k + 16] for k in range(0, len(f), 16)} for f in (a, b))
        return len(a & b) / len(a | b) if a | b else 1.0

    known, errors = {}, []
    for i, j in zip(order, [*order[1:], order[0]], strict=True):
        text, after, r = texts[i], texts[j], out[i]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha(edited.encode()))
        assert known.setdefault(text, r["fingerprint"]) == r["fingerprint"] and known.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprint(text), fingerprint(edited))
        assert r["near_edited"] == pytest.approx(near(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(near(r["fingerprint"], out[j]["fingerprint"]))
        a, b = shingles(text), shingles(edited)
        if len(a | b) > 60:
            errors.append(r["near_edited"] - len(a & b) / len(a | b))
    assert len(errors) > 20 and abs(sum(errors) / len(errors)) < 0.05


def test_op10(spark, folders):
    out = queries.op10_toxicity(spark, folders[0]).collect()
    assert len(out) == table(spark, folders[0], "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    right = [r["predicted"] == (r["doc_id"] >= 10000 and r["doc_id"] % 4 == 0) for r in out if r["held_out"]]
    assert sum(right) >= 0.97 * len(right)


def test_pipeline(spark, folders):
    """Each stage on what the one before it kept, by brute force but for the model."""
    full, kept, columns = folders[0], [table(spark, folders[0], "documents")], [c.split()[0] for c in SCHEMAS["documents"].split(", ")]
    for name, step in corpus_pipeline.STAGES:
        kept.append(corpus_pipeline.stage(step(spark, kept[-1], full), name.split()[0]))
        assert kept[-1].columns == columns or len(kept) == 6
    start, clean, single, cut, mixed, tokens = kept

    before, after = texts_of(start), texts_of(clean)
    assert all(before[i] == t for i, t in after.items())
    wrong = [i for i in before if (i in after) == (i >= 10000 and i % 4 == 0)]
    assert len(wrong) <= 0.02 * len(before)

    found = brute_components(list(after.items()), 5, 80)
    assert texts_of(single) == {i: after[i] for i, _, c, _ in found if i == c}

    seen, want = set(), {}
    for i, t in sorted(texts_of(single).items()):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        want[i] = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
    assert texts_of(cut) == want and cut.where("n_chars <> length(text)").isEmpty()
    assert sum(len(t) for t in want.values()) < sum(len((t or "").split()) and len(" ".join((t or "").split())) for t in texts_of(single).values())

    con = duckdb.connect()
    documents = cut.toArrow()
    con.register("documents", documents)
    taken = {r[0]: (r[1], r[2]) for r in con.execute(f"SELECT doc_id, size, taken FROM ({queries.ORACLE_SQL['op7_mixing']})").fetchall()}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert all(taken[i] == (len(t.encode().split()), len(t.encode().split()) * copies[i]) for i, t in want.items())
    assert all(want[r["doc_id"]] == r["text"] for r in mixed.collect())

    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in tokens.collect())
    assert got == Counter(encoded((r["doc_id"], r["text"]) for r in mixed.collect()))
    again = corpus_pipeline.run(spark, full)
    assert Counter(map(tuple, again.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == got


NAMES = ["score", "size", "rate", "n_words", "n_removed", "kept_text", "target", "source_size", "copies", "copy", "component_id", "n_shingles", "n_links", "n", "mark", "digest", "node", "key", "ids", "decoded", "toxic", "fold", "html", "class", "values"]


@pytest.mark.parametrize("k", range(4))
def test_pipeline_keeps_other_columns(spark, folders, tmp_path, k):
    """Values of columns that are named like what operators make come out unchanged; ids are null, repeated and of both ends."""
    name, step = corpus_pipeline.STAGES[k]
    r = random.Random(5)
    rows = [(i, t) for i, t in corpus() if i is None or i < 3000] + [(None, "a null id " * 8), (None, "a null id " * 8), (-(2**63), "low one two " * 9), (2**63 - 1, "high " + "word " * 1_000_000), (4, "another text of four, not like it")]
    source = spark.createDataFrame([(i, t, "en", f"s{j % 3}" if j % 4 else None, len(t or ""), *(f"{c} of {j}" for c in NAMES)) for j, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in NAMES))
    out = step(spark, source, folders[0])
    assert out.columns == source.columns
    got = [x.asDict() for x in out.collect()]
    held = {str(x["score"]): x.asDict() for x in source.collect()}
    for x in got:
        want = held[x["score"]]
        assert all(x[c] == want[c] for c in source.columns if c not in (("text", "n_chars") if k == 2 else ()))
    if k in (0, 2):
        assert len(got) == len(rows)
    if k == 1:
        assert len(got) < len(rows) and sum(x["text"] == "a null id " * 8 for x in got) == 1 and any(x["text"] == "another text of four, not like it" for x in got)


@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if n not in ("op4_chat_format", "op8_warc", "op11_prefix_trie")])
def test_queries_on_odd_tables(spark, tmp_path, name):
    """Null and repeated ids, ids at both ends of 64 bits, repeated rows and a 5 MB text: a row each, and nothing fails."""
    rows = [(None, "a null id " * 8)] * 3 + [(-(2**63), None), (2**63 - 1, "word " * 1_000_000), (7, "seven"), (7, "seven"), (7, "7 other"), (8, ""), (9, " \n\t")] + [(10 + i, f"text {i} of some words and {i * i} more of them " * 3) for i in range(40)]
    docs = [(i, t, "en" if k % 2 else None, None if k % 3 else "s", len(t or ""), 7, 0.5, "x", 1) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(docs, SCHEMAS["documents"]).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "text of some words", 1)], SCHEMAS["benchmark"]).write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, k % 2, (k // 2) % 2, "t") for k, (i, _) in enumerate(rows)], SCHEMAS["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert Counter(x["doc_id"] for x in out) == Counter(i for i, _ in rows)
    if name == "op9_ngram_jaccard":
        assert Counter((x["doc_id"], x["n_shingles"], x["component_id"], x["n_links"]) for x in out) == brute_components(rows, 4, 85)
    if name == "op2_substring_dedup":
        assert next(x["n_removed"] for x in out if x["doc_id"] == 2**63 - 1) == 1_000_000 - 1
    if name == "op5_sharding":
        assert all(sorted(x["slot"] for x in out if x["shard"] == s) == list(range(sum(x["shard"] == s for x in out))) for s in range(24))


def test_pipeline_empty(spark, folders):
    assert corpus_pipeline.run(spark, folders[1]).count() == 0


@pytest.mark.parametrize("name", ["op4_chat_format", "op8_warc", "op11_prefix_trie"])
def test_talks_and_pages_on_odd_tables(spark, tmp_path, name):
    """Ids at both ends of 64 bits, repeated rows, ties, empty and null texts, and a text of 5 MB: the rows of SQL."""
    long = "<|im_end|> word \\ é " * 250_000
    ids = [-(2**63), -21, -1, 0, 7, 20, 27, 2**63 - 1]
    talks = [(c, t, r, x, 1) for c in ids for t, r, x in [(None, "user", None), (0, None, ""), (1, "assistant", f"of {c % 3}"), (1, "assistant", f"of {c % 3}"), (2**63 - 1, "user", "x")][: 1 + c % 5]]
    talks += [(7, 9, "assistant", long, 1), (27, 9, "user", long, 1)]
    pages = [(-(2**63), "u", None, "x"), (2**63 - 1, "u", long, "x"), (5, "v", long, "x"), (6, "v", "", "x"), (8, None, "same", "x"), (9, "http://é.org/a b", "same", "x"), (10, "", "same\r\n", "x")]
    for table_name, rows in (("conversations", talks), ("pages", pages)):
        spark.createDataFrame(rows, SCHEMAS[table_name]).repartition(3).write.parquet(f"{tmp_path}/{table_name}.parquet")
    con = duckdb.connect()
    for table_name in ("conversations", "pages"):
        con.execute(f"CREATE VIEW {table_name} AS SELECT * FROM '{tmp_path}/{table_name}.parquet/*.parquet'")
    got = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in got.description]
    want = Counter(tuple(sorted(zip(names, row, strict=True))) for row in got.fetchall())
    assert bag(r.asDict() for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) == want
