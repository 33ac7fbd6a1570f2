"""Line dedup, the prefix trie and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from quillmesh.llm import importance, line_dedup, prefix_trie
from quillmesh.llm.line_dedup import Cuckoo, LineIndex

LINES = [f"a line that is long enough, number {k}" for k in range(30)] + ["short", "", "   " + "x" * 19 + "\t", "É" * 19, "É" * 20]


def lined(n, seed=1):
    r = random.Random(seed)
    rows = [(i, "\n".join(r.choice([x, x.upper(), f" {x}\r"]) for x in r.choices(LINES, k=r.randint(0, 6)))) for i in range(n)]
    return rows + [(None, LINES[0]), (None, LINES[1] + "\n" + LINES[0]), (n, None), (n + 1, ""), (3, LINES[2]), (3, LINES[2])]


def brute_lines(rows, among, min_docs=3, least=20):
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = defaultdict(set)
    for i, text in among:
        for x in (text or "").split("\n"):
            held[strip(x)].add(i)
    rank = lambda i: (i is not None, i)
    gone = {k: max(v, key=rank) for k, v in held.items() if len(k) >= least and len(v) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if strip(x) not in gone or gone[strip(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", "kept_text").collect())


def held_by(index):
    return Counter(tuple(r) for r in index.refs.collect()), Counter(tuple(r) for r in index.postings.collect())


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_lines int, key string")


def test_line_dedup(spark, docs):
    rows = lined(60)
    assert got(line_dedup.drop_frequent_lines(docs(rows))) == brute_lines(rows, rows)
    out = line_dedup.drop_frequent_lines(docs(rows), carry=["key", "n_lines"])
    assert out.columns == ["doc_id", "key", "n_lines", "n_dropped", "kept_text"] and {r["key"] for r in out.collect()} == {"x"}
    assert line_dedup.drop_frequent_lines(docs([])).count() == 0


def test_line_index_is_reversible(spark, docs):
    """Insertions in two parts are one insertion, and what is deleted leaves no trace; new documents are judged by the index."""
    rows = lined(40)
    first, second = rows[:25], rows[25:]
    a = LineIndex(spark).insert(docs(first))
    both = a.insert(docs(second)).insert(docs(rows[20:30]))
    whole = LineIndex(spark).insert(docs(rows))
    assert held_by(both) == held_by(whole)
    assert got(both.rewrite(docs(rows))) == got(whole.rewrite(docs(rows))) == brute_lines(rows, rows)
    new = [(900 + i, t) for i, t in enumerate(LINES)]
    assert got(both.rewrite(docs(new))) == brute_lines(new, [(i, t) for i, t in rows]) != brute_lines(new, [])
    known = {i for i, _ in first}
    gone = docs([r for r in second if r[0] not in known])
    left = [r for r in rows if r[0] in known]
    back = both.delete(gone)
    want = LineIndex(spark).insert(docs(left))
    assert held_by(back) == held_by(want) and got(back.rewrite(docs(rows))) == brute_lines(rows, left)
    keys = want.refs.select("key", "n")
    passed = lambda index: {bytes(r["key"]) for r in index._passed(keys).collect()}
    assert passed(back) == passed(want) == {bytes(r["key"]) for r in want.refs.where("n >= 3").collect()}
    nothing = back.delete(docs(rows))
    assert held_by(nothing) == (Counter(), Counter()) and not passed(nothing)


def test_cuckoo_filter():
    r = random.Random(4)
    keys = [r.randbytes(16) for _ in range(40_000)]
    held = Cuckoo()
    held.add(keys)
    assert held.holds(keys).all() and len(held.tables) == 3
    held = Cuckoo(bytes(held))
    held.remove(keys[:25_000])
    assert held.holds(keys[25_000:]).all() and held.holds(keys[:25_000]).mean() < 0.01
    held.remove(keys[25_000:])
    assert not any(t.any() for t in held.tables) and not held.holds(keys).any()
    held.add([keys[0]] * 20)
    held.remove([keys[0]] * 19)
    assert held.holds(keys[:1]).all()


def test_shards_are_dealt_anew(spark, docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "KEYS", 4)
    monkeypatch.setattr(line_dedup, "FULL", 2)
    rows = lined(60)
    index = LineIndex(spark)
    for k in range(0, len(rows), 22):
        index = index.insert(docs(rows[k : k + 22]))
    assert index.shards == 8 and got(index.rewrite(docs(rows))) == brute_lines(rows, rows)


def talks():
    r = random.Random(6)
    rows = []
    for c in range(-25, 120):
        shared = [("system", "same prompt"), ("user", "hello there"), (None, "x"), ("user", None)][: r.randint(0, 4)]
        own = [(r.choice(["user", "assistant"]), r.choice(["a b c", "", "yes", "no way"])) for _ in range(r.randint(0 if shared else 1, 4))]
        rows += [(c, k if k else None, *t) for k, t in enumerate(shared + own)]
    rows += [(200 + c, k, "user", f"step {k}") for c in range(30) for k in range(12)]
    return rows + [(7, 2, "user", "tie"), (7, 2, "user", "tie"), (None, 1, "user", "of nobody")]


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(role, text) for *_, role, text in sorted(t)] for c, t in own.items()}
    made = {}
    for c in own:
        h, leader = zlib.crc32(str(c).encode()) % 4, c - int(math.fmod(c, 20))
        made[c] = tuple(own.get(leader, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    kids = Counter(path[:-1] for path in nodes if path)
    out = []
    for path, members in nodes.items():
        under = [(p, m) for p, m in nodes.items() if p[: len(path)] == path]
        saved = sum((len(m) - 1) * len(p[-1][1].split()) for p, m in under if p)
        ends = ",".join(str(c) for c in sorted(c for c in members if made[c] == path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids[path], sum(not kids[p] for p, _ in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("kw", [{}, {"most": 15, "few": 1}, {"most": 1, "few": 1}])
def test_prefix_trie(spark, kw, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 7)
    rows = talks()
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    out = prefix_trie.trie(prefix_trie.splice(prefix_trie.turns_of(df)), **kw)
    assert Counter(tuple(r) for r in out.collect()) == brute_trie(rows)
    assert out.columns == [c.split()[0] for c in prefix_trie.NODE.split(", ")]


def test_prefix_trie_of_a_long_conversation(spark):
    """One far longer than a task's share is one chain, built at once."""
    rows = [(1, k, "user", f"{k} and more words") for k in range(20_000)] + [(2, 0, "user", "0 and more words")]
    out = prefix_trie.trie(prefix_trie.turns_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), most=500).collect()
    assert len(out) == 20_001 and next((r["n_convs"], r["n_leaves"], r["saved_tokens"]) for r in out if r["depth"] == 0) == (2, 1, 4)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(prefix_trie.splice(prefix_trie.turns_of(empty))).count() == 0


def brute_resample(rows, target, percent=5, least=20):
    grams = {}

    def count(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        found = Counter(grams.setdefault(g, zlib.crc32(g.encode()) % 10000) for n in (1, 2, 3) for g in (" ".join(w[i : i + n]) for i in range(len(w) - n + 1)))
        return len(w), found

    docs, theirs = [(i, *count(t)) for i, t in rows], [count(t)[1] for t in target]
    s, t = sum((f for _, _, f in docs), Counter()), sum(theirs, Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10000) / ((s[b] + 1.0) * (all_t + 10000)))) for b in {*s, *t}}
    scored = []
    for i, n, found in docs:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * k for b, k in found.items())
        scored.append((i, n, sum(found.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))))
    able = sorted((x for x in scored if x[1] >= least), key=lambda x: (-x[4], x[0] is not None, x[0]))
    drawn = {id(x): k for k, x in enumerate(able[: len(able) * percent // 100], 1)}
    return Counter((*x, drawn.get(id(x))) for x in scored)


@pytest.mark.parametrize("chunk", [importance.CHUNK, 200])
def test_importance(spark, chunk):
    r = random.Random(9)
    words = [f"Word{k}" for k in range(400)] + ["é", "ÀB", "x-y_z", "　", "1.5"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 90)))) for i in range(150)] + [(None, "z " * 30), (None, None), (500, ""), (7, "Again A b " * 9), (7, "Again A b " * 9), (501, "very long " * 2000)]
    target = [" ".join(r.choices(words[:60], k=40)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(*x, 1, 2) for x in rows], "doc_id long, text string, weight int, row int").repartition(3)
    theirs = spark.createDataFrame([(t, 5) for t in target], "text string, doc_id int")
    out = importance.resample(docs, theirs, percent=50, chunk=chunk)
    assert Counter(tuple(x) for x in out.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == brute_resample(rows, target, 50)
    assert importance.resample(docs.limit(0), theirs).count() == 0 and importance.resample(docs, theirs.limit(0), chunk=chunk).count() == len(rows)


def test_ranks_are_counted_range_by_range(spark, monkeypatch):
    monkeypatch.setattr(importance, "PART_ROWS", 50)
    rows = [(i if i % 9 else None, (i * 37) % 50) for i in range(1000)]
    out = importance.ranked(spark.createDataFrame(rows, "k long, v long"), "v", "k", "n").collect()
    order = sorted(rows, key=lambda x: (-x[1], x[0] is not None, x[0]))
    assert [(x["k"], x["v"]) for x in sorted(out, key=lambda x: x["n"])] == order and sorted(x["n"] for x in out) == list(range(1, 1001))


def test_importance_sends_a_run_once(spark, monkeypatch):
    """Neither chunks nor answers are written, the gains and the weights are of one exchange, and long texts and empty ones share chunks."""
    staged = []
    monkeypatch.setattr(importance, "stage", lambda df, name: staged.append(name) or df)
    r = random.Random(9)
    words = [f"{a}{b}" for a in ("Ab", "c", "é", "z9") for b in range(12)]
    rows = [(i, " ".join(r.choices(words, k=r.choice([0, 0, 1, 2, 3, 40])))) for i in range(120)] + [(900, " ".join(r.choices(words, k=500))), (None, None), (5, "Ab1"), *((1000 + i, "") for i in range(60))]
    theirs = [" ".join(r.choices(words, k=30)) for _ in range(8)]
    out = importance.weigh(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(t,) for t in theirs], "text string"), chunk=25)
    got = Counter((x["doc_id"], x["n_words"], x["n_features"], x["weight"]) for x in out.collect())
    assert not staged and out._jdf.queryExecution().executedPlan().toString().count("ReusedExchange")

    low = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    features = lambda t: [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for w in [low(t)] for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    s, t = Counter(f for _, x in rows for f in features(x)), Counter(f for x in theirs for f in features(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    assert got == Counter((i, len(low(x)), len(features(x)), sum(gain[b] for b in features(x))) for i, x in rows)


def test_importance_order_of_sending(monkeypatch):
    """Codes that have no room in 62 bits are sorted column by column, to the same rows; a run of words comes once a chunk."""
    held = importance._Chunk()
    for doc in range(4):
        held.add(doc, b"a b a b c a b a d".split()[doc:], 9 - doc)
    sent = list(held.sent(3))
    monkeypatch.setattr(importance, "ROOM", 1)
    assert list(held.sent(3)) == sent and {part for part, *_ in sent} <= {0, 1, 2}
    texts = [importance.pa.decompress(w[8:], int.from_bytes(w[:8], "little"), codec="zstd", asbytes=True) for _, w, *_ in sent]
    # of 30 occurrences: distinct first words a part, pairs, and runs of three or of what is left
    assert sum(len(importance._unpack(x[4], importance.np.uint32)) for x in sent) == 8 and sum(importance._unpack(x[4], importance.np.uint32).sum() for x in sent) == 30
    assert sum(len(importance._unpack(x[3], importance.np.uint32)) for x in sent) == 6 and all(t.endswith(b"\n") for t in texts)


def test_importance_sends_and_hashes_words_once(monkeypatch):
    """However many runs hold a word: one string a chunk and part, two hashes a part; the CRCs of runs are those of their bytes."""
    r = random.Random(4)
    words = [bytes(r.choices(b"az09\xc3\xa9", k=k)) for k in [*range(1, 40), 255, 256, 70_000]]
    texts = [r.choices(words[:30], k=120) for _ in range(9)] + [words, words[:1], []]
    rows = defaultdict(list)
    for chunk in range(2):
        held = importance._Chunk()
        for doc, found in enumerate(texts):
            held.add(doc, found, len(found))
        for sent in held.sent(3):
            rows[sent[0]].append({"chunk": chunk, "target": chunk == 1} | dict(zip([c.split()[0] for c in importance.SENT.split(", ")][2:], sent, strict=True)))
    strings = [importance.pa.decompress(x["words"][8:], int.from_bytes(x["words"][:8], "little"), codec="zstd", asbytes=True).split(b"\n")[:-1] for p in rows for x in rows[p]]
    assert all(len(x) == len(set(x)) for x in strings)

    hashed = []
    monkeypatch.setattr(importance, "crc32", lambda *x: hashed.append(x) or zlib.crc32(*x))
    parts = [importance._Part(x) for x in rows.values()]
    assert len(hashed) == sum(map(len, strings))  # both chunks send the same words, and each is hashed with a space before it and without
    features = lambda w: [zlib.crc32(b" ".join(w[i : i + n])) % importance.BUCKETS for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    want = Counter(f for w in texts for f in features(w))
    assert [Counter({b: n for b, n in enumerate(side.tolist()) if n}) for side in sum(x.sums() for x in parts)] == [want, want]
    gains = importance.np.arange(importance.BUCKETS) % 977 - 400
    weights = sum(importance.np.pad(w, (0, len(texts) - len(w))) for x in parts for _, w in x.weights(gains))
    assert weights.tolist() == [sum(int(gains[f]) for f in features(w)) for w in texts]


def test_importance_packs_all_values():
    for x in ([], [0, 0], [1, 255, 256], [2**32 - 1]):
        assert importance._unpack(importance._pack(importance.np.array(x, "u4")), "u4").tolist() == x
    for x in ([], [-1, 0, 2**62], [-(2**63), 5]):
        assert importance._unpack(importance._pack(importance.np.array(x, "i8")), "i8").tolist() == x
