import base64
import gzip
import hashlib
import math
import random
import sys
import time
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import bpe, chat, fingerprints, mixing, quality_rules, queries, sharding, toxicity, warc
from quillmesh.llm.chunks import Chunks
from quillmesh.llm.jaccard_join import Product, first_of_groups, jaccard_components, search
from quillmesh.llm.ranges import Ranges, key_of, place_among
from quillmesh.llm.shared import scratch
from quillmesh.llm.substring_dedup import remove_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, _extra int"


def documents(spark, rows):
    """With extra columns whose names clash with what operators make; rows are (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", None if k % 5 == 0 else f"s{k % 3}", len(t or ""), 0.5, "x", 1) for k, (i, t) in enumerate(rows)], DOCS)


def corpus(seed=3):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = [r.choice(words) for _ in range(60)]
    rows = [(None, "lone text of a null id"), (0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "one two"), (4, "one two"), (5, "Long " * 3000)]
    for i in range(10, 70):
        body = [r.choice(words) for _ in range(r.randint(1, 120))]
        if i % 3 == 0:
            at = r.randint(0, len(body))
            body[at:at] = passage[r.randint(0, 5) : r.randint(40, 60)]
        rows.append((i, " ".join(body)))
        if i % 7 == 0:
            body[r.randrange(len(body))] = "Edited"
            rows.append((i + 1000, " \n".join(body).upper() if i % 2 else " ".join(body)))
        if i % 10 == 0:
            rows += [(i + 2000 + k, " ".join(body)) for k in range(3)]
    return rows


def test_bpe_matches_library(spark):
    from tokenizers import Tokenizer

    own, lib = bpe.load(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    r = random.Random(5)
    alphabet = [chr(c) for c in [*range(0x250), *range(0x300, 0x3FF), 0x1680, 0x2003, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x130, 0x4E2D, 0xAC00, 0x1F600, 0x200D]]
    texts = ["", "ab" * 4000, "it's WE'LL ΑΣ Σ 12³", "a<|endoftext|>b<|startoftext|>"] + ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(800)]
    for text, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = own.encode(text)
        assert array("I", ids).tolist() == e.ids
        assert own.decode(ids) == lib.decode(e.ids, skip_special_tokens=False)
    out = bpe.decode(bpe.encode(documents(spark, [(1, "Some text"), (2, None)]))).collect()
    assert [o["decoded"] for o in out] == ["some</w> text</w>", ""] and out[1]["ids"] == b""


@pytest.mark.parametrize("bounds", [[], [4], [-3, 0, 4, 9, 10, 50], list(range(0, 600, 3))])
def test_place_among(spark, bounds):
    values = [None, *range(-10, 620)]
    out = spark.createDataFrame([(v,) for v in values], "v long").select("v", place_among(F.col("v"), F.array(*map(F.lit, bounds)), len(bounds)).alias("at")).collect()
    assert {r["v"]: r["at"] for r in out} == {v: 0 if v is None else sum(b <= v for b in bounds) for v in values}


@pytest.mark.parametrize("least", [None, 2000])
def test_substring_dedup(spark, least):
    rows = corpus()
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(documents(spark, rows), 20, ["source", "_extra"], least).collect())
    seen, want = set(), Counter()
    for i, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5((x[1] or "").encode()).digest())):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            if key in seen:
                gone[a : a + 20] = [True] * 20
            seen.add(key)
        want[i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()] += 1
    assert got == want
    assert remove_repeats(documents(spark, []), 20).count() == 0


def brute_groups(rows, n, percent):
    """For each row its set's size, its number of links, and the row that stands for its component; by all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[a : a + n]) for a in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    group, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                group[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    return [(len(sets[k]), links[k], find(k)) for k in range(len(rows))]


def brute_components(rows, n, percent):
    found, least = brute_groups(rows, n, percent), defaultdict(list)
    for (i, _), (_, _, g) in zip(rows, found, strict=True):
        least[g].append(i)
    return Counter((i, size, min((x for x in least[g] if x is not None), default=None), links) for (i, _), (size, links, g) in zip(rows, found, strict=True))


def tangle():
    """Null and repeated ids of near copies, ids at both ends of 64 bits, a chain through a null id, and a long text."""
    r = random.Random(12)
    body = [f"t{r.randrange(500)}" for _ in range(200)]
    step = lambda k: " ".join(w if j % 40 >= k else f"c{j}" for j, w in enumerate(body))
    rows = [(-(2**63), step(0)), (None, step(1)), (2**63 - 1, step(2)), (None, step(2)), (None, step(2)), (7, step(1)), (7, "quite another text it is"), (8, "quite another text it is"), (7, None), (None, "")]
    return rows + [(9, " ".join(f"u{k % 7919}" for k in range(400_000))), (10, " ".join(f"u{k % 7919}" for k in range(390_000)))] + [(None, f"null {k} " * 3) for k in range(60)] + [(11, f"eleven {k} " * 9) for k in range(60)]


@pytest.mark.parametrize("kw", [{}, {"least": 2000, "tile": 300}])
@pytest.mark.parametrize("make", [corpus, tangle])
def test_jaccard_components(spark, make, kw):
    rows = make()
    got = Counter(tuple(r) for r in jaccard_components(documents(spark, rows), 4, 85, **kw).collect())
    assert got == brute_components(rows, 4, 85)


def test_jaccard_large_class(spark):
    """A class of many tiles, all of one size, and one of many sizes: each link is counted once."""
    r = random.Random(13)
    body = [f"b{k}" for k in range(60)]
    rows = [(k, " ".join(f"x{k}" if j == k % 60 else w for j, w in enumerate(body))) for k in range(150)]
    rows += [(1000 + k, " ".join(body[: r.randint(35, 60)]) + " tail") for k in range(100)] + [(2000 + k, rows[0][1]) for k in range(30)]
    got = Counter(tuple(x) for x in jaccard_components(documents(spark, rows), 4, 70, least=3000, tile=400).collect())
    assert got == brute_components(rows, 4, 70) and max(x[3] for x in got) > 100


def test_first_of_groups(spark):
    for rows, kw in ((corpus(), {"least": 2000, "tile": 300}), (tangle(), {})):
        got, found = first_of_groups(documents(spark, rows), 4, 85, **kw), brute_groups(rows, 4, 85)
        assert got.columns == documents(spark, []).columns
        groups, want = defaultdict(list), Counter()
        for (i, t), (size, _, g) in zip(rows, found, strict=True):
            if size:
                groups[g].append((i is None, i or 0, hashlib.md5(t.encode()).hexdigest(), t))
            else:
                want[i, t] += 1
        want += Counter((None if none else i, t) for none, i, _, t in map(min, groups.values()))
        assert Counter((x["doc_id"], x["text"]) for x in got.collect()) == want


def test_jaccard_empty(spark):
    assert jaccard_components(documents(spark, []), 4, 85).count() == 0 == first_of_groups(documents(spark, [])).count()


def test_product_finds_all_links():
    r = np.random.default_rng(1)
    base = [np.unique(r.integers(0, 60, 25).astype(np.uint64)) for _ in range(60)]
    base += [np.unique(np.r_[b[1:], r.integers(0, 60, 1).astype(np.uint64)]) for b in base]
    weights, right = np.arange(1, 121), np.arange(120) % 7 < 3
    for sides in (None, right):
        group, many = list(range(len(base))), np.zeros(120, np.int64)
        for a in range(len(base)):
            for b in range(a):
                o = len(np.intersect1d(base[a], base[b]))
                if 100 * o >= 70 * (len(base[a]) + len(base[b]) - o) and (sides is None or right[a] != right[b]):
                    many[a] += weights[b]
                    many[b] += weights[a]
                    x, y = group[a], group[b]
                    group = [min(x, y) if g in (x, y) else g for g in group]
        links, counts = Product(base, 70, weights, sides).links()
        assert dict(links) == {k: g for k, g in enumerate(group) if k != g} and counts.tolist() == many.tolist() and many.any()
        assert sides is not None or dict(search(base, 70)) == dict(links)


def test_ranges(spark):
    """Ranges rise with doc_id and digest, are even, and cut an id that most rows share."""
    r = random.Random(14)
    ids = [None] * 300 + [5] * 400 + [r.choice([-1, 1]) * r.getrandbits(r.choice([4, 30, 62])) for _ in range(500)] + [-(2**63), 2**63 - 1, 2**62, 2**62 + 1]
    rows = [(i, f"{k} " * r.randint(1, 60)) for k, i in enumerate(ids)]
    docs = documents(spark, rows).repartition(7)
    ranges = Ranges(docs, "text", 4000)
    out = [(x["key"], x["n"], x["text"]) for x in ranges.with_number(docs.select("doc_id", "text", key_of(F.col("doc_id"), F.col("text")).alias("key")), "text", "n").collect()]
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    assert [x[2] for x in sorted(out)] == [t for _, t in order] and [x[1] for x in sorted(out)] == sorted(x[1] for x in out)
    held = Counter()
    for _, n, t in out:
        held[n] += len(t)
    assert ranges.n > 8 and max(held) == ranges.n - 1 and max(held.values()) <= 8000 + 300 and len({n for k, n, _ in out if k.startswith("-")}) > 2
    assert Ranges(docs.limit(0), "text", 10).n == 1


def test_quality_measures_and_bound(spark):
    rows = corpus() + [(90, "a b\na b\n\nc | d #\nx"), (91, "r s t u v " * 4)]
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.measures(documents(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        w, lines = (t or "").encode().split(), [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        runs = [tuple(w[a : a + 5]) for a in range(len(w) - 4)]
        count = Counter(runs)
        covered = {a + k for a, x in enumerate(runs) if count[x] > 1 for k in range(5)}
        want[i, len(w), sum(len(x.decode()) for x in w), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want
    cases = [(k, n) for n in (5, 700, 5000, 120_000) for k in (0, 3, 20, 399, 401, 580) if k <= n]
    tails = spark.createDataFrame(cases, "k long, n long").select("k", "n", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.005).alias("t")).collect()
    import math

    for r in tails:
        exact = sum(math.exp(math.lgamma(r["n"] + 1) - math.lgamma(i + 1) - math.lgamma(r["n"] - i + 1) + i * math.log(0.005) + (r["n"] - i) * math.log(0.995)) for i in range(r["k"] + 1))
        assert r["t"] == (1.0 if r["k"] >= 0.005 * r["n"] else pytest.approx(exact, rel=1e-6))


def test_quality_cutoffs(spark):
    docs = documents(spark, [(i, "fine words are here and many of them are good enough" if i < 3000 else "# # # $ $ % & | < >" + " x#" * 3) for i in range(3300)])
    labels = spark.createDataFrame([(i, 1 if i < 3000 else 0) for i in range(0, 3300)] + [(None, 1), (9, None)], "doc_id long, quality int")
    out = quality_rules.quality(docs, labels)
    assert out.where("rejected").count() == 300 and out.where("rejected AND doc_id < 3000").count() == 0
    assert quality_rules.quality(docs, labels.where("doc_id % 30 = 0")).where("rejected").count() == 0  # too few labels
    assert quality_rules.quality(docs.limit(0), labels).count() == 0 and quality_rules.quality(docs, labels.limit(0)).where("rejected").count() == 0


def test_quality_strata(spark):
    """Large strata have their own path; small ones, the null one among them, take the parent's."""
    r = random.Random(9)
    rows = []
    for i in range(2200):
        lang = "en" if i < 1000 else "de" if i < 2000 else None
        rows.append((i, "word" * r.randint(1, 3 if lang == "en" else 6) + " it is " * r.randint(2, 9) + f" end{i}", lang, "x", 1))
    rows += [(3000 + i, "# $ " * 40, lang, "x", 1) for i, lang in enumerate(["en", "de", None, "other"] * 5)] + [(None, "# " * 30, "en", "x", 1), (1, None, "en", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum string, rejected int")
    labels = spark.createDataFrame([(i, int(i < 3000)) for i in range(3020)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    cuts = {(c["stratum"], c["parent"]): c for c in quality_rules.cutoffs(quality_rules.measures(docs), labels).collect()}
    assert cuts.keys() == {("en", False), ("de", False), (None, True)} and all(c["step"] is not None for c in cuts.values())
    assert cuts["en", False]["cuts"]["long_words"] < cuts["de", False]["cuts"]["long_words"]
    out = quality_rules.quality(docs, labels).collect()
    assert len(out) == len(rows) and {x["doc_id"] for x in out if x["rejected"]} >= {None, *range(3000, 3020)}
    assert sum(x["rejected"] for x in out if x["doc_id"] is not None and x["doc_id"] < 3000) <= 0.02 * 2200


def test_chat():
    r = random.Random(2)
    tokenizer = chat._tokenizer(chat.default_path())
    pieces = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<", "|", "<||", "\\", "\\n", "é", "🙂", "word ", " "]
    for _ in range(300):
        turns = [(r.choice(["user", "assistant", "a\nb\\<|", ""]), "".join(r.choices(pieces, k=r.randint(0, 8)))) for _ in range(r.randint(0, 5))]
        formatted, spans = chat.render(turns)
        assert chat.parse(formatted) == turns
        flags, common = chat.mask(tokenizer.encode(formatted, add_special_tokens=False).offsets, [s for s, t in zip(spans, turns, strict=True) if t[0] == "assistant"])
        assert "".join(chat.unescape(formatted[a:b]) for a, b in common) == "".join(t for role, t in turns if role == "assistant")


def test_chat_rows(spark):
    rows = spark.createDataFrame([(1, 1, "assistant", "b", 0), (1, 0, "user", "a", 0), (2, 0, None, None, 0), (None, None, "assistant", "x", 0), (1, 1, "assistant", "b", 0)], "conv_id long, turn long, role string, text string, formatted int")
    out = {r["conv_id"]: (r["n_turns"], chat.parse(r["formatted"]), len(r["ids"]) == len(r["loss_mask"])) for r in chat.format_conversations(rows).collect()}
    assert out == {1: (3, [("user", "a"), ("assistant", "b"), ("assistant", "b")], True), 2: (1, [("", "")], True), None: (1, [("assistant", "x")], True)}


def test_sharding(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("shard")).unionByName(spark.createDataFrame([(None, "t"), (7, "t")], "doc_id long, shard string"))
    out = sharding.assign_shards(docs, "doc_id", [1.0] * 5).collect()
    for s in range(5):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
        assert 300 < sum(r["shard"] == s for r in out) < 500
    assert {r["grown_shard"] for r in out if r["grown_shard"] != r["shard"]} == {5}
    heavy = Counter(r[0] for r in spark.range(4000).select(sharding.shard_of(F.col("id"), [1.0, 3.0])).collect())
    assert 2.5 < heavy[1] / heavy[0] < 3.5


def test_mixing(spark):
    sizes = spark.createDataFrame([(None, 100), ("a", 1000), ("b", 1000), ("c", 10), ("d", 0)], "source string, source_size long")
    plan = {r["source"]: r["target"] for r in mixing.targets(mixing.cyclic_weights(sizes)).collect()}
    assert plan["c"] == 30 and plan["d"] == 0 and plan[None] == 300 and plan["a"] + plan["b"] == pytest.approx(1780) and plan["b"] == pytest.approx(2 * plan["a"])
    docs = documents(spark, [(i, "w") for i in range(3000)]).withColumn("size", F.lit(10).cast("long"))
    rows = mixing.mix(docs).collect()
    assert rows == mixing.mix(docs).collect() and max(r["copies"] for r in rows) <= 3
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert sum(10 * r["copies"] for r in own) == pytest.approx(own[0]["target"], rel=0.1)
    assert mixing.emit(mixing.mix(docs)).count() == sum(r["copies"] for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixing_chances_are_the_fractions(spark):
    """Sources alike but in name have seeds of their own: what each place in them takes is on average the rate."""
    sizes = (50, 7, 7, 1, 0)
    rows = [(100 * k + j, f"s{k:04}", n) for k in range(1200) for j, n in enumerate(sizes)]
    for own in (rows, [r for r in rows if r[2] == 50]):
        out = mixing.mix(spark.createDataFrame(own, "doc_id long, source string, size long")).collect()
        for weight in (1, 2, 3):
            # of the two alike in size, too, whichever tosses first
            for j in {r[0] % 100 for r in own}:
                taken = [x["copies"] for x in out if x["doc_id"] % 100 == j and int(x["source"][1:]) % 3 + 1 == weight]
                assert len(taken) == 400 and sum(taken) / 400 == pytest.approx(weight / 2, abs=0.1)


def test_mixing_of_many_alike(spark):
    out = mixing.mix(spark.createDataFrame([(i, f"s{i % 3}", 10) for i in range(9000)], "doc_id long, source string, size long")).collect()
    for k, rate in enumerate((0.5, 1.0, 1.5)):
        assert sum(x["copies"] for x in out if x["source"] == f"s{k}") == pytest.approx(3000 * rate, rel=0.05)


def test_mixing_comes_near_the_target(spark):
    """Within four standard deviations of independent coins; no document's copies depend on another."""
    r = random.Random(1)
    rows = [(i, f"s{i % 6}", int(r.paretovariate(1.1) * 20) if i % 6 else r.randint(1, 400)) for i in range(3000)]
    rows += [(None, "s1", 5)] * 3 + [(5000 + i, "s5", 30) for i in range(2000)]
    out = mixing.mix(spark.createDataFrame([(*x, 1.0, 2, 3) for x in rows], "doc_id long, source string, size long, rate double, copy int, _extra int")).collect()
    for s in {x["source"] for x in out}:
        own = [x for x in out if x["source"] == s]
        fraction = own[0]["target"] / own[0]["source_size"] % 1
        spread = sum(x["size"] ** 2 * fraction * (1 - fraction) for x in own) ** 0.5
        assert abs(sum(x["size"] * x["copies"] for x in own) - own[0]["target"]) <= 4 * spread + 1e-6 and own[0]["rate"] == 1.0 and own[0]["copy"] == 2
    assert len({x["copies"] for x in out if x["doc_id"] is None}) == 1
    halves = [(i, "a" if i < 500 else "b", 1 + i % 7) for i in range(1000)]
    whole = {x["doc_id"]: x["copies"] for x in mixing.mix(spark.createDataFrame(halves, "doc_id long, source string, size long")).collect()}
    swapped = [(i, s, 8 - n) for i, s, n in halves]
    rates = {x["source"]: x["target"] / x["source_size"] for x in mixing.mix(spark.createDataFrame(swapped, "doc_id long, source string, size long")).collect()}
    other = {x["doc_id"]: x["copies"] for x in mixing.mix(spark.createDataFrame(swapped, "doc_id long, source string, size long")).collect()}
    assert rates and sum(whole[i] != other[i] for i in whole) <= 60


def test_mixing_is_off_by_half_a_document(spark):
    """Of any source, some long documents in it or not, and of one whose words are mostly one document's."""
    r = random.Random(2)
    rows = [(i, f"s{i % 6}", int(r.paretovariate(1.1) * 20) if i % 6 else r.randint(0, 400)) for i in range(3000)]
    rows += [(4000, "giant", 5000), *((4001 + i, "giant", 2) for i in range(500)), (None, None, 7), (None, None, 7), (9000, None, 3)]
    own = defaultdict(list)
    for x in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect():
        own[x["source"]].append(x)
    for source, docs in own.items():
        off = abs(sum(x["size"] * x["copies"] for x in docs) - docs[0]["target"])
        assert off <= 0.55 * (14 if source is None else max(x["size"] for x in docs)) + 1e-6
        rate = docs[0]["target"] / docs[0]["source_size"]
        assert all(math.floor(rate) <= x["copies"] <= math.ceil(rate) for x in docs)
    even = [(i, f"s{i % 3}", 10 + i % 50) for i in range(3000)]
    own = defaultdict(list)
    for x in mixing.mix(spark.createDataFrame(even, "doc_id long, source string, size long")).collect():
        own[x["source"]].append(x)
    assert all(sum(x["size"] * x["copies"] for x in docs) == pytest.approx(docs[0]["target"], rel=0.002) for docs in own.values())


def test_words_are_the_patterns_and_quick():
    by_pattern = lambda text: toxicity._TOKEN.findall((text or "").lower().replace("_", " "))
    r = random.Random(8)
    every = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = [None, "", " ".join(every), "x".join(every), "".join(map(chr, range(128)))]
    texts += ["".join(r.choices("aZ9_ -.\n\x1c\x85\u0130\u0301\u3000\u00df" + "".join(r.choices(every, k=20)), k=60)) for _ in range(2000)]
    assert all(toxicity.words_in(t) == by_pattern(t) for t in texts)
    for text in ("Some words, of letters only. " * 20_000, "Einige Wörter, mit Umlauten. " * 20_000):

        def seconds(cut):
            start = time.process_time()
            cut(text)
            return time.process_time() - start

        assert min(seconds(toxicity.words_in) for _ in range(3)) < 0.7 * min(seconds(by_pattern) for _ in range(3))


def test_fingerprints(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    docs = documents(spark, rows)
    out = docs.select("text", fingerprints.as_text(fingerprints.sketch(F.col("text"))).alias("f"), fingerprints.likeness(fingerprints.sketch(F.col("text")), fingerprints.sketch(F.lit("zz yy"))).alias("l")).collect()
    assert all((r["f"] == "") == (not (r["text"] or "").split()) and 0 <= r["l"] <= 1 for r in out)
    assert len({r["f"] for r in out if r["text"] == "one two"}) == 1
    whole = fingerprints.sketch(F.lit(" ".join(f"v{i}" for i in range(400))))
    part = fingerprints.sketch(F.lit(" ".join(f"v{i}" for i in range(40))))
    r = spark.range(1).select(fingerprints.containment(part, whole).alias("c"), (fingerprints.merge(part, whole) == whole).alias("m")).first()
    assert r["c"] == 1.0 and r["m"]
    following = {(r["doc_id"], r["text"]): r["next"] for r in fingerprints.with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", 3000).collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0], hashlib.md5(x[1].encode()).hexdigest()), reverse=True)
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        assert following[a] == b[1] or a == b


def test_warc(spark, tmp_path):
    rows = [(1, "http://www.B.com/x?q=1", "same"), (2, "https://a.org", "same"), (3, "http://a.org/z", None), (4, None, "é\r\n\r\nx"), (None, "http://[", ""), (5, "http://c.net", "same"), (5, "http://c.net", "same"), (None, "http://d.net", "x0"), (-(2**63), "http://d.net", "x1"), (2**63 - 1, "http://d.net/\n é%20", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows] + [(100 + i, f"http://h{i % 9}.com/{i}", f"p{i}", "x") for i in range(700)], "page_id long, url string, html string, digest string")
    folder = f"{scratch(spark)}/warc-test-{random.getrandbits(60)}"
    captures, parts = warc.archive(pages, folder)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_back(captures, parts, folder).collect())
    want = Counter({(None, 2, "response", None): 1, (-(2**63), 2, "response", None): 1, (2**63 - 1, 3_000_000, "response", None): 1, (1, 4, "revisit", 5): 1, (2, 4, "revisit", 5): 1, (3, 0, "response", None): 1, (4, 7, "response", None): 1, (None, 0, "revisit", 3): 1, (5, 4, "response", None): 1, (5, 4, "revisit", 5): 1})
    assert got == want + Counter((100 + i, len(f"p{i}"), "response", None) for i in range(700))
    index = warc.Index(folder, [tuple(r) for r in parts.collect()])
    found = [index.read(c) for c in index.find("com,b)/x?q=1", every=True)]
    assert [(f["page_id"], f["payload_digest"]) for f in found] == [(1, base64.b32encode(hashlib.sha1(b"same").digest()).decode())]
    assert not list(index.find("com,none)/", every=True))
    read = [index.read(c) for r in captures.select("urlkey", "page_id").distinct().collect() for c in index.find(*r)]
    assert Counter((x["page_id"], x["url"]) for x in read) == Counter((r["page_id"], r["url"]) for r in pages.collect())
    responses = {x["record_id"]: x["page_id"] for x in read if x["record_type"] == "response"}
    assert len({x["record_id"] for x in read}) == len(read) and all(responses[x["refers_to_record"]] == x["refers_to"] for x in read if x["record_type"] == "revisit")
    name = captures.first()["file"]
    assert b"WARC-Type: warcinfo" in gzip.open(f"{folder.removeprefix('file://')}/{name}").read(400)


def test_toxicity(spark):
    r = random.Random(4)
    words, bad = ["".join(r.choices("abcdefgh", k=r.randint(2, 6))) for _ in range(200)], ["zyxo", "zyxu", "zyxan"]
    texts = []
    for i in range(800):
        body = [r.choice(words) for _ in range(r.randint(20, 80))]
        if i % 4 == 0:
            for _ in range(3):
                body[r.randrange(len(body))] = r.choice(bad) + r.choice(["", "n", "ra"])
        texts.append((i, " ".join(body)))
    docs = documents(spark, [*texts, (900, None), (901, ""), (902, "zyxq " * 4)])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)] + [(None, 1), (901, None)], "doc_id long, toxic int")
    learnt = labels.where(F.col("doc_id").isNull() | (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, learnt)).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[900] == got[901] < 0.5 <= got[902]
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels.limit(0))).count() == docs.count()


def gram_counts(words, ends=True):
    """Counts of the sequences of words and, for their ends, of the letters that come before."""
    counts = defaultdict(int)
    for word, n in words.items():
        for g in toxicity.grams_of(word):
            counts[g] += n
    for k in range(toxicity.ORDER, 1, -1) if ends else ():
        for g in [g for g in counts if len(g) == k]:
            counts[g[1:]] += 1
    return counts


def backoff_by_hand(words):
    """Kneser-Ney over a Counter of words, all of it in memory."""
    counts, after = gram_counts(words), defaultdict(list)
    for g, n in counts.items():
        after[g[:-1]].append(n)
    p = {"": 1 / (1 + len(after[""]))}
    for g in sorted(counts, key=len):
        n, own = counts[g], after[g[:-1]]
        p[g] = (max(n - toxicity.DISCOUNT, 0) + toxicity.DISCOUNT * len(own) * p[g[1:]]) / sum(own)
    return p


def test_toxicity_backoff_counts_all_documents(spark):
    r = random.Random(6)
    texts = [(i, " ".join("".join(r.choices("abcé", k=r.randint(1, 8))) for _ in range(r.randint(0, 30)))) for i in range(300)] + [(None, "abc dcb"), (7, None)]
    docs, labels = documents(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    every = Counter(w for _, t in texts for w in set((t or "").split()))
    seen = [Counter(w for i, t in texts if i is not None and i < 40 and i % 2 == y for w in set((t or "").split())) for y in (1, 0)]
    counts = [Counter(), Counter()]
    for own, k in zip(counts, seen, strict=True):
        for word, n in k.items():
            for g in toxicity.grams_of(word):
                own[g] += n
    want = toxicity.spelling_model([(g, counts[0][g], counts[1][g]) for g in counts[0].keys() | counts[1].keys()], backoff_by_hand(every))
    got = toxicity.fit(docs, labels)
    assert got.ratio == pytest.approx(want.ratio) and got.weight == pytest.approx(want.weight)


def test_toxicity_probabilities_sum_to_one():
    """After each context, over all letters and one that no word has: of the shared backoff, and of a class over it."""
    r = random.Random(8)
    words = Counter("".join(r.choices("abc", k=r.randint(1, 7))) for _ in range(400))
    p, after = backoff_by_hand(words), defaultdict(list)
    counts = gram_counts(words)
    for g, n in counts.items():
        after[g[:-1]].append(n)
    letters = [*(g for g in p if len(g) == 1), "?"]
    own = gram_counts(dict(list(words.items())[::3]), ends=False)

    def chance(h, x):
        if h + x in p:
            return p[h + x]
        lower = chance(h[1:], x) if h else p[""]
        return toxicity.DISCOUNT * len(after[h]) * lower / sum(after[h]) if h in after else lower

    def of_class(h, x):
        seen = [own[h + y] for y in letters if own.get(h + y)]
        share = (toxicity.DISCOUNT * len(seen) + toxicity.BELIEF) / (sum(seen) + toxicity.BELIEF)
        return max(own.get(h + x, 0) - toxicity.DISCOUNT, 0) / (sum(seen) + toxicity.BELIEF) + share * chance(h, x)

    for h in list(after):
        if len(h) < toxicity.ORDER:
            assert sum(chance(h, x) for x in letters) == pytest.approx(1) == sum(of_class(h, x) for x in letters)


def test_toxicity_learns_one_text_of_a_repeated_id(spark):
    texts = [(1, "bad zyxo"), (2, "fine text")] + [(1, f"copy {k} zz") for k in range(50)]
    known = toxicity.gather(documents(spark, texts), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int"))
    assert known.chosen.count() == 2
    assert toxicity.words_in("_A_b हिन्दी cafe\u0301 x\u200by") == ["a", "b", "हिन्दी", "cafe\u0301", "x", "y"]


def test_toxicity_keeps_all_sequences(spark):
    r = random.Random(7)
    texts = [(i, " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=20)) for _ in range(80))) for i in range(200)]
    model = toxicity.fit(documents(spark, texts), spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"))
    grams = {g for _, t in texts for w in t.split() for g in toxicity.grams_of(w)}
    assert len(grams) > 250_000 and model.ratio.keys() == grams


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14))


def test_no_text_is_long_enough(spark):
    rows = [(i, f"t{i}" if i % 2 else None) for i in range(20)]
    assert {(r["doc_id"], r["n_removed"], r["kept_text"]) for r in remove_repeats(documents(spark, rows), 20, least=10).collect()} == {(i, 0, t or "") for i, t in rows}


def test_chunks_are_cut_by_bytes(spark):
    """Long texts that stand together are spread over chunks; a chunk is about twice its size at most."""
    docs = documents(spark, [(i, "w " * (20_000 if 100 <= i < 120 else 50)) for i in range(1000)])
    chunks = Chunks(docs, least=60_000)
    held = chunks.docs.groupBy("_qm_chunk").agg(F.sum(F.length("text")).alias("n")).collect()
    assert len(held) > 8 and max(r["n"] for r in held) <= 2 * 60_000 + 40_000
