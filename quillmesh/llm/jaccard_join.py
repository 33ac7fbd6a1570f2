"""Self-join of documents by the Jaccard similarity of their word n-grams, as a blocked sparse product.

1. Documents with equal sets become one, which stands for as many as there are.
2. How many sets hold each n-gram is counted over all of them.  A set whose n-grams that no other
   holds are more than its size allows can have no partner, and goes: overlap cannot exceed the
   rest, which is under the least overlap that the similarity asks for.
3. Of those left, the n-grams in the order of rising frequency are cut to the prefix that two
   linked sets must share, again a bound from the size.  Sets that share one, directly or through
   others, form a candidate class; different classes are different diagonal blocks of the
   document by n-gram matrix, and no pair of documents between two of them can link.
4. Blocks are multiplied: overlaps accumulate over the posting lists of a set's n-grams, for each
   pair once, and pairs that their sizes or overlaps rule out are discarded.  What is left are all
   links between different sets; each set counts its own, and sends on one link that ties it to its
   component.  Classes too large for one task are cut by size into tiles, tile pairs whose sizes
   rule out a link fall away, and the others are blocks of their own.

Lower-casing is A to Z only.  Documents with fewer words than n have the whole sequence as their
one n-gram; null and blank texts have none and link with nothing, however often they occur.  Each
row is a document: rows that repeat a doc_id link by their texts alone, like any two, and a null
doc_id links like any other, but is not the smallest of its component while there is another.
Texts of any length are read whole.  Only doc_id and text are read, so other columns cannot clash;
no rows give no rows.  N-grams are told apart by 64-bit hashes, sets by 128 bits of a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chunks import BUCKET, CHUNK, Chunks, code_of, slices
from .components import connected_components
from .ranges import digest, place_among
from .shared import batches_of, hash_words, join_counted, lean, lean_group, lean_pair, rolling, stage

#: N-grams of a block that one task multiplies.
TILE = 3_000_000


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    words = hash_words((text or "").encode().lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    return np.unique(rolling(words, min(n, len(words))))


def mark_of(grams: np.ndarray) -> bytes | None:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """A row a document: its text's digest, the size of its set, the set's mark and, from that, its node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batches_of(batch, 512):
                sets = [shingles(t, n) for t in rows.column("text").to_pylist()]
                marks = [mark_of(s) for s in sets]
                nodes = [int.from_bytes(m[:8], "little", signed=True) if m else None for m in marks]
                made = [pa.array(map(len, sets), pa.int64()), pa.array(marks, pa.binary()), pa.array(nodes, pa.int64())]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "digest", CHUNK)), *made], names=["doc_id", "digest", CHUNK, "n_shingles", "mark", "node"])

    return docs.withColumn("digest", digest(F.col("text"))).mapInArrow(lean(run), f"doc_id long, digest string, {CHUNK} int, n_shingles long, mark binary, node long")


def _own(rows: pa.Table, keep: pa.Table, n: int) -> tuple[list[int], list[np.ndarray]]:
    """The node of each mark that is to be kept, and its set, from the first row that has it."""
    left = dict(zip(zip(keep["doc_id"].to_pylist(), keep["mark"].to_pylist(), strict=True), keep["node"].to_pylist(), strict=True))
    wanted = {i for i, _ in left}
    nodes, sets = [], []
    for i, t in zip(rows["doc_id"].to_pylist(), rows["text"].to_pylist(), strict=True):
        if i in wanted:
            s = shingles(t, n)
            if (node := left.pop((i, mark_of(s)), None)) is not None:
                nodes.append(node)
                sets.append(s)
    return nodes, sets


class Product:
    """All links among sets that are loaded together, or of those on the left with those on the right."""

    def __init__(self, sets: list[np.ndarray], percent: int, weights: np.ndarray | None = None, right: np.ndarray | None = None):
        """``right`` says which sets are on the right; without it, all meet all."""
        k = self.k = len(sets)
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.percent = percent
        self.weights = np.ones(k, np.int64) if weights is None else weights
        self.right = right
        docs = np.repeat(np.arange(k), self.sizes)
        _, self.grams, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        self.ends = np.cumsum(self.sizes)
        # posting lists, each in the order of the sets; without sides a set meets those after it only
        held = np.arange(len(docs)) if right is None else np.flatnonzero(right[docs])
        order = held[np.argsort(self.grams[held], kind="stable")]
        self.posting = docs[order]
        self.stops = np.cumsum(np.bincount(self.grams[held], minlength=len(counts)))
        if right is None:
            self.at = np.empty(len(docs), np.int64)
            self.at[order] = np.arange(1, len(docs) + 1)
        else:
            self.at = np.r_[0, self.stops[:-1]][self.grams]

    def _near(self, a: int) -> np.ndarray:
        own = slice(self.ends[a] - self.sizes[a], self.ends[a])
        first, many = self.at[own], self.stops[self.grams[own]] - self.at[own]
        total = int(many.sum())
        if not total:
            return np.empty(0, np.int64)
        met = self.posting[np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(total)]
        if 4 * total < self.k:
            others, overlap = np.unique(met, return_counts=True)
        else:
            overlap = np.bincount(met, minlength=self.k)
            others = np.flatnonzero(overlap)
            overlap = overlap[others]
        return others[100 * overlap >= self.percent * (self.sizes[a] + self.sizes[others] - overlap)]

    def links(self) -> tuple[list[tuple[int, int]], np.ndarray]:
        """(set, first set of its component) of each that has a partner, and how many documents of other sets each links with."""
        parent, many = np.arange(self.k), np.zeros(self.k, np.int64)

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return int(x)

        for a in range(self.k) if self.right is None else np.flatnonzero(~self.right):
            near = self._near(a)
            if len(near):
                many[a] += self.weights[near].sum()
                many[near] += self.weights[a]
                tops = {root(x) for x in np.unique(parent[near]).tolist()} | {root(a)}
                parent[list(tops)] = parent[near] = parent[a] = min(tops)
        return [(x, top) for x in range(self.k) if (top := root(x)) != x], many


def search(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(set, first set of its component) of each that has a partner, without all links: a set found once is met no more."""
    k = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    docs, ends = np.repeat(np.arange(k), sizes), np.cumsum(sizes)
    _, grams, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    own = [grams[end - size : end] for size, end in zip(sizes, ends, strict=True)]
    waiting = np.ones(k, bool)

    def postings() -> tuple[np.ndarray, np.ndarray]:
        held = np.flatnonzero(waiting[docs])
        order = held[np.argsort(grams[held], kind="stable")]
        return np.r_[0, np.cumsum(np.bincount(grams[held], minlength=len(counts)))], docs[order]

    starts, posting = postings()
    left = listed = k
    found = []
    for root in range(k):
        if not waiting[root]:
            continue
        waiting[root] = False
        left -= 1
        queue = [root]
        while queue and left:
            if 2 * left < listed:
                (starts, posting), listed = postings(), left
            a = queue.pop()
            first, many = starts[own[a]], starts[own[a] + 1] - starts[own[a]]
            total = int(many.sum())
            if not total:
                continue
            others, overlap = np.unique(posting[np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(total)], return_counts=True)
            near = others[waiting[others] & (100 * overlap >= percent * (sizes[a] + sizes[others] - overlap))]
            waiting[near] = False
            left -= len(near)
            found += [(int(b), root) for b in near]
            queue += near.tolist()
    return found


def _multiply(percent: int, count: bool):
    def run(rows: pa.Table) -> pa.Table:
        nodes, weights = rows["node"].to_numpy(), rows["many"].to_numpy()
        classes, right = rows["class"].to_numpy(), rows["right_side"].to_numpy(zero_copy_only=False)
        sets = rows["grams"].to_pylist()
        cross = bool(rows["cross"][0].as_py())
        order = np.lexsort((nodes, classes))
        cuts = np.flatnonzero(np.r_[True, classes[order][1:] != classes[order][:-1]])
        out = []
        for own in np.split(order, cuts[1:]):
            if len(own) > 1 and not count:
                out += [(int(nodes[own[x]]), int(nodes[own[y]]), 0) for x, y in search([np.frombuffer(sets[i], np.uint64) for i in own], percent)]
            elif len(own) > 1:
                links, many = Product([np.frombuffer(sets[i], np.uint64) for i in own], percent, weights[own], right[own] if cross else None).links()
                tied = dict(links)
                out += [(int(nodes[own[x]]), int(nodes[own[tied.get(x, x)]]), int(many[x])) for x in np.flatnonzero(many)]
        columns = list(zip(*out, strict=True)) or [()] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "links"])

    return run


def jaccard_groups(docs: DataFrame, n: int = 5, percent: int = 80, tile: int = TILE, least: int | None = None, count: bool = True) -> DataFrame:
    """doc_id, digest (of the text), n_shingles, n_links (other documents that it links with), component (a number, null without words).

    Two documents link when 100 * overlap >= percent * union.  Without ``count`` n_links is null, and sets known to
    belong together are not compared any more, so that a class of near copies costs in proportion to its size.
    """
    chunks = Chunks(docs, **({"least": least} if least else {}))
    buckets = chunks.n
    signed = stage(_signatures(chunks.docs, n), "signatures")
    held = signed.where("mark IS NOT NULL")
    # of each mark a row in which it can be found, and how many have it
    firsts = stage(held.groupBy("mark").agg(F.min(F.struct("doc_id", CHUNK)).alias("at"), F.min("node").alias("node"), F.count(F.lit(1)).alias("many")).select("at.*", "mark", "node", "many"), "firsts")

    def send(rows: pa.Table, keep: pa.Table) -> pa.Table:
        _, sets = _own(rows, keep, n) if rows.num_rows and keep.num_rows else ([], [])
        names, kinds = [BUCKET, CHUNK, "keys", "many"], [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        out = []
        if sets:
            codes, counts = np.unique(code_of(np.concatenate(sets), buckets), return_counts=True)
            low, many, number = codes.astype(np.uint32), np.minimum(counts, 255).astype(np.uint8), rows[CHUNK][0].as_py()
            for k, a, b in slices(codes):
                own = many[a:b]
                out.append((k, number, low[a:b].tobytes(), b"" if own.max() == 1 else own.tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    def count(rows: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, np.uint32) for k in rows["keys"].to_pylist()]
        many = [np.frombuffer(m, np.uint8) if m else np.ones(len(k), np.uint8) for k, m in zip(keys, rows["many"].to_pylist(), strict=True)]
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, np.concatenate(many))
        #: 0 for one document, then eighths of powers of two
        level = np.minimum(255, np.ceil(8 * np.log2(totals))).astype(np.uint8)[inverse]
        back = np.split(level, np.cumsum([len(k) for k in keys])[:-1])
        return pa.table([rows[CHUNK], rows[BUCKET], pa.array([x.tobytes() for x in back], pa.binary())], names=[CHUNK, BUCKET, "levels"])

    def prune(rows: pa.Table, told: pa.Table) -> pa.Table:
        keep = told.filter(pa.compute.is_valid(told["mark"]))
        nodes, sets = _own(rows, keep, n) if rows.num_rows and keep.num_rows else ([], [])
        out = []
        if sets:
            every = np.concatenate(sets)
            codes, inverse = np.unique(code_of(every, buckets), return_inverse=True)
            levels = np.zeros(len(codes), np.uint8)
            to = {k: v for k, v in zip(told[BUCKET].to_pylist(), told["levels"].to_pylist(), strict=True) if k is not None}
            for k, a, b in slices(codes):
                levels[a:b] = np.frombuffer(to[k], np.uint8)
            cuts = np.cumsum([len(s) for s in sets])[:-1]
            for i, s, level in zip(nodes, sets, np.split(levels[inverse], cuts), strict=True):
                size = len(s)
                if 100 * int((level > 0).sum()) >= percent * size:
                    prefix = size - -(-percent * size // 100) + 1
                    chosen = np.lexsort((s, level))[:prefix]
                    chosen = chosen[level[chosen] > 0]
                    out.append((i, size, s[chosen].astype(np.int64), s.tobytes()))
        columns = list(zip(*out, strict=True)) or [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["node", "size", "prefix", "grams"])

    sent = chunks.grouped().cogroup(firsts.select(CHUNK, "doc_id", "mark", "node").groupBy(CHUNK)).applyInArrow(lean_pair(send), f"{BUCKET} int, {CHUNK} int, keys binary, many binary")
    counted = sent.groupBy(BUCKET).applyInArrow(lean_group(count), f"{CHUNK} int, {BUCKET} int, levels binary")
    told = counted.unionByName(firsts.select(CHUNK, "doc_id", "mark", "node"), allowMissingColumns=True)
    alive = stage(chunks.grouped().cogroup(told.groupBy(CHUNK)).applyInArrow(lean_pair(prune), "node long, size long, prefix array<long>, grams binary"), "alive")

    entries = alive.select("node", F.explode("prefix").alias("gram"))
    leads = stage(entries.groupBy("gram").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1"), "leads")
    ties = join_counted(entries, leads, "gram", leads.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    classes = connected_components(ties.select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct())
    sized = alive.select("node", "size").join(classes.withColumnsRenamed({"node": "_qm_node", "component": "class"}), F.col("node") == F.col("_qm_node")).drop("_qm_node")
    sized = stage(sized.join(firsts.select(F.col("node").alias("_qm_node"), "many"), F.col("node") == F.col("_qm_node")).drop("_qm_node"), "sized")
    blocks = _blocks(sized, percent, tile).join(alive.select(F.col("node").alias("_qm_node"), "grams"), F.col("node") == F.col("_qm_node")).drop("_qm_node")
    links = stage(blocks.groupBy("_qm_bin").applyInArrow(lean_group(_multiply(percent, count)), "a long, b long, links long"), "links")
    linked = connected_components(links.select("a", "b")).withColumnRenamed("node", "_qm_node")
    counts = links.groupBy(F.col("a").alias("_qm_a")).agg(F.sum("links").alias("links"))
    found = firsts.select("mark", "node", F.col("many").alias("n")).join(linked, F.col("node") == F.col("_qm_node"), "left").join(counts, F.col("node") == F.col("_qm_a"), "left")
    found = stage(found.select("mark", "n", F.coalesce("component", "node").alias("component"), ((F.coalesce("links", F.lit(0)) + F.col("n") - 1) if count else F.lit(None).cast("long")).alias("n_links")), "found")
    out = join_counted(held.select("doc_id", "digest", "n_shingles", "mark"), found, "mark", found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    none = signed.where("mark IS NULL").select("doc_id", "digest", "n_shingles", F.lit(None).cast("long").alias("component"), F.lit(0 if count else None).cast("long").alias("n_links"))
    return out.drop("mark").unionByName(none).select("doc_id", "digest", "n_shingles", "n_links", "component")


def _blocks(sized: DataFrame, percent: int, tile: int) -> DataFrame:
    """(node, size, class, many) -> node, class, many, cross, right_side, _qm_bin: which sets a task multiplies together.

    A class of over ``tile`` n-grams is cut into tiles of half as many, by size and, within a size,
    by the node, which is a hash.  Where tiles begin is told from counts a class and size.  There
    are at most as many tiles as n-grams divided by half a tile, and they go to all executors.
    """
    counts = sized.groupBy("class", "size").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("class").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"before": F.coalesce(F.sum(F.col("n") * F.col("size")).over(upto), F.lit(0)), "whole": F.sum(F.col("n") * F.col("size")).over(Window.partitionBy("class"))}).where(F.col("whole") > tile)
    half, own = tile / 2, F.col("n") * F.col("size")
    begin, end = F.ceil(F.col("before") / half), F.ceil((F.col("before") + own) / half) - 1
    begins = counts.where(end >= begin).select("class", "size", "before", "n", F.explode(F.sequence(begin, end)).alias("t"))
    cuts = begins.groupBy("class").agg(F.sort_array(F.collect_list(F.col("size") + (F.col("t") * half - F.col("before")) / own)).alias("cuts"))
    tiles = stage(cuts.withColumnRenamed("class", "_qm_class"), "tiles")
    longest = tiles.agg(F.coalesce(F.max(F.size("cuts")), F.lit(0))).first()[0]
    place = F.col("size") + (F.col("node").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40))
    placed = sized.join(F.broadcast(tiles), F.col("class") == F.col("_qm_class"), "left")
    large = placed.where("_qm_class IS NOT NULL").withColumn("at", F.greatest(F.lit(0), place_among(place, F.col("cuts"), longest) - 1)).select("node", "size", "class", "many", "at")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    bins = max(1, -(-4 * total // tile))
    small = placed.where("_qm_class IS NULL").select("node", "class", "many", F.lit(False).alias("cross"), F.lit(False).alias("right_side"), F.pmod(F.xxhash64("class"), F.lit(bins)).alias("_qm_bin"))
    spans = large.groupBy("class", "at").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    pairs = spans.alias("l").join(spans.alias("r"), (F.col("l.class") == F.col("r.class")) & (F.col("l.at") <= F.col("r.at")) & (100 * F.col("l.hi") >= percent * F.col("r.lo")))
    pairs = pairs.select(F.col("l.class").alias("class"), F.col("l.at").alias("left"), F.col("r.at").alias("right"))
    ends = pairs.select("class", F.explode(F.array_distinct(F.array("left", "right"))).alias("at"), "left", "right")
    tiled = large.join(ends, ["class", "at"]).select("node", "class", "many", (F.col("left") < F.col("right")).alias("cross"), ((F.col("left") < F.col("right")) & (F.col("at") == F.col("right"))).alias("right_side"), (-1 - F.abs(F.xxhash64("class", "left", "right") / 2).cast("long")).alias("_qm_bin"))
    return small.unionByName(tiled)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, tile: int = TILE, least: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach; its own without words), n_links."""
    found = stage(jaccard_groups(docs, n, percent, tile, least), "groups")
    many = found.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    named = stage(many, "named")
    out = join_counted(found.where("component IS NOT NULL"), named, "component", named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    lone = found.where("component IS NULL").withColumn("component_id", F.col("doc_id"))
    return out.unionByName(lone).select("doc_id", "n_shingles", "component_id", "n_links")


def first_of_groups(docs: DataFrame, n: int = 5, percent: int = 80, tile: int = TILE, least: int | None = None) -> DataFrame:
    """Rows of docs, of each component one: that of the smallest doc_id, null last, and then digest.

    Rows without words all stay.
    """
    found = stage(jaccard_groups(docs, n, percent, tile, least, count=False), "groups")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("digest")))
    kept = found.where("component IS NOT NULL").groupBy("component").agg(best.alias("b")).select(F.col("b.id").alias("_qm_id"), F.col("b.digest").alias("_qm_digest"))
    blank = ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    same = F.col("doc_id").eqNullSafe(F.col("_qm_id")) & (digest(F.col("text")) == F.col("_qm_digest"))
    rows = docs.where(~blank).join(kept, same).select(*docs.columns, "_qm_digest")
    turn = F.row_number().over(Window.partitionBy("doc_id", "_qm_digest").orderBy(F.lit(1)))
    once = rows.withColumn("_qm_turn", turn).where("_qm_turn = 1").select(*docs.columns)
    return once.unionByName(docs.where(blank).select(*docs.columns))
