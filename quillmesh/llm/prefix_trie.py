"""Trie of conversation prefixes, with members, children, leaves and the tokens that sharing saves at each node.

Conversations become rows of turn digests; equal ones are counted once.  They are hash-partitioned by
the digest of their first turn, and each task builds the tries of its partition out of dictionaries
that point from node to node, sums them up in an iterative postorder, and returns a row a node.  A
first turn under which more than ``most`` turns hang (and more than ``FEW`` different conversations, so
that a few long ones stay together) is not built: its conversations are dealt again by their next turn,
its own row is summed up from those of its children, and so on, turn by turn.  The root is
the first such node.  A round is one job, so there are as many as the turns that over-full
groups share.

The digests of a conversation's turns are one row, as the text of a document is; nothing else is held
whole.  The digest of the ids that end at a node is fed from sorted blocks of ids, one after the other.

Turns are in the order of ``turn`` (null first), those of one number by their digest; a null role or text
is empty; repeated rows are turns of their own.  Rows without conv_id belong to no conversation.
Other columns are not read.  No conversations give no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_counted, lean, stage, words_of

#: Turns below one node that a task builds at most, and conversations that it takes however long.
MOST, FEW = 100_000, 16
#: Ids in a block of ids that are hashed together.
BLOCK = 4096
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): digest and number of words of each turn, in order."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"), digest.alias("digest"), F.size(words_of(text)).cast("long").alias("words")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def splice(turns: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns): the first h turns of the family's first conversation, then the own ones after the first h; h = crc32(conv_id) % most."""
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    heads = turns.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("_leader"), F.slice("turns", F.lit(1), F.lit(most - 1)).alias("_head"))
    rows = turns.withColumn("_of", F.col("conv_id") - F.col("conv_id") % family).join(heads, F.col("_of") == F.col("_leader"), "left")
    none = F.array().cast("array<struct<digest:string,words:bigint>>")
    lead = F.slice(F.coalesce("_head", none), F.lit(1), h)
    return rows.select("conv_id", F.concat(lead, F.slice("turns", h + 1, F.greatest(F.lit(0), F.size("turns") - h))).alias("turns"))


def _ends(rows: DataFrame) -> DataFrame:
    """(seq, conv_id) -> seq, n, conv_id (the smallest) and ends, the digest of all ids, ascending, with commas between."""
    block = F.floor(F.col("conv_id") / BLOCK)
    ids = F.array_sort(F.collect_list("conv_id"))
    blocks = rows.groupBy("seq", block.alias("block")).agg(ids.alias("ids")).select("seq", "block", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first"), F.array_join("ids", ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, first, digest = None, 0, None, None
        for b in batches:
            done = []
            for seq, many, smallest, ids in zip(*(b.column(c).to_pylist() for c in ("seq", "n", "first", "ids")), strict=True):
                if seq == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        done.append((now, n, first, digest.hexdigest()))
                    now, n, first, digest = seq, 0, smallest, hashlib.sha256()
                n += many
                digest.update(ids.encode())
            yield _ended(done)
        if now is not None:
            yield _ended([(now, n, first, digest.hexdigest())])

    return blocks.repartition("seq").sortWithinPartitions("seq", "block").mapInArrow(lean(run), "seq string, n long, conv_id long, ends string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["seq", "n", "conv_id", "ends"])


def distinct_sequences(turns: DataFrame) -> DataFrame:
    """One row a distinct sequence: digests, words, n, conv_id, ends."""
    rows = turns.select(F.md5(F.array_join(F.transform("turns", lambda t: t["digest"]), ",")).alias("seq"), "conv_id", "turns")
    rows = stage(rows, "rebuilt")
    one = rows.groupBy("seq").agg(F.min_by("turns", "conv_id").alias("turns"))
    made = one.join(_ends(rows.select("seq", "conv_id")), "seq")
    return made.select(F.transform("turns", lambda t: t["digest"]).alias("digests"), F.transform("turns", lambda t: t["words"]).alias("words"), "n", "conv_id", "ends")


class _Node:
    __slots__ = ("children", "conv", "depth", "ends", "leaves", "n", "parent", "saved", "words")

    def __init__(self, parent: _Node | None, depth: int, words: int, conv: int):
        self.children: dict[str, _Node] = {}
        self.parent, self.depth, self.words, self.n, self.conv, self.ends = parent, depth, words, 0, conv, NONE


def _built(rows: pd.DataFrame, depth: int) -> list[tuple]:
    """Rows of the nodes of depth ``depth`` and more; the tops have no parent_conv_id, but the prefix of their parent."""
    tops: dict[str, tuple[str, _Node]] = {}
    for prefix, parent, digests, words, n, conv, ends in zip(*(rows[c] for c in ("prefix", "parent", "digests", "words", "n", "conv_id", "ends")), strict=True):
        if prefix not in tops:
            tops[prefix] = parent, _Node(None, depth, words[depth - 1], conv)
        node, at = tops[prefix][1], depth
        while True:
            node.n += n
            node.conv = min(node.conv, conv)
            if at == len(digests):
                break
            if digests[at] not in node.children:
                node.children[digests[at]] = _Node(node, at + 1, words[at], conv)
            node, at = node.children[digests[at]], at + 1
        node.ends = ends
    out = []
    for parent, top in tops.values():
        order, waiting = [], [top]
        while waiting:
            node = waiting.pop()
            order.append(node)
            waiting += node.children.values()
        for node in reversed(order):  # children come before their parents
            own = node.children.values()
            node.leaves = sum(c.leaves for c in own) or 1
            node.saved = (node.n - 1) * node.words + sum(c.saved for c in own)
            out.append((node.conv, node.depth, node.parent.conv if node.parent else None, node.n, len(own), node.leaves, node.saved, node.ends, None if node.parent else parent))
    return out


BUILT = f"{NODE}, parent string"


def _tries(rows: DataFrame, depth: int, most: int) -> DataFrame:
    """Tries of the conversations below each prefix of ``depth`` turns, many prefixes a partition."""
    total = rows.agg(F.sum(F.size("digests") - (depth - 1))).first()[0] or 0
    names = [c.split()[0] for c in BUILT.split(", ")]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        made = pd.DataFrame(_built(part, depth), columns=names)
        made["parent_conv_id"] = made["parent_conv_id"].astype("Int64")
        return made

    return rows.groupBy(F.pmod(F.xxhash64("prefix"), F.lit(1 + total // most)).alias("_part")).applyInPandas(run, BUILT)


def trie(turns: DataFrame, most: int = MOST, few: int = FEW) -> DataFrame:
    """(conv_id, turns) as turns_of gives them -> rows as in NODE.

    Each conv_id must come once; of nodes, conv_id and depth together name one.
    """
    rest = stage(distinct_sequences(turns).withColumn("prefix", F.lit("")), "sequences")
    nodes, level = [], 0
    known = rest.select("prefix", F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("words")).limit(1)
    uppers: list[tuple[DataFrame, DataFrame]] = []  # nodes that are summed up, and the conversations that end there
    while True:
        uppers.append((known, rest.where(F.size("digests") == level)))
        deeper = rest.where(F.size("digests") > level).withColumn("parent", F.col("prefix"))
        deeper = deeper.withColumn("prefix", F.md5(F.concat("parent", F.get("digests", F.lit(level)))))
        sizes = deeper.groupBy("prefix").agg(F.sum(F.size("digests") - level).alias("below"), F.count(F.lit(1)).alias("many"), F.min("parent").alias("parent"), F.min(F.get("words", F.lit(level))).alias("words"))
        big = stage(sizes.where((F.col("below") > most) & (F.col("many") > few)).select("prefix", "parent", "words"), "prefixes")
        split = not big.isEmpty()
        if split:
            deeper = stage(deeper.join(big.select("prefix", F.lit(True).alias("again")), "prefix", "left"), "sequences")
        small = deeper.where("again IS NULL").drop("again") if split else deeper
        level += 1
        nodes.append(stage(_tries(small, level, most), "nodes"))
        if not split:
            break
        rest, known = deeper.where("again").drop("again", "parent"), big
    above = None
    for depth in reversed(range(len(uppers))):
        known, ended = uppers[depth]
        tops = nodes[depth].where("parent IS NOT NULL").select(F.col("parent").alias("prefix"), "conv_id", "n_convs", F.lit(1).alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends"))
        ended = ended.select("prefix", "conv_id", F.col("n").alias("n_convs"), F.lit(0).alias("child"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends")
        parts = tops.unionByName(ended)
        if above is not None:
            parts = parts.unionByName(above.select(F.col("parent").alias("prefix"), "conv_id", "n_convs", F.lit(1).alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends")))
        sums = parts.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").cast("long").alias("n_children"), F.greatest(F.lit(1), F.sum("n_leaves")).alias("n_leaves"), F.sum("saved_tokens").alias("below"), F.max("ends").alias("ends"))
        made = sums.join(known, "prefix").select("prefix", "parent", "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", "n_children", "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), F.coalesce("ends", F.lit(NONE)).alias("ends_sha256"))
        above = stage(made, "uppers")
        uppers[depth] = above, ended
    every = above
    for made, _ in uppers[1:]:
        every = every.unionByName(made)
    told = every.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    tops = every.where("parent IS NOT NULL").drop("prefix")
    for made in nodes:
        tops = tops.unionByName(made.where("parent IS NOT NULL").drop("parent_conv_id"))
    total = sum(r[0] or 0 for r in [every.agg(F.sum("n_children")).first()])
    columns = [c.split()[0] for c in NODE.split(", ")]
    out = join_counted(tops, told, "parent", total).select(columns)
    out = out.unionByName(every.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    for made in nodes:
        out = out.unionByName(made.where("parent IS NULL").select(columns))
    return out
