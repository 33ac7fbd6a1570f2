"""Importance resampling towards a target corpus, by a dictionary of the distinct features of both.

Features are the runs of 1 to 3 words of a text.  The steps, in one Spark job:

1. Texts are read once, in chunks.  Each sends its distinct runs of three words (fewer at a text's end) to the
   dictionary's parts, dealt by a mix of the hashes of the first two, as a trie: first words, under each
   its second words, under each its third words, and the number of the document of each occurrence.  Each word of a
   trie is sent once as a string, and by its number wherever it stands.
2. A part merges the tries of all chunks.  It holds each distinct run of two or three words of both corpora once,
   hashes it once, and sums the counts of each bucket.  A single word is held by the parts of the pairs that it begins.
   Only words are hashed as strings; the CRC of a longer run follows from those of what begins it and of its last word.
3. The gain of a bucket follows from the sums of all parts, a table of ``BUCKETS`` rows.
4. The parts, from the same exchange, add up the gains of what each document sent them; the sums of all parts are its weight.
5. Documents are ranked by weight plus seeded Gumbel noise, in ranges, without one global sort.

Buckets never go back to the chunks, and nothing is sent for a feature that begins another one.  A run that all
documents hold is one entry a chunk.  Chunks hold ``CHUNK`` words, and more from some 4 GB of text on, with the root of the corpus, so
that what a chunk sends a part keeps a useful size; a task's memory grows with it.  Texts longer than a
chunk are cut into pieces that share two words.

A null text has no words.  Rows are documents of their own, also where they repeat a doc_id; a null
doc_id draws its noise as ``null`` and comes first among ties.  Other columns are not read.  No rows
give no rows; an empty target leaves all gains to the corpus alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches_of, lean, lean_group, lean_pair, stage

BUCKETS = 10_000
CHUNK, PART_ROWS, ROOM = 3 << 19, 1 << 19, 1 << 62
#: What a chunk sends a part; codes are the numbers of first words, each less the one before, of second and of third words.  A row of a part below 0 tells the chunk's documents instead: whether each has an id, the ids, the numbers of words.
SENT = "chunk long, target boolean, part int, words binary, n_seconds binary, n_thirds binary, n binary, docs binary, codes binary"
#: A-Z become small, ASCII letters and digits and all other bytes from 128 on stay, the rest becomes a space.
_CLEAN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _pack(values: np.ndarray) -> bytes:
    """Compressed, all first bytes first; the last ones that all are 0 are left out."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    kept = next((k for k in range(values.itemsize, 0, -1) if planes[k - 1].any()), 0)
    return len(values).to_bytes(8, "little") + bytes([kept]) + pa.compress(planes[:kept].tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, kind) -> np.ndarray:
    many, kept = int.from_bytes(data[:8], "little"), data[8]
    out = np.zeros((many, np.dtype(kind).itemsize), np.uint8)
    out[:, :kept] = np.frombuffer(pa.decompress(data[9:], many * kept, codec="zstd", asbytes=True), np.uint8).reshape(kept, many).T
    return out.view(kind).ravel()


def _data(strings: pa.Array) -> bytes:
    """What a whole array of strings holds, one after the other."""
    return bytes(strings.buffers()[2] or b"") if len(strings) else b""


def _strings(data: bytes, stop: int) -> pa.Array:
    """The strings of a buffer, each with the byte that ends it."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == stop) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _sorted(codes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, all less than ``below``, in order, and the place of each; equal ones keep their order."""
    bits = len(codes).bit_length()
    if below << bits <= ROOM:
        both = codes << bits
        both |= np.arange(len(codes))
        both.sort()
        return both >> bits, (both & (1 << bits) - 1).astype(np.int32)
    at = np.argsort(codes, kind="stable")
    return codes[at], at


def _distinct(codes: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each distinct code, by code, and for each place which of them it has."""
    held, order = _sorted(codes, below)
    new = np.ones(len(held), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    which = np.empty(len(held), np.int32)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class _Chunk:
    """Documents' words, gathered until there are enough."""

    def __init__(self):
        self.docs, self.lengths, self.own, self.texts, self.size = [], [], [], [], 0

    def add(self, doc: int, words: list[bytes], own: int) -> None:
        """own: how many of the words begin features here, and not in the next piece."""
        self.docs.append(doc)
        self.lengths.append(len(words))
        self.own.append(own)
        self.texts.append(b"\n".join(words) + b"\n" if words else b"")
        self.size += len(words)

    def numbered(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words in order, after that of no word, and the number among them of each word."""
        coded = _strings(b"".join(self.texts), 10).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(1, len(order) + 1)
        return pa.concat_arrays([pa.array([b"\n"], pa.large_binary()), coded.dictionary.take(pa.array(order))]), rank[coded.indices.to_numpy()]

    def runs(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First, second and third words of the runs that begin here, and their documents."""
        lengths, own = np.array(self.lengths), np.array(self.own)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(ids))
        begins = np.arange(len(ids)) < np.repeat(np.cumsum(lengths) - lengths + own, lengths)
        second, third = (np.where(left > k, np.append(ids[k:], np.zeros(k, ids.dtype))[: len(ids)], 0)[begins] for k in (1, 2))
        return ids[begins], second, third, np.repeat(np.array(self.docs, np.uint32), own)

    def sent(self, parts: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes, bytes, bytes]]:
        """(part, words, n_seconds, n_thirds, n, docs, codes) of SENT; 0 is the number of no word, the others rise with the word."""
        if not self.size:
            return
        vocabulary, ids = self.numbered()
        first, second, third, docs = self.runs(ids)
        base = len(vocabulary)
        del ids
        at, pair = _distinct(first.astype(np.int64) * base + second, base**2)
        first, second = first[at], second[at]
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, _data(vocabulary).split(b"\n")), np.uint64, base)
        mixed = hashes[first] * np.uint64(_MIX[0]) + hashes[second] * np.uint64(_MIX[1])
        owner = ((mixed ^ mixed >> np.uint64(29)) % np.uint64(parts)).astype(np.int64)
        # pairs by part, first and second word
        owner, order = _sorted(owner, parts)
        first, second = first[order], second[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        held, order = _sorted(rank[pair] * base + third, len(rank) * base)
        docs, third = docs[order], third[order]
        runs = np.flatnonzero(np.append(True, held[1:] != held[:-1]))
        pair, third, ends = held[runs] // base, third[runs], np.append(runs, len(held))
        del at, held, order, rank, mixed, hashes
        firsts = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (first[1:] != first[:-1])))
        n_seconds, n_thirds, n = np.diff(np.append(firsts, len(owner))), np.bincount(pair, minlength=len(owner)), np.diff(ends)
        # where each part begins among the pairs, the first words and the runs
        cuts = np.searchsorted(owner, np.arange(parts + 1))
        above, below, place = np.searchsorted(firsts, cuts), np.searchsorted(pair, cuts), np.empty(base, np.int64)
        for part in np.flatnonzero(np.diff(cuts)).tolist():
            one, two, three = (slice(x[part], x[part + 1]) for x in (above, cuts, below))
            used = np.concatenate([first[firsts[one]], second[two], third[three]])
            place[used] = np.arange(len(used))
            own = np.sort(used[place[used] == np.arange(len(used))])
            place[own] = np.arange(len(own))
            words, codes = _data(vocabulary.take(pa.array(own))), place[used]
            many = one.stop - one.start
            codes[1:many] -= codes[: many - 1].copy()
            counts = [_pack(x.astype(np.uint32)) for x in (n_seconds[one], n_thirds[two], n[three])]
            yield part, len(words).to_bytes(8, "little") + pa.compress(words, "zstd", asbytes=True), *counts, _pack(docs[ends[three.start] : ends[three.stop]]), _pack(codes.astype(np.uint32))


def sent_by(docs: DataFrame, words: int, parts: int, target: bool = False) -> DataFrame:
    """docs(doc_id, text) as rows of SENT, and one row a chunk, of a part below 0, with the ids and numbers of words of its documents."""

    def rows_of(chunk: int, held: _Chunk, ids: list, totals: list) -> Iterator[pa.RecordBatch]:
        rows = [(chunk, target, *x) for x in held.sent(parts)]
        if ids and not target:
            known = pa.array(ids, pa.int64())
            rows.append((chunk, target, -1 - chunk % parts, None, _pack(np.array([x is not None for x in ids])), _pack(known.fill_null(0).to_numpy()), _pack(np.array(totals, np.int64)), None, None))
        for row in rows:
            kinds = [pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SENT.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, ids, totals = TaskContext.get().partitionId() << 24, _Chunk(), [], []
        for b in batches:
            for doc_id, text in ((i, t) for few in batches_of(b) for i, t in zip(few.column("doc_id").to_pylist(), few.column("text").cast(pa.binary()).to_pylist(), strict=True)):
                found = (text or b"").translate(_CLEAN).split()
                ids.append(doc_id)
                totals.append(len(found))
                for at in range(0, max(1, len(found)), words):
                    if held.size >= words or (not at and len(ids) > words):
                        yield from rows_of(chunk, held, ids[:-1] if not at else [], totals[:-1])
                        if not at:
                            chunk, ids, totals = chunk + 1, ids[-1:], totals[-1:]
                        held = _Chunk()
                    held.add(len(ids) - 1, found[at : at + words + 2], min(words, len(found) - at))
        yield from rows_of(chunk, held, ids, totals)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), SENT)


class _Longer:
    """What the CRCs of strings become by the bytes behind them: crc32(a + b) == by(crc32(a), len(b)) ^ crc32(b)."""

    def __init__(self, lengths: np.ndarray):
        """lengths: of all strings that may stand behind."""
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = one >> 1 ^ (one & 1) * np.uint32(0xEDB88320)
        bits = (np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]).ravel()
        many, self.row = np.unique(lengths, return_inverse=True)
        self.tables = np.tile(bits, (len(many), 1))
        # by 1, 2, 4 ... bytes, for each byte of a CRC
        step = bits >> 8 ^ one[bits & 255]
        for k in range(int(many.max(initial=0)).bit_length()):
            here = many >> k & 1 == 1
            self.tables[here] = self._look(step, self.tables[here], 0)
            step = self._look(step, step, 0)

    @staticmethod
    def _look(tables: np.ndarray, crc: np.ndarray, at: np.ndarray | int) -> np.ndarray:
        return tables[at + (crc & 255)] ^ tables[at + (256 + (crc >> 8 & 255))] ^ tables[at + (512 + (crc >> 16 & 255))] ^ tables[at + (768 + (crc >> 24))]

    def by(self, crc: np.ndarray, which: np.ndarray) -> np.ndarray:
        """which: the numbers, among the lengths, of the strings behind."""
        return self._look(self.tables.ravel(), crc, self.row[which] * 1024)


class _Part:
    """The dictionary's entries of one part, and where each chunk's runs of words are in it."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        texts = [pa.decompress(r["words"][8:], int.from_bytes(r["words"][:8], "little"), codec="zstd", asbytes=True) for r in rows]
        n_seconds, n_thirds, self.n, codes = ([_unpack(r[c], np.uint32) for r in rows] for c in ("n_seconds", "n_thirds", "n", "codes"))
        coded = _strings(b"".join(texts), 10).dictionary_encode()
        words, numbers, at = _data(coded.dictionary).split(b"\n")[:-1], coded.indices.to_numpy(), 0
        levels: list[list[np.ndarray]] = [[], [], []]
        for text, own, two, three in zip(texts, codes, n_seconds, n_thirds, strict=True):
            np.cumsum(own[: len(two)], out=own[: len(two)])
            for level, x in zip(levels, np.split(numbers[at:][own], [len(two), len(two) + len(three)]), strict=True):
                level.append(x)
            at += text.count(b"\n")
        first, second, third = map(np.concatenate, levels)
        del texts, codes, coded, numbers, levels, level, own, x
        # the hash of a run goes on from that of the run that begins it; each distinct one is hashed once
        hashed = np.fromiter(map(crc32, words), np.uint32, len(words))
        spaced = np.fromiter(map(crc32, map(b" ".__add__, words)), np.uint32, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        filled, longer = lengths > 0, _Longer(lengths + 1)
        begin = np.repeat(first, np.concatenate(n_seconds))
        at, pair = _distinct(begin.astype(np.int64) * len(words) + second, len(words) ** 2)
        pairs = longer.by(hashed[begin[at]], second[at]) ^ spaced[second[at]]
        many, has_second = len(at), filled[second[at]]
        own = np.repeat(pair, np.concatenate(n_thirds))
        at, run = _distinct(own.astype(np.int64) * len(words) + third, many * len(words))
        runs = longer.by(pairs[own[at]], third[at]) ^ spaced[third[at]]
        has_third = filled[third[at]]
        # of each run sent: the buckets of its one, two and three words, and BUCKETS for none
        self.buckets = [
            (hashed % BUCKETS).astype(np.int32)[np.repeat(begin, np.concatenate(n_thirds))],
            np.where(has_second, pairs % BUCKETS, BUCKETS).astype(np.int32)[own],
            np.where(has_third, runs % BUCKETS, BUCKETS).astype(np.int32)[run],
        ]

    def sums(self) -> np.ndarray:
        """Counts of the buckets, of the corpus and of the target."""
        n = np.concatenate(self.n).astype(float)
        target = np.repeat([r["target"] for r in self.rows], [len(x) for x in self.n])
        return np.stack([sum(np.bincount(b, n * (target == side), BUCKETS + 1)[:BUCKETS] for b in self.buckets).astype(np.int64) for side in (False, True)])

    def weights(self, gains: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each chunk's sums of gains by its documents."""
        table = np.append(gains, 0)
        each, at = sum(table[b] for b in self.buckets), 0
        for row, n in zip(self.rows, self.n, strict=True):
            if not row["target"]:
                yield row["chunk"], np.bincount(_unpack(row["docs"], np.uint32), np.repeat(each[at : at + len(n)], n)).astype(np.int64)
            at += len(n)


def gains_of(sent: DataFrame) -> DataFrame:
    """gains, one row with the gains of all buckets, from the sums of all parts."""

    def merge(rows: pa.Table) -> pa.Table:
        held = rows.filter(pc.greater_equal(rows["part"], 0)).to_pylist()
        s, t = _Part(held).sums() if held else np.zeros((2, BUCKETS), np.int64)
        return pa.table({"bucket": np.arange(BUCKETS), "s": s, "t": t})

    sums = sent.groupBy("part").applyInArrow(lean_group(merge), "bucket long, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    d = lambda c: F.col(c).cast("double")
    whole = sums.agg(F.sort_array(F.collect_list(F.struct("bucket", "s", "t"))).alias("held"), F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    gain = lambda x: F.floor(1000 * F.log((x["t"].cast("double") + 1) * (d("all_s") + BUCKETS) / ((x["s"].cast("double") + 1) * (d("all_t") + BUCKETS)))).cast("long")
    return whole.select(F.transform("held", gain).alias("gains"))


def weigh(docs: DataFrame, target: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight: a row each row of docs(doc_id, text); target has a text column."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    chunk = max(chunk, math.isqrt(6000 * (size // 6)))
    parts = max(1, -(-size // (4 * chunk)))
    theirs = sent_by(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), chunk, parts, True)
    sent = sent_by(docs, chunk, parts).unionByName(theirs)

    def run(rows: pa.Table, told: pa.Table) -> pa.Table:
        held, gains = rows.to_pylist(), told["gains"].to_pylist()
        out: list[tuple] = []
        if held and held[0]["part"] >= 0:
            out = [(chunk, _pack(weight), None, None, None) for chunk, weight in _Part(held).weights(np.array(gains[0], np.int64))]
        elif held:
            out = [(r["chunk"], None, r["n_seconds"], r["n_thirds"], r["n"]) for r in held]
        kinds = [pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["chunk", "weight", "known", "ids", "totals"])

    # one query, so that the gains and the weights are of one exchange
    told = docs.sparkSession.range(-parts, parts).select(F.col("id").cast("int").alias("part")).crossJoin(F.broadcast(gains_of(sent)))
    pieces = sent.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(lean_pair(run), "chunk long, weight binary, known binary, ids binary, totals binary")

    def add(rows: pa.Table) -> pa.Table:
        held = rows.to_pylist()
        known, ids, totals = next((_unpack(r["known"], bool), _unpack(r["ids"], np.int64), _unpack(r["totals"], np.int64)) for r in held if r["known"])
        weight = np.zeros(len(ids), np.int64)
        for r in held:
            if r["weight"]:
                own = _unpack(r["weight"], np.int64)
                weight[: len(own)] += own
        many = sum(np.maximum(totals - k, 0) for k in range(3))
        return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=~known), "n_words": totals, "n_features": many, "weight": weight})

    return pieces.groupBy("chunk").applyInArrow(lean_group(add), "doc_id long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int = 42) -> Column:
    """floor(1000 * Gumbel) from the first 32 bits of sha256(seed:key)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """rows with the number, from 1, of each by falling value, then by key (null first): counted range by range."""
    many = rows.count()
    parts = max(1, many // PART_ROWS)
    order = [F.col(value).desc(), F.col(key).asc_nulls_first()]
    held = stage(rows.repartitionByRange(parts, *order).withColumn("_qm_part", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("_qm_part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("_qm_part", F.coalesce(F.sum("n").over(Window.orderBy("_qm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_qm_before"))
    at = F.row_number().over(Window.partitionBy("_qm_part").orderBy(*order))
    return held.withColumn("_qm_at", at).join(before, "_qm_part").withColumn(name, F.col("_qm_before") + F.col("_qm_at")).drop("_qm_part", "_qm_before", "_qm_at")


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: of the documents of ``least`` words, floor(percent / 100) of them have a rank."""
    scored = stage(weigh(docs, target, chunk).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    able = ranked(scored.where(F.col("n_words") >= least), "score", "doc_id", "rank")
    drawn = scored.where(F.col("n_words") >= least).count() * percent // 100
    able = able.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return able.unionByName(scored.where(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))
