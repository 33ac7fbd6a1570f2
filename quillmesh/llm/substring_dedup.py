"""Removal of repeated passages by fixed-block anchors.

Every document is cut into blocks of ``window // 2`` words that do not overlap; these are the
index.  Every run of that many words, at every place, probes it.  A window of ``window`` words
holds a whole block wherever it lies, so two equal windows always share a hit, and hits that
touch grow into the runs in which repeats can lie.  Windows in these runs are then compared by a
64-bit hash within buckets cut by a second, independent hash; what they cover together are the
maximal exact repeats.

The earlier of two windows is that in the smaller doc_id, then the one that starts first.  Rows
that repeat a doc_id come in the order of a digest of their texts, and null doc_id before all
others.  Null and blank texts have no words and are kept as empty ones; texts are read whole, and
one that is longer than a chunk is a chunk of its own; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import BUCKET, CHUNK, Chunks, Loaded, bits, code_of, flags, slices
from .shared import lean_group, lean_pair, rolling

_PROBES = f"{BUCKET} int, {CHUNK} int, keys binary, repeated binary, anchors binary"
_HITS = f"{CHUNK} int, {BUCKET} int, hits binary"
_KEYS = f"{BUCKET} int, {CHUNK} int, keys binary"


def _arrow(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _probes(chunk: Loaded, block: int, buckets: int):
    """Distinct codes of all runs, which code each place has, and the places of runs."""
    places = np.flatnonzero(chunk.valid(block))
    codes, inverse, counts = np.unique(code_of(rolling(chunk.hashes, block)[places], buckets), return_inverse=True, return_counts=True)
    return places, codes, inverse, counts


def remove_repeats(docs: DataFrame, window: int = 20, carry: list[str] | None = None, least: int | None = None) -> DataFrame:
    """doc_id, *carry, n_words, n_removed, kept_text (the words left, joined by one space); carried columns of these names are replaced."""
    if window < 2:
        raise ValueError("window must have two words at least")
    carry = [c for c in carry or [] if c not in ("n_words", "n_removed", "kept_text")]
    chunks = Chunks(docs, carry, **({"least": least} if least else {}))
    buckets, block, carried = chunks.n, window // 2, chunks.carry
    reach = window - block + 1

    def probe(rows: pa.Table) -> pa.Table:
        chunk = Loaded(rows)
        places, codes, inverse, counts = _probes(chunk, block, buckets)
        anchored = np.zeros(len(codes), bool)
        anchored[inverse[(places - np.repeat(chunk.starts, chunk.lengths)[places]) % block == 0]] = True
        number = rows[CHUNK][0].as_py()
        low = codes.astype(np.uint32)
        out = [(k, number, low[a:b].tobytes(), bits(counts[a:b] > 1), bits(anchored[a:b])) for k, a, b in slices(codes)]
        return _arrow(out, [BUCKET, CHUNK, "keys", "repeated", "anchors"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()])

    def meet(rows: pa.Table) -> pa.Table:
        sent = list(zip(*(rows[c].to_pylist() for c in (CHUNK, "keys", "repeated", "anchors")), strict=True))
        sizes = [len(x[1]) // 4 for x in sent]
        _, inverse, counts = np.unique(np.frombuffer(b"".join(x[1] for x in sent), np.uint32), return_inverse=True, return_counts=True)
        repeated = np.concatenate([flags(x[2], n) for x, n in zip(sent, sizes, strict=True)])
        anchored = np.concatenate([flags(x[3], n) for x, n in zip(sent, sizes, strict=True)])
        hit = ((counts > 1) | (np.bincount(inverse, repeated, len(counts)) > 0)) & (np.bincount(inverse, anchored, len(counts)) > 0)
        out, at, bucket = [], 0, rows[BUCKET][0].as_py()
        for x, n in zip(sent, sizes, strict=True):
            if (own := hit[inverse[at : at + n]]).any():
                out.append((x[0], bucket, bits(own)))
            at += n
        return _arrow(out, [CHUNK, BUCKET, "hits"], [pa.int32(), pa.int32(), pa.binary()])

    def extend(rows: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = [pa.int32(), pa.int32(), pa.binary()]
        if not rows.num_rows or not answers.num_rows:
            return _arrow([], [BUCKET, CHUNK, "keys"], kinds)
        chunk = Loaded(rows)
        places, codes, inverse, _ = _probes(chunk, block, buckets)
        hit, to = np.zeros(len(codes), bool), dict(zip(answers[BUCKET].to_pylist(), answers["hits"].to_pylist(), strict=True))
        for k, a, b in slices(codes):
            if k in to:
                hit[a:b] = flags(to[k], b - a)
        runs = np.zeros(len(chunk.hashes) + reach + 1, np.int64)
        runs[places[hit[inverse]] + 1] = 1
        runs = np.cumsum(runs)
        whole = np.flatnonzero(chunk.valid(window))
        whole = whole[runs[whole + reach] > runs[whole]]
        first, second = rolling(chunk.hashes, window)[whole], rolling(chunk.hashes, window, 1)[whole]
        first, at = np.unique(first, return_index=True)
        owner = (second[at] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(owner, kind="stable")
        first, owner = first[order], owner[order]
        cuts = np.searchsorted(owner, np.arange(buckets + 1))
        number = rows[CHUNK][0].as_py()
        out = [(k, number, first[cuts[k] : cuts[k + 1]].tobytes()) for k in range(buckets) if cuts[k] < cuts[k + 1]]
        return _arrow(out, [BUCKET, CHUNK, "keys"], kinds)

    def judge(rows: pa.Table) -> pa.Table:
        numbers, keys = rows[CHUNK].to_numpy(), rows["keys"].to_pylist()
        owner = np.repeat(numbers, [len(k) // 8 for k in keys])
        every = np.frombuffer(b"".join(keys), np.uint64)
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        late = np.r_[False, every[1:] == every[:-1]]
        every, owner = every[late], owner[late]
        bucket = rows[BUCKET][0].as_py()
        out = [(bucket, int(c), every[owner == c].tobytes()) for c in np.unique(owner)]
        return _arrow(out, [BUCKET, CHUNK, "keys"], [pa.int32(), pa.int32(), pa.binary()])

    names = ["doc_id", *carried, "n_words", "n_removed", "kept_text"]
    kept_fields = [chunks.docs.schema[c] for c in carried]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *kept_fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])

    def cut(rows: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Loaded(rows)
        whole = np.flatnonzero(chunk.valid(window))
        codes, at, inverse = np.unique(rolling(chunk.hashes, window)[whole], return_index=True, return_inverse=True)
        late = np.arange(len(whole)) != at[inverse]
        elsewhere = np.frombuffer(b"".join(answers["keys"].to_pylist()), np.uint64)
        late |= np.isin(codes, elsewhere)[inverse]
        cover = np.zeros(len(chunk.hashes) + 1, np.int64)
        np.add.at(cover, whole[late], 1)
        np.add.at(cover, whole[late] + window, -1)
        keep = np.cumsum(cover)[:-1] == 0
        texts, removed = [], []
        for words, a, b in zip(chunk.words, chunk.starts, chunk.ends, strict=True):
            left = keep[a:b]
            n = int(b - a - left.sum())
            removed.append(n)
            texts.append(b" ".join(compress(words, left) if n else words).decode())
        rows = rows.take(pa.array(chunk.order, pa.int64()))
        return pa.table([rows["doc_id"], *(rows[c] for c in carried), pa.array(chunk.lengths), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=names)

    probes = chunks.grouped().applyInArrow(lean_group(probe), _PROBES)
    hits = probes.groupBy(BUCKET).applyInArrow(lean_group(meet), _HITS)
    windows = chunks.grouped().cogroup(hits.groupBy(CHUNK)).applyInArrow(lean_pair(extend), _KEYS)
    late = windows.groupBy(BUCKET).applyInArrow(lean_group(judge), _KEYS)
    return chunks.grouped().cogroup(late.groupBy(CHUNK)).applyInArrow(lean_pair(cut), schema)
