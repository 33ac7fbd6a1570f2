"""Documents in chunks of bounded size, and key look-ups between chunks.

``Chunks`` deals documents into ranges of doc_id (see ``ranges``).  Operators that must know which
hashes occur in other documents too send, for each chunk and hash bucket, one row with the sorted
distinct hashes as packed bytes.  A hash that a third of all documents hold is then one entry a chunk, and rows
are as even as the hash.  Answers go back to the chunk in the same form, so nothing is ever
expanded into pairs, and no document is sent to more than one place.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import Ranges
from .shared import hash_words

CHUNK, BUCKET = "_qm_chunk", "_qm_bucket"
#: Bytes of text in a chunk: the least and the most.  In between it grows with the root of the
#: corpus, so that a row between a chunk and a bucket keeps a useful size.
LEAST, MOST = 6 << 20, 256 << 20


class Chunks:
    """documents(doc_id, text, *carry) plus a chunk number that rises with doc_id, then with the text's digest."""

    def __init__(self, docs: DataFrame, carry: list[str] | None = None, least: int = LEAST):
        self.carry = [c for c in carry or [] if c not in ("doc_id", "text")]
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *self.carry)
        total = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        ranges = Ranges(docs, "text", min(MOST, max(least, math.isqrt(1500 * total))))
        self.n, self.docs = ranges.n, ranges.with_number(docs, "text", CHUNK)

    def grouped(self):
        return self.docs.groupBy(CHUNK)


class Loaded:
    """A chunk in memory: rows by doc_id (null first) and the text's digest, words, their hashes and places."""

    def __init__(self, rows: pa.Table, lower: bool = False):
        ids = rows["doc_id"].to_pylist()
        texts = [(t or "").encode() for t in rows["text"].to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, hashlib.md5(texts[i]).digest()))
        self.ids = [ids[i] for i in self.order]
        self.words = [(texts[i].lower() if lower else texts[i]).split() for i in self.order]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        parts = [hash_words(w) for w in self.words]
        self.hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def valid(self, k: int) -> np.ndarray:
        """Whether a run of k words that starts here ends in the same document."""
        n = max(0, len(self.hashes) - k + 1)
        return (np.arange(len(self.hashes)) + k <= np.repeat(self.ends, self.lengths))[:n]


def code_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the upper half, 32 further bits of the hash in the lower."""
    return ((hashes >> np.uint64(40)) % np.uint64(buckets) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def slices(codes: np.ndarray):
    """(bucket, from, to) of sorted codes."""
    owners = (codes >> np.uint64(32)).astype(np.int64)
    if not len(owners):
        return
    cuts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
    for a, b in zip(cuts, [*cuts[1:], len(owners)], strict=True):
        yield int(owners[a]), int(a), int(b)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags(packed: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8), count=n).astype(bool)
