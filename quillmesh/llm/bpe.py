"""Byte-pair encoding and decoding with the merges of a tokenizer file.

A piece of text is a doubly linked list of symbols.  A heap holds the pairs that can merge, by
rank and then by place; an entry whose symbols have changed since it was pushed is stale and
skipped.  Decoding concatenates the vocabulary's strings, with a space between them where the
file names no decoder.

The file's normalizer must be NFC, white space to one space, lower case; its pre-tokenizer the
split by pattern and the byte-level map; words end in a suffix.  Other files are refused.
Null text encodes as the empty text, which has no ids; texts of any length are encoded whole;
repeated rows encode alike; of pairs of equal rank the first in the text merges; no rows give no
rows.  A token file's usual form is kept: ``ids`` is binary, unsigned 32-bit little-endian.  Input
columns called ids or decoded are replaced where they are made, all others are carried.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import batches_of, lean

#: What the tokenizer file calls white space, less the three that ``str.split`` adds.
_EXTRA_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = "\t-\r \x85\xa0  -     　"


class Bpe:
    """Encoder and decoder of one tokenizer file."""

    #: Pieces of at most so many characters are remembered, so many at a time.
    REMEMBERED, LONGEST = 600_000, 40

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") or not model["end_of_word_suffix"] or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError(f"{path}: only word-end BPE files with NFC and lower case are supported")
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.suffix = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocabulary
        #: Rank by the two ids, packed into one number, and the id that each rank makes.
        self.ranks = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(merges)}
        self.made = [ids[a + b] for a, b in merges]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special = special
        self.find_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.strings = {i: s for s, i in (ids | special).items()}
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", _SPACE) if "[^" in split["pattern"]["Regex"] else split["pattern"]["Regex"])
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.byte_chars = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.first = {b: ids.get(c, -1) for b, c in self.byte_chars.items()}
        self.last = {b: ids.get(c + self.suffix, -1) for b, c in self.byte_chars.items()}
        self.known: dict[str, bytes] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece, which is not empty."""
        raw = piece.encode()
        first = self.first
        symbols = [first[b] for b in raw]
        symbols[-1] = left = self.last[raw[-1]]
        n = len(symbols)
        if n == 1:
            return [left] if left >= 0 else []
        rank_of, made = self.ranks.get, self.made
        pairs = [-1] * n  # rank of the pair that starts at a symbol, -1 for none
        heap = []  # rank, then place, in one number
        left = symbols[0]
        for i in range(1, n):
            right = symbols[i]
            if (rank := rank_of(left << 32 | right)) is not None:
                pairs[i - 1] = rank
                heap.append(rank << 32 | i - 1)
            left = right
        if not heap:
            return [s for s in symbols if s >= 0]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            if pairs[i] != entry >> 32:
                continue  # stale: one of the two symbols has merged since
            symbols[i] = whole = made[entry >> 32]
            j = after[i]
            symbols[j] = pairs[j] = -1
            after[i] = k = after[j]
            pairs[i] = -1
            if k < n:
                before[k] = i
                if (rank := rank_of(whole << 32 | symbols[k])) is not None:
                    pairs[i] = rank
                    heappush(heap, rank << 32 | i)
            if (h := before[i]) >= 0:
                if (rank := rank_of(symbols[h] << 32 | whole)) is not None:
                    pairs[h] = rank
                    heappush(heap, rank << 32 | h)
                else:
                    pairs[h] = -1
        return [s for s in symbols if s >= 0]

    def _of_piece(self, piece: str) -> bytes:
        if (known := self.known.get(piece)) is not None:
            return known
        return self._keep(piece, array("I", self.merge(piece)).tobytes())

    def _keep(self, text: str, packed: bytes) -> bytes:
        if len(text) <= self.LONGEST:
            if len(self.known) >= self.REMEMBERED:
                self.known.clear()
            self.known[text] = packed
        return packed

    def _of_word(self, word: str) -> bytes:
        """Ids of a run without white space."""
        if word.isalpha():
            return self._of_piece(word)
        return self._keep(word, b"".join(map(self._of_piece, self.pieces.findall(word))))

    def _of_plain(self, text: str) -> bytes:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")  # lower case letter by letter, wherever it stands
        text = text.lower()
        words = re.findall(f"[^{_SPACE}]+", text) if _EXTRA_SPACE.search(text) else text.split()
        known = self.known
        return b"".join([known[w] if w in known else self._of_word(w) for w in words])

    def encode(self, text: str) -> bytes:
        if not self.find_special or "<" not in text:
            return self._of_plain(text)
        parts = self.find_special.split(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if i % 2 else self._of_plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One encoder a process and file."""
    if path not in _LOADED:
        _LOADED[path] = Bpe(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _forget() -> None:
    for encoder in _LOADED.values():
        encoder.known.clear()


def _apply(docs: DataFrame, column: str, added: list[tuple[str, T.DataType]], make) -> DataFrame:
    names = {n for n, _ in added}
    docs = docs.select(*[c for c in docs.columns if c not in names or c == column])
    carried = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*carried, *(T.StructField(n, k) for n, k in added)])
    kinds = [pa.binary() if isinstance(k, T.BinaryType) else pa.string() for _, k in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batches_of(batch):
                made = zip(*map(make, rows.column(column).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in carried), *(pa.array(m, k) for m, k in zip(made, kinds, strict=True))], names=schema.names)

    return docs.mapInArrow(lean(run, _forget), schema)


def encode(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """Adds ``ids``; an input column of that name is replaced."""
    where = path or default_path()
    return _apply(docs, column, [("ids", T.BinaryType())], lambda t: (load(where).encode(t or ""),))


def decode(docs: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """Adds ``decoded``; null ids decode as the empty text."""
    where = path or default_path()
    return _apply(docs, column, [("decoded", T.StringType())], lambda x: (load(where).decode(x or b""),))


def round_trip(docs: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded`` in one pass over the texts."""
    where = path or default_path()

    def both(text: str | None) -> tuple[bytes, str]:
        ids = load(where).encode(text or "")
        return ids, load(where).decode(ids)

    return _apply(docs, column, [("ids", T.BinaryType()), ("decoded", T.StringType())], both)
