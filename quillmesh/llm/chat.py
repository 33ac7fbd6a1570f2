"""Chat formatting with loss masks aligned by character offsets.

A conversation is rendered whole: each turn is START role, a line feed, the text, END and a line
feed.  Inside roles and texts every ``<`` followed by bars gets one bar more, so no text can hold
a control string; in roles, backslashes and line feeds are escaped as well.  The rendering is
encoded once, with offsets.  Turn spans and token spans are both in order, so binary search finds
the tokens of each assistant text, and the mask is what a token and that text have in common:
where a token reaches over a text's end, only the part inside is under the mask.

Turns come in the order of turn (null first), then role, then text.  A null role or text is the
empty one; a null conv_id is a conversation like any other; repeated rows are a turn each; no rows
give no rows; columns but those four are not read.  A conversation, however long, is one row of the
output and is built by one task, which holds no other one meanwhile.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_BARS = re.compile(r"<(\|+)")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _BARS.sub(r"<|\1", text)


def unescape(text: str) -> str:
    return re.sub(r"<\|(\|+)", r"<\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        parts += [head, body, END + "\n"]
        spans.append((at + len(head), at + len(head) + len(body)))
        at = spans[-1][1] + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendering; raises if there is anything else in it."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return turns


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """A 1 for each token that meets a span, and what tokens and spans have in common, joined up."""
    starts, ends = [a for a, _ in offsets], [b for _, b in offsets]
    flags, common = [0] * len(offsets), []
    for lo, hi in spans:
        first, last = bisect_right(ends, lo), bisect_left(starts, hi)
        run: list[int] = []
        for i in range(first, last):
            a, b = max(lo, starts[i]), min(hi, ends[i])
            if a >= b:
                continue
            flags[i] = 1
            if run and a <= run[1]:
                run[1] = max(run[1], b)
            else:
                if run:
                    common.append((run[0], run[1]))
                run = [a, b]
        if run:
            common.append((run[0], run[1]))
    return flags, common


_LOADED: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.add_special_tokens([START, END])
        _LOADED[path] = own
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


FORMATTED = "conv_id long, n_turns long, formatted string, ids array<int>, loss_mask array<int>, loss_spans array<struct<start:int,end:int>>"


def format_conversations(rows: DataFrame, path: str | None = None, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) -> a row a conversation, as in FORMATTED.  Other columns are not read."""
    where = path or default_path()

    def finish(batch: list) -> pa.RecordBatch:
        columns = list(zip(*batch, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n_turns", "formatted", "ids", "loss_mask", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = (t for b in batches for t in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        batch, held = [], 0
        for conv, own in groupby(turns, key=lambda t: t[0]):
            said = [(role or "", text or "") for _, role, text in own]
            formatted, spans = render(said)
            encoded = _tokenizer(where).encode(formatted, add_special_tokens=False)
            flags, common = mask(encoded.offsets, [s for s, (role, _) in zip(spans, said, strict=True) if role in learnt])
            batch.append((conv, len(said), formatted, encoded.ids, flags, [{"start": a, "end": b} for a, b in common]))
            held += len(formatted)
            if held > 1 << 20:
                yield finish(batch)
                batch, held = [], 0
        if batch:
            yield finish(batch)

    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    sorted_ = own.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    return sorted_.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)
