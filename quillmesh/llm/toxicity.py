"""Toxicity by class-conditional Kneser-Ney models of spelling.

Each class models a word letter by letter, with contexts of up to ``ORDER - 1`` letters from the
word's start.  A class's counts are discounted and fall back on one Kneser-Ney distribution that
both share, counted over the words of all documents, to which ``BELIEF`` further counts of every
context go, so where a class has seen little the two say the same and cancel: for a letter that
neither saw after a context, the ratio of the two models is that of their backoff weights alone.
New forms of a toxic stem are therefore found by the stem.  A document counts a word once, so a
long or repetitive one weighs no more.

The text's words give log-likelihood ratios.  Their means, that is length-normalised, over the
whole text and over its most toxic windows of one word and of four are the inputs of a logistic
curve.  It is fitted on labelled rows scored by models whose class counts leave out their fold; the
shared backoff knows no labels and has seen their words, as it has those of any document scored.
Every word of every text is scored.  Learning and scoring cut words by the same function.

The class counts and the curve are fitted on at most ``rows`` labelled documents of each label
(those of the lowest hashed id); all their letter sequences are kept.  The shared counts stay in
Spark; those of sequences that neither class has seen cancel and are not fetched.  Nulls and texts
without words score as no evidence; rows without a label, or with a null one, are not learnt from.
Of rows that repeat a labelled doc_id one is learnt from, the first by digest.  Repeated texts
score alike; only ``doc_id`` and ``text`` are read, so other columns cannot clash.  Where no row is
labelled toxic no document is taken for it, and without documents there are no rows.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranges import digest
from .shared import batches_of, lean, release, stage

ORDER, DISCOUNT, WINDOWS, FOLDS = 6, 0.75, (1, 4), 4
#: Counts of every context that are taken to follow the shared backoff: of 3 to 800, that of the least log loss on the folds of the learning rows.
BELIEF = 60.0
#: Words that a task counts before it sends the counts on.
HELD = 200_000


def _marks() -> str:
    """A pattern's ranges of all combining marks, which belong to the word they stand in."""
    codes = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c))[0] == "M"]
    starts = [c for k, c in enumerate(codes) if not k or codes[k - 1] < c - 1]
    ends = [c for k, c in enumerate(codes) if k + 1 == len(codes) or codes[k + 1] > c + 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends, strict=True))


_TOKEN = re.compile(rf"[\w{_marks()}]+")


class _Spaced(dict):
    """For ``str.translate``: code points of words stay, all others become spaces; each is judged by the pattern once."""

    def __missing__(self, code: int) -> int:
        self[code] = code if code != ord("_") and _TOKEN.fullmatch(chr(code)) else 32
        return self[code]


_SPACED = _Spaced()
_ASCII = bytes(map(_SPACED.__getitem__, range(128))).ljust(256)


def words_in(text: str | None) -> list[str]:
    """Lower-cased runs of letters, marks and digits."""
    text = (text or "").lower()
    # no white space is of a word, so split() finds the pattern's runs, in a fifth of its time
    spaced = text.encode().translate(_ASCII).decode() if text.isascii() else text.translate(_SPACED)
    return spaced.split()


def grams_of(word: str) -> list[str]:
    s = "^" + word + "$"
    return [s[:i] for i in range(2, min(ORDER, len(s) + 1))] + [s[i : i + ORDER] for i in range(len(s) - ORDER + 1)]


@dataclass
class Spelling:
    """Log ratios of toxic to ordinary, by letter sequence and by context."""

    ratio: dict[str, float]
    weight: dict[str, float]
    curve: list[float] = field(default_factory=lambda: [0.0] * (2 + len(WINDOWS)))
    #: Mean log loss of the labelled rows, each scored without its fold.
    loss: float = math.nan
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, word: str) -> float:
        if (v := self.known.get(word)) is None:
            ratio, weight = self.ratio, self.weight
            v = 0.0
            for g in grams_of(word):
                r = ratio.get(g)
                v += weight.get(g[:-1], 0.0) if r is None else r
            if len(self.known) >= 300_000:
                self.known.clear()
            if len(word) <= 40:
                self.known[word] = v
        return v

    def inputs(self, text: str | None) -> list[float]:
        """Mean ratio a word: of the whole text, and of its most toxic window of each length."""
        words = words_in(text)
        if not words:
            return [0.0] * (1 + len(WINDOWS))
        held = list(map(self.known.get, words))
        v = np.array([self.word(w) if x is None else x for w, x in zip(words, held, strict=True)] if None in held else held)
        total = np.r_[0.0, np.cumsum(v)]
        most = [total[-1] / k if len(v) <= k else (total[k:] - total[:-k]).max() / k for k in WINDOWS]
        return [float(x) for x in (total[-1] / len(v), *most)]

    def score(self, text: str | None) -> float:
        at = self.curve[0] + sum(b * x for b, x in zip(self.curve[1:], self.inputs(text), strict=True))
        return 1 / (1 + math.exp(-min(50.0, max(-50.0, at))))


def count_words(rows: DataFrame) -> DataFrame:
    """(fold, toxic, text) -> fold, toxic, word, n: partial counts of the documents that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple, Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (fold, toxic), own in counts.items():
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([fold] * n, pa.int32()), pa.array([toxic] * n, pa.int32()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["fold", "toxic", "word", "n"])
            counts.clear()

        for batch in batches:
            for b in batches_of(batch, 256):
                for fold, toxic, text in zip(*(b.column(c).to_pylist() for c in ("fold", "toxic", "text")), strict=True):
                    counts[fold, toxic].update(set(words_in(text)))
                if sum(map(len, counts.values())) > HELD:
                    yield from flush()
        yield from flush()

    return rows.select("fold", "toxic", "text").mapInArrow(lean(run), "fold int, toxic int, word string, n long")


def sequences(words: DataFrame, cells: list[str]) -> DataFrame:
    """words(word, n, *cells) -> gram, *cells, n, others, kinds: what Kneser-Ney needs to know of each sequence of ``cells``.

    Sequences are those of ``grams_of`` and their ends.  ``n`` counts the sequence in all words,
    whether or not a cell does; a shorter one counts the letters before it that it was seen with.
    ``others`` and ``kinds`` are the sum and the number of the sequences that share all letters
    but the last.  Cells are 0 for what is only an end.  Returned are the sequences, and ends of
    sequences, that a cell counts.
    """
    spelt = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
    cut = F.transform(F.sequence(F.lit(2), F.length("word") + 2), lambda i: F.substring(spelt, F.greatest(F.lit(1), i - ORDER + 1), F.least(i, F.lit(ORDER))))
    grams = words.select(F.explode(cut).alias("gram"), "n", *cells).groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("n", *cells)))
    ends = F.transform(F.sequence(F.lit(1), F.length("gram")), lambda i: F.substring(F.col("gram"), i, F.lit(ORDER)))
    whole = F.col("at") == 0
    learnt = sum(F.col(c) for c in cells) > 0
    parts = grams.select("n", *cells, learnt.alias("learnt"), F.posexplode(ends).alias("at", "gram"))
    parts = stage(parts.groupBy("gram").agg(*(F.sum(F.when(whole, F.col(c)).otherwise(0)).alias(c) for c in ("n", *cells)), F.max("learnt").alias("learnt")), "sequences")
    before = parts.where(F.length("gram") > 1).groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("before"))
    table = parts.join(before, "gram", "left").withColumn("n", F.col("n") + F.coalesce("before", F.lit(0))).withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    sums = table.groupBy("context").agg(F.sum("n").alias("others"), F.count(F.lit(1)).alias("kinds"))
    return table.where("learnt").join(sums, "context").select("gram", *cells, "n", "others", "kinds")


def shared_backoff(rows: Iterable[tuple[str, int, int, int]]) -> dict[str, float]:
    """Interpolated Kneser-Ney probability of a sequence's last letter after the others, from ``sequences``."""
    sizes: list[list[tuple[str, int, int, int]]] = [[] for _ in range(ORDER + 1)]
    for row in rows:
        sizes[len(row[0])].append(row)
    p = {"": 1.0 / (1 + max([1, *(kinds for *_, kinds in sizes[1])]))}
    for table in sizes[1:]:
        for g, n, others, kinds in table:
            p[g] = (max(n - DISCOUNT, 0.0) + DISCOUNT * kinds * p[g[1:]]) / others
    return p


def spelling_model(counts: list[tuple[str, int, int]], below: dict[str, float], belief: float = BELIEF) -> Spelling:
    """From (letter sequence, count in toxic words, count in ordinary words) and the shared backoff."""
    total: list[dict[str, float]] = [defaultdict(float), defaultdict(float)]
    kinds: list[dict[str, int]] = [defaultdict(int), defaultdict(int)]
    for g, *n in counts:
        h = g[:-1]
        for k in (0, 1):
            if n[k]:
                total[k][h] += n[k]
                kinds[k][h] += 1
    backs = [{h: (DISCOUNT * kinds[k][h] + belief) / (n + belief) for h, n in total[k].items()} for k in (0, 1)]
    weight = {h: math.log(backs[0].get(h, 1.0) / backs[1].get(h, 1.0)) for h in total[0].keys() | total[1].keys()}
    ratio = {}
    for g, *n in counts:
        h, p = g[:-1], below[g]
        toxic, ordinary = ((max(n[k] - DISCOUNT, 0.0) / (total[k][h] + belief) if n[k] else 0.0) + backs[k].get(h, 1.0) * p for k in (0, 1))
        ratio[g] = math.log(toxic / ordinary)
    return Spelling(ratio, weight)


def fit_curve(inputs: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = 60) -> list[float]:
    """Logistic regression by Newton's method, with a slight pull to 0."""
    x = np.c_[np.ones(len(inputs)), inputs]
    b = np.zeros(x.shape[1])
    if not len(x) or not 0 < labels.sum() < len(labels):
        b[0] = 3.0 if len(x) and labels.all() else -3.0
        return b.tolist()
    pull = np.diag([1e-3, *[1e-2] * (x.shape[1] - 1)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        slope = x.T @ (weights * (labels - p)) - pull @ b
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + pull
        step = np.linalg.solve(bend, slope)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b.tolist()


def log_loss(curve: list[float], inputs: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    p = 1 / (1 + np.exp(-np.clip(curve[0] + inputs @ np.array(curve[1:]), -50, 50)))
    return float(-(weights * np.log(np.where(labels > 0, p, 1 - p))).sum() / weights.sum())


@dataclass
class Evidence:
    """What models are made of: letter sequences with counts by fold and label, the shared backoff, and the sample."""

    spellings: list[str]
    n: np.ndarray
    below: dict[str, float]
    chosen: DataFrame
    weights: dict[int, float]

    def without(self, fold: int | None, belief: float = BELIEF) -> Spelling:
        left = self.n.sum(1) - (self.n[:, fold] if fold is not None else 0)
        return spelling_model([(g, t, o) for g, t, o in zip(self.spellings, left[:, 0].tolist(), left[:, 1].tolist(), strict=True) if t or o], self.below, belief)


def gather(docs: DataFrame, labels: DataFrame, rows: int = 10_000) -> Evidence:
    """docs(doc_id, text) and labels(doc_id, toxic), of learning rows only."""
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    marked = marked.withColumn("_qm_turn", F.xxhash64(F.lit("toxicity"), "doc_id"))
    kept, share = [], {}
    for label in (0, 1):
        own = marked.where(F.col("toxic") == label)
        share[label] = own.count()
        kept.append(own.orderBy("_qm_turn").limit(rows))
    sample = kept[0].unionByName(kept[1]).withColumn("fold", F.pmod(F.col("_qm_turn"), F.lit(FOLDS)).cast("int"))
    # the sample has 2 * rows short rows at most, so every executor can hold it
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.select("doc_id", "toxic", "fold")), "doc_id")
    chosen = stage(texts.groupBy("doc_id", "toxic", "fold").agg(F.min_by("text", digest(F.col("text"))).alias("text")), "labelled")
    cells = [((F.col("fold") == k) & (F.col("toxic") == y), f"n{k}_{y}") for k in range(FOLDS) for y in (1, 0)]
    every = count_words(docs.select(F.lit(None).cast("int").alias("fold"), F.lit(None).cast("int").alias("toxic"), "text"))
    words = every.unionByName(count_words(chosen.select("fold", "toxic", "text"))).groupBy("word")
    words = words.agg(F.coalesce(F.sum(F.when(F.col("fold").isNull(), F.col("n"))), F.lit(0)).alias("n"), *(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(name) for c, name in cells))
    names = [name for _, name in cells]
    found = sequences(words, names)
    rows_of = found.toArrow()
    below = shared_backoff(row for b in rows_of.to_batches() for row in zip(*(b[c].to_pylist() for c in ("gram", "n", "others", "kinds")), strict=True))
    n = np.stack([rows_of[c].to_numpy() for c in names], 1).reshape(rows_of.num_rows, FOLDS, 2)
    own = n.any((1, 2))
    spellings, n = rows_of["gram"].filter(pa.array(own)).to_pylist(), n[own]
    del rows_of
    release()

    return Evidence(spellings, n, below, chosen, {y: share[y] / max(1, min(rows, share[y])) for y in (0, 1)})


def fit(docs: DataFrame, labels: DataFrame, rows: int = 10_000) -> Spelling:
    """The model of ``gather`` and its curve, from rows scored without their fold."""
    known = gather(docs, labels, rows)

    def inputs_of(fold: int) -> pa.Table:
        sent = docs.sparkSession.sparkContext.broadcast(known.without(fold))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [sent.value.inputs(t) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(got, pa.list_(pa.float64()))], names=["toxic", "inputs"])

        out = known.chosen.where(F.col("fold") == fold).mapInArrow(lean(run), "toxic int, inputs array<double>").toArrow()
        sent.destroy()
        return out

    seen = pa.concat_tables([inputs_of(k) for k in range(FOLDS)]).to_pandas()
    model = known.without(None)
    y = seen["toxic"].to_numpy(float)
    w = np.where(y > 0, known.weights[1], known.weights[0])
    x = np.array(seen["inputs"].tolist(), float).reshape(len(seen), 1 + len(WINDOWS))
    model.curve = fit_curve(x, y, w)
    if len(x):
        model.loss = log_loss(model.curve, x, y, w)
    return model


def score(docs: DataFrame, model: Spelling, carry: list[str] | None = None) -> DataFrame:
    """doc_id, *carry, score (0 to 1); input columns called score are replaced."""
    carry = [c for c in carry or [] if c not in ("doc_id", "score")]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", *carry, *(["text"] if "text" not in carry else []))
    names = ["doc_id", *carry, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batches_of(batch, 512):
                got = pa.array([sent.value.score(t) for t in b.column("text").to_pylist()], pa.float64())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-1]), got], names=names)

    return source.mapInArrow(lean(run, lambda: sent.value.known.clear()), T.StructType([*(source.schema[c] for c in names[:-1]), T.StructField("score", T.DoubleType())]))
