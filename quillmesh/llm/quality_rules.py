"""Quality rules whose cutoffs carry a bound on false rejection, in DataFrame operations only.

A rule rejects a document when one of its measures, an integer, is over a cutoff.  The cutoffs of
all rules are chosen together for each stratum (the document's language) from documents that are
labelled good.  A hash of doc_id parts these: on the first part, one of ``PARTS``, each rule's
cutoffs are placed, from mild ones far beyond the largest measure seen down to quantiles.  That is
one path of steps a stratum.  On the rest, the holdout, the number of good documents that any rule
rejects at a step is binomial, and the step is certified when so few, or fewer, would be rejected
with a probability of at most ``delta / chains`` were the true rate ``alpha`` or more: the exact
one-sided binomial (Clopper-Pearson) bound.  Steps are tested from mild to strict up to the first
failure, so only the paths, of which there are ``chains``, need Bonferroni's correction.  With
probability ``1 - delta``, in no stratum do all rules together reject more than ``alpha`` of the
good documents.

A holdout that is too small to certify even a step that rejects nothing says nothing of its
stratum, and that stratum takes the cutoffs of the parent, the path of all documents: the bound
then holds for good documents at large.  Without cutoffs there either, documents are kept.

A stratum may hold any share of the rows: only counts are grouped by it.  Null strata are one
stratum; null labels and doc_ids teach nothing; rows that repeat a doc_id are measured each, and
of its labels the best counts; null and empty texts have no words; without documents there are no
rows, and without labels no cutoffs.  Other columns of the documents are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fingerprints import bind
from .shared import stage, words_of

SYMBOLS = "#*$%&|<>"
#: The first part of the good labels is one in so many.
PARTS = 5
#: Steps from mild to strict: a quantile in thousandths, how many times its distance from the median it is moved up, and how far besides.
STEPS = [(1000, 4, 300), (1000, 2, 150), (1000, 1, 75), (1000, 0, 40), (1000, 0, 0), (999, 0, 0), (998, 0, 0)]


def repeated_words(words: Column, run: int = 5) -> Column:
    """Words in runs that the text holds twice or more, the first included."""

    def covered(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.size(h) - run), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(run)]))
        return F.when(F.size(h) < run, F.lit(0)).otherwise(bind(runs, among))

    def among(r: Column) -> Column:
        # The hashes in order with their places; equal neighbours are repeats.
        ordered = F.array_sort(F.transform(r, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(r)) == F.size(r), F.lit(0)).otherwise(bind(ordered, places))

    def places(s: Column) -> Column:
        def twin(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

        return bind(F.array_sort(F.transform(F.filter(s, twin), lambda x: x["i"])), length)

    def length(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(run)), F.lit(run)))
        return F.aggregate(gaps, F.lit(0), lambda t, x: t + x)

    return bind(F.transform(words, lambda w: F.xxhash64(w)), covered)


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        chars = F.aggregate(w, F.lit(0).cast("long"), lambda t, x: t + F.length(x))
        return F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words"))

    twice = bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    rows = docs.select("doc_id", F.col(stratum).cast("string").alias("stratum"), bind(words_of(F.col("text")), of_words).alias("_w"), symbols.cast("long").alias("n_symbols"), twice.cast("long").alias("n_dup_lines"), F.size(F.split(text, "\n")).alias("n_lines"))
    return rows.select("doc_id", "stratum", "_w.n_words", "_w.word_chars", "n_symbols", "n_dup_lines", "_w.n_repeat_words", "n_lines")


def rule_values() -> dict[str, Column]:
    """The measure of each rule as a long; larger is worse."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    share = lambda part, whole: F.floor(1000 * F.col(part) / whole).cast("long")
    length = F.floor(100 * F.col("word_chars") / words).cast("long")
    return {
        "symbols": share("n_symbols", words),
        "dup_lines": share("n_dup_lines", lines),
        "repeats": share("n_repeat_words", words),
        "long_words": length,
        "short_words": -length,
    }


def _log_factorial(x: Column) -> Column:
    """By Stirling's series beyond 32, exactly below."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(33)])
    y = F.greatest(x, F.lit(33)).cast("double")
    series = (y + 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * F.pow(y, 3)) + 1 / (1260 * F.pow(y, 5))
    return F.when(x <= 32, F.get(small, x.cast("int"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X of n trials of chance p; 1 from the mean up.

    Terms are summed down from the largest.  Below the mean the m-th is at most exp(-m * (m - 1) / 2k)
    of the first, so those after the first 12 sqrt(k) + 40 are under 1e-30 of the sum together and
    change no digit of it.
    """
    k, n = k.cast("long"), n.cast("long")
    top = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p))
    odds = (1 - p) / p
    last = F.least(k - 1, (12 * F.sqrt(k)).cast("long") + 40)
    sums = F.aggregate(
        F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("all")),
        lambda s, i: bind(s["term"] * (k - i) / (n - k + i + 1) * odds, lambda t: F.struct(t.alias("term"), (s["all"] + t).alias("all"))),
        lambda s: s["all"],
    )
    return F.when(k >= n * p, 1.0).when(k == 0, F.exp(n * math.log1p(-p))).otherwise(F.least(F.lit(1.0), top * sums * (1 + 1e-9)))


def in_first_part(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % PARTS == 0


def placed(known: DataFrame) -> DataFrame:
    """(stratum, parent, rule, value) of the first part -> stratum, parent, rule, cuts: an array in the order of STEPS."""
    group = ["stratum", "parent", "rule"]
    bins = known.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*group).orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*group)))
    wanted = sorted({500, *(q for q, _, _ in STEPS)})
    found = ranked.groupBy(*group).agg(*[F.min(F.when(1000 * F.col("upto") >= q * F.col("all"), F.col("value"))).alias(f"q{q}") for q in wanted])
    cuts = F.array(*[F.col(f"q{q}") + m * (F.col(f"q{q}") - F.col("q500")) + more for q, m, more in STEPS])
    return found.select(*group, cuts.alias("cuts"))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum, parent (one row has true), step, held (good documents in the holdout), cuts: a struct of each rule's cutoff at the strictest certified step.

    Strata whose holdout could certify a step but did not have a null step and no cuts, and strata
    with too small a holdout no row.
    """
    good = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality > 0").select("doc_id")
    values = F.create_map(*[x for rule, value in rule_values().items() for x in (F.lit(rule), value)])
    both = F.array(F.struct(F.col("stratum").alias("stratum"), F.lit(False).alias("parent")), F.struct(F.lit(None).cast("string").alias("stratum"), F.lit(True).alias("parent")))
    known = stage(measured.join(good, "doc_id").select(in_first_part(F.col("doc_id")).alias("first"), both.alias("b"), values.alias("values")).select("first", F.inline("b"), "values"), "known")
    cuts = placed(known.where("first").select("stratum", "parent", F.explode("values").alias("rule", "value")))
    paths = cuts.groupBy(F.col("stratum").alias("_s"), F.col("parent").alias("_p")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cuts"))).alias("cuts"))
    held = known.where("NOT first").join(paths, F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("parent") == F.col("_p")))
    # the step at which some rule first rejects the document, and one more than there are if none does
    passed = lambda rule: F.size(F.filter(F.col("cuts")[rule], lambda c: F.col("values")[rule] <= c))
    first = F.least(*map(passed, rule_values()))
    counts = held.select("stratum", "parent", first.alias("lost")).groupBy("stratum", "parent", "lost").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.groupBy("stratum", "parent").agg(F.sum("n").alias("held"), *[F.sum(F.when(F.col("lost") <= i, F.col("n")).otherwise(0)).alias(f"l{i}") for i in range(len(STEPS))])
    wide = wide.withColumn("chains", F.count(F.lit(1)).over(Window.partitionBy()))
    wide = wide.where(F.exp(F.col("held") * math.log1p(-alpha)) * F.col("chains") <= delta)
    passes = F.array(*[binomial_tail(F.col(f"l{i}"), F.col("held"), alpha) * F.col("chains") <= delta for i in range(len(STEPS))])
    failed = F.array_position(passes, F.lit(False))
    certified = F.when(failed == 0, F.lit(len(STEPS))).otherwise(failed - 1).cast("int")
    told = wide.select("stratum", "parent", "held", F.nullif(certified - 1, F.lit(-1)).alias("step"))
    out = told.join(paths, F.col("stratum").eqNullSafe(F.col("_s")) & (F.col("parent") == F.col("_p")))
    chosen = F.struct(*[F.get(F.col("cuts")[rule], F.col("step")).alias(rule) for rule in rule_values()])
    return out.select("stratum", "parent", "step", "held", F.when(F.col("step").isNotNull(), chosen).alias("cuts"))


def judge(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured -> the same with rejected: whether some rule's cutoff, of its stratum or else of the parent, is exceeded."""
    own = cuts.where("NOT parent").select(F.col("stratum").alias("_qm_s"), F.lit(True).alias("told"), "cuts")
    strata = measured.select("stratum").distinct().join(own, F.col("stratum").eqNullSafe(F.col("_qm_s")), "left").select("stratum", F.lit(False).alias("parent"), F.coalesce("told", F.lit(False)).alias("told"), "cuts")
    # a row a stratum, and the parent's
    every = strata.unionByName(cuts.where("parent").select("stratum", "parent", F.lit(True).alias("told"), "cuts"))
    top = F.max(F.when(F.col("parent"), F.col("cuts"))).over(Window.partitionBy())
    every = every.withColumn("top", top).where("NOT parent").select(F.col("stratum").alias("_qm_s"), F.when(F.col("told"), F.col("cuts")).otherwise(F.col("top")).alias("_qm_cuts"))
    failed = F.lit(False)
    for rule, value in rule_values().items():
        failed = failed | F.coalesce(value > F.col(f"_qm_cuts.{rule}"), F.lit(False))
    return measured.join(every, F.col("stratum").eqNullSafe(F.col("_qm_s")), "left").withColumn("rejected", failed).drop("_qm_s", "_qm_cuts")


def quality(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05, among: Column | None = None) -> DataFrame:
    """The measures of each document, and rejected.

    Where other rules have judged before, ``among`` (on the measures) tells the documents that they
    let pass: cutoffs are learnt from these, and the bound is on the good ones of them.
    """
    measured = stage(measures(docs, stratum), "measures")
    return judge(measured, stage(cutoffs(measured if among is None else measured.where(among), labels, alpha, delta), "cutoffs"))
