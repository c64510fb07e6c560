"""Quality rules with risk-controlled thresholds (DataFrame functions only).

Every text gets exact counts (words, symbols, repeated lines, words inside
repeated 5-word windows). A fixed base test fails hopeless texts. Beyond it,
each rule scores a text in per mille and a labelled holdout chooses the
cutoffs:

* strata are languages (a null language is a stratum of its own, ``''``);
* the *level* of a score is the share, in per mille, of the stratum's documents
  with this score or a higher one under the same rule; a text's level is the
  least of its rules'. Rejecting all texts of a level up to ``t`` gives one
  ladder of joint cutoffs per stratum, from the most lenient (``t`` = 1) on.
  Levels come from all documents and no labels, so labels cannot bend the
  order of tests;
* rejecting up to level ``t`` falsely rejects k of the stratum's n good
  labelled texts; ``t`` is *admissible* if the exact binomial tail
  ``P(Bin(n, alpha) <= k)`` is at most ``delta / strata``. Tests go up the
  ladder, where the tail only grows (fixed-sequence testing), so Bonferroni
  over strata holds the family-wise error: with probability 1 - delta every
  stratum loses at most ``alpha`` of its good texts that pass the base test
  (the base test itself is fixed and not calibrated);
* of the admissible levels the one that rejects most bad minus good labelled
  texts is taken (ties: the most lenient), if it rejects more bad than good. A
  stratum needs ``(1 - alpha) ** n <= delta / strata`` (217 good labels with
  four strata); with fewer no level is admissible and nothing is rejected.

Defined cases: a null text has no words; a null doc_id is scored and never
joins a label; repeated rows are scored each; a label is good if the smallest
non-null quality of its doc_id is 1 or more, bad if it is 0; null qualities
are ignored; empty labels disable the rules; empty documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolgauge.llm.common import ASCII_SPACE, cut, let, text_key

ALPHA = 0.02
DELTA = 0.05
RULES = ("symbols", "capitals", "dup_lines", "repeats")
#: A cutoff table of at most so many strata is broadcast; beyond it Spark joins as it finds best.
BROADCAST_STRATA = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    parts = F.split(F.btrim(text, F.lit(ASCII_SPACE)), r"[ \t-\r]+")
    return F.when(F.length(F.btrim(text, F.lit(ASCII_SPACE))) > 0, parts).otherwise(F.array().cast("array<string>"))


def _repeat_words(words: Column) -> Column:
    """Words covered by a window of 5 that occurs at least twice in the row."""

    def windows(h: Column) -> Column:
        at = lambda i, k: F.get(h, i + k)
        return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[at(i, k) for k in range(5)]))

    def covered(grams: Column) -> Column:
        by_hash = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def again(s: Column) -> Column:
            twin = lambda j, d: F.coalesce(F.get(s, j + d)["g"] == F.get(s, j)["g"], F.lit(False))
            return F.filter(s, lambda x, j: F.when(j > 0, twin(j, -1)).otherwise(F.lit(False)) | twin(j, 1))

        starts = F.sort_array(F.transform(let(by_hash, again), lambda x: x["i"]))
        zero = F.struct(F.lit(-5).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(5), p - a["last"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda a: a["n"])

    def count(grams: Column) -> Column:
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(grams, covered))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < 5, F.lit(0)).otherwise(let(let(hashes, windows), count))


def measures(text: Column) -> Column:
    """A struct of the counts of one text; one pass per count, nothing exploded."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0)
        fields = {
            "n_words": F.size(words),
            "word_chars": F.length(F.array_join(words, "")),
            "n_symbols": F.size(F.split(text, r"[#*$%&|<>]", -1)) - 1,
            "n_capitals": F.size(F.split(text, r"[\p{Lu}]", -1)) - 1,
            "n_lines": let(lines, lambda x: F.size(x)),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            "n_repeat_words": _repeat_words(words),
        }
        return F.struct(*[c.cast("long").alias(k) for k, c in fields.items()])

    return let(_words(text), of_words)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def scores(m: Column) -> dict[str, Column]:
    """Whole per mille (0 to 1000) by rule; higher is worse."""
    part = lambda a, b: F.least(F.lit(1000), F.coalesce(F.try_divide(1000 * m[a], m[b]).cast("int"), F.lit(0)))
    return {"symbols": part("n_symbols", "word_chars"), "capitals": part("n_capitals", "word_chars"), "dup_lines": part("n_dup_lines", "n_lines"), "repeats": part("n_repeat_words", "n_words")}


def scored(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, ``stratum`` and ``m`` (the counts) of every row."""
    return docs.select(*keep, F.coalesce(F.col("lang"), F.lit("")).alias("stratum"), measures(F.col("text")).alias("m"))


def _admitted(n: Column, rate: float, level: Column) -> Column:
    """The largest k with ``P(Bin(n, rate) <= k) <= level``, or -1: exact terms by their ratio, in logarithms."""
    start = F.struct((n * F.log(F.lit(1 - rate))).alias("term"), F.lit(0.0).alias("tail"), F.lit(-1).cast("long").alias("k"))

    def step(a: Column, j: Column) -> Column:
        tail = a["tail"] + F.exp(a["term"])
        term = a["term"] + F.log(F.greatest(n - j, F.lit(1e-300)) / (j + 1)) + F.log(F.lit(rate / (1 - rate)))
        return F.struct(term.alias("term"), tail.alias("tail"), F.when(tail <= level, j).otherwise(a["k"]).alias("k"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.ceil(n * rate).cast("long")), start, step, lambda a: a["k"])


def levels(measured: DataFrame) -> DataFrame:
    """stratum, rule, score and level of every score that documents passing the base test have: at most 1001 rows per stratum and rule."""
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), s.alias("score")) for r, s in scores(F.col("m")).items()]))
    bins = measured.where(~base_failed(F.col("m"))).select("stratum", each.alias("e")).groupBy("stratum", F.col("e.rule").alias("rule"), F.col("e.score").alias("score")).agg(F.count("*").alias("own"))
    whole = Window.partitionBy("stratum", "rule")
    above = F.sum("own").over(whole.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0))
    every = F.sum("own").over(whole)
    return bins.select("stratum", "rule", "score", F.expr("1000L").alias("t"), above.alias("above"), every.alias("every")).select("stratum", "rule", "score", F.expr("(t * above + every - 1) div every").alias("level"))


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum with a cutoff: ``stratum`` and the highest score that each rule lets pass.

    ``measured`` is :func:`scored` with doc_id. Documents are reduced to the
    bins of :func:`levels`, labelled ones to their different scores, before
    anything is joined or windowed.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    rows = measured.where(~base_failed(F.col("m"))).join(known, "doc_id")
    alike = rows.groupBy("stratum", *[s.alias(r) for r, s in scores(F.col("m")).items()]).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    ladder = cut(levels(measured))
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("score")) for r in RULES]))
    reached = alike.select("*", each.alias("e")).select("stratum", *RULES, "good", "bad", "e.rule", "e.score").join(ladder, ["stratum", "rule", "score"])
    bins = reached.groupBy("stratum", *RULES).agg(F.min("level").alias("level"), F.max("good").alias("good"), F.max("bad").alias("bad")).groupBy("stratum", "level").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    whole = Window.partitionBy("stratum")
    up_to = whole.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    curve = bins.select("stratum", "level", F.sum("good").over(whole).alias("n"), F.sum("good").over(up_to).alias("k"), F.sum("bad").over(up_to).alias("hit"))
    # one row per stratum
    sizes = curve.groupBy("stratum").agg(F.max("n").alias("n"))
    families = sizes.select("stratum", "n", F.count("*").over(Window.partitionBy(F.lit(1))).alias("tests"))
    most = families.select("stratum", _admitted(F.col("n"), alpha, F.lit(delta) / F.col("tests")).alias("most"))
    gain = F.struct((F.col("hit") - F.col("k")).alias("gain"), (-F.col("level")).alias("lenient"))
    best = curve.join(most, "stratum").where((F.col("k") <= F.col("most")) & (F.col("hit") > F.col("k")) & (F.col("level") < 1000)).groupBy("stratum").agg((-F.max(gain)["lenient"]).alias("up_to"))
    passing = ladder.join(best, "stratum").where(F.col("level") > F.col("up_to"))
    return passing.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("score"))).alias(r) for r in RULES])


def _limits(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    limits = cut(cutoffs(measured, labels, alpha, delta).select("stratum", F.struct(*RULES).alias("cutoff")))
    return F.broadcast(limits) if limits.count() <= BROADCAST_STRATA else limits


def verdict(m: Column, cutoff: Column) -> Column:
    """Kept: passes the base test and exceeds no cutoff."""
    over = [F.coalesce(s > cutoff[r], F.lit(False)) for r, s in scores(m).items()]
    kept = ~base_failed(m)
    for x in over:
        kept = kept & ~x
    return kept


def rate(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Counts, base test and verdict of every row of ``docs`` (doc_id, text, lang).

    The counts (a few numbers a row) are checkpointed, as the calibration and
    the verdict both read them; texts are scanned once and never shuffled.
    """
    measured = cut(scored(docs, "doc_id"))
    judged = measured.join(_limits(measured, labels, alpha, delta), "stratum", "left")
    return judged.select("doc_id", *[F.col("m")[c].alias(c) for c in COUNTS], base_failed(F.col("m")).alias("base_failed"), verdict(F.col("m"), F.col("cutoff")).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are.

    Every text is measured once: its counts are checkpointed under doc_id,
    text hash and stratum, calibrated and judged, and the rows join the keys
    of those that stay. A shuffle of the texts costs a small part of what
    measuring them again does.
    """
    names = ["k_id", "k_none", "k_th", "stratum"]
    keys = [F.coalesce(F.xxhash64("doc_id"), F.lit(0)).alias("k_id"), F.col("doc_id").isNull().alias("k_none"), text_key(F.col("text")).alias("k_th"), F.coalesce("lang", F.lit("")).alias("stratum")]
    measured = cut(docs.select("doc_id", *keys, measures(F.col("text")).alias("m")))
    judged = measured.join(_limits(measured, labels, alpha, delta), "stratum", "left").where(verdict(F.col("m"), F.col("cutoff")))
    rows = docs.select(F.struct("*").alias("row"), *keys)
    return rows.join(judged.select(*names), names, "left_semi").select("row.*")
