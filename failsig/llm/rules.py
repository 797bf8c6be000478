"""Operator 3: quality rules whose cutoffs are certified on labelled holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scale import frozen
from .common import SPACES, fold_of, let, text_of, words

BANDS = (100, 1000)  # words; the strata are the lengths below, between and from these
LIMIT = 0.02  # of the good texts of a stratum, rejected at most
CONFIDENCE = 0.95  # that the limit holds in every stratum at once
# quantiles of good texts that are tried as cutoffs: lower ones than 1 - LIMIT / rules can't be certified
LEVELS = (*(round(0.996 + 0.0002 * i, 4) for i in range(20)), 1.0)
TERMS = 1024  # of a binomial tail that are added up; what lies beyond is bounded

#: each rule rejects texts whose figure is above its cutoff
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
}


def _removed(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def repeated_words(found: Column) -> Column:
    """Words within 3-word windows that occur twice or more in ``found``.

    Windows are sorted by hash, so equal ones are neighbours; no window is compared with all
    others. A 64-bit hash tells the windows of one text apart.
    """
    last = F.size(found) - 2
    windows = F.transform(
        F.sequence(F.lit(1), last),
        lambda i: F.struct(
            F.xxhash64(F.get(found, i - 1), F.get(found, i), F.get(found, i + 1)).alias("h"),
            i.alias("at"),
        ),
    )

    def again(s: Column) -> Column:
        return F.filter(
            s,
            lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]),
        )

    covered = F.flatten(
        F.transform(
            let(F.sort_array(windows), again),
            lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2),
        )
    )
    return F.when(last >= 1, F.size(F.array_distinct(covered))).otherwise(0)


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts of each row's whole text; null texts count as empty."""
    text = text_of()
    tokens = docs.select("doc_id", text.alias("body"), words(text, SPACES).alias("w"))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return tokens.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        _removed(F.col("body"), r"[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        .cast("long")
        .alias("n_dup_lines"),
        repeated_words(F.col("w")).cast("long").alias("n_repeat_words"),
        _removed(F.col("body"), "[A-Z]").alias("n_capitals"),
        _removed(F.col("body"), r"\|").alias("n_bars"),
        F.size(lines).cast("long").alias("n_lines"),
    )


def _stratum() -> Column:
    return sum((F.col("n_words") >= b).cast("int") for b in BANDS)


def _log_factorial(n: Column) -> Column:
    """ln(n!), by table up to 20 and by Stirling's series, good to 12 digits, above."""
    x = n.cast("double")
    series = (
        x * F.log(x) - x + F.log(2 * F.pi() * x) / 2
        + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    )
    return F.when(n > 20, series).otherwise(F.log(F.factorial(F.least(n, F.lit(20)).cast("int"))))


def _base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X of n trials at ``p``.

    The terms are added from the k-th down, each from the one above. With up to ``TERMS`` of them
    the sum is exact; the others shrink at least as fast as the last that was added, so a
    geometric series bounds them and the tail is never stated too small. The work doesn't grow
    with n or k.
    """
    odds = (1 - p) / p
    top = (
        _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
        + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    )

    def shrink(j: Column) -> Column:
        """The (k-j-1)-th term over the (k-j)-th."""
        return (k - j) / (n - k + j + 1) * odds

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] * shrink(j)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    last = F.lit(TERMS - 1).cast("long")
    rest = shrink(last)

    def closed(acc: Column) -> Column:
        beyond = F.when(rest < 1, acc["term"] * rest / (1 - rest)).otherwise(float("inf"))
        return acc["total"] + F.when(k > last, beyond).otherwise(0.0)

    below = F.sequence(F.lit(0).cast("long"), F.least(k - 1, last - 1))
    sums = F.when(k >= 1, F.aggregate(below, start, step, closed)).otherwise(1.0)
    return F.when(k >= n, 1.0).otherwise(F.least(F.lit(1.0), F.exp(top) * sums))


def cutoffs(figures: DataFrame, labels: DataFrame) -> DataFrame:
    """``stratum`` and a certified cutoff for each rule, null where none could be certified.

    Only texts that pass the base rules count, as the others are rejected anyway. A quarter of the
    labelled texts, by a hash of the id, proposes: quantiles of its good texts are the cutoffs tried for each stratum and rule. On the other three quarters a proposal is
    accepted only if its false rejections would be this few with small probability were its true
    rate above the rule's share of ``LIMIT``: an exact binomial test at level (1 - CONFIDENCE) /
    (strata * rules), Bonferroni's correction. The cutoffs of one stratum and rule are tested
    from the highest down and the first failure ends that, a fixed sequence, which needs no
    correction of its own. Of those accepted the lowest that rejects a larger share of the bad texts
    than of the good ones stands; a rule without one rejects nothing. The rules'
    shares add up to ``LIMIT``, so that bounds the false rejections of all rules together. There
    are as many rows as strata, whatever the input.
    """
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.max("quality").alias("quality")
    )
    rows = (
        figures.filter(~_base_failed())
        .select("doc_id", _stratum().alias("stratum"), *[
            F.expr(e).alias(r) for r, e in RULES.items()
        ])
        .join(marks, "doc_id")
        .withColumn("fold", fold_of(4))
    )
    pairs = ", ".join(f"'{r}', {r}" for r in RULES)
    long = rows.select(
        "stratum", "quality", "fold", F.expr(f"stack({len(RULES)}, {pairs}) as (rule, figure)")
    )
    good = F.col("quality") > 0
    proposed = (
        long.filter(good & (F.col("fold") == 0))
        .groupBy("stratum", "rule")
        .agg(F.percentile_approx("figure", list(LEVELS), 100_000).alias("levels"))
        .select("stratum", "rule", F.explode("levels").alias("cutoff"))
        .distinct()
    )
    over = F.col("figure") > F.col("cutoff")
    tests = (
        long.filter(F.col("fold") > 0)
        .join(F.broadcast(proposed), ["stratum", "rule"])  # at most strata * rules * levels rows
        .groupBy("stratum", "rule", "cutoff")
        .agg(
            F.count_if(good).alias("n"),
            F.count_if(good & over).alias("false"),
            F.count_if(~good).alias("bad"),
            F.count_if(~good & over).alias("true"),
        )
    )
    level = (1 - CONFIDENCE) / ((len(BANDS) + 1) * len(RULES))
    passed = (F.col("n") > 0) & (
        binomial_tail(F.col("n"), F.col("false"), LIMIT / len(RULES)) <= level
    )
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    return (
        tests.withColumn("safe", F.min(passed).over(down))
        .filter(F.col("safe") & (F.col("true") * F.col("n") > F.col("false") * F.col("bad")))
        .groupBy("stratum")
        .pivot("rule", list(RULES))
        .agg(F.min("cutoff"))
    )


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of each row with ``base_failed``, ``reasons`` and ``kept``.

    A text fails the base rules with under 50 words or if more than half of its words repeat;
    empty and null texts fail so. Without enough labels to certify a cutoff, a rule rejects
    nothing in that stratum. Repeated rows stay.
    """
    figures = frozen(measured(docs))
    limits = cutoffs(figures, labels).select(
        F.col("stratum").alias("of"), *[F.col(r).alias(f"most_{r}") for r in RULES]
    )
    reasons = F.array_compact(
        F.array(
            *[F.when(F.expr(e) > F.col(f"most_{r}"), F.lit(r)) for r, e in RULES.items()]
        )
    )
    return (
        figures.join(F.broadcast(limits), _stratum() == F.col("of"), "left")
        .withColumn("reasons", reasons)
        .withColumn("base_failed", _base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.size("reasons") == 0))
        .drop("of", *[f"most_{r}" for r in RULES])
    )
