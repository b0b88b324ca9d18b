"""Corpus BLEU: counts per row, sums per group, score of the sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenry.functions.arrays import let

# Weights of BLEU-1 to BLEU-4 and the constant of the smoothing.
WEIGHTS = {1: (1.0, 0.0, 0.0, 0.0), 2: (0.5, 0.5, 0.0, 0.0), 3: (0.34, 0.33, 0.33, 0.0), 4: (0.25, 0.25, 0.25, 0.25)}
SMOOTHING = 5.0


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by blanks; none if there are fewer tokens."""
    empty = F.array().cast("array<string>")
    runs = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(empty)


def _clipped(hyp: Column, ref: Column) -> Column:
    def of(g: Column) -> Column:
        return F.least(F.size(F.filter(hyp, lambda x: x == g)), F.size(F.filter(ref, lambda x: x == g)))

    return F.aggregate(F.array_intersect(hyp, ref), F.lit(0), lambda a, g: a + of(g))


def row_counts(pairs: DataFrame, hyp: str = "hyp", ref: str = "ref") -> DataFrame:
    """``pairs`` with matches ``m1..m4``, totals ``t1..t4`` and lengths; token arrays in, narrow."""
    out = pairs.withColumn("hyp_len", F.size(hyp)).withColumn("ref_len", F.size(ref))
    for n in range(1, 5):
        both = F.struct(ngrams(F.col(hyp), n).alias("h"), ngrams(F.col(ref), n).alias("r"))
        out = out.withColumn(f"m{n}", let(both, lambda s: _clipped(s["h"], s["r"])))
        out = out.withColumn(f"t{n}", F.greatest(F.lit(0), F.col("hyp_len") - (n - 1)))
    return out


def summed(counts: DataFrame, *keys: str) -> DataFrame:
    """The counts summed over each group: one small shuffle."""
    names = [f"{c}{n}" for n in range(1, 5) for c in "mt"] + ["hyp_len", "ref_len"]
    return counts.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in names))


def score(n: int) -> Column:
    """BLEU-``n`` in percent, not rounded, of summed counts.

    A count of matches of zero is smoothed, before division, to
    ``1 / (2^k 5 / ln(length))``, k counting such orders; without a matching
    word the score is 0. The brevity penalty holds up to equal length.
    """
    hyp, ref = F.col("hyp_len").cast("double"), F.col("ref_len").cast("double")
    zeros, logs = F.lit(0), F.lit(0.0)
    for order, weight in enumerate(WEIGHTS[n], 1):
        m, t = F.col(f"m{order}").cast("double"), F.greatest(F.lit(1), F.col(f"t{order}")).cast("double")
        zero = m == 0
        zeros = zeros + F.when(zero, 1).otherwise(0)
        smooth = F.when(hyp > 1, 1.0 / (F.pow(F.lit(2.0), zeros) * SMOOTHING / F.log(hyp)))
        p = F.when(zero, smooth).otherwise(m) / t
        if weight:
            logs = logs + F.coalesce(weight * F.log(p), F.lit(0.0))
    penalty = F.when(hyp > ref, 1.0).when(hyp == 0, 0.0).otherwise(F.exp(1 - ref / hyp))
    return F.when(F.col("m1") == 0, 0.0).otherwise(100 * penalty * F.exp(logs))


def overall(counts: DataFrame, *keys: str) -> DataFrame:
    """BLEU-1 to BLEU-4, two decimals (ties to even), per group of ``keys``."""
    return summed(counts, *keys).select(*keys, *(F.bround(score(n), 2).alias(f"bleu_{n}") for n in range(1, 5)))


def by_style(counts: DataFrame, *keys: str) -> DataFrame:
    """BLEU-4 per group of ``keys`` and style; styles without a hypothesis have no row."""
    return summed(counts, *keys, "emotion").select(*keys, "emotion", F.bround(score(4), 2).alias("bleu_4"))


def best_model(table: DataFrame) -> DataFrame:
    """The model of the highest BLEU-4, the first by ``model_ord`` of equal ones."""
    return table.orderBy(F.desc("bleu_4"), "model_ord").limit(1)
