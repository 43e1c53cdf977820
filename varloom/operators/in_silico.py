"""Worst in-silico scores of a variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.values import number, yes

# Scores that are worse when lower, and the one whose direction the data tell.
LOW_IS_WORSE = ("SIFT_score", "LRT_score", "LRT_Omega")
BY_SIGN = "FATHMM_score"


def worst(value: str, low: bool) -> Column:
    """Aggregate: smallest or largest finite value."""
    x = number(F.col(value))
    return F.min(x) if low else F.max(x)


def sign_table(features: DataFrame, candidates: DataFrame, sample: str = "sample_id", key: str = "varId", value: str = BY_SIGN) -> DataFrame:
    """Per sample whether any value of its candidates is negative, so that low is worse there, and the least of their worst values."""
    x = number(F.col(value))
    per = features.groupBy(sample, key).agg(F.min(x).alias("lo"), F.max(x).alias("hi")).join(candidates.select(sample, key).distinct(), [sample, key], "left_semi")
    low = yes(F.min("lo") < 0)
    return per.groupBy(sample).agg(low.alias("low"), F.when(low, F.min("lo")).otherwise(F.min("hi")).alias("least"))


def any_positive(*values: str) -> Column:
    """Aggregate: 1 if any value of any column is above 0."""
    hit = F.lit(False)
    for v in values:
        hit = hit | yes(number(F.col(v)) > 0)
    return F.max(hit.cast("int"))


def worst_scores(features: DataFrame, candidates: DataFrame, scores: list[str], sample: str = "sample_id", key: str = "varId", signs: DataFrame | None = None) -> DataFrame:
    """One row per candidate variant: worst score per column, splice and frameshift flags, CADD_worst.

    Features become a row per variant first, with both ends of the score whose direction the
    sample tells; a row per sample then chooses, and no task holds a sample. signs are those of sign_table(), if at hand.
    """
    aggs = [worst(c, c in LOW_IS_WORSE).alias(c) for c in scores]
    if BY_SIGN in scores:
        aggs.append(worst(BY_SIGN, True).alias("__lo"))
    if "cons_splice_acceptor_variant" in features.columns:
        aggs.append(any_positive("cons_splice_acceptor_variant", "cons_splice_donor_variant").alias("is_splice"))
    if "cons_frameshift_variant" in features.columns:
        aggs.append(any_positive("cons_frameshift_variant").alias("is_frameshift"))
    out = features.groupBy(sample, key).agg(*aggs).join(candidates.select(sample, key).distinct(), [sample, key], "left_semi")
    if BY_SIGN in scores:
        signs = signs if signs is not None else sign_table(features, candidates, sample, key)
        out = out.join(signs.select(sample, "low"), sample).withColumn(BY_SIGN, F.when(F.col("low"), F.col("__lo")).otherwise(F.col(BY_SIGN))).drop("low", "__lo")
    return out.withColumn("CADD_worst", F.greatest("CADD_phred", "CADD_PHRED_raw")) if {"CADD_phred", "CADD_PHRED_raw"} <= set(out.columns) else out
