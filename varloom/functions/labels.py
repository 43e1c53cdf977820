"""Verdict labels, frequencies and the criterion votes built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from varloom.functions.values import number

# What a label counts.
PHENOTYPE = {"not fit": 0.0, "partial fit": 1.0, "good fit": 2.0, "strong": 3.0}
DATABASE = {"against": 0.0, "neutral": 1.0, "supporting": 2.0, "convincing": 3.0}
RNA = {"strong rna evidence": 2.0, "weak rna evidence": 1.0}
IN_SILICO = {"weak": 1.0, "moderate": 2.0, "strong": 3.0}

# Share of patients that a frequency term stands for.
FREQUENCY_TERMS = {"HP:0040280": 1.0, "HP:0040281": 0.90, "HP:0040282": 0.55, "HP:0040283": 0.17, "HP:0040284": 0.025, "HP:0040285": 0.0}


def label(c: Column) -> Column:
    """Lower case, separators as single spaces, synonyms as one; empty where missing."""
    s = F.trim(F.regexp_replace(F.translate(F.lower(F.trim(c)), "_-", "  "), r"\s+", " "))
    s = (
        F.when(s.isin("not fit", "no fit"), "not fit")
        .when(s.isin("partial fit", "partially fit", "partial"), "partial fit")
        .when(s.isin("good fit", "good"), "good fit")
        .when(s.isin("stand alone strong evidence", "standalone strong evidence", "strong evidence", "strong"), "strong")
        .otherwise(s)
    )
    return F.coalesce(s, F.lit(""))


def points(c: Column, scale: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, value in scale.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def rna_label(gene: Column, variant: Column) -> Column:
    """The better of the gene-level and the variant-level label; the gene wins ties, none if neither counts."""
    g, v = label(gene), label(variant)
    pg, pv = points(g, RNA), points(v, RNA)
    return F.when(pv > pg, v).when(pg > 0, g).otherwise("")


def in_silico_points(conclusion: Column, rank: Column, top: int = 100) -> Column:
    return F.when(number(rank) <= top, points(label(conclusion), IN_SILICO)).otherwise(0.0)


def vote(a: Column, b: Column, low_wins: bool = False) -> Column:
    """A, B or tie; a missing value loses to any other."""
    better = (a < b) if low_wins else (a > b)
    worse = (b < a) if low_wins else (b > a)
    return F.when(a.isNull() & b.isNull(), "tie").when(a.isNull(), "B").when(b.isNull(), "A").when(better, "A").when(worse, "B").otherwise("tie")


def ratio_side(ref: Column, alt: Column, enough: float = 50) -> Column:
    """1 or -1 for an allele ratio above 1.2 or below 0.8 with enough reads on both sides, else 0."""
    fair = (ref >= enough) & (alt >= enough)
    return F.coalesce(F.when(fair & (F.try_divide(ref, alt) > 1.2), 1).when(fair & (F.try_divide(ref, alt) < 0.8), -1), F.lit(0))


def frequency(c: Column) -> Column:
    """(num, den, has) of a frequency: -, a term, x% or m/n; null for anything else."""
    s = F.trim(c)
    make = lambda n, d, h: F.struct(n.cast("double").alias("num"), d.cast("double").alias("den"), F.lit(h).alias("has"))
    share = F.create_map(*[F.lit(x) for kv in FREQUENCY_TERMS.items() for x in kv])[s]
    percent = F.regexp_extract(s, r"^([0-9.]+)%$", 1).try_cast("double")
    num, den = F.regexp_extract(s, r"^([0-9]+)/([0-9]+)$", 1).try_cast("double"), F.regexp_extract(s, r"^([0-9]+)/([0-9]+)$", 2).try_cast("double")
    return (
        F.when(s == "-", make(F.lit(0), F.lit(0), 0))
        .when(share.isNotNull(), make(share * 6, F.lit(6), 1))
        .when(percent.isNotNull(), make(percent / 100 * 6, F.lit(6), 1))
        .when(num.isNotNull() & den.isNotNull(), make(num, den, 1))
    )


def frequency_label(p: Column) -> Column:
    return F.when(p == 1, "Obligate").when(p == 0, "Excluded").when((p >= 0.8) & (p < 1), "Very frequent").when((p >= 0.3) & (p < 0.8), "Frequent").when((p >= 0.05) & (p < 0.3), "Occasional").otherwise("Very rare")
