"""Genes and transcripts of variants, and labels of known causes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions.keys import bare_contig, change_of, transcript_of, unversioned, variant_key
from varloom.functions.values import yes
from varloom.operators.ranks import best_rows


def coding_only(scores: DataFrame, genes: DataFrame, gene: str = "geneSymbol", name: str = "gene_name", kind: str = "gene_type") -> DataFrame:
    return scores.join(genes.filter(F.col(kind) == "protein_coding").select(F.col(name).alias(gene)).distinct(), gene, "left_semi")


def with_transcript(scores: DataFrame, mane: DataFrame) -> DataFrame:
    """Adds transcript_id, HGVSc_core, is_mane and transcript_score: 4 for MANE, 2 for a protein change, 1 for a coding change.

    A missing change counts as one, only - does not.
    """
    known = mane.select(unversioned(F.col("transcript_id")).alias("transcript_id")).distinct().withColumn("is_mane", F.lit(True))
    df = scores.withColumn("transcript_id", transcript_of(F.col("HGVSc"))).withColumn("HGVSc_core", change_of(F.col("HGVSc")))
    df = df.join(known, "transcript_id", "left").withColumn("is_mane", yes(F.col("is_mane")))
    has = lambda c: F.coalesce(F.col(c) != "-", F.lit(True)).cast("int")
    return df.withColumn("transcript_score", 4 * F.col("is_mane").cast("int") + 2 * has("HGVSp") + has("HGVSc"))


def best_transcript(df: DataFrame, by: list[str]) -> DataFrame:
    """One row per variant and gene: highest score, then smallest changes."""
    return best_rows(df, by, [F.desc("transcript_score"), F.col("HGVSc").asc_nulls_first(), F.col("HGVSp").asc_nulls_first()])


def truth_keys(truth: DataFrame) -> DataFrame:
    """(sample_id, varId) of known causes; a chr prefix goes where there is one."""
    key = variant_key(bare_contig(F.col("chr")), F.col("pos"), F.col("ref"), F.col("alt"))
    return truth.select(F.col("SampleID").alias("sample_id"), key.alias("varId")).distinct()


def with_causal(df: DataFrame, causes: DataFrame, by: list[str], name: str = "is_causal") -> DataFrame:
    """Adds 1 where the key is among the causes, else 0."""
    return df.join(causes.select(*by).distinct().withColumn(name, F.lit(1)), by, "left").withColumn(name, F.coalesce(name, F.lit(0)))
