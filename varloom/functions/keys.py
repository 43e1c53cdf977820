"""Variant, contig, transcript and gene keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCUS = r"^chr([1-9]|1[0-9]|2[0-2]|X|Y)$"


def variant_key(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    """chrom_pos_ref_alt; null if any part is."""
    parts = [c.cast("string") for c in (chrom, pos, ref, alt)]
    return F.concat(parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2], F.lit("_"), parts[3])


def key_parts(key: Column) -> dict[str, Column]:
    """chrom, pos (null where not a number), ref and alt of a variant key."""
    p = F.split(F.trim(key), "_", 4)
    return {"chrom": F.get(p, 0), "pos": F.get(p, 1).try_cast("double").try_cast("long"), "ref": F.get(p, 2), "alt": F.get(p, 3)}


def bare_contig(c: Column) -> Column:
    """Without a chr prefix; M is MT."""
    x = F.regexp_replace(c, "^chr", "")
    return F.when(x == "M", "MT").otherwise(x)


def coded_contig(c: Column) -> Column:
    """Without a prefix in any case; X and Y are 23 and 24."""
    x = F.regexp_replace(c, "(?i)^chr", "")
    return F.when(x.isin("X", "x"), "23").when(x.isin("Y", "y"), "24").otherwise(x)


def is_coded_contig(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)^chr([1-9]|1[0-9]|2[0-2]|X|Y)$") | c.rlike("^([1-9]|1[0-9]|2[0-4])$"), F.lit(False))


def locus_contig(c: Column) -> Column:
    """chr1 to chr22, chrX, chrY out of a key's chromosome."""
    x = F.when(c.isin("23", "x"), "X").when(c.isin("24", "y"), "Y").otherwise(c)
    return F.concat(F.lit("chr"), x)


def is_locus(contig: Column, pos: Column) -> Column:
    return F.coalesce(contig.rlike(LOCUS), F.lit(False)) & pos.isNotNull()


def unversioned(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def transcript_of(hgvsc: Column) -> Column:
    """Text before the first colon without its version; - where missing."""
    return F.coalesce(unversioned(F.get(F.split(hgvsc, ":", 2), 0)), F.lit("-"))


def change_of(hgvsc: Column) -> Column:
    """Text after the first colon; - where missing."""
    return F.coalesce(F.get(F.split(hgvsc, ":", 2), 1), F.lit("-"))


def genes_of(c: Column) -> Column:
    return F.split(c, ";")


def pair_key(gene: Column, a: Column, b: Column, sample: Column) -> Column:
    """One name for a pair of variants of a gene, whichever comes first."""
    return F.concat_ws("|", sample, F.upper(gene), F.lit("CH"), F.least(a, b), F.greatest(a, b))


def entity_key(c: Column) -> tuple[Column, Column]:
    """Gene and variant of gene_VarId_variant."""
    p = F.split(c, "_VarId_", 2)
    return F.get(p, 0), F.get(p, 1)
