"""Candidate rules and the RNA evidence they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.keys import genes_of, is_locus, key_parts, locus_contig
from varloom.functions.values import yes
from varloom.operators.ranks import joined_in_place

# Names of the rules in the order in which they are listed.
RULES = ["Strong DNA Evidence", "Strong In-Silico Evidence", "Strong Database Evidence", "Strong Genetics Evidence", "Strong RNA Evidence", "Compound Heterozygous (Compound Het)"]


def rules(rank: str = "Diagnostic_Engine_Rank", in_silico: str = "rank_InSilico", database: str = "rank_Database", genetics: str = "rank_Genetics", splice: str = "Fraser_pvaluesBetaBinomial_jaccard", expression: str = "Outrider_pValue") -> list[Column]:
    """The five rules. Splicing alone nominates; expression does so for the first hundred ranks only."""
    top = yes(F.col(rank) <= 100)
    expert = [yes(F.col(c) <= 10) & top for c in (in_silico, database, genetics)]
    return [yes(F.col(rank) <= 20), *expert, yes(F.col(splice) < 1e-5) | (yes(F.col(expression) < 1e-5) & top)]


def nominated(df: DataFrame, hits: list[Column], gene: str = "geneSymbol", key: str = "varId", sample: str = "sample_id", recessive: str = "recessive") -> DataFrame:
    """Rows that a rule hits and all rows of a gene with a recessive hit, with evidence_rules and is_compound_het_group.

    A gene is a compound group when it has a variant that a rule hits and another that none
    does. The placeholder gene - has no candidates.
    """
    names = [f"__r{i}" for i in range(len(hits))]
    df = df.withColumns(dict(zip(names, hits)))
    hit = F.greatest(*names)
    df = df.withColumn("__hit", hit)
    # a variant counts with its first row, a hit if it has one; rows are dealt by gene and never joined back
    variant, of_gene = Window.partitionBy(sample, gene, key).orderBy(F.desc("__hit")), Window.partitionBy(sample, gene)
    named = F.col(sample).isNotNull() & F.col(gene).isNotNull()
    df = df.withColumn("__first", named & F.col(key).isNotNull() & (F.row_number().over(variant) == 1))
    df = df.withColumns({
        "__total": F.count(F.when(F.col("__first"), 1)).over(of_gene),
        "__strong": F.count(F.when(F.col("__first") & F.col("__hit"), 1)).over(of_gene),
        "__rescue": F.max(named & F.col("__hit") & yes(F.col(recessive) == 1)).over(of_gene),
    }).drop("__first")
    group = yes((F.col("__strong") >= 1) & (F.col("__total") - F.col("__strong") >= 1))
    label = F.concat_ws(", ", *[F.when(F.col(n), F.lit(r)) for n, r in zip(names, RULES)], F.when(F.col("is_compound_het_group"), F.lit(RULES[-1])))
    df = df.withColumn("is_compound_het_group", group).withColumn("evidence_rules", label)
    return df.filter((F.col("__hit") | yes(F.col("__rescue"))) & (F.col(gene) != "-")).drop(*names, "__hit", "__total", "__strong", "__rescue")


def located(df: DataFrame, key: str = "varId") -> DataFrame:
    """Adds Chromosome, Pos, Start and End; rows without a valid place go."""
    p = key_parts(F.col(key))
    df = df.withColumn("Chromosome", locus_contig(p["chrom"])).withColumn("Pos", p["pos"])
    return df.filter(is_locus(F.col("Chromosome"), F.col("Pos"))).withColumn("Start", F.col("Pos")).withColumn("End", F.col("Pos") + 1)


def min_per_name(df: DataFrame, names: str, value: str, by: list[str], name: str, out: str) -> DataFrame:
    """Smallest value per name of a ;-list (or an array); missing names have no row, missing values don't count."""
    split = genes_of(F.col(names)) if dict(df.dtypes)[names] == "string" else F.col(names)
    return df.filter(F.col(names).isNotNull()).select(*by, F.explode(split).alias(name), value).groupBy(*by, name).agg(F.min(value).alias(out))


#: Cells of a level of interval_hits() are so many times as wide as those of the level below.
GROWTH = 16


def interval_hits(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, end: str) -> DataFrame:
    """Inner join of points and spans with start <= at <= end and equal `by`.

    A span goes to the level whose cells are just as wide as it or wider, there to the cell it
    starts in and, if it leaves that one, to the next: two rows at most, however long it is.
    A point looks into its one cell of each level that has spans (of 16 at most), so no pair
    comes twice, and a long span meets no more points than lie within its own length of it.
    """
    width = F.col(end) - F.col(start) + 1
    # whole powers of a power of two, compared as whole numbers
    powers = [GROWTH**k for k in range(16) if GROWTH**k < 1 << 63]
    level = sum((F.when(width > p, 1).otherwise(0) for p in powers), F.lit(0))
    s = spans.filter(F.col(start) <= F.col(end)).withColumn("__level", level)
    used = sorted(r["__level"] for r in s.select("__level").distinct().collect())
    cell = lambda c, k: F.floor(F.col(c) / F.element_at(F.array(*[F.lit(float(p)) for p in powers]), k + 1)).cast("long")
    s = s.withColumn("__cell", F.explode(F.array_distinct(F.array(cell(start, F.col("__level")), cell(end, F.col("__level"))))))
    cells = F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(at) / float(powers[k])).cast("long").alias("cell")) for k in used]) if used else F.array().cast("array<struct<level:int,cell:bigint>>")
    p = points.withColumn("__in", F.explode(cells)).withColumn("__level", F.col("__in.level")).withColumn("__cell", F.col("__in.cell")).drop("__in")
    return p.join(s, [*by, "__level", "__cell"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("__level", "__cell")


def best_junction(variants: DataFrame, junctions: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per variant key the overlapping junction with the smallest value, then start and end; the end is reported one later.

    Cells are those of interval_hits(), but a cell's junctions come to its points as a list, by
    windows inside a sample, so that what is dealt by sample doesn't move.
    """
    place, levels = ["sample_id", "Chromosome"], [k for k in range(16) if GROWTH**k < 1 << 63]
    known = junctions.filter(F.col(value).isNotNull() & (F.col("start") <= F.col("end")))
    others = [c for c in known.columns if c not in (*by, "Chromosome", "Pos", value, "start", "end")]
    level = sum((F.when(F.col("end") - F.col("start") + 1 > GROWTH**k, 1).otherwise(0) for k in levels), F.lit(0))
    points = variants.select("sample_id", "varId", "Chromosome", "Pos").filter(F.col("sample_id").isNotNull() & F.col("Chromosome").isNotNull())
    rows = points.withColumn("__level", F.lit(None).cast("int")).unionByName(known.withColumn("__level", level), allowMissingColumns=True)
    is_point = F.col("__level").isNull()
    # a point looks into the levels that its sample's contig has
    rows = rows.withColumn("__used", F.collect_set("__level").over(Window.partitionBy(*place)))
    wide = F.array(*[F.lit(float(GROWTH**k)) for k in levels])
    cell = lambda c, k: F.struct(k.alias("level"), F.floor(F.col(c) / F.element_at(wide, k + 1)).cast("long").alias("cell"))
    cells = F.when(is_point, F.transform("__used", lambda k: cell("Pos", k))).otherwise(F.array_distinct(F.array(cell("start", F.col("__level")), cell("end", F.col("__level")))))
    rows = rows.withColumn("__at", F.explode(cells)).drop("__used")
    here = Window.partitionBy(*place, "__at.level", "__at.cell")
    # two lists that agree, so that the other columns stay behind where nobody uses them
    near = lambda *c: F.collect_list(F.when(~is_point, F.struct(value, "start", "end", *c))).over(here)
    rows = rows.withColumns({"__b": near(), "__o": near(*others)}).filter(is_point)
    inside = lambda c: F.array_min(F.filter(c, lambda x: F.col("Pos").between(x["start"], x["end"])))
    best = rows.groupBy(*by).agg(F.min(inside("__b")).alias("b"), F.min(inside("__o")).alias("o")).filter(F.col("b").isNotNull()).select(*by, "b.*", *[F.col(f"o.{c}").alias(c) for c in others])
    return best.withColumnRenamed("start", "Fraser_junction_start").withColumn("Fraser_junction_end", F.col("end") + 1).drop("end")


def enriched(df: DataFrame, expression: DataFrame, splicing: DataFrame, ase: DataFrame) -> DataFrame:
    """Left joins of expression by gene, splicing by gene and by place, and allele counts by variant.

    Tables that are dealt by sample, to as many tasks each, stay where they are; others move.
    """
    p = "pvaluesBetaBinomial_jaccard"
    exp = expression.withColumnsRenamed({"sampleID": "sample_id", "GeneSymbol": "geneSymbol", "pValue": "Outrider_pValue", "padjust": "Outrider_padjust", "zScore": "Outrider_zScore", "l2fc": "Outrider_l2f", "rawcounts": "Outrider_rawcounts", "RawZscore": "Outrider_RawZscore"})
    if "Outrider_RawZscore" not in exp.columns:
        exp = exp.withColumn("Outrider_RawZscore", F.lit(None).cast("double"))
    spl = splicing.withColumnsRenamed({"sampleID": "sample_id", "seqnames": "Chromosome"}).filter(F.col("hgnc_symbol").isNotNull())
    genes = min_per_name(spl, "hgnc_symbol", p, ["sample_id"], "geneSymbol", "Fraser_GenePvalue")
    values = [c for c in spl.columns if c not in ("sample_id", "Chromosome", "start", "end", "strand", "hgnc_symbol")]
    df = located(df)
    best = best_junction(df.select("sample_id", "varId", "Chromosome", "Pos"), spl.drop("strand", "hgnc_symbol"), ["sample_id", "varId"], p).withColumnsRenamed({c: f"Fraser_{c}" for c in values})
    counts = ase.select(F.col("sampleID").alias("sample_id"), "varId", *[F.col(c).alias(n) for c, n in {"REF": "ASE_REF", "ALT": "ASE_ALT", "REF_COUNT": "ASE_REF_COUNT", "ALT_COUNT": "ASE_ALT_COUNT", "ALT_RATIO": "ASE_ALT_RATIO", "PVAL": "ASE_PVAL", "IS_MAE": "IS_MAE"}.items()])
    # windows inside a sample, so that rows stay where they are
    df = joined_in_place(df, [best, counts], ["sample_id", "varId"])
    return joined_in_place(df, [exp, genes], ["sample_id", "geneSymbol"])
