"""RNA evidence: gates, gene constants, allele support and region burden."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions.values import known, let, yes
from varloom.operators.ranks import joined_in_place

#: Places of a cell of counted(), as a power of two.
CELL = 14


def gated(df: DataFrame, variant_splice: str, gene_splice: str, z: str, ase: str, p: float = 0.1, outlier: float = 1.5) -> DataFrame:
    """Rows with any of four RNA signals, as flags; level says whether a gene and a variant report is due."""
    df = df.withColumns({
        "splice_variant": yes(known(F.col(variant_splice)) <= p),
        "splice_gene": yes(known(F.col(gene_splice)) <= p),
        "outlier": yes(F.abs(known(F.col(z))) >= outlier),
        "ase": yes(known(F.col(ase)) <= p),
    })
    df = df.filter(F.col("splice_variant") | F.col("splice_gene") | F.col("outlier") | F.col("ase"))
    return df.withColumn("gene_report", F.col("outlier") | F.col("splice_gene")).withColumn("variant_report", F.col("splice_variant") | F.col("ase"))


def first_known(df: DataFrame, by: list[str], order, first: list[str], least: list[str]) -> DataFrame:
    """Per group the first known value of some columns in order, and the least of others."""
    o = F.struct(*order)
    return df.groupBy(*by).agg(*[F.min_by(known(F.col(c)), F.when(known(F.col(c)).isNotNull(), o)).alias(c) for c in first], *[F.min(c).alias(c) for c in least])


def with_first_known(df: DataFrame, by: list[str], order: list[str], first: list[str], least: list[str]) -> DataFrame:
    """All rows with first_known() of their group in place of their own values; needs no order of the rows, so a sort by more columns than by serves it."""
    w, o = Window.partitionBy(*by), F.struct(*order)
    return df.withColumns({c: F.min_by(known(F.col(c)), F.when(known(F.col(c)).isNotNull(), o)).over(w) for c in first} | {c: F.min(c).over(w) for c in least})


def counted(regions: DataFrame, points: DataFrame, by: list[str], start: str, end: str, at: str, bad: str, benign: str, keys: list[str]) -> DataFrame:
    """(keys, by, start, end, n_harmful, n_benign) of regions, in one or two rows whose sum is the count of points inside [start, end].

    Points and the edges of regions are one sorted sequence with running counts: a region's
    count is the one at its end less the one before its start, so no region meets its points.
    The sequence is dealt to cells of equal width; a cell counts its own rows and gets the total
    of the cells before it, so no task holds a whole contig. A region moves to the cells of its
    edges, mostly to one. A point counts once per row, null marks count as no; a region that
    ends before it starts holds none and has no row, and repeated ones are one.
    """
    none, cell = F.lit(0).cast("long"), lambda c: F.shiftright(F.col(c).cast("long"), CELL)
    asked = regions.filter(F.col(start) <= F.col(end)).select(*keys, *by, F.col(start).alias("__start"), F.col(end).alias("__end"), F.explode(F.array_distinct(F.array(cell(start), cell(end)))).alias("__cell"))
    seen = points.filter(F.col(at).isNotNull()).groupBy(*by, F.col(at).cast("long").alias("__at")).agg(F.count(F.when(F.col(bad), 1)).alias("bad"), F.count(F.when(F.col(benign), 1)).alias("benign")).withColumn("__cell", cell("__at"))
    # at one place: first the starts, then the points, then the ends; an edge adds nothing and keeps its region's name
    event = lambda c, kind, n=(none, none): F.struct(F.col(c).cast("long").alias("at"), F.lit(kind).alias("kind"), n[0].alias("bad"), n[1].alias("benign"))
    edges = F.filter(F.array(event("__start", 0), event("__end", 2)), lambda e: F.shiftright(e["at"], CELL) == F.col("__cell"))
    dealt = asked.unionByName(seen, allowMissingColumns=True).repartition(*by, "__cell")
    rows = dealt.withColumn("e", F.explode(F.when(F.col("__at").isNull(), edges).otherwise(F.array(event("__at", 1, (F.col("bad"), F.col("benign"))))))).select(*keys, *by, "__start", "__end", "__cell", "e.*")
    inside = Window.partitionBy(*by, "__cell").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.withColumns({f"__{c}": F.sum(c).over(inside) for c in ("bad", "benign")}).filter("kind <> 1")
    edge = lambda c, kind: F.max(F.when(F.col("kind") == kind, F.col(c)))
    parts = totals.groupBy(*by, "__cell", *keys, "__start", "__end").agg(*[edge(f"__{c}", kind).alias(f"__{c}{kind}") for c in ("bad", "benign") for kind in (0, 2)])
    before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = asked.select(*by, "__cell").distinct().withColumns({"bad": none, "benign": none})
    heads = seen.select(*by, "__cell", "bad", "benign").unionByName(ends).groupBy(*by, "__cell").agg(F.sum("bad").alias("bad"), F.sum("benign").alias("benign"))
    heads = heads.select(*by, "__cell", *[F.coalesce(F.sum(c).over(before), none).alias(f"__{c}") for c in ("bad", "benign")])
    # the total before the cell adds to an end and takes off a start, so it counts where only one of them is here
    part = lambda c: F.coalesce(F.col(f"__{c}2") + F.col(f"__{c}"), none) - F.coalesce(F.col(f"__{c}0") + F.col(f"__{c}"), none)
    return parts.join(heads, [*by, "__cell"]).select(*keys, *by, F.col("__start").alias(start), F.col("__end").alias(end), part("bad").alias("n_harmful"), part("benign").alias("n_benign"))


def burden(regions: DataFrame, points: DataFrame, by: list[str], start: str, end: str, at: str, bad: str, benign: str, keys: list[str]) -> DataFrame:
    """Per row the counts of harmful and of benign points inside its region, as counted() has them, and their ratio; null over none."""
    per = counted(regions.select(*by, start, end).distinct(), points, by, start, end, at, bad, benign, [])
    per = per.groupBy(*by, start, end).agg(F.sum("n_harmful").alias("n_harmful"), F.sum("n_benign").alias("n_benign"))
    out = regions.select(*keys, *by, start, end).join(per, [*by, start, end], "left").fillna(0, ["n_harmful", "n_benign"])
    return out.withColumn("ratio", F.try_divide("n_harmful", "n_benign"))


def with_places_in_place(rows: DataFrame, counts: DataFrame, shared: list[str], length: Column) -> DataFrame:
    """rows with the counts of their place, and as __more those of as many places after it as their length asks for."""
    reads = ("__A", "__C", "__G", "__T")
    df = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__first", F.col("__pos"))
    df = df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce(length, F.lit(1)) - 1, F.lit(0))))).withColumn("__pos", F.col("__first") + F.col("__i"))
    df = joined_in_place(df, [counts], [*shared, "chrom", "__pos"])
    more = F.sort_array(F.collect_list(F.when(F.col("__i") > 0, F.struct("__i", *reads))).over(Window.partitionBy(*shared, "__id")))
    return df.withColumn("__more", more).filter("__i = 0").drop("__id", "__first", "__i")


def support(rows: DataFrame, bases: DataFrame, shared: list[str], in_place: bool = False) -> DataFrame:
    """rows with the reads that show each allele: maximum, mean and minimum over the allele's bases.

    rows has shared, chrom, pos, ref, alt; bases has a row per read base (shared, chrom, pos,
    base). A base that no read covers counts 0, and so does one that is not A, C, G or T.
    Reads are counted first, and rows meet the counts of the place they start at. Longer alleles need
    those of the following places too: a place gets them once, as far as its longest allele goes.
    in_place is for rows and bases that are dealt by a shared column: they meet by windows inside it.
    """
    place = [*shared, "chrom", "__pos"]
    at = F.col("pos").cast("long").alias("__pos")
    counts = bases.groupBy(*shared, "chrom", at).agg(*[F.count(F.when(F.upper("base") == b, 1)).alias(f"__{b}") for b in "ACGT"])
    size = lambda s: F.length(F.upper(s))
    df = rows.withColumn("__pos", F.col("pos").cast("long"))
    if in_place:
        df = with_places_in_place(df, counts, shared, F.greatest(size("ref"), size("alt")))
    else:
        long = rows.select(*shared, "chrom", at, F.greatest(size("ref"), size("alt")).alias("__n")).filter("__n > 1").groupBy(*place).agg(F.max("__n").alias("__n"))
        cells = long.select(*[F.col(c).alias(f"__at_{c}") for c in place], F.explode(F.sequence(F.lit(1), F.col("__n") - 1)).alias("__i"))
        next_ = F.col("__at___pos") + F.col("__i")
        met = cells.select("*", *[F.col(f"__at_{c}").alias(c) for c in place[:-1]], next_.alias("__pos")).join(counts, place, "left")
        more = met.groupBy(*[F.col(f"__at_{c}").alias(c) for c in place]).agg(F.sort_array(F.collect_list(F.struct("__i", *[f"__{b}" for b in "ACGT"]))).alias("__more"))
        df = df.join(counts, place, "left").join(more, place, "left")

    def seen(base: Column, reads: Callable[[str], Column]) -> Column:
        n = F.lit(None).cast("long")
        for b in "ACGT":
            n = F.when(base == b, reads(f"__{b}")).otherwise(n)
        return F.coalesce(n, F.lit(0)).cast("double")

    def stats(s: str) -> Column:
        three = lambda most, mean, least: F.struct(most.alias("max"), mean.alias("mean"), least.alias("min"))
        one = seen(F.upper(s), F.col)
        letters = F.filter(F.split(F.upper(s), ""), lambda x: x != "")
        each = F.transform(letters, lambda x, i: F.when(i == 0, seen(x, F.col)).otherwise(seen(x, lambda c: F.get("__more", i - 1)[c])))
        mean = lambda ns: F.try_divide(F.aggregate(ns, F.lit(0.0), lambda a, n: a + n), F.size(ns))
        return F.when(size(s) == 1, three(one, one, one)).otherwise(let(each, lambda ns: three(F.array_max(ns), mean(ns), F.array_min(ns))))

    df = df.withColumns({f"__{s}": stats(s) for s in ("ref", "alt")})
    return df.select(*rows.columns, *[F.col(f"__{s}.{k}").alias(f"{s}_count_{k}") for s in ("ref", "alt") for k in ("max", "mean", "min")])


def allele_support(variants: DataFrame, bases: DataFrame, by: list[str]) -> DataFrame:
    """support() of each distinct variant; variants has by, chrom, pos, ref, alt, and bases the sample columns of by.

    Variants are dealt by place before equal ones become one, so that they move once.
    """
    shared = [c for c in by if c in bases.columns]
    rows = variants.select(*by, "chrom", "pos", "ref", "alt").repartition(*shared, "chrom", F.col("pos").cast("long"))
    return support(rows.distinct(), bases, shared)


def dosage_of(df: DataFrame, dosage: DataFrame, gene: str = "geneSymbol") -> DataFrame:
    """Adds haploinsufficiency and triplosensitivity of the upper-case gene; empty where unknown. Repeated genes count once.

    One row per gene is small however many samples there are, so it is sent to all tasks and df stays where it is.
    """
    d = dosage.groupBy(F.col("GENE SYMBOL").alias("__g")).agg(F.min("HAPLOINSUFFICIENCY").alias("haploinsufficiency"), F.min("TRIPLOSENSITIVITY").alias("triplosensitivity"))
    return df.join(F.broadcast(d), F.upper(F.col(gene)) == F.col("__g"), "left").drop("__g").fillna("", ["haploinsufficiency", "triplosensitivity"])
