"""Phenotype tables: patient terms, gene terms, disease texts and publications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.labels import frequency, frequency_label
from varloom.operators.ranks import best_rows, joined_text

ROOT = "HP:0000001"
# Words of which a publication must hold one.
KEYWORDS = ["variant", "variants", "mutation", "mutations", "diagnosis", "mendelian", "cause", "causes"]


def patient_terms(samples: DataFrame, terms: DataFrame, names: DataFrame) -> DataFrame:
    """(sample_id, n_terms, term_text, has_terms) of every sample.

    Unknown ids are dropped; no ids, only the root, or only unknown ids give All and flag 0.
    """
    known = terms.join(names, terms["hpo_id"] == names["id"]).select("sample_id", "ord", "hpo_id", "name")
    per = known.groupBy("sample_id").agg(F.count("*").alias("n_terms"), F.max((F.col("hpo_id") != ROOT).cast("int")).alias("real"), joined_text(F.col("ord"), F.col("name"), ", ").alias("term_text"))
    out = samples.select("sample_id").distinct().join(per, "sample_id", "left")
    real = F.coalesce(F.col("real") == 1, F.lit(False))
    return out.select("sample_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), F.when(real, F.col("term_text")).otherwise("All").alias("term_text"), real.cast("int").alias("has_terms"))


def shown_terms(c: Column) -> Column:
    """Text for prompts: nothing where all phenotypes count."""
    return F.when(c == "All", "").otherwise(c)


def pooled_terms(rows: DataFrame, gene: str = "gene_symbol", term: str = "hpo_id", name: str = "hpo_name", freq: str = "frequency") -> DataFrame:
    """(gene, term, name, num, den, has, entry): frequencies of a gene's term pooled over its sources.

    Unreadable frequencies don't count, but their term stays.
    """
    df = rows.withColumn("__f", frequency(F.col(freq)))
    per = df.groupBy(gene, term).agg(F.min(name).alias("name"), F.coalesce(F.sum("__f.num"), F.lit(0.0)).alias("num"), F.coalesce(F.sum("__f.den"), F.lit(0.0)).alias("den"), F.coalesce(F.max("__f.has"), F.lit(0)).alias("has"), F.sum((F.col(freq).isNotNull() & F.col("__f").isNull()).cast("int")).alias("unreadable"))
    label = frequency_label(F.try_divide("num", "den"))
    entry = F.when((F.col("has") == 1) & (F.col("den") > 0), F.concat(F.col("name"), F.lit(" ("), label, F.lit(")"))).otherwise(F.concat(F.col("name"), F.lit(" (Frequency not specified)")))
    return per.withColumn("entry", entry)


def gene_terms(rows: DataFrame, gene: str = "gene_symbol", term: str = "hpo_id", **names) -> DataFrame:
    """(gene, phenotype_text): pooled entries in term order."""
    return pooled_terms(rows, gene, term, **names).groupBy(gene).agg(joined_text(F.col(term), F.col("entry"), ", ").alias("phenotype_text"))


def disease_texts(rows: DataFrame, gene: str, phenotypes: str, features: str, order: list[str]) -> DataFrame:
    """(gene, texts): one text per disease with clinical features, in order."""
    told = F.concat(F.col(gene), F.lit(" causes "), F.coalesce(phenotypes, F.lit("nan")), F.lit(".\nClinical Features: "), F.trim(F.replace(features, F.lit("\n\n"), F.lit("\n"))))
    df = rows.filter(F.col(features).isNotNull()).select(gene, F.struct(*order).alias("__o"), told.alias("__t"))
    return df.groupBy(gene).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", "__t"))), lambda x: x["__t"]).alias("texts"))


def unannotated(candidates: DataFrame, annotated: DataFrame, sample: str = "sample_id", gene: str = "geneSymbol") -> DataFrame:
    """Candidate (sample, gene) rows of genes that no sample's annotation covers."""
    bare = candidates.select(gene).distinct().join(annotated.select(gene).distinct(), gene, "left_anti")
    return candidates.select(sample, gene).distinct().join(bare, gene, "left_semi")


def mentions(text: Column, gene: Column) -> Column:
    """Whether the text names the gene as a whole word, hyphens being part of words; case counts."""
    return F.rlike(text, F.concat(F.lit(r"(?<![A-Za-z0-9_\-])\Q"), gene, F.lit(r"\E(?![A-Za-z0-9_\-])")))


def says(text: Column, words: list[str]) -> Column:
    """Whether the text holds one of the words as a whole word, in any case."""
    return F.rlike(text, F.lit(r"(?i)(?<![\p{L}\p{N}_])(?:" + "|".join(words) + r")(?![\p{L}\p{N}_])"))


#: What a gene name is made of, and so a word of a text that may be one.
NAME = r"[A-Za-z0-9_\-]+"


def named_genes(texts: DataFrame, genes: DataFrame, key: str, text: str, gene: str = "gene") -> DataFrame:
    """(key, gene): the genes that each text names as mentions() tells, without meeting every gene with every text.

    A text is cut once into its distinct words, which join the names on equality. Names that
    hold other characters go by their longest word first, and then by their pattern; names
    without a word are none.
    """
    cut = texts.filter(F.col(text).isNotNull()).select(key, F.col(text).alias("__t"))
    words = cut.select(key, F.explode(F.array_distinct(F.regexp_extract_all("__t", F.lit(f"({NAME})"), F.lit(1)))).alias("__w"))
    names = genes.select(F.col(gene).alias("__g")).filter("__g <> ''").distinct()
    simple = names.filter(F.col("__g").rlike(f"^{NAME}$"))
    out = words.join(simple, F.col("__w") == F.col("__g")).select(key, F.col("__g").alias(gene))
    odd = names.filter(~F.col("__g").rlike(f"^{NAME}$")).withColumn("__w", F.get(F.array_sort(F.regexp_extract_all("__g", F.lit(f"({NAME})"), F.lit(1)), lambda a, b: F.length(b) - F.length(a)), F.lit(0)))
    if odd.isEmpty():
        return out
    near = words.join(odd.filter("__w is not null"), "__w").select(key, "__g").distinct().join(cut, key)
    return out.unionAll(near.filter(mentions(F.col("__t"), F.col("__g"))).select(key, F.col("__g").alias(gene))).distinct()


def publications(rows: DataFrame, keywords: list[str] = KEYWORDS, gene: str = "gene", order: list | None = None, most: int = 50) -> DataFrame:
    """Up to `most` publications per gene in order of relevance: with a numeric id and a title, naming the gene and a keyword.

    The first title stands for an id that comes more than once.
    """
    text = F.concat_ws(" ", F.trim("title"), F.trim(F.coalesce("abstract", F.lit(""))))
    wanted = F.col("PMID").rlike("^[0-9]+$") & (F.trim("title") != "") & mentions(text, F.col(gene)) & says(text, keywords)
    order = order or ["relevance", "PMID"]
    df = best_rows(rows.filter(wanted), [gene, "PMID"], [*order, "title"])
    return best_rows(df, [gene], order, most, "place")


def abstracts(parts: DataFrame) -> DataFrame:
    """(PMID, abstract): the parts (PMID, part, text) of an abstract in order, as one text."""
    return parts.filter(F.col("PMID").rlike("^[0-9]+$")).groupBy("PMID").agg(joined_text(F.col("part"), F.col("text"), " ").alias("abstract"))


def search_text(gene: Column, keywords: list[str] = KEYWORDS) -> Column:
    return F.concat(F.lit('("'), gene, F.lit('"[Title/Abstract]) AND (' + " OR ".join(f"{k}[Title/Abstract]" for k in keywords) + ")"))
