"""Prompt texts for reviewers and tables out of their answers."""

from __future__ import annotations

from collections.abc import Callable
from xml.etree.ElementTree import Element, ParseError, fromstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from varloom.functions.values import clipped, four_text, let, number, shown
from varloom.operators.ranks import joined_text
from varloom.operators.rubrics import rubric

# Keys of each reviewer's answer, with what stands for a missing one.
DEFAULTS = {
    "database": {"reasoning": "", "conclusion": "Neutral", "zygosity": "no information"},
    "insilico": {"Reasoning": "parse_error", "Conclusion": "Weak"},
    "hpo": {"Reasoning": "comply_error", "Conclusion": "Not Fit"},
    "omim": {"Reasoning": "comply_error", "Conclusion": "Not Fit"},
    "literature": {"Reasoning": "comply_error", "Conclusion": "Not Fit"},
    "rna_gene": {"Reasoning": "comply_error", "Event": "No Signal", "Conclusion": "No RNA Evidence"},
    "rna_variant": {"Reasoning": "comply_error", "Event": "No Signal", "Conclusion": "No RNA Evidence"},
}
# What a reviewer may answer.
FIT = ["Not Fit", "Partial Fit", "Good Fit"]
SURE = "Stand-Alone Strong Evidence"
RNA_LEVELS = ["No RNA Evidence", "Weak RNA Evidence", "Strong RNA Evidence"]
AMOUNTS = ["Moderately Decreased Expression", "Largely Decreased Expression", "Increased Expression"]
CHOICES = {
    "database": {"conclusion": ["Against", "Neutral", "Supporting", "Convincing"], "zygosity": ["homozygous", "compound_heterozygous", "heterozygous", "no_information"]},
    "insilico": {"Conclusion": ["Weak", "Moderate", "Strong"]},
    "hpo": {"Conclusion": [*FIT, SURE]},
    "omim": {"Conclusion": ["Impossible", *FIT, SURE]},
    "literature": {"Conclusion": FIT},
    "rna_gene": {"Event": ["No Signal", "Abnormal Splicing", *AMOUNTS], "Conclusion": RNA_LEVELS},
    "rna_variant": {"Event": ["No Signal", "Exon Skipping", "Intron Retention", "Cryptic Splicing", *AMOUNTS, "Allele Imbalance (Alt High)", "Allele Imbalance (Alt Low)"], "Conclusion": RNA_LEVELS},
}
# Kinds of publications, and those whose abstracts are read.
CATEGORIES = ["functional study", "review", "case report", "patient cohort", "phenotype association"]


def told(*parts) -> Column:
    """One text; missing parts are empty."""
    return F.concat(*[F.coalesce(p, F.lit("")) if isinstance(p, Column) else F.lit(p) for p in parts])


def request(kind: str) -> str:
    """What is asked of the reviewer: a JSON object with exactly the keys that parsed() reads, and what each choice means."""
    keys = ", ".join(f'"{k}"' for k in DEFAULTS[kind])
    return f"\nAnswer with one JSON object with the keys {keys} and nothing else." + "".join(f"\n{k}: one of {' | '.join(v)}." for k, v in CHOICES[kind].items()) + f"\n{rubric(kind)}"


def ask(kind: str, *blocks) -> Column:
    return told(*blocks, request(kind))


def fours(columns: list[str], text: Callable[[Callable[[str], Column]], Column]) -> Column:
    """A text out of columns shown with four significant digits, or NA: text gets a function from a column's name to what is shown.

    All go through one expression over their array, so the plan holds the rounding once.
    """
    shown_ = F.transform(F.array(*[number(F.col(c)) for c in columns]), lambda x: F.coalesce(four_text(x), F.lit("NA")))
    return let(shown_, lambda t: text(lambda c: F.get(t, F.lit(columns.index(c)))))


def whole(c: Column) -> Column:
    return F.coalesce(number(c).cast("long").cast("string"), F.lit("NA"))


def submissions(rows: DataFrame, key: str, order: str, text: str, size: int = 3000) -> DataFrame:
    """(key, submissions): the key's texts in order, each cut to a size, with rules between them."""
    return rows.filter(F.col(text).isNotNull()).groupBy(key).agg(joined_text(F.col(order), clipped(F.col(text), size), "\n---\n").alias("submissions"))


def database_prompt(key: Column, change: Column, texts: Column) -> Column:
    return ask("database", "Variant ", key, "; coding change ", change, ".\nSubmissions:\n", F.coalesce(texts, F.lit("No submissions were found.")))


def in_silico_prompt(gene: Column, change: Column, protein: Column, scores: dict[str, Column], splice: Column | None = None, is_splice: Column | None = None, note: str = "") -> Column:
    """The coding change is told unless the protein change is -; the splice score only for splice variants."""
    lines = [told("\n", name, ": ", shown(c)) for name, c in scores.items()]
    if splice is not None:
        lines.append(F.when(is_splice, told("\nspliceAImax: ", shown(splice))))
    return ask("insilico", "Gene ", gene, F.when(F.coalesce(protein, F.lit("-")) != "-", told("; cDNA ", change, "; protein ", protein)), ".", *lines, note)


def inheritance(recessive: Column, dominant: Column) -> Column:
    """The patterns that all of a gene's rows allow."""
    text = F.concat_ws(", ", F.when(recessive == 1, "recessive"), F.when(dominant == 1, "dominant"))
    return F.when(text == "", "unknown").otherwise(text)


# Names of columns that the RNA prompts show.
GENE_NUMBERS = ["gnomadGenePLI", "gnomadGeneOELof", "gnomadGeneOELofUpper"]
EXPRESSION_NUMBERS = ["Outrider_RawZscore", "Outrider_zScore", "Outrider_pValue"]
# Names of a junction's columns.
JUNCTION = ["jaccard", "predictedMeans_jaccard", "delta_jaccard", "rawOtherCounts_jaccard", "psi5", "rawOtherCounts_psi5", "delta_psi5", "psi3", "rawOtherCounts_psi3", "delta_psi3", "rawCountsJnonsplit"]


def gene_block(four: Callable[[str], Column]) -> Column:
    """Constraint metrics, inheritance and dosage of a gene."""
    known = F.when((F.col("haploinsufficiency") != "") | (F.col("triplosensitivity") != ""), told("\nHaploinsufficiency: ", F.col("haploinsufficiency"), "\nTriplosensitivity: ", F.col("triplosensitivity")))
    return told("\nInheritance: ", inheritance(F.col("recessive"), F.col("dominant")), "\npLI: ", four("gnomadGenePLI"), "\no/e LOF: ", four("gnomadGeneOELof"), " (upper ", four("gnomadGeneOELofUpper"), ")", known)


def expression_block(four: Callable[[str], Column]) -> Column:
    return told("\nExpression: raw counts ", whole(F.col("Outrider_rawcounts")), ", raw z ", four("Outrider_RawZscore"), ", z ", four("Outrider_zScore"), ", p ", four("Outrider_pValue"))


def rna_gene_prompt() -> Column:
    def text(four: Callable[[str], Column]) -> Column:
        return ask("rna_gene", "RNA evidence of gene ", F.col("geneSymbol"), ":", gene_block(four), "\nSplicing p of the gene: ", four("Fraser_GenePvalue"), expression_block(four))

    return fours([*GENE_NUMBERS, *EXPRESSION_NUMBERS, "Fraser_GenePvalue"], text)


def rna_variant_prompt() -> Column:
    """Junction, expression where tested, and allele counts where tested at a heterozygous site."""
    f = lambda c: F.col(f"Fraser_{c}")

    def text(four: Callable[[str], Column]) -> Column:
        junction = told("\nJunction ", F.col("Chromosome"), ":", whole(f("junction_start")), "-", whole(f("junction_end")), ", p ", four("Fraser_pvaluesBetaBinomial_jaccard"), *[x for c in JUNCTION for x in (f", {c} ", four(f"Fraser_{c}"))])
        burden = told("\nHarmful, benign records inside: ", F.col("n_harmful").cast("string"), ", ", F.col("n_benign").cast("string"), ", ratio ", four("ratio"))
        ase = F.when(number(F.col("ASE_PVAL")).isNotNull() & (F.col("zyg") == 1), told("\nAlleles: p ", four("ASE_PVAL"), ", ref ", whole(F.col("ASE_REF_COUNT")), ", alt ", whole(F.col("ASE_ALT_COUNT")), ", alt ratio ", four("ASE_ALT_RATIO")))
        expressed = F.when(number(F.col("Outrider_pValue")).isNotNull(), expression_block(four))
        return ask("rna_variant", "RNA evidence of ", F.col("geneSymbol"), " ", F.col("varId"), ":", gene_block(four), junction, burden, expressed, ase)

    return fours([*GENE_NUMBERS, *EXPRESSION_NUMBERS, "Fraser_pvaluesBetaBinomial_jaccard", *[f"Fraser_{c}" for c in JUNCTION], "ratio", "ASE_PVAL", "ASE_ALT_RATIO"], text)


def triage_prompt(gene: Column, items: Column) -> Column:
    """Asks for a table of the publications on rare disease, each in one category."""
    return told("Gene ", gene, ". Which of these publications are about rare disease, and of which kind: ", ", ".join(CATEGORIES), "?\nAnswer with a tab-separated table with the header PMID, Title, Category and nothing else.\n", items)


def phenotype_prompt(kind: str, patient: Column, gene: Column, evidence: Column) -> Column:
    return ask(kind, "Patient: ", F.when(F.coalesce(patient, F.lit("")) == "", F.lit("no phenotype given")).otherwise(patient), ".\nGene ", gene, ":\n", F.coalesce(evidence, F.lit("Nothing is known.")))


def parsed(answers: DataFrame, kind: str, text: str = "response") -> DataFrame:
    """Adds the fields of a JSON answer; a missing field or an unreadable answer gives the defaults."""
    fields = DEFAULTS[kind]
    got = F.from_json(F.col(text), ", ".join(f"`{f}` string" for f in fields))
    df = answers.withColumn("__j", got)
    return df.withColumns({f: F.coalesce(F.col("__j")[f], F.lit(d)) for f, d in fields.items()}).drop("__j")


def named(answers: DataFrame, kind: str, prefix: str, text: str = "response") -> DataFrame:
    """parsed() with the columns as <prefix>_Reasoning, <prefix>_Conclusion and so on."""
    return parsed(answers, kind, text).drop(text).withColumnsRenamed({f: f"{prefix}_{f.capitalize()}" for f in DEFAULTS[kind]})


def table_rows(df: DataFrame, keys: list[str], text: str, columns: list[str]) -> DataFrame:
    """Rows of a tab-separated table inside a text; a spelled-out tab is a tab, the first line is the header."""
    lines = F.split(F.replace(F.col(text), F.lit("\\t"), F.lit("\t")), "\n")
    rows = df.select(*keys, F.posexplode(lines).alias("line", "row")).filter(F.col("line") > 0).filter(F.trim("row") != "")
    cells = F.split("row", "\t")
    return rows.select(*keys, "line", *[F.trim(F.get(cells, i)).alias(c) for i, c in enumerate(columns)])


def in_categories(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    return df.filter(F.lower(F.trim(column)).isin(*wanted))


@F.pandas_udf(StringType())
def xml_lines(texts: pd.Series) -> pd.Series:
    """An XML element as indented lines, tag [k="v"]: text, children below their parent; null where it is no XML."""

    def lines(e: Element, depth: int) -> list[str]:
        own = "  " * depth + e.tag + (" [" + ", ".join(f'{k}="{v}"' for k, v in e.attrib.items()) + "]" if e.attrib else "")
        text = (e.text or "").strip()
        out = [f"{own}: {text}" if text else f"{own}:" if len(e) else own]
        for child in e:
            out += lines(child, depth + 1)
        return out

    def one(text: str | None) -> str | None:
        try:
            return "\n".join(lines(fromstring(text), 0)) if text else None
        except ParseError:
            return None

    return texts.map(one)


def submission_texts(rows: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds text, the record's XML as lines."""
    return rows.withColumn("text", xml_lines(F.col(xml)))
