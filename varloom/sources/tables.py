"""Readers: one multi-sample table per input, keyed by the sample that the file name gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that names the columns it lacks. Only the schema is looked at."""
    lacking = [n for n in names if n not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df


def with_sample(df: DataFrame, pattern: str, name: str = "sample_id") -> DataFrame:
    """Adds the key that a pattern takes from the file's path."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


#: What the columns of each input are; columns that are not named are text.
KINDS = {
    "predictions": {"overall_logit": "double", "overall_prob": "double", "recessive": "int", "dominant": "int", "zyg": "int"},
    "scores": {},
    "truth": {"pos": "long"},
    "expression": {"pValue": "double", "padjust": "double", "zScore": "double", "l2fc": "double", "rawcounts": "long"},
    "splicing": {"start": "long", "end": "long", "pvaluesBetaBinomial_jaccard": "double"},
    "allele_counts": {"position": "long", "refCount": "long", "altCount": "long", "PVAL": "double"},
    "dosage": {},
    "gene_phenotypes": {},
    "disease_descriptions": {},
}
BROKEN = "_broken"


def declared(spark: SparkSession, path: str, kinds: dict[str, str], sep: str = ",", pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Delimited files with the columns of their header, typed as declared; a broken line keeps its text in _broken.

    A line is broken if a value doesn't fit its type or it has too few or too many values. Only
    headers are read beforehand. Adds sample_id and file; files of one path share a header.
    """
    reader = spark.read.option("header", True).option("sep", sep)
    names = reader.csv(path).columns
    if not names:
        raise ValueError(f"no columns in {path}")
    schema = ", ".join([*[f"`{n}` {kinds.get(n, 'string')}" for n in names], f"`{BROKEN}` string"])
    df = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).option("columnPruning", False).csv(path)
    df = with_sample(df, pattern).withColumn("file", F.col("_metadata.file_path"))
    # only columns that are asked for are tried, so whether a line is broken asks for all that have a type
    typed = [F.substring(F.col(f"`{n}`").cast("string"), 1, 0) for n in names if n in kinds or n == names[0]]
    return df.withColumn(BROKEN, F.when(F.col(BROKEN).isNotNull(), F.concat_ws("", F.col(BROKEN), *typed)))


def good(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col(BROKEN).isNull()).drop(BROKEN)


def rejects(rows: DataFrame) -> DataFrame:
    """(sample_id, file, line) of the lines that were not read."""
    return rows.filter(F.col(BROKEN).isNotNull()).select("sample_id", "file", F.col(BROKEN).alias("line"))


def reject_counts(rows: DataFrame) -> DataFrame:
    """(sample_id, file, n_good, n_rejected) of every file with a line."""
    return rows.groupBy("sample_id", "file").agg(F.count(F.when(F.col(BROKEN).isNull(), 1)).alias("n_good"), F.count(BROKEN).alias("n_rejected"))


def first_match(rows: DataFrame) -> DataFrame:
    """The rows of each sample's first file, by its path: others of the sample are copies or older runs."""
    firsts = rows.groupBy("sample_id").agg(F.min("file").alias("__first"))
    return rows.join(firsts, "sample_id").filter(F.col("file") == F.col("__first")).drop("__first")


def require_inputs(expected: DataFrame, found: DataFrame, what: str, shown: int = 20) -> DataFrame:
    """found, or an error that names samples of expected that it lacks, `shown` of them at most."""
    lacking = expected.select("sample_id").distinct().join(found.select("sample_id"), "sample_id", "left_anti").orderBy("sample_id").limit(shown + 1).collect()
    if lacking:
        more = ", ..." if len(lacking) > shown else ""
        raise FileNotFoundError(f"no {what} of {', '.join(str(r['sample_id']) for r in lacking[:shown])}{more}")
    return found


def predictions(spark: SparkSession, path: str, pattern: str = r"([^/]+)/[^/]+$", schema: str | None = None) -> DataFrame:
    """CSV files of predictions, the sample being their folder; the first column is varId."""
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if not df.columns:
        raise ValueError(f"no columns in {path}")
    return with_sample(df.withColumnRenamed(df.columns[0], "varId"), pattern)


def scores(spark: SparkSession, path: str, pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """Tab-separated annotation files, gzipped or not: four text columns. A gzip file is one split, so rows are dealt anew."""
    df = spark.read.option("header", True).option("sep", "\t").csv(path)
    require_columns(df, "geneSymbol", "varId", "HGVSc", "HGVSp")
    return with_sample(df, pattern).select("sample_id", "geneSymbol", "varId", "HGVSc", "HGVSp").repartition("sample_id", "varId")


def missing_samples(predicted: DataFrame, scored: DataFrame) -> DataFrame:
    """(sample_id, lacks) of samples that only one of the two inputs has."""
    a, b = predicted.select("sample_id").distinct(), scored.select("sample_id").distinct()
    return a.join(b, "sample_id", "left_anti").withColumn("lacks", F.lit("scores")).unionAll(b.join(a, "sample_id", "left_anti").withColumn("lacks", F.lit("predictions")))


def known_samples(predicted: DataFrame, causes: DataFrame) -> DataFrame:
    """(sample_id) of samples with a known cause: those that both tables name."""
    return predicted.select("sample_id").intersect(causes.select(F.col("SampleID").alias("sample_id")))


def truth(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.option("header", True).csv(path), "SampleID", "chr", "pos", "ref", "alt")


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV by the path's ending."""
    if ".parquet" in path:
        return spark.read.parquet(path)
    if ".csv" in path:
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    raise ValueError(f"neither parquet nor csv: {path}")


def annotation(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Gene, transcript or archive tables: the named columns only, which must be there."""
    return require_columns(by_extension(spark, path), *names).select(*[F.col(f"`{n}`") for n in names])


def patient_term_lists(spark: SparkSession, path: str, samples: DataFrame | None = None, pattern: str = r"([^/]+)\.hpo\.txt$") -> DataFrame:
    """(sample_id, ord, hpo_id) of {sample}.hpo.txt files, blank lines dropped, unknown samples skipped."""
    df = with_sample(spark.read.text(path, wholetext=True), pattern)
    df = df.select("sample_id", F.posexplode(F.split("value", r"\r?\n")).alias("ord", "hpo_id")).withColumn("hpo_id", F.trim("hpo_id")).filter("hpo_id <> ''")
    return df.join(samples.select("sample_id").distinct(), "sample_id", "left_semi") if samples is not None else df


def ontology(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of an OBO file's terms."""
    df = spark.read.option("lineSep", "\n\n[Term]").text(path)
    df = df.select(F.regexp_extract("value", r"(?m)^id: *(\S+)", 1).alias("id"), F.regexp_extract("value", r"(?m)^name: *(.+?) *$", 1).alias("name"), F.col("value"))
    return df.filter((F.col("id") != "") & ~F.col("value").startswith("format-version")).drop("value")


def gene_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("sep", "\t").csv(path)


def disease_descriptions(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("sep", "\t").option("multiLine", True).option("escape", '"').csv(path)
    return require_columns(df, "gene_symbol", "Phenotypes", "Clinical Features").select("gene_symbol", "Phenotypes", "Clinical Features")


def dosage(spark: SparkSession, path: str) -> DataFrame:
    names = ("GENE SYMBOL", "HAPLOINSUFFICIENCY", "TRIPLOSENSITIVITY")
    return require_columns(spark.read.option("header", True).csv(path), *names).select(*[F.col(f"`{n}`") for n in names])


def answers(spark: SparkSession, path: str, pattern: str = r"([^/]+)\.json$") -> DataFrame:
    """(key, response) of a folder of JSON files, the key being the file's stem."""
    return with_sample(spark.read.text(path, wholetext=True), pattern, "key").select("key", F.col("value").alias("response"))


def submission_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)
