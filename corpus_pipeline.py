"""Five stages from raw documents to encoded ones: each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varloom.llm import line_dedup, mixing, near_dedup, pieces, quality_rules
from varloom.llm.common import forget, table, written
from varloom.sources.sinks import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects. Null and empty texts have no word and go; repeated rows are judged alike."""
    return quality_rules.keep(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring line templates stay in their first document only; documents emptied by that go.

    Null and empty texts stay as they are; a null id is the smallest; copies of a text are one.
    """
    return line_dedup.drop_recurring(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity 0.8 join: that of the smallest id.

    Texts without words link with nothing and stay, rows without an id too; of rows with one id, all or none stay.
    """
    return near_dedup.one_of_each(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that bring good, poor and toxic text to their weights; good ones stay.

    Rows with equal id and text are repeated alike; without labelled documents every row stays once.
    """
    labelled = mixing.labelled_texts(docs, table(spark, sf_dir, "labels"))
    return mixing.remix(docs, labelled, "domain", mixing.PIPELINE_TARGETS, rise=("good", mixing.PIPELINE_RISE))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their number of pieces and the digests of ids and decoded text; columns that had these names give way."""
    return pieces.encoded(docs, pieces.model_path(), keep=tuple(docs.columns))


STAGES = [("quality rules", quality), ("line dedup", lines), ("MinHash near-dedup", near), ("mixing", mix), ("SentencePiece encoding", encode)]

#: Similarity joins, sampled labels and merges are not SQL; the operators' tests cover the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote on its way, and the stage before it, are deleted once it is done."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            made.pop()
        if before is not None:
            forget(before)
        before = docs
    return docs
