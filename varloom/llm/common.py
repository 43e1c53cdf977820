"""Helpers that the corpus operators share: shared-folder tables, text tests and components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.sources.sinks import forget, materialised, shared_folder

WHITE = r"[\x20\x09-\x0D]"
NOT_WHITE = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Cuts the lineage by a table in the shared folder; forget() deletes one that nothing will read again.
written, shared_dir = materialised, shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen_by_hash(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About `rows` rows of df at most, by a hash of their key: the same rows in every run, whatever the table's size."""
    share = min(1.0, rows / max(df.count(), 1))
    return df.filter(F.shiftrightunsigned(F.xxhash64(F.col(f"`{key}`"), F.lit(3)), 2) <= F.lit(int(share * ((1 << 62) - 1))))


def slots(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def words(text):
    """Array of the words of a text; none for null or blank text."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\v\f\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"{WHITE}+"))


def components(edges: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, component) for each node of the undirected edges (a, b); component is the smallest node reached.

    Alternating large-star and small-star rounds: every round is a grouped minimum and an
    equi-join, so a hub is split like any skewed join and nothing is collected. A round is
    written to the shared folder, so a lost executor repeats one round at most.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v")
    pairs = written(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    k = 0
    while True:
        k += 1
        # large star: each node's larger neighbours move to its smallest neighbour
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # small star: smaller neighbours and the node itself move to the smallest
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = written(small.filter("u <> v").distinct(), f"{name}-{k}")
        # settled: every node has one link, and no node that others link to has a link of its own
        heads = new.select(F.col("v").alias("h")).distinct()
        many = new.groupBy("u").count().filter("count > 1").select("u").unionAll(new.join(heads, F.col("u") == F.col("h"), "left_semi").select("u"))
        forget(pairs)
        pairs = new
        if many.isEmpty():
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
