"""Sharding by histogram sort: splitters are refined by exact byte counts, then rows move once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.common import forget, table, written

#: Probes into the range of a splitter in each pass.
PROBES = 2048
TOP = 1 << 62


def keyed(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Adds size (UTF-8 bytes plus 1; null text: none), text_crc32 and the sort key (__k1, __k2).

    Rows sort by a hash of the text, then by a hash of the id: equal texts stand together
    and are only parted where a splitter falls into them.
    """
    t = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("string")
    low = lambda h: F.shiftrightunsigned(h, 2)  # noqa: E731  0 to 2^62 - 1
    return docs.withColumns({"size": (F.octet_length(t) + 1).cast("long"), "text_crc32": F.crc32(t.cast("binary")), "__k1": low(F.xxhash64(t)), "__k2": low(F.xxhash64(F.col(f"`{key}`"), F.lit(1)))})


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """Keys (k1, k2) that part the rows into shards of nearly equal bytes; fewer for an empty table.

    Each pass counts the exact bytes between PROBES boundaries inside every open range and
    keeps the interval that holds the target, until a boundary lies within the tolerance (a
    share of one shard) or rows with one key remain, which no splitter can part.
    """
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    targets = {s: total * s / shards for s in range(1, shards)}
    # (k1 of a single text's group or None, low, high) -> splitters still open there, bytes below low
    open_at = {(None, 0, TOP): (list(targets), 0)} if total else {}
    found: dict[int, tuple[int, int]] = {}
    while open_at:
        cells = list(open_at)
        cell, probe = F.lit(None).cast("int"), F.lit(None).cast("long")
        for c, (k1, lo, hi) in enumerate(cells):
            k = F.col("__k1") if k1 is None else F.col("__k2")
            inside = (k >= lo) & (k < hi) if k1 is None else (F.col("__k1") == k1) & (k >= lo) & (k < hi)
            cell = F.when(inside, c).otherwise(cell)
            probe = F.when(inside, F.floor((k - lo) / F.lit(width(lo, hi)))).otherwise(probe)
        counted = rows.select(cell.alias("c"), probe.alias("p"), "size", "__k1").filter("c is not null").groupBy("c", "p").agg(F.sum("size").alias("b"), F.min("__k1").alias("lo"), F.max("__k1").alias("hi")).collect()
        seen: dict[int, list] = {}
        for r in counted:
            seen.setdefault(r["c"], []).append(r)
        following: dict = {}
        for c, at in enumerate(cells):
            k1, lo, hi = at
            wide, (wanted, below) = width(lo, hi), open_at[at]
            bins = sorted(seen.get(c, []), key=lambda r: r["p"])
            for s in wanted:
                before = below
                for r in bins:
                    if before + r["b"] >= targets[s]:
                        break
                    before += r["b"]
                start, end = lo + r["p"] * wide, min(hi, lo + (r["p"] + 1) * wide)
                near = start if targets[s] - before <= before + r["b"] - targets[s] else end
                if min(targets[s] - before, before + r["b"] - targets[s]) <= tolerance * total / shards or (k1 is not None and end - start <= 1):
                    found[s] = (near, 0) if k1 is None else (k1, near)
                else:
                    nxt = (r["lo"], 0, TOP) if k1 is None and r["lo"] == r["hi"] else (k1, start, end)
                    following.setdefault(nxt, ([], before))[0].append(s)
        open_at = following
    return [found[s] for s in sorted(found)]


def width(lo: int, hi: int) -> int:
    return max(1, -(-(hi - lo) // PROBES))


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    """Number of splitters at or below the row's key."""
    shard = F.lit(0)
    for k1, k2 in cuts:
        shard = shard + F.when((F.col("__k1") > k1) | ((F.col("__k1") == k1) & (F.col("__k2") >= k2)), 1).otherwise(0)
    return shard.cast("int")


def sharded(rows: DataFrame, shards: int = 16, tolerance: float = 0.002, slice_rows: int = 50_000) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard) to keyed() rows.

    A shard is numbered by slices of the key's range, so no task holds a whole shard; the slice
    counts give each slice its first slot. Slots follow the key, so equal texts have slots in a
    row; only a slice that one text or a few fill beyond slice_rows is cut by the hash of the
    id. Repeated rows get slots of their own. An empty table gives no rows; null ids and texts
    have keys like any others.
    """
    wide = -(-TOP // max(1, shards * -(-rows.count() // (shards * slice_rows))))
    dealt = rows.withColumn("shard", shard_of(splitters(rows, shards, tolerance))).withColumn("__c", F.floor(F.col("__k1") / F.lit(wide)).cast("long"))
    full = dealt.groupBy("shard", "__c").agg(F.ceil(F.count("*") / slice_rows).cast("long").alias("__cuts")).filter("__cuts > 1")
    dealt = dealt.join(full, ["shard", "__c"], "left").withColumn("__s", F.when(F.col("__cuts").isNull(), 0).otherwise(F.pmod(F.col("__k2"), F.col("__cuts")))).drop("__cuts")
    counts = dealt.groupBy("shard", "__c", "__s").count()
    first = counts.withColumn("__first", F.sum("count").over(Window.partitionBy("shard").orderBy("__c", "__s").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "__c", "__s", F.coalesce("__first", F.lit(0)).alias("__first"))
    order = Window.partitionBy("shard", "__c", "__s").orderBy("__k1", "__k2")
    numbered = dealt.withColumn("__n", F.row_number().over(order) - 1).join(first, ["shard", "__c", "__s"])
    return numbered.withColumn("slot", (F.col("__first") + F.col("__n")).cast("long")).drop("__c", "__s", "__n", "__first", "__k1", "__k2")


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.002, text: str = "text", key: str = "doc_id", file_bytes: int = 256 << 20) -> DataFrame:
    """Exchanges the rows once and writes them as path/shard=N, in files of about file_bytes; returns the shards' sizes.

    Columns of docs that are named like those of keyed() are replaced.
    """
    keys = written(keyed(docs, text, key).select("size", "__k1", "__k2"), "shard-keys")
    cuts = splitters(keys, shards, tolerance)
    total = keys.agg(F.sum("size").alias("b")).first()["b"] or 0
    forget(keys)
    files = max(1, -(-total // (shards * file_bytes)))
    dealt = keyed(docs, text, key).withColumn("shard", shard_of(cuts)).withColumn("__f", F.pmod("__k2", F.lit(files)))
    dealt.repartition(shards * files, "shard", "__f").drop("__k1", "__k2", "__f").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = written(keyed(docs).drop("text"), "shard-keys")
    return sharded(rows).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
