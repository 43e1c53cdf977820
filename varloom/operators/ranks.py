"""Ranks, first rows and best rows under total orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.sources.sinks import materialised


def best_rows(df: DataFrame, by: list[str], order: list, keep: int = 1, rank: str | None = None) -> DataFrame:
    """The first `keep` rows of each group; rank names the kept position, if wanted."""
    n = rank or "__n"
    out = df.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(n) <= keep)
    return out if rank else out.drop(n)


def max_ranks(df: DataFrame, scores: dict[str, str], key: str = "varId", by: str = "sample_id") -> DataFrame:
    """Adds, per score, the number of keys of the group that score at least as high: ties share the largest rank.

    scores maps the rank's column to the score's. A key counts once, with its highest score; a
    missing score has no rank.
    """
    per = df.groupBy(by, key).agg(*[F.max(s).alias(f"__{r}") for r, s in scores.items()])
    for r in scores:
        w = Window.partitionBy(by).orderBy(F.col(f"__{r}").desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        per = per.withColumn(r, F.when(F.col(f"__{r}").isNotNull(), F.count(F.lit(1)).over(w)).cast("int"))
    return df.join(per.drop(*[f"__{r}" for r in scores]), [by, key])


def ranks_in_place(df: DataFrame, scores: dict[str, str], key: str = "varId", by: str = "sample_id") -> DataFrame:
    """max_ranks() by windows over the rows themselves: they move once, by group, and are scored once, as nothing is joined back."""
    # all windows are over groups, so rows need be dealt by these alone; a key's rows are those of equal order
    own = Window.partitionBy(by).orderBy(key)
    same = own.rangeBetween(Window.currentRow, Window.currentRow)
    again = (F.row_number().over(own) > 1) & F.lag(key).over(own).eqNullSafe(F.col(key))
    out = df.filter(F.col(by).isNotNull()).withColumns({f"__{r}": F.max(s).over(same) for r, s in scores.items()} | {"__one": F.when(~again, 1)})
    for r in scores:
        w = Window.partitionBy(by).orderBy(F.col(f"__{r}").desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(r, F.when(F.col(f"__{r}").isNotNull(), F.count("__one").over(w)).cast("int"))
    return out.filter(F.col(key).isNotNull()).drop("__one", *[f"__{r}" for r in scores])


def joined_in_place(df: DataFrame, tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """df LEFT JOIN each of the tables on keys by windows over the rows of all: what is dealt by one of the keys already doesn't move.

    A row that meets several of a table comes as often, one that meets none once. Each column of
    a table is a list of its own, so that unused ones stay behind; lists of one window have one order.
    """
    columns, here = [[c for c in t.columns if c not in keys] for t in tables], Window.partitionBy(*keys)
    rows, own, named = df.withColumn("__of", F.lit(-1)), F.col("__of") == -1, F.lit(True)
    for i, t in enumerate(tables):
        rows = rows.unionByName(t.withColumn("__of", F.lit(i)), allowMissingColumns=True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    lists = {f"__l_{c}": F.collect_list(F.when(F.col("__of") == i, F.struct(F.col(c)))).over(here) for i, cs in enumerate(columns) for c in cs}
    rows = rows.withColumns(lists | {f"__n{i}": F.count(F.when(named & (F.col("__of") == i), 1)).over(here) for i in range(len(tables))}).filter(own)
    for i in range(len(tables)):
        rows = rows.withColumn(f"__i{i}", F.explode(F.sequence(F.lit(0), (F.greatest(F.col(f"__n{i}"), F.lit(1)) - 1).cast("int"))))
    return rows.select(*df.columns, *[F.when(F.col(f"__n{i}") > 0, F.get(f"__l_{c}", F.col(f"__i{i}"))[c]).alias(c) for i, cs in enumerate(columns) for c in cs])


def running_totals(rows: DataFrame, by: list[str], order: list, sums: list[str], name: str = "running") -> DataFrame:
    """Adds, per column of sums, its total over the group's rows up to this one, for groups of any size.

    Rows are dealt to ranges of (by, order) and written once; each range adds up its own rows
    and gets the total of the ranges before it, of which a group has as many as there are
    tasks at most. Of rows of equal order one only may add anything.
    """
    dealt = materialised(rows.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()), name)
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    heads = dealt.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    heads = heads.select(*[F.col(c).alias(f"__by_{c}") for c in by], F.col("__range").alias("__at"), *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col("__range") == F.col("__at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    out = dealt.withColumns({f"__in_{c}": F.sum(c).over(inside) for c in sums}).join(heads, same)
    return out.select(*rows.columns, *[(F.col(f"__in_{c}") + F.col(f"__{c}")).alias(f"{c}_so_far") for c in sums])


def ranks_of_any_size(df: DataFrame, scores: dict[str, str], key: str = "varId", by: str = "sample_id") -> DataFrame:
    """max_ranks() where a group may be too large for a task: no window holds more than a range of it.

    Equal scores of a group are one row with their number, so a rank is a running total of
    numbers, the same for all that tie, and ties over the edge of a range can't occur.
    """
    names = list(scores)
    per = df.groupBy(by, key).agg(*[F.max(s).alias(r) for r, s in scores.items()])
    cells = per.select(by, key, F.explode(F.array(*[F.struct(F.lit(i).alias("which"), F.col(r).alias("score")) for i, r in enumerate(names)])).alias("s")).select(by, key, "s.*").filter("score is not null")
    counts = cells.groupBy(by, "which", "score").agg(F.count("*").alias("n"))
    ranked = running_totals(counts, [by, "which"], [F.col("score").desc()], ["n"], "ranks")
    ranked = ranked.select(F.col(by).alias("__by"), F.col("which").alias("__which"), F.col("score").alias("__score"), F.col("n_so_far").cast("int").alias("rank"))
    at = cells.join(ranked, F.col(by).eqNullSafe(F.col("__by")) & (F.col("which") == F.col("__which")) & (F.col("score") == F.col("__score")))
    wide = at.groupBy(F.col(by).alias("__by"), F.col(key).alias("__key")).agg(*[F.max(F.when(F.col("which") == i, F.col("rank"))).alias(r) for i, r in enumerate(names)])
    return df.join(wide, F.col(by).eqNullSafe(F.col("__by")) & F.col(key).eqNullSafe(F.col("__key")), "left").drop("__by", "__key")


def place(df: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """1, 2, ... in each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def first_text(value: Column, order: Column) -> Column:
    """Aggregate: the first value that is filled, in order; else empty."""
    from varloom.functions.values import filled

    v = filled(value)
    return F.coalesce(F.min_by(v, F.when(v.isNotNull(), order)), F.lit(""))


def joined_text(order: Column, value: Column, separator: str) -> Column:
    """Aggregate: values in order as one text."""
    return F.concat_ws(separator, F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]))
