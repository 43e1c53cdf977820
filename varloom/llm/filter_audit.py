"""Filter interaction audit: what every order of the filters removes at every step, from one count per mask of failures."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.llm.common import NOT_WHITE, UPPER, table, words

#: Filters in the order of their bits; the last one is the table-wide test for copies.
FILTERS = "ABCDE"


def failures(text: Column, w: Column) -> dict[str, Column]:
    """Failure conditions that a text alone decides; w: its words."""
    caps = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(w) < 50,
        "B": 100 * F.size(F.array_distinct(w)) < 65 * F.size(w),
        "C": 100 * caps > 5 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def orders(filters: str) -> list[str]:
    """All permutations in lexicographic order: the place of each is its Lehmer rank."""
    if not filters:
        return [""]
    return [f + rest for i, f in enumerate(filters) for rest in orders(filters[:i] + filters[i + 1 :])]


def removals(filters: str) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last): the orders in which a document that fails mask goes at step.

    Orders that begin with the same letters are one interval of ranks. A document goes at the
    step whose letter is the first of its mask, so its intervals are those of the beginnings
    whose other letters it passes; neighbours are joined.
    """
    k, all_orders = len(filters), orders(filters)
    out = []
    for size in range(1, k + 1):
        for failed in combinations(range(k), size):
            letters = {filters[i] for i in failed}
            for step in range(1, k + 1):
                run = factorial(k - step)
                spans: list[list[int]] = []
                for lo in range(0, len(all_orders), run):
                    head = all_orders[lo][:step]
                    if head[-1] in letters and not letters & set(head[:-1]):
                        if spans and spans[-1][1] == lo:
                            spans[-1][1] = lo + run
                        else:
                            spans.append([lo, lo + run])
                out += [(sum(1 << i for i in failed), step, lo, hi) for lo, hi in spans]
    return out


def masks(docs: DataFrame, labels: DataFrame, text: str, key: str, part: str) -> DataFrame:
    """(part, mask, docs, good, toxic): documents by what they fail.

    A copy is told by its digest and length. Copies are counted per part and id before they
    meet, so a text that many documents share is one row per task in the exchange.
    """
    col = lambda c: F.col(f"`{c}`")
    full = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(col(key).alias("id"), F.coalesce(col(part).cast("string"), F.lit("")).alias("part"), col(text).alias("text"))
    rows = rows.withColumn("w", words(F.col("text")))
    bits = [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failures(full, F.col("w")).values())]
    rows = rows.select("id", "part", F.sha2(full, 256).alias("digest"), F.length(full).alias("size"), sum(bits, F.lit(0)).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "size", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    counts = [F.col("n"), F.col("n") * F.coalesce("good", F.lit(0)), F.col("n") * F.coalesce("toxic", F.lit(0))]
    names = ["docs", "good", "toxic"]
    rows = rows.join(marks, "id", "left").select("id", "part", "digest", "size", "mask", *[c.alias(x) for c, x in zip(counts, names)])
    # per text and part: all documents, those without an id, and those of the smallest id
    own = F.col("id").isNotNull()
    same = rows.groupBy("digest", "size", "mask", "part").agg(*[F.sum(x).alias(x) for x in names], *[F.coalesce(F.sum(F.when(~own, F.col(x))), F.lit(0)).alias(f"bare_{x}") for x in names], F.min(F.when(own, F.struct("id", *names))).alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest", "size"))
    same = same.withColumn("first", F.col("least.id").eqNullSafe(first) & F.col("least").isNotNull())
    same = same.select("part", "mask", *names, *[(F.col(f"bare_{x}") + F.when(F.col("first"), F.col(f"least.{x}")).otherwise(0)).alias(f"pass_{x}") for x in names])
    per = same.groupBy("part", "mask").agg(*[F.sum(x).alias(x) for x in (*names, *[f"pass_{x}" for x in names])])
    copy = 1 << (len(FILTERS) - 1)
    sides = F.array(F.struct(F.col("mask").alias("mask"), *[F.col(f"pass_{x}").alias(x) for x in names]), F.struct((F.col("mask") + copy).alias("mask"), *[(F.col(x) - F.col(f"pass_{x}")).alias(x) for x in names]))
    return per.select("part", F.explode(sides).alias("s")).select("part", "s.*").groupBy("part", "mask").agg(*[F.sum(x).alias(x) for x in names])


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source", filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every part, order and step.

    A null part is the empty string, a null text the empty text. A document without an id is no
    copy and makes none; rows with one id are not copies of each other; a label counts if any
    label row of the id sets it. An empty table gives no row. Texts of any length are read whole.
    """
    spark = docs.sparkSession
    names, ranks, k = ["docs", "good", "toxic"], factorial(len(filters)), len(filters)
    per = masks(docs, labels, text, key, part)
    # counts go in where an interval of orders begins and out where it ends
    spans = spark.createDataFrame(removals(filters), "mask int, step int, lo int, hi int")
    ends = per.join(F.broadcast(spans), "mask").select("part", "step", *names, F.explode(F.array(F.struct(F.col("lo").alias("rank"), F.lit(1).alias("sign")), F.struct(F.col("hi").alias("rank"), F.lit(-1).alias("sign")))).alias("e"))
    ends = ends.groupBy("part", "step", F.col("e.rank").alias("rank")).agg(*[F.sum(F.col(x) * F.col("e.sign")).alias(x) for x in names])
    # what a part holds, fails and fails alone
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("docs")).otherwise(0)) for i in range(k)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("docs")).otherwise(0)) for i in range(k)]
    parts = per.groupBy("part").agg(F.sum("docs").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    grid = parts.select("*", F.posexplode(F.array(*[F.lit(x) for x in orders(filters)])).alias("rank", "filter_order"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step")).withColumn("f", F.instr(F.lit(filters), F.substring("filter_order", F.col("step"), F.lit(1))))
    # the prefix sum over the ranks
    running = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = grid.join(ends, ["part", "step", "rank"], "left").withColumns({x: F.coalesce(F.sum(x).over(running), F.lit(0)) for x in names})
    before = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("docs").over(before)).alias("kept"),
        F.col("docs").alias("removed"),
        (F.element_at("fails", F.col("f")) - F.col("docs")).alias("redundant"),
        F.element_at("alone", F.col("f")).alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("docs").over(Window.partitionBy("part", "f")).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The same in SQL: every document meets every order.
ORACLE = rf"""
WITH raw AS (SELECT row_number() OVER () AS d, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
 w AS (SELECT *, regexp_extract_all(t, '{NOT_WHITE}+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM raw),
 f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(translate(t, '{UPPER}', ''))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(w.doc_id > first, false)] AS bad
  FROM w LEFT JOIN marks ON marks.doc_id = w.doc_id),
 m AS (SELECT part, bad, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
 l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
 o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
 g AS (SELECT *, list_filter([1, 2, 3, 4, 5], lambda s: bad[instr('ABCDE', filter_order[s])]) AS hit FROM m, o),
 s AS (SELECT *, coalesce(hit[1], 6) AS gone, unnest([1, 2, 3, 4, 5]) AS step FROM g),
 x AS (SELECT *, bad[instr('ABCDE', filter_order[step])] AS fails, len(list_filter(bad, lambda b: b)) AS many FROM s),
 r AS (SELECT part, filter_order, step, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN fails AND gone < step THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND many = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM r
"""
