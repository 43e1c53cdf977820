"""Quality rules as a short-circuit cascade, ordered by rejections per cost on a sample."""

from __future__ import annotations

import time
from math import floor, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import NOT_WHITE, WHITE, table, words

#: Rows on which costs and selectivities are estimated, and runs of each estimate. They decide the order of the rules, never a verdict.
SAMPLE_ROWS, RUNS = 1500, 3


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(w: Column) -> Column:
    """A hash of every three words in a row."""
    hashes = lambda v: F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))
    return let(w, lambda v: F.when(F.size(v) < 3, F.array().cast("array<bigint>")).otherwise(hashes(v)))


def covered(keys: Column) -> Column:
    """Words in the 3-word windows whose key occurs more than once."""
    order = F.array_sort(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
    # every window that equals its neighbour in this order repeats
    starts = let(order, lambda s: F.transform(F.filter(s, lambda x, j: (F.get(s, j - 1)["k"] == x["k"]) | (F.get(s, j + 1)["k"] == x["k"])), lambda x: x["i"]))
    return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))


def repeat_words(w: Column, over: Column | None = None) -> Column:
    """Words in windows found twice or more; given a bound, at most the bound's order is told: 0 where it can't be passed.

    Windows that repeat are at most twice those that are not new, and each covers three words,
    so most texts are decided without sorting.
    """
    spare = lambda k: F.size(k) - F.size(F.array_distinct(k))
    return let(windows(w), lambda k: F.when(6 * spare(k) <= (F.lit(0) if over is None else over), F.lit(0)).otherwise(covered(k)))


def text_lines(t: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_WHITE))


def measure(t: Column) -> dict[str, Column]:
    """Each count of a text (not null) as an expression of its own."""
    return {
        "n_words": F.size(words(t)),
        "word_chars": F.length(F.regexp_replace(t, f"{WHITE}+", "")),
        "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")),
        "n_upper": F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")),
        "n_lines": F.size(text_lines(t)),
        "n_dup_lines": let(text_lines(t), lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(words(t)),
    }


#: Counts that every row of the query has, whatever the verdict.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(docs: DataFrame, text: str = "text", prefix: str = "", names: tuple[str, ...] | None = None) -> DataFrame:
    """Adds counts of the text, all by default. Null or empty text: all are 0."""
    m = measure(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.withColumns({f"{prefix}{k}": m[k].cast("long") for k in names or m})


def rules(t: Column, ready: dict[str, Column]) -> dict[str, Column]:
    """Name -> condition under which a text (not null) is rejected; counts that are not ready are measured in the condition itself."""
    m = measure(t) | ready
    n = m["n_words"]
    repeated = m["n_repeat_words"] if "n_repeat_words" in ready else repeat_words(words(t), F.floor(n / 2))
    return {
        "too_short": n < 50,
        "word_length": let(m["word_chars"], lambda c: (c < 3 * n) | (c > 10 * n)),
        "symbols": 10 * m["n_symbols"] > n,
        "capitals": 10 * m["n_upper"] > 3 * m["word_chars"],
        "repeated_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "repeated_words": 100 * repeated > 50 * n,
    }


def ordered(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, cost, share rejected) on a sample, best rejection per cost first.

    A cost is the seconds that the sample takes with the rule less those without any, the least
    of RUNS runs, to a power of four, so that noise seldom turns the order; ties stand as
    written. An empty table gives the rules as written. The order changes the work of the
    cascade, never its verdict: a text is kept when no rule rejects it.
    """
    total = docs.count()
    sample = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).sample(fraction=min(1.0, sample_rows / max(total, 1)), seed=7)
    sample = sample.withColumn("n", F.size(words(F.col("t")))).repartition(2).persist()
    try:
        rows = max(sample.count(), 1)

        def timed(hit: Column) -> tuple[float, int]:
            took = []
            for _ in range(RUNS):
                began = time.perf_counter()
                hits = sample.agg(F.sum(hit.cast("int")).alias("n")).first()["n"] or 0
                took.append(time.perf_counter() - began)
            return min(took), hits

        idle = timed(F.col("n") < 0)[0]
        seen = []
        for name, rejects in rules(F.col("t"), {"n_words": F.col("n")}).items():
            took, hits = timed(rejects)
            seen.append((name, 4.0 ** floor(log2(max(took - idle, 1e-3)) / 2), hits / rows))
    finally:
        sample.unpersist()
    return sorted(seen, key=lambda x: -x[2] / x[1])


def cascade(t: Column, ready: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule that rejects, or null: one CASE, so what a rule measures is measured only if no rule before it rejects."""
    checks = rules(t, ready)
    first = F.when(checks[order[0]], F.lit(order[0]))
    for name in order[1:]:
        first = first.when(checks[name], F.lit(name))
    return first


def verdicts(docs: DataFrame, text: str = "text", order: list[str] | None = None, prefix: str = "", counts: tuple[str, ...] = ("n_words",)) -> DataFrame:
    """Adds the counts asked for, rejected_by (the first rule of the cascade that rejects, or null) and kept.

    Counts asked for are measured for every row and used by the rules; all others inside the
    cascade only. rejected_by depends on the order, which `order` fixes; kept doesn't. Null and
    empty texts have no word and are rejected; rows are judged alone, so ties and repeats are
    judged alike. Columns of docs with the names of results are replaced (see prefix).
    """
    order = order or [x[0] for x in ordered(docs, text)]
    counts = ("n_words", *[c for c in counts if c != "n_words"])
    df = measures(docs.withColumn("__t", F.coalesce(F.col(f"`{text}`"), F.lit(""))), "__t", prefix, counts)
    first = cascade(F.col("__t"), {c: F.col(f"{prefix}{c}") for c in counts}, order)
    return df.withColumn(f"{prefix}rejected_by", first).withColumn(f"{prefix}kept", F.col(f"{prefix}rejected_by").isNull()).drop("__t")


def keep(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that no rule rejects, with their own columns only."""
    own = [f"`{c}`" for c in docs.columns]
    # rows go by an empty array, as a filter would be pushed below the count of words and repeat it inside itself
    kept = F.explode(F.when(F.col("__q_kept"), F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    return verdicts(docs, text, prefix="__q_").select(*own, kept.alias("__q_row")).drop("__q_row")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return verdicts(docs, counts=BASE).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM k WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) AS n_upper,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_symbols > n_words
        OR 10 * n_upper > 3 * word_chars OR 10 * n_dup_lines > 3 * n_lines AS rejected FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept FROM f
"""
