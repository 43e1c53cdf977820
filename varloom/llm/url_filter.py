"""URL filters: a range join of addresses and nested host rules by sorting and one sweep."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import LOWER, UPPER, slots, table

# The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
#: Characters of an address that decide its range, addresses read per range to place the edges, ranges per task.
HEAD, PROBES, SPREAD = 200, 64, 4
#: After every label of a host that is written backwards; the next character ends the host's interval.
MARK = "."


def address(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty where there is no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(F.coalesce(rest, F.lit("")), F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.coalesce(path, F.lit(""))


def backwards(host: Column) -> Column:
    """The host's labels from the last to the first, each with its mark: a host and its subdomains are one interval of such keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), MARK), F.lit(MARK))


def ranged(edges: list[str]):
    """Column function: the number of edges at or before a key."""

    @F.pandas_udf("int")
    def number(key):
        return key.map(lambda k: bisect_right(edges, k)).astype("int32")

    return number


class Nest:
    """The stack of rules whose hosts hold the current key, outermost first: (key, sorted paths, each one's next shorter prefix, rules)."""

    def __init__(self):
        self.stack: list[tuple[str, list[str], list[int], list[tuple[int, str, str]]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def push(self, key: str, host: str, paths: list[tuple[str, str]]) -> None:
        self.move(key)
        paths = sorted(paths)
        above, open_ = [], []
        for i, (p, _) in enumerate(paths):
            while open_ and not p.startswith(paths[open_[-1]][0]):
                open_.pop()
            above.append(open_[-1] if open_ else -1)
            open_.append(i)
        self.stack.append((key, [p for p, _ in paths], above, [(len(host) + len(p), host + p, v) for p, v in paths]))

    def rule(self, path: str) -> tuple[int, str, str] | None:
        """The longest rule that fits; of two equally long ones that of the deeper host."""
        best = None
        for _, paths, above, rules in self.stack:
            i = bisect_right(paths, path) - 1
            while i >= 0 and not path.startswith(paths[i]):
                i = above[i]
            if i >= 0 and (best is None or rules[i][0] >= best[0]):
                best = rules[i]
        return best


def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range and key, rules before addresses. Columns: range, key, is_url, host, path, rules (path, verdict), row."""
    nest, now = Nest(), -1
    for batch in batches:
        number, keys, url = (batch.column(i) for i in (0, 1, 2))
        wanted = pc.indices_nonzero(url)
        found: list[tuple[int, str, str] | None] = []
        paths = batch.column(4)
        for i, (r, key, is_url) in enumerate(zip(number.to_pylist(), keys.to_pylist(), url.to_pylist())):
            if r != now:
                nest, now = Nest(), r
            if is_url:
                nest.move(key)
                found.append(nest.rule(paths[i].as_py()) if nest.stack else None)
            else:
                nest.push(key, batch.column(3)[i].as_py(), [(x["path"], x["verdict"]) for x in batch.column(5)[i].as_py()])
        if len(wanted):
            yield pa.RecordBatch.from_arrays([batch.column(6).take(wanted), batch.column(3).take(wanted), paths.take(wanted), pa.array([f and f[1] for f in found], pa.string()), pa.array([f and f[2] for f in found], pa.string())], ["row", "host", "path", "rule", "verdict"])


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), otherwise: str = "allow") -> DataFrame:
    """The kept columns of every row with host, path, rule and verdict; columns of these names give way.

    rules has host, path and verdict. The longest rule that fits decides, whatever the order of
    the rules; of equal rules block comes before allow. Rules without a host fit nothing. A null
    address, or one without ://, has an empty host and path and no rule, so its verdict is
    `otherwise`; repeated rows are judged alike, an empty table gives no row.
    Addresses and rules are dealt to key ranges, a rule to all that its interval meets; equal
    addresses are told apart by a hash, so a frequent one is many ranges. A task holds the
    rules of the hosts above the key it is at, no more. Edges only balance the ranges.
    """
    spark = pages.sparkSession
    kept = [c for c in keep if c not in ("host", "path", "rule", "verdict")]
    host, path = address(F.col(f"`{url}`"))
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"), F.xxhash64(*[F.col(f"`{c}`") for c in (*kept, url)], F.monotonically_increasing_id() % 64).alias("deal"))
    rows = rows.withColumn("key", backwards(F.col("host")))
    # what the ranges go by: the key, the path, and a number that parts equal addresses
    rows = rows.withColumn("head", F.concat(F.substring(F.concat("key", "path"), 1, HEAD), F.lit("\0"), F.lpad(F.hex("deal"), 16, "0")))
    ranges = SPREAD * slots(spark)
    share = min(1.0, PROBES * ranges / max(pages.count(), 1))
    probes = sorted(r["head"] for r in rows.select("head").sample(fraction=share, seed=13).toLocalIterator())
    edges = [probes[len(probes) * i // ranges] for i in range(1, ranges)] if probes else []
    number = ranged(edges)
    rows = rows.select(number("head").alias("range"), "key", F.lit(True).alias("is_url"), "host", "path", F.lit(None).cast("array<struct<path:string,verdict:string>>").alias("rules"), "row")
    hosts = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("host <> ''")
    hosts = hosts.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).groupBy("host").agg(F.collect_list(F.struct("path", "verdict")).alias("rules")).withColumn("key", backwards(F.col("host")))
    after = F.concat(F.substring("key", 1, HEAD), F.lit("\U0010ffff"))
    hosts = hosts.withColumn("range", F.explode(F.sequence(number(F.substring("key", 1, HEAD)), number(after))))
    hosts = hosts.select("range", "key", F.lit(False).alias("is_url"), "host", F.lit("").alias("path"), "rules", F.lit(None).cast(rows.schema["row"].dataType).alias("row"))
    both = rows.unionByName(hosts).repartition(slots(spark), "range").sortWithinPartitions("range", "key", "is_url")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, host string, path string, rule string, verdict string"
    out = both.mapInArrow(swept, schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


#: The same in SQL: every address against every rule.
ORACLE = """
WITH r(h, p, v) AS (VALUES """ + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + f"""),
 a AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 b AS (SELECT i, page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, rest FROM a),
 c AS (SELECT i, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b),
 hit AS (SELECT i, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM c LEFT JOIN hit USING (i)
"""
