"""Driver queries: the operators over the driver's tables, and the same in SQL.

Adapters turn the tables into the genomic schemas; their SQL runs in both engines and is the
first part of each oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import keys as K
from varloom.functions import labels as L
from varloom.functions.repeats import best_repeat
from varloom.functions.values import clipped, four_digits, known, shown
from varloom.operators import annotate, evidence, in_silico, nominate, phenotype, ranks, review, rna, score, vote
from varloom.operators.rubrics import rubric
from varloom.sources.sinks import todo

#: Rows of a table that a task gets where data() deals them.
TASK_ROWS = 200_000

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tasks_of(df: DataFrame) -> int:
    """How many tasks to deal a table to; with fewer than a shuffle has a join would deal it once more."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // TASK_ROWS + 1)


def data(spark: SparkSession, sf_dir: str, sql: str, by: list[str] | None = None) -> DataFrame:
    """Runs an adapter on the tables that it names in braces.

    by, expressions over its table, deals that first: what the adapter and the query group by
    these then stays where it is. Tasks get a number of rows that doesn't grow with the table.
    """
    names = {n for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations") if "{" + n + "}" in sql}
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    if by:
        frames = {n: df.repartition(tasks_of(df), *[F.expr(e) for e in by]) for n, df in frames.items()}
    return spark.sql(sql, **frames)


def plain(sql: str) -> str:
    """The adapter for SQL proper: table names without braces, doubled braces single, names in double quotes."""
    return re.sub(r"\{\{|\}\}|\{|\}", lambda m: m[0][:1] if len(m[0]) == 2 else "", sql).replace("`", '"')


def query(oracle: str, dealt: dict[str, list[str]] | None = None, **adapters: str):
    """Registers a function of the adapters' frames; the oracle sees each adapter as a CTE of its name. dealt: see data()."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(**{n: data(spark, sf_dir, s, (dealt or {}).get(n)) for n, s in adapters.items()})
        ORACLES[f.__name__] = "WITH " + ", ".join(f"{n} AS ({plain(s)})" for n, s in adapters.items()) + oracle
        return f

    return register


def rubric_sql(kind: str) -> str:
    """A reviewer's rubric as SQL text on a line of its own."""
    return "chr(10) || '" + rubric(kind).replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


VARIANT = "cast(l_partkey % 24 + 1 as string) || '_' || cast(l_orderkey as string) || '_' || substr('ACGT', cast(l_linenumber % 4 + 1 as int), 1) || '_' || substr('CGTA', cast(l_linenumber % 4 + 1 as int), 1)"
SAMPLE = "'S' || cast(l_suppkey as string)"
GENE = "case when l_partkey % 41 = 0 then '-' else 'G' || cast(l_partkey % 400 as string) end"

SCORED = f"""SELECT {SAMPLE} AS sample_id, {GENE} AS geneSymbol, {VARIANT} AS varId,
 case when l_linenumber % 3 = 0 then 1 else 0 end AS recessive, l_extendedprice AS overall_logit,
 l_extendedprice * l_discount AS score_InSilico, l_extendedprice * l_tax AS score_Database, l_quantity * (1 - l_discount) AS score_Genetics,
 case when l_orderkey % 499 = 0 then cast(0.000001 as double) when l_orderkey % 7 = 0 then null else l_discount end AS splice_p,
 case when l_partkey % 97 = 0 then cast(0.000002 as double) else l_tax end AS expr_p FROM {{lineitem}}"""

RANKED = """, p AS (SELECT sample_id, varId, max(overall_logit) AS a, max(score_InSilico) AS b, max(score_Database) AS c, max(score_Genetics) AS d FROM scored GROUP BY ALL),
r AS (SELECT sample_id, varId,
 count(*) OVER (PARTITION BY sample_id ORDER BY a DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS Diagnostic_Engine_Rank,
 count(*) OVER (PARTITION BY sample_id ORDER BY b DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_InSilico,
 count(*) OVER (PARTITION BY sample_id ORDER BY c DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_Database,
 count(*) OVER (PARTITION BY sample_id ORDER BY d DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rank_Genetics FROM p)"""


@query(
    RANKED
    + """, m AS (SELECT scored.*, Diagnostic_Engine_Rank, Diagnostic_Engine_Rank <= 20 AS r1,
 rank_InSilico <= 10 AND Diagnostic_Engine_Rank <= 100 AS r2, rank_Database <= 10 AND Diagnostic_Engine_Rank <= 100 AS r3,
 rank_Genetics <= 10 AND Diagnostic_Engine_Rank <= 100 AS r4,
 coalesce(splice_p < 0.00001, false) OR (coalesce(expr_p < 0.00001, false) AND Diagnostic_Engine_Rank <= 100) AS r5 FROM scored JOIN r USING (sample_id, varId)),
h AS (SELECT *, r1 OR r2 OR r3 OR r4 OR r5 AS hit FROM m),
g AS (SELECT sample_id, geneSymbol, count(DISTINCT varId) AS total, count(DISTINCT CASE WHEN hit THEN varId END) AS strong, bool_or(hit AND recessive = 1) AS rescue FROM h GROUP BY ALL)
SELECT sample_id, geneSymbol, varId, recessive, CAST(Diagnostic_Engine_Rank AS INT) AS Diagnostic_Engine_Rank, strong >= 1 AND total - strong >= 1 AS is_compound_het_group,
 concat_ws(', ', CASE WHEN r1 THEN 'Strong DNA Evidence' END, CASE WHEN r2 THEN 'Strong In-Silico Evidence' END, CASE WHEN r3 THEN 'Strong Database Evidence' END,
 CASE WHEN r4 THEN 'Strong Genetics Evidence' END, CASE WHEN r5 THEN 'Strong RNA Evidence' END,
 CASE WHEN strong >= 1 AND total - strong >= 1 THEN 'Compound Heterozygous (Compound Het)' END) AS evidence_rules
FROM h JOIN g USING (sample_id, geneSymbol) WHERE (hit OR rescue) AND geneSymbol <> '-'""",
    scored=SCORED,
)
def nominate_(scored: DataFrame) -> DataFrame:
    """For each sample, which variants are nominated and why."""
    df = ranks.max_ranks(scored, {"Diagnostic_Engine_Rank": "overall_logit", "rank_InSilico": "score_InSilico", "rank_Database": "score_Database", "rank_Genetics": "score_Genetics"})
    df = nominate.nominated(df, nominate.rules(splice="splice_p", expression="expr_p"))
    return df.select("sample_id", "geneSymbol", "varId", "recessive", "Diagnostic_Engine_Rank", "is_compound_het_group", "evidence_rules")


QUERIES["nominate"], ORACLES["nominate"] = QUERIES.pop("nominate_"), ORACLES.pop("nominate_")


@query(
    """, p AS (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS v FROM o GROUP BY ALL),
r AS (SELECT *, count(*) OVER (PARTITION BY o_custkey ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_rank FROM p)
SELECT o_orderkey, o_custkey, o_orderpriority, CAST(price_rank AS INT) AS price_rank FROM o JOIN r USING (o_custkey, o_orderpriority)""",
    o="SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM {orders}",
)
def rank_max_desc(o: DataFrame) -> DataFrame:
    return ranks.max_ranks(o, {"price_rank": "o_totalprice"}, "o_orderpriority", "o_custkey").select("o_orderkey", "o_custkey", "o_orderpriority", "price_rank")


@query(
    """, p AS (SELECT flag, key, max(quantity) AS q, max(price) AS v FROM l GROUP BY ALL),
r AS (SELECT *, CASE WHEN q IS NOT NULL THEN count(*) OVER (PARTITION BY flag ORDER BY q DESC NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS quantity_rank, count(*) OVER (PARTITION BY flag ORDER BY v DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price_rank FROM p)
SELECT flag, key, CAST(quantity_rank AS INT) AS quantity_rank, CAST(price_rank AS INT) AS price_rank FROM l JOIN r USING (flag, key)""",
    l="SELECT case when l_linestatus = 'O' then 'all' else l_returnflag end AS flag, cast(l_orderkey as string) || '_' || cast(l_linenumber as string) AS key, case when l_linenumber = 7 then null else l_quantity end AS quantity, l_extendedprice AS price FROM {lineitem}",
)
def rank_any_group(l: DataFrame) -> DataFrame:  # noqa: E741
    """Few groups, one with half of all rows, and a score that many rows share."""
    return ranks.ranks_of_any_size(l, {"quantity_rank": "quantity", "price_rank": "price"}, "key", "flag").select("flag", "key", "quantity_rank", "price_rank")


@query(
    """, s AS (SELECT *, coalesce(split_part(split_part(HGVSc, ':', 1), '.', 1), '-') AS transcript_id,
 coalesce(CASE WHEN contains(HGVSc, ':') THEN substr(HGVSc, instr(HGVSc, ':') + 1) END, '-') AS HGVSc_core FROM scores),
m AS (SELECT DISTINCT split_part(transcript_id, '.', 1) AS t FROM mane),
k AS (SELECT s.*, m.t IS NOT NULL AS is_mane, 4 * (m.t IS NOT NULL)::INT + 2 * coalesce(HGVSp <> '-', true)::INT + coalesce(HGVSc <> '-', true)::INT AS transcript_score FROM s LEFT JOIN m ON s.transcript_id = m.t),
n AS (SELECT *, row_number() OVER (PARTITION BY sample_id, varId, geneSymbol ORDER BY transcript_score DESC, HGVSc NULLS FIRST, HGVSp NULLS FIRST) AS n FROM k)
SELECT sample_id, varId, geneSymbol, transcript_id, HGVSc_core, HGVSp, is_mane, transcript_score FROM n WHERE n = 1""",
    scores=f"""SELECT {SAMPLE} AS sample_id, cast(l_orderkey as string) AS varId, {GENE} AS geneSymbol,
 case when l_linenumber % 5 = 0 then null when l_linenumber % 7 = 0 then '-' else 'T' || cast(l_partkey as string) || '.' || cast(l_linenumber as string) || ':c.' || cast(l_orderkey as string) end AS HGVSc,
 case when l_returnflag = 'R' then '-' when l_returnflag = 'A' then null else 'p.' || cast(l_linenumber as string) end AS HGVSp FROM {{lineitem}}""",
    mane="SELECT 'T' || cast(p_partkey as string) || '.9' AS transcript_id FROM {part} WHERE p_size < 10",
)
def best_row_per_pair(scores: DataFrame, mane: DataFrame) -> DataFrame:
    df = annotate.best_transcript(annotate.with_transcript(scores, mane), ["sample_id", "varId", "geneSymbol"])
    return df.select("sample_id", "varId", "geneSymbol", "transcript_id", "HGVSc_core", "HGVSp", "is_mane", "transcript_score")


@query(
    """, c AS (SELECT DISTINCT SampleID AS sample_id, (CASE WHEN regexp_replace(chr, '^chr', '') = 'M' THEN 'MT' ELSE regexp_replace(chr, '^chr', '') END) || '_' || pos || '_' || ref || '_' || alt AS varId FROM truth),
f AS (SELECT s.* FROM scores s WHERE geneSymbol IN (SELECT gene_name FROM genes WHERE gene_type = 'protein_coding'))
SELECT sample_id, geneSymbol, f.varId, price, (c.varId IS NOT NULL)::INT AS is_causal FROM f LEFT JOIN c USING (sample_id, varId)""",
    scores=f"SELECT {SAMPLE} AS sample_id, 'P' || cast(l_partkey as string) AS geneSymbol, {VARIANT} AS varId, l_extendedprice AS price FROM {{lineitem}}",
    genes="SELECT case when p_size < 25 then 'protein_coding' else 'lncRNA' end AS gene_type, 'P' || cast(p_partkey as string) AS gene_name FROM {part}",
    truth=f"SELECT {SAMPLE} AS SampleID, case when l_linenumber % 2 = 0 then 'chr' else '' end || cast(l_partkey % 24 + 1 as string) AS chr, cast(l_orderkey as string) AS pos, substr('ACGT', cast(l_linenumber % 4 + 1 as int), 1) AS ref, substr('CGTA', cast(l_linenumber % 4 + 1 as int), 1) AS alt FROM {{lineitem}} WHERE l_returnflag = 'R'",
)
def semi_label(scores: DataFrame, genes: DataFrame, truth: DataFrame) -> DataFrame:
    df = annotate.coding_only(scores, genes)
    return annotate.with_causal(df, annotate.truth_keys(truth), ["sample_id", "varId"]).select("sample_id", "geneSymbol", "varId", "price", "is_causal")


SPANS = "SELECT 'S' || cast(l_suppkey as string) AS sampleID, 'chr' || cast(l_partkey % 24 + 1 as string) AS seqnames, l_orderkey AS start, l_orderkey + l_linenumber * 40 AS end, '*' AS strand, case when l_linenumber = 5 then null else 'G' || cast(l_partkey % 400 as string) || ';G' || cast(l_suppkey % 400 as string) end AS hgnc_symbol, case when l_linenumber = 6 then null else l_discount + l_tax end AS pvaluesBetaBinomial_jaccard, l_quantity AS psi5 FROM {lineitem}"


@query(
    """, v AS (SELECT *, 'chr' || CASE split_part(varId, '_', 1) WHEN '23' THEN 'X' WHEN '24' THEN 'Y' ELSE split_part(varId, '_', 1) END AS Chromosome, CAST(split_part(varId, '_', 2) AS BIGINT) AS Pos FROM variants),
s AS (SELECT sampleID AS sample_id, seqnames AS Chromosome, start, "end", hgnc_symbol, pvaluesBetaBinomial_jaccard AS p, psi5 FROM spans WHERE hgnc_symbol IS NOT NULL),
g AS (SELECT sample_id, geneSymbol, min(p) AS gp FROM (SELECT sample_id, unnest(string_split(hgnc_symbol, ';')) AS geneSymbol, p FROM s) GROUP BY ALL),
h AS (SELECT v.sample_id, v.varId, s.start, s."end", s.p, s.psi5, row_number() OVER (PARTITION BY v.sample_id, v.varId ORDER BY s.p, s.start, s."end", s.psi5) AS n
 FROM (SELECT DISTINCT sample_id, varId, Chromosome, Pos FROM v) v JOIN s ON v.sample_id = s.sample_id AND v.Chromosome = s.Chromosome AND v.Pos BETWEEN s.start AND s."end" WHERE s.p IS NOT NULL),
e AS (SELECT sampleID AS sample_id, GeneSymbol, pValue, zScore FROM expression), a AS (SELECT sampleID AS sample_id, varId, REF_COUNT, PVAL FROM ase)
SELECT v.sample_id, v.geneSymbol, v.varId, v.Chromosome, v.Pos, round(e.pValue, 6) AS Outrider_pValue, round(e.zScore, 6) AS Outrider_zScore, round(g.gp, 6) AS Fraser_GenePvalue,
 h.start AS Fraser_junction_start, h."end" + 1 AS Fraser_junction_end, round(h.p, 6) AS Fraser_pvaluesBetaBinomial_jaccard, a.REF_COUNT AS ASE_REF_COUNT, round(a.PVAL, 6) AS ASE_PVAL
FROM v LEFT JOIN e ON v.sample_id = e.sample_id AND v.geneSymbol = e.GeneSymbol LEFT JOIN g ON v.sample_id = g.sample_id AND v.geneSymbol = g.geneSymbol
LEFT JOIN h ON v.sample_id = h.sample_id AND v.varId = h.varId AND h.n = 1 LEFT JOIN a ON v.sample_id = a.sample_id AND v.varId = a.varId""",
    dealt={n: [SAMPLE] for n in ("variants", "spans", "expression", "ase")},
    variants=f"SELECT {SAMPLE} AS sample_id, {GENE} AS geneSymbol, {VARIANT} AS varId FROM {{lineitem}}",
    spans=SPANS,
    expression="SELECT 'S' || cast(l_suppkey as string) AS sampleID, 'G' || cast(l_partkey % 400 as string) AS GeneSymbol, min(l_discount) AS pValue, max(l_tax) AS padjust, max(l_quantity) - 25 AS zScore, min(l_tax) AS l2fc, count(*) AS rawcounts FROM {lineitem} GROUP BY 1, 2",
    ase=f"SELECT {SAMPLE} AS sampleID, {VARIANT} AS varId, 'A' AS REF, 'C' AS ALT, cast(max(l_quantity) as int) AS REF_COUNT, cast(min(l_quantity) as int) AS ALT_COUNT, max(l_tax) AS ALT_RATIO, min(l_discount) AS PVAL, 1 AS IS_MAE FROM {{lineitem}} WHERE l_returnflag = 'A' GROUP BY 1, 2",
)
def enrich_left(variants: DataFrame, spans: DataFrame, expression: DataFrame, ase: DataFrame) -> DataFrame:
    df = nominate.enriched(variants, expression, spans, ase)
    r = lambda c: F.round(c, 6).alias(c)
    return df.select("sample_id", "geneSymbol", "varId", "Chromosome", "Pos", r("Outrider_pValue"), r("Outrider_zScore"), r("Fraser_GenePvalue"), "Fraser_junction_start", "Fraser_junction_end", r("Fraser_pvaluesBetaBinomial_jaccard"), "ASE_REF_COUNT", r("ASE_PVAL"))


@query(
    """, h AS (SELECT p.event_id, s.span_id, s.value, row_number() OVER (PARTITION BY p.event_id ORDER BY s.value, s.span_id) AS n FROM points p JOIN spans s ON p.user_id = s.user_id AND p.at BETWEEN s.start AND s.stop)
SELECT p.event_id, p.user_id, h.span_id, round(h.value, 6) AS value FROM points p LEFT JOIN h ON p.event_id = h.event_id AND h.n = 1""",
    points="SELECT event_id, user_id, cast(extract(epoch from ts) as bigint) AS at FROM {events} WHERE event_type <> 'error'",
    spans="SELECT event_id AS span_id, user_id, cast(extract(epoch from ts) as bigint) AS start, cast(extract(epoch from ts) as bigint) + 86400 AS stop, value FROM {events} WHERE event_type = 'error'",
)
def interval_best_hit(points: DataFrame, spans: DataFrame) -> DataFrame:
    hits = nominate.interval_hits(points, spans, ["user_id"], "at", "start", "stop")
    best = ranks.best_rows(hits, ["event_id"], [F.col("value").asc_nulls_last(), "span_id"]).select("event_id", "span_id", F.round("value", 6).alias("value"))
    return points.join(best, "event_id", "left").select("event_id", "user_id", "span_id", "value")


# the nearest whole second, as the SQL's cast of a fraction to a whole number takes it; unix_timestamp() would cut it off
SECONDS = "cast(rint(unix_micros(cast(ts as timestamp)) / 1000000D) as bigint)"
QUERIES["interval_best_hit"] = lambda spark, sf_dir: interval_best_hit(
    data(spark, sf_dir, f"SELECT event_id, user_id, {SECONDS} AS at FROM {{events}} WHERE event_type <> 'error'"),
    data(spark, sf_dir, f"SELECT event_id AS span_id, user_id, {SECONDS} AS start, {SECONDS} + 86400 AS stop, value FROM {{events}} WHERE event_type = 'error'"),
)


@query(
    " SELECT token, round(min(p_retailprice), 6) AS least FROM (SELECT unnest(string_split(p_name, ';')) AS token, p_retailprice FROM p WHERE p_name IS NOT NULL) GROUP BY token",
    p="SELECT replace(p_name, ' ', ';') AS p_name, p_retailprice, 1 AS one FROM {part}",
)
def min_per_token(p: DataFrame) -> DataFrame:
    return nominate.min_per_name(p, "p_name", "p_retailprice", ["one"], "token", "least").select("token", F.round("least", 6).alias("least"))


@query(
    """, u AS (SELECT * FROM a UNION ALL SELECT * FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM u)
SELECT o_custkey, o_orderkey, c_nationkey FROM n JOIN archive ON o_custkey = c_custkey WHERE n = 1""",
    a="SELECT o_custkey, o_orderkey FROM {orders} WHERE o_orderpriority < '3'",
    b="SELECT o_custkey, o_orderkey FROM {orders} WHERE o_totalprice > 100000",
    archive="SELECT c_custkey, c_nationkey FROM {customer} WHERE c_acctbal > 0",
)
def archive_match_dedupe(a: DataFrame, b: DataFrame, archive: DataFrame) -> DataFrame:
    first = ranks.best_rows(a.unionByName(b), ["o_custkey"], ["o_orderkey"])
    return first.join(archive, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", "c_nationkey")


@query(
    """, c AS (SELECT DISTINCT sample_id, varId FROM candidates WHERE r <= 100), f AS (SELECT features.* FROM features SEMI JOIN c USING (sample_id, varId)),
s AS (SELECT *, coalesce(min(FATHMM_score) OVER (PARTITION BY sample_id) < 0, false) AS low FROM f)
SELECT sample_id, varId, round(max(CADD_phred), 6) AS CADD_phred, round(max(CADD_PHRED_raw), 6) AS CADD_PHRED_raw, round(min(SIFT_score), 6) AS SIFT_score,
 round(CASE WHEN bool_or(low) THEN min(FATHMM_score) ELSE max(FATHMM_score) END, 6) AS FATHMM_score,
 max((cons_splice_acceptor_variant > 0 OR cons_splice_donor_variant > 0)::INT) AS is_splice, max((cons_frameshift_variant > 0)::INT) AS is_frameshift,
 round(greatest(max(CADD_phred), max(CADD_PHRED_raw)), 6) AS CADD_worst FROM s GROUP BY sample_id, varId""",
    features=f"SELECT {SAMPLE} AS sample_id, cast(l_orderkey as string) AS varId, l_quantity AS CADD_phred, case when l_linenumber = 2 then null else l_extendedprice end AS CADD_PHRED_raw, l_discount AS SIFT_score, case when l_suppkey % 2 = 0 then l_tax - 0.01 else l_tax end AS FATHMM_score, case when l_linenumber = 3 then 1 else 0 end AS cons_splice_acceptor_variant, case when l_linenumber = 4 then 1 else 0 end AS cons_splice_donor_variant, case when l_returnflag = 'R' then 1 else 0 end AS cons_frameshift_variant FROM {{lineitem}}",
    candidates=f"SELECT {SAMPLE} AS sample_id, cast(l_orderkey as string) AS varId, cast(l_partkey % 300 as int) AS r FROM {{lineitem}}",
)
def worst_directional(features: DataFrame, candidates: DataFrame) -> DataFrame:
    df = in_silico.worst_scores(features, candidates.filter("r <= 100"), ["CADD_phred", "CADD_PHRED_raw", "SIFT_score", "FATHMM_score"])
    return df.select("sample_id", "varId", *[F.round(c, 6).alias(c) for c in ("CADD_phred", "CADD_PHRED_raw", "SIFT_score", "FATHMM_score", "CADD_worst")], "is_splice", "is_frameshift")


@query(
    """, v AS (SELECT *, CASE WHEN lower(trim(name)) NOT IN ('', 'nan', 'none', 'null') THEN trim(name) END AS v FROM p)
SELECT p_brand, coalesce(arg_min(v, ord) FILTER (WHERE v IS NOT NULL), '') AS first_name, round(arg_min(price, ord) FILTER (WHERE price IS NOT NULL), 6) AS first_price, min(p_size) AS p_size FROM v GROUP BY p_brand""",
    p="SELECT p_brand, p_partkey AS ord, p_size, case when p_partkey % 3 = 0 then ' nan ' when p_partkey % 3 = 1 then '' else ' ' || p_name end AS name, case when p_partkey % 4 < 2 then null else p_retailprice end AS price FROM {part}",
)
def first_nonempty(p: DataFrame) -> DataFrame:
    names = p.groupBy("p_brand").agg(ranks.first_text(F.col("name"), F.col("ord")).alias("first_name"))
    values = rna.first_known(p, ["p_brand"], [F.col("ord")], ["price"], ["p_size"])
    return names.join(values.select("p_brand", F.round("price", 6).alias("first_price"), "p_size"), "p_brand")


@query(
    """, s AS (SELECT *, string_split(trim(key), '_') AS x FROM p)
SELECT p_partkey, x[1] AS chrom, TRY_CAST(x[2] AS BIGINT) AS pos, x[3] AS ref, array_to_string(x[4:], '_') AS alt,
 CASE WHEN regexp_replace(contig, '^chr', '') = 'M' THEN 'MT' ELSE regexp_replace(contig, '^chr', '') END AS bare,
 CASE WHEN lower(regexp_replace(contig, '^chr', '', 'i')) = 'x' THEN '23' WHEN lower(regexp_replace(contig, '^chr', '', 'i')) = 'y' THEN '24' ELSE regexp_replace(contig, '^chr', '', 'i') END AS coded,
 regexp_matches(contig, '^(chr([1-9]|1[0-9]|2[0-2]|X|Y))$', 'i') OR regexp_matches(contig, '^([1-9]|1[0-9]|2[0-4])$') AS usable,
 'chr' || CASE x[1] WHEN '23' THEN 'X' WHEN '24' THEN 'Y' ELSE x[1] END AS locus,
 split_part(split_part(hgvsc, ':', 1), '.', 1) AS transcript, CASE WHEN contains(hgvsc, ':') THEN substr(hgvsc, instr(hgvsc, ':') + 1) ELSE '-' END AS change FROM s""",
    p="""SELECT p_partkey, ' ' || cast(p_partkey % 26 + 1 as string) || '_' || case when p_size = 7 then 'x' else cast(p_partkey * 3 as string) end || '_' || substr(p_brand, 1, 3) || '_' || substr(p_type, 1, 4) || '_z ' AS key,
 case when p_partkey % 5 = 0 then 'M' when p_partkey % 5 = 1 then 'chrX' when p_partkey % 5 = 2 then 'CHRy' when p_partkey % 5 = 3 then 'chr' || cast(p_partkey % 26 as string) else cast(p_partkey % 26 as string) end AS contig,
 case when p_partkey % 2 = 0 then p_brand || '.' || cast(p_size as string) || ':c.' || cast(p_partkey as string) else p_brand || '.4' end AS hgvsc FROM {part}""",
)
def key_parse(p: DataFrame) -> DataFrame:
    x = K.key_parts(F.col("key"))
    c, h = F.col("contig"), F.col("hgvsc")
    return p.select("p_partkey", *[v.alias(n) for n, v in x.items()], K.bare_contig(c).alias("bare"), K.coded_contig(c).alias("coded"), K.is_coded_contig(c).alias("usable"), K.locus_contig(x["chrom"]).alias("locus"), K.transcript_of(h).alias("transcript"), K.change_of(h).alias("change"))


@query(
    """, f AS (SELECT *, CASE WHEN frequency = '-' THEN 0 WHEN frequency = 'HP:0040280' THEN 6.0 WHEN frequency = 'HP:0040283' THEN 0.17 * 6 WHEN right(frequency, 1) = '%' THEN TRY_CAST(replace(frequency, '%', '') AS DOUBLE) / 100 * 6 ELSE TRY_CAST(split_part(frequency, '/', 1) AS DOUBLE) END AS num,
 CASE WHEN frequency = '-' THEN 0 WHEN frequency LIKE '%/%' THEN CAST(split_part(frequency, '/', 2) AS DOUBLE) ELSE 6.0 END AS den, (frequency <> '-')::INT AS has FROM (SELECT gene_symbol, hpo_id, hpo_name, frequency FROM rows_)),
g AS (SELECT gene_symbol, hpo_id, min(hpo_name) AS name, sum(num) AS num, sum(den) AS den, max(has) AS has FROM f GROUP BY ALL),
e AS (SELECT *, name || CASE WHEN has = 1 AND den > 0 THEN ' (' || CASE WHEN num / den = 1 THEN 'Obligate' WHEN num / den = 0 THEN 'Excluded' WHEN num / den >= 0.8 AND num / den < 1 THEN 'Very frequent' WHEN num / den >= 0.3 AND num / den < 0.8 THEN 'Frequent' WHEN num / den >= 0.05 AND num / den < 0.3 THEN 'Occasional' ELSE 'Very rare' END || ')' ELSE ' (Frequency not specified)' END AS entry FROM g)
SELECT gene_symbol, string_agg(entry, ', ' ORDER BY hpo_id) AS phenotype_text FROM e GROUP BY gene_symbol""",
    rows_="""SELECT 'G' || cast(l_partkey % 400 as string) AS gene_symbol, 'HP:' || cast(l_suppkey % 30 + 100 as string) AS hpo_id, 'term' || cast(l_suppkey % 30 as string) AS hpo_name,
 case when l_linenumber = 1 then '-' when l_linenumber = 2 then 'HP:0040280' when l_linenumber = 3 then 'HP:0040283' when l_linenumber = 4 then cast(cast(l_quantity as int) as string) || '%' else cast(l_linenumber as string) || '/' || cast(cast(l_quantity as int) + 7 as string) end AS frequency FROM {lineitem}""",
)
def freq_pool(rows_: DataFrame) -> DataFrame:
    return phenotype.gene_terms(rows_)


@query(
    """, k AS (SELECT sample_id, ord, hpo_id, name FROM terms JOIN names ON hpo_id = id),
g AS (SELECT sample_id, count(*) AS n, max((hpo_id <> 'HP:0000001')::INT) AS real, string_agg(name, ', ' ORDER BY ord) AS t FROM k GROUP BY sample_id)
SELECT s.sample_id, coalesce(n, 0) AS n_terms, CASE WHEN real = 1 THEN t ELSE 'All' END AS term_text, coalesce(real, 0) AS has_terms FROM samples s LEFT JOIN g USING (sample_id)""",
    samples="SELECT DISTINCT cast(c_custkey as string) AS sample_id FROM {customer}",
    terms="SELECT cast(o_custkey as string) AS sample_id, o_orderkey AS ord, case when o_orderpriority < '2' then 'HP:0000001' else 'HP:' || cast(o_orderkey as string) end AS hpo_id FROM {orders}",
    names="SELECT 'HP:' || cast(p_partkey as string) AS id, p_name AS name FROM {part} UNION ALL SELECT DISTINCT 'HP:0000001' AS id, 'All' AS name FROM {region}",
)
def term_default(samples: DataFrame, terms: DataFrame, names: DataFrame) -> DataFrame:
    return phenotype.patient_terms(samples, terms, names)


@query(
    """, t AS (SELECT gene, array_agg(gene || ' causes ' || coalesce(lang, 'nan') || '.' || chr(10) || 'Clinical Features: ' || trim(replace(features, chr(10) || chr(10), chr(10))) ORDER BY doc_id) AS texts FROM d WHERE features IS NOT NULL GROUP BY gene),
m AS (SELECT c.gene, len(texts) AS n_texts, sha256(array_to_string(texts, '|')) AS digest FROM c LEFT JOIN t USING (gene)) SELECT gene, coalesce(n_texts, 0) AS n_texts, digest, (n_texts IS NULL)::INT AS skipped FROM m""",
    d="SELECT doc_id, 'G' || cast(cast(floor(doc_id / 4) as bigint) as string) AS gene, lang, text AS features FROM {documents}",
    c="SELECT DISTINCT 'G' || cast(cast(floor(doc_id / 4) as bigint) as string) AS gene FROM {documents} UNION SELECT 'B' || cast(item_id as string) AS gene FROM {benchmark}",
)
def text_map(d: DataFrame, c: DataFrame) -> DataFrame:
    texts = phenotype.disease_texts(d, "gene", "lang", "features", ["doc_id"])
    df = c.join(texts, "gene", "left")
    return df.select("gene", F.when(F.col("texts").isNull(), 0).otherwise(F.size("texts")).alias("n_texts"), F.sha2(F.concat_ws("|", "texts"), 256).alias("d"), F.col("texts").isNull().cast("int").alias("skipped")).withColumn("digest", F.when(F.col("skipped") == 0, F.col("d"))).drop("d")


@query(
    """, x AS (SELECT DISTINCT sample_id, geneSymbol FROM candidates WHERE geneSymbol NOT IN (SELECT geneSymbol FROM annotated)),
y AS (SELECT * FROM x EXCEPT SELECT sample_id, geneSymbol FROM finished) SELECT sample_id, geneSymbol FROM y""",
    candidates="SELECT c_mktsegment AS sample_id, cast(c_custkey as string) AS geneSymbol FROM {customer}",
    annotated="SELECT cast(o_custkey as string) AS geneSymbol FROM {orders} WHERE o_totalprice > 400000",
    finished="SELECT c_mktsegment AS sample_id, cast(c_custkey as string) AS geneSymbol FROM {customer} WHERE c_acctbal < 0",
)
def anti_genes(candidates: DataFrame, annotated: DataFrame, finished: DataFrame) -> DataFrame:
    return todo(phenotype.unannotated(candidates, annotated), finished, ["sample_id", "geneSymbol"])


KEYWORDS = ["est", "sich", "une", "Que", "are", "para"]


@query(
    """, t AS (SELECT *, concat_ws(' ', trim(title), trim(coalesce(abstract, ''))) AS text FROM p),
k AS (SELECT * FROM t WHERE regexp_full_match(PMID, '[0-9]+') AND trim(title) <> '' AND list_contains(regexp_split_to_array(text, '[^A-Za-z0-9_-]'), gene)
 AND regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(est|sich|une|que|are|para)([^\\p{L}\\p{N}_]|$)', 'i')),
f AS (SELECT *, row_number() OVER (PARTITION BY gene, PMID ORDER BY relevance, title) AS n FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY relevance, PMID) AS place FROM f WHERE n = 1)
SELECT gene, PMID, relevance, place FROM r WHERE place <= 50""",
    p="SELECT g.name AS gene, case when d.doc_id % 9 = 0 then 'x' else '' end || cast(d.doc_id as string) AS PMID, case when d.doc_id % 11 = 0 then null else substr(d.text, 1, 40) end AS title, d.text AS abstract, cast(d.n_chars as int) AS relevance FROM {documents} d JOIN (SELECT 'the' AS name, 'en' AS lang UNION ALL SELECT 'der' AS name, 'de' AS lang UNION ALL SELECT 'que' AS name, 'fr' AS lang UNION ALL SELECT 'and' AS name, 'en' AS lang) g ON d.lang = g.lang",
)
def pub_filter(p: DataFrame) -> DataFrame:
    return phenotype.publications(p, KEYWORDS).select("gene", "PMID", "relevance", "place")


@query(
    """, w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z0-9_-]+')) AS gene FROM t) SELECT doc_id, gene FROM w JOIN (SELECT DISTINCT gene FROM g) USING (gene)""",
    t="SELECT doc_id, text FROM {documents}",
    g="SELECT 'G' || cast(p_partkey as string) AS gene FROM {part} UNION ALL SELECT substr(text, 1, instr(text, ' ') - 1) AS gene FROM {documents} WHERE instr(text, ' ') > 1 AND NOT regexp_like(substr(text, 1, instr(text, ' ') - 1), '[^A-Za-z0-9_-]')",
)
def gene_mentions(t: DataFrame, g: DataFrame) -> DataFrame:
    """Every word that starts a document, and thousands of names more, in all documents of every language."""
    return phenotype.named_genes(t.groupBy("doc_id").agg(F.max("text").alias("text")), g, "doc_id", "text")


QUERIES["gene_mentions"], ORACLES["gene_mentions"] = QUERIES["gene_mentions"], ORACLES["gene_mentions"].replace("regexp_like(", "regexp_matches(")


@query(
    " SELECT id, line, CASE WHEN ref >= 50 AND alt >= 50 AND ref / alt > 1.2 THEN 1 WHEN ref >= 50 AND alt >= 50 AND ref / alt < 0.8 THEN -1 ELSE 0 END AS side FROM a",
    a="SELECT l_orderkey AS id, l_linenumber AS line, cast(l_quantity * 4 as double) AS ref, cast((l_suppkey % 7 + 1) * 20 as double) AS alt FROM {lineitem}",
)
def ratio_sides(a: DataFrame) -> DataFrame:
    return a.select("id", "line", L.ratio_side(F.col("ref"), F.col("alt")).alias("side"))


@query(
    """, n AS (SELECT quantile_disc(x, 0.5) AS mx, quantile_disc(y, 0.5) AS my, quantile_disc(z, 0.5) AS mz FROM r) SELECT 'x' AS name, mx AS median FROM n UNION ALL SELECT 'y', my FROM n UNION ALL SELECT 'z', mz FROM n""",
    r="SELECT cast(l_extendedprice as double) + cast(l_orderkey as double) / 1000003 AS x, cast(l_quantity as double) AS y, case when l_linenumber = 1 then cast(l_suppkey as double) end AS z FROM {lineitem}",
)
def exact_medians(r: DataFrame) -> DataFrame:
    """Distinct values, values that thousands of rows share, and mostly missing ones."""
    got = score.medians(r, ["x", "y", "z"])
    return r.sparkSession.createDataFrame(list(got.items()), "name string, median double")


@query(
    """, j AS (SELECT *, json_valid(response) AS fine FROM a),
v AS (SELECT gene, varId, cell, coalesce(CASE WHEN fine THEN response ->> 'Conclusion' END, 'Weak') AS conclusion, coalesce(CASE WHEN fine THEN response ->> 'Reasoning' END, 'parse_error') AS reasoning FROM j),
r AS (SELECT gene, varId, conclusion, reasoning, unnest(string_split(replace(cell, '\\t', chr(9)), chr(10))[2:]) AS line FROM v)
SELECT gene, varId, conclusion, reasoning, trim(split_part(line, chr(9), 1)) AS pmid, trim(split_part(line, chr(9), 2)) AS category FROM r WHERE lower(trim(split_part(line, chr(9), 2))) IN ('functional study', 'review', 'case report', 'patient cohort', 'phenotype association')""",
    a="""SELECT 'u' || cast(user_id as string) AS gene, cast(event_id as string) || '_1_A_C' AS varId,
 case when event_id % 5 = 0 then '{{' when event_id % 5 = 1 then '{{"Reasoning": "x"}}' else '{{"Reasoning": "r' || cast(event_id as string) || '", "Conclusion": "' || event_type || '"}}' end AS response,
 'PMID' || chr(92) || 'tCategory' || chr(92) || 'tNote' || chr(10) || cast(event_id as string) || chr(92) || 't Case report ' || chr(92) || 'tx' || chr(10) || cast(event_id + 1 as string) || chr(9) || case when event_id % 3 = 0 then 'REVIEW' else 'other' end || chr(9) || 'y' AS cell FROM {events}""",
)
def response_parse(a: DataFrame) -> DataFrame:
    gene, variant = K.entity_key(F.concat("gene", F.lit("_VarId_"), "varId"))
    df = evidence.parsed(a, "insilico").select(gene.alias("gene"), variant.alias("varId"), F.col("Conclusion").alias("conclusion"), F.col("Reasoning").alias("reasoning"), "cell")
    df = evidence.table_rows(df, ["gene", "varId", "conclusion", "reasoning"], "cell", ["pmid", "category", "note"])
    return evidence.in_categories(df, "category", evidence.CATEGORIES).drop("line", "note")


@query(
    """, t AS (SELECT varId, string_agg(CASE WHEN length(text) > 3000 THEN substr(text, 1, 3000) || '...' ELSE text END, chr(10) || '---' || chr(10) ORDER BY ord) AS submissions FROM s WHERE text IS NOT NULL GROUP BY varId),
m AS (SELECT p.*, coalesce(t.submissions, 'No submissions were found.') AS submissions FROM p LEFT JOIN t USING (varId)),
q AS (SELECT varId, 'Variant ' || varId || '; coding change ' || change || '.' || chr(10) || 'Submissions:' || chr(10) || submissions || chr(10) || 'Answer with one JSON object with the keys "reasoning", "conclusion", "zygosity" and nothing else.' || chr(10)
 || 'conclusion: one of Against | Neutral | Supporting | Convincing.' || chr(10) || 'zygosity: one of homozygous | compound_heterozygous | heterozygous | no_information.' || """
    + rubric_sql("database")
    + """ AS prompt,
 CASE WHEN x IS NULL THEN 'NA' WHEN abs(x) >= 10 THEN printf('%.2f', x) ELSE regexp_replace(regexp_replace(printf('%.4f', x), '0+$', ''), '\\.$', '') END AS shown_x FROM m)
SELECT varId, sha256(prompt) AS prompt_sha256, shown_x, '("' || varId || '"[Title/Abstract]) AND (variant[Title/Abstract] OR variants[Title/Abstract] OR mutation[Title/Abstract] OR mutations[Title/Abstract] OR diagnosis[Title/Abstract] OR mendelian[Title/Abstract] OR cause[Title/Abstract] OR causes[Title/Abstract])' AS search FROM q""",
    p="SELECT cast(p_partkey as string) AS varId, p_brand AS change, case when p_partkey % 6 = 0 then null when p_partkey % 6 < 4 then p_size / 8.0 else p_retailprice end AS x FROM {part}",
    s="SELECT cast(cast(floor(doc_id / 3) as bigint) as string) AS varId, doc_id AS ord, text FROM {documents}",
)
def prompt_render(p: DataFrame, s: DataFrame) -> DataFrame:
    df = p.join(evidence.submissions(s, "varId", "ord", "text"), "varId", "left")
    prompt = evidence.database_prompt(F.col("varId"), F.col("change"), F.col("submissions"))
    return df.select("varId", F.sha2(prompt, 256).alias("prompt_sha256"), shown(F.col("x")).alias("shown_x"), phenotype.search_text(F.col("varId")).alias("search"))


@query(
    """, c AS (SELECT chrom, start, stop, count(*) FILTER (WHERE harmful) AS n_harmful, count(*) FILTER (WHERE benign) AS n_benign FROM (SELECT DISTINCT chrom, start, stop FROM r) r JOIN v USING (chrom) WHERE v.at BETWEEN start AND stop GROUP BY ALL),
g AS (SELECT gene, min(h) AS haploinsufficiency FROM dosage GROUP BY gene)
SELECT r.id, r.line, chrom, start, stop, coalesce(n_harmful, 0) AS n_harmful, coalesce(n_benign, 0) AS n_benign, round(CASE WHEN n_benign > 0 THEN n_harmful / n_benign END, 6) AS ratio, coalesce(haploinsufficiency, '') AS haploinsufficiency FROM r LEFT JOIN c USING (chrom, start, stop) LEFT JOIN g ON upper(r.gene) = g.gene""",
    r="SELECT l_orderkey AS id, l_linenumber AS line, cast(l_partkey % 24 + 1 as string) AS chrom, l_orderkey AS start, l_orderkey + l_linenumber * 100 AS stop, 'g' || cast(l_partkey % 50 as string) AS gene FROM {lineitem}",
    v="SELECT cast(o_custkey % 24 + 1 as string) AS chrom, o_orderkey AS at, o_orderstatus = 'F' AS harmful, o_orderstatus = 'O' AS benign FROM {orders}",
    dosage="SELECT 'G' || cast(p_partkey % 40 as string) AS gene, p_brand AS h FROM {part}",
)
def region_burden(r: DataFrame, v: DataFrame, dosage: DataFrame) -> DataFrame:
    df = rna.burden(r, v, ["chrom"], "start", "stop", "at", "harmful", "benign", ["id", "line", "gene"])
    d = dosage.select(F.col("gene").alias("GENE SYMBOL"), F.col("h").alias("HAPLOINSUFFICIENCY"), F.col("h").alias("TRIPLOSENSITIVITY"))
    return rna.dosage_of(df, d, "gene").select("id", "line", "chrom", "start", "stop", "n_harmful", "n_benign", F.round("ratio", 6).alias("ratio"), "haploinsufficiency")


@query(
    """, g AS (SELECT supp, site, count(*) FILTER (WHERE returned) AS h, count(*) FILTER (WHERE NOT returned) AS b FROM p GROUP BY ALL), s AS (SELECT *, sum(h) OVER w AS hs, sum(b) OVER w AS bs FROM g WINDOW w AS (PARTITION BY supp ORDER BY site)),
x AS (SELECT id, r.supp, start, stop, e.hs AS eh, e.bs AS eb FROM r ASOF LEFT JOIN s e ON r.supp = e.supp AND r.stop >= e.site), y AS (SELECT x.*, o.hs AS oh, o.bs AS ob FROM x ASOF LEFT JOIN s o ON x.supp = o.supp AND x.start > o.site)
SELECT id, supp, start, stop, CAST(coalesce(eh, 0) - coalesce(oh, 0) AS BIGINT) AS n_harmful, CAST(coalesce(eb, 0) - coalesce(ob, 0) AS BIGINT) AS n_benign FROM y""",
    r="SELECT o_orderkey AS id, o_custkey % 3 AS supp, o_orderkey - o_custkey AS start, o_orderkey + o_custkey * 10 AS stop FROM {orders}",
    p="SELECT l_suppkey % 3 AS supp, l_orderkey AS site, l_returnflag = 'R' AS returned FROM {lineitem}",
)
def region_prefix_counts(r: DataFrame, p: DataFrame) -> DataFrame:
    """Three contigs only, and regions that hold a large part of all points."""
    df = rna.burden(r, p.withColumn("kept", ~F.col("returned")), ["supp"], "start", "stop", "site", "returned", "kept", ["id"])
    return df.select("id", "supp", "start", "stop", "n_harmful", "n_benign")


@query(
    """, n AS (SELECT chrom, pos, upper(base) AS base, count(*) AS n FROM b GROUP BY ALL),
o AS (SELECT DISTINCT varId, chrom, pos, ref, alt FROM v),
x AS (SELECT varId, chrom, pos, ref, alt, side, i, upper(substr(allele, i, 1)) AS base FROM (SELECT *, unnest(['ref', 'alt']) AS side, unnest([ref, alt]) AS allele FROM o) t, LATERAL (SELECT unnest(range(1, length(allele) + 1)) AS i) u),
s AS (SELECT x.*, CASE WHEN x.base IN ('A', 'C', 'G', 'T') THEN coalesce(n.n, 0) ELSE 0 END AS n FROM x LEFT JOIN n ON x.chrom = n.chrom AND n.pos = x.pos + x.i - 1 AND n.base = x.base)
SELECT varId, chrom, pos, ref, alt, CAST(max(n) FILTER (WHERE side = 'ref') AS DOUBLE) AS ref_count_max, round(avg(n) FILTER (WHERE side = 'ref'), 6) AS ref_count_mean, CAST(min(n) FILTER (WHERE side = 'ref') AS DOUBLE) AS ref_count_min,
 CAST(max(n) FILTER (WHERE side = 'alt') AS DOUBLE) AS alt_count_max, round(avg(n) FILTER (WHERE side = 'alt'), 6) AS alt_count_mean, CAST(min(n) FILTER (WHERE side = 'alt') AS DOUBLE) AS alt_count_min FROM s GROUP BY ALL""",
    v="SELECT cast(l_orderkey as string) || '_' || cast(l_linenumber as string) AS varId, cast(l_partkey % 5 as string) AS chrom, l_orderkey % 3000 AS pos, substr('ACGTNACGT', cast(l_linenumber % 5 + 1 as int), cast(l_quantity % 4 + 1 as int)) AS ref, substr('GATTACA', cast(l_linenumber % 4 + 1 as int), cast(l_suppkey % 3 + 1 as int)) AS alt FROM {lineitem}",
    b="SELECT cast(o_custkey % 5 as string) AS chrom, o_orderkey % 3000 AS pos, substr('acgtTGCA', cast(o_custkey % 8 + 1 as int), 1) AS base FROM {orders}",
)
def allele_support(v: DataFrame, b: DataFrame) -> DataFrame:
    df = rna.allele_support(v, b, ["varId"])
    return df.select("varId", "chrom", "pos", "ref", "alt", *[F.round(f"{s}_count_{k}", 6).alias(f"{s}_count_{k}") for s in ("ref", "alt") for k in ("max", "mean", "min")])


@query(
    """, t AS (SELECT doc_id, x, unnest(range(0, greatest(length(x), 1), 30)) AS o FROM w), v AS (SELECT doc_id, o, upper(substr(x, CAST(o AS BIGINT) + 1, 61)) AS s FROM t),
k AS (SELECT *, unnest(range(1, 7)) AS k FROM v), c AS (SELECT *, unnest(range(1, length(s) - 3 * k + 2)) AS st FROM k WHERE length(s) >= 3 * k),
m AS (SELECT *, substr(s, st, k) AS motif FROM c WHERE substr(s, st, k) = substr(s, st + k, k) AND substr(s, st, k) = substr(s, st + 2 * k, k)),
r AS (SELECT *, list_count(list_filter(range(1, CAST((length(s) - st + 1) / k AS INT) + 2), lambda j: CASE WHEN substr(s, st, k * j) = repeat(motif, j) AND length(substr(s, st, k * j)) = k * j THEN true ELSE false END)) AS copies FROM m WHERE regexp_full_match(motif, '[A-Z]+') AND NOT contains(motif, 'N')),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY copies DESC, k, o + st) AS n FROM r WHERE copies >= 3)
SELECT doc_id, motif, CAST(copies AS INT) AS copies, CAST(o + st AS INT) AS motif_start FROM b WHERE n = 1""",
    w="SELECT doc_id, replace(replace(replace(coalesce(text, ''), 'ß', 'ss'), ' ', ''), '.', '') AS x FROM {documents}",
)
def tandem_repeat(w: DataFrame) -> DataFrame:
    """The best repeat of every whole text, found in windows of 61 that overlap by half."""
    cells = w.select("doc_id", "x", F.explode(F.sequence(F.lit(0), F.greatest(F.length("x") - 1, F.lit(0)), F.lit(30))).alias("o")).select("doc_id", "o", F.substring(F.col("x"), F.col("o") + 1, F.lit(61)).alias("s"))
    found = best_repeat(cells, ["doc_id", "o"], "s")
    best = found.groupBy("doc_id").agg(F.min(F.struct((-F.col("copies")).alias("c"), F.length("motif").alias("k"), (F.col("o") + F.col("motif_start")).alias("at"), "motif")).alias("b"))
    return best.select("doc_id", "b.motif", (-F.col("b.c")).cast("int").alias("copies"), F.col("b.at").cast("int").alias("motif_start"))


@query(
    """, k AS (SELECT doc_id, x, unnest(range(1, 7)) AS k FROM w), m AS (SELECT doc_id, x, k, unnest(list_filter(range(1, length(x) - 3 * k + 2), lambda i: substr(x, i, k) = substr(x, i + k, k) AND substr(x, i, k) = substr(x, i + 2 * k, k) AND regexp_full_match(substr(x, i, k), '[A-MO-Z]+'))) AS st FROM k WHERE length(x) >= 3 * k),
r AS (SELECT doc_id, k, st, substr(x, st, k) AS motif, length(regexp_extract(substr(x, st), '^(' || substr(x, st, k) || ')+')) // k AS copies FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY copies DESC, k, st) AS n FROM r)
SELECT doc_id, motif, CAST(copies AS INT) AS copies, CAST(st AS INT) AS motif_start FROM b WHERE n = 1""",
    w="SELECT c_custkey AS doc_id, upper(replace(replace(replace(c_name || c_mktsegment || c_mktsegment || c_mktsegment || 'ATATATATCACACACA' || c_mktsegment, '#', ''), '0', 'A'), '1', 'AC')) AS x FROM {customer}",
)
def period_runs(w: DataFrame) -> DataFrame:
    """The best repeat of each row's text, whole."""
    return best_repeat(w, ["doc_id"], "x").select("doc_id", "motif", "copies", "motif_start")


@query(
    """, f AS (SELECT *, coalesce(vs <= 0.1, false) AS splice_variant, coalesce(gs <= 0.1, false) AS splice_gene, coalesce(abs(z) >= 1.5, false) AS outlier, coalesce(ase <= 0.1, false) AS ase_ FROM r)
SELECT id, line, splice_variant, splice_gene, outlier, ase_ AS ase_hit, outlier OR splice_gene AS gene_report, splice_variant OR ase_ AS variant_report, CAST(printf('%.3e', z) AS DOUBLE) AS z FROM f WHERE splice_variant OR splice_gene OR outlier OR ase_""",
    r="SELECT l_orderkey AS id, l_linenumber AS line, case when l_linenumber = 1 then null else l_discount + 0.05 end AS vs, case when l_linenumber = 2 then null else l_tax + 0.06 end AS gs, case when l_linenumber = 3 then null else (l_quantity - 25.0) / 14.0 end AS z, case when l_linenumber = 4 then null else l_tax * 2 + 0.05 end AS ase FROM {lineitem}",
)
def rna_gate(r: DataFrame) -> DataFrame:
    df = rna.gated(r.withColumnRenamed("ase", "ase_p"), "vs", "gs", "z", "ase_p")
    return df.select("id", "line", "splice_variant", "splice_gene", "outlier", F.col("ase").alias("ase_hit"), "gene_report", "variant_report", four_digits(F.col("z")).alias("z"))


CANDIDATES = f"""SELECT {SAMPLE} AS sample_id, 'G' || cast(l_partkey % 300 as string) AS geneSymbol, cast(l_partkey % 24 + 1 as string) || '_' || cast(l_orderkey as string) || '_A_C' AS varId,
 cast(min(l_linenumber) as string) AS transcript_id, min(l_linenumber) % 2 AS recessive, min(l_suppkey) % 2 AS dominant, case when min(l_linenumber) = 1 then 2 else 1 end AS zyg,
 case when min(l_partkey) % 24 = 22 then 'chrX' else 'chr1' end AS Chromosome, min(l_linenumber) % 3 AS cons_frameshift_variant, case when max(l_returnflag) = 'R' then 'p.A1Ter' else 'p.A1C' end AS HGVSp, 'c.1' AS HGVSc,
 min(l_partkey) % 37 = 0 AS has_repeat_motif, min(l_orderkey) % 1000 AS Diagnostic_Engine_Rank, min(l_partkey) % 200 AS rank_InSilico,
 case when min(l_orderkey) % 5 = 0 then 'Compound Heterozygous (Compound Het)' when min(l_orderkey) % 5 = 1 then 'Strong RNA Evidence' else 'Strong DNA Evidence' end AS evidence_rules,
 max(l_quantity) * 2 AS ref_count_mean, max(l_quantity) * 2 - min(l_linenumber) * 8 AS alt_count_mean, case when min(l_linenumber) > 3 then 0 else 5 end AS alt_count_min,
 case when min(l_orderkey) % 4 = 0 then 'Supporting' when min(l_orderkey) % 4 = 1 then 'Neutral' when min(l_orderkey) % 4 = 2 then 'Against' else null end AS Database_Conclusion,
 case when min(l_orderkey) % 7 = 0 then 'heterozygous' when min(l_orderkey) % 7 = 1 then 'homozygous' when min(l_orderkey) % 7 = 2 then 'compound_heterozygous' else null end AS Database_Zygosity,
 case when min(l_partkey) % 3 = 0 then 'Not Fit' when min(l_partkey) % 3 = 1 then 'Good Fit' else null end AS Literature_Conclusion,
 case when min(l_partkey) % 8 = 0 then 'Impossible' else 'Partial Fit' end AS OMIM_Conclusion, case when min(l_partkey) % 4 = 0 then 'Good_Fit' when min(l_partkey) % 4 = 1 then 'partially fit' else null end AS HPO_Conclusion,
 case when min(l_suppkey) % 3 = 0 then 'Strong RNA Evidence' when min(l_suppkey) % 3 = 1 then 'Weak RNA Evidence' else null end AS RNA_GeneLevel_Conclusion,
 case when min(l_suppkey) % 4 = 0 then 'Strong RNA Evidence' else null end AS RNA_VarLevel_Conclusion, case when min(l_orderkey) % 3 = 0 then 'Strong' else 'Moderate' end AS Insilico_Conclusion
 FROM {{lineitem}} GROUP BY 1, 2, 3"""

TIERED = """, t0 AS (SELECT *, NOT coalesce(ref_count_mean > 20 AND alt_count_min = 0, false) AS misscall_rna_flag,
 NOT (coalesce(Literature_Conclusion = 'Not Fit', false) AND (Database_Conclusion IS NULL OR Database_Conclusion IN ('Neutral', 'Against'))) AS new_diseasegene_flag,
 OMIM_Conclusion IS DISTINCT FROM 'Impossible' AS omim_flag,
 NOT (evidence_rules = 'Compound Heterozygous (Compound Het)' OR (evidence_rules IN ('Strong RNA Evidence', 'Strong RNA Evidence, Compound Heterozygous (Compound Het)') AND RNA_GeneLevel_Conclusion IS DISTINCT FROM 'Strong RNA Evidence' AND RNA_VarLevel_Conclusion IS DISTINCT FROM 'Strong RNA Evidence')) AS strong_nom_flag FROM c),
t1 AS (SELECT *, CASE WHEN misscall_rna_flag AND new_diseasegene_flag AND omim_flag AND strong_nom_flag AND NOT has_repeat_motif THEN 1 ELSE 2 END AS Tier0, cons_frameshift_variant = 1 AND contains(HGVSp, 'Ter') AS frame_shift FROM t0),
t2 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY Tier0, Diagnostic_Engine_Rank, varId, geneSymbol) AS new_rank FROM t1)"""

PARTNERED = """, side AS (SELECT *, CASE WHEN ref_count_mean >= 50 AND alt_count_mean >= 50 AND ref_count_mean / alt_count_mean > 1.2 THEN 1 WHEN ref_count_mean >= 50 AND alt_count_mean >= 50 AND ref_count_mean / alt_count_mean < 0.8 THEN -1 ELSE 0 END AS side,
 row_number() OVER (PARTITION BY sample_id, geneSymbol ORDER BY new_rank) AS gn FROM t2),
lead_ AS (SELECT * FROM side WHERE gn = 1 AND (recessive = 1 OR coalesce(Database_Zygosity IN ('compound_heterozygous', 'compound heterozygous'), false)) AND zyg = 1 AND Database_Zygosity IS DISTINCT FROM 'heterozygous'),
met AS (SELECT l.sample_id, l.geneSymbol, l.varId AS a, o.varId AS b, l.Tier0 AS tier, row_number() OVER (PARTITION BY l.sample_id, l.geneSymbol ORDER BY o.new_rank) AS n FROM lead_ l JOIN side o ON l.sample_id = o.sample_id AND l.geneSymbol = o.geneSymbol AND l.varId <> o.varId
 WHERE (coalesce(o.Database_Conclusion IN ('Supporting', 'Convincing'), false) OR coalesce(o.RNA_GeneLevel_Conclusion = 'Strong RNA Evidence', false) OR coalesce(o.RNA_VarLevel_Conclusion = 'Strong RNA Evidence', false) OR o.frame_shift OR o.new_rank <= 50) AND NOT (l.side <> 0 AND l.side = o.side)),
pr AS (SELECT sample_id, geneSymbol, a AS varId, b AS partner, NULL AS lt FROM met WHERE n = 1 UNION ALL SELECT sample_id, geneSymbol, b, a, tier FROM met WHERE n = 1),
t3 AS (SELECT t2.*, coalesce(pr.partner, '') AS partner, pr.partner IS NOT NULL AS find_compound_het, coalesce(pr.lt, Tier0) AS Tier1 FROM t2 LEFT JOIN pr USING (sample_id, geneSymbol, varId)),
t4 AS (SELECT *, CASE WHEN zyg = 1 AND Chromosome <> 'chrX' AND NOT find_compound_het AND (coalesce(Database_Zygosity IN ('homozygous', 'compound_heterozygous', 'compound heterozygous'), false) OR (recessive = 1 AND dominant = 0 AND Database_Zygosity IS DISTINCT FROM 'heterozygous')) THEN 3 ELSE Tier1 END AS Tier FROM t3)"""


def reviewed(c: DataFrame) -> DataFrame:
    df = review.tiered(c, ["Diagnostic_Engine_Rank", "varId", "geneSymbol"])
    return review.demoted(review.partnered(df))


@query(TIERED + " SELECT sample_id, geneSymbol, varId, misscall_rna_flag, new_diseasegene_flag, omim_flag, strong_nom_flag, Tier0 AS Tier, CAST(new_rank AS INT) AS new_rank, frame_shift FROM t2", c=CANDIDATES)
def review_tier(c: DataFrame) -> DataFrame:
    return review.tiered(c, ["Diagnostic_Engine_Rank", "varId", "geneSymbol"]).select("sample_id", "geneSymbol", "varId", "misscall_rna_flag", "new_diseasegene_flag", "omim_flag", "strong_nom_flag", "Tier", "new_rank", "frame_shift")


@query(TIERED + PARTNERED + " SELECT sample_id, geneSymbol, varId, partner, find_compound_het, Tier FROM t4", c=CANDIDATES)
def partner_search(c: DataFrame) -> DataFrame:
    return reviewed(c).select("sample_id", "geneSymbol", "varId", "partner", "find_compound_het", "Tier")


VOTERS = CANDIDATES.replace("'G' || cast(l_partkey % 300 as string)", "'G' || cast(l_partkey % 12 as string)")

VOTED = """, n AS (SELECT *, lower(replace(HPO_Conclusion, '_', ' ')) AS h FROM t4 WHERE Tier = 1),
m AS (SELECT sample_id, geneSymbol, varId, trim(partner) AS partner, HGVSc, CAST(Diagnostic_Engine_Rank AS DOUBLE) AS rk, CASE h WHEN 'good fit' THEN 2.0 WHEN 'partially fit' THEN 1.0 ELSE 0.0 END AS ph,
 CASE Database_Conclusion WHEN 'Neutral' THEN 1.0 WHEN 'Supporting' THEN 2.0 WHEN 'Convincing' THEN 3.0 ELSE 0.0 END AS cl,
 greatest(CASE RNA_GeneLevel_Conclusion WHEN 'Strong RNA Evidence' THEN 2.0 WHEN 'Weak RNA Evidence' THEN 1.0 ELSE 0.0 END, CASE RNA_VarLevel_Conclusion WHEN 'Strong RNA Evidence' THEN 2.0 ELSE 0.0 END) AS rn,
 frame_shift::INT::DOUBLE AS fs, CASE WHEN rank_InSilico <= 100 THEN CASE Insilico_Conclusion WHEN 'Strong' THEN 3.0 ELSE 2.0 END ELSE 0.0 END AS si FROM n),
pv AS (SELECT a.*, 'COMPOUND::' || a.sample_id || '|' || upper(a.geneSymbol) || '|CH|' || least(a.varId, a.partner) || '|' || greatest(a.varId, a.partner) AS gid FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.geneSymbol = b.geneSymbol AND a.partner = b.varId WHERE a.partner <> ''),
ok AS (SELECT gid FROM pv GROUP BY gid HAVING count(DISTINCT varId) > 1),
e AS (SELECT m.*, coalesce(pv.gid, 'SINGLE::' || m.sample_id || '::' || m.geneSymbol || '::' || m.varId) AS eid, (pv.gid IS NOT NULL) AS comp,
 row_number() OVER (PARTITION BY m.sample_id, coalesce(pv.gid, m.geneSymbol || m.varId) ORDER BY m.rk, m.ph DESC, m.cl DESC, m.rn DESC, m.fs DESC, m.varId) AS wn FROM m LEFT JOIN (SELECT * FROM pv WHERE gid IN (SELECT gid FROM ok)) pv ON m.sample_id = pv.sample_id AND m.geneSymbol = pv.geneSymbol AND m.varId = pv.varId),
g AS (SELECT sample_id, eid, comp, avg(rk) AS mrk, avg(ph) AS mph, avg(cl) AS mcl, avg(rn) AS mrn, avg(fs) AS mfs, avg(si) AS msi, max(rk) FILTER (WHERE wn = 1) AS brk, max(ph) FILTER (WHERE wn = 1) AS bph, max(cl) FILTER (WHERE wn = 1) AS bcl, max(rn) FILTER (WHERE wn = 1) AS brn, max(fs) FILTER (WHERE wn = 1) AS bfs, max(si) FILTER (WHERE wn = 1) AS bsi FROM e GROUP BY ALL),
x AS (SELECT a.sample_id, a.eid AS ea, b.eid AS eb, a.comp AND b.comp AS duo, CASE WHEN duo THEN a.mrk ELSE a.brk END AS ark, CASE WHEN duo THEN b.mrk ELSE b.brk END AS brk, CASE WHEN duo THEN a.mph ELSE a.bph END AS aph, CASE WHEN duo THEN b.mph ELSE b.bph END AS bph,
 CASE WHEN duo THEN a.mcl ELSE a.bcl END AS acl, CASE WHEN duo THEN b.mcl ELSE b.bcl END AS bcl, CASE WHEN duo THEN a.mrn ELSE a.brn END AS arn, CASE WHEN duo THEN b.mrn ELSE b.brn END AS brn, CASE WHEN duo THEN a.mfs ELSE a.bfs END AS afs, CASE WHEN duo THEN b.mfs ELSE b.bfs END AS bfs, CASE WHEN duo THEN a.msi ELSE a.bsi END AS asi, CASE WHEN duo THEN b.msi ELSE b.bsi END AS bsi
 FROM g a JOIN g b ON a.sample_id = b.sample_id AND a.eid < b.eid),
y AS (SELECT *, (ark < brk)::INT + (aph > bph)::INT + (acl > bcl)::INT + (arn > brn)::INT + (afs > bfs)::INT AS va, (brk < ark)::INT + (bph > aph)::INT + (bcl > acl)::INT + (brn > arn)::INT + (bfs > afs)::INT AS vb FROM x),
z AS (SELECT *, CASE WHEN va > vb THEN 'A' WHEN vb > va THEN 'B' WHEN asi > bsi THEN 'A' WHEN bsi > asi THEN 'B' WHEN ark < brk THEN 'A' WHEN brk < ark THEN 'B' ELSE 'tie' END AS winner,
 CASE WHEN va <> vb THEN '' WHEN asi <> bsi THEN 'tie_break_by_insilico' WHEN ark <> brk THEN 'tie_break_by_rank' ELSE 'full_tie' END AS tie_breaker FROM y)"""


@query(
    TIERED + PARTNERED + VOTED + """, w AS (SELECT sample_id, ea AS eid, (winner = 'A')::INT AS w, (winner = 'B')::INT AS l, (winner = 'tie')::INT AS t FROM z UNION ALL SELECT sample_id, eb, (winner = 'B')::INT, (winner = 'A')::INT, (winner = 'tie')::INT FROM z),
s AS (SELECT g.sample_id, g.eid, g.mrk, coalesce(sum(w), 0) AS wins, coalesce(sum(l), 0) AS losses, coalesce(sum(t), 0) AS ties FROM g LEFT JOIN w ON g.sample_id = w.sample_id AND g.eid = w.eid GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY wins - losses DESC, wins DESC, losses, mrk, eid) AS er FROM s)
SELECT e.sample_id, geneSymbol, varId, CAST(wins - losses AS BIGINT) AS PairWiseScore, CAST(wins AS BIGINT) AS PairWiseWins, CAST(losses AS BIGINT) AS PairWiseLosses, CAST(ties AS BIGINT) AS PairWiseTies, CAST(er AS INT) AS PairWiseEntityRank, CAST(wn AS INT) AS PairWiseWithinEntityRank,
 e.eid AS pairwise_entity_id, CASE WHEN comp THEN 'compound' ELSE 'single' END AS pairwise_entity_type, CASE WHEN comp THEN substr(e.eid, 11) ELSE '' END AS compound_het_group_id FROM e JOIN o ON e.sample_id = o.sample_id AND e.eid = o.eid""",
    dealt={"c": [SAMPLE]},
    c=VOTERS,
)
def pairwise_vote(c: DataFrame) -> DataFrame:
    return vote.pairwise(reviewed(c), (1,))[0]


def copeland_tally(c: DataFrame) -> DataFrame:
    """pairwise_vote without any pair."""
    return vote.pairwise(reviewed(c), (1,), log=False)[0]


QUERIES["copeland_tally"] = lambda spark, sf_dir: copeland_tally(data(spark, sf_dir, VOTERS, [SAMPLE]))
ORACLES["copeland_tally"] = ORACLES["pairwise_vote"]


@query(TIERED + PARTNERED + VOTED + " SELECT sample_id, ea AS A_entity, eb AS B_entity, va AS votes_A, vb AS votes_B, 6 - va - vb AS votes_tie, winner, tie_breaker FROM z", dealt={"c": [SAMPLE]}, c=VOTERS)
def pairwise_log(c: DataFrame) -> DataFrame:
    return vote.log(reviewed(c), (1,)).select("sample_id", F.col("A_pairwise_entity_id").alias("A_entity"), F.col("B_pairwise_entity_id").alias("B_entity"), "votes_A", "votes_B", "votes_tie", "winner", "tie_breaker")


@query(
    """, n AS (SELECT *, TRY_CAST(size AS DOUBLE) AS x FROM p), f AS (SELECT quantile_disc(x, 0.5) AS m, stddev_pop(x) AS s FROM n)
SELECT p_partkey, round((coalesce(x, m) - m) / s, 6) AS size_standard, (p_brand = 'Brand#11')::INT::DOUBLE AS brand_11, (p_brand = 'Brand#23')::INT::DOUBLE AS brand_23 FROM n, f""",
    p="SELECT p_partkey, p_brand, case when p_partkey % 10 = 0 then 'x' else cast(p_size as string) end AS size FROM {part}",
)
def standardise_onehot(p: DataFrame) -> DataFrame:
    fitted = score.fit_standard(p, ["size"])["size"]
    a, b = score.one_hot(F.col("p_brand"), ["Brand#11", "Brand#23"])
    return p.select("p_partkey", F.round(score.standard(F.col("size"), *fitted), 6).alias("size_standard"), a.alias("brand_11"), b.alias("brand_23"))


def formula_weights(width: int) -> dict:
    """Weights out of formulas, so that SQL can repeat them: hidden sums of every second feature."""
    import numpy as np

    even = (np.arange(width) % 2 == 0).astype(float)[:, None]
    layers = [(np.concatenate([even, 1 - even], axis=1), np.array([0.1, -0.1])), (np.array([[1.0, 0.5], [-0.5, 1.0]]), np.zeros(2))]
    domain = {"layers": layers, "head": (np.array([[1.0], [-1.0]]), np.array([0.25]))}
    return {"domains": {"even": domain, "all": {"layers": [(np.ones((width, 2)), np.array([0.0, 0.5])), (np.eye(2), np.zeros(2))], "head": (np.array([[0.5], [0.5]]), np.zeros(1))}}, "fusion": [(np.array([[1.0], [1.0], [0.5], [0.5]]), np.array([-0.2]))], "out": (np.array([[2.0]]), np.array([-1.0]))}


@query(
    """, a AS (SELECT vec_id, list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i % 2 = 1 THEN v[i] ELSE 0.0 END)) AS ev, list_sum(v) AS al FROM e),
h AS (SELECT vec_id, greatest(ev + 0.1, 0) AS h1, greatest(al - ev - 0.1, 0) AS h2, greatest(al, 0) AS g1, greatest(al + 0.5, 0) AS g2 FROM a),
k AS (SELECT *, greatest(h1 - 0.5 * h2, 0) AS k1, greatest(0.5 * h1 + h2, 0) AS k2 FROM h),
l AS (SELECT vec_id, 2 * greatest(k1 + k2 + 0.5 * g1 + 0.5 * g2 - 0.2, 0) - 1 AS overall_logit, k1 - k2 + 0.25 AS score_even, 0.5 * g1 + 0.5 * g2 AS score_all FROM k)
SELECT vec_id, round(overall_logit, 4) AS overall_logit, round(1 / (1 + exp(-overall_logit)), 4) AS overall_prob, round(score_even, 4) AS score_even, round(score_all, 4) AS score_all FROM l""",
    e="SELECT vec_id, cast(embedding as double[]) AS v FROM {embeddings}",
)
def moe_score(e: DataFrame) -> DataFrame:
    width = e.agg(F.max(F.size("v"))).first()[0] or 1
    df = score.moe_scores(e, {"even": ["v"], "all": ["v"]}, formula_weights(width))
    return df.select("vec_id", *[F.round(c, 4).alias(c) for c in ("overall_logit", "overall_prob", "score_even", "score_all")])


QUERIES["moe_score"] = lambda spark, sf_dir: moe_score(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("v")))


def scan_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table written as CSV, tab-separated gzip and Parquet by sample, read again and joined."""
    import uuid

    from varloom.sources import sinks, tables

    root = f"{sinks.shared_folder(spark)}/formats-{uuid.uuid4().hex}"
    part = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("sample_id", F.concat(F.lit("S"), (F.col("p_partkey") % 4).cast("string")))
    sinks.write_by_sample(part.select("sample_id", "p_partkey", "p_brand"), f"{root}/parquet")
    part.select("p_partkey", "p_size").write.option("header", True).csv(f"{root}/out.csv")
    part.select(F.col("p_type").alias("geneSymbol"), F.col("p_partkey").alias("varId"), F.col("p_name").alias("HGVSc"), F.col("p_brand").alias("HGVSp"), "p_size").write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(f"{root}/S/scores")
    a, b = spark.read.parquet(f"{root}/parquet"), tables.by_extension(spark, f"{root}/out.csv")
    c = tables.scores(spark, f"{root}/S/scores", r"/([^/]+)/scores/[^/]+$")
    return a.join(b, "p_partkey").join(c.select(F.col("varId").cast("long").alias("p_partkey"), "geneSymbol", F.col("sample_id").alias("folder")), "p_partkey").select("p_partkey", "sample_id", "p_brand", F.col("p_size").cast("int").alias("p_size"), F.col("geneSymbol").alias("p_type"), "folder")


QUERIES["scan_formats"] = scan_formats
ORACLES["scan_formats"] = "SELECT p_partkey, 'S' || CAST(p_partkey % 4 AS VARCHAR) AS sample_id, p_brand, p_size, p_type, 'S' AS folder FROM part"
