"""What the findings of round 3 named, on small tables of their own."""

from __future__ import annotations

import glob
import os
import re

import duckdb

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from varloom import plan_queries, queries  # noqa: F401
from varloom.functions import repeats
from varloom.operators import ranks, rna, vote
from varloom.plans import cohort


def beside(spark, name: str, folder) -> tuple[list, list]:
    """Sorted rows of a query and of its SQL over the parquet files of a folder."""
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = queries.QUERIES[name](spark, str(folder))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
    return sorted(map(tuple, got.collect()), key=repr), sorted(want, key=repr)


def write(folder, **tables: str) -> None:
    for name, sql in tables.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")


def test_interval_seconds_are_rounded_and_missing_values_come_last(spark, tmp_path):
    # 10.6 is second 11 and so inside of an interval from 11.2; 2.5 is second 2 and 3.5 second 4; a day ends at 86411 with 86411.4
    write(tmp_path, events="""SELECT * FROM (VALUES (1, TIMESTAMP '2024-01-01 00:00:10.6', 1, 'view', 1.0), (2, TIMESTAMP '2024-01-01 00:00:11.2', 1, 'error', 5.0), (3, TIMESTAMP '2024-01-02 00:00:11.4', 1, 'view', 1.0), (4, TIMESTAMP '2024-01-02 00:00:11.6', 1, 'view', 1.0),
        (5, TIMESTAMP '2024-01-01 00:00:02.5', 2, 'view', 1.0), (6, TIMESTAMP '2024-01-01 00:00:03.5', 2, 'error', 1.0), (7, TIMESTAMP '2024-01-01 00:00:03.6', 2, 'view', 1.0),
        (8, TIMESTAMP '2024-01-01 00:00:01', 3, 'error', NULL), (9, TIMESTAMP '2024-01-01 00:00:02', 3, 'error', 7.0), (10, TIMESTAMP '2024-01-01 00:00:03', 3, 'view', 1.0)) t(event_id, ts, user_id, event_type, value)""")
    got, want = beside(spark, "interval_best_hit", tmp_path)
    assert got == want
    assert {r[0]: r[2] for r in got} == {1: 2, 3: 2, 4: None, 5: None, 7: 6, 10: 9}


def test_dimension_files_hold_every_part(spark, tmp_path):
    write(tmp_path, part="SELECT i AS p_partkey, 'n' || i AS p_name, 'b' || i AS p_brand, 't' || i AS p_type, i % 50 + 1 AS p_size FROM range(1, 60) r(i) UNION ALL SELECT i * 800 + 1, 'n', 'b', 't', i + 1 FROM range(1, 20) r(i)",
        supplier="SELECT i AS s_suppkey, i % 3 AS s_nationkey FROM range(1, 7) r(i)", nation="SELECT i AS n_nationkey, 'N' || i AS n_name FROM range(3) r(i)")
    got, want = beside(spark, "dimension_files", tmp_path)
    assert got == want
    # one row per gene, of which those whose number is 5 more than a multiple of 16 were left out
    assert sum(r[0] == "gene_phenotype" for r in got) == 59 and ("gene_phenotype", "G5", "HP:6=-") in got


def test_a_prompt_is_made_once_for_samples_with_the_same_terms(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    form = F.udf(seen, StringType()).asNondeterministic()
    found = spark.sql("SELECT 'S' || s.id AS sample_id, 'G' || g.id AS geneSymbol FROM range(40) s, range(3) g")
    terms = spark.sql("SELECT 'S' || id AS sample_id, 0 AS ord, 'HP:' || (id % 2) AS hpo_id FROM range(39)")
    names = spark.sql("SELECT 'HP:' || id AS id, 'n' || id AS name FROM range(2)")
    gp = spark.sql("SELECT 'G0' AS gene_symbol, 'HP:1' AS hpo_id, 'n1' AS hpo_name, '-' AS frequency")
    diseases = spark.sql("SELECT 'G1' AS gene_symbol, 'p' AS Phenotypes, 'f' AS `Clinical Features`")
    triage = spark.sql(r"SELECT 'G' || id AS geneSymbol, 'PMID\tTitle\tCategory\n7\tt\tReview' AS response FROM range(3)")
    parts = spark.sql("SELECT '7' AS PMID, 1 AS part, 'a' AS text")
    t = cohort.phenotype_tables(found, terms, names, gp, diseases)
    hpo, omim, skipped = cohort.phenotype_prompts(t, form)
    # two sets of terms and that of the sample without any
    for df, rows, kinds in ((hpo, 120, 9), (omim, 40, 3), (cohort.literature_prompts(t, gp, triage, parts, form), 80, 6)):
        made.value = 0
        got = df.collect()
        assert len(got) == rows and made.value == kinds
        assert len({r["prompt"] for r in got}) == kinds and all(f"Gene {r['geneSymbol']}:" in r["prompt"] for r in got)
    assert {r["n_skipped"] for r in skipped.collect()} == {2} and skipped.count() == 40


def test_small_and_large_samples_are_tallied_alike(spark):
    rows = spark.sql("""SELECT CASE WHEN id < 4 THEN 'S1' ELSE 'S2' END AS sample_id, 'e' || id AS pairwise_entity_id, 'single' AS pairwise_entity_type, 'v' || id AS best_member, 'v' || id AS member_variant_ids,
        struct(cast(id % 3 AS double) AS diag_rank, cast(id % 2 AS double) AS pheno_score, 1D AS clinvar_score, 0D AS rna_score, 1D AS inheritance_match, 0D AS frameshift, cast(id % 4 AS double) AS insilico_score, '' AS pheno_label, '' AS clinvar_label, '' AS rna_label, '' AS insilico_label) AS best FROM range(11)""").withColumn("mean", F.col("best"))
    # of the two samples one goes by its pairs, the other by running counts
    got, want = vote.tally(rows, 4), vote.tallied(rows, vote.compared(rows))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def moves(df, column: str) -> int:
    """Exchanges of a plan that carry a column."""
    parts = re.split(r"\n\n+", df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
    return sum(bool(re.match(r"\(\d+\) (Broadcast)?Exchange", p) and re.search(rf"Input.*\b{column}#", p)) for p in parts)


def test_variants_move_once_to_their_reads(spark):
    # an allele that reaches over covered and uncovered places, one without bases, a missing one, a repeated row and one of unknown place
    v = spark.sql("SELECT * FROM VALUES ('s', 'a', '1', 10L, 'ACGTN', 'c'), ('s', 'a', '1', 10L, 'ACGTN', 'c'), ('s', 'b', '1', 10L, '', NULL), ('s', 'c', '1', 12L, 'g', 'ga'), ('t', 'd', '1', 10L, 'A', 'AC'), ('t', 'e', '2', CAST(NULL AS BIGINT), 'A', 'C') t(sample_id, varId, chrom, pos, ref, alt)")
    reads = {("s", 10, "a"): 3, ("s", 10, "C"): 2, ("s", 11, "C"): 5, ("s", 12, "G"): 4, ("s", 12, "N"): 9, ("s", 14, "T"): 7, ("t", 11, "c"): 6}
    b = spark.createDataFrame([(s, "1", p, x) for (s, p, x), n in reads.items() for _ in range(n)], "sample_id string, chrom string, pos long, base string")
    df = rna.allele_support(v, b, ["sample_id", "varId"])
    got = {r["varId"]: tuple(r)[6:] for r in df.collect()}
    assert df.count() == 5 and got == {"a": (5.0, 2.4, 0.0, 2.0, 2.0, 2.0), "b": (None,) * 6, "c": (4.0, 4.0, 4.0, 4.0, 2.0, 0.0), "d": (0.0, 0.0, 0.0, 6.0, 3.0, 0.0), "e": (0.0,) * 6}
    assert moves(df, "varId") == 1


def test_candidates_move_once_to_their_reads(spark):
    found = spark.sql("SELECT * FROM VALUES ('s', '1_10_A_C', 'g', 't'), ('s', '1_10_A_C', 'h', 't'), ('s', '1_x_A_C', 'g', 't'), (NULL, '1_10_A_C', 'g', 't') f(sample_id, varId, geneSymbol, transcript_id)")
    bases = spark.sql("SELECT * FROM VALUES ('s', '1', 10L, 'a'), ('s', '1', 10L, 'A'), ('s', '1', 10L, 'C') b(sample_id, chrom, pos, base)")
    df = cohort.allele_counts(found, bases)
    assert sorted(((r["sample_id"] or "", r["varId"], r["geneSymbol"], r["ref_count_max"], r["alt_count_mean"]) for r in df.collect()), key=repr) == [("", "1_10_A_C", "g", None, None), ("s", "1_10_A_C", "g", 2.0, 1.0), ("s", "1_10_A_C", "h", 2.0, 1.0), ("s", "1_x_A_C", "g", None, None)]
    assert moves(df, "transcript_id") <= 1 and moves(df, "varId") <= 1


def test_a_report_writes_no_pair(spark, monkeypatch):
    def fail(found):
        raise AssertionError("pairs were made")

    rows = spark.sql("""SELECT CASE WHEN id < 6 THEN 'S1' ELSE 'S2' END AS sample_id, 'e' || id AS pairwise_entity_id, CASE WHEN id % 3 = 0 THEN 'compound' ELSE 'single' END AS pairwise_entity_type, 'v' || id AS best_member, 'v' || id AS member_variant_ids,
        struct(CASE WHEN id = 4 THEN double('inf') ELSE cast(id % 3 AS double) END AS diag_rank, cast(id % 2 AS double) AS pheno_score, CASE WHEN id % 5 > 0 THEN 1D END AS clinvar_score, 0D AS rna_score, 1D AS inheritance_match, 0D AS frameshift, cast(id % 4 AS double) AS insilico_score, '' AS pheno_label, '' AS clinvar_label, '' AS rna_label, '' AS insilico_label) AS best FROM range(14)""")
    rows = rows.withColumn("mean", F.col("best").withField("diag_rank", F.col("best.pheno_score")))
    want = sorted(map(tuple, vote.tallied(rows, vote.compared(rows)).collect()))
    monkeypatch.setattr(vote, "compared", fail)
    assert sorted(map(tuple, vote.tally(rows).collect())) == want


def test_windows_take_from_the_chunks_that_they_need(spark):
    points = spark.sql("SELECT '1' AS chrom, 95L AS pos UNION ALL SELECT '2', 10L UNION ALL SELECT '1', 500L")
    reference = spark.range(0, 1000).select(F.lit("1").alias("chrom"), (F.col("id") * 100).alias("chunk_start"), F.repeat(F.lit("acgt"), 25).alias("seq"))
    got = {(r["chrom"], r["pos"]): r["sequence"] for r in repeats.windows_at(points, reference, 100).collect()}
    assert got == {("1", 95): ("ACGT" * 99)[64:125], ("2", 10): "", ("1", 500): ("ACGT" * 199)[469:530]}


def test_candidates_leave_unused_columns_behind_and_are_not_joined_back(spark):
    v = spark.sql("SELECT 's' AS sample_id, 'g' AS geneSymbol, '1_' || id || '_A_C' AS varId, 1 AS recessive, cast(id * 30 AS int) AS Diagnostic_Engine_Rank, 50 AS rank_InSilico, 50 AS rank_Database, 50 AS rank_Genetics FROM range(3) UNION ALL SELECT 's', 'h', '1_0_A_C', 0, 0, 50, 50, 50")
    j = spark.sql("SELECT 's' AS sampleID, 'chr1' AS seqnames, 0L AS start, 5L AS end, '*' AS strand, 'g;h' AS hgnc_symbol, 0.5D AS pvaluesBetaBinomial_jaccard, 0.25D AS psi5 UNION ALL SELECT 's', 'chr1', 1L, 5L, '*', 'g', 0.125D, 0.75D UNION ALL SELECT 's', 'chr1', 1L, 5L, '*', 'g', 0.125D, 0.5D")
    e = spark.sql("SELECT 's' AS sampleID, 'g' AS GeneSymbol, 1D AS pValue, 1D AS padjust, 0D AS zScore, 0D AS l2fc, 1L AS rawcounts")
    a = spark.sql("SELECT 's' AS sampleID, '1_0_A_C' AS varId, 'A' AS REF, 'C' AS ALT, 1 AS REF_COUNT, 1 AS ALT_COUNT, 1D AS ALT_RATIO, 0.5D AS PVAL, 1 AS IS_MAE")
    df = cohort.candidates(v, e, j, a)
    got = sorted((r["geneSymbol"], r["varId"], r["Fraser_pvaluesBetaBinomial_jaccard"], r["Fraser_psi5"], r["Fraser_GenePvalue"], r["is_compound_het_group"]) for r in df.collect())
    assert got == [("g", "1_0_A_C", 0.5, 0.25, 0.125, True), ("g", "1_1_A_C", 0.125, 0.5, 0.125, True), ("g", "1_2_A_C", 0.125, 0.5, 0.125, True), ("h", "1_0_A_C", 0.5, 0.25, 0.5, False)]
    narrow = df.select("varId", "Fraser_pvaluesBetaBinomial_jaccard", "evidence_rules")
    assert "psi5" not in narrow._jdf.queryExecution().optimizedPlan().toString()
    assert narrow._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 5


LINES = """SELECT i // 3 AS l_orderkey, i % 7 AS l_partkey, i % 2 AS l_suppkey, i % 6 + 1 AS l_linenumber, (i % 50)::DOUBLE AS l_quantity, (i % 11) / 100.0::DOUBLE AS l_discount, (i % 9) / 100.0::DOUBLE AS l_tax, chr((65 + i % 3)::INT) AS l_returnflag, 'O' AS l_linestatus FROM range(400) r(i)"""


def test_rows_of_rna_prompts_stay_where_their_table_was_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rna, "CELL", 5)
    write(tmp_path, lineitem=LINES, part="SELECT i AS p_partkey, 'b' || i AS p_brand, 't' || i AS p_type FROM range(5) r(i)",
        orders="SELECT i AS o_orderkey, i % 7 AS o_custkey, CASE WHEN i % 3 = 0 THEN 'F' ELSE 'O' END AS o_orderstatus FROM range(900) r(i)")
    got, want = beside(spark, "rna_variant_prompts", tmp_path)
    assert got == want and len(got) > 100
    df = queries.QUERIES["rna_variant_prompts"](spark, str(tmp_path))
    assert moves(df, "Fraser_psi5") == 0 and moves(df, "l_quantity") == 1


def test_regions_over_many_cells_are_counted(spark, monkeypatch):
    monkeypatch.setattr(rna, "CELL", 3)
    regions = [(i, "a" if i % 3 else "b", 7 * i % 90 - 20, 7 * i % 90 - 20 + (i * i) % 70 - 3) for i in range(80)] + [(99, "a", 5, 5), (98, None, 1, 9), (97, "c", 1, 9)]
    points = [("a" if i % 2 else "b", i * 5 % 101 - 15, i % 3 == 0, i % 4 == 0) for i in range(300)]
    r, p = spark.createDataFrame(regions + regions[:5], "id int, c string, lo long, hi long"), spark.createDataFrame(points, "c string, at long, bad boolean, fine boolean")
    per = rna.counted(r, p, ["c"], "lo", "hi", "at", "bad", "fine", ["id"]).groupBy("id").agg(F.sum("n_harmful"), F.sum("n_benign"))
    inside = lambda c, a, b, k: sum(x[0] == c and a <= x[1] <= b and x[k] for x in points)
    assert {x[0]: (x[1], x[2]) for x in per.collect()} == {i: (inside(c, a, b, 2), inside(c, a, b, 3)) for i, c, a, b in regions if a <= b and c}


def test_samples_are_ranked_where_they_are(spark):
    df = spark.sql("SELECT * FROM VALUES ('s', 'a', 1D), ('s', 'a', 3D), ('s', 'b', 3D), ('s', 'c', NULL), ('s', NULL, 5D), ('s', NULL, 4D), ('t', 'a', double('nan')), ('t', 'b', 2D), (NULL, 'a', 1D) t(sample_id, varId, x)").repartition(4, "sample_id")
    got, want = ranks.ranks_in_place(df, {"r": "x"}), ranks.max_ranks(df, {"r": "x"})
    key = lambda d: sorted(map(repr, d.select("sample_id", "varId", "x", "r").collect()))
    assert key(got) == key(want) and moves(got, "varId") == 1


def test_no_window_holds_a_sample_of_features(spark, tmp_path):
    write(tmp_path, lineitem=LINES)
    got, want = beside(spark, "in_silico_prompts", tmp_path)
    assert got == want and len(got) > 100
    df = queries.QUERIES["in_silico_prompts"](spark, str(tmp_path))
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert moves(df, "geneSymbol") == 0
