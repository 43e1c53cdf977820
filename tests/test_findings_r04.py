"""What the findings of round 4 named, on small tables of their own."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from varloom import plan_queries, queries  # noqa: F401
from varloom.functions import repeats
from varloom.operators import nominate, ranks, vote
from varloom.plans import cohort
from varloom.sources.sinks import dealt_table, scratch

from test_findings_r03 import LINES, beside, moves, write


def test_a_log_writes_nothing_and_variants_stay_with_their_sample(spark, tmp_path, monkeypatch):
    def fail(df, name):
        raise AssertionError(f"{name} was written")

    # samples of many chunks, whose pairs are keys of their own
    monkeypatch.setattr(vote, "CHUNK", 4)
    monkeypatch.setattr(vote, "materialised", fail)
    write(tmp_path, lineitem=LINES)
    got, want = beside(spark, "pairwise_log", tmp_path)
    assert got == want and len(got) > 1000
    assert moves(queries.QUERIES["pairwise_log"](spark, str(tmp_path)), "geneSymbol") == 0


def test_candidates_never_leave_their_sample(spark, tmp_path):
    write(tmp_path, lineitem=LINES)
    got, want = beside(spark, "candidate_table", tmp_path)
    assert got == want and len(got) > 100
    # every exchange is one of the tables, before anything is made of them
    plan = queries.QUERIES["candidate_table"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange (.*)", plan)
    assert "Join" not in plan and len(dealt) > 3 and all(re.match(r"hashpartitioning\(concat\(S, cast\(l_suppkey#\d+L as string\)\), \d+\), REPARTITION_BY_NUM", e) for e in dealt)


def test_rows_joined_in_place_are_those_of_a_join(spark):
    df = spark.sql("SELECT * FROM VALUES ('s', 'a', 1), ('s', 'a', 2), ('s', 'b', 3), ('s', NULL, 4), (NULL, 'a', 5), ('t', 'c', 6) d(s, k, n)")
    x = spark.sql("SELECT * FROM VALUES ('s', 'a', 10, 'p'), ('s', 'a', 20, NULL), ('s', NULL, 30, 'q'), (NULL, 'a', 40, 'r'), ('u', 'a', 50, 's') x(s, k, v, w)")
    y = spark.sql("SELECT * FROM VALUES ('t', 'c', NULL), ('s', 'b', 1.5D) y(s, k, z)")
    want = df.join(x, ["s", "k"], "left").join(y, ["s", "k"], "left")
    got = ranks.joined_in_place(df, [x, y], ["s", "k"])
    rows = lambda d: sorted(map(repr, d.select("s", "k", "n", "v", "w", "z").collect()))
    assert got.columns == ["s", "k", "n", "v", "w", "z"] and rows(got) == rows(want)
    assert not re.findall(r"\bw#", got.select("n", "v")._jdf.queryExecution().optimizedPlan().toString())
    dealt = ranks.joined_in_place(df.repartition(3, "s"), [x.repartition(3, "s")], ["s", "k"])
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_junctions_of_any_width_meet_their_variants(spark):
    # widths up to some thousands, so that a contig has several levels; the other contig has none of them
    spans = [("s" if i % 5 else "t", "1" if i % 3 else "2", i * 37 % 900, i * 37 % 900 + (i * i * 11) % (7 if i % 2 else 4000) - 1, [0.5, 0.25, None, 0.125][i % 4], float(i % 6), i) for i in range(120)]
    points = [("s" if i % 2 else "t", f"v{i // 2}", "1" if i % 3 else "2", i * 29 % 1000) for i in range(100)] + [("s", "z", "3", 5), ("u", "y", "1", 5), (None, "x", "1", 5)]
    p = spark.createDataFrame(points + points[:9], "sample_id string, varId string, Chromosome string, Pos long")
    j = spark.createDataFrame(spans, "sample_id string, Chromosome string, start long, end long, p double, psi double, n int")
    best = nominate.best_junction(p, j, ["sample_id", "varId"], "p")
    got = {(r["sample_id"], r["varId"]): (r["p"], r["Fraser_junction_start"], r["Fraser_junction_end"] - 1, r["psi"], r["n"]) for r in best.collect()}
    want = {}
    for s, v, c, at in points:
        hits = [(x[4], x[2], x[3], x[5], x[6]) for x in spans if (x[0], x[1]) == (s, c) and x[2] <= at <= x[3] and x[4] is not None]
        if hits:
            want[s, v] = min([*hits, *([want[s, v]] if (s, v) in want else [])])
    assert got == want and best.count() == len(want) > 40


def test_places_are_searched_for_repeats_where_their_chunk_is(spark, monkeypatch):
    # stretches of two chunks; windows over one, two and four chunks, at the start, over missing chunks and past the end
    monkeypatch.setattr(repeats, "STRETCH", 1)
    text = ("acgt" * 3 + "a" * 14 + "cag" * 12 + "nnnn" + "gt" * 11 + "c") * 9
    for chunk in (20, 25, 300):
        reference = spark.createDataFrame([(c, i, text[i : i + chunk]) for c in ("1", "2") for i in range(0, len(text), chunk) if c == "1" or i // chunk % 3], "chrom string, chunk_start long, seq string")
        rows = [(s, c, p) for s, c in (("s", "1"), ("t", "1"), ("s", "2"), ("s", "3"), ("t", None)) for p in range(1, len(text) + 40, 7)] + [("s", "1", None)]
        points = spark.createDataFrame(rows + rows[:5], "sample_id string, chrom string, pos long")
        want = repeats.best_repeat(repeats.windows_at(points.distinct().filter("pos is not null"), reference, chunk), ["sample_id", "chrom", "pos"])
        got = repeats.repeats_at(points, reference, chunk, "sample_id")
        assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 100


def test_alleles_are_counted_where_their_sample_is(spark):
    found = spark.sql("SELECT * FROM VALUES ('s', '1_10_A_C', 'g', 't'), ('s', '1_10_ACG_c', 'h', 't'), ('s', '1_11_CTTT_G', 'h', 't'), ('s', '1_10_ACG_c', 'h', 't'), ('s', '1_x_A_C', 'g', 't'), ('u', '1_10__C', 'g', 't'), (NULL, '1_10_A_C', 'g', 't') f(sample_id, varId, geneSymbol, transcript_id)")
    reads = {("s", 10, "a"): 3, ("s", 10, "C"): 2, ("s", 11, "C"): 5, ("s", 12, "G"): 4, ("s", 14, "T"): 7, ("u", 10, "c"): 6, (None, 10, "a"): 2}
    bases = spark.createDataFrame([(s, "1", p, x) for (s, p, x), n in reads.items() for _ in range(n)], "sample_id string, chrom string, pos long, base string")
    want = cohort.allele_counts(found, bases)
    got = cohort.with_allele_counts(found.repartition(3, "sample_id"), bases.repartition(3, "sample_id"))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.select("*")._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_a_report_deals_its_tables_by_sample_alone(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(cohort, "dealt_table", lambda df, name, *of: (seen.append((name, df._jdf.queryExecution().executedPlan().toString())), dealt_table(df, name, *of))[1])
    write(tmp_path, lineitem=LINES, part="SELECT i AS p_partkey, 'n' || i AS p_name, 'b' || i AS p_brand, 't' || i AS p_type FROM range(1, 9) r(i)", nation="SELECT i AS n_nationkey FROM range(25) r(i)")
    got, want = beside(spark, "review_report", tmp_path)
    assert got == want and len(got) > 100 and {r[-1] for r in got} == {"S0", "S1"}
    # whole candidates are dealt by sample and never by what they are joined on
    (plan,) = [plan for name, plan in seen if name == "reviewed"]
    assert not re.search(r"Exchange hashpartitioning\([^)]*(geneSymbol|transcript_id)#", plan)


def test_a_table_is_read_as_it_was_dealt(spark):
    df = spark.sql("SELECT 's' || id % 5 AS s, id % 3 AS g, CASE WHEN id % 7 > 0 THEN id END AS n FROM range(60)")
    with scratch():
        kept, plain = dealt_table(df.repartition(3, "s"), "t", "s", 3)
        of = kept.groupBy("s", "g").count()
        assert "Exchange" not in of._jdf.queryExecution().executedPlan().toString() and sum(r["count"] for r in of.collect()) == 60
        assert sorted(map(repr, kept.collect())) == sorted(map(repr, plain.collect())) == sorted(map(repr, df.collect()))
        # sides of a union are told to be dealt alike, so that a window over both moves neither again
        both = ranks.joined_in_place(plain.repartition(3, "s"), [df.groupBy("s", "g").agg(F.count("n").alias("m")).repartition(3, "s")], ["s", "g"])
        assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 3 and both.count() == 60
        files = kept.inputFiles()
    assert files and not spark.sql("SHOW TABLES").filter("tableName LIKE 'varloom%'").count()
    assert not plain.sparkSession.read.parquet(files[0].rsplit("/", 1)[0]).count()
