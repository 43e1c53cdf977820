import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import annotate, evidence, in_silico, nominate, phenotype, ranks, review, rna, score, vote
from varloom.sources import sinks, tables


def test_rank_counts_scores_at_least_as_high(spark):
    df = spark.createDataFrame([("s", "a", 3.0), ("s", "b", 2.0), ("s", "c", 2.0), ("s", "c", 1.0), ("s", "d", None), ("t", "a", 1.0)], "sample_id string, varId string, x double")
    got = {(r["sample_id"], r["varId"]): r["r"] for r in ranks.max_ranks(df, {"r": "x"}).collect()}
    assert got == {("s", "a"): 1, ("s", "b"): 3, ("s", "c"): 3, ("s", "d"): None, ("t", "a"): 1}


def test_rules_rescue_and_groups(spark):
    rows = [("s", "G1", "v1", 5, 0.5, None, 1), ("s", "G1", "v2", 500, 0.5, None, 0), ("s", "G2", "v3", 500, 1e-6, None, 0), ("s", "G3", "v4", 500, None, 1e-6, 0), ("s", "G4", "v5", 50, float("nan"), 1e-6, 0), ("s", "-", "v6", 1, None, None, 0), ("s", "G5", "v7", None, None, None, 0)]
    df = spark.createDataFrame(rows, "sample_id string, geneSymbol string, varId string, Diagnostic_Engine_Rank int, Fraser_pvaluesBetaBinomial_jaccard double, Outrider_pValue double, recessive int")
    for c in ("rank_InSilico", "rank_Database", "rank_Genetics"):
        df = df.withColumn(c, F.lit(None).cast("int"))
    got = {r["varId"]: (r["evidence_rules"], r["is_compound_het_group"]) for r in nominate.nominated(df, nominate.rules()).collect()}
    ch = "Compound Heterozygous (Compound Het)"
    # splicing nominates at any rank, expression only within the first hundred
    assert got == {"v1": (f"Strong DNA Evidence, {ch}", True), "v2": (ch, True), "v3": ("Strong RNA Evidence", False), "v5": ("Strong RNA Evidence", False)}


def test_interval_join_equals_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, str(rng.randint(1, 3)), rng.randint(0, 500)) for i in range(200)]
    spans = [(i, str(rng.randint(1, 3)), a, a + rng.randint(0, 90)) for i in range(80) for a in [rng.randint(0, 500)]]
    p = spark.createDataFrame(pts, "p int, c string, at long")
    s = spark.createDataFrame(spans, "s int, c string, lo long, hi long")
    got = sorted((r["p"], r["s"]) for r in nominate.interval_hits(p, s, ["c"], "at", "lo", "hi").collect())
    assert got == sorted((x[0], y[0]) for x in pts for y in spans if x[1] == y[1] and y[2] <= x[2] <= y[3])


def test_long_spans_stay_few_rows(spark):
    rng = random.Random(6)
    pts = [(i, "c", rng.randint(0, 10**8)) for i in range(400)] + [(400, "c", 0), (401, None, 5), (402, "c", None)]
    spans = [(i, "c", a, a + rng.choice([0, 1, 15, 16, 255, 256, 10**4, 10**6, 10**8]) + rng.randint(-1, 1)) for i in range(150) for a in [rng.choice([rng.randint(-50, 10**8), pts[rng.randrange(400)][2] - rng.randint(0, 300)])]]
    p = spark.createDataFrame(pts, "p int, c string, at long")
    s = spark.createDataFrame(spans, "s int, c string, lo long, hi long")
    got = sorted((r["p"], r["s"]) for r in nominate.interval_hits(p, s, ["c"], "at", "lo", "hi").collect())
    want = sorted((x[0], y[0]) for x in pts for y in spans if x[1] == y[1] and x[2] is not None and y[2] <= x[2] <= y[3])
    assert got == want and len(want) > 1000
    assert nominate.interval_hits(p, s.limit(0), ["c"], "at", "lo", "hi").count() == 0


def test_rank_of_a_large_group_equals_the_window(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["big"] * 30 + ["a", None]), f"v{i % 1500}", rng.choice([None, float(rng.randint(0, 40)), rng.random()]), float(rng.randint(0, 3)) if i % 9 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "sample_id string, varId string, x double, y double").repartition(6)
    got = sorted(map(tuple, ranks.ranks_of_any_size(df, {"rx": "x", "ry": "y"}).collect()), key=repr)
    best = {}
    for s, v, *xy in rows:
        for i, x in enumerate(xy):
            if x is not None:
                best[s, v, i] = max(x, best.get((s, v, i), x))
    held = {}
    for (s, _, i), x in best.items():
        held.setdefault((s, i), []).append(x)
    rank = lambda s, v, i: sum(x >= best[s, v, i] for x in held[s, i]) if (s, v, i) in best else None
    assert got == sorted(((*r, rank(r[0], r[1], 0), rank(r[0], r[1], 1)) for r in rows), key=repr)
    assert ranks.ranks_of_any_size(df.limit(0), {"rx": "x"}).count() == 0


def test_region_counts_equal_brute_force(spark):
    rng = random.Random(8)
    pts = [(rng.choice(["1"] * 9 + ["2"]), rng.randint(0, 300), rng.choice([True, False, None]), rng.random() < 0.3) for _ in range(2000)] + [("1", None, True, True), (None, 5, True, True)]
    regions = [(i, rng.choice("123"), a, a + rng.choice([0, 3, 50, 400, -5])) for i in range(200) for a in [rng.randint(-20, 320)]] + [(900, "1", 7, 9), (901, "1", 7, 9), (902, None, 1, 2), (903, "1", None, 4)]
    r = spark.createDataFrame(regions, "id int, c string, lo long, hi long")
    p = spark.createDataFrame(pts, "c string, at long, bad boolean, fine boolean").repartition(5)
    got = {x["id"]: (x["n_harmful"], x["n_benign"]) for x in rna.burden(r, p, ["c"], "lo", "hi", "at", "bad", "fine", ["id"]).collect()}
    inside = lambda c, a, b, k: sum(1 for x in pts if c is not None and x[0] == c and a is not None and x[1] is not None and a <= x[1] <= b and x[k])
    assert got == {i: (inside(c, a, b, 2), inside(c, a, b, 3)) for i, c, a, b in regions}


def test_transcripts(spark):
    df = spark.createDataFrame([("s", "v", "G", "NM_1.2:c.1", "p.1"), ("s", "v", "G", "NM_2.1:c.2", "-"), ("s", "w", "G", None, None)], "sample_id string, varId string, geneSymbol string, HGVSc string, HGVSp string")
    mane = spark.createDataFrame([("NM_2.7",)], "transcript_id string")
    got = {r["varId"]: (r["transcript_id"], r["transcript_score"]) for r in annotate.best_transcript(annotate.with_transcript(df, mane), ["sample_id", "varId", "geneSymbol"]).collect()}
    assert got == {"v": ("NM_2", 5), "w": ("-", 3)}
    truth = spark.createDataFrame([("s", "chr1", "5", "A", "C"), ("s", "2", "6", "A", "C")], "SampleID string, chr string, pos string, ref string, alt string")
    assert sorted(r["varId"] for r in annotate.truth_keys(truth).collect()) == ["1_5_A_C", "2_6_A_C"]


def test_worst_scores(spark):
    df = spark.createDataFrame([("s", "v", 0.1, -1.0, "5"), ("s", "v", 0.2, 2.0, "x"), ("t", "v", 0.3, 1.0, None), ("t", "w", 0.3, 1.0, None)], "sample_id string, varId string, SIFT_score double, FATHMM_score double, CADD_phred string")
    cand = df.filter("varId = 'v'").select("sample_id", "varId")
    got = {r["sample_id"]: (r["SIFT_score"], r["FATHMM_score"], r["CADD_phred"]) for r in in_silico.worst_scores(df, cand, ["SIFT_score", "FATHMM_score", "CADD_phred"]).collect()}
    assert got == {"s": (0.1, -1.0, 5.0), "t": (0.3, 1.0, None)}


def test_patients_and_terms(spark):
    samples = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sample_id string")
    terms = spark.createDataFrame([("a", 1, "HP:2"), ("a", 0, "HP:1"), ("b", 0, "HP:0000001"), ("c", 0, "HP:9")], "sample_id string, ord int, hpo_id string")
    names = spark.createDataFrame([("HP:1", "one"), ("HP:2", "two"), ("HP:0000001", "All")], "id string, name string")
    got = {r["sample_id"]: (r["term_text"], r["has_terms"]) for r in phenotype.patient_terms(samples, terms, names).collect()}
    assert got == {"a": ("one, two", 1), "b": ("All", 0), "c": ("All", 0), "d": ("All", 0)}
    rows = spark.createDataFrame([("G", "HP:1", "one", "1/2"), ("G", "HP:1", "one", "50%"), ("G", "HP:2", "two", "-"), ("G", "HP:3", "three", "bad")], "gene_symbol string, hpo_id string, hpo_name string, frequency string")
    assert phenotype.gene_terms(rows).first()["phenotype_text"] == "one (Frequent), two (Frequency not specified), three (Frequency not specified)"


def test_publications(spark):
    rows = [("ABC", "1", "ABC causes disease", "", 2), ("ABC", "2", "ABC-1 causes disease", "", 1), ("ABC", "x3", "ABC disease", "", 0), ("ABC", "4", None, "ABC disease", 0), ("ABC", "5", "abc disease", "", 0), ("ABC", "6", "about ABC", "", 0), ("ABC", "1", "second ABC disease", "", 3)]
    df = spark.createDataFrame(rows, "gene string, PMID string, title string, abstract string, relevance int")
    got = phenotype.publications(df, ["Disease"]).collect()
    assert [(r["PMID"], r["title"]) for r in got] == [("1", "ABC causes disease")]
    words = spark.createDataFrame([("because", "x"), ("the Cause.", "x"), ("diagnosis", "x"), ("éCause", "x")], "t string, x string")
    assert [r[0] for r in words.select(phenotype.says(F.col("t"), phenotype.KEYWORDS)).collect()] == [False, True, True, False]


def test_answers(spark):
    df = spark.createDataFrame([("a", '{"Reasoning": "r", "Conclusion": "Strong"}'), ("b", "{bad"), ("c", '{"Reasoning": "r"}'), ("d", None)], "key string, response string")
    got = {r["key"]: r["Conclusion"] for r in evidence.parsed(df, "insilico").collect()}
    assert got == {"a": "Strong", "b": "Weak", "c": "Weak", "d": "Weak"}
    cells = spark.createDataFrame([("k", "h1\\th2\n1\\t Case \n\n2\tother")], "key string, t string")
    rows = evidence.in_categories(evidence.table_rows(cells, ["key"], "t", ["a", "b"]), "b", ["case"])
    assert [(r["a"], r["b"]) for r in rows.collect()] == [("1", "Case")]


def test_allele_support_and_burden(spark):
    v = spark.createDataFrame([("s", "v1", "1", 10, "A", "C"), ("s", "v2", "1", 10, "AG", "N"), ("s", "v3", "9", 1, "A", "T")], "sample_id string, varId string, chrom string, pos long, ref string, alt string")
    b = spark.createDataFrame([("s", "1", 10, "a"), ("s", "1", 10, "A"), ("s", "1", 10, "C"), ("s", "1", 11, "T"), ("t", "1", 10, "A")], "sample_id string, chrom string, pos long, base string")
    got = {r["varId"]: (r["ref_count_max"], r["ref_count_mean"], r["ref_count_min"], r["alt_count_max"]) for r in rna.allele_support(v, b, ["sample_id", "varId"]).collect()}
    assert got == {"v1": (2, 2, 2, 1), "v2": (2, 1, 0, 0), "v3": (0, 0, 0, 0)}
    r = spark.createDataFrame([(1, "1", 0, 10), (2, "1", 20, 30), (3, "1", 0, 10)], "id int, c string, lo long, hi long")
    p = spark.createDataFrame([("1", 0, True, False), ("1", 10, False, True), ("1", 11, True, False)], "c string, at long, bad boolean, fine boolean")
    got = {x["id"]: (x["n_harmful"], x["n_benign"], x["ratio"]) for x in rna.burden(r, p, ["c"], "lo", "hi", "at", "bad", "fine", ["id"]).collect()}
    assert got == {1: (1, 1, 1.0), 2: (0, 0, None), 3: (1, 1, 1.0)}


def candidate(**more):
    base = dict(sample_id="s", geneSymbol="G", varId="v", transcript_id="t", recessive=1, dominant=0, zyg=1, Chromosome="chr1", cons_frameshift_variant=0, HGVSp="p.1", HGVSc="c.1", has_repeat_motif=False, Diagnostic_Engine_Rank=1, rank_InSilico=1, evidence_rules="Strong DNA Evidence", ref_count_mean=None, alt_count_mean=None, alt_count_min=None, Database_Conclusion=None, Database_Zygosity=None, Literature_Conclusion=None, OMIM_Conclusion=None, HPO_Conclusion=None, RNA_GeneLevel_Conclusion=None, RNA_VarLevel_Conclusion=None, Insilico_Conclusion=None)
    return base | more


SCHEMA = "sample_id string, geneSymbol string, varId string, transcript_id string, recessive int, dominant int, zyg int, Chromosome string, cons_frameshift_variant int, HGVSp string, HGVSc string, has_repeat_motif boolean, Diagnostic_Engine_Rank int, rank_InSilico int, evidence_rules string, ref_count_mean double, alt_count_mean double, alt_count_min double, Database_Conclusion string, Database_Zygosity string, Literature_Conclusion string, OMIM_Conclusion string, HPO_Conclusion string, RNA_GeneLevel_Conclusion string, RNA_VarLevel_Conclusion string, Insilico_Conclusion string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)


def reviewed(df):
    return review.demoted(review.partnered(review.tiered(df, ["Diagnostic_Engine_Rank", "varId"])))


def test_review(spark):
    rows = [candidate(varId="a"), candidate(varId="b", Diagnostic_Engine_Rank=2, OMIM_Conclusion="Impossible"), candidate(geneSymbol="H", varId="c", Diagnostic_Engine_Rank=3), candidate(geneSymbol="X", varId="d", Chromosome="chrX", Diagnostic_Engine_Rank=4), candidate(geneSymbol="I", varId="e", Database_Zygosity="heterozygous", Diagnostic_Engine_Rank=5)]
    got = {r["varId"]: (r["Tier"], r["partner"]) for r in reviewed(frame(spark, rows)).collect()}
    # a finds b, which takes its tier; c has no partner; chrX and called heterozygotes stay
    assert got == {"a": (1, "b"), "b": (1, "a"), "c": (3, ""), "d": (1, ""), "e": (1, "")}


def test_partner_must_not_lean_the_same_way(spark):
    rows = [candidate(varId="a", ref_count_mean=100.0, alt_count_mean=60.0), candidate(varId="b", Diagnostic_Engine_Rank=2, ref_count_mean=100.0, alt_count_mean=60.0), candidate(varId="c", Diagnostic_Engine_Rank=3, ref_count_mean=60.0, alt_count_mean=100.0)]
    got = {r["varId"]: r["partner"] for r in reviewed(frame(spark, rows)).collect()}
    assert got == {"a": "c", "b": "", "c": "a"}


def test_votes_sum_up(spark):
    rng = random.Random(9)
    rows = [candidate(geneSymbol=f"G{i // 2}", varId=f"v{i:02d}", Diagnostic_Engine_Rank=rng.randint(1, 9), Database_Conclusion=rng.choice([None, "Neutral", "Supporting"]), HPO_Conclusion=rng.choice([None, "Good Fit"]), recessive=rng.randint(0, 1), dominant=1) for i in range(14)]
    df = reviewed(frame(spark, rows))
    scores, log = vote.pairwise(df, (1,))
    got = scores.collect()
    per = {r["pairwise_entity_id"]: r for r in got}
    n = len(per)
    assert sum(r["PairWiseScore"] for r in per.values()) == 0
    assert all(r["PairWiseWins"] + r["PairWiseLosses"] + r["PairWiseTies"] == n - 1 for r in per.values())
    assert log.count() == n * (n - 1) // 2
    assert sorted(r["PairWiseEntityRank"] for r in per.values()) == list(range(1, n + 1))
    assert any(r["pairwise_entity_type"] == "compound" for r in per.values())


def test_scores_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 3))
    w = {"domains": {"A": {"layers": [(rng.normal(size=(3, 4)), rng.normal(size=4)), (rng.normal(size=(4, 2)), np.zeros(2))], "head": (rng.normal(size=(2, 1)), np.zeros(1)), "norm": {"g": np.ones(2), "b": np.zeros(2)}}}, "norm": {"g": np.ones(2), "b": np.zeros(2)}, "fusion": [(rng.normal(size=(2, 3)), np.zeros(3))], "out": (rng.normal(size=(3, 1)), np.zeros(1))}
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "i int, a double, b double, c double")
    got = np.array([[r["overall_logit"], r["score_A"]] for r in score.moe_scores(df, {"A": ["a", "b", "c"]}, w).orderBy("i").collect()])
    logit, heads = score.forward({"A": x}, w)
    assert np.allclose(got, np.stack([logit, heads[:, 0]], axis=1))


def test_scoring_imputes_and_takes_empty_batches(spark):
    w = {"domains": {"A": {"layers": [(np.eye(2), np.zeros(2))], "head": (np.ones((2, 1)), np.zeros(1))}}, "fusion": [], "out": (np.ones((2, 1)), np.zeros(1))}
    df = spark.createDataFrame([(1, "5", "x"), (2, "bad", "y"), (3, None, None)], "i int, a string, c string")
    fitted = {"a": (4.0, 2.0)}
    x = score.features(df, ["a", "absent"], fitted, {"c": ["x"], "gone": ["z"]})
    got = {r.i: r.overall_logit for r in score.moe_scores(df.withColumn("f", x), {"A": ["f"]}, w).collect()}
    assert got == {1: 1.5, 2: 0.0, 3: 0.0}
    none = df.filter("i > 5").withColumn("f", x)
    assert score.moe_scores(none, {"A": ["f"]}, w).count() == 0 and score.fit_standard(none, ["a"]) == {"a": (0.0, 1.0)}


def test_xml_lines(spark):
    df = spark.createDataFrame([('<a k="v"><b> t </b><c/></a>',), ("<bad",), (None,)], "xml string")
    assert [r["text"] for r in evidence.submission_texts(df).collect()] == ['a [k="v"]:\n  b: t\n  c', None, None]


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    import pytest

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context, Conf()

    with pytest.raises(ValueError):
        sinks.shared_folder(Session)


def test_forgotten_tables_hold_nothing(spark):
    df = sinks.materialised(spark.range(5), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    sinks.forget(df)
    assert spark.read.schema("id long").parquet(path).count() == 0


def test_scratch_keeps_what_is_taken_out(spark):
    with sinks.scratch() as made:
        a, b = sinks.materialised(spark.range(3), "a"), sinks.materialised(spark.range(4), "b")
        made.pop()
        folder = a.inputFiles()[0].rsplit("/", 1)[0]
    assert b.count() == 4 and spark.read.schema("id long").parquet(folder).count() == 0


def test_votes_of_a_large_sample_meet_in_chunks(spark, monkeypatch):
    rows = [candidate(geneSymbol=f"G{i}", varId=f"v{i:02d}", Diagnostic_Engine_Rank=i + 1) for i in range(20)]
    df = reviewed(frame(spark, rows).withColumn("recessive", F.lit(0)))
    whole = vote.pairwise(df, (1,))[0].collect()
    monkeypatch.setattr(vote, "CHUNK", 3)
    scores, log = vote.pairwise(df, (1,))
    assert sorted(map(tuple, scores.collect())) == sorted(map(tuple, whole)) and log.count() == 190


def test_sources_and_sinks(spark, tmp_path):
    for s, ids in (("p1", "HP:1\n\nHP:2\n"), ("p2", "HP:3")):
        (tmp_path / f"{s}.hpo.txt").write_text(ids)
    got = sorted((r["sample_id"], r["ord"], r["hpo_id"]) for r in tables.patient_term_lists(spark, str(tmp_path / "*.hpo.txt")).collect())
    assert got == [("p1", 0, "HP:1"), ("p1", 2, "HP:2"), ("p2", 0, "HP:3")]
    (tmp_path / "t.obo").write_text("format-version: 1.2\n\n[Term]\nid: HP:1\nname: one\n\n[Term]\nid: HP:2\nname: two words\n")
    assert sorted((r["id"], r["name"]) for r in tables.ontology(spark, str(tmp_path / "t.obo")).collect()) == [("HP:1", "one"), ("HP:2", "two words")]
    df = spark.createDataFrame([("s", 1), ("t", 2)], "sample_id string, x int")
    for _ in range(2):
        sinks.write_missing(df, str(tmp_path / "out"), ["sample_id"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    try:
        tables.require_columns(df, "x", "y")
        raise AssertionError
    except ValueError as e:
        assert "y" in str(e)


def test_pairs_meet_once_with_mirrored_votes(spark):
    from varloom.functions import labels

    for a, b, low in itertools.product([None, 1.0, 2.0], [None, 1.0, 2.0], [True, False]):
        df = spark.createDataFrame([(a, b)], "a double, b double")
        x, y = df.select(labels.vote(F.col("a"), F.col("b"), low), labels.vote(F.col("b"), F.col("a"), low)).first()
        assert {"A": "B", "B": "A", "tie": "tie"}[x] == y


def test_tally_equals_the_pairs(spark):
    rng = random.Random(21)
    measures = ", ".join(f"{c} double" for c in vote.SCORES)
    labels = ", ".join(f"{c} string" for c in vote.LABELS)
    schema = f"sample_id string, pairwise_entity_id string, pairwise_entity_type string, mean struct<{measures.replace(' double', ': double')}, {labels.replace(' string', ': string')}>, best struct<{measures.replace(' double', ': double')}, {labels.replace(' string', ': string')}>, best_member string, member_variant_ids string"
    value = lambda: (rng.choice([1.0, 2.0, 3.5, float("inf"), float(rng.randint(1, 60))]), *[rng.choice([0.0, 0.5, 1.0]) for _ in vote.SCORES[1:-1]], rng.choice([None, 0.0, 2.0]), "", "", "", "")
    rows = []
    for i in range(260):
        pair = rng.random() < 0.3
        one = value()
        rows.append((rng.choice(["big"] * 9 + ["small"]), f"e{i}", "compound" if pair else "single", value() if pair else one, one, "v", "v|w"))
    rows.append(("alone", "e", "single", value(), value(), "v", "v"))
    found = spark.createDataFrame(rows, schema)
    show = lambda df: sorted(tuple(r[c] for c in ("sample_id", "pairwise_entity_id", "PairWiseWins", "PairWiseLosses", "PairWiseTies", "PairWiseEntityRank")) for r in df.collect())
    assert show(vote.tally(found)) == show(vote.tallied(found, vote.compared(found)))


def test_medians_are_exact(spark):
    rng = random.Random(22)
    rows = [(rng.lognormvariate(0, 40), float(rng.randint(0, 3)), None if i % 3 else rng.random(), None, 5.0 if i < 1900 else rng.random()) for i in range(4001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    got = score.medians(df, ["a", "b", "c", "d", "e"], few=20)
    for i, c in enumerate("abcde"):
        x = sorted(r[i] for r in rows if r[i] is not None)
        assert got[c] == (x[(len(x) - 1) // 2] if x else None), c
    wide = spark.range(1_000_000).select((F.pmod(F.col("id") * 7919, F.lit(1_000_003)) + F.col("id") / 1e7).alias("x"))
    assert score.medians(wide, ["x"])["x"] == wide.agg(F.expr("percentile_disc(0.5) within group (order by x)").alias("m")).first()["m"]


def test_gene_names_equal_the_patterns(spark):
    rng = random.Random(23)
    genes = ["BRCA1", "A-B", "B", "HLA.X", "(p53)", "der", "..", "", None, "B"]
    bits = ["BRCA1", "xBRCA1", "A-B", "A", "B", "HLA.X", "HLA", "(p53)", "p53", "der", "é", "B_", "..", ".", "-"]
    texts = [(i, rng.choice([" ", ","]).join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for i in range(150)] + [(200, None), (201, "")]
    t, g = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(x,) for x in genes], "gene string")
    got = sorted(tuple(r) for r in phenotype.named_genes(t, g, "id", "text").collect())
    want = sorted((r["id"], r["gene"]) for r in t.crossJoin(g.filter("gene <> '' and gene rlike '[A-Za-z0-9]'").distinct()).filter(phenotype.mentions(F.col("text"), F.col("gene"))).select("id", "gene").collect())
    assert got == want and len(want) > 50


def test_broken_lines_and_first_files(spark, tmp_path):
    for name, lines in {"a/1.csv": ["1,0.5", "2,x", "3,1,9", "4", "5,"], "a/2.csv": ["9,9"], "b/1.csv": ["7,7"], "c/1.csv": []}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(["varId,overall_logit", *lines, ""]))
    rows = tables.declared(spark, f"{tmp_path}/*", tables.KINDS["predictions"])
    assert sorted(r["line"] for r in tables.rejects(rows).collect()) == ["2,x", "3,1,9", "4"]
    assert sorted((r["varId"], r["overall_logit"]) for r in tables.good(rows).collect()) == [("1", 0.5), ("5", None), ("7", 7.0), ("9", 9.0)]
    assert {(r["sample_id"], r["file"][-5:]): (r["n_good"], r["n_rejected"]) for r in tables.reject_counts(rows).collect()} == {("a", "1.csv"): (2, 3), ("a", "2.csv"): (1, 0), ("b", "1.csv"): (1, 0)}
    assert sorted(r["varId"] for r in tables.good(tables.first_match(rows)).collect()) == ["1", "5", "7"]
    with pytest.raises(FileNotFoundError, match="no predictions of z"):
        tables.require_inputs(spark.createDataFrame([("a",), ("z",)], "sample_id string"), rows, "predictions")


def test_manifest_survives_a_killed_run(spark, tmp_path):
    rows = spark.createDataFrame([(s, i) for s in "abc" for i in range(5)], "sample_id string, x int")
    path, make = str(tmp_path / "out"), lambda df: df.groupBy("sample_id").agg(F.sum("x").alias("total")).filter("total > 0")
    assert sinks.finished(spark, path) is None
    with pytest.raises(ZeroDivisionError):
        sinks.resume(rows, lambda df: 1 // 0, path)
    assert sinks.resume(rows.filter("sample_id = 'a'"), make, path) == 1
    make(rows.filter("sample_id = 'b' and x < 3")).write.mode("append").partitionBy("sample_id").parquet(f"{path}/rows")
    assert [r["sample_id"] for r in sinks.finished(spark, path).collect()] == ["a"]
    assert sinks.resume(rows, make, path) == 2 and sinks.resume(rows, make, path) == 0
    show = lambda: sorted((r["sample_id"], r["total"]) for r in sinks.finished(spark, path).collect())
    assert show() == [("a", 10), ("b", 10), ("c", 10)]
    # order is no change; another row is; a sample that has no rows any more shows none
    assert sinks.resume(rows.orderBy(F.desc("x")), make, path) == 0
    changed = rows.withColumn("x", F.when(F.col("sample_id") == "c", 0).otherwise(F.col("x")))
    assert sinks.resume(changed, make, path) == 1 and show() == [("a", 10), ("b", 10)]
