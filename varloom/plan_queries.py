"""Driver queries of the cohort plans: whole pipelines over the driver's tables, and the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import repeats
from varloom.functions.keys import key_parts
from varloom.operators import evidence, ranks, score, vote
from varloom.plans import cohort
from varloom.queries import GENE, PARTNERED, QUERIES, SAMPLE, SPANS, TIERED, VARIANT, VOTED, data, query, rubric_sql, tasks_of
from varloom.sources import sinks, tables

NL = "chr(10)"
PLACE = "cast(l_partkey % 24 + 1 as string) || '_' || cast(l_orderkey as string) || '_A_C'"

# Candidate rows, one per sample, gene and variant.
FOUND = f"""SELECT {SAMPLE} AS sample_id, 'G' || cast(l_partkey % 400 as string) AS geneSymbol, {PLACE} AS varId, 'T' || cast(min(l_linenumber) as string) AS transcript_id,
 'c.' || cast(min(l_orderkey) as string) AS HGVSc_core, case when max(l_returnflag) = 'A' then '-' else 'p.' || cast(min(l_linenumber) as string) end AS HGVSp, 'T1:c.' || cast(min(l_orderkey) as string) AS HGVSc,
 min(l_linenumber) % 2 AS recessive, cast(max(l_suppkey) % 2 as int) AS dominant, case when min(l_linenumber) < 5 then 1 else 2 end AS zyg, case when min(l_partkey) % 24 = 22 then 'chrX' else 'chr' || cast(min(l_partkey) % 24 + 1 as string) end AS Chromosome,
 cast(min(l_orderkey) as int) AS Diagnostic_Engine_Rank, cast(min(l_quantity) as int) * 3 AS rank_InSilico,
 case when min(l_linenumber) = 1 then null else min(l_tax) end AS gnomadGenePLI, min(l_discount) AS gnomadGeneOELof, max(l_discount) + 0.01 AS gnomadGeneOELofUpper,
 case when min(l_linenumber) = 2 then null else min(l_orderkey) end AS Fraser_junction_start, case when min(l_linenumber) = 2 then null else min(l_orderkey) + min(l_linenumber) * 100 end AS Fraser_junction_end,
 case when min(l_linenumber) = 2 then null else min(l_discount) + 0.06 end AS Fraser_pvaluesBetaBinomial_jaccard, case when min(l_linenumber) = 3 then null else min(l_tax) + 0.05 end AS Fraser_GenePvalue,
 min(l_tax) AS Fraser_jaccard, max(l_tax) AS Fraser_predictedMeans_jaccard, min(l_tax) - 0.04 AS Fraser_delta_jaccard, min(l_quantity) AS Fraser_rawOtherCounts_jaccard, min(l_discount) AS Fraser_psi5, max(l_quantity) AS Fraser_rawOtherCounts_psi5, 0.5 - min(l_tax) AS Fraser_delta_psi5,
 max(l_discount) AS Fraser_psi3, max(l_quantity) + 1 AS Fraser_rawOtherCounts_psi3, 0.25 - min(l_tax) AS Fraser_delta_psi3, min(l_quantity) * 2 AS Fraser_rawCountsJnonsplit,
 case when min(l_linenumber) = 4 then null else (min(l_quantity) - 25.0) / 10.0 end AS Outrider_zScore, (max(l_quantity) - 20.0) / 8.0 AS Outrider_RawZscore, case when min(l_linenumber) = 4 then null else min(l_discount) end AS Outrider_pValue, cast(max(l_quantity) as int) AS Outrider_rawcounts,
 case when min(l_linenumber) = 5 then null else min(l_tax) * 2 + 0.02 end AS ASE_PVAL, cast(min(l_quantity) as int) AS ASE_REF_COUNT, cast(max(l_quantity) as int) + 1 AS ASE_ALT_COUNT, min(l_discount) * 5 AS ASE_ALT_RATIO FROM {{lineitem}} GROUP BY 1, 2, 3"""


def four(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'NA' ELSE CAST(CAST(printf('%.3e', CAST({x} AS DOUBLE)) AS DOUBLE) AS VARCHAR) END"


def whole(x: str) -> str:
    return f"coalesce(CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR), 'NA')"


def shown_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'NA' WHEN abs({x}) >= 10 THEN printf('%.2f', {x}) ELSE regexp_replace(regexp_replace(printf('%.4f', {x}), '0+$', ''), '\\.$', '') END"


def lines(*texts: str) -> str:
    return f" || {NL} || ".join(f"'{t}'" for t in ("", *texts))


FITS = "Not Fit | Partial Fit | Good Fit"
RNA = "Conclusion: one of No RNA Evidence | Weak RNA Evidence | Strong RNA Evidence."
ASKED = {
    "database": lines('Answer with one JSON object with the keys "reasoning", "conclusion", "zygosity" and nothing else.', "conclusion: one of Against | Neutral | Supporting | Convincing.", "zygosity: one of homozygous | compound_heterozygous | heterozygous | no_information."),
    "insilico": lines('Answer with one JSON object with the keys "Reasoning", "Conclusion" and nothing else.', "Conclusion: one of Weak | Moderate | Strong."),
    "hpo": lines('Answer with one JSON object with the keys "Reasoning", "Conclusion" and nothing else.', f"Conclusion: one of {FITS} | Stand-Alone Strong Evidence."),
    "omim": lines('Answer with one JSON object with the keys "Reasoning", "Conclusion" and nothing else.', f"Conclusion: one of Impossible | {FITS} | Stand-Alone Strong Evidence."),
    "literature": lines('Answer with one JSON object with the keys "Reasoning", "Conclusion" and nothing else.', f"Conclusion: one of {FITS}."),
    "rna_gene": lines('Answer with one JSON object with the keys "Reasoning", "Event", "Conclusion" and nothing else.', "Event: one of No Signal | Abnormal Splicing | Moderately Decreased Expression | Largely Decreased Expression | Increased Expression.", RNA),
    "rna_variant": lines('Answer with one JSON object with the keys "Reasoning", "Event", "Conclusion" and nothing else.', "Event: one of No Signal | Exon Skipping | Intron Retention | Cryptic Splicing | Moderately Decreased Expression | Largely Decreased Expression | Increased Expression | Allele Imbalance (Alt High) | Allele Imbalance (Alt Low).", RNA),
}
ASKED = {kind: f"{asked} || {rubric_sql(kind)}" for kind, asked in ASKED.items()}


def hashed(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def digest(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, hashed(F.col("prompt")).alias("prompt_sha256"))


@query(
    f""", f AS (SELECT varId, HGVSc_core, row_number() OVER (PARTITION BY varId ORDER BY sample_id, geneSymbol) AS n FROM found WHERE varId IN (SELECT varId FROM archive)),
t AS (SELECT varId, string_agg(text, {NL} || '---' || {NL} ORDER BY ord) AS texts FROM submissions GROUP BY varId)
SELECT f.varId, sha256('Variant ' || f.varId || '; coding change ' || HGVSc_core || '.' || {NL} || 'Submissions:' || {NL} || coalesce(texts, 'No submissions were found.') || {ASKED['database']}) AS prompt_sha256 FROM f LEFT JOIN t USING (varId) WHERE n = 1""",
    found=FOUND,
    archive=f"SELECT DISTINCT {PLACE} AS varId, cast(l_orderkey as string) AS VariationID FROM {{lineitem}} WHERE l_returnflag = 'R'",
    submissions=f"SELECT DISTINCT {PLACE} AS varId, l_linenumber AS ord, 'line ' || cast(l_linenumber as string) || ' status ' || l_linestatus AS text FROM {{lineitem}} WHERE l_linestatus = 'O'",
)
def database_prompts(found: DataFrame, archive: DataFrame, submissions: DataFrame) -> DataFrame:
    # a variant's two lines with one number would have no order
    one = submissions.groupBy("varId", "ord").agg(F.min("text").alias("text"))
    return digest(cohort.database_prompts(found, archive, one), "varId")


SILICO = ["CADD_phred", "SIFT_score", "FATHMM_score", "spliceAImax"]


@query(
    f""", top AS (SELECT * FROM found WHERE rank_InSilico <= 100),
told AS (SELECT sample_id, varId, arg_min(geneSymbol, (geneSymbol, HGVSc)) AS g, arg_min(HGVSc_core, (geneSymbol, HGVSc)) AS c, arg_min(HGVSp, (geneSymbol, HGVSc)) AS p FROM top GROUP BY ALL),
s AS (SELECT f.* FROM features f SEMI JOIN top USING (sample_id, varId)), low AS (SELECT sample_id, min(FATHMM_score) < 0 AS low FROM s GROUP BY sample_id),
w AS (SELECT sample_id, varId, max(CADD_phred) AS ca, min(SIFT_score) AS si, CASE WHEN any_value(low) THEN min(FATHMM_score) ELSE max(FATHMM_score) END AS fa, max(spliceAImax) AS sp, bool_or(cons_splice_acceptor_variant > 0 OR cons_splice_donor_variant > 0) AS splice FROM s JOIN low USING (sample_id) GROUP BY ALL),
note AS (SELECT CASE WHEN min(fa) < 0 THEN 'more negative is worse here.' ELSE 'higher is worse here.' END AS note FROM w)
SELECT sample_id, varId, sha256('Gene ' || g || CASE WHEN p <> '-' THEN '; cDNA ' || c || '; protein ' || p ELSE '' END || '.' || {NL} || 'CADD_phred: ' || {shown_sql('ca')} || {NL} || 'SIFT_score: ' || {shown_sql('si')} || {NL} || 'FATHMM_score: ' || {shown_sql('fa')}
 || CASE WHEN splice THEN {NL} || 'spliceAImax: ' || {shown_sql('sp')} ELSE '' END || {NL} || 'FATHMM_score: ' || note || {ASKED['insilico']}) AS prompt_sha256 FROM told JOIN w USING (sample_id, varId), note""",
    dealt={n: [SAMPLE, PLACE] for n in ("found", "features")},
    found=FOUND,
    features=f"SELECT {SAMPLE} AS sample_id, {PLACE} AS varId, l_quantity AS CADD_phred, l_discount AS SIFT_score, case when l_suppkey % 2 = 0 then l_tax - 0.04 else l_tax end AS FATHMM_score, l_tax AS spliceAImax, case when l_linenumber = 3 then 1 else 0 end AS cons_splice_acceptor_variant, case when l_linenumber = 4 then 1 else 0 end AS cons_splice_donor_variant FROM {{lineitem}}",
)
def in_silico_prompts(found: DataFrame, features: DataFrame) -> DataFrame:
    return digest(cohort.in_silico_prompts(found, features, SILICO), "sample_id", "varId")


@query(
    """, p AS (SELECT *, CAST(split_part(varId, '_', 2) AS BIGINT) AS pos, split_part(varId, '_', 1) AS chrom FROM found),
n AS (SELECT sample_id, chrom, pos, count(*) FILTER (WHERE upper(base) = 'A') AS a, count(*) FILTER (WHERE upper(base) = 'C') AS c FROM bases GROUP BY ALL)
SELECT p.sample_id, varId, geneSymbol, transcript_id, coalesce(a, 0)::DOUBLE AS ref_count_max, coalesce(a, 0)::DOUBLE AS ref_count_mean, coalesce(c, 0)::DOUBLE AS alt_count_max, coalesce(c, 0)::DOUBLE AS alt_count_min FROM p LEFT JOIN n USING (sample_id, chrom, pos)""",
    found=FOUND,
    bases=f"SELECT {SAMPLE} AS sample_id, cast(l_partkey % 24 + 1 as string) AS chrom, l_orderkey AS pos, case when l_linenumber < 4 then 'a' when l_returnflag = 'A' then 'C' else 'G' end AS base FROM {{lineitem}}",
)
def allele_quantification(found: DataFrame, bases: DataFrame) -> DataFrame:
    return cohort.allele_counts(found, bases).select("sample_id", "varId", "geneSymbol", "transcript_id", "ref_count_max", "ref_count_mean", "alt_count_max", "alt_count_min")


GENE_BLOCK = f"""{NL} || 'Inheritance: ' || CASE WHEN rec = 1 AND dom = 1 THEN 'recessive, dominant' WHEN rec = 1 THEN 'recessive' WHEN dom = 1 THEN 'dominant' ELSE 'unknown' END || {NL} || 'pLI: ' || {four('pli')} || {NL} || 'o/e LOF: ' || {four('oe')} || ' (upper ' || {four('oeu')} || ')'
 || CASE WHEN hi IS NOT NULL THEN {NL} || 'Haploinsufficiency: ' || hi || {NL} || 'Triplosensitivity: ' || ts ELSE '' END"""
EXPRESSION_BLOCK = f"{NL} || 'Expression: raw counts ' || {whole('Outrider_rawcounts')} || ', raw z ' || {four('Outrider_RawZscore')} || ', z ' || {four('Outrider_zScore')} || ', p ' || {four('Outrider_pValue')}"
RNA_ROWS = """, q AS (SELECT *, coalesce(Fraser_pvaluesBetaBinomial_jaccard <= 0.1, false) AS sv, coalesce(Fraser_GenePvalue <= 0.1, false) AS sg, coalesce(abs(Outrider_zScore) >= 1.5, false) AS ou, coalesce(ASE_PVAL <= 0.1, false) AS ae FROM found),
r AS (SELECT * FROM q WHERE sv OR sg OR ou OR ae),
k AS (SELECT sample_id, geneSymbol, arg_min(gnomadGenePLI, (Diagnostic_Engine_Rank, varId, HGVSc)) FILTER (WHERE gnomadGenePLI IS NOT NULL) AS pli, arg_min(gnomadGeneOELof, (Diagnostic_Engine_Rank, varId, HGVSc)) AS oe,
 arg_min(gnomadGeneOELofUpper, (Diagnostic_Engine_Rank, varId, HGVSc)) AS oeu, min(recessive) AS rec, min(dominant) AS dom FROM r GROUP BY ALL),
d AS (SELECT "GENE SYMBOL" AS g, min(HAPLOINSUFFICIENCY) AS hi, min(TRIPLOSENSITIVITY) AS ts FROM dosage GROUP BY 1),
j AS (SELECT r.*, pli, oe, oeu, rec, dom, hi, ts FROM r JOIN k USING (sample_id, geneSymbol) LEFT JOIN d ON upper(geneSymbol) = d.g)"""
DOSAGE = """SELECT 'G' || cast(p_partkey % 300 as string) AS `GENE SYMBOL`, p_brand AS HAPLOINSUFFICIENCY, p_type AS TRIPLOSENSITIVITY FROM {part}"""
ARCHIVE = "SELECT 'chr' || cast(o_custkey % 24 + 1 as string) AS chrom, o_orderkey AS at, o_orderstatus = 'F' AS harmful, o_orderstatus = 'O' AS benign FROM {orders}"


@query(
    RNA_ROWS + f""", b AS (SELECT *, row_number() OVER (PARTITION BY sample_id, geneSymbol ORDER BY Diagnostic_Engine_Rank, varId, HGVSc) AS n FROM j WHERE ou OR sg)
SELECT sample_id, geneSymbol, sha256('RNA evidence of gene ' || geneSymbol || ':' || {GENE_BLOCK} || {NL} || 'Splicing p of the gene: ' || {four('Fraser_GenePvalue')} || {EXPRESSION_BLOCK} || {ASKED['rna_gene']}) AS prompt_sha256 FROM b WHERE n = 1""",
    found=FOUND,
    dosage=DOSAGE,
)
def rna_gene_prompts(found: DataFrame, dosage: DataFrame) -> DataFrame:
    return digest(cohort.rna_prompts(found, dosage)[0], "sample_id", "geneSymbol")


JUNCTION_SQL = " || ".join(f"', {c} ' || {four('Fraser_' + c)}" for c in ("jaccard", "predictedMeans_jaccard", "delta_jaccard", "rawOtherCounts_jaccard", "psi5", "rawOtherCounts_psi5", "delta_psi5", "psi3", "rawOtherCounts_psi3", "delta_psi3", "rawCountsJnonsplit"))


@query(
    RNA_ROWS + f""", u AS (SELECT Chromosome, Fraser_junction_start AS s, Fraser_junction_end AS e, count(*) FILTER (WHERE harmful) AS h, count(*) FILTER (WHERE benign) AS b FROM (SELECT DISTINCT Chromosome, Fraser_junction_start, Fraser_junction_end FROM j) x JOIN archive ON chrom = Chromosome AND archive.at BETWEEN Fraser_junction_start AND Fraser_junction_end GROUP BY ALL),
w AS (SELECT j.*, coalesce(h, 0) AS h, coalesce(b, 0) AS b FROM j LEFT JOIN u ON u.Chromosome = j.Chromosome AND s = Fraser_junction_start AND e = Fraser_junction_end WHERE sv OR ae)
SELECT sample_id, geneSymbol || '_VarId_' || varId AS key, sha256('RNA evidence of ' || geneSymbol || ' ' || varId || ':' || {GENE_BLOCK} || {NL} || 'Junction ' || Chromosome || ':' || {whole('Fraser_junction_start')} || '-' || {whole('Fraser_junction_end')} || ', p ' || {four('Fraser_pvaluesBetaBinomial_jaccard')} || {JUNCTION_SQL}
 || {NL} || 'Harmful, benign records inside: ' || h || ', ' || b || ', ratio ' || CASE WHEN b = 0 THEN 'NA' ELSE CAST(CAST(printf('%.3e', h / b) AS DOUBLE) AS VARCHAR) END || CASE WHEN Outrider_pValue IS NOT NULL THEN {EXPRESSION_BLOCK} ELSE '' END
 || CASE WHEN ASE_PVAL IS NOT NULL AND zyg = 1 THEN {NL} || 'Alleles: p ' || {four('ASE_PVAL')} || ', ref ' || {whole('ASE_REF_COUNT')} || ', alt ' || {whole('ASE_ALT_COUNT')} || ', alt ratio ' || {four('ASE_ALT_RATIO')} ELSE '' END || {ASKED['rna_variant']}) AS prompt_sha256 FROM w""",
    dealt={"found": [SAMPLE, "'G' || cast(l_partkey % 400 as string)"]},
    found=FOUND,
    dosage=DOSAGE,
    archive=ARCHIVE,
)
def rna_variant_prompts(found: DataFrame, dosage: DataFrame, archive: DataFrame) -> DataFrame:
    return digest(cohort.rna_prompts(found, dosage, archive)[1], "sample_id", "key")


PATIENTS = {
    "found": "SELECT DISTINCT 'S' || cast(l_suppkey as string) AS sample_id, 'G' || cast(l_partkey % 400 as string) AS geneSymbol FROM {lineitem}",
    "terms": "SELECT 'S' || cast(s_suppkey as string) AS sample_id, s_nationkey AS ord, case when s_acctbal < 0 then 'HP:0000001' else 'HP:' || cast(s_nationkey as string) end AS hpo_id FROM {supplier}",
    "names": "SELECT 'HP:' || cast(n_nationkey as string) AS id, n_name AS name FROM {nation} UNION ALL SELECT DISTINCT 'HP:0000001' AS id, 'All' AS name FROM {region}",
    "gene_phenotype": "SELECT DISTINCT 'G' || cast(p_partkey % 800 as string) AS gene_symbol, 'HP:' || cast(p_size as string) AS hpo_id, 'term' || cast(p_size as string) AS hpo_name, case when p_size < 20 then '-' else '3/' || cast(p_size as string) end AS frequency FROM {part} WHERE p_size > 5 AND p_partkey % 800 % 16 <> 5",
    "disease_text": "SELECT 'G' || cast(p_partkey % 900 as string) AS gene_symbol, p_name AS Phenotypes, p_type || chr(10) || chr(10) || p_brand AS `Clinical Features` FROM {part} WHERE p_size < 30",
}
PATIENT_SQL = """, k AS (SELECT sample_id, ord, hpo_id, name FROM terms JOIN names ON hpo_id = id), z AS (SELECT sample_id, max((hpo_id <> 'HP:0000001')::INT) AS real, string_agg(name, ', ' ORDER BY ord) AS t FROM k GROUP BY sample_id),
pt AS (SELECT s.sample_id, CASE WHEN real = 1 THEN t ELSE 'All' END AS t FROM (SELECT DISTINCT sample_id FROM found) s LEFT JOIN z USING (sample_id)),
said AS (SELECT sample_id, CASE WHEN t = 'All' THEN 'no phenotype given' ELSE t END AS said FROM pt)"""


def phenotypes(found, terms, names, gene_phenotype, disease_text) -> dict[str, DataFrame]:
    return cohort.phenotype_tables(found, terms, names, gene_phenotype, disease_text)


@query(
    PATIENT_SQL + f""", f AS (SELECT gene_symbol, hpo_id, hpo_name, sum(CASE WHEN frequency = '-' THEN 0 ELSE 3 END) AS num, sum(CASE WHEN frequency = '-' THEN 0 ELSE CAST(split_part(frequency, '/', 2) AS DOUBLE) END) AS den FROM gene_phenotype GROUP BY ALL),
e AS (SELECT gene_symbol, hpo_id, hpo_name || CASE WHEN den > 0 THEN CASE WHEN num / den >= 0.3 THEN ' (Frequent)' WHEN num / den >= 0.05 THEN ' (Occasional)' ELSE ' (Very rare)' END ELSE ' (Frequency not specified)' END AS entry FROM f),
g AS (SELECT gene_symbol, string_agg(entry, ', ' ORDER BY hpo_id) AS t FROM e GROUP BY gene_symbol)
SELECT sample_id, geneSymbol, sha256('Patient: ' || said || '.' || {NL} || 'Gene ' || geneSymbol || ':' || {NL} || coalesce(t, 'Nothing is known.') || {ASKED['hpo']}) AS prompt_sha256 FROM found JOIN said USING (sample_id) LEFT JOIN g ON geneSymbol = gene_symbol""",
    **PATIENTS,
)
def hpo_prompts(**t: DataFrame) -> DataFrame:
    return cohort.phenotype_prompts(phenotypes(**t), hashed)[0].withColumnRenamed("prompt", "prompt_sha256")


OMIM_SQL = PATIENT_SQL + f""", g AS (SELECT gene_symbol, string_agg(gene_symbol || ' causes ' || Phenotypes || '.' || {NL} || 'Clinical Features: ' || trim(replace("Clinical Features", {NL} || {NL}, {NL})), {NL} || {NL} ORDER BY Phenotypes, "Clinical Features") AS t FROM disease_text GROUP BY gene_symbol)"""


@query(
    OMIM_SQL + f""" SELECT sample_id, geneSymbol, sha256('Patient: ' || said || '.' || {NL} || 'Gene ' || geneSymbol || ':' || {NL} || t || {ASKED['omim']}) AS prompt_sha256 FROM found JOIN said USING (sample_id) JOIN g ON geneSymbol = gene_symbol""",
    **PATIENTS,
)
def omim_prompts(**t: DataFrame) -> DataFrame:
    return cohort.phenotype_prompts(phenotypes(**t), hashed)[1].withColumnRenamed("prompt", "prompt_sha256")


@query(OMIM_SQL + " SELECT sample_id, count(*) FILTER (WHERE t IS NULL) AS n_skipped FROM found LEFT JOIN g ON geneSymbol = gene_symbol GROUP BY sample_id", **PATIENTS)
def omim_skipped(**t: DataFrame) -> DataFrame:
    return cohort.phenotype_prompts(phenotypes(**t))[2]


LITERATURE = PATIENTS | {
    "publications": "SELECT 'G' || cast(o_custkey % 400 as string) AS gene, cast(o_orderkey as string) AS PMID, case when o_orderpriority < '2' then 'Mutation of G' || cast(o_custkey % 400 as string) when o_orderpriority < '3' then 'a because of G' || cast(o_custkey % 400 as string) else 'G' || cast(o_custkey % 400 as string) || ' Causes ' || o_orderpriority end AS title, 'pre-G' || cast(o_custkey % 400 as string) || ' text' AS abstract, o_orderkey AS relevance FROM {orders}",
}
TRIAGED = """, bare AS (SELECT DISTINCT geneSymbol FROM found WHERE geneSymbol NOT IN (SELECT gene_symbol FROM gene_phenotype)),
pub AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY relevance, PMID) AS place FROM publications JOIN bare ON gene = geneSymbol WHERE NOT contains(title, 'because'))"""


@query(
    TRIAGED + f""" SELECT geneSymbol, sha256('Gene ' || geneSymbol || '. Which of these publications are about rare disease, and of which kind: functional study, review, case report, patient cohort, phenotype association?' || {NL} || 'Answer with a tab-separated table with the header PMID, Title, Category and nothing else.' || {NL} || string_agg('- ' || PMID || ': ' || title, {NL} ORDER BY place)) AS prompt_sha256 FROM pub WHERE place <= 50 GROUP BY geneSymbol""",
    **LITERATURE,
)
def triage_prompts(publications: DataFrame, **t: DataFrame) -> DataFrame:
    return digest(cohort.triage_prompts(phenotypes(**t), t["gene_phenotype"], publications)[0], "geneSymbol")


@query(
    PATIENT_SQL + f""", bare AS (SELECT DISTINCT sample_id, geneSymbol FROM found WHERE geneSymbol NOT IN (SELECT gene_symbol FROM gene_phenotype)),
x AS (SELECT geneSymbol, PMID, line, title FROM cells WHERE kind IN (' Review', 'case report', 'Functional Study ')),
y AS (SELECT *, row_number() OVER (PARTITION BY geneSymbol, PMID ORDER BY line) AS n FROM x), ab AS (SELECT PMID, string_agg(text, ' ' ORDER BY part) AS abstract FROM parts GROUP BY PMID),
l AS (SELECT geneSymbol, string_agg(title || ': ' || abstract, {NL} || {NL} ORDER BY line) AS t FROM y JOIN ab USING (PMID) WHERE n = 1 GROUP BY geneSymbol)
SELECT sample_id, geneSymbol, sha256('Patient: ' || pt.t || '.' || {NL} || 'Gene ' || geneSymbol || ':' || {NL} || l.t || {ASKED['literature']}) AS prompt_sha256 FROM bare JOIN l USING (geneSymbol) JOIN pt USING (sample_id)""",
    **PATIENTS,
    cells="SELECT 'G' || cast(o_custkey % 400 as string) AS geneSymbol, cast(o_orderkey as string) AS PMID, row_number() OVER (PARTITION BY o_custkey % 400 ORDER BY o_orderkey) AS line, 'title ' || cast(o_orderkey as string) AS title, case when o_orderpriority < '2' then ' Review' when o_orderpriority < '3' then 'case report' when o_orderpriority < '4' then 'Functional Study ' else 'unrelated' end AS kind FROM {orders}",
    parts="SELECT cast(l_orderkey as string) AS PMID, l_linenumber AS part, min('part ' || l_returnflag) AS text FROM {lineitem} GROUP BY 1, 2",
)
def literature_prompts(cells: DataFrame, parts: DataFrame, **t: DataFrame) -> DataFrame:
    """The triage answers are made as reviewers write them: a table inside a text, with spelled-out tabs."""
    row = F.concat_ws("\\t", "PMID", "title", "kind")
    triage = cells.groupBy("geneSymbol").agg(F.concat(F.lit("PMID\\tTitle\\tCategory\n"), ranks.joined_text(F.col("line"), row, "\n")).alias("response"))
    return cohort.literature_prompts(phenotypes(**t), t["gene_phenotype"], triage, parts, hashed).withColumnRenamed("prompt", "prompt_sha256")


def answer_query(kind: str) -> None:
    """Registers answer_parse_<agent>: answers with all keys, without the last one, and broken ones."""
    fields = list(evidence.DEFAULTS[kind])
    whole_ = " || ', ' || ".join(f"'\"{f}\": \"' || event_type || '{i}\"'" for i, f in enumerate(fields))
    a = f"SELECT event_id, event_type, case when event_id % 5 = 0 then '{{{{' when event_id % 5 = 1 then '{{{{\"{fields[0]}\": \"x\"}}}}' when event_id % 5 = 2 then null else '{{{{' || {whole_} || '}}}}' end AS response FROM {{events}}"
    made = ", ".join(f"CASE event_id % 5 WHEN 0 THEN '{d}' WHEN 1 THEN '{'x' if i == 0 else d}' WHEN 2 THEN '{d}' ELSE event_type || '{i}' END AS {f}" for i, (f, d) in enumerate(evidence.DEFAULTS[kind].items()))

    def run(a: DataFrame) -> DataFrame:
        return evidence.parsed(a, kind).select("event_id", *fields)

    run.__name__ = f"answer_parse_{kind}"
    query(f" SELECT event_id, {made} FROM a", a=a)(run)


for _kind in evidence.DEFAULTS:
    answer_query(_kind)


@query(
    """, s AS (SELECT *, coalesce(split_part(split_part(HGVSc, ':', 1), '.', 1), '-') AS transcript_id, coalesce(CASE WHEN contains(HGVSc, ':') THEN substr(HGVSc, instr(HGVSc, ':') + 1) END, '-') AS HGVSc_core FROM scores WHERE geneSymbol IN (SELECT gene_name FROM genes WHERE gene_type = 'protein_coding')),
m AS (SELECT DISTINCT split_part(transcript_id, '.', 1) AS t FROM mane), k AS (SELECT s.*, 4 * (m.t IS NOT NULL)::INT + 2 * coalesce(HGVSp <> '-', true)::INT + coalesce(HGVSc <> '-', true)::INT AS transcript_score FROM s LEFT JOIN m ON s.transcript_id = m.t),
n AS (SELECT *, row_number() OVER (PARTITION BY sample_id, varId, geneSymbol ORDER BY transcript_score DESC, HGVSc NULLS FIRST, HGVSp NULLS FIRST) AS n FROM k),
c AS (SELECT DISTINCT SampleID AS sample_id, CASE WHEN chr = 'chrM' THEN 'MT' ELSE replace(chr, 'chr', '') END || '_' || pos || '_' || ref || '_' || alt AS varId FROM truth)
SELECT p.sample_id, p.varId, p.zyg, geneSymbol, transcript_id, HGVSc_core, transcript_score, (c.varId IS NOT NULL)::INT AS is_causal FROM predictions p JOIN n ON p.sample_id = n.sample_id AND p.varId = n.varId AND n.n = 1 LEFT JOIN c ON p.sample_id = c.sample_id AND p.varId = c.varId""",
    predictions=f"SELECT {SAMPLE} AS sample_id, {VARIANT} AS varId, min(l_linenumber) AS zyg FROM {{lineitem}} GROUP BY 1, 2",
    scores=f"SELECT {SAMPLE} AS sample_id, {VARIANT} AS varId, 'P' || cast(l_partkey as string) AS geneSymbol, case when l_linenumber = 5 then null when l_linenumber = 7 then '-' else 'T' || cast(l_partkey as string) || '.1:c.' || cast(l_orderkey as string) end AS HGVSc, case when l_returnflag = 'R' then '-' else 'p.1' end AS HGVSp FROM {{lineitem}}",
    genes="SELECT case when p_size < 40 then 'protein_coding' else 'lncRNA' end AS gene_type, 'P' || cast(p_partkey as string) AS gene_name FROM {part}",
    mane="SELECT 'T' || cast(p_partkey as string) || '.9' AS transcript_id FROM {part} WHERE p_size < 20",
    truth=f"SELECT {SAMPLE} AS SampleID, 'chr' || cast(l_partkey % 24 + 1 as string) AS chr, cast(l_orderkey as string) AS pos, substr('ACGT', cast(l_linenumber % 4 + 1 as int), 1) AS ref, substr('CGTA', cast(l_linenumber % 4 + 1 as int), 1) AS alt FROM {{lineitem}} WHERE l_returnflag = 'R'",
)
def var_to_gene(predictions: DataFrame, scores: DataFrame, genes: DataFrame, mane: DataFrame, truth: DataFrame) -> DataFrame:
    return cohort.annotated(predictions, scores, genes, mane, truth).select("sample_id", "varId", "zyg", "geneSymbol", "transcript_id", "HGVSc_core", "transcript_score", "is_causal")


EXPRESSED = f"SELECT {SAMPLE} AS sampleID, 'G' || cast(l_partkey % 400 as string) AS GeneSymbol, min(l_discount) AS pValue, max(l_tax) AS padjust, max(l_quantity) - 25 AS zScore, min(l_tax) AS l2fc, count(*) AS rawcounts, max(l_suppkey) AS more FROM {{lineitem}} GROUP BY 1, 2"
SPLICED = SPANS.replace("l_quantity AS psi5", "l_quantity AS psi5, l_tax AS psi3, l_tax AS rawOtherCounts_psi5, l_tax AS rawOtherCounts_psi3, l_tax AS rawCountsJnonsplit, l_tax AS jaccard, l_tax AS rawOtherCounts_jaccard, l_tax AS delta_jaccard, l_tax AS delta_psi5, l_tax AS delta_psi3, l_tax AS predictedMeans_jaccard")
ALLELES = f"SELECT {SAMPLE} AS sampleID, case when l_partkey % 24 = 22 then 'chrx' when l_partkey % 24 = 23 then 'chrM' else 'CHR' || cast(l_partkey % 24 + 1 as string) end AS CHROM, l_orderkey AS POS, 'A' AS REF, 'C' AS ALT, cast(max(l_quantity) as int) AS REF_COUNT, cast(min(l_quantity) as int) AS ALT_COUNT, max(l_tax) AS ALT_RATIO, min(l_discount) AS PVAL, 1 AS IS_MAE FROM {{lineitem}} WHERE l_returnflag = 'A' GROUP BY 1, 2, 3"


@query(
    """ SELECT 'expression' AS kind, sampleID AS sample_id, GeneSymbol AS key, round(sum(zScore), 4) AS value FROM expression GROUP BY ALL
UNION ALL SELECT 'splicing', sampleID, seqnames, round(sum(psi5 + psi3), 4) FROM splicing GROUP BY ALL
UNION ALL SELECT 'ase', sampleID, CASE WHEN CHROM = 'chrx' THEN '23' ELSE replace(CHROM, 'CHR', '') END || '_' || POS || '_A_C', round(sum(PVAL), 4) FROM ase WHERE CHROM <> 'chrM' GROUP BY ALL""",
    expression=EXPRESSED,
    splicing=SPLICED,
    ase=ALLELES,
)
def rna_inputs(expression: DataFrame, splicing: DataFrame, ase: DataFrame) -> DataFrame:
    e, s, a = cohort.rna_tables(expression, splicing, ase)
    assert e.columns == cohort.EXPRESSION and s.columns == cohort.SPLICING
    one = lambda df, kind, key, value: df.groupBy(F.lit(kind).alias("kind"), F.col("sampleID").alias("sample_id"), F.col(key).alias("key")).agg(F.round(F.sum(value), 4).alias("value"))
    return one(e, "expression", "GeneSymbol", F.col("zScore")).unionAll(one(s, "splicing", "seqnames", F.col("psi5") + F.col("psi3"))).unionAll(one(a, "ase", "varId", F.col("PVAL")))


@query(
    " SELECT sample_id, bool_or(x.k = 1) AS has_expression, bool_or(x.k = 2) AS has_ase FROM (SELECT sample_id, 0 AS k FROM samples UNION ALL SELECT sample_id, 1 FROM samples SEMI JOIN expression ON sampleID = sample_id UNION ALL SELECT sample_id, 2 FROM samples SEMI JOIN ase ON sampleID = sample_id) x GROUP BY sample_id",
    samples="SELECT cast(c_custkey as string) AS sample_id FROM {customer}",
    expression="SELECT cast(o_custkey as string) AS sampleID FROM {orders} WHERE o_orderstatus = 'F'",
    ase="SELECT cast(o_custkey as string) AS sampleID FROM {orders} WHERE o_totalprice > 300000",
)
def modality_flags(samples: DataFrame, expression: DataFrame, ase: DataFrame) -> DataFrame:
    return cohort.modalities(samples, expression=expression, ase=ase)


def expert_weights() -> dict:
    """Weights out of formulas: an expert of two inputs, and one of a number and two categories."""
    import numpy as np

    first = {"layers": [(np.array([[1.0], [2.0]]), np.array([0.5]))], "head": (np.array([[1.0]]), np.array([-0.25]))}
    second = {"layers": [(np.array([[1.0], [3.0], [-1.0]]), np.zeros(1))], "head": (np.array([[2.0]]), np.zeros(1))}
    return {"domains": {"InSilico": first, "Genetics": second}, "fusion": [], "out": (np.array([[1.0], [0.5]]), np.array([0.125]))}


@query(
    """, n AS (SELECT *, TRY_CAST(f1 AS DOUBLE) AS a, f2 AS b FROM rows_), q AS (SELECT quantile_disc(a, 0.5) AS ma, stddev_pop(a) AS sa, quantile_disc(b, 0.5) AS mb, stddev_pop(b) AS sb FROM n),
z AS (SELECT sample_id, varId, geneSymbol, zyg, (coalesce(a, ma) - ma) / sa AS x, (coalesce(b, mb) - mb) / sb AS y, (kind = 'R')::INT AS r, (kind = 'A')::INT AS o FROM n, q),
h AS (SELECT *, greatest(x + 2 * y + 0.5, 0) AS h1, greatest(y + 3 * r - o, 0) AS h2 FROM z),
s AS (SELECT *, h1 - 0.25 AS s1, 2 * h2 AS s2, h1 + 0.5 * h2 + 0.125 AS l FROM h),
p AS (SELECT sample_id, varId, max(s1) AS a, max(s2) AS b, max(1 / (1 + exp(-l))) AS c FROM s GROUP BY ALL),
r AS (SELECT sample_id, varId, count(*) OVER (PARTITION BY sample_id ORDER BY a DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ra, count(*) OVER (PARTITION BY sample_id ORDER BY b DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rb,
 count(*) OVER (PARTITION BY sample_id ORDER BY c DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rc FROM p)
SELECT sample_id, varId, geneSymbol, zyg, round(l, 3) AS overall_logit, round(1 / (1 + exp(-l)), 3) AS overall_prob, round(s1, 3) AS score_InSilico, round(s2, 3) AS score_Genetics, CAST(ra AS INT) AS rank_InSilico, CAST(rb AS INT) AS rank_Genetics, CAST(rc AS INT) AS Diagnostic_Engine_Rank FROM s JOIN r USING (sample_id, varId)""",
    dealt={"rows_": [SAMPLE]},
    rows_=f"SELECT {SAMPLE} AS sample_id, {VARIANT} AS varId, 'G' || cast(l_partkey as string) AS geneSymbol, min(l_linenumber) AS zyg, case when min(l_linenumber) = 3 then 'x' else cast(min(cast(l_quantity as int)) as string) end AS f1, case when min(l_linenumber) = 4 then null else cast(max(l_linenumber) as double) end AS f2, max(l_returnflag) AS kind, 0 AS unused FROM {{lineitem}} GROUP BY 1, 2, 3",
)
def scored_table(rows_: DataFrame) -> DataFrame:
    """Raw columns, imputed, standardised and one-hot, to expert scores and ranks by probability."""
    # medians take several passes, over a table that needs no exchange
    numbers = sinks.materialised(rows_.select("f1", "f2"), "numbers")
    fitted = score.fit_standard(numbers, ["f1", "f2"])
    df = cohort.scored(rows_, {"InSilico": ["f1", "f2"], "Genetics": ["f2", "absent"]}, expert_weights(), fitted, {"Genetics": {"kind": ["R", "A"]}}, on_logit=False, tasks=tasks_of(numbers))
    assert "unused" not in df.columns
    return df.select("sample_id", "varId", "geneSymbol", "zyg", *[F.round(c, 3).alias(c) for c in ("overall_logit", "overall_prob", "score_InSilico", "score_Genetics")], "rank_InSilico", "rank_Genetics", "Diagnostic_Engine_Rank")


@query(
    """, v AS (SELECT *, 'chr' || CASE split_part(varId, '_', 1) WHEN '23' THEN 'X' WHEN '24' THEN 'Y' ELSE split_part(varId, '_', 1) END AS Chromosome, CAST(split_part(varId, '_', 2) AS BIGINT) AS Pos FROM variants),
s AS (SELECT sampleID AS sample_id, seqnames AS Chromosome, start, "end", hgnc_symbol, pvaluesBetaBinomial_jaccard AS p FROM splicing WHERE hgnc_symbol IS NOT NULL),
g AS (SELECT sample_id, geneSymbol, min(p) AS gp FROM (SELECT sample_id, unnest(string_split(hgnc_symbol, ';')) AS geneSymbol, p FROM s) GROUP BY ALL),
h AS (SELECT v.sample_id, v.varId, min(s.p) AS p FROM (SELECT DISTINCT sample_id, varId, Chromosome, Pos FROM v) v JOIN s ON v.sample_id = s.sample_id AND v.Chromosome = s.Chromosome AND v.Pos BETWEEN s.start AND s."end" GROUP BY ALL),
e AS (SELECT sampleID AS sample_id, GeneSymbol AS geneSymbol, pValue FROM expression), a AS (SELECT sampleID AS sample_id, CASE WHEN CHROM = 'chrx' THEN '23' ELSE replace(CHROM, 'CHR', '') END || '_' || POS || '_A_C' AS varId, PVAL FROM ase WHERE CHROM <> 'chrM'),
m AS (SELECT v.*, e.pValue, g.gp, h.p, a.PVAL, Diagnostic_Engine_Rank <= 20 AS r1, rank_InSilico <= 10 AND Diagnostic_Engine_Rank <= 100 AS r2, rank_Database <= 10 AND Diagnostic_Engine_Rank <= 100 AS r3, rank_Genetics <= 10 AND Diagnostic_Engine_Rank <= 100 AS r4,
 coalesce(h.p < 0.00001, false) OR (coalesce(e.pValue < 0.00001, false) AND Diagnostic_Engine_Rank <= 100) AS r5 FROM v LEFT JOIN e USING (sample_id, geneSymbol) LEFT JOIN g USING (sample_id, geneSymbol) LEFT JOIN h ON v.sample_id = h.sample_id AND v.varId = h.varId LEFT JOIN a ON v.sample_id = a.sample_id AND v.varId = a.varId),
x AS (SELECT *, r1 OR r2 OR r3 OR r4 OR r5 AS hit FROM m), c AS (SELECT sample_id, geneSymbol, count(DISTINCT varId) AS total, count(DISTINCT CASE WHEN hit THEN varId END) AS strong, bool_or(hit AND recessive = 1) AS rescue FROM x GROUP BY ALL)
SELECT x.sample_id, x.geneSymbol, x.varId, round(x.gp, 6) AS Fraser_GenePvalue, round(x.p, 6) AS Fraser_p, round(x.PVAL, 6) AS ASE_PVAL, strong >= 1 AND total - strong >= 1 AS is_compound_het_group,
 concat_ws(', ', CASE WHEN r1 THEN 'Strong DNA Evidence' END, CASE WHEN r2 THEN 'Strong In-Silico Evidence' END, CASE WHEN r3 THEN 'Strong Database Evidence' END, CASE WHEN r4 THEN 'Strong Genetics Evidence' END, CASE WHEN r5 THEN 'Strong RNA Evidence' END,
 CASE WHEN strong >= 1 AND total - strong >= 1 THEN 'Compound Heterozygous (Compound Het)' END) AS evidence_rules FROM x JOIN c USING (sample_id, geneSymbol) WHERE (hit OR rescue) AND geneSymbol <> '-'""",
    dealt={n: [SAMPLE] for n in ("variants", "expression", "splicing", "ase")},
    variants=f"SELECT {SAMPLE} AS sample_id, {GENE} AS geneSymbol, {PLACE} AS varId, min(l_linenumber) % 2 AS recessive, cast(min(l_quantity) as int) * 4 AS Diagnostic_Engine_Rank, cast(max(l_quantity) as int) AS rank_InSilico, cast(min(l_partkey) % 50 as int) AS rank_Database, min(l_linenumber) * 9 AS rank_Genetics FROM {{lineitem}} GROUP BY 1, 2, 3",
    expression=EXPRESSED,
    splicing=SPLICED,
    ase=ALLELES,
)
def candidate_table(variants: DataFrame, expression: DataFrame, splicing: DataFrame, ase: DataFrame) -> DataFrame:
    df = cohort.candidates(variants, *cohort.rna_tables(expression, splicing, ase))
    return df.select("sample_id", "geneSymbol", "varId", F.round("Fraser_GenePvalue", 6).alias("Fraser_GenePvalue"), F.round("Fraser_pvaluesBetaBinomial_jaccard", 6).alias("Fraser_p"), F.round("ASE_PVAL", 6).alias("ASE_PVAL"), "is_compound_het_group", "evidence_rules")


@query(
    """, j AS (SELECT p.*, s1.seq AS a, s2.seq AS b, greatest(0, pos - 31) AS s, pos + 30 AS e FROM points p LEFT JOIN reference s1 ON p.chrom = s1.chrom AND s1.chunk_start = greatest(0, pos - 31) // 60 * 60 LEFT JOIN reference s2 ON p.chrom = s2.chrom AND s2.chunk_start = greatest(0, pos - 31) // 60 * 60 + 60)
SELECT chrom, pos, coalesce(upper(substr(a || coalesce(b, ''), CAST(s - s // 60 * 60 + 1 AS BIGINT), CAST(e - s AS BIGINT))), '') AS sequence FROM j""",
    points="SELECT DISTINCT cast(o_custkey % 7 as string) AS chrom, o_orderkey % 4000 + 1 AS pos FROM {orders}",
    reference="SELECT cast(p_partkey % 5 as string) AS chrom, cast(floor(p_partkey / 5) as bigint) * 60 AS chunk_start, translate(substr(md5(cast(p_partkey as string)) || md5(p_name), 1, 60), '0123456789abcdef', 'acgtACGTacgtACGT') AS seq FROM {part}",
)
def sequence_windows(points: DataFrame, reference: DataFrame) -> DataFrame:
    return repeats.windows_at(points, reference, 60)


@query(
    f""" SELECT event_id, 'record [id="' || event_id || '", kind="' || event_type || '"]:' || {NL} || '  note: ' || event_type || {NL} || '  empty' || {NL} || '  list:' || {NL} || '    item [n="1"]: first' || {NL} || '    item [n="2"]' AS text FROM e""",
    e="SELECT event_id, event_type, '<record id=\"' || cast(event_id as string) || '\" kind=\"' || event_type || '\"><note> ' || event_type || ' </note><empty/><list><item n=\"1\">first</item><item n=\"2\"/></list></record>' AS xml FROM {events}",
)
def submission_lines(e: DataFrame) -> DataFrame:
    return evidence.submission_texts(e).select("event_id", "text")


@query(
    """ SELECT s.sample_id, count(p.sample_id) AS predicted, max((g.SampleID IS NOT NULL)::INT) AS known, max((x.sample_id IS NULL)::INT) AS unscored FROM (SELECT DISTINCT sample_id FROM predictions) s JOIN predictions p USING (sample_id) LEFT JOIN (SELECT DISTINCT SampleID FROM truth) g ON s.sample_id = g.SampleID LEFT JOIN (SELECT DISTINCT sample_id FROM scores) x ON s.sample_id = x.sample_id GROUP BY s.sample_id""",
    predictions="SELECT 'N' || cast(c_nationkey as string) AS sample_id, cast(c_custkey as string) AS id, c_acctbal AS f FROM {customer}",
    scores="SELECT 'N' || cast(s_nationkey as string) AS sample_id, 'G' AS geneSymbol, cast(s_suppkey as string) AS varId, s_name AS HGVSc, '-' AS HGVSp FROM {supplier} WHERE s_acctbal > 0",
    truth="SELECT 'N' || cast(n_nationkey as string) AS SampleID, 'chr1' AS chr, '1' AS pos, 'A' AS ref, 'C' AS alt FROM {nation} WHERE n_regionkey < 2",
)
def sample_files(predictions: DataFrame, scores: DataFrame, truth: DataFrame) -> DataFrame:
    """A folder per sample with predictions and scores, written and found again, with the samples that lack scores and those with a known cause."""
    spark = predictions.sparkSession
    root = f"{sinks.shared_folder(spark)}/samples-{uuid.uuid4().hex}"
    predictions.write.partitionBy("sample_id").option("header", True).csv(f"{root}/predictions")
    scores.repartition(4).write.partitionBy("sample_id").option("header", True).option("sep", "\t").option("compression", "gzip").csv(f"{root}/scores")
    truth.write.option("header", True).csv(f"{root}/truth.csv")
    folder = r"sample_id=([^/]+)/[^/]+$"
    p = tables.predictions(spark, f"{root}/predictions/*", folder)
    s = tables.scores(spark, f"{root}/scores/*", folder)
    known = tables.known_samples(p, tables.truth(spark, f"{root}/truth.csv"))
    lacking = tables.missing_samples(p, s).filter("lacks = 'scores'")
    out = p.groupBy("sample_id").agg(F.count("varId").alias("predicted"))
    out = out.join(known.withColumn("k", F.lit(1)), "sample_id", "left").join(lacking.select("sample_id", F.lit(1).alias("u")), "sample_id", "left")
    return out.select("sample_id", "predicted", F.coalesce("k", F.lit(0)).alias("known"), F.coalesce("u", F.lit(0)).alias("unscored"))


@query(
    " SELECT sample_id, count(*) FILTER (WHERE NOT broken) AS n_good, count(*) FILTER (WHERE broken) AS n_rejected, round(coalesce(sum(f) FILTER (WHERE NOT broken), 0), 2) AS total FROM (SELECT *, id % 5 < 2 AS broken FROM p) GROUP BY sample_id",
    p="SELECT 'N' || cast(c_nationkey as string) AS sample_id, c_custkey AS id, c_acctbal AS f FROM {customer}",
)
def input_rejects(p: DataFrame) -> DataFrame:
    """Predictions as files with lines that don't fit: a word for a number, or a value too many."""
    spark = p.sparkSession
    root = f"{sinks.shared_folder(spark)}/rejects-{uuid.uuid4().hex}"
    number = F.when(F.col("id") % 5 == 0, "n/a?").when(F.col("id") % 5 == 1, F.concat(F.col("f").cast("string"), F.lit(",extra"))).otherwise(F.col("f").cast("string"))
    lines = p.select("sample_id", F.concat_ws(",", F.col("id").cast("string"), number).alias("value"))
    heads = p.select("sample_id").distinct().select("sample_id", F.lit("varId,overall_logit").alias("value"))
    lines.unionAll(heads).repartition("sample_id").sortWithinPartitions("sample_id", F.col("value").desc()).write.partitionBy("sample_id").text(root)
    rows = tables.declared(spark, f"{root}/*", tables.KINDS["predictions"], pattern=r"sample_id=([^/]+)/[^/]+$")
    tables.require_inputs(p, rows, "predictions")
    sums = tables.good(rows).groupBy("sample_id").agg(F.sum("overall_logit").alias("total"))
    return tables.reject_counts(rows).join(sums, "sample_id", "left").select("sample_id", "n_good", "n_rejected", F.round(F.coalesce("total", F.lit(0.0)), 2).alias("total"))


@query(
    " SELECT sample_id, kind, count(*) AS n, round(sum(price), 2) AS total FROM l GROUP BY ALL",
    l="SELECT 'S' || cast(l_suppkey % 20 as string) AS sample_id, l_returnflag AS kind, l_linenumber AS line, l_extendedprice AS price FROM {lineitem}",
)
def resume_manifest(l: DataFrame) -> DataFrame:  # noqa: E741
    """A table made in four runs, one of which was killed while it wrote and one of which saw other inputs, equals that of one clean run."""
    spark = l.sparkSession
    path = f"{sinks.shared_folder(spark)}/resume-{uuid.uuid4().hex}"
    make = lambda rows: rows.groupBy("sample_id", "kind").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total"))
    early = F.col("sample_id").isin(*[f"S{i}" for i in range(8)])
    sinks.resume(l.filter(early & (F.col("line") < 4)), make, path)
    # killed: rows of some samples are there, half of them, without a record
    make(l.filter(F.col("sample_id").isin("S8", "S9") & (F.col("line") == 1))).write.mode("append").partitionBy("sample_id").parquet(f"{path}/rows")
    sinks.resume(l.filter(early), make, path)
    sinks.resume(l, make, path)
    if sinks.resume(l, make, path):
        raise AssertionError("a finished sample was made again")
    return sinks.finished(spark, path).select("sample_id", "kind", "n", "total")


@query(
    """ SELECT 'terms' AS kind, s AS key, string_agg(h, '|' ORDER BY h) AS value FROM patients GROUP BY s UNION ALL SELECT 'ontology', id, name FROM names UNION ALL SELECT 'gene_phenotype', gene_symbol, string_agg(hpo_id || '=' || frequency, '|' ORDER BY hpo_id, frequency) FROM gene_phenotype GROUP BY 2
UNION ALL SELECT 'disease', gene_symbol, string_agg("Clinical Features", '|' ORDER BY "Clinical Features") FROM disease_text GROUP BY 2 UNION ALL SELECT 'dosage', "GENE SYMBOL", string_agg(HAPLOINSUFFICIENCY, '|' ORDER BY HAPLOINSUFFICIENCY) FROM dosage GROUP BY 2
UNION ALL SELECT 'answers', cast(n_nationkey as varchar), n_name FROM answers UNION ALL SELECT 'map', gene_symbol, 'x' || gene_symbol FROM (SELECT DISTINCT gene_symbol FROM gene_phenotype) UNION ALL SELECT 'genes', gene_name, gene_type FROM genes""",
    patients="SELECT DISTINCT 'S' || cast(s_nationkey as string) AS s, 'HP:' || cast(s_suppkey as string) AS h FROM {supplier}",
    names="SELECT 'HP:' || cast(n_nationkey as string) AS id, n_name AS name FROM {nation}",
    gene_phenotype="SELECT DISTINCT 'G' || cast(p_partkey % 800 as string) AS gene_symbol, 'HP:' || cast(p_size as string) AS hpo_id, 'term' || cast(p_size as string) AS hpo_name, case when p_size < 20 then '-' else '3/' || cast(p_size as string) end AS frequency FROM {part}",
    disease_text="SELECT 'G' || cast(p_partkey % 900 as string) AS gene_symbol, p_name AS Phenotypes, p_type || chr(10) || '\"' || p_brand || '\"' AS `Clinical Features` FROM {part}",
    dosage=DOSAGE,
    answers="SELECT n_nationkey, n_name FROM {nation}",
    genes="SELECT 'P' || cast(p_partkey as string) AS gene_name, p_brand AS gene_type FROM {part}",
)
def dimension_files(patients: DataFrame, names: DataFrame, gene_phenotype: DataFrame, disease_text: DataFrame, dosage: DataFrame, answers: DataFrame, genes: DataFrame) -> DataFrame:
    """The small inputs as the files that they come in, read again."""
    spark = patients.sparkSession
    root = f"{sinks.shared_folder(spark)}/dimensions-{uuid.uuid4().hex}"
    header = lambda df, sep=",": df.write.option("header", True).option("sep", sep).option("escape", '"').option("quoteAll", True)
    patients.groupBy("s").agg(F.concat_ws("\n\n", F.collect_list("h")).alias("value")).repartition("s").write.partitionBy("s").option("lineSep", "\n").text(f"{root}/terms")
    names.select(F.concat(F.lit("\n[Term]\nid: "), "id", F.lit("\nname: "), "name", F.lit("\n")).alias("value")).coalesce(1).write.text(f"{root}/obo")
    header(gene_phenotype, "\t").csv(f"{root}/gene_phenotype")
    header(disease_text, "\t").csv(f"{root}/disease")
    header(dosage).csv(f"{root}/dosage")
    answers.select("n_nationkey", F.to_json(F.struct(F.col("n_name").alias("Reasoning"), F.lit("Strong").alias("Conclusion"))).alias("value")).repartition("n_nationkey").write.partitionBy("n_nationkey").text(f"{root}/answers")
    genes.write.parquet(f"{root}/genes.parquet")
    sinks.write_map(gene_phenotype.select(F.col("gene_symbol").alias("gene"), F.concat(F.lit("x"), "gene_symbol").alias("text")).distinct(), f"{root}/map")
    joined = lambda c: F.concat_ws("|", F.sort_array(F.collect_list(c)))
    row = lambda kind, df, key, value: df.groupBy(F.lit(kind).alias("kind"), F.col(key).alias("key")).agg(value.alias("value"))
    parts = [
        row("terms", tables.patient_term_lists(spark, f"{root}/terms/*", pattern=r"/s=([^/]+)/[^/]+$"), "sample_id", joined("hpo_id")),
        row("ontology", tables.ontology(spark, f"{root}/obo"), "id", F.min("name")),
        row("gene_phenotype", tables.gene_phenotypes(spark, f"{root}/gene_phenotype"), "gene_symbol", ranks.joined_text(F.struct("hpo_id", "frequency"), F.concat_ws("=", "hpo_id", "frequency"), "|")),
        row("disease", tables.disease_descriptions(spark, f"{root}/disease"), "gene_symbol", joined(F.col("Clinical Features"))),
        row("dosage", tables.dosage(spark, f"{root}/dosage"), "GENE SYMBOL", joined("HAPLOINSUFFICIENCY")),
        row("answers", evidence.named(tables.answers(spark, f"{root}/answers/*", r"=([^/]+)/[^/]+$"), "insilico", "Insilico"), "key", F.min("Insilico_Reasoning")),
        row("map", spark.read.schema("gene string, text string").json(f"{root}/map"), "gene", F.min("text")),
        row("genes", tables.annotation(spark, f"{root}/genes.parquet", "gene_name", "gene_type"), "gene_name", F.min("gene_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(
    """, n AS (SELECT *, row_number() OVER (PARTITION BY sample_id, geneSymbol, varId ORDER BY Diagnostic_Engine_Rank, HGVSc) AS n FROM v WHERE Tier = 1), m AS (SELECT * FROM n WHERE n = 1)
SELECT sample_id, 'SINGLE::' || sample_id || '::' || geneSymbol || '::' || varId AS entity, geneSymbol AS geneSymbol_set, coalesce(HGVSc, '') AS HGVSc_set, coalesce(HGVSp, '') AS HGVSp_set, varId AS member_variant_ids FROM m WHERE partner = ''
UNION ALL SELECT sample_id, 'COMPOUND::' || sample_id || '|' || upper(geneSymbol) || '|CH|' || varId || '|' || partner, geneSymbol, least(HGVSc, HGVSc2) || CASE WHEN HGVSc = HGVSc2 THEN '' ELSE '|' || greatest(HGVSc, HGVSc2) END, CASE WHEN HGVSp = HGVSp2 THEN HGVSp ELSE least(HGVSp, HGVSp2) || '|' || greatest(HGVSp, HGVSp2) END, varId || '|' || partner
 FROM (SELECT a.*, b.HGVSc AS HGVSc2, b.HGVSp AS HGVSp2 FROM m a JOIN m b ON a.sample_id = b.sample_id AND a.geneSymbol = b.geneSymbol AND a.partner = b.varId WHERE a.varId < a.partner)""",
    v="""SELECT 'S' || cast(o_custkey as string) AS sample_id, 'g' || cast(cast(floor(o_orderkey / 2) as bigint) as string) AS geneSymbol, 'v' || cast(o_orderkey as string) AS varId, '' AS partner, o_orderpriority AS HGVSc, o_orderstatus AS HGVSp, 1 AS Tier, cast(o_orderkey as int) AS Diagnostic_Engine_Rank, 1 AS rank_InSilico,
 'Good Fit' AS HPO_Conclusion, 'Neutral' AS Database_Conclusion, 'Strong' AS Insilico_Conclusion, 'x' AS RNA_GeneLevel_Conclusion, 'x' AS RNA_VarLevel_Conclusion, 1 AS inheritance_match, o_orderstatus = 'F' AS frame_shift FROM {orders}
 UNION ALL SELECT 'P' || cast(p_size as string), 'h' || cast(cast(floor(p_partkey / 2) as bigint) as string), 'v' || cast(p_partkey as string), '', p_brand, p_type, 1, cast(p_partkey as int), 1, 'Good Fit', 'Neutral', 'Strong', 'x', 'x', 1, false FROM {part}
 UNION ALL SELECT 'C' || cast(c_nationkey as string), 'k' || cast(c_custkey as string), 'a' || cast(c_custkey as string), 'b' || cast(c_custkey as string), c_mktsegment, 'p.1', 1, cast(c_custkey as int), 1, 'Good Fit', 'Neutral', 'Strong', 'x', 'x', 1, false FROM {customer}
 UNION ALL SELECT 'C' || cast(c_nationkey as string), 'k' || cast(c_custkey as string), 'b' || cast(c_custkey as string), 'a' || cast(c_custkey as string), c_name, 'p.2', 1, cast(c_custkey as int), 1, 'Good Fit', 'Neutral', 'Strong', 'x', 'x', 1, false FROM {customer}""",
)
def entity_sets(v: DataFrame) -> DataFrame:
    found, _ = vote.entities(vote.metrics(v), (1,))
    return found.select("sample_id", F.col("pairwise_entity_id").alias("entity"), "geneSymbol_set", "HGVSc_set", "HGVSp_set", "member_variant_ids")


# Candidates of small genes, whose verdicts are functions of what the reviewers saw.
REVIEWED = f"""SELECT {SAMPLE} AS sample_id, 'G' || cast(l_partkey % 12 as string) AS geneSymbol, {PLACE} AS varId, cast(min(l_linenumber) as string) AS transcript_id, min(l_linenumber) % 2 AS recessive, cast(min(l_suppkey) % 2 as int) AS dominant,
 case when min(l_linenumber) = 1 then 2 else 1 end AS zyg, case when min(l_partkey) % 24 = 22 then 'chrX' else 'chr1' end AS Chromosome, min(l_linenumber) % 3 AS cons_frameshift_variant, case when max(l_returnflag) = 'R' then 'p.A1Ter' else 'p.A1C' end AS HGVSp,
 case when min(l_linenumber) < 4 then 'c.1del' else 'c.1' end AS HGVSc, cast(min(l_orderkey) % 1000 as int) AS Diagnostic_Engine_Rank, cast(min(l_partkey) % 200 as int) AS rank_InSilico, 'Strong DNA Evidence' AS evidence_rules FROM {{lineitem}} GROUP BY 1, 2, 3"""
BASES = f"SELECT {SAMPLE} AS sample_id, cast(l_partkey % 24 + 1 as string) AS chrom, l_orderkey AS pos, case when l_linenumber < 4 then 'A' else 'C' end AS base FROM {{lineitem}}"
SEQUENCES = "SELECT c.chrom, p.p_partkey * 300 AS chunk_start, case when p.p_partkey % 3 = 0 then repeat('A', 300) else substr(translate(repeat(md5(p.p_name || cast(p.p_partkey as string)) || md5(p.p_type || cast(p.p_partkey as string)) || md5(p.p_brand || cast(p.p_partkey as string)), 4), '0123456789abcdef', 'CGTCGTCTGCTGCTGT'), 1, 300) end AS seq FROM {part} p, (SELECT DISTINCT cast(n_nationkey as string) AS chrom FROM {nation}) c"
JUDGED = f""", ct AS (SELECT sample_id, chrom, pos, count(*) FILTER (WHERE base = 'A') AS a, count(*) FILTER (WHERE base = 'C') AS c FROM bases GROUP BY ALL),
pl AS (SELECT *, split_part(varId, '_', 1) AS chrom, CAST(split_part(varId, '_', 2) AS BIGINT) AS pos, greatest(0, CAST(split_part(varId, '_', 2) AS BIGINT) - 31) AS lo FROM found),
sq AS (SELECT pl.*, coalesce(substr(coalesce(x.seq, '') || coalesce(y.seq, ''), CASE WHEN x.seq IS NULL THEN 1 ELSE CAST(lo % 300 + 1 AS BIGINT) END, CASE WHEN x.seq IS NULL THEN greatest(lo % 300 + pos + 30 - lo - 300, 0)::BIGINT ELSE CAST(pos + 30 - lo AS BIGINT) END), '') AS seq FROM pl LEFT JOIN reference x ON x.chrom = pl.chrom AND x.chunk_start = lo // 300 * 300 LEFT JOIN reference y ON y.chrom = pl.chrom AND y.chunk_start = lo // 300 * 300 + 300),
c AS (SELECT sq.sample_id, geneSymbol, varId, transcript_id, recessive, dominant, zyg, Chromosome, cons_frameshift_variant, HGVSp, HGVSc, Diagnostic_Engine_Rank, rank_InSilico, evidence_rules, contains(HGVSc, 'del') AND contains(seq, 'AAAAAAAAAA') AS has_repeat_motif,
 coalesce(a, 0)::DOUBLE AS ref_count_mean, coalesce(c, 0)::DOUBLE AS alt_count_mean, coalesce(c, 0)::DOUBLE AS alt_count_min,
 CASE WHEN sq.pos % 3 = 0 THEN 'Supporting' WHEN sq.pos % 3 = 1 THEN 'Neutral' END AS Database_Conclusion, CASE WHEN sq.pos % 3 = 0 THEN 'heterozygous' WHEN sq.pos % 3 = 1 THEN 'compound_heterozygous' END AS Database_Zygosity,
 CASE WHEN geneSymbol < 'G3' THEN 'Good Fit' END AS HPO_Conclusion, CASE WHEN geneSymbol = 'G4' THEN 'Impossible' END AS OMIM_Conclusion, CASE WHEN geneSymbol > 'G7' THEN 'Not Fit' END AS Literature_Conclusion, CASE WHEN rank_InSilico < 50 THEN 'Strong' END AS Insilico_Conclusion,
 CASE WHEN geneSymbol = 'G5' THEN 'Weak RNA Evidence' END AS RNA_GeneLevel_Conclusion, CASE WHEN HGVSp = 'p.A1C' AND geneSymbol = 'G6' THEN 'Strong RNA Evidence' END AS RNA_VarLevel_Conclusion FROM sq LEFT JOIN ct ON sq.sample_id = ct.sample_id AND sq.chrom = ct.chrom AND sq.pos = ct.pos)"""
# VOTED without an in-silico answer counts 0, not the mildest.
VOTED_REPORT = VOTED.replace("CASE Insilico_Conclusion WHEN 'Strong' THEN 3.0 ELSE 2.0 END", "CASE Insilico_Conclusion WHEN 'Strong' THEN 3.0 ELSE 0.0 END")


@query(
    JUDGED + TIERED + PARTNERED + VOTED_REPORT + """, w AS (SELECT sample_id, ea AS eid, (winner = 'A')::INT AS w, (winner = 'B')::INT AS l FROM z UNION ALL SELECT sample_id, eb, (winner = 'B')::INT, (winner = 'A')::INT FROM z),
sc AS (SELECT sample_id, eid, sum(w) - sum(l) AS score FROM w GROUP BY ALL), pw AS (SELECT e.sample_id, geneSymbol, varId, coalesce(score, 0) AS score FROM e LEFT JOIN sc ON e.sample_id = sc.sample_id AND e.eid = sc.eid)
SELECT t4.sample_id, t4.geneSymbol, t4.varId, has_repeat_motif, Tier, partner, CAST(score AS BIGINT) AS PairWiseScore, CAST(row_number() OVER (PARTITION BY t4.sample_id ORDER BY Tier, score DESC NULLS LAST, Diagnostic_Engine_Rank, t4.varId, t4.geneSymbol) AS INT) AS report_place
FROM t4 LEFT JOIN pw ON t4.sample_id = pw.sample_id AND t4.geneSymbol = pw.geneSymbol AND t4.varId = pw.varId""",
    found=REVIEWED,
    bases=BASES,
    reference=SEQUENCES,
)
def review_report(found: DataFrame, bases: DataFrame, reference: DataFrame, tasks: int = 1) -> DataFrame:
    """The whole review: answers as JSON, verdicts, repeats, tiers, partners, votes and places, written as reports by sample and read again."""
    s, g, v = "sample_id", "geneSymbol", "varId"
    pos = key_parts(F.col(v))["pos"]
    dealt, found = sinks.dealt_table(found, "found", s, tasks)
    answer = lambda df, kind, prefix, **fields: evidence.named(df.withColumn("response", F.to_json(F.struct(*[x.alias(k) for k, x in fields.items()]))), kind, prefix)
    genes, rows = dealt.select(s, g).distinct(), dealt.select(s, g, v, "HGVSp").distinct()
    verdicts = {
        "database": answer(dealt.select(v).distinct().filter(pos % 3 < 2), "database", "Database", conclusion=F.when(pos % 3 == 0, "Supporting"), zygosity=F.when(pos % 3 == 0, "heterozygous").otherwise("compound_heterozygous")),
        "hpo": answer(genes.filter("geneSymbol < 'G3'"), "hpo", "HPO", Conclusion=F.lit("Good Fit")),
        "omim": answer(genes.filter("geneSymbol = 'G4'"), "omim", "OMIM", Conclusion=F.lit("Impossible")),
        "literature": answer(genes.filter("geneSymbol > 'G7'"), "literature", "Literature", Reasoning=F.lit("none")),
        "insilico": answer(dealt.groupBy(s, v).agg(F.min("rank_InSilico").alias("r")).filter("r < 50").drop("r"), "insilico", "Insilico", Conclusion=F.lit("Strong")),
        "rna_gene": answer(genes.filter("geneSymbol = 'G5'"), "rna_gene", "RNA_GeneLevel", Conclusion=F.lit("Weak RNA Evidence")),
        "rna_variant": answer(rows.filter("geneSymbol = 'G6' AND HGVSp = 'p.A1C'").select(s, F.concat(g, F.lit("_VarId_"), v).alias("key")), "rna_variant", "RNA_VarLevel", Conclusion=F.lit("Strong RNA Evidence")),
    }
    counts = lambda rows: cohort.with_allele_counts(rows, bases)
    out, _ = cohort.report(found, verdicts, counts, reference, 300, tasks, dealt.select(s, v).distinct())
    path = f"{sinks.shared_folder(found.sparkSession)}/report-{uuid.uuid4().hex}"
    sinks.write_report(out.select(s, g, v, "has_repeat_motif", "Tier", "partner", "PairWiseScore", "report_place"), path, ["report_place"], dealt=True)
    read = found.sparkSession.read.option("header", True).schema("geneSymbol string, varId string, has_repeat_motif boolean, Tier int, partner string, PairWiseScore long, report_place int, sample_id string").csv(path)
    return read.fillna("", ["partner"])


def dealt_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """review_report() over candidates and reads that are dealt by sample, each to as many tasks."""
    found, bases, reference = (data(spark, sf_dir, sql, by) for sql, by in ((REVIEWED, [SAMPLE]), (BASES, [SAMPLE]), (SEQUENCES, None)))
    return review_report(found, bases, reference, tasks_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


QUERIES["review_report"] = dealt_report
