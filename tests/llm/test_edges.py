"""Empty tables, missing and repeated ids, clashing names, very long texts and vectors."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from varloom.llm import embedding_dedup, pieces, quality_rules, rule_ensemble, secrets, sharding, tokens


def test_empty_tables(spark, documents):
    none = documents([])
    assert secrets.findings(none).count() == 0
    assert rule_ensemble.classified(none, [], 0.0).count() == 0
    assert quality_rules.keep(none).count() == 0
    if pytest.importorskip("public_tokenizers"):
        assert pieces.encoded(none, pieces.model_path()).count() == 0


def test_other_models_are_refused(tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")

    class Other(sentencepiece.SentencePieceProcessor):
        def encode(self, text, *a, **k):
            return super().encode(text.lower(), *a, **k)

    table = pieces.PrefixTable(pieces.model_path())
    assert table.encode("a b") == sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()).encode("a b")
    kept, sentencepiece.SentencePieceProcessor = sentencepiece.SentencePieceProcessor, Other
    try:
        with pytest.raises(ValueError):
            pieces.PrefixTable(pieces.model_path())
    finally:
        sentencepiece.SentencePieceProcessor = kept


def test_long_texts_are_hashed_in_pieces():
    texts = ["abc de " * 50, "x" * 500, "a b", "", "yy " + "z" * 300 + " q", None]
    whole, parts = ([(h.tolist(), n.tolist()) for _, _, h, n in tokens.slices(pa.array(texts), size)] for size in (1 << 20, 64))
    assert [sum((x[k] for x in whole), []) for k in (0, 1)] == [sum((x[k] for x in parts), []) for k in (0, 1)]
    raw = np.frombuffer(("abc de " * 50).encode(), np.uint8)
    assert max(b - a for a, b in tokens.pieces_of_text(raw, 0, len(raw), 64)) <= 64


def test_compiled_rules_equal_numpy(spark, documents, hard):
    rng = np.random.default_rng(9)
    texts = hard + [" ".join(rng.choice(["a", "bb%", "Cc", "7", "|", "word!"], rng.integers(1, 90))) for _ in range(80)]
    docs = documents(texts).withColumn("predicted", F.lit("mine"))
    stats = rule_ensemble.statistics(docs).select("doc_id", *[f"__s_{s}" for s in rule_ensemble.STATISTICS]).collect()
    x = np.array([r[1:] for r in stats], dtype=float)
    y = (x[:, 2] < 0.3).astype(float)
    rules, b = rule_ensemble.fit(x, y)
    assert rules
    z = b + sum(w * rule_ensemble.holds(x, r) for r, w in rules)
    want = dict(zip([r.doc_id for r in stats], 1 / (1 + np.exp(-z))))
    for r in rule_ensemble.classified(docs, rules, b).collect():
        assert abs(r.score - want[r.doc_id]) < 1e-12 and r.predicted == int(want[r.doc_id] >= 0.3)


def test_labels_repeat_conflict_and_lack(spark, documents):
    docs = documents(["good text %d" % i for i in range(40)] + ["bad %% text" for _ in range(40)])
    one = [(i, int(i < 40)) for i in range(80)]
    labels = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    plain = rule_ensemble.learn(docs, labels(one))
    assert rule_ensemble.learn(docs, labels(one + one[:30] + [(None, 1), (3, None)])) == plain
    # of two labels the least counts
    assert rule_ensemble.learn(docs, labels(one + [(i, 1) for i in range(40, 80)])) == plain
    assert rule_ensemble.learn(docs, labels([])) == ([], 0.0)
    assert rule_ensemble.learn(docs, labels([(1, 1)]))[0] == []


def test_equal_texts_have_slots_in_a_row(spark, documents):
    rng = random.Random(3)
    texts = [f"text {rng.randint(0, 60)}" for _ in range(600)]
    rows = sharding.sharded(sharding.keyed(documents(texts)), 4, slice_rows=5000).collect()
    at = collections.defaultdict(list)
    for r in rows:
        at[texts[r.doc_id], r.shard].append(r.slot)
    assert all(max(x) - min(x) == len(x) - 1 for x in at.values())
    size = collections.Counter()
    for r in rows:
        size[r.shard] += r.size
    assert max(size.values()) - min(size.values()) <= 2 * 0.002 * sum(size.values()) / 4 + 2 * max(len(t) for t in texts)


def test_written_shards(spark, documents, tmp_path):
    docs = documents(["same text"] * 50 + [f"text {i} " * (i % 9) for i in range(150)] + [None]).withColumn("shard", F.lit("mine"))
    got = sharding.write_shards(docs, str(tmp_path / "shards"), 4, file_bytes=1000).collect()
    assert {r.shard for r in got} == {0, 1, 2, 3} and sum(r.n for r in got) == 201
    whole = sum(r.bytes for r in got)
    assert max(r.bytes for r in got) - min(r.bytes for r in got) <= 0.1 * whole
    assert len(list((tmp_path / "shards").glob("shard=*/*.parquet"))) > 4
    same = spark.read.parquet(str(tmp_path / "shards"))
    assert {r.shard: (r.n, r.b) for r in same.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()} == {r.shard: (r.n, r.bytes) for r in got}


def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(4)
    base = [rng.normal(size=8).tolist() for _ in range(20)]
    rows = [(i, v) for i, v in enumerate(base + base[:3])] + [(50, [1.0] * 5000), (60, [1.0, 2.0, 3.0]), (61, [2.0, 4.0, 6.1]), (None, base[0])]
    wide = rng.normal(size=1500)
    rows += [(70, wide.tolist()), (71, (wide * 2 + 0.01).tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[50] == (0, 50) and got[60] == (1, 60) and got[61] == (1, 60) and got[70] == (1, 70) and got[71] == (1, 70)
    assert got[20] == (2, 0) and got[0] == (2, 0) and got[None][0] == 2 and got[21] == (1, 1)



def test_pipeline_on_hard_rows(spark, tmp_path):
    """Each stage's decisions, on rows with nulls, copies, shared lines and clashing columns, against what they were made for."""
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    body = lambda n=80: " ".join(word() for _ in range(n))
    shared = " ".join(word() for _ in range(55))
    texts = [body() for _ in range(40)]
    near = texts[0].split(" ")
    near[40] = "other"
    texts += [" ".join(near), texts[1]]  # 40: near copy of 0; 41: exact copy of 1
    texts += [body() + "\n" + shared, body() + "\n" + shared]  # 42 keeps the line, 43 loses it
    texts += [None, "", "short text", "| " * 100, body(3000)]  # 44 to 47 go, 48 stays
    rows = [(i, t, "en", "s", None if t is None else len(t), "x", 1.5, "y") for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, copies string, rate double, __h string"
    sf = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(47, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf)
        assert docs.columns == before.columns, name
    out = corpus_pipeline.run(spark, sf)
    got = {r.doc_id: r for r in out.collect()}
    assert set(got) == set(range(40)) | {42, 43, 48}
    assert got[42].text == texts[42] and got[43].text == texts[43].split("\n")[0] and got[43].n_chars == len(got[43].text)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    assert all(r.n_tokens == len(sp.encode(r.text)) and r.copies == "x" and r.rate == 1.5 for r in got.values())
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
