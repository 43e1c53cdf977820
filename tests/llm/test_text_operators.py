import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from varloom.llm import line_dedup, mixing, pieces, quality_rules, rule_ensemble, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    t = text or ""
    w = WORD.findall(t)
    win = collections.Counter(zip(w, w[1:], w[2:]))
    hit = {j for i in range(len(w) - 2) if win[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


def test_quality_counts_equal_brute_force(spark, documents, hard):
    rng = random.Random(2)
    texts = hard + [" ".join(rng.choice("a b c d | %").split(" ")[0] if rng.random() < 0.9 else "\n" for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["a b c a b c a b", "a a a a"]
    out = quality_rules.verdicts(documents(texts), counts=quality_rules.BASE).collect()
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text), r.text
        assert r.kept == (r.rejected_by is None)
    assert quality_rules.verdicts(documents([])).count() == 0


def test_quality_order_does_not_change_verdicts(spark, documents):
    good = " ".join(f"word{i}" for i in range(80))
    docs = documents([good, good.upper(), "| " * 90, "the same thing " * 40, "short"])
    names = list(quality_rules.rules(F.lit(""), {"n_words": F.lit(0)}))
    a = [r.kept for r in quality_rules.verdicts(docs, order=names).orderBy("doc_id").collect()]
    b = [r.kept for r in quality_rules.verdicts(docs, order=names[::-1]).orderBy("doc_id").collect()]
    assert a == b == [True, False, False, False, False]
    clash = docs.withColumn("n_words", F.lit("mine"))
    kept = quality_rules.keep(clash)
    assert kept.columns == clash.columns and [r.n_words for r in kept.collect()] == ["mine"]


def test_pieces_equal_the_library(spark, documents, hard):
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    rng = random.Random(4)
    bits = ["▁", " ", "  ", "\n", "the", "ing", "é", "漢", "\x00", "\t", "😀", "<s>", "<0x41>", "zz", " " * 37, "\r", "Straße", "naïve"]
    texts = hard + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    for r in pieces.encoded(documents(texts).withColumn("n_tokens", F.lit(1)), pieces.model_path(), keep=("doc_id", "text", "n_tokens"), with_ids=True).collect():
        want = sp.encode(r.text or "")
        assert list(r.ids) == want and r.decoded == sp.decode(want) and r.n_tokens == len(want), r.text
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_equal_brute_force(spark, documents, hard):
    rng = random.Random(6)
    bits = ["password", "PassWd", "api_key", "apikey", "secret", "token", "=", ": ", '"', "'", " ", "abc123", "deadbeef" * 3, "AKIA", "ABCDEFGH12345678", "é", "漢", "\n", "x", "AKIAAKIA"]
    texts = hard + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["password=password=abcdef", "token: token: x", "secretoken=abcdef1"]
    for r in secrets.findings(documents(texts).withColumn("spans", F.lit(0))).join(documents(texts), "doc_id").collect():
        want = base_spans(r.text or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[1] == k for x in want) for k in range(3)], r.text
        listed = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_checksums_decide(spark):
    body = b"Zq" * 15
    good = b"ghp_" + body + secrets.base62_crc(body)
    bad = good[:-1] + (b"0" if good[-1:] != b"0" else b"1")
    a = secrets.automaton()
    assert [secrets.KINDS[k] for _, k, _ in secrets.scan(a, b"x " + good + b" y")] == ["github"]
    assert secrets.scan(a, b"x " + bad + b" y") == []
    assert [secrets.KINDS[k] for _, k, _ in secrets.scan(a, b"4111111111111111 4111111111111112")] == ["card"]


def test_shards_are_even_and_slots_gapless(spark, documents, hard):
    rng = random.Random(8)
    texts = hard + ["copy " * 40] * 300 + ["".join(rng.choice("abcdef ") for _ in range(rng.randint(0, 900))) for _ in range(600)]
    rows = sharding.sharded(sharding.keyed(documents(texts).withColumn("shard", F.lit("x"))), 8, slice_rows=20).collect()
    assert len(rows) == len(texts)
    size = collections.Counter()
    for r in rows:
        assert r.size == len((texts[r.doc_id] or "").encode()) + 1
        size[r.shard] += r.size
    assert set(size) <= set(range(8)) and max(size.values()) - min(size.values()) <= 2 * max(len(t or "") for t in texts)
    for s in size:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.sharded(sharding.keyed(documents([])), 8).count() == 0
    same = sharding.sharded(sharding.keyed(documents(["t"] * 20, [7] * 20)), 4).collect()
    assert sorted((r.shard, r.slot) for r in same) == sorted((s, n) for s in {r.shard for r in same} for n in range(sum(x.shard == s for x in same)))


def test_recurring_lines_go(spark, documents, hard):
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    edited = long.replace("wab", "other")
    texts = ["alpha beta gamma delta\n" + long, "epsilon zeta eta theta\n" + long, "iota kappa lambda mu\n" + edited, "page 12 of 40 here\nnu xi omicron pi", "page 13 of 40 here\nrho sigma tau upsilon", "two words\nphi chi psi omega", "two words\nother last line here", long]
    out = {r.doc_id: r.text for r in line_dedup.without_recurring(documents(texts + hard).withColumn("id", F.lit("mine"))).collect()}
    assert out[0] == texts[0] and out[3] == texts[3]
    assert out[1] == "epsilon zeta eta theta" and out[2] == "iota kappa lambda mu"
    assert out[4] == "rho sigma tau upsilon" and out[5] == texts[5] and out[6] == texts[6]
    for i, t in enumerate(hard):
        assert out[len(texts) + i] == t
    kept = line_dedup.drop_recurring(documents(texts))
    assert {r.doc_id for r in kept.collect()} == set(range(7)) and all(r.n_chars == len(r.text) for r in kept.collect())
    # exact copies are one text, and repeats inside a text are not across documents
    copies = documents(["same line of text\nsame line of text"] * 3, [5, 5, 9])
    assert line_dedup.dropped(copies).count() == 0
    assert line_dedup.drop_recurring(documents([])).count() == 0
    null_id = spark.createDataFrame([(None, "a line that recurs here", "", "", 1), (3, "a line that recurs here\nmore of it", "", "", 2)], documents([]).schema)
    # a null id is the smallest: it keeps the line
    assert [(r.doc_id, r.text) for r in line_dedup.drop_recurring(null_id).orderBy("doc_id").collect()] == [(None, "a line that recurs here"), (3, "more of it")]


def labelled_words(seed=12):
    rng = random.Random(seed)
    make = lambda words: " ".join(rng.choice(words) for _ in range(40))
    common = ["the", "of", "and", "to"]
    return [make(common + ["gold", "fine"]) for _ in range(120)] + [make(common + ["trash", "mud"]) for _ in range(60)]


def test_mixing_meets_targets(spark, documents, hard):
    texts = labelled_words()
    docs = documents(texts + hard).withColumns({"rate": F.lit("mine"), "copies": F.lit("mine")})
    labelled = docs.filter("doc_id < 180").select("text", F.when(F.col("doc_id") < 120, "a.good").otherwise("bad one").alias("domain"))
    out = mixing.mixed(docs, labelled, "domain", {"a.good": 0.4, "bad one": 0.6})
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.rate >= 0 and r.met for r in rows)
    for r in rows:
        p = {x["domain"]: x["value"] for x in r.posteriors}
        assert abs(sum(p.values()) - 1) < 1e-9 and (r.doc_id >= 180 or p["a.good" if r.doc_id < 120 else "bad one"] > 0.9)
    total = sum(r.n_tokens for r in rows)
    got = {d: sum(r.rate * r.n_tokens * x["value"] for r in rows for x in r.posteriors if x["domain"] == d) for d in ("a.good", "bad one")}
    assert abs(got["a.good"] - 0.4 * total) <= 0.003 * total and abs(got["bad one"] - 0.6 * total) <= 0.003 * total
    assert {x["domain"]: round(x["value"], 3) for x in rows[0].reached} == {d: round(v, 3) for d, v in got.items()}
    again = {(r.doc_id, r.copies) for r in mixing.mixed(docs, labelled, "domain", {"a.good": 0.4, "bad one": 0.6}).collect()}
    assert again == {(r.doc_id, r.copies) for r in rows}
    none = mixing.mixed(docs, labelled.filter("false"), "domain", {"x": 1.0}).collect()
    assert {(r.rate, r.copies, r.met, len(r.posteriors)) for r in none} == {(1.0, 1, True, 0)}
    assert mixing.mixed(documents([]), labelled, "domain", {"a.good": 1.0}).count() == 0


def test_remix_repeats_rows_and_keeps_their_columns(spark, documents, hard):
    texts = labelled_words()
    docs = documents(texts + hard).withColumn("copies", F.lit("mine"))
    labelled = docs.filter("doc_id < 180").select("text", F.when(F.col("doc_id") < 120, "good").otherwise("bad").alias("domain"))
    out = mixing.remix(docs, labelled, "domain", {"good": 0.95, "bad": 0.05}, rise=("good", 1.5))
    assert out.columns == docs.columns
    times = collections.Counter(r.doc_id for r in out.collect())
    assert all(times[i] in (1, 2) for i in range(120)) and sum(times[i] for i in range(120, 180)) < 40
    twice = docs.filter("doc_id = 3").unionAll(docs.filter("doc_id = 3")).withColumn("doc_id", F.lit(None).cast("long"))
    assert mixing.remix(twice, labelled, "domain", {"good": 1.0}, rise=("good", 1.0)).count() >= 2
    assert mixing.remix(documents([]), labelled, "domain", {"good": 1.0}).count() == 0


def test_labels_of_an_id(spark, documents):
    docs = documents(["t0", "t1", "t2", "t3", "t4"])
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, 1, 1), (1, 1, 0), (2, 1, 0), (3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {(r.text, r.domain) for r in mixing.labelled_texts(docs, labels).collect()} == {("t0", "poor"), ("t1", "toxic"), ("t2", "good")}


def test_rule_ensemble_learns_and_scores_all(spark, documents, hard):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(rng.randint(60, 120))) for _ in range(150)]
    bad = [" ".join(word() + "%%%" for _ in range(90)) for _ in range(40)] + [" ".join([word()] * 90) for _ in range(40)]
    docs = documents(good + bad + hard)
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(230)], "doc_id long, quality int")
    rules, b = rule_ensemble.learn(docs, labels.filter("doc_id % 5 <> 0"))
    assert rules
    out = rule_ensemble.classified(docs.withColumn("score", F.lit("x")), rules, b).collect()
    assert all(0 <= r.score <= 1 for r in out) and len(out) == docs.count()
    held = [r for r in out if r.doc_id < 230 and r.doc_id % 5 == 0]
    assert sum(r.predicted == int(r.doc_id < 150) for r in held) >= 0.95 * len(held)
    assert rule_ensemble.learn(docs, labels.filter("false"))[0] == []
