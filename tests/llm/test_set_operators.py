import collections
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import common, embedding_dedup, near_dedup, ngram_lm, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def joined(nodes, edges):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == joined(nodes, [e for e in edges if e[0] != e[1]])
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_dedup_equals_brute_force(spark, documents, hard):
    rng = random.Random(1)
    texts = list(hard)
    for g in range(12):
        base = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([3, 30, 120, 400]))]
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 99999)}"
            texts.append(rng.choice([" ", "\n", "  "]).join(w) if rng.random() < 0.9 else " ".join(w).upper())
    sets = [shingle_set(t) for t in texts]
    for percent in (85, 80):
        edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
        want = joined(range(len(texts)), edges)
        rows = near_dedup.near_components(documents(texts).withColumn("n", F.lit("x")), percent=percent).collect()
        assert {r.doc_id: r.component_id for r in rows} == want
        assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)
    kept = near_dedup.one_of_each(documents(texts), percent=80)
    assert {r.doc_id for r in kept.collect()} == set(want.values())
    assert near_dedup.near_components(documents([])).count() == 0
    same = near_dedup.near_components(documents(["a b c d e f"] * 3, [4, 4, 2])).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in same) == [(2, 2, True), (4, 2, False), (4, 2, False)]


def test_large_groups_are_compared_in_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)
    monkeypatch.setattr(near_dedup, "BLOCK_MATES", 24)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(100)] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts]
    want = joined(range(120), [(i, j) for i in range(120) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])])
    assert {r.doc_id: r.component_id for r in near_dedup.near_components(documents(texts)).collect()} == want


def test_look_alikes_under_the_threshold_are_not_verified(spark, documents, monkeypatch):
    """Texts of similarity about 0.55 share bands, but their registers disagree, so their number doesn't bring work."""
    seen = []
    kept = near_dedup.group_links

    def spy(rows, compare, *rest):
        if compare is near_dedup.linked:
            seen.append(rows.count())
        return kept(rows, compare, *rest)

    monkeypatch.setattr(near_dedup, "group_links", spy)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(400):
        w = list(base)
        for k in rng.sample(range(300), 9):
            w[k] = f"e{rng.randint(0, 10**9)}"
        texts.append(" ".join(w))
    sets = [shingle_set(t) for t in texts[:30]]
    like = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert 0.45 < min(like) and max(like) < 0.72
    rows = near_dedup.near_components(documents(texts)).collect()
    assert all(r.kept for r in rows) and sum(seen) <= 60


def test_near_dedup_without_ids(spark, documents):
    docs = documents(["a b c d e f g"] * 3).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in near_dedup.near_components(docs).collect())
    assert got == [(-1, -1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.one_of_each(docs).count() == 2


def test_band_width_follows_the_threshold():
    assert [near_dedup.band_width(x) for x in (0.85, 0.8, 0.6, 0.3)] == [8, 6, 3, 2]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(5)
    x = np.sort(rng.integers(0, 1 << 63, 3000, dtype=np.uint64))
    a, b = x[:2000], x[1000:]
    sa, sb, su = (near_dedup.sketches(s, np.array([len(s)]))[0] for s in (a, b, x))
    assert (np.maximum(sa, sb) == su).all()
    assert abs((sa == sb).mean() - 1 / 3) < 0.12
    n = np.array([2000.0])
    assert near_dedup.likely(sa[None], sb[None], n, n, 0.15)[0, 0] and not near_dedup.likely(sa[None], sb[None], n, n, 0.55)[0, 0]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_embedding_dedup_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    monkeypatch.setattr(embedding_dedup, "PART", 8)
    monkeypatch.setattr(embedding_dedup, "FAN", 3)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    x = np.concatenate([base, np.repeat(base[:10], 12, axis=0) + rng.normal(scale=0.12, size=(120, 8)), np.repeat(base[:1], 30, axis=0)]).astype(np.float32)
    x = np.concatenate([x, 3 * x[:5]])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [None, [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7, []]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)] + [(2000, [1.0, 2.0], 0), (2001, [1.0, 2.0], 1)]
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    want = joined(range(len(x)), [(i, j) for i in range(len(x)) for j in range(i) if hit[i, j]])
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(vectors(spark, rows).withColumn("dim", F.lit("x"))).collect()}
    assert len(got) == len(rows)
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum() - 1, want[i], want[i] == i)
    for i in range(len(odd)):
        assert (got[1000 + i].n_links, got[1000 + i].component_id) == (0, 1000 + i)
    assert (got[2001].n_links, got[2001].component_id) == (1, 2000)
    assert embedding_dedup.near_vectors(vectors(spark, [])).count() == 0


def test_word_hashes_tell_words_apart(documents, hard):
    import pyarrow as pa

    texts = hard + ["The the THE", "ab ba", "a b"]
    seen = {}
    for lo, hi, h, n in tokens.slices(pa.array(texts), 64):
        at = 0
        for t, c in zip(texts[lo:hi], n):
            w = WORD.findall((t or "").translate(LOW))
            assert len(w) == c
            for word, key in zip(w, h[at : at + c].tolist()):
                assert seen.setdefault(word, key) == key
            at += c
    assert len(set(seen.values())) == len(seen)
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert (tokens.unmix(tokens.mix(x)) == x).all()


def brute_scores(train, texts):
    """Interpolated modified Kneser-Ney trigrams with plain dictionaries."""
    cut = lambda t: WORD.findall((t or "").translate(LOW)) + ["</s>"]
    uni, bi, tri = collections.Counter(), collections.Counter(), collections.Counter()
    for t in train:
        w = ["<s>", *cut(t)]
        uni.update(w[1:])
        tri.update(zip(w, w[1:], w[2:]))
        bi["<s>", w[1]] += 1  # no word stands before the start, so its pairs keep their counts
    for _, b, c in tri:
        bi[b, c] += 1
    follows = collections.Counter(b for _, b in bi)
    n, v = sum(uni.values()), len(uni)
    of = lambda c: ngram_lm.discounts([sum(x == k for x in c.values()) for k in (1, 2, 3, 4)])
    d3, d2, d1 = of(tri), of(bi), of(follows)
    d = lambda table, c: 0 if not c else table[min(c, 3) - 1]
    kinds = len(bi)

    def contexts(table, law):
        total, left = collections.Counter(), collections.Counter()
        for k, c in table.items():
            total[k[:-1]] += c
            left[k[:-1]] += d(law, c)
        return total, left

    (t2, g2), (t3, g3) = contexts(bi, d2), contexts(tri, d3)
    spare = sum(d(d1, c) for c in follows.values()) / kinds
    p1 = lambda b: max(follows[b] - d(d1, follows[b]), 0) / kinds + spare / (v + 1)
    p2 = lambda a, b: (max(bi[a, b] - d(d2, bi[a, b]), 0) + g2[a,] * p1(b)) / t2[a,] if t2[a,] else p1(b)
    p3 = lambda x, a, b: (max(tri[x, a, b] - d(d3, tri[x, a, b]), 0) + g3[x, a] * p2(a, b)) / t3[x, a] if t3[x, a] else p2(a, b)
    for x, a in [("<s>", w) for w in list(uni)[:3]] + [k[:2] for k in list(tri)[:5]]:
        assert abs(sum(p3(x, a, b) for b in [*uni, "an unseen word"]) - 1) < 1e-9
    out = []
    for t in texts:
        w = ["<s>", *cut(t)]
        score = math.log10(p2("<s>", w[1])) + sum(math.log10(p3(*x)) for x in zip(w, w[1:], w[2:]))
        w = w[1:]
        out.append((len(w), sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), score))
    return n, out


def test_lm_equals_brute_force(spark, documents, hard, monkeypatch):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(40)]
    texts = hard + [" ".join(rng.choice(words[: rng.randint(1, 40)]) for _ in range(rng.randint(0, 50))) for _ in range(120)] + ["unseen words only", "w1 unseen w1", "w1 w2 unseen w3 w4"]
    train = texts[:100]
    docs = documents(texts).withColumn("score", F.lit("mine")).withColumn("n", F.lit(0))
    n, want = brute_scores(train, texts)
    for flush, size in ((1 << 30, 20_000), (500, 10_000)):
        monkeypatch.setattr(ngram_lm, "FLUSH", flush)
        model = ngram_lm.fit(docs.filter("doc_id < 100"), range_bytes=size)
        assert model.ranges > 1 and model.tokens == n
        got = ngram_lm.scored(docs, model, keep=("doc_id", "score", "n")).collect()
        assert len(got) == len(texts)
        for r in got:
            a = want[r.doc_id]
            assert (r.n_tokens, r.n_known) == a[:2]
            assert abs(r.base_score - a[2]) < 1e-6 * max(1, abs(a[2])) and abs(r.score - a[3]) < 1e-6 * max(1, abs(a[3]))
    empty = ngram_lm.fit(documents([]))
    assert [round(r.score, 6) for r in ngram_lm.scored(documents(["a b"]), empty).collect()] == [round(3 * math.log10(0.5), 6)]
    assert ngram_lm.scored(documents([]), model).count() == 0
    nulls = ngram_lm.scored(documents(["w1", None]).withColumn("doc_id", F.lit(None).cast("long")), model)
    assert nulls.count() == 2


def test_pairs_come_back_and_large_counts_stay():
    import pyarrow as pa  # noqa: F401

    for v in (1, 5, 1000, 1 << 20, (1 << 31) + 7):
        p = ngram_lm.Pairs(v)
        rng = np.random.default_rng(v)
        a, b = rng.integers(0, v, 200).astype(np.uint64), rng.integers(0, v, 200).astype(np.uint64)
        a[:3] = ngram_lm.START
        k = p.keys(a, b)
        assert (p.first(k) == a).all() and (p.second(k) == b).all()
        assert len(np.unique(k)) == len({*zip(a.tolist(), b.tolist())})
    c = np.array([1, 5, 1 << 40], dtype="<u8")
    assert (ngram_lm.from_planes(ngram_lm.planes(c), "<u8") == c).all()
    code, rows = ngram_lm.coded([c, c])
    assert (rows[code][:, 0] == c.astype(np.int64)).all()


def test_pipeline_stages_keep_columns(spark, tmp_path):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "text", "lang", "source", "n_chars", "n_tokens"} <= set(out.columns)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and out.count() > 0


def test_whole_keys_take_no_other_word_for_their_own(tmp_path):
    rng = np.random.default_rng(17)
    keys = np.unique(rng.integers(0, 1 << 64, 200_000, dtype=np.uint64))
    ngram_lm.write_array(str(tmp_path), 0, keys, [np.arange(len(keys))], whole=True)
    place, values = ngram_lm.find(str(tmp_path), 0, keys, whole=True)
    assert (place == np.arange(len(keys))).all() and (values[:, 0] == place).all()
    other = np.setdiff1d(np.concatenate([keys ^ np.uint64(1), keys ^ np.uint64(1 << 20), rng.integers(0, 1 << 64, 2_000_000, dtype=np.uint64)]), keys)
    assert (ngram_lm.find(str(tmp_path), 0, other, whole=True)[0] == -1).all()
    ngram_lm.write_array(str(tmp_path), 1, keys[:0], [keys[:0]])
    assert (ngram_lm.find(str(tmp_path), 1, other)[0] == -1).all()
    with pytest.raises(FileNotFoundError):
        ngram_lm.find(str(tmp_path), 2, other)


def test_long_and_repeated_rows_are_scored_alike_and_the_model_goes(spark, documents):
    docs = documents(["a b a c " * 60_000, "a b", "a b", "x" * 300_000])
    model = ngram_lm.fit(docs, range_bytes=200_000)
    rows = {r.doc_id: r for r in ngram_lm.scored_once(docs, model).collect()}
    assert [rows[i].n_tokens for i in range(4)] == [240_001, 3, 3, 2] and all(r.n_known == r.n_tokens for r in rows.values())
    assert rows[1].score == rows[2].score and not os.path.exists(model.folder)
