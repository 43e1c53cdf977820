"""Templates of lines that differ by white space, by an early token, or share a leaf with many others."""

from varloom.llm import line_dedup

TAIL = "and then the rest of this line stays just as it was"


def drops(docs, **tree):
    return {r.id: r["drop"] for r in line_dedup.dropped(docs, **tree).collect()}


def test_lines_that_differ_by_blanks_meet(spark, documents):
    texts = ["see the old mill", "first\n  see the\told  mill \r", "see\x0bthe old mill now"]
    assert drops(documents(texts)) == {1: [1]}


def test_a_varying_fourth_token_meets_its_template(spark, documents):
    texts = [f"written long ago by {TAIL}", f"alone\nwritten long ago in {TAIL}", f"written long since by {TAIL}"]
    assert drops(documents(texts)) == {1: [1]}


def test_every_template_of_a_crowded_leaf_is_found(spark, documents):
    """Three common lines that take nothing in come before the templates."""
    kind = lambda k, end: " ".join(["one", "of", "them", *[f"{k}{c}" for c in "abcdefgh"], end])
    kind_of = dict(zip(range(9), "pqrstuvwx"))
    texts = ["\n".join(kind(kind_of[k], "same") for k in range(3))] + [f"{'uvw'[i]} x\n" + "\n".join(kind(kind_of[k], "same") for k in range(3)) for i in range(3)]
    texts += ["\n".join(kind(kind_of[k], end) for k in range(3, 9)) for end in ("left", "right")]
    got = drops(documents(texts))
    assert got == {1: [1, 2, 3], 2: [1, 2, 3], 3: [1, 2, 3], 5: [0, 1, 2, 3, 4, 5]}


def test_templates_equal_one_leader_at_a_time(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    kinds = {}
    for leaf in range(12):
        n = rng.choice([10, 12, 20, 31])
        for _ in range(rng.randint(1, 60)):
            tok = [rng.randint(0, 1) if j in (3, 7, 9) else rng.random() < 0.03 for j in range(n)]
            kinds[leaf, tuple(int(x) for x in tok)] = rng.randint(1, 4)
    rows = [(leaf, i, times, list(tok)) for i, ((leaf, tok), times) in enumerate(kinds.items())]
    want = {}
    for leaf in range(12):
        left = sorted(((t, m, tok) for f, m, t, tok in rows if f == leaf), reverse=True)
        while left:
            lead = left[0]
            mine = [x for x in left if sum(p == q for p, q in zip(x[2], lead[2])) >= 0.9 * len(lead[2])]
            want |= {x[1]: lead[1] for x in mine}
            left = [x for x in left if x not in mine]
    rest = spark.createDataFrame(rows, "leaf long, masked long, times long, tok array<long>")
    assert len(set(want.values())) > 24 and any(k != v for k, v in want.items())
    for spare, gain in ((line_dedup.SPARE, line_dedup.GAIN), (0, 0), (0.5, 0.2), (1e9, 0)):
        got = {r.masked: r.template for r in line_dedup.settled(rest, 0.9, spare, gain).collect()}
        assert got == {k: v for k, v in want.items() if k != v}, (spare, gain)
    assert line_dedup.settled(rest.filter(F.col("leaf") < 0), 0.9).count() == 0


def test_compared_pairs_grow_with_the_kinds(spark, monkeypatch):
    """Five templates in one leaf with a varying word: a kind is compared a few times, however many there are."""
    compared = []
    whole = line_dedup.meet

    def counted(pairs, rest, similar):
        compared.append(pairs.distinct().count())
        return whole(pairs, rest, similar)

    monkeypatch.setattr(line_dedup, "meet", counted)
    for n in (200, 400, 800):
        rows = [(1, t * n + i, 1 + (i == 0), [1, 2, 3, *range(100 * t + 10, 100 * t + 18), 10_000 + i]) for t in range(5) for i in range(n)]
        compared.clear()
        got = {r.masked: r.template for r in line_dedup.settled(spark.createDataFrame(rows, "leaf long, masked long, times long, tok array<long>"), 0.9).collect()}
        assert got == {m: m // n * n for _, m, times, _ in rows if times == 1}
        assert sum(compared) <= 4 * len(rows)


def brute_tree(texts):
    """Drops per document by the tree as described, one line and one leader at a time."""
    import collections
    import math
    import re

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashed = lambda s: signed(xxhash.xxh64(s.encode(), seed=42).intdigest())
    rows = []
    for i, t in enumerate(texts):
        for pos, line in enumerate((t or "").split("\n")):
            tok = ["<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line)]
            if len(tok) >= 3:
                rows.append((i, hashed(t or ""), pos, (len(tok), *tok[:3]), " ".join(tok)))
    leaves = collections.defaultdict(set)
    for _, th, _, leaf, _ in rows:
        leaves[leaf].add(th)
    rows = [r for r in rows if len(leaves[r[3]]) > 1]
    times = collections.Counter((r[3], r[4]) for r in rows)
    template = {}
    for leaf in {k[0] for k in times}:
        left = sorted(((n, hashed(m), m) for (f, m), n in times.items() if f == leaf), reverse=True)
        while left:
            lead = left[0][2].split(" ")
            takes = [x for x in left if sum(a == b for a, b in zip(x[2].split(" "), lead)) >= math.ceil(0.9 * len(lead))]
            template |= {(leaf, x[2]): left[0][2] for x in takes}
            left = [x for x in left if x not in takes]
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[3], template[r[3], r[4]]].append(r)
    out = collections.defaultdict(set)
    for own in groups.values():
        home = min((r[0], r[1]) for r in own)[1]
        if len({r[1] for r in own}) > 1:
            for r in own:
                if r[1] != home:
                    out[r[0]].add(r[2])
    return {i: sorted(p) for i, p in out.items()}


def test_the_whole_tree_equals_brute_force(spark, documents, hard):
    """Leaves of up to 50 templates with variants each, fields with digits, copies of documents and odd rows."""
    import random

    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(3))
    pool = []
    for leaf in range(5):
        head, size = [word() for _ in range(3)], rng.choice([5, 10, 20, 31])
        for _ in range(rng.choice([3, 50])):
            base = head + [word() for _ in range(size - 3)]
            for _ in range(3):
                line = list(base)
                for k in rng.sample(range(3, size), min(size - 3, rng.choice([0, 1, 1, 2]))):
                    line[k] = rng.choice([word(), f"{rng.randint(0, 99)}x"])
                pool.append(rng.choice([" ", "  "]).join(line))
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6))) for _ in range(150)]
    texts += texts[:5] + hard
    want = brute_tree(texts)
    assert len(want) > 60
    assert drops(documents(texts)) == want
