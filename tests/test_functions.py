import random

from pyspark.sql import functions as F

from varloom.functions import keys, labels, repeats, values


def one(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in row.items()))
    return df.select(column.alias("x")).first()["x"]


def test_nan_is_missing(spark):
    nan = float("nan")
    assert one(spark, values.known(F.col("a")), a=nan) is None
    assert one(spark, values.yes(values.known(F.col("a")) >= 1.5), a=nan) is False
    assert one(spark, values.number(F.col("a")), a="x") is None
    assert one(spark, values.number(F.col("a")), a="inf") is None
    assert one(spark, values.differs(F.col("a"), F.lit("b")), a=None) is True


def test_number_text(spark):
    for x, want in ((1.5, "1.5"), (12.345, "12.35"), (0.00004, "0"), (2.0, "2"), (-0.25, "-0.25")):
        assert one(spark, values.shown(F.col("a")), a=x) == want
    assert one(spark, values.shown(F.col("a")), a="x") == "NA"
    assert one(spark, values.four_digits(F.col("a")), a=123456.0) == 123500.0
    assert one(spark, values.filled(F.col("a")), a=" NaN ") is None


def test_variant_keys(spark):
    p = keys.key_parts(F.col("a"))
    assert [one(spark, p[k], a=" 23_100_A_C_G ") for k in p] == ["23", 100, "A", "C_G"]
    assert one(spark, p["pos"], a="1_x_A_C") is None
    assert one(spark, keys.locus_contig(F.col("a")), a="23") == "chrX"
    assert one(spark, keys.is_locus(F.lit("chrM"), F.lit(1)), a="") is False
    assert one(spark, keys.coded_contig(F.col("a")), a="CHRy") == "24"
    assert one(spark, keys.bare_contig(F.col("a")), a="chrM") == "MT"
    assert one(spark, keys.transcript_of(F.col("a")), a="NM_1.4:c.5A>G") == "NM_1"
    assert one(spark, keys.change_of(F.col("a")), a="NM_1.4") == "-"
    assert one(spark, keys.variant_key(F.col("a"), F.lit(None).cast("string"), F.lit("A"), F.lit("C")), a="1") is None
    x, y = (one(spark, keys.pair_key(F.lit("g"), F.lit(a), F.lit(b), F.lit("s")), a="") for a, b in (("1", "2"), ("2", "1")))
    assert x == y == "s|G|CH|1|2"


def test_frequencies(spark):
    for text, num, den, has in (("-", 0, 0, 1 - 1), ("HP:0040280", 6, 6, 1), ("50%", 3, 6, 1), ("2/9", 2, 9, 1)):
        got = one(spark, labels.frequency(F.col("a")), a=text)
        assert (got.num, got.den, got.has) == (num, den, has)
    assert one(spark, labels.frequency(F.col("a")), a="often") is None
    for p, want in ((1.0, "Obligate"), (0.0, "Excluded"), (0.8, "Very frequent"), (0.3, "Frequent"), (0.05, "Occasional"), (0.01, "Very rare"), (1.2, "Very rare")):
        assert one(spark, labels.frequency_label(F.col("a")), a=p) == want


def test_labels_and_votes(spark):
    assert one(spark, labels.label(F.col("a")), a=" Stand-Alone  Strong_Evidence ") == "strong"
    assert one(spark, labels.label(F.col("a")), a=None) == ""
    assert one(spark, labels.rna_label(F.col("a"), F.lit("Strong RNA Evidence")), a="Weak RNA Evidence") == "strong rna evidence"
    null = F.lit(None).cast("double")
    for a, b, low, want in ((1.0, F.lit(2.0), True, "A"), (1.0, F.lit(2.0), False, "B"), (1.0, null, False, "A"), (1.0, F.lit(1.0), False, "tie")):
        assert one(spark, labels.vote(F.col("a"), b, low), a=a) == want
    assert one(spark, labels.vote(null, null), a="") == "tie"
    assert one(spark, labels.ratio_side(F.col("a"), F.lit(0.0)), a=60.0) == 0
    assert one(spark, labels.ratio_side(F.col("a"), F.lit(50.0)), a=100.0) == 1


def brute_repeat(s):
    best = None
    for k in range(1, min(6, len(s) // 3) + 1):
        for at in range(len(s) - 3 * k + 1):
            m = s[at : at + k]
            if "N" in m:
                continue
            n = 1
            while s[at + n * k : at + (n + 1) * k] == m:
                n += 1
            if n >= 3 and (best is None or n > best[1]):
                best = (m, n, at + 1)
    return best


def test_repeats_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ACGN" if i % 2 else "AC") for _ in range(rng.randint(0, 40))) for i in range(80)] + ["", "AAA", "ACACACAC"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, sequence string")
    got = {r["id"]: (r["motif"], r["copies"], r["motif_start"]) for r in repeats.best_repeat(df, ["id"]).collect()}
    assert got == {i: brute_repeat(t) for i, t in enumerate(texts) if brute_repeat(t)}


def test_windows_cross_chunks(spark):
    seq = "acgtacgtaa" * 20
    ref = spark.createDataFrame([("1", i, seq[i : i + 50]) for i in range(0, 200, 50)], "chrom string, chunk_start long, seq string")
    pts = spark.createDataFrame([("1", 1), ("1", 48), ("1", 60), ("9", 5)], "chrom string, pos long")
    got = {(r["chrom"], r["pos"]): r["sequence"] for r in repeats.windows_at(pts, ref, 50).collect()}
    want = {(c, p): seq.upper()[max(0, p - 31) : p + 30] if c == "1" else "" for c, p in got}
    assert got == want


def test_four_digits_equal_exact_rounding(spark):
    import random
    import struct

    from varloom.functions.values import four_digits, four_text

    rng = random.Random(16)
    x = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(63)))[0] for _ in range(20000)]
    x += [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randint(-12, 18) for _ in range(80000)]
    x += [k / 16 for k in range(-3000, 20000)] + [k / 32 for k in range(20000)]  # ties
    x += [float(f"{rng.randint(1000, 9999)}5e{rng.randint(-300, 300)}") for _ in range(10000)]  # hardly past or short of the middle
    x += [10.0**k for k in range(-300, 300)] + [9.9995 * 10.0**k for k in range(-300, 300)] + [0.0, -0.5]
    x = [v for v in x if abs(v) < 1e307 and (v == 0 or abs(v) > 1e-307)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for r in df.select("x", four_digits(F.col("x")).alias("d"), four_text(F.col("x")).alias("t")).collect():
        want = float(f"{r.x:.4g}")
        assert r.d == want and r.t == repr(want), r.x
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double").select(four_text(F.col("x")).alias("t"), four_digits(F.col("x")).alias("d")).collect()
    assert all(r.t is None and r.d is None for r in odd)


def test_every_choice_of_a_reviewer_is_defined():
    from varloom.operators import evidence, rubrics

    for kind, keys in evidence.CHOICES.items():
        assert {k: list(v) for k, v in rubrics.MEANINGS[kind].items()} == keys and rubrics.GUIDES[kind]
        text = evidence.request(kind)
        for key, choices in keys.items():
            assert f"\n{key}: one of {' | '.join(choices)}." in text
            assert all(f"\n- {c}: {m}." in text for c, m in rubrics.MEANINGS[kind][key].items())
