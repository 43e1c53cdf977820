"""Null-safe values: NaN is missing everywhere, and a missing comparison is false."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def known(c: Column) -> Column:
    """A double whose NaN is null."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def number(c: Column) -> Column:
    """A finite double out of any value, else null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def differs(a: Column, b: Column) -> Column:
    """Unequal, and so true where just one side is missing."""
    return ~a.eqNullSafe(b)


def filled(c: Column) -> Column:
    """Trimmed text, or null where it is empty or a spelled-out missing value."""
    t = F.trim(c.cast("string"))
    return F.when(~F.lower(t).isin("", "nan", "none", "null"), t)


def lenient(c: Column) -> Column:
    return yes(F.lower(F.trim(c.cast("string"))).isin("true", "t", "1", "yes", "y"))


def shown(c: Column) -> Column:
    """Two decimals from 10 up, else four without trailing zeros; NA where missing."""
    x = number(c)
    small = F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", "")
    return F.when(x.isNull(), "NA").when(F.abs(x) >= 10, F.format_string("%.2f", x)).otherwise(small)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value being computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


#: Bits of a limb of the long numbers below.
LIMB = 31


def times(limbs: Column, factors: Column) -> Column:
    """A long number, its limbs from the lowest, times each of some factors under 2^31."""

    def by(number: Column, factor: Column) -> Column:
        start = F.struct(F.array().cast("array<bigint>").alias("l"), F.lit(0).cast("bigint").alias("c"))

        def limb(acc: Column, x: Column) -> Column:
            v = x * factor + acc["c"]
            return F.struct(F.concat(acc["l"], F.array(v.bitwiseAND((1 << LIMB) - 1))).alias("l"), F.shiftright(v, LIMB).alias("c"))

        return F.aggregate(number, start, limb, lambda acc: F.concat(acc["l"], F.array(acc["c"])))

    return F.aggregate(factors, limbs, by)


def power(base: int, step: int, n: Column) -> Column:
    """Factors under 2^31 whose product is base^n; base^step is one factor."""
    n = F.greatest(n, F.lit(0)).cast("int")
    return F.concat(F.array_repeat(F.lit(base**step).cast("bigint"), F.floor(n / step).cast("int")), F.array(F.round(F.pow(F.lit(float(base)), n % step)).cast("bigint")))


def spelt(limbs: Column) -> Column:
    """The limbs as one text; of two such texts without leading zeros the longer is the larger number, then the later one."""
    return F.ltrim(F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(F.hex(x), 8, "0")), ""), F.lit("0"))


def past_half(a: Column, n: Column, p: Column) -> Column:
    """1, 0 or -1: whether the double a lies above, on or below (n + 1/2) * 10^p, in whole numbers.

    a is m * 2^e, so 2a = m * 2^(e + 1) meets (2n + 1) * 5^p * 2^p; the powers stand on the side
    where they are whole.
    """

    def compare(e: Column) -> Column:
        half = F.floor(-e / 2)
        m = (a * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), -e - half)).cast("bigint")
        shift = e + 1 - p
        left = times(F.array(m.bitwiseAND((1 << LIMB) - 1), F.shiftright(m, LIMB)), F.concat(power(5, 13, -p), power(2, 30, shift)))
        right = times(F.array(2 * n + 1), F.concat(power(5, 13, p), power(2, 30, -shift)))
        order = lambda x, y: F.when(F.length(x) != F.length(y), F.sign(F.length(x) - F.length(y))).when(x == y, 0).when(x > y, 1).otherwise(-1)
        return let(F.struct(spelt(left).alias("x"), spelt(right).alias("y")), lambda s: order(s["x"], s["y"]))

    return let((F.floor(F.log2(a)) - 53).cast("int"), compare)


def four_parts(a: Column) -> Column:
    """(n, p) of a positive double: n * 10^p, n from 1000 to 10000, is nearest to it; of two, that with even n.

    Far from the middle of two numbers plain doubles decide; near it the exact double does.
    """

    def near(p: Column) -> Column:
        half = F.floor(-p / 2)

        def rounded(y: Column) -> Column:
            low = F.floor(y)
            side = past_half(a, low, p)
            tie = let(side, lambda s: low + F.when((s > 0) | ((s == 0) & (low % 2 == 1)), 1).otherwise(0))
            return F.struct(F.when(F.abs(y - low - 0.5) < 1e-6, tie).otherwise(F.rint(y).cast("bigint")).cast("bigint").alias("n"), p.alias("p"))

        return let(a * F.pow(F.lit(10.0), half) * F.pow(F.lit(10.0), -p - half), rounded)

    return let((F.floor(F.log10(a)) - 3).cast("int"), near)


def four_digits(c: Column) -> Column:
    """Rounded to four significant digits, halves to even, as the exact value of the double tells them."""
    x = number(c)
    return F.when(x == 0, x).when(x.isNotNull(), let(four_parts(F.abs(x)), lambda r: F.sign(x) * F.concat(r["n"].cast("string"), F.lit("E"), r["p"].cast("string")).cast("double")))


def four_text(c: Column) -> Column:
    """four_digits() as text: plain from 0.0001 to under 10^16 with one decimal at least, else as 1.5e-07; null where there is no number.

    Below 10^-319, where doubles have fewer than four digits, the digits are those of the exact value.
    """
    x = number(c)

    def text(r: Column) -> Column:
        digits, top = F.regexp_replace(r["n"].cast("string"), "0+$", ""), F.length(r["n"].cast("string")) - 1 + r["p"]

        def laid(d: Column, e: Column) -> Column:
            more = F.when(F.length(d) > 1, F.concat(F.lit("."), F.substring(d, 2, 4))).otherwise("")
            tiny = F.concat(F.substring(d, 1, 1), more, F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
            fraction = F.when(F.length(d) > e + 1, F.substring(d, e + 2, F.lit(4))).otherwise("0")
            plain = F.concat(F.rpad(F.substring(d, F.lit(1), e + 1), e + 1, F.lit("0")), F.lit("."), fraction)
            return F.when((e < -4) | (e >= 16), tiny).when(e >= 0, plain).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), d))

        return let(F.struct(digits.alias("d"), top.alias("e")), lambda s: laid(s["d"], s["e"]))

    return F.when(x == 0, "0.0").when(x.isNotNull(), F.concat(F.when(x < 0, "-").otherwise(""), let(four_parts(F.abs(x)), text)))


def clipped(c: Column, size: int = 3000) -> Column:
    return F.when(F.length(c) > size, F.concat(F.substring(c, 1, size), F.lit("..."))).otherwise(c)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
