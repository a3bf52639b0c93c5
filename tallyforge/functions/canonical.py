"""One spelling for equal values: JSON with sorted keys, and doubles with all the digits that tell them apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Doubles outside these bounds have more digits before or behind the point than decimals of 38 digits can carry here.
LEAST, MOST = 1e-9, 1e15
DIGITS = 17


def canonical_json(text: Column) -> Column:
    """A JSON text with the keys of all its objects sorted, however deep, and no blanks; whole numbers without a point however they were written.  Null for null, for text that is no
    JSON, and for an object that has a key twice."""
    # Strings are matched whole, so that only numbers lose their point.
    return F.regexp_replace(F.to_json(F.try_parse_json(text)), r'("(?:[^"\\]|\\.)*")|(\d)\.0(?=[,}\]]|$)', "$1$2")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def precise(value: Column, digits: int = DIGITS) -> Column:
    """value, a double of LEAST to MOST in size or 0, in `digits` significant digits, exactly: the nearest decimal to the double's true value, a half away from 0; null outside the bounds.

    Sizes under 1e-6 have an exponent, as 1.2345e-7.  A double is a whole number of 53 bits times a power of two; the digits come from dividing it out in whole numbers, one at a time.
    """
    zero = F.lit("0." + "0" * (digits - 1))
    sign = F.when(value < 0, "-").otherwise("")
    spelled = let(F.abs(value), lambda size: F.when(size == 0, zero).when(size.between(LEAST, MOST), let(exponent(size), lambda e: let(divided(size, e), lambda d: spelling(d, digits)))))
    return F.concat(F.when(value == 0, "").otherwise(sign), spelled)


def exponent(size: Column) -> Column:
    """The power of two at or below size; log2 may round up to the next whole number."""
    near = lambda e: F.when(F.pow(F.lit(2.0), e) > size, e - 1).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)
    return let(F.floor(F.log2(size)).cast("int"), near)


def quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b).cast("decimal(38,0)")


def divided(size: Column, e: Column) -> Column:
    """size as a fraction of whole numbers: first, the part before the point, and rest and below, the fraction behind it."""
    shift = 52 - e
    whole = (size * F.pow(F.lit(2.0), shift)).cast("decimal(38,0)")
    # In two factors that a double spells exactly.
    power = lambda k: F.pow(F.lit(2.0), k).cast("decimal(19,0)")
    below = (power(F.least(F.greatest(shift, F.lit(0)), F.lit(50))) * power(F.greatest(shift - 50, F.lit(0)))).cast("decimal(38,0)")
    both = F.struct(whole.alias("whole"), below.alias("below"))
    split = lambda b: F.struct(quotient(b["whole"], b["below"]).alias("first"), (b["whole"] % b["below"]).cast("decimal(38,0)").alias("rest"), b["below"].alias("below"))
    return let(both, split)


def spelling(d: Column, digits: int) -> Column:
    """digits significant digits of a fraction of divided()."""

    def step(state: Column, _: Column) -> Column:
        ten = (state["rest"] * F.lit(10).cast("decimal(2,0)")).cast("decimal(38,0)")
        return F.struct((ten % d["below"]).cast("decimal(38,0)").alias("rest"), F.concat(state["out"], quotient(ten, d["below"]).cast("string")).alias("out"))

    # Behind the point: leading zeros (nine at most), the digits asked for and one more, which rounds.
    made = F.aggregate(F.sequence(F.lit(1), F.lit(digits + 10)), F.struct(d["rest"].alias("rest"), F.lit("").alias("out")), step, lambda s: s["out"])

    def parts(m: Column) -> Column:
        zeros = F.when(d["first"] > 0, 0).otherwise(F.length(F.regexp_extract(m, "^0*", 0)))
        number = F.when(d["first"] > 0, F.concat(d["first"].cast("string"), m)).otherwise(F.ltrim(m, F.lit("0")))
        before = F.when(d["first"] > 0, F.length(d["first"].cast("string"))).otherwise(-zeros)
        return F.struct(number.alias("number"), before.alias("before"))

    def rounded(x: Column) -> Column:
        up = F.when(F.substr(x["number"], F.lit(digits + 1), F.lit(1)) >= "5", 1).otherwise(0)
        return F.struct((F.left(x["number"], F.lit(digits)).cast("decimal(20,0)") + up).cast("string").alias("number"), x["before"].alias("before"))

    def placed(x: Column) -> Column:
        """A number of one digit too many is a power of ten: its point moves on."""
        text, point = F.left(x["number"], F.lit(digits)), x["before"] + (F.length(x["number"]) > digits).cast("int")
        behind = F.when(point < digits, F.concat(F.lit("."), F.substr(text, point + 1))).otherwise("")
        small = F.concat(F.left(text, F.lit(1)), F.lit("."), F.substr(text, F.lit(2)), F.lit("e"), (point - 1).cast("string"))
        return F.when(point > 0, F.concat(F.left(text, point), behind)).when(point < -5, small).otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), text))

    return let(let(let(made, parts), rounded), placed)


def vector_digest(ids: Column, values: Column) -> Column:
    """Aggregate: SHA-256 of lines id:value by id, values in 17 digits; null if one of them has no such spelling."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(ids.cast("string").alias("id"), values.alias("v")))), lambda r: F.concat(r["id"], F.lit(":"), precise(r["v"])))
    return let(lines, lambda own: F.when(~F.exists(own, lambda x: x.isNull()), F.sha2(F.array_join(own, "\n").cast("binary"), 256)))
