"""Floating point of a chosen precision, computed exactly on whole numbers and rounded to the nearest, ties to even.

A number is struct(neg, m, e): the value is m * 2^e, with m below 2^prec; m = -1 stands for infinity and NULL for
what is no number. Numbers below the least normal one have fewer digits (e is `emin`), and what rounds to 2^prec * 2^emax
or more is infinite. Sums align their parts to a common exponent; a part too small to be seen leaves a mark below
the last digit, so that rounding is as for the exact sum.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITE = -1


@dataclass(frozen=True)
class Format:
    """prec digits of base 2; e from emin to emax, where the value is m * 2^e with m a whole number."""

    prec: int
    emin: int
    emax: int


SINGLE = Format(24, -149, 104)
HALF = Format(11, -24, 5)


def _pow2(k: Column) -> Column:
    """2^k as a long, for k from 0 to 62."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))


def _bits(m: Column) -> Column:
    """The number of binary digits of a long of 0 or more."""
    return F.when(m == 0, F.lit(0)).otherwise(F.length(F.bin(m)))


def number(neg: Column, m: Column, e: Column) -> Column:
    return F.struct(neg.alias("neg"), m.cast("long").alias("m"), e.cast("int").alias("e"))


def _let(f, **values: Column) -> Column:
    """f of a struct of values that are computed once; without it an expression would be copied wherever it is used."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), F.lit(0))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def rounded(neg: Column, m: Column, e: Column, f: Format) -> Column:
    """m * 2^e, m below 2^62, rounded to the format."""

    def cut(s: Column) -> Column:
        # so many digits go; a subnormal loses those below 2^emin
        drop = F.greatest(_bits(s["m"]) - f.prec, F.lit(f.emin) - s["e"], F.lit(0))
        return _let(split, neg=s["neg"], m=s["m"], e=s["e"], drop=drop, unit=_pow2(F.least(drop, F.lit(62))))

    def split(s: Column) -> Column:
        # all digits and one more are gone: nothing is left to round up
        gone = s["drop"] > 62
        kept = F.when(gone, F.lit(0).cast("long")).otherwise(_div(s["m"], s["unit"]))
        rest = F.when(gone, F.lit(0).cast("long")).otherwise(s["m"] % s["unit"])
        return _let(up, neg=s["neg"], e=s["e"] + s["drop"], kept=kept, rest=rest, half=_div(s["unit"], F.lit(2).cast("long")), cut=s["drop"] > 0)

    def up(s: Column) -> Column:
        more = s["kept"] + F.when(s["cut"] & ((s["rest"] > s["half"]) | ((s["rest"] == s["half"]) & (s["kept"] % 2 == 1))), 1).otherwise(0)
        return _let(carry, neg=s["neg"], e=s["e"], m=more)

    def carry(s: Column) -> Column:
        # a carry makes one digit too many
        full = s["m"] == (1 << f.prec)
        return _let(fit, neg=s["neg"], m=F.when(full, F.lit(1 << (f.prec - 1)).cast("long")).otherwise(s["m"]), e=s["e"] + F.when(full, 1).otherwise(0))

    def fit(s: Column) -> Column:
        # an exponent above emax is taken down while the digits have room
        room = F.greatest(F.least(F.lit(f.prec) - _bits(s["m"]), s["e"] - f.emax), F.lit(0))
        return _let(done, neg=s["neg"], m=s["m"] * _pow2(room), e=s["e"] - room)

    def done(s: Column) -> Column:
        infinite = number(s["neg"], F.lit(INFINITE), F.lit(f.emax))
        return F.when((s["m"] != 0) & (s["e"] > f.emax), infinite).otherwise(number(s["neg"], s["m"], F.when(s["m"] == 0, F.lit(f.emin)).otherwise(s["e"])))

    return _let(cut, neg=neg, m=m.cast("long"), e=e.cast("int"))


def from_double(x: Column, f: Format) -> Column:
    """A double, taken exactly, in the format; NaN becomes NULL."""

    def scale(s: Column) -> Column:
        # a logarithm that is one off only moves digits between m and e, which has room for it
        return _let(whole, a=s["a"], neg=s["neg"], k=F.floor(F.log2(F.when(s["a"] > 0, s["a"]).otherwise(1.0))).cast("int") - 53)

    def whole(s: Column) -> Column:
        # powers of two are exact; a very small number is moved up in two steps, as 2^-k would leave the doubles
        far = s["k"] < -900
        up = F.when(far, F.pow(F.lit(2.0), F.lit(200.0))).otherwise(1.0)
        m = s["a"] * up * F.pow(F.lit(2.0), -(s["k"] + F.when(far, 200).otherwise(0)).cast("double"))
        return rounded(s["neg"], F.when(s["a"] == 0, 0.0).otherwise(m).cast("long"), F.when(s["a"] == 0, F.lit(f.emin)).otherwise(s["k"]), f)

    def kinds(s: Column) -> Column:
        infinite = number(s["neg"], F.lit(INFINITE), F.lit(f.emax))
        return F.when(s["a"] == float("inf"), infinite).otherwise(_let(scale, a=s["a"], neg=s["neg"]))

    return F.when(x.isNotNull() & ~F.isnan(x), _let(kinds, a=F.abs(x), neg=F.startswith(x.cast("string"), F.lit("-"))))


def from_decimal(x: Column, scale: int, f: Format) -> Column:
    """A decimal with so many places, at most 9, and below 10^18 without its point, in the format: rounded once, from its exact value."""
    if not 0 <= scale <= 9:
        raise ValueError("decimals of at most nine places")
    tens = F.lit(10**scale).cast("decimal(10,0)")

    def shifted(s: Column) -> Column:
        # at least two digits more than asked for stand before the rest
        shift = F.greatest(F.lit(f.prec + 2 + 31) - _bits(s["digits"]), F.lit(0))
        return _let(divided, neg=s["neg"], shift=shift, scaled=(s["digits"].cast("decimal(19,0)") * _pow2(shift).cast("decimal(19,0)")).cast("decimal(38,0)"))

    def divided(s: Column) -> Column:
        # a last digit of 1 says that something is left behind
        q = _div(s["scaled"], tens).cast("long")
        return rounded(s["neg"], q * 2 + F.when(s["scaled"] % tens != 0, 1).otherwise(0), -s["shift"] - 1, f)

    return F.when(x.isNotNull(), _let(shifted, neg=x < 0, digits=F.abs((x * 10**scale).cast("decimal(18,0)")).cast("long")))


def neg(x: Column) -> Column:
    return number(~x["neg"], x["m"], x["e"])


def add(x: Column, y: Column, f: Format) -> Column:
    """The sum, rounded once. Infinities of unlike signs have none, which is NULL; a zero sum is +0 but for -0 + -0."""

    def kinds(s: Column) -> Column:
        a, b = s["x"], s["y"]
        inf_a, inf_b = a["m"] == INFINITE, b["m"] == INFINITE
        # the part of the greater exponent comes first
        swap = (b["m"] != 0) & ((a["m"] == 0) | (a["e"] < b["e"]))
        finite = _let(align, big=F.when(swap, b).otherwise(a), small=F.when(swap, a).otherwise(b), zero=a["neg"] & b["neg"])
        return F.when(inf_a & inf_b, F.when(a["neg"] == b["neg"], a)).when(inf_a, a).when(inf_b, b).otherwise(finite)

    def align(s: Column) -> Column:
        # it is moved up as far as it has room, the other one down
        gap = F.when(s["small"]["m"] == 0, F.lit(0)).otherwise(s["big"]["e"] - s["small"]["e"])
        return _let(meet, big=s["big"], small=s["small"], zero=s["zero"], room=F.least(gap, F.lit(60 - f.prec)), down=F.least(gap - F.least(gap, F.lit(60 - f.prec)), F.lit(62)))

    def meet(s: Column) -> Column:
        signed = lambda p, m: F.when(p["neg"], -m).otherwise(m)
        unit = _pow2(s["down"])
        # one more digit, in which a mark stands for what the smaller part loses
        low = _div(s["small"]["m"], unit) * 2 + F.when(s["small"]["m"] % unit != 0, 1).otherwise(0)
        return _let(total, zero=s["zero"], e=s["big"]["e"] - s["room"] - 1, t=signed(s["big"], s["big"]["m"] * _pow2(s["room"]) * 2) + signed(s["small"], low))

    def total(s: Column) -> Column:
        return rounded(F.when(s["t"] == 0, s["zero"]).otherwise(s["t"] < 0), F.abs(s["t"]), s["e"], f)

    return _let(lambda s: F.when(s["x"].isNotNull() & s["y"].isNotNull(), kinds(s)), x=x, y=y)


def to_double(x: Column) -> Column:
    """The value as a double, which is exact for formats of at most 53 digits within its range."""

    def value(s: Column) -> Column:
        n = s["x"]
        return F.when(n["m"] == INFINITE, s["sign"] * float("inf")).otherwise(s["sign"] * n["m"].cast("double") * F.pow(F.lit(2.0), n["e"].cast("double")))

    return _let(lambda s: F.when(s["x"].isNotNull(), _let(value, x=s["x"], sign=F.when(s["x"]["neg"], F.lit(-1.0)).otherwise(1.0))), x=x)


def total(values: Column, f: Format) -> Column:
    """A list of doubles added one after another from the left, each sum rounded to the format, as a double; NULL where a part is no number.

    The 24 digits of `SINGLE` are those of Spark's FLOAT, whose sums the machine rounds to the nearest, ties to even; other
    formats are added on whole numbers.
    """
    if f == SINGLE:
        out = F.aggregate(values, F.lit(0.0).cast("float"), lambda a, x: a + x.cast("float")).cast("double")
        return F.when(~F.isnan(out), out)
    start = number(F.lit(False), F.lit(0), F.lit(f.emin))
    return to_double(F.aggregate(F.transform(values, lambda x: from_double(x, f)), start, lambda a, x: add(a, x, f)))
