"""Functions on numbers as Column expressions; loops are folds over bounded arrays, so all of them run inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def long(x) -> Column:
    return F.lit(x).cast("long")


def round_up_ties(x: Column) -> Column:
    """The nearest integer, ties toward plus infinity."""
    return F.floor(x + 0.5)


def sign(x: Column) -> Column:
    return F.signum(x)


def distance(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def partial_minus(n: Column, k: Column) -> Column:
    """n - k, or NULL below 0."""
    return F.when(n >= k, n - k)


def predecessor(n: Column) -> Column:
    return F.when(n > 0, n - 1)


def nth_root(a: Column, n: int) -> Column:
    """The largest natural r with r ** n <= a; n = 0 gives 1. The floating root is put right by one either way."""
    if n == 0:
        return long(1)
    guess = F.round(F.pow(a.cast("double"), 1.0 / n)).cast("long")
    power = lambda r: F.pow(r.cast("decimal(38,0)").cast("double"), F.lit(float(n)))
    return F.when(power(guess) > a, guess - 1).when(power(guess + 1) <= a, guess + 1).otherwise(guess)


def int_sqrt(z: Column) -> Column:
    """The integer square root, 0 below 0."""
    return nth_root(F.greatest(z, long(0)), 2)


def pair(a: Column, b: Column) -> Column:
    """A bijection from pairs of naturals to naturals."""
    return F.when(a < b, b * b + a).otherwise(a * a + a + b)


def unpair(n: Column) -> tuple[Column, Column]:
    """Its inverse."""
    s = int_sqrt(n)
    rest = n - s * s
    return F.when(rest < s, rest).otherwise(s), F.when(rest < s, s).otherwise(rest - s)


def bit_indices(n: Column) -> Column:
    """The places of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.getbit(n, i) == 1)


def divided_out(p: int, n: Column) -> Column:
    """struct(k, rest): the largest k with p ** k | n, and n without it; (0, n) for n = 0 or p < 2."""
    start = F.struct(F.lit(0).alias("k"), n.cast("long").alias("rest"))
    if p < 2:
        return start
    turns = int(63 / math.log2(p)) + 1
    return F.aggregate(F.sequence(F.lit(1), F.lit(turns)), start, lambda a, _: F.when((a["rest"] != 0) & (a["rest"] % p == 0), F.struct((a["k"] + 1).alias("k"), (a["rest"] / p).cast("long").alias("rest"))).otherwise(a))


def valuation(p: int, n: Column) -> Column:
    return divided_out(p, n)["k"]


def prime_factors(n: Column) -> Column:
    """The set of prime divisors, ascending; none of 0 and 1. Trial division up to the square root, one array per row."""
    root = F.greatest(int_sqrt(n), long(1))
    start = F.struct(n.cast("long").alias("rest"), F.array().cast("array<bigint>").alias("found"))

    def step(a: Column, p: Column) -> Column:
        # a composite p never divides what is left, as its primes are gone
        stripped = F.aggregate(F.sequence(F.lit(1), F.lit(63)), a["rest"], lambda r, _: F.when(r % p == 0, (r / p).cast("long")).otherwise(r))
        return F.when((p > 1) & (a["rest"] > 1) & (a["rest"] % p == 0), F.struct(stripped.alias("rest"), F.array_append(a["found"], p).alias("found"))).otherwise(a)

    return F.aggregate(F.sequence(long(1), root), start, step, lambda a: F.when(a["rest"] > 1, F.array_append(a["found"], a["rest"])).otherwise(a["found"]))


def largest_prime(n: Column) -> Column:
    """The largest prime divisor; 0 and 1 are their own."""
    return F.when(n < 2, n).otherwise(F.element_at(prime_factors(F.greatest(n, long(2))), -1))


def crt(remainders: Column, moduli: Column) -> Column:
    """The least x with x = r_i modulo each m_i, for moduli that are pairwise coprime; small ones, as each step tries its modulus's residues."""
    start = F.struct(long(0).alias("x"), long(1).alias("m"))
    step = lambda a, z: F.struct(
        (a["x"] + a["m"] * F.element_at(F.filter(F.sequence(long(0), z["m"] - 1), lambda t: (a["x"] + a["m"] * t) % z["m"] == F.pmod(z["r"], z["m"])), 1)).alias("x"),
        (a["m"] * z["m"]).alias("m"),
    )
    return F.aggregate(F.zip_with(remainders, moduli, lambda r, m: F.struct(r.cast("long").alias("r"), m.cast("long").alias("m"))), start, step, lambda a: a["x"])


def product_of(array: Column) -> Column:
    return F.aggregate(array, long(1), lambda a, x: a * x)


def double_factorial(n: Column) -> Column:
    return product_of(F.when(n > 0, F.filter(F.sequence(long(1), n), lambda k: (n - k) % 2 == 0)).otherwise(F.array().cast("array<bigint>")))


def super_factorial(n: Column) -> Column:
    """The product of k! for k up to n."""
    return F.aggregate(F.when(n > 0, F.sequence(long(1), n)).otherwise(F.array().cast("array<bigint>")), F.struct(long(1).alias("f"), long(1).alias("p")), lambda a, k: F.struct((a["f"] * k).alias("f"), (a["p"] * a["f"] * k).alias("p")), lambda a: a["p"])


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficients by exact steps; 0 for k beyond n."""
    made = F.aggregate(F.when(k > 0, F.sequence(long(1), k)).otherwise(F.array().cast("array<bigint>")), long(1), lambda a, i: ((a * (n - k + i)) / i).cast("decimal(38,0)").cast("long"))
    return F.when((k < 0) | (k > n), 0).otherwise(made)


def central_binomial(n: Column) -> Column:
    return choose(2 * n, n)


def catalan(n: Column) -> Column:
    return F.expr("0").cast("long") + F.floor(central_binomial(n) / (n + 1)).cast("long")


def fibonacci(n: Column) -> Column:
    """Over all integers: below 0 the sign alternates."""
    steps = F.when(F.abs(n) > 0, F.sequence(long(1), F.abs(n))).otherwise(F.array().cast("array<bigint>"))
    f = F.aggregate(steps, F.struct(long(0).alias("a"), long(1).alias("b")), lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")), lambda s: s["a"])
    return F.when((n < 0) & (n % 2 == 0), -f).otherwise(f)


#: Indices of Fibonacci numbers that fit into a long.
FIBONACCI = 90


def zeckendorf(n: Column) -> Column:
    """The indices of the Fibonacci numbers of the greedy representation, descending."""
    a, b, values = 0, 1, []
    for i in range(FIBONACCI + 1):
        values.append((i, a))
        a, b = b, a + b
    table = F.array(*[F.struct(F.lit(i).alias("i"), long(f).alias("f")) for i, f in reversed(values[2:])])
    start = F.struct(n.cast("long").alias("rest"), F.array().cast("array<int>").alias("found"))
    return F.aggregate(table, start, lambda s, z: F.when((s["rest"] > 0) & (z["f"] <= s["rest"]), F.struct((s["rest"] - z["f"]).alias("rest"), F.array_append(s["found"], z["i"]).alias("found"))).otherwise(s), lambda s: s["found"])


def derangements(n: Column) -> Column:
    steps = F.when(n > 0, F.sequence(long(1), n)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, long(1), lambda d, k: k * d + F.when(k % 2 == 0, 1).otherwise(-1))


def stirling_second(n: Column, k: int) -> Column:
    """Partitions of n things in k parts: a row of k + 1 numbers, folded n times."""
    start = F.array(*[long(1 if i == 0 else 0) for i in range(k + 1)])
    places = F.array(*[F.lit(i) for i in range(k + 1)])
    steps = F.when(n > 0, F.sequence(long(1), n)).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.aggregate(steps, start, lambda row, _: F.transform(places, lambda j: F.when(j == 0, long(0)).otherwise(j * F.get(row, j) + F.get(row, j - 1)))), k + 1)


def sinc(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(F.sin(x) / x)


def extended_log(x: Column) -> Column:
    """On zero to infinity: minus infinity at 0, NULL below."""
    return F.when(x == 0, float("-inf")).when(x == float("inf"), float("inf")).otherwise(F.ln(x))


def kl_term(x: Column) -> Column:
    """x ln x + 1 - x, 1 at 0."""
    return F.when(x == 0, 1.0).otherwise(x * F.ln(x) + 1 - x)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0: Stirling's series after shifting x up by 8."""
    y = x + 8
    shift = F.ln(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def exponential_density(x: Column, rate: float) -> Column:
    return F.when(x >= 0, rate * F.exp(-rate * x)).otherwise(0.0)


def pareto_density(x: Column, scale: float, shape: float) -> Column:
    return F.when(x >= scale, shape * scale**shape * F.pow(F.when(x >= scale, x).otherwise(scale), F.lit(-(shape + 1)))).otherwise(0.0)


def cauchy_density(x: Column, place: float, scale: float) -> Column:
    return F.lit(0.0) if scale == 0 else scale / (math.pi * (F.pow(x - place, F.lit(2)) + scale * scale))


def gamma_density(x: Column, shape: float, rate: float) -> Column:
    inside = F.when(x > 0, x).otherwise(1.0)
    return F.when(x > 0, F.exp(shape * math.log(rate) - math.lgamma(shape) + (shape - 1) * F.ln(inside) - rate * inside)).otherwise(F.when((x == 0) & F.lit(shape == 1), rate).otherwise(0.0))


def beta_density(x: Column, a: float, b: float) -> Column:
    inside = F.when((x > 0) & (x < 1), x).otherwise(0.5)
    constant = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    return F.when((x > 0) & (x < 1), F.exp(constant + (a - 1) * F.ln(inside) + (b - 1) * F.ln(1 - inside))).otherwise(0.0)


def geometric_mass(n: Column, p: float) -> Column:
    return F.pow(F.lit(1 - p), n) * p


def binomial_mass(k: Column, n: int, p: float) -> Column:
    return choose(long(n), k.cast("long")) * F.pow(F.lit(p), k) * F.pow(F.lit(1 - p), n - k)
