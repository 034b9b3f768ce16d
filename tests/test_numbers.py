"""Prime divisors by the sieve against trial division."""

import pytest

from tessera.operators import numbers


def divisors(n):
    out, p = [], 2
    while n and n > 1:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out


@pytest.mark.parametrize(("block", "largest"), [(1 << 16, 1 << 30), (16, 1 << 30), (64, 500)])
def test_factored_equals_trial_division(spark, monkeypatch, block, largest):
    monkeypatch.setattr(numbers, "BLOCK", block)
    monkeypatch.setattr(numbers, "LARGEST", largest)
    values = [None, -6, 0, 1, 2, 2, 4, 9, *range(30, 130), 7 * 11 * 13, 1024, 997 * 2, 9973, 65536, 65537]
    df = numbers.factored(spark.createDataFrame([(v,) for v in values], "n long"), "n")
    found = df.collect()
    assert sorted((r["n"] or 0, r["primes"]) for r in found) == sorted((v or 0, divisors(v)) for v in values)
