"""Column functions on probabilities; a zero probability is -infinity as a logarithm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOG_EPSILON = -24.0067  # ln of the smallest probability given to what is all but impossible, rounded


def log_add(a: Column, b: Column) -> Column:
    """ln(exp a + exp b)."""
    high, low = F.greatest(a, b), F.least(a, b)
    return F.when(low == float("-inf"), high).otherwise(high + F.log1p(F.exp(low - high)))


def log_sub(a: Column, b: Column) -> Column:
    """ln(exp a - exp b); null if b is larger."""
    return F.when(b == float("-inf"), a).when(a == b, F.lit(float("-inf"))).when(a > b, a + F.log1p(-F.exp(b - a)))


def digamma(x: Column) -> Column:
    """Derivative of the logarithm of the gamma function, for x > 0.

    Six steps of the recurrence, then an asymptotic series."""
    up = x + 6
    low = sum((1 / (x + k) for k in range(1, 6)), 1 / x)
    inv = 1 / (up * up)
    tail = inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv * (1 / 240 - inv / 132))))
    return F.log(up) - 0.5 / up - tail - low


def digamma_sql(x: str) -> str:
    """The same series as SQL text, for oracles."""
    up, low = f"(({x}) + 6)", " + ".join(f"1.0/(({x}) + {k})" for k in range(6))
    inv = f"(1.0/({up}*{up}))"
    return f"(ln({up}) - 0.5/{up} - {inv}*(1.0/12 - {inv}*(1.0/120 - {inv}*(1.0/252 - {inv}*(1.0/240 - {inv}/132)))) - ({low}))"
