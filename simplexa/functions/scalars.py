"""Distances between single values, strings, bit vectors and count vectors, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def categorical(x: str, y: str) -> Column:
    """0 if equal, else 1; null if either is."""
    return F.when(F.col(x) == F.col(y), 0.0).when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1.0)


def hierarchical_categorical(levels: Sequence[tuple[str, str]]) -> Column:
    """The share of levels, finest first, before the first at which both sides agree; 1 if none does."""
    made = F.lit(1.0)
    for at in range(len(levels) - 1, -1, -1):
        x, y = levels[at]
        made = F.when(F.col(x) == F.col(y), float(at) / len(levels)).otherwise(made)
    return made


def ordinal(x: str, y: str, support: float = 1.0) -> Column:
    return F.abs(F.col(x) - F.col(y)) / float(support)


def string(x: str, y: str, normalisation: float = 1.0, most: int = 20) -> Column:
    """Levenshtein distance over ``normalisation``; beyond ``most``, the difference of lengths if larger than it, else ``most``."""
    apart = F.abs(F.length(x) - F.length(y))
    exact = F.levenshtein(F.col(x), F.col(y), most)
    return (F.when(apart > most, apart).when(exact < 0, F.lit(most)).otherwise(exact) / float(normalisation)).cast("double")


def count(x: str, y: str, rate: float = 1.0, normalisation: float = 1.0) -> Column:
    """Sum of log Poisson(rate) probabilities of the counts from the lesser to below the greater, over ``normalisation``."""
    term = f"k * ln({float(rate)}D) - {float(rate)}D - {_lgamma('(k + 1D)')}"
    low, high = f"least(int({x}), int({y}))", f"greatest(int({x}), int({y}))"
    return F.expr(f"case when {low} = {high} then 0D else aggregate(transform(sequence({low}, {high} - 1), k -> {term}), 0D, (s, z) -> s + z) / {float(normalisation)}D end")


def bits(name: str, x: str, y: str) -> Column:
    """``bit_hamming`` (bits that differ) or ``bit_jaccard`` (-log of the shared share) of arrays of integers."""
    total = lambda op: f"aggregate(zip_with({x}, {y}, (u, v) -> bit_count(u {op} v)), 0, (s, z) -> s + z)"
    if name == "bit_hamming":
        return F.expr(f"cast({total('^')} as double)")
    if name == "bit_jaccard":
        return F.expr(f"case when {total('|')} = 0 then 0D when {total('&')} = 0 then double('Infinity') else -ln({total('&')} / {total('|')}) end")
    raise ValueError(f"unknown metric {name!r}")


def _lgamma(x: str) -> str:
    """log Gamma of x > 0: Stirling's series at x + 8, and the recurrence back."""
    z = f"({x} + 8)"
    series = f"({z} - 0.5D) * ln({z}) - {z} + 0.9189385332046727D + 1 / (12 * {z}) - 1 / (360 * pow({z}, 3)) + 1 / (1260 * pow({z}, 5))"
    return f"({series} - ln({' * '.join(f'({x} + {i})' for i in range(8))}))"


def _lbeta(x: str, y: str) -> str:
    return f"({_lgamma(x)} + {_lgamma(y)} - {_lgamma(f'({x} + {y})')})"


def ll_dirichlet(x: str, y: str) -> Column:
    """Symmetric relative log likelihood of two vectors of counts; an empty one against another is 1e8, two empty ones 0."""
    total = lambda a: f"aggregate({a}, 0D, (s, z) -> s + z)"
    both = f"aggregate(zip_with(x, y, (u, v) -> case when u * v > 0.9D then {_lbeta('u', 'v')} else 0D end), 0D, (s, z) -> s + z)"
    own = lambda a: f"aggregate(transform({a}, u -> case when u > 0.9D then {_lbeta('u', 'u')} else 0D end), 0D, (s, z) -> s + z)"
    let = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    body = f"sqrt(greatest((b - {_lbeta('n1', 'n2')} - (d2 - {_lbeta('n2', 'n2')})) / n2 + (b - {_lbeta('n1', 'n2')} - (d1 - {_lbeta('n1', 'n1')})) / n1, 0D))"
    body = f"case when n1 = 0 and n2 = 0 then 0D when n1 = 0 or n2 = 0 then 1e8D else {body} end"
    for name, value in (("d2", own("y")), ("d1", own("x")), ("b", both), ("n2", total("y")), ("n1", total("x"))):
        body = let(name, value, body)
    return F.expr(let("x", x, let("y", y, body)))
