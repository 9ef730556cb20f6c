"""Named distances between two array columns, as Catalyst expressions (no Python in the hot path)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(f: str, x: str = "x", y: str = "y") -> str:
    return f"aggregate(zip_with({x}, {y}, (u, v) -> cast({f} as double)), 0D, (s, z) -> s + z)"


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _angle(dot: str, a: str, b: str) -> str:
    """1 - dot / sqrt(a * b); 0 where both norms vanish, 1 where one does."""
    return f"case when {a} = 0 and {b} = 0 then 0D when {a} = 0 or {b} = 0 then 1D else 1 - {dot} / sqrt({a} * {b}) end"


_TRUE = "(u != 0 and v != 0)"
_TT, _NE, _N = _sum(f"int({_TRUE})"), _sum("int((u != 0) != (v != 0))"), "size(x)"
_TF, _FT = _sum("int(u != 0 and v = 0)"), _sum("int(u = 0 and v != 0)")
_MEANS = "transform({0}, u -> u - aggregate({0}, 0D, (s, z) -> s + z) / size({0}))"
_SMOOTH = "transform({0}, u -> (u + 1e-11) / (aggregate({0}, 0D, (s, z) -> s + z + 1e-11)))"


def _correlation() -> str:
    dot, a, b = (_sum(f, "cx", "cy") for f in ("u * v", "u * u", "v * v"))
    body = f"case when {a} = 0 and {b} = 0 then 0D when {dot} = 0 then 1D else 1 - {dot} / sqrt({a} * {b}) end"
    return _let("cx", _MEANS.format("x"), _let("cy", _MEANS.format("y"), body))


_SQUARED = _sum("(u - v) * (u - v)")
EXPRESSIONS = {
    "euclidean": f"sqrt({_SQUARED})",
    "manhattan": _sum("abs(u - v)"),
    "chebyshev": "array_max(zip_with(x, y, (u, v) -> cast(abs(u - v) as double)))",
    "canberra": _sum("case when abs(u) + abs(v) > 0 then abs(u - v) / (abs(u) + abs(v)) else 0 end"),
    "braycurtis": f"coalesce({_sum('abs(u - v)')} / nullif({_sum('abs(u + v)')}, 0D), 0D)",
    "cosine": _angle(_sum("u * v"), _sum("u * u"), _sum("v * v")),
    "correlation": _correlation(),
    "hellinger": f"case when {_sum('u')} = 0 and {_sum('v')} = 0 then 0D when {_sum('u')} = 0 or {_sum('v')} = 0 then 1D else sqrt(greatest(1 - {_sum('sqrt(u * v)')} / sqrt({_sum('u')} * {_sum('v')}), 0D)) end",
    "symmetric_kl": _let("p", _SMOOTH.format("x"), _let("q", _SMOOTH.format("y"), f"0.5D * ({_sum('u * ln(u / v) + v * ln(v / u)', 'p', 'q')})")),
    "poincare": f"acosh(1 + 2 * {_SQUARED} / ((1 - {_sum('u * u')}) * (1 - {_sum('v * v')})))",
    "haversine": "2 * asin(sqrt(pow(sin((x[0] - y[0]) / 2), 2) + cos(x[0]) * cos(y[0]) * pow(sin((x[1] - y[1]) / 2), 2)))",
    "hamming": f"{_sum('int(u != v)')} / {_N}",
    "jaccard": f"coalesce({_NE} / nullif({_TT} + {_NE}, 0D), 0D)",
    "matching": f"{_NE} / {_N}",
    "dice": f"coalesce({_NE} / nullif(2 * {_TT} + {_NE}, 0D), 0D)",
    "kulsinski": f"case when {_NE} = 0 then 0D else ({_NE} - {_TT} + {_N}) / ({_NE} + {_N}) end",
    "rogerstanimoto": f"2 * {_NE} / ({_N} + {_NE})",
    "russellrao": f"case when {_NE} = 0 then 0D else ({_N} - {_TT}) / {_N} end",
    "sokalmichener": f"2 * {_NE} / ({_N} + {_NE})",
    "sokalsneath": f"case when {_NE} = 0 then 0D else {_NE} / (0.5D * {_TT} + {_NE}) end",
    "yule": f"case when {_TF} = 0 or {_FT} = 0 then 0D else 2 * {_TF} * {_FT} / ({_TT} * ({_N} - {_TT} - {_NE}) + {_TF} * {_FT}) end",
}
ALIASES = {"l2": "euclidean", "l1": "manhattan", "taxicab": "manhattan", "linfinity": "chebyshev", "linfty": "chebyshev", "linf": "chebyshev"}


def distance(name: str, x: str, y: str, p: float = 2.0) -> Column:
    """Distance between the columns ``x`` and ``y`` (array<double>); ValueError for an unknown name."""
    if name == "minkowski":
        made = f"pow({_sum(f'pow(abs(u - v), {float(p)}D)')}, 1 / {float(p)}D)"
    else:
        name = ALIASES.get(name, name)
        if name not in EXPRESSIONS:
            raise ValueError(f"unknown metric {name!r}")
        made = EXPRESSIONS[name]
    return F.expr(f"transform(array(struct({x} as x, {y} as y)), r -> transform(array(r.x), x -> transform(array(r.y), y -> {made})[0])[0])[0]")


def _literal(values: Sequence[float]) -> str:
    return f"array({', '.join(f'{float(v)!r}D' for v in values)})"


def weighted_distance(name: str, x: str, y: str, parameter: Sequence, p: float = 2.0) -> Column:
    """Distances with a parameter for each coordinate: ``seuclidean`` (variances), ``wminkowski`` (weights), ``mahalanobis`` (inverse covariance, by rows)."""
    if name == "seuclidean":
        made = f"sqrt({_sum('u / v', _OFF.format('u * u'), _literal(parameter))})"
    elif name == "wminkowski":
        made = f"pow({_sum('u * v', _OFF.format(f'pow(abs(u), {float(p)}D)'), _literal(parameter))}, 1 / {float(p)}D)"
    elif name == "mahalanobis":
        rows = f"transform(array({', '.join(map(_literal, parameter))}), r -> {_sum('u * v', 'r', 'd')})"
        made = _let("d", _OFF.format("u"), f"sqrt({_sum('u * v', rows, 'd')})")
    else:
        raise ValueError(f"unknown metric {name!r}")
    return F.expr(f"transform(array(struct({x} as x, {y} as y)), r -> transform(array(r.x), x -> transform(array(r.y), y -> {made})[0])[0])[0]")


#: A function of each coordinate's difference u.
_OFF = "transform(zip_with(x, y, (a, b) -> cast(a - b as double)), u -> {0})"
