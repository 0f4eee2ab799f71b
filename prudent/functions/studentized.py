"""Studentised range (Tukey) as SQL expression text for Spark.

For k group means and ``df`` degrees of freedom of the error,

    P(Q <= q) = int f(x) W(q x / sqrt(df)) dx,   W(w) = k int phi(z) (Phi(z) - Phi(z - w))**(k - 1) dz,

where f is the density of the chi distribution.  Both integrals are Gauss-Legendre sums over nodes that
stand in the text as constants, folded with ``aggregate``, so the value is an ordinary expression on
a row per pair of groups.
"""

from __future__ import annotations

import math

import numpy as np

from prudent.functions.dist import SPARK, _fresh, fold, let, lgamma

#: nodes of the inner and outer integral; z beyond +-8 and chi beyond 7 (ten standard deviations) from its middle add nothing
INNER, OUTER, REACH_Z, REACH_X = 80, 64, 8.0, 7.0

# Rational approximation of the normal tail (Hart 1968, in the form of West 2005),
# numerator and denominator from the highest power down; relative error below 1e-15.
_NUMERATOR = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
_DENOMINATOR = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831,
                793.826512519948, 440.413735824752]


def _horner(coefficients: list[float], x: str) -> str:
    out = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}D)"
    return out


def normal_cdf(x: str) -> str:
    """Phi(x) in closed form: cheap enough for the inside of a double integral."""
    v, a = _fresh("zx"), _fresh("za")
    near = f"exp(-{a} * {a} / 2D) * {_horner(_NUMERATOR, a)} / {_horner(_DENOMINATOR, a)}"
    far = f"exp(-{a} * {a} / 2D) / ({a} + 1D / ({a} + 2D / ({a} + 3D / ({a} + 4D / ({a} + 0.65D))))) / {math.sqrt(2 * math.pi)!r}D"
    tail = f"CASE WHEN {a} > 37 THEN 0D WHEN {a} < 7.07106781186547D THEN {near} ELSE {far} END"
    return let(SPARK, v, x, let(SPARK, a, f"abs({v})", f"CASE WHEN {v} > 0 THEN 1D - ({tail}) ELSE {tail} END"))


def _rows(rows) -> str:
    return "array(" + ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in r) + ")" for r in rows) + ")"


def _inner_nodes() -> str:
    x, w = np.polynomial.legendre.leggauss(INNER)
    z = REACH_Z * x
    return _rows((a, REACH_Z * b * math.exp(-a * a / 2) / math.sqrt(2 * math.pi), 0.5 * math.erfc(-a / math.sqrt(2))) for a, b in zip(z, w))


def _outer_nodes() -> str:
    return _rows(zip(*np.polynomial.legendre.leggauss(OUTER)))


def range_sf(q: str, k: str, df: str) -> str:
    """P(Q > q) for ``k`` groups and ``df`` degrees of freedom of the error."""
    vq, vk, vd, lo, hi, gone = (_fresh("zt") for _ in range(6))
    a, n, b, m, w, x = (_fresh("zt") for _ in range(6))
    spread = f"aggregate({_inner_nodes()}, 0D, ({a}, {n}) -> {a} + {n}[1] * pow(greatest({n}[2] - {normal_cdf(f'{n}[0] - {w}')}, 0D), {vk} - 1))"
    density = f"exp((1D - {vd} / 2D) * {math.log(2)!r}D + ({vd} - 1D) * ln({x}) - {x} * {x} / 2D - {gone})"
    at = f"({lo} + ({hi} - {lo}) * (1D + {m}[0]) / 2D)"
    term = let(SPARK, x, at, f"{density} * " + let(SPARK, w, f"{vq} * {x} / sqrt({vd})", f"{vk} * {spread}"))
    total = f"aggregate({_outer_nodes()}, 0D, ({b}, {m}) -> {b} + {m}[1] * {term}) * ({hi} - {lo}) / 2D"
    body = let(SPARK, lo, f"greatest(sqrt({vd}) - {REACH_X!r}D, 0D)", let(SPARK, hi, f"sqrt({vd}) + {REACH_X!r}D", let(
        SPARK, gone, lgamma(f"{vd} / 2D"), f"least(1D, greatest(0D, 1D - {total}))")))
    whole = f"CASE WHEN {vq} <= 0 THEN 1D WHEN {vk} < 2 OR {vd} < 1 THEN NULL ELSE {body} END"
    return let(SPARK, vq, f"CAST({q} AS DOUBLE)", let(SPARK, vk, f"CAST({k} AS DOUBLE)", let(SPARK, vd, f"CAST({df} AS DOUBLE)", whole)))


def range_quantile(p: float, k: str, df: str, steps: int = 45) -> str:
    """The q with P(Q <= q) = p, by bisection below 200."""
    vk, vd = _fresh("zt"), _fresh("zt")

    def once(st: str, k_: str) -> dict[str, str]:
        # the interval's low end and width: one evaluation a step
        width = f"({st}.w / 2D)"
        return {"lo": f"{st}.lo + CASE WHEN {range_sf(f'{st}.lo + {width}', vk, vd)} > {1 - p!r}D THEN {width} ELSE 0D END", "w": width}

    text = fold(SPARK, str(steps), {"lo": "0D", "w": "200D"}, once, "lo")
    return let(SPARK, vk, f"CAST({k} AS DOUBLE)", let(SPARK, vd, f"CAST({df} AS DOUBLE)", f"CASE WHEN {vk} >= 2 AND {vd} >= 1 THEN {text} END"))
