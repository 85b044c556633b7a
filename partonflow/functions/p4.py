"""Four-vector kinematics as Column expressions.

A particle is a struct with ``pt``, ``eta``, ``phi`` and either ``mass`` or
``energy``.  A *cartesian* vector is a struct with ``px``, ``py``, ``pz``,
``e``.  Going to cartesian costs four transcendental calls, so convert each
list element once (:func:`with_cartesian`) and build pairs and triples from the
result instead of converting inside every combination.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi
COMPONENTS = ("px", "py", "pz", "e")


def stable(value: Column, decimals: int = 6) -> Column:
    """Round a derived quantity so that cuts and bins do not depend on the last bit.

    ``rint`` on the scaled number works on doubles; ``round`` would go through a
    decimal object for every value.
    """
    scale = float(10**decimals)
    return F.rint(value * scale) / scale


def px(v: Column) -> Column:
    return v["pt"] * F.cos(v["phi"])


def py(v: Column) -> Column:
    return v["pt"] * F.sin(v["phi"])


def pz(v: Column) -> Column:
    return v["pt"] * F.sinh(v["eta"])


def energy(v: Column) -> Column:
    """Energy from pt, eta and mass."""
    p = v["pt"] * F.cosh(v["eta"])
    return F.sqrt(p * p + v["mass"] * v["mass"])


def cartesian(v: Column, stored_energy: bool = False) -> Column:
    """``(px, py, pz, e)`` of a particle; ``stored_energy`` reads ``v.energy``."""
    e = v["energy"] if stored_energy else energy(v)
    return F.struct(px(v).alias("px"), py(v).alias("py"), pz(v).alias("pz"), e.alias("e"))


def with_cartesian(particles: Column, *keep: str, stored_energy: bool = False) -> Column:
    """Every list element as its cartesian components plus the fields in ``keep``."""

    def convert(v: Column) -> Column:
        e = v["energy"] if stored_energy else energy(v)
        parts = [px(v), py(v), pz(v), e]
        return F.struct(
            *[c.alias(n) for n, c in zip(COMPONENTS, parts)],
            *[v[name].alias(name) for name in keep],
        )

    return F.transform(particles, convert)


def add(*vectors: Column) -> Column:
    """Component-wise sum of cartesian vectors."""
    return F.struct(
        *[reduce(lambda a, b: a + b, [v[c] for v in vectors]).alias(c) for c in COMPONENTS]
    )


def _component_sum(vectors: tuple[Column, ...], name: str) -> Column:
    return reduce(lambda a, b: a + b, [v[name] for v in vectors])


def mass(*vectors: Column) -> Column:
    """Invariant mass of the sum of cartesian vectors; 0 where rounding makes it imaginary."""
    sx, sy, sz, se = (_component_sum(vectors, c) for c in COMPONENTS)
    return F.sqrt(F.greatest(F.lit(0.0), se * se - (sx * sx + sy * sy + sz * sz)))


def pt(*vectors: Column) -> Column:
    """Transverse momentum of the sum of cartesian vectors."""
    sx, sy = _component_sum(vectors, "px"), _component_sum(vectors, "py")
    return F.sqrt(sx * sx + sy * sy)


def delta_phi(phi_a: Column, phi_b: Column) -> Column:
    """Signed azimuthal difference wrapped into [-pi, pi)."""
    return F.pmod(phi_a - phi_b + F.lit(math.pi), F.lit(TWO_PI)) - F.lit(math.pi)


def delta_phi_raw(phi_a: Column, phi_b: Column) -> Column:
    """Absolute azimuthal difference without wrapping."""
    return F.abs(phi_a - phi_b)


def delta_eta(a: Column, b: Column) -> Column:
    return F.abs(a["eta"] - b["eta"])


def delta_r(a: Column, b: Column) -> Column:
    """Distance in the (eta, phi) plane with the azimuth wrapped."""
    d_eta = a["eta"] - b["eta"]
    d_phi = delta_phi(a["phi"], b["phi"])
    return F.sqrt(d_eta * d_eta + d_phi * d_phi)


def transverse_mass(pt_a: Column, pt_b: Column, d_phi: Column) -> Column:
    return F.sqrt(F.lit(2.0) * pt_a * pt_b * (F.lit(1.0) - F.cos(d_phi)))


def elementwise_max(*values: Column) -> Column:
    return F.greatest(*values)
