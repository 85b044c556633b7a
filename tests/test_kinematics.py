"""Kinematics against closed-form cases."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from partonflow.functions import p4


def particle(pt, eta, phi, mass=0.0):
    return F.struct(
        *[F.lit(float(v)).alias(n) for n, v in zip(("pt", "eta", "phi", "mass"), (pt, eta, phi, mass))]
    )


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_back_to_back_pair_mass_is_twice_pt(spark):
    a = p4.cartesian(particle(45, 0, 0))
    b = p4.cartesian(particle(45, 0, math.pi))
    assert value(spark, p4.mass(a, b)) == pytest.approx(90)
    assert value(spark, p4.pt(a, b)) == pytest.approx(0, abs=1e-9)


def test_parallel_massless_pair_has_no_mass(spark):
    a, b = p4.cartesian(particle(10, 1, 1)), p4.cartesian(particle(20, 1, 1))
    assert value(spark, p4.mass(a, b)) == pytest.approx(0, abs=1e-5)
    assert value(spark, p4.pt(a, b)) == pytest.approx(30)


def test_single_particle_keeps_its_mass(spark):
    assert value(spark, p4.mass(p4.cartesian(particle(30, 1.2, 2, 5)))) == pytest.approx(5)


def test_components(spark):
    v = value(spark, p4.cartesian(particle(2, 0.5, math.pi / 2, 1)))
    assert v["px"] == pytest.approx(0, abs=1e-12)
    assert v["py"] == pytest.approx(2)
    assert v["pz"] == pytest.approx(2 * math.sinh(0.5))
    assert v["e"] == pytest.approx(math.sqrt((2 * math.cosh(0.5)) ** 2 + 1))


def test_stored_energy_is_used(spark):
    v = F.struct(*[F.lit(x).alias(n) for n, x in zip(("pt", "eta", "phi", "energy"), (3.0, 0.0, 0.0, 5.0))])
    assert value(spark, p4.mass(p4.cartesian(v, stored_energy=True))) == pytest.approx(4)


@pytest.mark.parametrize(
    ("a", "b", "wrapped", "raw"),
    [
        (3.0, -3.0, 6.0 - 2 * math.pi, 6.0),
        (-3.0, 3.0, 2 * math.pi - 6.0, 6.0),
        (1.0, 0.25, 0.75, 0.75),
        (math.pi, 0.0, -math.pi, math.pi),
    ],
)
def test_delta_phi(spark, a, b, wrapped, raw):
    assert value(spark, p4.delta_phi(F.lit(a), F.lit(b))) == pytest.approx(wrapped)
    assert value(spark, p4.delta_phi_raw(F.lit(a), F.lit(b))) == pytest.approx(raw)


def test_delta_r_wraps(spark):
    a, b = particle(1, 0.3, 3.1), particle(1, 0.0, -3.1)
    expected = math.hypot(0.3, 2 * math.pi - 6.2)
    assert value(spark, p4.delta_r(a, b)) == pytest.approx(expected)
    assert value(spark, p4.delta_eta(b, a)) == pytest.approx(0.3)


def test_transverse_mass(spark):
    mt = p4.transverse_mass(F.lit(20.0), F.lit(45.0), F.lit(math.pi))
    assert value(spark, mt) == pytest.approx(60)


@settings(
    max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(
    st.lists(
        st.tuples(
            st.floats(0.1, 500), st.floats(-3, 3), st.floats(-3.14, 3.14), st.floats(0, 50)
        ),
        min_size=2,
        max_size=3,
    )
)
def test_mass_of_sum_matches_python(spark, particles):
    vectors = [p4.cartesian(particle(*p)) for p in particles]
    sums = [0.0] * 4
    for pt, eta, phi, m in particles:
        parts = (
            pt * math.cos(phi), pt * math.sin(phi), pt * math.sinh(eta),
            math.sqrt((pt * math.cosh(eta)) ** 2 + m * m),
        )
        sums = [s + p for s, p in zip(sums, parts)]
    square = max(0.0, sums[3] ** 2 - sum(x * x for x in sums[:3]))
    assert value(spark, p4.mass(*vectors)) == pytest.approx(math.sqrt(square), abs=1e-2, rel=1e-6)
