"""Building blocks of the reference SQL.

The SQL works on the flat object rows of each event with self-joins and window
functions, never with lists.  Only axis definitions and constants are shared with
the Spark queries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from partonflow.operators.hist import Axis

PI = repr(math.pi)
TWO_PI = repr(2.0 * math.pi)

# The sample names, as a list that SQL reads.
SAMPLE_NAMES = (
    "['tHq','tHW','ttW','ttWJets','ttZ','ttZJets','ttH','WZ','ZZ',"
    "'ZZZ','WWZ','WZZ','tttt','WpWp','WGToLNuG','TGJets','TTGJets']"
)

BASE = f"""WITH cells AS (
  SELECT l_orderkey AS event_id, l_partkey % 6 AS kind, (l_partkey // 6) % 8 AS tower,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) % 11 AS BIGINT) AS disc,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) % 9 AS BIGINT) AS tax,
    CAST(sum(l_partkey) AS BIGINT) AS part, CAST(sum(l_suppkey) AS BIGINT) AS supp, CAST(sum(l_linenumber) AS BIGINT) AS line,
    2 * sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) >= count(*) AS positive
  FROM lineitem GROUP BY 1, 2, 3),
obj0 AS (
  SELECT event_id, kind // 2 AS coll, cents, kind, tower,
    CAST(cents AS DOUBLE) / 100000 AS pt,
    CAST((part * 37 + supp * 11) % 5000 AS DOUBLE) / 1000 - 2.5e0 AS eta,
    CAST((part * 13 + supp * 101) % 6283 AS DOUBLE) / 1000 - 3.1415e0 AS phi,
    CASE kind // 2 WHEN 0 THEN CAST(qty AS DOUBLE) / 10 WHEN 1 THEN 0.1056e0
      ELSE 0.000511e0 END AS mass,
    CASE WHEN positive THEN 1 ELSE -1 END AS charge,
    CAST(disc AS DOUBLE) / 10 AS btag,
    CASE WHEN line % 2 = 1 THEN -1e0 ELSE 1e0 END * CAST((supp * 7) % 100 AS DOUBLE) / 1800 AS dxy,
    CASE WHEN line % 2 = 1 THEN -1e0 ELSE 1e0 END * CAST((part * 3) % 100 AS DOUBLE) / 900 AS dz,
    CAST((part * 17) % 100 AS DOUBLE) / 11 AS sip3d,
    CAST(tax AS DOUBLE) * 0.055e0 AS iso,
    supp % 10 <> 0 AS loose_id, part % 7 <> 0 AS medium_id, part % 9 <> 0 AS conv_veto,
    CASE WHEN supp % 8 = 0 THEN 0 WHEN supp % 8 = 1 THEN 1 ELSE 2 END AS tight_charge,
    1e0 - CAST(disc AS DOUBLE) / 100 AS mva_tth,
    0.4e0 + CAST(qty AS DOUBLE) / 80 AS mva_iso,
    CASE WHEN supp % 12 < 10 THEN 0 WHEN supp % 12 = 10 THEN 1 ELSE 2 END AS lost_hits,
    CAST((part * 29) % 120 AS DOUBLE) / 10000 AS sieie,
    CAST((supp * 31) % 110 AS DOUBLE) / 1500 AS hoe,
    CAST((part * 41) % 70 AS DOUBLE) / 1200 - 0.052e0 AS slope,
    part % 4 - 1 AS jet_idx
  FROM cells),
obj AS (
  SELECT *, row_number() OVER (
      PARTITION BY event_id, coll ORDER BY cents DESC, kind, tower) - 1 AS idx,
    pt * cos(phi) AS px, pt * sin(phi) AS py, pt * sinh(eta) AS pz,
    sqrt(pt * cosh(eta) * (pt * cosh(eta)) + mass * mass) AS e
  FROM obj0),
jet AS (SELECT * FROM obj WHERE coll = 0),
mu AS (SELECT * FROM obj WHERE coll = 1),
el AS (SELECT * FROM obj WHERE coll = 2),
ev AS (
  SELECT o_orderkey AS event_id, o_orderpriority AS dataset,
    {SAMPLE_NAMES}[CAST(o_custkey % 17 AS INTEGER) + 1] AS sample,
    o_totalprice / 2500e0 AS met_pt,
    CAST((o_custkey * 7919) % 6283 AS DOUBLE) / 1000 - 3.1415e0 AS met_phi
  FROM orders)"""


def sql(select: str, **ctes: str) -> str:
    """Base tables, then ``ctes`` in order, then the final select."""
    extra = "".join(f",\n{name} AS ({body})" for name, body in ctes.items())
    return f"{BASE}{extra}\n{select}"


def _sum(aliases: Sequence[str], field: str) -> str:
    return "(" + " + ".join(f"{a}.{field}" for a in aliases) + ")"


def mass(*aliases: str) -> str:
    """Rounded invariant mass of the sum of object rows."""
    e, x, y, z = (_sum(aliases, f) for f in ("e", "px", "py", "pz"))
    return f"round(sqrt(greatest(0e0, {e} * {e} - ({x} * {x} + {y} * {y} + {z} * {z}))), 6)"


def pt(*aliases: str) -> str:
    x, y = _sum(aliases, "px"), _sum(aliases, "py")
    return f"round(sqrt({x} * {x} + {y} * {y}), 6)"


def dphi(a: str, b: str) -> str:
    shifted = f"({a} - {b} + {PI})"
    return f"({shifted} - {TWO_PI} * floor({shifted} / {TWO_PI}) - {PI})"


def dr(a: str, b: str) -> str:
    d = dphi(f"{a}.phi", f"{b}.phi")
    return f"round(sqrt(({a}.eta - {b}.eta) * ({a}.eta - {b}.eta) + {d} * {d}), 6)"


def per_event(value: str, join: str, group: str = "GROUP BY ev.event_id", name: str = "value") -> str:
    """One aggregated value per event, events without rows included."""
    return sql(f"SELECT ev.event_id, {value} AS {name} FROM ev LEFT JOIN {join} {group}")


def _axis_table(axes: Sequence[Axis]) -> str:
    rows = ", ".join(
        f"('{a.name}', {a.bins}, {float(a.lo)!r}e0, {float(a.hi)!r}e0, {a.width!r}e0)" for a in axes
    )
    return f"SELECT * FROM (VALUES {rows}) t(variable, bins, first, last, width)"


def binned(axes: Sequence[Axis], by: Sequence[str], weight: bool = False) -> dict[str, str]:
    """CTEs from ``fills(*by, variable, v[, w])`` to ``hist(*by, variable, bin, n, sumw, sumw2)``."""
    keys = ", ".join(by)
    w = "w" if weight else "1e0"
    return {
        "axes": _axis_table(axes),
        "binned": f"""SELECT {keys}, fills.variable, bins, first, width, {w} AS w,
  CAST(CASE WHEN v < first THEN -1 WHEN v >= last THEN bins
    ELSE least(floor((v - first) / width), bins - 1) END AS INTEGER) AS bin
  FROM fills JOIN axes ON fills.variable = axes.variable WHERE v IS NOT NULL""",
        "hist": f"""SELECT {keys}, variable, bin, bins, first, width, count(*) AS n,
  sum(w) AS sumw, sum(w * w) AS sumw2 FROM binned GROUP BY ALL""",
    }


def sparse_hist(
    fills: str, axes: Sequence[Axis], by: Sequence[str] = ("dataset",), weight: bool = False,
    where: str = "TRUE", **ctes: str,
) -> str:
    keys = ", ".join(by)
    return sql(
        f"SELECT {keys}, variable, bin, n, sumw, sumw2 FROM hist WHERE {where}",
        **ctes,
        fills=fills,
        **binned(axes, by, weight),
    )


def dense_hist(
    fills: str, axes: Sequence[Axis], by: Sequence[str] = ("dataset",), weight: bool = False,
    cats: str = "SELECT DISTINCT dataset FROM ev", **ctes: str,
) -> str:
    """Every bin of every category in ``cats``, which are those of the input, whatever passes."""
    match = " AND ".join(f"h.{k} IS NOT DISTINCT FROM c.{k}" for k in (*by, "variable"))
    most = max(a.bins for a in axes)
    return sql(
        f"""SELECT {", ".join(f"c.{k}" for k in by)}, c.variable, CAST(r.bin AS INTEGER) AS bin,
  c.first + r.bin * c.width AS lo, c.first + (r.bin + 1) * c.width AS hi,
  coalesce(h.n, 0) AS n, coalesce(h.sumw, 0e0) AS sumw, coalesce(h.sumw2, 0e0) AS sumw2
FROM (SELECT cats.*, axes.* FROM cats, axes) c
JOIN range({most}) r(bin) ON r.bin < c.bins
LEFT JOIN hist h ON {match} AND h.bin = r.bin""",
        **ctes,
        cats=cats,
        fills=fills,
        **binned(axes, by, weight),
    )


def counters(rows: str, steps: dict[str, str], by: Sequence[str] = ("dataset",), **ctes: str) -> str:
    """Cutflow rows from per-event numbers in ``rows``."""
    keys = ", ".join(by)
    parts = [
        f"SELECT {keys}, {i} AS step_no, '{s}' AS step, CAST(coalesce(sum({v}), 0) AS BIGINT) AS n "
        f"FROM counted GROUP BY {keys}"
        for i, (s, v) in enumerate(steps.items())
    ]
    return sql(" UNION ALL ".join(parts), **ctes, counted=rows)
