"""Small generators of DuckDB SQL text for the oracle queries.

They only assemble strings (CTEs, unions over metric names, per-metric
expressions); each oracle remains a plain SQL query over the driver's views.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..model import (EVENTS_ORDER_SQL, EVENTS_SQL, LINEITEM_METRICS, LINEITEM_ORDER_SQL,
                     LINEITEM_SQL)

LI_KEYS = "E, T, l_orderkey, l_linenumber, l_partkey"


def r(expr: str, scale: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {scale})"


def nz(expr: str) -> str:
    return f"(CASE WHEN {expr} = 0 THEN 1 ELSE {expr} END)"


def unpivot(src: str, ids: str, metrics: Sequence[str], where: str = "") -> str:
    w = f" WHERE {where}" if where else ""
    return " UNION ALL ".join(
        f"SELECT {ids}, '{m}' AS M, CAST({m} AS DOUBLE) AS V FROM {src}{w}" for m in metrics)


def fit_cte(src: str, key: str, order: str, metrics: Sequence[str], n: int | None,
            pct: float = 95.0) -> str:
    """CTEs `fit_rank`, `fit_long`, `fit` (per key, M statistics)."""
    where = f"_rn <= {n}" if n else ""
    return (
        f"fit_rank AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _rn "
        f"FROM {src}), "
        f"fit_long AS ({unpivot('fit_rank', key, metrics, where)}), "
        f"fit AS (SELECT {key}, M, count(V) AS n, avg(V) AS mean, stddev_pop(V) AS std, "
        f"stddev_samp(V) AS std_samp, min(V) AS min, max(V) AS max, "
        f"quantile_cont(V, 0.05) AS p5, quantile_cont(V, 0.25) AS q1, "
        f"quantile_cont(V, 0.5) AS median, quantile_cont(V, 0.75) AS q3, "
        f"quantile_cont(V, 0.95) AS p95, quantile_cont(V, 0.99) AS p99, "
        f"quantile_cont(V, 0.75) - quantile_cont(V, 0.25) AS iqr, "
        f"quantile_cont(V, {pct / 100.0}) AS warn, quantile_cont(V, 0.99) AS crit "
        f"FROM fit_long WHERE V IS NOT NULL GROUP BY {key}, M)")


def wide_cte(name: str, key: str, metrics: Sequence[str],
             stats: Sequence[str] = ("mean", "std", "q1", "q3", "iqr")) -> str:
    cols = ", ".join(f"max(CASE WHEN M = '{m}' THEN {s} END) AS {m}_{s}"
                     for m in metrics for s in stats)
    return f"{name} AS (SELECT {key}, {cols} FROM fit GROUP BY {key})"


def max_abs_z(metrics: Sequence[str]) -> str:
    zs = [f"abs(({m} - {m}_mean) / {nz(m + '_std')})" for m in metrics]
    return zs[0] if len(zs) == 1 else f"greatest({', '.join(zs)})"


def iqr_out(metrics: Sequence[str], k: float = 1.5) -> str:
    return " OR ".join(f"({m} < {m}_q1 - {k} * {m}_iqr OR {m} > {m}_q3 + {k} * {m}_iqr)"
                       for m in metrics)


def stat_component(m: str) -> str:
    z = f"abs({m} - {m}_mean) / {m}_std"
    return (f"(CASE WHEN {m}_mean IS NULL THEN 75.0 WHEN {m}_std = 0 THEN "
            f"(CASE WHEN {m} = {m}_mean THEN 100.0 ELSE 50.0 END) "
            f"ELSE least(greatest(100.0 - ({z}) * ({z}) * 12.5, 0.0), 100.0) END)")


def status(h: str) -> str:
    return (f"(CASE WHEN {h} >= 90 THEN 'excellent' WHEN {h} >= 70 THEN 'good' "
            f"WHEN {h} >= 50 THEN 'fair' WHEN {h} >= 30 THEN 'warning' ELSE 'critical' END)")


def li_src() -> str:
    return f"src AS ({LINEITEM_SQL})"


def ev_src() -> str:
    return f"src AS ({EVENTS_SQL})"


LI_ORDER = LINEITEM_ORDER_SQL
EV_ORDER = EVENTS_ORDER_SQL
LI_METRICS = LINEITEM_METRICS
