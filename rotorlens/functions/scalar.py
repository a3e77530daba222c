"""Scalar column functions (FN1-FN8). All are JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import as_col

# Fixed values that must equal the reference's for the same results.
# Severity of a health score: >=70 info, >=40 warning, else critical.
SEVERITY_BANDS = [(70.0, "info"), (40.0, "warning")]
SEVERITY_FLOOR = "critical"
# Text label of a health score: >=70 Good, >=40 Warning, else Critical.
HEALTH_LABEL_BANDS = [(70.0, "Good"), (40.0, "Warning")]
HEALTH_LABEL_FLOOR = "Critical"
# Health status: >=90 excellent, >=70 good, >=50 fair, >=30 warning, else critical.
STATUS_BANDS = [(90.0, "excellent"), (70.0, "good"), (50.0, "fair"), (30.0, "warning")]
STATUS_FLOOR = "critical"
SNAPSHOT_TS_FORMAT = "yyyy.MM.dd.HH.mm.ss"


def round_fixed(x, decimals: int = 1) -> Column:
    """Round a double to `decimals` places exactly as a correctly rounded
    printf does (half-even on the exact binary value), returning a double.

    `x * 10^d` is split into its rounded product p and the rounding error
    (Dekker's exact product), so a product that lands exactly on .5 is
    resolved by the sign of the error instead of by decimal string tricks.
    """
    x = as_col(x).cast("double")
    f = float(10 ** decimals)
    p = x * f
    c = x * 134217729.0  # 2^27 + 1
    xh = c - (c - x)
    xl = x - xh
    err = (xh * f - p) + xl * f
    k = F.floor(p)
    frac = p - k
    up = (F.when(frac > 0.5, True).when(frac < 0.5, False)
           .when(err > 0, True).when(err < 0, False)
           .otherwise(F.pmod(k, F.lit(2)) == 1))
    return (k + F.when(up, 1).otherwise(0)) / f


def fmt_fixed(x, decimals: int = 1) -> Column:
    """printf('%.<d>f') with correctly rounded output (see round_fixed)."""
    return F.format_string(f"%.{decimals}f", round_fixed(x, decimals))


def bands(c, table, floor) -> Column:
    """`when` chain over descending lower bounds (value >= bound -> label)."""
    c = as_col(c)
    expr = None
    for bound, label in table:
        expr = F.when(c >= bound, label) if expr is None else expr.when(c >= bound, label)
    return expr.otherwise(floor)


def safe_divide(a, b, default: float = 0.0) -> Column:
    """FN1: a / b, or `default` when b is zero (no reliance on ANSI errors)."""
    a, b = as_col(a), as_col(b)
    return F.when(b == 0, F.lit(default)).otherwise(a / b)


def nonzero(c, repl: float = 1.0) -> Column:
    """Replace an exact zero (a constant baseline) by `repl` before dividing."""
    c = as_col(c)
    return F.when(c == 0, F.lit(repl)).otherwise(c)


def clamp(c, lo: float, hi: float) -> Column:
    """`c` kept within [lo, hi]; null stays null (greatest and least alone would skip it)."""
    c = as_col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def reading(c) -> Column:
    """A measured value with NaN as null: a reading that isn't there."""
    c = as_col(c).cast("double")
    return F.when(~F.isnan(c), c)


def severity_level(h) -> Column:
    """FN5."""
    return bands(h, SEVERITY_BANDS, SEVERITY_FLOOR)


def format_health(h) -> Column:
    """FN6: 'NN.N% (Good|Warning|Critical)'."""
    h = as_col(h)
    return F.format_string("%s%% (%s)", fmt_fixed(h, 1),
                           bands(h, HEALTH_LABEL_BANDS, HEALTH_LABEL_FLOOR))


def health_status(h) -> Column:
    """FN7."""
    return bands(h, STATUS_BANDS, STATUS_FLOOR)


def parse_snapshot_ts(s) -> Column:
    """FN4: 'YYYY.MM.DD.HH.MM.SS' -> timestamp_ntz (null when it does not parse)."""
    return F.try_to_timestamp(as_col(s), F.lit(SNAPSHOT_TS_FORMAT)).cast("timestamp_ntz")


def format_snapshot_ts(t) -> Column:
    """FN4 inverse."""
    return F.date_format(as_col(t), SNAPSHOT_TS_FORMAT)


# FN8 display bands of the monitor page (fixed values).
# health: >=70 success, >=40 warning, else danger
# failure probability (percent): <30 success, <60 warning, else danger
# remaining samples: >100 success, >30 warning, else danger
def display_health_band(h) -> Column:
    h = as_col(h)
    return F.when(h >= 70, "success").when(h >= 40, "warning").otherwise("danger")


def display_failure_band(p) -> Column:
    p = as_col(p)
    return F.when(p < 30, "success").when(p < 60, "warning").otherwise("danger")


def display_remaining_band(r) -> Column:
    r = as_col(r)
    return F.when(r > 100, "success").when(r > 30, "warning").otherwise("danger")
