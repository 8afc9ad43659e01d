"""Small helpers for writing oracle SQL text (DuckDB dialect)."""

from __future__ import annotations


def R(expr: str, digits: int = 6) -> str:
    """floor(x * 10^d + 0.5 + 2^-17) / 10^d: the SQL twin of functions.scalar.round_half_up."""
    f = repr(10.0 ** digits)
    return f"(floor(({expr}) * {f} + 0.5000076293945312) / {f})"

SQL_FUNCS = {"count": "count", "sum": "sum", "mean": "avg", "std": "stddev_samp", "max": "max", "min": "min",
             "median": "median"}


def agg_list(rules: dict, renames: dict | None = None, digits: int | None = None) -> str:
    """pandas-style `{col: [fn]}` spec -> DuckDB select list `fn(col) AS col_fn`."""
    renames = renames or {}
    out = []
    for c, fns in rules.items():
        for fn in fns:
            name = renames.get(f"{c}_{fn}", f"{c}_{fn}")
            e = f"{SQL_FUNCS[fn]}({c})"
            if fn == "count":
                e = f"CAST({e} AS BIGINT)"
            elif digits is not None:
                e = R(f"CAST({e} AS DOUBLE)", digits)
            elif fn == "sum":
                e = f"CAST({e} AS DOUBLE)" if c not in INT_COLUMNS else f"CAST({e} AS BIGINT)"
            out.append(f"{e} AS {name}")
    return ",\n  ".join(out)


# Integer columns of the trips view (their sums stay BIGINT on both sides).
INT_COLUMNS = {"harsh_braking_events", "harsh_acceleration_events", "sharp_cornering_events", "phone_usage_seconds",
               "night_driving", "rush_hour", "has_claim", "total_harsh_events"}


def rnd(inner: str, doubles: list[str], digits: int = 6) -> str:
    """Wrap a query so the listed double columns are rounded."""
    rep = ", ".join(f"{R(c, digits)} AS {c}" for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM (\n{inner}\n) AS _q"
