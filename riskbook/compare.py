"""Order-insensitive comparison of result rows (Spark vs the SQL oracle)."""

from __future__ import annotations

import datetime as _dt
import decimal


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v else "nan"
    if isinstance(v, (_dt.datetime, _dt.date)):
        return v.isoformat()
    return v


def canonical(cols: list[str], rows) -> tuple[list[str], list[tuple]]:
    """Columns sorted by name, values normalized, rows sorted."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, str(x)) for x in t))
    return [cols[i] for i in order], out


def diff(a_cols, a_rows, b_cols, b_rows) -> str | None:
    """None when equal, else a short description of the first differences."""
    ca, ra = canonical(list(a_cols), a_rows)
    cb, rb = canonical(list(b_cols), b_rows)
    if ca != cb:
        return f"columns differ: {ca} vs {cb}"
    if ra == rb:
        return None
    only_a = [x for x in ra if x not in rb][:3]
    only_b = [x for x in rb if x not in ra][:3]
    return f"rows {len(ra)} vs {len(rb)}; only left {only_a}; only right {only_b}"
