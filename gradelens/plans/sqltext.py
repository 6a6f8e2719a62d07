"""Small SQL text helpers for the DuckDB oracles (mirror the Column helpers)."""

from __future__ import annotations

from gradelens.spec import OutcomeSpec


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def level_counts(spec: OutcomeSpec, col: str | None = None) -> str:
    c = col or spec.column
    return ", ".join(f"count(*) FILTER (WHERE {c} = {q(lv)}) AS {n}"
                     for lv, n in zip(spec.levels, spec.names))


def rates(spec: OutcomeSpec, total: str = "total") -> str:
    parts = [f"CASE WHEN {total} > 0 THEN CAST({n} AS DOUBLE) / CAST({total} AS DOUBLE) ELSE 0.0 END AS {n}_rate"
             for n in reversed(spec.names[1:])]
    num = " + ".join(n if w == 1 else f"{n} * {w}" for n, w in zip(spec.names, spec.weights) if w)
    parts.append(f"CASE WHEN {total} > 0 THEN CAST({num} AS DOUBLE) / CAST({total} AS DOUBLE) ELSE 0.0 END AS risk")
    return ", ".join(parts)


def round_ratio(num: str, den: str, digits: int) -> str:
    """Exact half-to-even rounding of an integer ratio (see numeric.scaled_round)."""
    scale = 10 ** digits
    a = f"(abs({num}) * {scale})"
    r = f"({a} % ({den}))"
    w = f"(({a} - {r}) // ({den}))"
    rounded = f"({w} + CASE WHEN 2 * {r} > ({den}) OR (2 * {r} = ({den}) AND {w} % 2 = 1) THEN 1 ELSE 0 END)"
    signed = f"(CASE WHEN ({num}) < 0 THEN -{rounded} ELSE {rounded} END)"
    return f"(CASE WHEN ({den}) > 0 THEN CAST({signed} AS DOUBLE) / CAST({scale} AS DOUBLE) ELSE 0.0 END)"


def pct(num: str, den: str, digits: int) -> str:
    return round_ratio(f"(CAST({num} AS BIGINT) * 100)", den, digits)


def ratio(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0 END)"
