"""Column expressions shared by several operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or_expr(value: str | Column) -> Column:
    """A SQL predicate string or an existing Column."""
    return F.expr(value) if isinstance(value, str) else value


def masked_payload(pii: Column, payload: Column, mask_unknown: bool = False) -> Column:
    """SHA-256 of the payload when the event carries personal data.

    A NULL flag leaves the payload in clear, as the original rule does
    (decision D4); ``mask_unknown=True`` hashes it instead.
    """
    flag = F.coalesce(pii, F.lit(True)) if mask_unknown else pii
    return F.when(flag, F.sha2(payload, 256)).otherwise(payload)


def anomaly_threshold(mean: Column, stddev: Column, sigma: float) -> Column:
    """``mean + sigma * coalesce(stddev, 0)``; a single row has no deviation."""
    return mean + F.lit(float(sigma)) * F.coalesce(stddev, F.lit(0.0))


def risk_factor(anomalies: Column, events: Column) -> Column:
    """Percentage of anomalous events, two decimals, 0.0 when undefined.

    ``100.0`` is a DOUBLE literal on purpose: a SQL ``100.0`` would make the
    arithmetic DECIMAL (decision D9).
    """
    ratio = F.lit(100.0) * anomalies / F.nullif(events, F.lit(0))
    return F.coalesce(F.round(ratio, 2), F.lit(0.0))


def present2(x: Column) -> Column:
    """Presentation rounding to 2 decimals, stable under float noise.

    A mean whose exact value is a tie (``32.255``) comes out of a distributed
    sum a few ulps above or below it depending on the merge order; rounding
    to 9 decimals first removes that noise, then 2 decimals round half up.
    """
    return F.round(F.round(x, 9), 2)


def full_match(value: Column, pattern: str | Column) -> Column:
    """Python ``re.fullmatch`` semantics on the JVM (decision D15).

    ``\\A`` / ``\\z`` anchor the whole string (``$`` would accept a trailing
    newline) and ``(?U)`` makes ``\\d``, ``\\w``, ``\\s``, ``\\b`` Unicode-aware.
    """
    pat = F.concat(F.lit("(?U)\\A(?:"), pattern if isinstance(pattern, Column) else F.lit(pattern),
                   F.lit(")\\z"))
    return F.regexp_like(value, pat)


def word_alternation(words) -> str:
    return "|".join(words)


def sql_token_regex(words, symbols=()) -> str:
    """Case-insensitive, Unicode-aware token search: whole words or symbols."""
    parts = [f"\\b(?:{word_alternation(words)})\\b"]
    parts += [_escape(s) for s in symbols]
    return "(?iU)" + "|".join(parts)


def _escape(symbol: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?{}[]\|()/" else ch for ch in symbol)
