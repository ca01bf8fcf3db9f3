"""Small DuckDB SQL snippets shared by oracle strings."""

from __future__ import annotations


def H(seed, expr: str) -> str:
    """md5 shuffle key, same text as ``md5_key`` in Spark."""
    return f"md5(concat('{seed}', ':', CAST({expr} AS VARCHAR)))"


def U(seed, expr: str) -> str:
    """md5 uniform in [0, 1), same value as ``md5_uniform`` in Spark."""
    return f"(CAST(('0x' || substr({H(seed, expr)}, 1, 13)) AS BIGINT) / 4503599627370496.0)"


def WC(expr: str) -> str:
    """Whitespace word count, 0 for blank."""
    t = f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"
    return f"CAST(CASE WHEN {t} = '' THEN 0 ELSE len(string_split({t}, ' ')) END AS BIGINT)"


def D(x) -> str:
    """A double literal (DuckDB reads 0.5 as DECIMAL)."""
    return f"CAST({x} AS DOUBLE)"
