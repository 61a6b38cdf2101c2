"""Bit strings as columns: writing syntax elements to bytes with built-in functions."""

from __future__ import annotations


def fixed(x: str, n: int) -> str:
    """SQL: x in n bits, as a string of 0 and 1."""
    return f"right(lpad(bin(CAST({x} AS BIGINT)), 64, '0'), {n})"


def ue(x: str) -> str:
    """SQL: the unsigned Exp-Golomb code."""
    return f"lpad(bin(CAST({x} AS BIGINT) + 1), CAST(2 * length(bin(CAST({x} AS BIGINT) + 1)) - 1 AS INT), '0')"


def se(x: str) -> str:
    """SQL: the signed Exp-Golomb code."""
    return ue(f"(CASE WHEN {x} > 0 THEN 2 * ({x}) - 1 ELSE -2 * ({x}) END)")


def payload(bits: str) -> str:
    """SQL: the bytes of a unit's body: a stop bit, zeros to the byte, and a 3 after two zero bytes before a byte up to 3."""
    # 64 bits at a time, the last in as many bytes as it fills; codes of whole bytes are matched from where the one before ended
    octets = "substring(lpad(conv(rpad(p, 64, '0'), 2, 16), 16, '0'), 1, CAST(ceil(length(p) / 8) * 2 AS INT))"
    hexed = f"array_join(transform(regexp_extract_all(concat({bits}, '1'), '.{{1,64}}', 0), p -> {octets}), '')"
    return f"unhex(regexp_replace({hexed}, '\\\\G((?:..)*?)0000(?=0[0-3])', '$1000003'))"
