"""Pieces of DuckDB SQL that several queries share."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, bit by bit."""
    h = f"hex(encode({text}))"
    taken = f"list_transform(range(0, len({h}) // 2), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT)"
    step = "CASE WHEN (r & 1) = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda r, z: {step})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {taken}), lambda c, b: {byte}), 4294967295::BIGINT)"
