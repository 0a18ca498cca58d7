"""Encoded polylines with six decimals, the public format of map services."""

from __future__ import annotations

from collections.abc import Sequence

#: Fixed values of the format: units of a degree, bits of a chunk, offset of its letters.
SCALE, BITS, FIRST = 10**6, 5, 63


def encode(points: Sequence[tuple[float, float]]) -> str:
    out, last = [], (0, 0)
    for point in points:
        now = tuple(round(v * SCALE) for v in point)
        for step in (n - p for n, p in zip(now, last, strict=True)):
            value = ~(step << 1) if step < 0 else step << 1
            while True:
                chunk, value = value & (1 << BITS) - 1, value >> BITS
                out.append(chr(FIRST + chunk + ((1 << BITS) if value else 0)))
                if not value:
                    break
        last = now
    return "".join(out)


def decode(text: str) -> list[tuple[float, float]]:
    values, value, shift = [], 0, 0
    for letter in text:
        chunk = ord(letter) - FIRST
        value |= (chunk & (1 << BITS) - 1) << shift
        shift += BITS
        if not chunk >> BITS:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    out, at = [], [0, 0]
    for i in range(0, len(values) - 1, 2):
        at = [at[0] + values[i], at[1] + values[i + 1]]
        out.append((at[0] / SCALE, at[1] / SCALE))
    return out
