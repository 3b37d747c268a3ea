"""Generators of write workloads: series appends, varied values, layered batches."""

from __future__ import annotations

from collections.abc import Iterator

_M64 = (1 << 64) - 1


def xorshift(seed: int = 1337) -> Iterator[int]:
    """64-bit xorshift numbers (shifts 13, 7, 17)."""
    x = seed
    while True:
        x ^= x << 13 & _M64
        x ^= x >> 7
        x ^= x << 17 & _M64
        yield x


def series_rows(n: int, series: int = 1009) -> Iterator[tuple[bytes, bytes]]:
    """Appends to random series: 12-byte keys of series, time and number in the series; 64-byte values."""
    rng = xorshift()
    names = [next(rng) & 0xFFFFFFFF for _ in range(series)]
    seen = [0] * series
    for t in range(n):
        i = next(rng) % series
        seen[i] += 1
        yield b"".join(x.to_bytes(4, "big") for x in (names[i], t, seen[i] - 1)), b"".join(next(rng).to_bytes(8, "big") for _ in range(8))


def varied_values(n: int) -> Iterator[tuple[bytes, bytes]]:
    """Numbered keys with values of 0 to 99 bytes, some of them empty."""
    z = 43237 % 11113
    for i in range(n):
        z = (z + 43237) % 11113
        yield i.to_bytes(8, "big"), bytes([i & 255]) * (z % 100)


def layers(top: int) -> list[list[tuple[bytes, bytes | None]]]:
    """Four batches, each written over the one before; None deletes."""
    be = lambda i: i.to_bytes(8, "big")
    return [
        [(be(i), be(i * i) if i % 2 == 0 else None) for i in range(top // 8)],
        [(be(i), be(i * i // 2)) for i in range(0, top // 4, 4)],
        [(be(i), be(42)) for i in range(0, 3 * (top // 2 // 3), 3)],
        [(be(i), None) for i in range(0, 5 * (top // 5), 5)],
    ]
