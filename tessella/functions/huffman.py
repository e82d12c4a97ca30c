"""Length-limited prefix codes."""

from __future__ import annotations


def code_lengths(counts: dict[int, int], limit: int = 16) -> dict[int, int]:
    """Optimal code lengths of at most ``limit`` bits by package-merge; a single symbol gets one bit."""
    symbols = sorted((n, s) for s, n in counts.items() if n > 0)
    if not symbols:
        return {}
    if len(symbols) == 1:
        return {symbols[0][1]: 1}
    if len(symbols) > 1 << limit:
        raise ValueError("too many symbols for the limit")
    leaves = [(n, (s,)) for n, s in symbols]
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(limit):
        merged = sorted(leaves + packages, key=lambda p: p[0])
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(merged[::2], merged[1::2], strict=False)]
    lengths = dict.fromkeys((s for _, s in symbols), 0)
    # the first n - 1 packages of the last round hold each symbol once for each bit of its code
    for _, members in packages[: len(symbols) - 1]:
        for s in members:
            lengths[s] += 1
    return lengths


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length): shorter codes first, then by symbol."""
    code, last, out = 0, 0, {}
    for n, s in sorted((n, s) for s, n in lengths.items() if n):
        code <<= n - last
        out[s] = (code, n)
        code, last = code + 1, n
    return out
