"""A counter-based integer mix: draws for many counters without a digest for each.

Two rounds of shift and multiply on 32 bits map each number to another one, no two to the same. It is the same
in numpy, in columns and in SQL, since no product leaves 63 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np

_FACTOR, _SPAN = 73244475, 1 << 32


def seed_of(seed) -> int:
    """A 32-bit number for any seed."""
    return int(hashlib.md5(str(seed).encode()).hexdigest()[:8], 16)


def mix(x) -> np.ndarray:
    """Mixed 32-bit numbers of 32-bit numbers, as unsigned longs."""
    x = np.asarray(x, dtype=np.uint64)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(16))) * np.uint64(_FACTOR) & np.uint64(_SPAN - 1)
    return x ^ (x >> np.uint64(16))


def normals(base_a: int, base_b: int, n: int) -> np.ndarray:
    """n standard normals of a stream told by two 32-bit numbers, by the Box-Muller transform."""
    count = mix(np.arange(n, dtype=np.uint64))
    one, two = ((mix(np.uint64(b) ^ count) + 0.5) / _SPAN for b in (base_a, base_b))
    return np.sqrt(-2.0 * np.log(one)) * np.cos(6.283185307179586 * two)


def mix_sql(text: str) -> str:
    """DuckDB text of `mix` of a BIGINT below 2^32."""
    for _ in range(2):
        text = f"list_transform([{text}], lambda z: xor(z, z // 65536) * {_FACTOR} % {_SPAN})[1]"
    return f"list_transform([{text}], lambda z: xor(z, z // 65536))[1]"
