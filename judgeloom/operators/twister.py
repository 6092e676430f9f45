"""NumPy's legacy generator from any place of its stream on, so that many tasks read one stream.

The words of its state are a linear recurrence over GF(2) with a characteristic polynomial of degree 19937. With x^J modulo that polynomial, the state J numbers
on is a sum of windows of the next words. Polynomials are integers, their bits the coefficients.
"""

from __future__ import annotations

import functools

WORDS, DEGREE = 624, 19937


def _words(key, n: int):
    """At least n words of the recurrence, beginning with those of a state that is used up."""
    import numpy as np

    rng, out = np.random.RandomState(), [key]
    rng.set_state(("MT19937", key, WORDS))
    while len(out) * WORDS < n:
        rng.randint(0, 1 << 32, WORDS, dtype=np.uint32)
        out.append(rng.get_state()[1].copy())
    return np.concatenate(out)


@functools.lru_cache(maxsize=1)
def _polynomial() -> int:
    """The characteristic polynomial, by Berlekamp and Massey from one bit of the words."""
    import numpy as np

    bits = (_words(np.random.RandomState(1).get_state()[1], 2 * DEGREE + WORDS)[1 : 2 * DEGREE + 2] & 1).tolist()
    c, b, length, since, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = seen << 1 | bit
        if (c & seen).bit_count() & 1:
            kept = c
            c ^= b << since
            if 2 * length <= n:
                length, b, since = n + 1 - length, kept, 0
        since += 1
    return int(bin(c)[2:].rjust(length + 1, "0")[::-1], 2)


@functools.lru_cache(maxsize=8)
def powers(n: int) -> tuple[int, ...]:
    """x^(2^k) modulo the polynomial for k below n."""
    p, out = _polynomial(), [2]
    while len(out) < n:
        x = int("0".join(bin(out[-1])[2:]), 2)  # the square
        while (over := x.bit_length() - DEGREE - 1) >= 0:
            x ^= p << over
        out.append(x)
    return tuple(out)


def at(seed: int, place: int, steps: tuple[int, ...]):
    """RandomState(seed) after place numbers of 32 bits. steps: powers."""
    import numpy as np

    rng = np.random.RandomState(seed)
    key = rng.get_state()[1]
    for k in range(place.bit_length()):
        if place >> k & 1:
            chosen = np.unpackbits(np.frombuffer(steps[k].to_bytes(DEGREE // 8 + 1, "little"), np.uint8), bitorder="little").nonzero()[0]
            key = np.bitwise_xor.reduce(np.lib.stride_tricks.sliding_window_view(_words(key, DEGREE + WORDS), WORDS)[chosen], axis=0)
    rng.set_state(("MT19937", key, WORDS))
    return rng
