"""The ChaCha8 random stream of the public C2SP chacha8rand definition, and the bounded shuffle drawn from it.

Streams of many seeds are computed side by side in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# The four constants of ChaCha ("expand 32-byte k").
CONSTANTS = (0x61707865, 0x3320646E, 0x79622D32, 0x6B206574)
LANES = 4  # blocks computed side by side
ROUND_BLOCKS = 16  # blocks under one key


def _quarter(s: list[np.ndarray], a: int, b: int, c: int, d: int) -> None:
    for x, y, z, turn in ((a, b, d, 16), (c, d, b, 12), (a, b, d, 8), (c, d, b, 7)):
        s[x] = s[x] + s[y]
        s[z] = s[z] ^ s[x]
        s[z] = (s[z] << np.uint32(turn)) | (s[z] >> np.uint32(32 - turn))


def blocks(keys: np.ndarray, counter: int) -> np.ndarray:
    """Four interleaved blocks of each key (n, 8) of 32-bit words, as (n, 32) 64-bit values."""
    n = len(keys)
    state = [np.full((n, LANES), c, np.uint32) for c in CONSTANTS]
    state += [np.repeat(keys[:, k : k + 1], LANES, 1) for k in range(8)]
    state += [np.tile(np.arange(counter, counter + LANES, dtype=np.uint32), (n, 1))] + [np.zeros((n, LANES), np.uint32) for _ in range(3)]
    work = [x.copy() for x in state]
    for _ in range(4):
        for k in range(4):
            _quarter(work, k, 4 + k, 8 + k, 12 + k)
        for k in range(4):
            _quarter(work, k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4)
    for k in range(4, 12):  # only the key is added back
        work[k] = work[k] + state[k]
    words = np.stack(work, 1).reshape(n, 64)
    return words[:, 0::2].astype(np.uint64) | (words[:, 1::2].astype(np.uint64) << np.uint64(32))


def stream(seeds: list[bytes], count: int) -> np.ndarray:
    """The first ``count`` 64-bit values of each 32-byte seed's stream."""
    keys = np.frombuffer(b"".join(seeds), "<u4").reshape(len(seeds), 8).astype(np.uint32)
    out: list[np.ndarray] = []
    have = 0
    while have < count:
        for counter in range(0, ROUND_BLOCKS, LANES):
            values = blocks(keys, counter)
            last = counter == ROUND_BLOCKS - LANES
            out.append(values[:, :28] if last else values)
            have += out[-1].shape[1]
            if last:  # the four values held back are the next key
                keys = np.ascontiguousarray(values[:, 28:]).view("<u4").reshape(len(seeds), 8).astype(np.uint32)
            if have >= count:
                break
    return np.concatenate(out, 1)[:, :count]


def permutation(values: Iterator[int], n: int) -> list[int]:
    """0 to n - 1 shuffled from the top down; a bounded draw is a widening product, powers of two a mask."""
    order = list(range(n))
    for i in range(n - 1, 0, -1):
        bound = i + 1
        if bound & i == 0:
            j = next(values) & i
        else:
            product = (next(values) >> 32) * bound
            low = product & 0xFFFFFFFF
            if low < bound:
                least = (-bound & 0xFFFFFFFF) % bound
                while low < least:
                    product = (next(values) >> 32) * bound
                    low = product & 0xFFFFFFFF
            j = product >> 32
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(seeds: list[bytes], sizes: list[int]) -> list[list[int]]:
    """A permutation for each seed; the rare rejected draws take values past the expected number."""
    if not seeds:
        return []
    drawn = stream(seeds, max(sizes) + 16)

    def values(k: int) -> Iterator[int]:
        yield from drawn[k].tolist()
        yield from stream([seeds[k]], 4 * max(sizes) + 256)[0, drawn.shape[1] :].tolist()

    return [permutation(values(k), n) for k, n in enumerate(sizes)]
