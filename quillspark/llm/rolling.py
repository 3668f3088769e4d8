"""Anchors: content-defined places such that equal strings of a fixed length have the same one."""

import sys

import numpy as np

LENGTH = 200
GRAM = 40
#: Windows looked at at once; longer texts are cut into blocks that overlap by a window.
BLOCK = 1 << 19
PLACE = np.uint64((1 << 20) - 1)
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and powers of BASE and of its inverse (mod 2 ** 64) below n; kept in the process."""
    kept = sys.__dict__.setdefault("_quillspark_rolling", {})
    if len(kept.get("powers", ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        kept["bytes"] = np.random.default_rng(77).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for name, base in (("powers", BASE), ("inverse", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            kept[name] = np.multiply.accumulate(steps)
    return kept["bytes"], kept["powers"], kept["inverse"]


class Rolling:
    """Hashes of any substring of ``data`` (uint8), after one pass over it."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        of_byte, powers, self.inverse = _tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(of_byte[data] * powers[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w values in a row: prefix and suffix minima of blocks of w."""
    n = len(x) - w + 1
    pad = -len(x) % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    forward = np.minimum.accumulate(full, axis=1).reshape(-1)
    backward = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(backward[:n], forward[w - 1 : w - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """``gram`` (hash of the anchor), ``span`` (hash of data[low : high + length]), ``low``, ``high``, ``at``.

    The windows data[p : p + length] with low <= p <= high have their smallest gram (the leftmost, if several) at ``at``.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for s in range(0, len(data) - length + 1, BLOCK):
        part = data[s : s + BLOCK + length - 1]
        r = Rolling(part)
        h = r.grams(gram)
        place = np.arange(len(h), dtype=np.uint64)
        smallest = sliding_min((h & ~PLACE) | place, length - gram + 1)
        at = (smallest & PLACE).astype(np.int64)
        low = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        high = np.concatenate([low[1:] - 1, [len(at) - 1]])
        found.append((h[at[low]], r.hashes(low, high + length), low + s, high + s, at[low] + s))
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    return dict(zip(("gram", "span", "low", "high", "at"), columns))
