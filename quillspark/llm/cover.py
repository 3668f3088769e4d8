"""Suffix sorting by a difference cover, one block of suffix buckets at a time.

A difference cover modulo V holds, for any two places i and j, some shift below V that moves both onto covered places. The
covered places of a block are ranked once, by their next bytes up to the depth that matters. Suffixes are then sorted by
their first V bytes; ties are resolved by the ranks at the shift of each pair, without looking at more text. Memory is
bounded by the block.
"""

import numpy as np

#: A perfect difference set modulo 13 (each difference occurs just once).
V = 13
COVER = (0, 1, 3, 9)

#: SHIFT[r1][r2]: the least shift that moves places with these remainders onto the cover.
SHIFT = [[next(d for d in range(V) if (a + d) % V in COVER and (b + d) % V in COVER) for b in range(V)] for a in range(V)]


def dense(*keys: np.ndarray) -> np.ndarray:
    """Ranks from 0 of rows by their keys, the first the most significant; equal rows have equal ranks."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def head(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Dense ranks of the first V bytes at each place; ``text`` has V bytes more than the last place."""
    first, second = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(8):
        first = (first << np.uint64(8)) | text[at + j]
    for j in range(8, V):
        second = (second << np.uint64(8)) | text[at + j]
    return dense(first, second)


def sample_ranks(text: np.ndarray, n: int, depth: int) -> np.ndarray:
    """rank[i] of each covered place i < n by its next bytes, ``depth`` at least; -1 elsewhere. ``text`` is padded."""
    covered = np.zeros(V, bool)
    covered[list(COVER)] = True
    at = np.flatnonzero(covered[np.arange(n) % V])
    rank = np.full(n + 2 * depth + 2 * V, -1, np.int64)
    rank[at] = head(text, at)
    known = V
    while known < depth:  # the place ``known`` further on has the same remainder, so it is covered too
        rank[at] = dense(rank[at] * (n + 2) + rank[at + known] + 1)
        known *= 2
    return rank


def suffix_order(text: np.ndarray, n: int, starts: np.ndarray, depth: int) -> np.ndarray:
    """Permutation that sorts the suffixes at ``starts`` by their first ``depth`` bytes at least; ``text`` has n bytes and a padding of 2 * depth + 2 * V."""
    prefix = head(text, starts)
    size = np.bincount(prefix)
    place = (np.cumsum(size) - size)[prefix]  # where the ties of each prefix begin
    tied = np.flatnonzero(size[prefix] > 1)
    if len(tied):
        rank = sample_ranks(text, n, depth)
        wide = rank.max() + 2
        by_rest = [tied[starts[tied] % V == r] for r in range(V)]
        smaller = [np.concatenate([[0], np.cumsum(np.bincount(prefix[t], minlength=len(size)))]) for t in by_rest]
        keys: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

        def ordered(r: int, d: int) -> tuple[np.ndarray, np.ndarray]:
            """Sorted keys of the tied suffixes with this remainder at this shift, and the suffixes in that order."""
            if (r, d) not in keys:
                key = prefix[by_rest[r]] * wide + rank[starts[by_rest[r]] + d]
                by_key = np.argsort(key)
                keys[r, d] = key[by_key], by_rest[r][by_key]
            return keys[r, d]

        for r1 in range(V):
            for r2 in range(V):
                if len(by_rest[r1]) and len(by_rest[r2]):
                    own, mine = ordered(r1, SHIFT[r1][r2])
                    theirs, _ = ordered(r2, SHIFT[r1][r2])
                    place[mine] += np.searchsorted(theirs, own) - smaller[r2][prefix[mine]]
    return np.argsort(place, kind="stable")


def repeated(text: bytes, starts: np.ndarray, weights: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of ``length`` bytes at ``starts`` occur twice, counting each as ``weights`` of them."""
    n = len(text)
    data = np.zeros(n + 4 * length + 4 * V, np.uint8)
    data[:n] = np.frombuffer(text, np.uint8)
    order = suffix_order(data, n, starts, length)
    s = starts[order]
    same = np.ones(max(0, len(s) - 1), bool)
    for j in range(length):  # neighbours in the order are compared byte by byte
        open_ = np.flatnonzero(same) if j % 16 == 0 else open_
        if not len(open_):
            break
        same[open_] &= data[s[open_] + j] == data[s[open_ + 1] + j]
    run = np.concatenate([[0], np.cumsum(~same)])
    total = np.bincount(run, weights[order])
    out = np.empty(len(s), bool)
    out[order] = total[run] > 1
    return out
