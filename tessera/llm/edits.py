"""Edit distances of many pairs of sequences at once, within limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CELLS, PARITIES, FAR = 1 << 18, 512, 1 << 20
#: Bands tried before that of the limit, where the limit is more than twice as wide.
BANDS = (16, 128)


def flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and where each text's begin (n + 1 entries)."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<i4"), np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])


def parities(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each sequence PARITIES bits: whether the codes that fall to a bit are odd in number. The bits two sequences differ in and the difference of their lengths
    are together at most twice their edit distance."""
    bit = (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(PARITIES)
    cell = np.repeat(np.arange(len(at) - 1), np.diff(at)) * PARITIES + bit.astype(np.int64)
    odd = np.bincount(cell, minlength=(len(at) - 1) * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8).reshape(-1, PARITIES), axis=1).view(np.uint64)


def _padded(codes: np.ndarray, first: np.ndarray, n: np.ndarray, left: int, width: int, pad: int) -> np.ndarray:
    out = np.full((len(n), width), pad, np.int32)
    line = np.repeat(np.arange(len(n)), n)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    out[line, left + place] = codes[np.repeat(first, n) + place]
    return out


def _banded(codes: np.ndarray, first: np.ndarray, n: np.ndarray, second: np.ndarray, m: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether the distances are within the limits, in a band as wide as the largest of them: a row of the table for all pairs at a time."""
    band = int(limit.max())
    x, y = _padded(codes, first, n, 0, int(n.max()) + 1, -2), _padded(codes, second, m, band, int(max(m.max(), n.max())) + 2 * band + 1, -1)
    k = np.arange(-band, band + 1, dtype=np.int32)
    row = np.broadcast_to(np.where(k >= 0, k, FAR).astype(np.int32), (len(n), len(k))).copy()
    out, which = np.zeros(len(n), bool), np.arange(len(n))
    for i in range(int(n.max()) + 1):
        if i:
            new = row + (y[:, i - 1 : i + 2 * band] != x[:, i - 1 : i])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            row = np.minimum.accumulate(new - k, axis=1) + k
        done = np.flatnonzero(n == i)
        if len(done):
            out[which[done]] = row[done, (m - n)[done] + band] <= limit[done]
        if i % 16 == 15 or len(done):
            left = (n > i) & (row.min(axis=1) <= limit)
            if 2 * left.sum() < len(left):
                if not left.any():
                    break
                x, y, row, n, m, limit, which = x[left], y[left], row[left], n[left], m[left], limit[left], which[left]
    return out


def within(codes: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Whether sequences a[i] and b[i] are at most limit[i] edits apart."""
    n, m = np.diff(at)[a], np.diff(at)[b]
    out, left = np.zeros(len(a), bool), np.abs(n - m) <= limit
    for band in (*BANDS, None):
        some = np.flatnonzero(left if band is None else left & (limit > 2 * band) & (np.abs(n - m) <= band))
        own = limit[some] if band is None else np.full(len(some), band)
        order = np.lexsort((n[some], own))
        some, own = some[order], own[order]
        for lo, hi in _runs(own):
            part = some[lo:hi]
            out[part] |= _banded(codes, at[a[part]], n[part], at[b[part]], m[part], own[lo:hi])
        left &= ~out
    return out


def _runs(limit: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of ascending limits whose rows have about CELLS cells."""
    lo = 0
    while lo < len(limit):
        hi = lo + max(1, CELLS // (2 * int(limit[lo]) + 1))
        hi = min(len(limit), lo + max(1, CELLS // (2 * int(limit[min(hi, len(limit)) - 1]) + 1)))
        yield lo, hi
        lo = hi


def links(codes: np.ndarray, at: np.ndarray, kind: np.ndarray, a: np.ndarray, b: np.ndarray, apart: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Numbers of pairs (a, b) within their limits that join all classes (kind) which such pairs join. Of two classes the pairs that seem nearest (apart) are tried first, the others only
    while the classes are two."""
    _, kind = np.unique(kind, return_inverse=True)
    root, found, rest, take = np.arange(int(kind.max()) + 1 if len(kind) else 0), [], np.arange(len(a)), 1

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = int(root[c])
        return c

    while True:
        while len(root) and np.any(root[root] != root):
            root = root[root]
        x, y = root[kind[a[rest]]], root[kind[b[rest]]]
        rest, x, y = rest[x != y], x[x != y], y[x != y]
        if not len(rest):
            return np.array(found, np.int64)
        low, high = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((apart[rest], high, low))
        rest, key = rest[order], (low * len(root) + high)[order]
        some = np.arange(len(key)) - np.searchsorted(key, key, "left") < take
        for p in rest[some][within(codes, at, a[rest[some]], b[rest[some]], limit[rest[some]])].tolist():
            x, y = find(int(kind[a[p]])), find(int(kind[b[p]]))
            if x != y:
                root[max(x, y)] = min(x, y)
                found.append(p)
        rest, take = rest[~some], take * 4
