"""Words, shingle sets and SuperMinHash signatures of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

from loomgraph.llm.common import mix

_BASE = 0x9E3779B97F4A7C15
_SPREAD = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and their inverses."""
    if "up" not in _powers or len(_powers["up"]) < n:
        n = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def words(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z lower-cased) of all texts in turn, and the
    number of the text that each belongs to."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass").lower() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)))
    hashes = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * np.uint64(_SPREAD[7]))
    return hashes, np.searchsorted(ends, start, side="right")


def shingle_sets(texts: list, width: int = 4) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text with fewer words than the
    width has its whole sequence as its one shingle, a text without words none."""
    h, of = words(texts)
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    n = len(h) - width + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        rolled += h[k : k + n] * np.uint64(_SPREAD[k])
    rolled = mix(rolled)
    out = []
    for i in range(len(texts)):
        a, b = first[i], first[i + 1]
        if b - a >= width:
            own = np.sort(rolled[a : b - width + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            few = (h[a:b] * np.array(_SPREAD[: b - a], np.uint64)).sum(dtype=np.uint64)
            out.append(mix(np.array([few + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _draw(x: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The fractional rank (56 bits) and a second random number of each element at
    this level of its own permutation."""
    r = mix(x + np.uint64((level + 1) * _SPREAD[0] & (1 << 64) - 1))
    return r >> np.uint64(8), mix(r ^ np.uint64(_SPREAD[1])) >> np.uint64(32)


def superminhash(sets: list[np.ndarray], size: int = 128, chunk: int = 60_000) -> np.ndarray:
    """One row of `size` 64-bit values per set.

    Each element walks its own random permutation of the slots; its value in the
    j-th slot of the walk is j plus a fraction (here the level in the upper 8 bits
    and the fraction below). All elements of a set move one level at a time, and a
    set stops as soon as no slot can be improved any more, which for large sets is
    after one or two levels. A slot of an empty set stays at the maximum."""
    n = len(sets)
    top = np.uint64((1 << 64) - 1)
    out = np.full(n * size, top, np.uint64)
    if not n:
        return out.reshape(0, size)
    x, of = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    rank, draw = _draw(x, 0)
    slot = (draw % np.uint64(size)).astype(np.int64)
    np.minimum.at(out, of * size + slot, rank)
    out2 = out.reshape(n, size)
    open_ = (out2.max(axis=1) >= np.uint64(1 << 56)) & np.array([len(s) > 0 for s in sets])
    left = np.flatnonzero(open_[of])
    cut = 0
    while cut < len(left):
        stop = min(cut + chunk, len(left))
        if stop < len(left):  # a set is never split over chunks
            stop = max(np.searchsorted(of[left], of[left[stop]]), cut)
            if stop == cut:
                stop = np.searchsorted(of[left], of[left[cut]], side="right")
        own = left[cut:stop]
        cut = stop
        e, d, row = x[own], of[own], np.arange(len(own))
        walk = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (len(own), 1))
        walk[row, slot[own]] = 0
        for level in range(1, size):
            rank, draw = _draw(e, level)
            k = (level + draw % np.uint64(size - level)).astype(np.int64)
            at = walk[row, k].astype(np.int64)
            walk[row, k] = walk[row, level]
            np.minimum.at(out, d * size + at, rank + np.uint64(level << 56))
            going = out2[d].max(axis=1) >= np.uint64(level + 1 << 56) if len(d) < 2000 else (out2.max(axis=1) >= np.uint64(level + 1 << 56))[d]
            if not going.any():
                break
            if going.mean() < 0.6:
                e, d, walk = e[going], d[going], walk[going]
                row = np.arange(len(e))
    return out2


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set as a whole."""
    a = [mix(s ^ np.uint64(_SPREAD[2])).sum(dtype=np.uint64) for s in sets]
    b = [mix(s ^ np.uint64(_SPREAD[3])).sum(dtype=np.uint64) for s in sets]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def batches(texts: list, most: int = 400_000):
    """Slices of a list of texts, each of about so many characters: the arrays made of a
    slice take some hundred bytes for each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
