"""Hamming distances of many fingerprints at once, on vertical bit planes.

Bit ``i`` of word ``w`` of plane ``b`` is bit ``b`` of candidate ``64 w + i``: one
operation on a word advances 64 distances.  Distances are kept in carry-save
bitwise counters that start so high that passing the radius overflows them; a
word whose 64 candidates have all overflowed is abandoned.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Planes added between two looks at what may be abandoned.
STEP = 8


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(n, w) uint64 -> (64 w, ceil(n / 64)) uint64."""
    n, w = values.shape
    bits = np.zeros((-(-n // 64) * 64, 64 * w), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(values).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(plane: Callable[[int, np.ndarray | None], np.ndarray], planes: int, words: int, radius: int) -> np.ndarray:
    """For each of ``words`` words the candidates (as bits) whose distance is at most ``radius``.

    ``plane(b, at)`` gives plane b of the differences, at the word indices ``at``
    or all of them.  ``planes`` is a multiple of 8.
    """
    k = max(3, radius.bit_length())
    bias = (1 << k) - 1 - radius
    count = [np.full(words, ALL if bias >> i & 1 else 0, np.uint64) for i in range(k)]
    dead = np.zeros(words, np.uint64)
    at: np.ndarray | None = None
    for b in range(0, planes, STEP):
        p = [plane(b + i, at) for i in range(STEP)]
        count[0], t1 = _add(count[0], p[0], p[1])
        count[0], t2 = _add(count[0], p[2], p[3])
        count[1], f1 = _add(count[1], t1, t2)
        count[0], t1 = _add(count[0], p[4], p[5])
        count[0], t2 = _add(count[0], p[6], p[7])
        count[1], f2 = _add(count[1], t1, t2)
        count[2], carry = _add(count[2], f1, f2)
        for i in range(3, k):
            count[i], carry = count[i] ^ carry, count[i] & carry
        dead |= carry
        alive = dead != ALL
        n = int(np.count_nonzero(alive))
        if n == 0:
            return np.zeros(words, np.uint64)
        if 2 * n < len(alive):
            at = np.flatnonzero(alive) if at is None else at[alive]
            count = [c[alive] for c in count]
            dead = dead[alive]
    out = np.zeros(words, np.uint64)
    out[slice(None) if at is None else at] = ~dead
    return out


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Which rows of two (n, w) arrays differ in at most ``radius`` bits."""
    n = len(left)
    planes = bit_planes(left ^ right)
    hit = within(lambda b, at: planes[b] if at is None else planes[b][at], len(planes), planes.shape[1], radius)
    return np.unpackbits(hit.view(np.uint8), bitorder="little")[:n].astype(bool)


class Block:
    """One block of fingerprints, to find neighbours in."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.planes = bit_planes(values)
        bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8), axis=1, bitorder="little")
        self.masks = np.where(bits.T, ALL, np.uint64(0))

    def near(self, queries: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
        """(queries, words) bits: rows of the block's words near each of its rows ``queries``."""
        planes, masks = self.planes[:, words], self.masks[:, queries]
        nq, nw = len(queries), len(words)

        def plane(b: int, at: np.ndarray | None) -> np.ndarray:
            if at is None:
                return (masks[b][:, None] ^ planes[b][None, :]).ravel()
            return masks[b][at // nw] ^ planes[b][at % nw]

        return within(plane, len(planes), nq * nw, radius).reshape(nq, nw)


def forest(values: np.ndarray, side: np.ndarray, radius: int, tile: int = 1 << 15) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the near pairs among ``values``.

    Rows of side 1 are compared with rows of side 2 only, rows of side 0 with all.
    Each row is expanded once, against the rows not yet reached.
    """
    block = Block(values)
    n, all_words = block.n, block.planes.shape[1]

    def as_words(flags: np.ndarray) -> np.ndarray:
        padded = np.zeros(all_words * 64, np.uint8)
        padded[:n] = flags
        return np.packbits(padded, bitorder="little").view(np.uint64)

    free = as_words(np.ones(n, bool))
    sides = {s: as_words(side != s) if s else as_words(np.ones(n, bool)) for s in np.unique(side).tolist()}
    edges: list[tuple[int, int]] = []

    def take(q: int, row: np.ndarray, words: np.ndarray) -> list[int]:
        """Hangs the free rows of a row's neighbours on it."""
        new = row & free[words] & sides[int(side[q])][words]
        if not new.any():
            return []
        free[words] &= ~new
        at = np.flatnonzero(np.unpackbits(new.view(np.uint8), bitorder="little"))
        reached = ((words[at >> 6] << 6) + (at & 63)).tolist()
        edges.extend((q, r) for r in reached)
        return reached

    while len(words := np.flatnonzero(free)):
        # neighbours of several possible roots at once; a tree is finished before the next root,
        # so a root that is still free then has no neighbour in the trees before it
        bits = np.flatnonzero(np.unpackbits(free[words].view(np.uint8), bitorder="little")[: 64 * 64])
        roots = ((words[bits >> 6] << 6) + (bits & 63))[: max(1, tile // len(words))][:64]
        for root, row in zip(roots.tolist(), block.near(roots, words, radius), strict=True):
            if not int(free[root >> 6]) >> (root & 63) & 1:
                continue
            free[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
            stack = take(root, row, words)
            while stack and len(left := np.flatnonzero(free)):
                batch = max(1, min(len(stack), tile // len(left)))
                queries, stack = stack[-batch:], stack[:-batch]
                for q, found in zip(queries, block.near(np.array(queries), left, radius), strict=True):
                    stack += take(q, found, left)
    return edges
