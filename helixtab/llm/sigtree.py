"""Signature trees over sets of 64-bit tokens: nodes hold the OR of their sets' bitmaps and the range of their sizes.

A pair of nodes is skipped when their sizes cannot reach the similarity, or when the largest overlap that the bitmaps allow is below
what it needs: bits of a signature that the other node lacks are tokens that no set below it shares. Signatures of different length are
folded by OR onto the shorter. Everything here works on the arrays of one group of bounded size, inside a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

#: Sets in a leaf, children of a node.
LEAF, FAN = 8, 4
#: Words of signatures that are compared at once.
CHUNK = 1 << 20


def signature(tokens: np.ndarray, bits_each: int) -> np.ndarray:
    """Bitmap of at least bits_each bits a token, a power of two long, as 64-bit words."""
    bits = 64
    while bits < bits_each * len(tokens):
        bits *= 2
    flags = np.zeros(bits, np.uint8)
    flags[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(sig: np.ndarray, size: int) -> np.ndarray:
    """A signature as one of `size` words."""
    return sig if len(sig) == size else np.bitwise_or.reduce(sig.reshape(-1, size), axis=0)


class Signatures:
    """Signatures of rows as one flat array and their offsets."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat, sizes
        self.at = np.cumsum(sizes) - sizes

    def __getitem__(self, row: int) -> np.ndarray:
        return self.flat[self.at[row] : self.at[row] + self.sizes[row]]

    def folded(self, rows: np.ndarray, size: int) -> np.ndarray:
        """(rows, size): the rows' signatures, folded to `size` words."""
        out, own = np.empty((len(rows), size), np.uint64), self.sizes[rows]
        for length in np.unique(own):
            k = np.flatnonzero(own == length)
            words = self.flat[self.at[rows[k]][:, None] + np.arange(length)]
            out[k] = np.bitwise_or.reduce(words.reshape(len(k), -1, size), axis=1)
        return out

    def most(self, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The largest overlap that sets i and j of sizes n may have."""
        out, size = np.empty(len(i), np.int64), np.minimum(self.sizes[i], self.sizes[j])
        for s in np.unique(size):
            same = np.flatnonzero(size == s)
            step = max(1, CHUNK // int(s))
            for a in range(0, len(same), step):
                k = same[a : a + step]
                p, q = self.folded(i[k], s), self.folded(j[k], s)
                out[k] = np.minimum(n[i[k]] - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), n[j[k]] - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
        return out


class Node:
    """rows, children, OR of the signatures, range of sizes; excess: the most tokens that a set below has beyond its bits."""

    __slots__ = ("children", "excess", "hi", "lo", "rows", "sig")

    def __init__(self, rows: np.ndarray, children: list["Node"], sig: np.ndarray, excess: int, lo: int, hi: int):
        self.rows, self.children, self.sig, self.excess, self.lo, self.hi = rows, children, sig, excess, lo, hi


class Tree:
    """Tree over `rows`, leaves in order of size; similarity num / den."""

    def __init__(self, n: np.ndarray, sigs: Signatures, rows: np.ndarray, num: int, den: int, leaf: int | None = None):
        self.n, self.sigs, self.num, self.den = n, sigs, num, den
        rows, leaf = rows[np.argsort(n[rows], kind="stable")], leaf or LEAF
        level = [self._leaf(rows[k : k + leaf]) for k in range(0, len(rows), leaf)]
        while len(level) > 1:
            level = [self._over(level[k : k + FAN]) for k in range(0, len(level), FAN)]
        self.root = level[0]

    def _leaf(self, rows: np.ndarray) -> Node:
        size = int(self.sigs.sizes[rows].min())
        each = self.sigs.folded(rows, size)
        excess = int((self.n[rows] - np.bitwise_count(each).sum(1, dtype=np.int64)).max())
        return Node(rows, [], np.bitwise_or.reduce(each, axis=0), excess, int(self.n[rows[0]]), int(self.n[rows[-1]]))

    def _over(self, nodes: list[Node]) -> Node:
        size = min(len(c.sig) for c in nodes)
        sig = np.bitwise_or.reduce([fold(c.sig, size) for c in nodes])
        rows = np.concatenate([c.rows for c in nodes])
        if all(len(c.sig) == size for c in nodes):
            excess = max(c.excess for c in nodes)
        else:
            excess = int((self.n[rows] - np.bitwise_count(self.sigs.folded(rows, size)).sum(1, dtype=np.int64)).max())
        return Node(rows, nodes, sig, excess, nodes[0].lo, nodes[-1].hi)

    def apart(self, x: Node, y: Node) -> bool:
        """True if no set below x can be similar to one below y."""
        if self.den * x.hi < self.num * y.lo or self.den * y.hi < self.num * x.lo:
            return True
        size = min(len(x.sig), len(y.sig))
        common = int(np.bitwise_count(fold(x.sig, size) & fold(y.sig, size)).sum())
        # shared tokens lie on common bits, and beyond one a bit there are no more of them than either side has in excess
        excess = min(z.excess for z in (x, y) if len(z.sig) == size)
        return (self.den + self.num) * (common + excess) < self.num * (x.lo + y.lo)


def dual(a: Tree, b: Tree, settled: Callable[[np.ndarray, np.ndarray], bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal of two trees, or of one with itself: rows of the pairs of leaves that neither the nodes rule out nor `settled`
    does, which says of the rows below two nodes that nothing is to be found among them any more. Pairs of one leaf come as (rows, rows)."""
    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        if settled(x.rows, y.rows) or x is not y and a.apart(x, y):
            continue
        if not x.children and not y.children:
            yield x.rows, y.rows
        elif x is y:
            kids = x.children
            stack += [(kids[u], kids[v]) for u in range(len(kids)) for v in range(u, len(kids))]
        elif x.children and (not y.children or len(x.rows) >= len(y.rows)):
            stack += [(c, y) for c in x.children]
        else:
            stack += [(x, c) for c in y.children]


def crossed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of two lists of rows; of one list with itself each pair once."""
    i, j = np.repeat(x, len(y)), np.tile(y, len(x))
    if x is y:
        up = np.repeat(np.arange(len(x)), len(y)) < np.tile(np.arange(len(y)), len(x))
        return i[up], j[up]
    return i, j


class Union:
    """Union-find over rows."""

    def __init__(self, names: np.ndarray):
        """Rows of equal name are one from the start."""
        _, first, back = np.unique(names, return_index=True, return_inverse=True)
        self.parent = first[back]

    def find(self, rows: np.ndarray) -> np.ndarray:
        p = self.parent[rows]
        while True:
            q = self.parent[p]
            if (q == p).all():
                return p
            p = q

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = int(p[i])
        return i

    def unite(self, i: int, j: int) -> bool:
        """False if they are one already."""
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)
        return a != b
