"""Signature trees over token sets, and the dual traversals that compare them.

A node holds the OR of its sets' bitmaps, the range of their sizes, and the most tokens that any of
them has beyond its bitmap's bits. Two sets share at most the common bits of their bitmaps plus the
smaller of those excesses; what that bound says of two nodes holds for every pair below them.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

LEAF = 16
FANOUT = 8
#: Widths of bitmaps: powers of two from twice the set's size up.
NARROWEST, WIDEST = 64, 1 << 16


def bitmap(tokens: np.ndarray) -> bytes:
    """A set's bitmap of its own width: a bit for each token's hash."""
    width = NARROWEST
    while width < 2 * len(tokens) and width < WIDEST:
        width *= 2
    flags = np.zeros(width, dtype=bool)
    flags[(tokens >> np.uint64(20)).astype(np.int64) & (width - 1)] = True
    return np.packbits(flags).tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half the width: a token's place there is its place modulo the width."""
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


class Components:
    """Union-find whose root is the lowest position."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


class Node:
    __slots__ = ("bits", "low", "high", "excess", "children", "members", "sizes", "each", "spare")

    def __init__(self, bits, sizes, spare, children, members, each=None):
        self.bits, self.children, self.members = bits, children, members
        self.low, self.high, self.excess = int(min(sizes)), int(max(sizes)), int(max(spare))
        self.sizes, self.spare, self.each = sizes, spare, each  # of a leaf's sets


def tree(members: np.ndarray, bits: np.ndarray, sizes: np.ndarray, order: list) -> Node | None:
    """A tree packed bottom-up over the members in the given order; bits and sizes are those of the members."""
    if not len(members):
        return None
    order = np.array(order)
    members, bits, sizes = members[order], bits[order], sizes[order]
    spare = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    level = []
    for at in range(0, len(members), LEAF):
        own = slice(at, at + LEAF)
        level.append(Node(np.bitwise_or.reduce(bits[own]), sizes[own], spare[own], None, members[own], bits[own]))
    while len(level) > 1:
        groups = [level[at : at + FANOUT] for at in range(0, len(level), FANOUT)]
        level = [Node(np.bitwise_or.reduce([n.bits for n in g]), [v for n in g for v in (n.low, n.high)], [n.excess for n in g], g, np.concatenate([n.members for n in g])) for g in groups]
    return level[0]


class Traversal:
    """Walks two trees together. percent: 100 * shared >= percent * union links two sets."""

    def __init__(self, percent: int):
        self.percent = percent

    def needed(self, a, b):
        """Fewest shared tokens of linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def hopeless(self, x: Node, y: Node) -> bool:
        if 100 * x.high < self.percent * y.low or 100 * y.high < self.percent * x.low:
            return True
        return int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.excess, y.excess) < self.needed(x.low, y.low)

    def settled(self, x: Node, y: Node) -> bool:
        """Whether no pair between the nodes could tell anything new."""
        raise NotImplementedError

    def leaves(self, x: Node, y: Node, may: np.ndarray) -> None:
        """Takes the pairs of two leaves that the bound leaves possible."""
        raise NotImplementedError

    def walk(self, x: Node | None, y: Node | None) -> None:
        """All pairs between x and y (within x, where y is x), without pairs of nodes that are hopeless or settled."""
        stack = [(x, y)] if x and y else []
        while stack:
            x, y = stack.pop()
            if (x is not y and self.hopeless(x, y)) or self.settled(x, y):
                continue
            if x.children is None and y.children is None:
                self._compare(x, y)
            elif x is y:  # a child with itself first: what it finds spares pairs
                n = len(x.children)
                stack += [(x.children[i], x.children[j]) for i in range(n) for j in range(n - 1, i, -1)]
                stack += [(c, c) for c in reversed(x.children)]
            elif y.children is None or (x.children is not None and len(x.members) >= len(y.members)):
                stack += [(c, y) for c in reversed(x.children)]
            else:
                stack += [(x, c) for c in reversed(y.children)]

    def _compare(self, x: Node, y: Node) -> None:
        sa, sb = x.sizes[:, None], y.sizes[None, :]
        shared = np.bitwise_count(x.each[:, None, :] & y.each[None, :, :]).sum(axis=2).astype(np.int64)
        most = np.minimum(shared + np.minimum(x.spare[:, None], y.spare[None, :]), np.minimum(sa, sb))
        may = most >= self.needed(sa, sb)
        if x is y:
            may = np.triu(may, 1)
        if may.any():
            self.leaves(x, y, may)


class Possible(Traversal):
    """Which members may be linked to any other, by their bitmaps and sizes alone. sides: only pairs of members of different sides count."""

    def __init__(self, maps: list[bytes], sizes: list[int], percent: int, sides: list[bool] | None = None):
        super().__init__(percent)
        self.alive = np.zeros(len(maps), dtype=bool)
        by = defaultdict(list)
        for i, m in enumerate(maps):
            by[len(m), bool(sides and sides[i])].append(i)
        sizes = np.array(sizes, dtype=np.int64)
        held, trees = {}, {}
        for (width, side), own in by.items():
            held[width, side] = np.frombuffer(b"".join(maps[i] for i in own), dtype=np.uint8).reshape(len(own), width).copy()
            trees[width, side] = self._tree(own, held[width, side], sizes)
        # Any two widths whose sizes the threshold allows are compared, the wider one folded.
        for narrow, own in by.items():
            for wide, other in by.items():
                if wide[0] < narrow[0] or (wide[0] == narrow[0] and wide[1] < narrow[1]) or (sides and wide[1] == narrow[1]):
                    continue
                if 100 * int(sizes[own].max()) < percent * int(sizes[other].min()):
                    continue
                bits = held[wide]
                while bits.shape[1] > narrow[0]:
                    bits = folded(bits)
                self.walk(trees[narrow], trees[wide] if wide[0] == narrow[0] else self._tree(other, bits, sizes))

    @staticmethod
    def _tree(own: list[int], bits: np.ndarray, sizes: np.ndarray) -> Node | None:
        bits = bits.view(np.uint64) if bits.shape[1] % 8 == 0 else bits
        return tree(np.array(own), bits, sizes[own], sorted(range(len(own)), key=lambda k: (int(sizes[own[k]]), bits[k].tobytes())))

    def settled(self, x: Node, y: Node) -> bool:
        return bool(self.alive[x.members].all() and self.alive[y.members].all())

    def leaves(self, x: Node, y: Node, may: np.ndarray) -> None:
        self.alive[x.members[may.any(axis=1)]] = True
        self.alive[y.members[may.any(axis=0)]] = True


class Forest(Traversal):
    """Sets, trees over them, and links that join the components of all similar pairs."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        super().__init__(percent)
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.components = Components(len(sets))
        self.links: list[tuple[int, int]] = []
        width = 256
        while width < 4 * int(self.sizes.max(initial=1)) and width < WIDEST:
            width *= 2
        flags = np.zeros((len(sets), width), dtype=bool)
        for i, s in enumerate(sets):
            flags[i, (s >> np.uint64(20)).astype(np.int64) & (width - 1)] = True
        self.bits = np.packbits(flags, axis=1).view(np.uint64)

    def tree(self, members: list[int]) -> Node | None:
        """A tree in the order of the smallest token and the size, which brings similar sets together."""
        key = lambda k: (int(self.sets[members[k]][0]) if len(self.sets[members[k]]) else 0, int(self.sizes[members[k]]), k)
        return tree(np.array(members, dtype=np.int64), self.bits[members], self.sizes[members], sorted(range(len(members)), key=key))

    def settled(self, x: Node, y: Node) -> bool:
        find = self.components.find
        root = find(int(x.members[0]))
        return len(x.members) + len(y.members) > 2 and all(find(i) == root for i in y.members.tolist()) and all(find(i) == root for i in x.members.tolist())

    def leaves(self, x: Node, y: Node, may: np.ndarray) -> None:
        find = self.components.find
        for a, b in zip(*np.nonzero(may), strict=True):
            i, j = int(x.members[a]), int(y.members[b])
            if i != j and find(i) != find(j) and self.linked(i, j):
                self.components.join(i, j)
                self.links.append((i, j))

    def traverse(self, x: Node | None, y: Node | None) -> list[tuple[int, int]]:
        """Links between x and y (within x, where y is x) that join the components of all similar pairs."""
        self.links = []
        self.walk(x, y)
        return self.links

    def linked(self, i: int, j: int) -> bool:
        """The exact check."""
        s, t = self.sets[i], self.sets[j]
        if len(s) > len(t):
            s, t = t, s
        if not len(s):
            return False
        at = np.minimum(np.searchsorted(t, s), len(t) - 1)
        shared = int((t[at] == s).sum())
        return 100 * shared >= self.percent * (len(s) + len(t) - shared)
