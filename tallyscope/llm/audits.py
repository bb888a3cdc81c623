"""Edit prefixes as linked nodes that share what they have in common.

A node adds a piece of text to its parent and keeps the length and rolling hash of the whole
prefix, and its ancestors at distances 1, 2, 4, ... Two prefixes compare by their longest common
prefix: ancestors are searched by hash from the farthest jump to the nearest, so long prefixes
cost a few steps. Equal hashes are no proof, so the part behind the last shared node is compared
as text before a result counts.
"""

from __future__ import annotations

PRIME, BASE = (1 << 61) - 1, 0x1F3A5C7E9B2D4F61


class Audits:
    def __init__(self) -> None:
        self.parent, self.piece, self.length, self.hash = [0], [""], [0], [0]
        self.up: list[tuple[int, ...]] = [()]

    def add(self, parent: int, piece: str) -> int:
        value = self.hash[parent]
        for c in piece:
            value = (value * BASE + ord(c)) % PRIME
        node, up, k = len(self.parent), [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.parent.append(parent)
        self.piece.append(piece)
        self.length.append(self.length[parent] + len(piece))
        self.hash.append(value)
        self.up.append(tuple(up))
        return node

    def text(self, node: int, above: int = 0) -> str:
        """The text of ``node`` behind its ancestor ``above``."""
        parts = []
        while node != above:
            parts.append(self.piece[node])
            node = self.parent[node]
        return "".join(reversed(parts))

    def _over(self, node: int, length: int) -> int:
        """The highest node on the way to ``node`` whose text is longer than ``length``."""
        for k in range(len(self.up[node]) - 1, -1, -1):
            if k < len(self.up[node]) and self.length[self.up[node][k]] > length:
                node = self.up[node][k]
        return node

    def prefix_hash(self, node: int, length: int) -> int:
        if self.length[node] <= length:
            return self.hash[node]
        node = self._over(node, length)
        above = self.parent[node]
        value = self.hash[above]
        for c in self.piece[node][: length - self.length[above]]:
            value = (value * BASE + ord(c)) % PRIME
        return value

    def _shared(self, a: int, b: int) -> int:
        """The last node that both ways from the start have in common."""
        while a != b:
            if self.length[a] < self.length[b] or (self.length[a] == self.length[b] and a < b):
                a, b = b, a
            a = self.parent[a]
        return a

    def common(self, a: int, b: int) -> int:
        """Length of the longest common prefix."""
        agrees = lambda x: self.length[x] <= self.length[b] and self.hash[x] == self.prefix_hash(b, self.length[x])
        deep = a
        if not agrees(deep):
            for k in range(len(self.up[a]) - 1, -1, -1):
                if k < len(self.up[deep]) and not agrees(self.up[deep][k]):
                    deep = self.up[deep][k]
            # ``deep`` is the highest that differs; its piece may still begin alike
            deep_parent = self.parent[deep]
        else:
            deep_parent = a
        start = self.length[deep_parent]
        mine = "" if deep_parent == a else self.piece[deep]
        theirs = self._slice(b, start, start + len(mine))
        more = next((i for i, (x, y) in enumerate(zip(mine, theirs)) if x != y), min(len(mine), len(theirs)))
        return self._verified(a, b, start + more)

    def _slice(self, node: int, lo: int, hi: int) -> str:
        if hi <= lo or lo >= self.length[node]:
            return ""
        if self.length[node] > hi:
            node = self._over(node, hi - 1)
        above = node
        while self.length[above] > lo:
            above = self.parent[above]
        return self.text(node, above)[lo - self.length[above] : hi - self.length[above]]

    def _verified(self, a: int, b: int, length: int) -> int:
        """``length`` if the texts agree so far, else the length up to which they do."""
        x, y = (self._over(n, length - 1) if self.length[n] > length else n for n in (a, b)) if length else (0, 0)
        above = self._shared(x, y)
        start = self.length[above]
        mine, theirs = self.text(x, above)[: length - start], self.text(y, above)[: length - start]
        if mine == theirs:
            return length
        return start + next(i for i, (p, q) in enumerate(zip(mine, theirs)) if p != q)

    def less(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` comes before that of ``b``."""
        if a == b:
            return False
        n = self.common(a, b)
        if n == self.length[a] or n == self.length[b]:
            return self.length[a] < self.length[b]
        return self._slice(a, n, n + 1) < self._slice(b, n, n + 1)
