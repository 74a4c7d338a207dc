"""Ukkonen suffix trees over integer sequences, and longest common extensions by lowest common ancestors.

A sequence ends with a symbol that occurs nowhere else in it, so every suffix is a leaf.  Nodes are numbers into
plain lists; an extension query is a range minimum over the depths of the Euler tour, answered for arrays of
pairs at once: minima within blocks and a sparse table over blocks, so memory stays a few numbers a node.
"""

from __future__ import annotations

import numpy as np

BLOCK = 16


class SuffixTree:
    """Suffix tree of ``s`` by Ukkonen's algorithm: active point, suffix links, leaves that grow by themselves."""

    def __init__(self, s: list[int]):
        self.s = s
        n = len(s)
        self.start, self.end, self.link, self.leaf = [0], [0], [0], [-1]
        self.next: list[dict[int, int] | None] = [{}]
        start, end, link, leaf, down = self.start, self.end, self.link, self.leaf, self.next
        node, edge, length, pending, made = 0, 0, 0, 0, 0
        for i, c in enumerate(s):
            pending += 1
            waiting = 0  # internal node of this phase that still lacks its link (0: none)
            while pending:
                if not length:
                    edge = i
                children = down[node]
                x = children.get(s[edge])
                if x is None:
                    children[s[edge]] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    leaf.append(made)
                    down.append(None)
                    made += 1
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    a = start[x]
                    size = end[x] - a
                    if length >= size:
                        edge += size
                        length -= size
                        node = x
                        continue
                    if s[a + length] == c:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    mid = len(start)
                    children[s[edge]] = mid
                    start += (a, i)
                    end += (a + length, n)
                    link += (0, 0)
                    leaf += (-1, made)
                    down += ({c: mid + 1, s[a + length]: x}, None)
                    made += 1
                    start[x] = a + length
                    if waiting:
                        link[waiting] = mid
                    waiting = mid
                pending -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - pending + 1

    def tour(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Euler tour with children in the order of their symbols: (depth in symbols at every step, step of each
        suffix' leaf, rank of each suffix)."""
        start, end, leaf, down, n = self.start, self.end, self.leaf, self.next, len(self.s)
        depths: list[int] = []
        at, order = [0] * n, []
        stack: list[tuple[int, object, int]] = []
        depth, todo = 0, iter([x for _, x in sorted(down[0].items())])
        depths.append(0)
        while True:
            for x in todo:
                if leaf[x] >= 0:
                    k = leaf[x]
                    at[k] = len(depths)
                    order.append(k)
                    depths += (n - k, depth)
                else:
                    stack.append((depth, todo))
                    depth += end[x] - start[x]
                    depths.append(depth)
                    todo = iter([y for _, y in sorted(down[x].items())])
                    break
            else:
                if not stack:
                    break
                depth, todo = stack.pop()
                depths.append(depth)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        return np.array(depths, np.int32), np.array(at, np.int64), rank

    def ranks(self, key) -> np.ndarray:
        """Rank of each suffix when symbols are ordered by ``key``."""
        leaf, down, n = self.leaf, self.next, len(self.s)
        order, stack = [], [0]
        while stack:
            x = stack.pop()
            if leaf[x] >= 0:
                order.append(leaf[x])
            else:
                children = down[x]
                stack += [children[c] for c in sorted(children, key=key, reverse=True)]
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        return rank


class Extensions:
    """Longest common extensions of a tree's suffixes in constant time each."""

    def __init__(self, depths: np.ndarray, at: np.ndarray):
        self.at = at
        n = len(depths)
        blocks = -(-n // BLOCK)
        d = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        d[:n] = depths
        self.depths = d
        grid = d.reshape(blocks, BLOCK)
        self.left = np.minimum.accumulate(grid, axis=1).ravel()  # from the block's beginning
        self.right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()  # to the block's end
        self.table = [grid.min(axis=1)]
        step = 1
        while 2 * step <= blocks:
            row = self.table[-1]
            self.table.append(np.minimum(row[:-step], row[step:]))
            step *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes ``i`` and ``j`` (different ones), elementwise."""
        a, b = self.at[i], self.at[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        x, y = a // BLOCK, b // BLOCK
        out = np.minimum(self.right[a], self.left[b])
        for k in np.flatnonzero(x == y):  # inside one block
            out[k] = self.depths[a[k]:b[k] + 1].min()
        far = np.flatnonzero(y - x > 1)
        if len(far):
            lo, size = x[far] + 1, y[far] - x[far] - 1
            level = np.frexp(size.astype(np.float64))[1] - 1
            best = np.empty(len(far), np.int32)
            for v in np.unique(level):
                m = level == v
                row = self.table[v]
                best[m] = np.minimum(row[lo[m]], row[lo[m] + size[m] - (1 << int(v))])
            out[far] = np.minimum(out[far], best)
        return out
