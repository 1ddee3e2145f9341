"""Suffix trees by Ukkonen's algorithm, and longest common extensions by constant-time lowest common ancestors.

A text is an array of positive integers; the end mark is 0, below all of them. The Euler tour of the tree lists the string depths of the nodes it
passes, so the lowest common ancestor of two leaves is the minimum between them. Minima of blocks of the tour are kept in a sparse table, so the memory
stays near the size of the tour, and a query reads two blocks' ends and two table cells.
"""

from __future__ import annotations

import numpy as np

_BLOCK = 32


def ukkonen(text: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
    """(first, last) place of the label of every node's edge, and node * width + symbol -> child. Node 0 is the root; `text` ends with its only 0."""
    size = len(text)
    first, last, link, child = [0], [0], [0], {}
    node = edge = length = rest = 0
    for i, symbol in enumerate(text):
        rest += 1
        waits = 0   # the inner node made just now, whose link is not known yet
        while rest:
            if not length:
                edge = i
            key = node * width + text[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                first.append(i)
                last.append(size)
                link.append(0)
                if waits:
                    link[waits] = node
                waits = node
            else:
                top = first[below]
                span = (last[below] if last[below] <= i else i + 1) - top
                if length >= span:
                    edge += span
                    length -= span
                    node = below
                    continue
                if text[top + length] == symbol:
                    length += 1
                    if waits:
                        link[waits] = node
                    break
                inner = len(first)
                child[key] = inner
                first += (top, i)
                last += (top + length, size)
                link += (0, 0)
                child[inner * width + symbol] = inner + 1
                first[below] = top + length
                child[inner * width + text[top + length]] = below
                if waits:
                    link[waits] = inner
                waits = inner
            rest -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - rest + 1
    return first, last, child


class Extensions:
    """Lexicographic rank of every suffix and longest common extensions of pairs of them."""

    def __init__(self, symbols: np.ndarray):
        text = [*symbols.tolist(), 0]
        size, width = len(text), int(symbols.max(initial=0)) + 1
        first, last, child = ukkonen(text, width)
        keys = np.sort(np.fromiter(child, np.int64, len(child)))   # by parent, then symbol
        kids = [child[k] for k in keys.tolist()]
        ends = np.searchsorted(keys // width, np.arange(len(first)), side="right").tolist()
        at = [0, *ends[:-1]]
        depth = [0] * len(first)
        tour, place, leaves = [0], [0] * size, []
        path, node, here = [], 0, 0
        while True:
            k = at[node]
            if k < ends[node]:
                at[node] = k + 1
                low = kids[k]
                deep = here + last[low] - first[low]
                if at[low] == ends[low]:
                    place[size - deep] = len(tour)
                    leaves.append(size - deep)
                    tour += (deep, here)
                else:
                    path.append(node)
                    node, here = low, deep
                    depth[low] = deep
                    tour.append(deep)
            elif path:
                node = path.pop()
                here = depth[node]
                tour.append(here)
            else:
                break
        self.size, self.place = size, np.array(place)
        self.rank = np.empty(size, np.int64)
        self.rank[leaves] = np.arange(size)
        padded = np.full(-(-len(tour) // _BLOCK) * _BLOCK, size, np.int32)
        padded[:len(tour)] = tour
        blocks = padded.reshape(-1, _BLOCK)
        self.tour = padded
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [blocks.min(axis=1)]
        while 2 << len(self.table) - 1 <= len(blocks):
            below, step = self.table[-1], 1 << len(self.table) - 1
            self.table.append(np.minimum(below[:-step], below[step:]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes a and b (elementwise, a != b)."""
        x, y = self.place[a], self.place[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        from_, to = x // _BLOCK, y // _BLOCK
        out = np.minimum(self.behind[x], self.ahead[y])
        far = np.flatnonzero(to - from_ > 1)
        if len(far):
            lo, count = from_[far] + 1, to[far] - from_[far] - 1
            level = np.frexp(count)[1] - 1
            for n in np.unique(level):
                some = level == n
                row, left = self.table[n], lo[some]
                right = left + count[some] - (1 << n)
                out[far[some]] = np.minimum(out[far[some]], np.minimum(row[left], row[right]))
        near = np.flatnonzero(to == from_)
        if len(near):
            left, right = x[near], y[near]
            best = self.tour[left]
            for k in range(1, _BLOCK):
                best = np.minimum(best, self.tour[np.minimum(left + k, right)])
            out[near] = best
        return out
