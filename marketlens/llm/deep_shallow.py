"""Deep-shallow sorting of byte strings, and the common prefixes of neighbours.

Multikey quicksort orders the strings down to a shallow depth: the three-way
split of all open groups is made at once, by a sort on the group and its next
eight bytes. What still shares that prefix is ordered by blind tries, which
look at single bytes on the way down, compare each string with one leaf only,
and know the common prefixes of all neighbours when done.
"""

from __future__ import annotations

import numpy as np

SYMBOL = 8
SHALLOW_SYMBOLS = 2


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo if hi == lo or a[lo] != b[lo] else lo + 1


class BlindTrie:
    """Inner nodes are [depth, {byte: child}], leaves lists of equal strings; -1 stands for the end of a string."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list = []

    def insert(self, item: int) -> None:
        own = self.strings[item]
        if not self.root:
            self.root = [item]
            return
        node = self.root
        while len(node) == 2 and isinstance(node[1], dict):
            depth, children = node
            byte = own[depth] if depth < len(own) else -1
            node = children[byte] if byte in children else next(iter(children.values()))
        leaf = self.strings[node[0]]
        common = common_prefix(own, leaf)
        if common == len(own) == len(leaf):
            node.append(item)
            return
        parent, key, node = None, 0, self.root
        while len(node) == 2 and isinstance(node[1], dict) and node[0] < common:
            parent, key = node, own[node[0]]
            node = node[1][key]
        byte = own[common] if common < len(own) else -1
        if len(node) == 2 and isinstance(node[1], dict) and node[0] == common:
            node[1][byte] = [item]
            return
        inner = [common, {leaf[common] if common < len(leaf) else -1: node, byte: [item]}]
        if parent is None:
            self.root = inner
        else:
            parent[1][key] = inner

    def walk(self) -> tuple[list[int], list[int]]:
        """Items in order, and the common prefix of each with the one before (-1: the first)."""
        order: list[int] = []
        common: list[int] = []
        stack: list[tuple[list, int]] = [(self.root, -1)]
        while stack:
            node, before = stack.pop()
            if len(node) == 2 and isinstance(node[1], dict):
                depth, children = node
                keys = sorted(children)
                stack += [(children[k], depth) for k in reversed(keys[1:])]
                stack.append((children[keys[0]], before))
            else:
                order += node
                common += [before] + [len(self.strings[node[0]])] * (len(node) - 1)
        return order, common


def deep_shallow_sort(strings: list[bytes], group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (group, string), and the common prefix of neighbours; -1 between groups."""
    n, width = len(strings), SYMBOL * SHALLOW_SYMBOLS
    head = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(n, SHALLOW_SYMBOLS)
    length = np.fromiter(map(len, strings), np.int64, n)
    order, tie = np.arange(n), np.asarray(group).astype(np.int64)
    for level in range(SHALLOW_SYMBOLS):  # split the open groups of equal prefixes
        symbol = head[order, level].astype(np.uint64)
        at = np.lexsort((symbol, tie))
        order, tie, symbol = order[at], tie[at], symbol[at]
        new = np.ones(n, bool)
        new[1:] = (tie[1:] != tie[:-1]) | (symbol[1:] != symbol[:-1])
        tie = np.cumsum(new)
    keys = tie
    common = np.full(n, -1, np.int64)
    edge = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1]]) if n else tie
    for lo, hi in zip(edge, np.r_[edge[1:], n], strict=True):
        if hi - lo > 1:
            trie = BlindTrie(strings)
            for item in order[lo:hi].tolist():
                trie.insert(item)
            order[lo:hi], common[lo:hi] = trie.walk()
    last, first = order[edge[1:] - 1], order[edge[1:]]  # neighbours that the shallow sort told apart
    grouped, flat = np.asarray(group), head.view(np.uint8).reshape(n, width)
    differs = (flat[last] != flat[first]).argmax(axis=1)
    shared = np.minimum(differs, np.minimum(length[last], length[first]))
    common[edge[1:]] = np.where(grouped[last] == grouped[first], shared, -1)
    return order, common
