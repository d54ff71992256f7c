"""Deep-shallow sorting of byte strings: order and common prefixes of neighbours.

Multikey quicksort sorts by the first `SHALLOW` bytes; strings that agree so far go to a blind trie, which keeps only
the depth of each branch and its first bytes, so a string is placed by one blind descent and one comparison.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Strings are indexes; a branch is [depth, {byte or -1 for the end: child}], a leaf the list of equal strings."""

    def __init__(self, strings: list[bytes], first: int):
        self.strings = strings
        self.root: list = [first]

    def add(self, index: int) -> None:
        strings, text = self.strings, self.strings[index]
        size, node = len(text), self.root
        while node.__class__ is Branch:
            depth = node.depth
            child = node.children.get(text[depth] if depth < size else -1)
            node = next(iter(node.children.values())) if child is None else child
        other = strings[node[0]]
        agree = common_prefix(text, other)
        if agree == size == len(other):
            node.append(index)
            return
        mine = text[agree] if agree < size else -1
        above, last, node = None, 0, self.root
        while node.__class__ is Branch and node.depth < agree:
            above, last = node, text[node.depth] if node.depth < size else -1
            node = node.children[last]
        if node.__class__ is Branch and node.depth == agree:
            node.children[mine] = [index]
            return
        theirs = other[agree] if agree < len(other) else -1
        branch = Branch(agree, {theirs: node, mine: [index]})
        if above is None:
            self.root = branch
        else:
            above.children[last] = branch

    def walk(self, order: list[int], agree: list[int], before: int) -> None:
        """Appends the strings in order, and for each its common prefix with the one before (`before` for the first)."""
        stack: list[tuple[object, int]] = [(self.root, before)]
        while stack:
            node, shared = stack.pop()
            if node.__class__ is Branch:
                for byte in sorted(node.children, reverse=True):
                    stack.append((node.children[byte], node.depth))
                stack[-1] = (stack[-1][0], shared)  # the first child follows what came before this branch
            else:
                order.extend(node)
                agree.append(shared)
                agree.extend([len(self.strings[node[0]])] * (len(node) - 1))


class Branch:
    __slots__ = ("children", "depth")

    def __init__(self, depth: int, children: dict):
        self.depth, self.children = depth, children


def deep_shallow_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in ascending order of their strings, and the common prefix of each with the one before it."""
    order: list[int] = []
    agree: list[int] = []
    # (indexes, bytes they share, common prefix with what comes before)
    stack = [(list(range(len(strings))), 0, 0)]
    while stack:
        group, depth, before = stack.pop()
        if len(group) == 1:
            order.append(group[0])
            agree.append(before)
        elif group and depth >= SHALLOW:
            trie = BlindTrie(strings, group[0])
            for index in group[1:]:
                trie.add(index)
            trie.walk(order, agree, before)
        elif group:
            keys = [strings[i][depth] if len(strings[i]) > depth else -1 for i in group]
            pivot = keys[len(keys) // 2]
            less = [i for i, k in zip(group, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(group, keys, strict=True) if k == pivot]
            more = [i for i, k in zip(group, keys, strict=True) if k > pivot]
            if more:
                stack.append((more, depth, depth))
            if pivot >= 0:
                stack.append((same, depth + 1, depth if less else before))
            else:  # these end here and are equal; nothing is less than the end
                order.extend(same)
                agree.append(before)
                agree.extend([depth] * (len(same) - 1))
            if less:
                stack.append((less, depth, before))
    return np.array(order, np.int64), np.array(agree, np.int64)
