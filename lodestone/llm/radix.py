"""Adaptive radix trees over keys of fixed-width parts: nodes of four layouts, and paths of one child kept as one prefix.

A key is a sequence of parts of `WIDTH` bytes, each a big-endian number. Keys that end at a node are counted there. Only byte depths at
the end of a part are nodes of the trie that the tree stands for; those inside a prefix have the members of the node below them.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator

WIDTH = 16


class Sorted:
    """Children by sorted key bytes: the layout of few children (4, then 16)."""

    __slots__ = ("most", "keys", "kids")

    def __init__(self, most: int = 4):
        self.most, self.keys, self.kids = most, bytearray(), []

    def find(self, byte: int):
        at = self.keys.find(byte)
        return None if at < 0 else self.kids[at]

    def put(self, byte: int, kid) -> Sorted | Indexed:
        """The layout with the child added: this one, or a larger one if it is full. A known byte gets the new child."""
        at = bisect_left(self.keys, byte)
        if at < len(self.keys) and self.keys[at] == byte:
            self.kids[at] = kid
            return self
        if len(self.keys) == self.most:
            larger = Sorted(16) if self.most == 4 else Indexed()
            for b, k in self.items():
                larger.put(b, k)
            return larger.put(byte, kid)
        self.keys.insert(at, byte)
        self.kids.insert(at, kid)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.keys, self.kids, strict=True)


class Indexed:
    """Up to 48 children behind a table of 256 places."""

    __slots__ = ("places", "kids")
    MOST = 48

    def __init__(self):
        self.places, self.kids = bytearray(256), []

    def find(self, byte: int):
        place = self.places[byte]
        return self.kids[place - 1] if place else None

    def put(self, byte: int, kid) -> Indexed | Full:
        if self.places[byte]:
            self.kids[self.places[byte] - 1] = kid
            return self
        if len(self.kids) == self.MOST:
            larger = Full()
            for b, k in self.items():
                larger.put(b, k)
            return larger.put(byte, kid)
        self.kids.append(kid)
        self.places[byte] = len(self.kids)
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, self.kids[p - 1]) for b, p in enumerate(self.places) if p)


class Full:
    """A place for each of 256 children."""

    __slots__ = ("kids",)

    def __init__(self):
        self.kids: list = [None] * 256

    def find(self, byte: int):
        return self.kids[byte]

    def put(self, byte: int, kid) -> Full:
        self.kids[byte] = kid
        return self

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((b, k) for b, k in enumerate(self.kids) if k is not None)


class Node:
    """A prefix after the byte that leads here, children, and what ends here: a sum, a least value, a second sum, and marks."""

    __slots__ = ("prefix", "kids", "count", "least", "tail", "marks")

    def __init__(self, prefix: bytes):
        self.prefix, self.kids = prefix, Sorted()
        self.count, self.least, self.tail, self.marks = 0, None, 0, []


class Tree:
    def __init__(self):
        self.root = Node(b"")

    def place(self, key: bytes) -> Node:
        """The node at which `key` ends, made if it is new."""
        node, parent, edge, at = self.root, None, 0, 0
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, at):
                same = len(os.path.commonprefix((prefix, key[at : at + len(prefix)])))
                above = Node(prefix[:same])
                above.kids.put(prefix[same], node)
                node.prefix = prefix[same + 1 :]
                if parent is None:
                    self.root = above
                else:
                    parent.kids = parent.kids.put(edge, above)
                node, prefix = above, above.prefix
            at += len(prefix)
            if at == len(key):
                return node
            kid = node.kids.find(key[at])
            if kid is None:
                kid = Node(key[at + 1 :])
                node.kids = node.kids.put(key[at], kid)
                return kid
            parent, edge, node, at = node, key[at], kid, at + 1

    def add(self, key: bytes, count: int, least: int, tail: int, mark: int | None = None) -> None:
        node = self.place(key)
        node.count += count
        node.tail += tail
        node.least = least if node.least is None else min(node.least, least)
        if mark is not None:
            node.marks.append(mark)

    def nodes(self) -> Iterator[tuple[bytes, Node | None, int, int, int]]:
        """The trie's nodes, children first: (path, the node if keys may end there, count, least, tail) over all keys through it."""
        stack: list = [(self.root, self.root.prefix, 0, None)]
        sums: dict[int, list] = {}
        while stack:
            node, path, above, kids = stack.pop()
            if kids is None:
                stack.append((node, path, above, True))
                sums[id(node)] = [node.count, node.least, node.tail]
                stack += [(kid, path + bytes((b,)) + kid.prefix, len(path), None) for b, kid in node.kids.items()]
                continue
            own = sums[id(node)]
            for _, kid in node.kids.items():
                count, least, tail = sums.pop(id(kid))
                own[0] += count
                own[1] = least if own[1] is None else own[1] if least is None else min(own[1], least)
                own[2] += tail
            # From the last whole part of the path up to, not including, the end of the path above.
            for end in range(len(path) - len(path) % WIDTH, above, -WIDTH):
                # What the caller adds to the tail at this depth goes on upwards.
                own[2] += (yield path[:end], node if end == len(path) else None, *own) or 0
            if node is self.root:
                yield b"", node if not path else None, *own
