"""An adaptive radix tree over byte strings, with sums for every key-aligned depth.

Inner nodes grow with their number of children through four layouts: sorted arrays of up to 4 and up to 16 key bytes, an
index of 256 bytes over up to 48 children, and a plain table of 256. A path without branches is one node with a prefix.
Keys may be prefixes of each other as long as their lengths are multiples of one width.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator


class Node:
    """A path (after the byte that leads here), the key that ends behind it, if any, and no children yet."""

    __slots__ = ("prefix", "row")
    room = 0

    def __init__(self, prefix: bytes, row: int | None = None):
        self.prefix = prefix
        self.row = row

    def child(self, byte: int) -> Node | None:
        return None

    def children(self) -> Iterator[Node]:
        return iter(())

    def full(self) -> bool:
        return True

    def put(self, byte: int, child: Node) -> None:
        raise IndexError("no room")

    def items(self) -> Iterator[tuple[int, Node]]:
        return iter(())

    def grown(self) -> Node:
        """The same node in the next larger layout."""
        larger = GROWS[type(self)](self.prefix, self.row)
        for byte, child in self.items():
            larger.put(byte, child)
        return larger


class Node4(Node):
    """Key bytes in order beside their children."""

    __slots__ = ("bytes", "held")
    room = 4

    def __init__(self, prefix: bytes, row: int | None = None):
        super().__init__(prefix, row)
        self.bytes = bytearray()
        self.held: list[Node] = []

    def child(self, byte: int) -> Node | None:
        at = self.bytes.find(byte)
        return self.held[at] if at >= 0 else None

    def children(self) -> Iterator[Node]:
        return iter(self.held)

    def items(self) -> Iterator[tuple[int, Node]]:
        return zip(self.bytes, self.held, strict=True)

    def full(self) -> bool:
        return len(self.held) >= self.room

    def put(self, byte: int, child: Node) -> None:
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.held[at] = child
        else:
            self.bytes.insert(at, byte)
            self.held.insert(at, child)


class Node16(Node4):
    __slots__ = ()
    room = 16


class Node48(Node):
    """For each byte the number of its child, from 1; 0 for none."""

    __slots__ = ("index", "held")
    room = 48

    def __init__(self, prefix: bytes, row: int | None = None):
        super().__init__(prefix, row)
        self.index = bytearray(256)
        self.held: list[Node] = []

    def child(self, byte: int) -> Node | None:
        at = self.index[byte]
        return self.held[at - 1] if at else None

    def children(self) -> Iterator[Node]:
        return (child for _, child in self.items())

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, self.held[at - 1]) for byte, at in enumerate(self.index) if at)

    def full(self) -> bool:
        return len(self.held) >= self.room

    def put(self, byte: int, child: Node) -> None:
        at = self.index[byte]
        if at:
            self.held[at - 1] = child
        else:
            self.held.append(child)
            self.index[byte] = len(self.held)


class Node256(Node):
    __slots__ = ("table",)
    room = 256

    def __init__(self, prefix: bytes, row: int | None = None):
        super().__init__(prefix, row)
        self.table: list[Node | None] = [None] * 256

    def child(self, byte: int) -> Node | None:
        return self.table[byte]

    def children(self) -> Iterator[Node]:
        return (child for child in self.table if child is not None)

    def items(self) -> Iterator[tuple[int, Node]]:
        return ((byte, child) for byte, child in enumerate(self.table) if child is not None)

    def full(self) -> bool:
        return False

    def put(self, byte: int, child: Node) -> None:
        self.table[byte] = child


GROWS = {Node: Node4, Node4: Node16, Node16: Node48, Node48: Node256}


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


class RadixTree:
    """Distinct keys, each with the number of a row."""

    def __init__(self) -> None:
        self.root: Node = Node4(b"")

    def insert(self, key: bytes, row: int) -> None:
        above: Node | None = None
        byte = at = 0
        node = self.root
        while True:
            rest = key[at:]
            same = _common(node.prefix, rest)
            if same < len(node.prefix):  # the path parts within this node
                fork = Node4(node.prefix[:same])
                fork.put(node.prefix[same], node)
                node.prefix = node.prefix[same + 1 :]
                if same == len(rest):
                    fork.row = row
                else:
                    fork.put(rest[same], Node(rest[same + 1 :], row))
                self._replace(above, byte, fork)
                return
            at += same
            if at == len(key):
                node.row = row
                return
            below = node.child(key[at])
            if below is None:
                if node.full():
                    node = node.grown()
                    self._replace(above, byte, node)
                node.put(key[at], Node(key[at + 1 :], row))
                return
            above, byte, node = node, key[at], below
            at += 1

    def _replace(self, above: Node | None, byte: int, node: Node) -> None:
        if above is None:
            self.root = node
        else:
            above.put(byte, node)

    def walk(self) -> Iterator[tuple[Node, int, int]]:
        """(node, depth where its path begins, depth where it ends), every node after its children.

        The byte that leads to a node counts as part of its path.
        """
        stack = [(self.root, 0, len(self.root.prefix), False)]
        while stack:
            node, start, end, seen = stack.pop()
            if seen:
                yield node, start, end
                continue
            stack.append((node, start, end, True))
            stack += [(child, end, end + 1 + len(child.prefix), False) for child in node.children()]
