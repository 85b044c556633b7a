"""Survivor-coalescence Viterbi: the cheapest path through a few states, emitted while it is being found.

Each state keeps its best path so far, a leaf of a tree of back pointers.  Nodes
count their references (children, and states that end there); one that nobody
refers to is released with the ancestors that only it kept.  When the root has a
single child and no state ends at it, all survivors share that child: its label
is final, is emitted, and the child becomes the root.  So only the unresolved
part of the paths is in memory.

Paths of equal cost are compared by the text of their labels from their common
ancestor to their ends, the whole unresolved suffix.
"""

from __future__ import annotations

from collections.abc import Iterable


class Node:
    __slots__ = ("parent", "label", "payload", "refs", "depth")

    def __init__(self, parent: Node | None, label: str, payload):
        self.parent, self.label, self.payload, self.refs = parent, label, payload, 0
        self.depth = parent.depth + 1 if parent else 0


def suffixes(a: Node, b: Node) -> tuple[str, str]:
    """Label texts from the common ancestor of two nodes to each of them."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.label)
            a = a.parent
        else:
            right.append(b.label)
            b = b.parent
    return "".join(reversed(left)), "".join(reversed(right))


class Survivors:
    """The best path to each of ``states``; a missing state cannot be reached or cannot win any more."""

    def __init__(self, start: int):
        self.root = Node(None, "", None)
        self.at: dict[int, tuple[int, Node]] = {}
        self.made = 0
        self.next_flush = 64
        self.emitted: list = []
        self._put({start: (0, self.root)})

    def _put(self, new: dict[int, tuple[int, Node]]) -> None:
        for _, node in new.values():
            while True:  # a new node refers to its parent from its first reference on
                node.refs += 1
                if node.refs > 1 or node.parent is None:
                    break
                node = node.parent
        old, self.at = self.at, new
        for _, node in old.values():
            node.refs -= 1
            while node.refs == 0 and node.parent is not None:
                node = node.parent
                node.refs -= 1

    def better(self, cost: int, node: Node, than: tuple[int, Node] | None) -> bool:
        if than is None or cost != than[0]:
            return than is None or cost < than[0]
        left, right = suffixes(node, than[1])
        return left < right

    def advance(self, moves: Iterable[tuple], free: Iterable[tuple] = (), dominated=None) -> None:
        """One step.  ``moves`` are (from, to, cost, label, payload); ``free`` ones may follow, again and again, without a step."""
        new: dict[int, tuple[int, Node]] = {}
        for source, target, cost, label, payload in moves:
            held = self.at.get(source)
            if held is not None:
                self._offer(new, held, target, cost, label, payload)
        self._relax(new, free)
        if dominated:
            for state in dominated(new):
                del new[state]
        self._put(new)
        self.made += 1
        if self.made >= self.next_flush:
            self.flush()
            self.next_flush = self.made + 2 * max(32, max(n.depth for _, n in self.at.values()) - self.root.depth)

    def settle(self, free: Iterable[tuple]) -> None:
        """Take ``free`` moves before the first step."""
        new = dict(self.at)
        self._relax(new, free)
        self._put(new)

    def _relax(self, new: dict, free: Iterable[tuple]) -> None:
        changed = True
        while changed:
            changed = False
            for source, target, cost, label in free:
                held = new.get(source)
                if held is not None and self._offer(new, held, target, cost, label, None):
                    changed = True

    def _offer(self, new: dict, held: tuple[int, Node], target: int, cost: int, label: str, payload) -> bool:
        there, total = new.get(target), held[0] + cost
        if there is not None and total > there[0]:
            return False
        node = Node(held[1], label, payload)
        if there is not None and not self.better(total, node, there):
            return False
        new[target] = (total, node)
        return True

    def flush(self) -> None:
        """Emit what all survivors share."""
        chain, node = [], next(iter(self.at.values()))[1]
        while node is not self.root:
            chain.append(node)
            node = node.parent
        while chain and self.root.refs == 1:
            child = chain.pop()
            self.emitted.append((child.label, child.payload))
            child.parent, self.root = None, child

    def best(self, states: Iterable[int]) -> int:
        """The state among ``states`` with the cheapest path, the least text among equals."""
        chosen = None
        for s in states:
            if s in self.at and (chosen is None or self.better(*self.at[s], self.at[chosen])):
                chosen = s
        return chosen

    def path(self, state: int) -> list:
        """All (label, payload) of the path to ``state``, the emitted ones first."""
        out, node = [], self.at[state][1]
        while node is not self.root:
            out.append((node.label, node.payload))
            node = node.parent
        return self.emitted + out[::-1]

    def unresolved(self) -> int:
        """Length of the longest path that is not emitted."""
        return max(n.depth for _, n in self.at.values()) - self.root.depth
