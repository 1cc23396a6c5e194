"""Small unlabelled patterns and what can be said about them on the driver."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from itertools import combinations, permutations

#: Patterns that mining accepts.
SMALLEST, LARGEST = 3, 5


@dataclass(frozen=True)
class Pattern:
    """A simple graph on the vertices 0 .. size - 1; edges are unordered pairs. Equality is of the drawn graph, not up
    to isomorphism."""

    size: int
    edges: frozenset[tuple[int, int]] = frozenset()
    labels: tuple[int | None, ...] | None = None

    @staticmethod
    def of(size: int, edges: Iterable[tuple[int, int]], labels: Iterable[int | None] | None = None) -> Pattern:
        """labels: one for each vertex, None where any will do."""
        found = frozenset((min(e), max(e)) for e in edges)
        if any(a == b or a < 0 or b >= size for a, b in found):
            raise ValueError(f"edges must join two of {size} vertices: {sorted(found)}")
        labels = None if labels is None else tuple(labels)
        if labels is not None and len(labels) != size:
            raise ValueError(f"{len(labels)} labels for {size} vertices")
        return Pattern(size, found, labels)

    def label(self, v: int) -> int | None:
        return self.labels[v] if self.labels else None

    def has_edge(self, a: int, b: int) -> bool:
        return (min(a, b), max(a, b)) in self.edges

    def add_edge(self, a: int, b: int) -> Pattern:
        return Pattern.of(self.size, [*self.edges, (a, b)], self.labels)

    def clear_edges(self) -> Pattern:
        return Pattern(self.size, labels=self.labels)

    def neighbours(self, v: int) -> set[int]:
        return {a + b - v for a, b in self.edges if v in (a, b)}

    def is_connected(self) -> bool:
        seen, todo = set(), [0] if self.size else []
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += self.neighbours(v)
        return len(seen) == self.size

    def is_clique(self) -> bool:
        return len(self.edges) == self.size * (self.size - 1) // 2

    def is_cycle(self) -> bool:
        """A connected pattern of four or more vertices that all have two neighbours; a triangle counts as a clique only."""
        return self.size >= 4 and self.is_connected() and all(len(self.neighbours(v)) == 2 for v in range(self.size))

    def automorphisms(self) -> list[tuple[int, ...]]:
        return [p for p in permutations(range(self.size)) if all(self.has_edge(p[a], p[b]) for a, b in self.edges) and all(self.label(p[v]) == self.label(v) for v in range(self.size))]

    def multiplicity(self) -> int:
        """How often an unrestricted search meets each match."""
        return len(self.automorphisms())

    def __str__(self) -> str:
        return f"Pattern: (size:{self.size}, num_edges:{len(self.edges)})" + "".join(f" ({a}, {b})" for a, b in sorted(self.edges))


def clique(k: int) -> Pattern:
    return Pattern.of(k, combinations(range(k), 2))


def cycle(k: int) -> Pattern:
    return Pattern.of(k, [(i, (i + 1) % k) for i in range(k)])


def chain(k: int) -> Pattern:
    return Pattern.of(k, [(i, i + 1) for i in range(k - 1)])


def star(leaves: int) -> Pattern:
    return Pattern.of(leaves + 1, [(0, i) for i in range(1, leaves + 1)])


TRIANGLE, WEDGE = clique(3), star(2)
