"""From a pattern to an extension plan.

A plan adds one pattern vertex after another. For each it says which earlier vertices must be neighbours, which must
not be (induced matching), which must merely differ, and which order restrictions hold. The restrictions pick one of
the automorphic images of each match: going through the vertices in plan order, a vertex must be smaller than all
others that the remaining automorphisms can put in its place; then only automorphisms that leave it in place remain.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from lacework.plans.pattern import LARGEST, SMALLEST, Pattern


@dataclass(frozen=True)
class Step:
    """Places count in plan order. above: the new id is larger than those there; below: smaller."""

    back: tuple[int, ...]
    anti: tuple[int, ...]
    apart: tuple[int, ...]
    above: tuple[int, ...]
    below: tuple[int, ...]


@dataclass(frozen=True)
class Plan:
    pattern: Pattern
    induced: bool
    order: tuple[int, ...]
    restrictions: frozenset[tuple[int, int]]
    steps: tuple[Step, ...]

    def lists_needed(self, place: int) -> bool:
        """Whether the neighbours of the vertex at this place are looked at by a later step."""
        return any(place in s.back or place in s.anti for s in self.steps[place:])


def restrictions(pattern: Pattern, order: tuple[int, ...]) -> frozenset[tuple[int, int]]:
    """Pairs (a, b) of pattern vertices: the id at a is smaller than the one at b."""
    group, out = pattern.automorphisms(), set()
    for v in order:
        out |= {(v, p[v]) for p in group if p[v] != v}
        group = [p for p in group if p[v] == v]
    return frozenset(out)


def matching_order(pattern: Pattern) -> tuple[int, ...]:
    """Every vertex after the first has an earlier neighbour; those with most come first, which keeps candidates few."""
    order = [max(range(pattern.size), key=lambda v: (len(pattern.neighbours(v)), -v))]
    while len(order) < pattern.size:
        rest = [v for v in range(pattern.size) if v not in order and pattern.neighbours(v) & set(order)]
        order.append(max(rest, key=lambda v: (len(pattern.neighbours(v) & set(order)), len(pattern.neighbours(v)), -v)))
    return tuple(order)


def compile_pattern(pattern: Pattern, induced: bool = False, order: tuple[int, ...] | None = None) -> Plan:
    if not SMALLEST <= pattern.size <= LARGEST:
        raise ValueError(f"patterns have {SMALLEST} to {LARGEST} vertices, not {pattern.size}")
    if not pattern.is_connected():
        raise ValueError(f"the pattern isn't connected: {pattern}")
    order = order or matching_order(pattern)
    if sorted(order) != list(range(pattern.size)):
        raise ValueError(f"not an order of the pattern's vertices: {order}")
    rules = restrictions(pattern, order)
    steps = []
    for k in range(1, pattern.size):
        v, before = order[k], range(k)
        back = tuple(i for i in before if pattern.has_edge(v, order[i]))
        if not back:
            raise ValueError(f"vertex {v} has no earlier neighbour in {order}")
        rest = tuple(i for i in before if i not in back)
        above = tuple(i for i in before if (order[i], v) in rules)
        below = tuple(i for i in before if (v, order[i]) in rules)
        steps.append(Step(back, rest if induced else (), tuple(i for i in rest if i not in above + below), above, below))
    return Plan(pattern, induced, order, rules, tuple(steps))


def breaks_symmetry(plan: Plan) -> bool:
    """Whether exactly one automorphic image of every assignment of distinct ids meets the restrictions."""
    group = plan.pattern.automorphisms()
    return all(sum(all(ids[p[a]] < ids[p[b]] for a, b in plan.restrictions) for p in group) == 1 for ids in permutations(range(plan.pattern.size)))
