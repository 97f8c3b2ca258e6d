"""What every engine needs to know of each step of a matching order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkmatch.model import QueryGraph
from sparkmatch.plans import symmetry
from sparkmatch.plans.order import check


def col(u: int) -> str:
    return f"u{u}"


@dataclass(frozen=True)
class Step:
    u: int
    #: Neighbours bound before, the pivot first.
    near: tuple[int, ...]
    #: Vertices bound before that u could collide with: of its label, not adjacent, not kept apart by a constraint.
    differ: tuple[int, ...]
    #: Constraints (a, b), image of a less than that of b, that are complete with u.
    less: tuple[tuple[int, int], ...]

    def accepts(self, v: Column, bound=lambda w: F.col(col(w))) -> Column:
        """Whether v may be bound to u beside the vertices bound before."""
        at = lambda w: v if w == self.u else bound(w)
        out = F.lit(True)
        for w in self.differ:
            out = out & (v != bound(w))
        for a, b in self.less:
            out = out & (at(a) < at(b))
        return out


def steps(query: QueryGraph, order: list[int], constraints: list[tuple[int, int]]) -> list[Step]:
    check(query, order)
    when = symmetry.by_step(constraints, order)
    apart = {frozenset(x) for x in constraints}
    out = []
    for i, u in enumerate(order):
        near = tuple(w for w in order[:i] if query.has_edge(u, w))
        differ = tuple(w for w in order[:i] if query.labels[w] == query.labels[u] and w not in near and frozenset((u, w)) not in apart)
        out.append(Step(u, near, differ, tuple(when[u])))
    return out
