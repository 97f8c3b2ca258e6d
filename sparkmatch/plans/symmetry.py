"""Automorphisms of a query, and the order constraints that leave one embedding of each class of equivalent ones."""

from __future__ import annotations

from sparkmatch.model import QueryGraph


def equitable_partition(query: QueryGraph) -> list[int]:
    """Colour of each vertex: labels, refined by the colours over edges of each label around, until nothing changes."""
    colour = list(query.labels)
    while True:
        signs = [(colour[u], tuple(sorted((str(query.edge_label(u, w)), colour[w]) for w in query.adjacent[u]))) for u in range(len(query))]
        index = {s: i for i, s in enumerate(sorted(set(signs)))}
        new = [index[s] for s in signs]
        if len(index) == len(set(colour)):
            return new
        colour = new


def _extend(query: QueryGraph, colour: list[int], image: dict[int, int]) -> dict[int, int] | None:
    """An automorphism that continues the partial one, if there is any."""
    if len(image) == len(query):
        return image
    # the next vertex beside those mapped, which has the fewest choices left
    beside = [u for u in range(len(query)) if u not in image and any(w in image for w in query.adjacent[u])] or [u for u in range(len(query)) if u not in image]
    u = max(beside, key=lambda x: (sum(w in image for w in query.adjacent[x]), -x))
    used = set(image.values())
    for v in range(len(query)):
        if v in used or colour[v] != colour[u]:
            continue
        if all(query.has_edge(v, image[w]) == query.has_edge(u, w) and (not query.has_edge(u, w) or query.edge_label(v, image[w]) == query.edge_label(u, w)) for w in image):
            if (got := _extend(query, colour, image | {u: v})) is not None:
                return got
    return None


def stabiliser_orbits(query: QueryGraph) -> list[list[int]]:
    """For each u its orbit under the automorphisms that fix 0 .. u - 1; the product of the sizes is the group's order."""
    colour, out = equitable_partition(query), []
    fixed: dict[int, int] = {}
    for u in range(len(query)):
        orbit = [u]
        for v in range(u + 1, len(query)):
            if colour[v] == colour[u] and _consistent(query, fixed, u, v) and _extend(query, colour, fixed | {u: v}) is not None:
                orbit.append(v)
        out.append(orbit)
        fixed = fixed | {u: u}
    return out


def _consistent(query: QueryGraph, image: dict[int, int], u: int, v: int) -> bool:
    return all(query.has_edge(v, image[w]) == query.has_edge(u, w) and (not query.has_edge(u, w) or query.edge_label(v, image[w]) == query.edge_label(u, w)) for w in image)


def automorphism_count(query: QueryGraph) -> int:
    n = 1
    for orbit in stabiliser_orbits(query):
        n *= len(orbit)
    return n


def constraints(query: QueryGraph) -> list[tuple[int, int]]:
    """Pairs (u, v): the image of u is less than that of v.  Just one of each class of equivalent embeddings meets all."""
    return [(u, v) for u, orbit in enumerate(stabiliser_orbits(query)) for v in orbit if v != u]


def by_step(pairs: list[tuple[int, int]], order: list[int]) -> dict[int, list[tuple[int, int]]]:
    """Each constraint at the vertex of the order that is bound later."""
    at = {u: i for i, u in enumerate(order)}
    out: dict[int, list[tuple[int, int]]] = {u: [] for u in order}
    for u, v in pairs:
        out[max(u, v, key=at.__getitem__)].append((u, v))
    return out
