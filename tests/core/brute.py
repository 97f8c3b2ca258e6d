"""Brute force over small graphs held in Python."""

import random
from itertools import product

from sparkmatch.model import DataGraph, QueryGraph


def embeddings(labels, edges, query):
    """Sorted list of all embeddings; ``edges`` maps (a, b) with a < b to a label or None."""
    near = {}
    for (a, b), x in edges.items():
        near.setdefault(a, {})[b] = x
        near.setdefault(b, {})[a] = x
    out, n = [], len(query)

    def go(image):
        u = len(image)
        if u == n:
            out.append(tuple(image))
            return
        for v in range(len(labels)):
            if labels[v] != query.labels[u] or v in image:
                continue
            if all(image[w] in near.get(v, {}) and (query.edge_label(u, w) is None or near[v][image[w]] == query.edge_label(u, w)) for w in query.adjacent[u] if w < u):
                go([*image, v])

    go([])
    return sorted(out)


def automorphisms(query):
    edges = dict(query.edges)
    return embeddings(query.labels, edges, query)


def random_case(seed, n=14, p=0.35, n_labels=2, k=4, edge_labels=0):
    """(labels, edges, query): a random graph and a connected query of k vertices."""
    r = random.Random(seed)
    lab = lambda: r.randrange(edge_labels) if edge_labels else None
    labels = [r.randrange(n_labels) for _ in range(n)]
    edges = {(a, b): lab() for a, b in product(range(n), repeat=2) if a < b and r.random() < p}
    qedges = {(r.randrange(i), i): lab() for i in range(1, k)}
    for a, b in product(range(k), repeat=2):
        if a < b and r.random() < 0.4:
            qedges.setdefault((a, b), lab())
    query = QueryGraph.of([r.randrange(n_labels) for _ in range(k)], [(a, b, x) if x is not None else (a, b) for (a, b), x in qedges.items()])
    return labels, edges, query


def data_graph(spark, labels, edges):
    v = spark.createDataFrame(list(enumerate(labels)), "id long, label int")
    e = spark.createDataFrame([(a, b, x) for (a, b), x in edges.items()], "src long, dst long, elabel int")
    return DataGraph.of(v, e)
