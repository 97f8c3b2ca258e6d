"""``match``: filter, index, order, engine; counts, embeddings, distribution, reports, limits and spectrum analysis."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmatch.model import DataGraph, QueryGraph
from sparkmatch.operators import engines, filters
from sparkmatch.operators.index import Index, build
from sparkmatch.operators.steps import Step, col, steps
from sparkmatch.plans import order as orders
from sparkmatch.plans import symmetry
from sparkmatch.store import Store

#: Shares of the root candidates, in sixty-fourths, that a limited run takes one after the other.
BATCHES = (1, 4, 16, 64)


@dataclass
class Plan:
    """A prepared match.  Nothing has run yet but what the planner had to count."""

    index: Index
    order: list[int]
    constraints: list[tuple[int, int]]
    filter: str
    order_name: str
    engine: str
    store: Store | None = None

    def close(self) -> None:
        """Deletes the stored candidates and index; nothing of the plan can run after that."""
        if self.store:
            self.store.clear()

    @property
    def steps(self) -> list[Step]:
        return steps(self.index.candidates.query, self.order, self.constraints)

    def embeddings(self) -> DataFrame:
        """(u0, u1, ...), one row an embedding; engines that only count are answered by ``lftj``."""
        return engines.ENUMERATORS.get(self.engine, engines.lftj)(self.index, self.steps)

    def count(self) -> DataFrame:
        """(n_embeddings), one row."""
        if self.engine in engines.COUNTERS:
            return engines.COUNTERS[self.engine](self.index, self.steps)
        if self.engine == "explore":
            return engines.explore_count(self.index, self.steps, self.store)
        return self.embeddings().agg(F.count("*").alias("n_embeddings"))

    def _shares(self):
        """The plan over growing shares of the root candidates, the whole at last."""
        c, root = self.index.candidates, self.order[0]
        share = F.pmod(F.xxhash64("v"), F.lit(64))
        for part in BATCHES[:-1]:
            yield replace(self, index=_restricted(self.index, root, {**c.of, root: c.of[root].where(share < part)}))
        yield self

    def limited(self, limit: int) -> DataFrame:
        """At most ``limit`` embeddings, by the plan's engine.  Roots are taken in growing shares until there are enough."""
        for some in self._shares():
            out = some.embeddings().limit(limit)
            if some is self or out.count() >= limit:
                return out
        raise AssertionError

    def count_up_to(self, limit: int) -> int:
        """The least of ``limit`` and the number of embeddings, by the plan's engine, counting or enumerating."""
        for some in self._shares():
            n = some.count().first()[0] if self.engine in engines.COUNTERS else some.embeddings().limit(limit).count()
            if some is self or n >= limit:
                return min(n, limit)
        raise AssertionError

    def distribution(self) -> DataFrame:
        """(v, n): for each data vertex the number of embeddings that hold it."""
        n = len(self.index.candidates.query)
        at = F.explode(F.array(*[col(u) for u in range(n)])).alias("v")
        return self.embeddings().select(at).groupBy("v").agg(F.count("*").alias("n"))

    def level_counts(self) -> DataFrame:
        """(level, n): partial embeddings after each step of the order, what a search would call its extensions."""
        c, parts = self.index.candidates, []
        for k in range(1, len(self.order) + 1):
            inside = self.order[:k]
            names = {u: i for i, u in enumerate(inside)}
            q = QueryGraph.of([c.query.labels[u] for u in inside], [(names[u], names[w], x) if x is not None else (names[u], names[w]) for (u, w), x in c.query.edges.items() if u in names and w in names])
            sub = Index(filters.Candidates(q, c.graph, {names[u]: c.of[u] for u in inside}), {(min(names[u], names[w]), max(names[u], names[w])): self.index.edges(*((u, w) if names[u] < names[w] else (w, u))) for u, w in c.query.edges if u in names and w in names})
            less = [(names[a], names[b]) for a, b in self.constraints if a in names and b in names]
            parts.append(engines.lftj(sub, steps(q, list(range(k)), less)).agg(F.count("*").alias("n")).select(F.lit(k).alias("level"), "n"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out

    def to_json(self) -> str:
        return json.dumps({"filter": self.filter, "order": self.order_name, "engine": self.engine, "steps": [asdict(s) for s in self.steps]})

    @staticmethod
    def order_from_json(text: str) -> list[int]:
        return [s["u"] for s in json.loads(text)["steps"]]

    @staticmethod
    def from_json(text: str, graph: DataGraph, query: QueryGraph, store: Store | None = None) -> Plan:
        """The same filter, order, engine and constraints for a graph and query; candidates and index are built anew."""
        told = json.loads(text)
        plan = prepare(graph, query, filter=told["filter"], order=[s["u"] for s in told["steps"]], engine=told["engine"], store=store)
        constraints = [tuple(c) for s in told["steps"] for c in s["less"]]
        return replace(plan, constraints=constraints, order_name=told["order"])


def _restricted(index: Index, root: int, of: dict[int, DataFrame]) -> Index:
    c = index.candidates
    return Index(filters.Candidates(c.query, c.graph, of), index.of, index)


def prepare(
    graph: DataGraph, query: QueryGraph, *, filter: str = "nlf", order: str | list[int] = "gql", engine: str = "lftj",
    symmetry_breaking: bool = False, root: int | None = None, store: Store | None = None,
) -> Plan:
    """Filters, indexes and orders.

    A given list as ``order`` spares the statistics job.  Candidates and index are written to ``store``, or to a store
    of the plan's own, since every engine reads them often; with the ``label`` filter there is nothing to write.
    ``Plan.close`` deletes what was written.
    """
    if engine not in engines.ENGINES:
        raise ValueError(f"no engine {engine!r}; there are {', '.join(engines.ENGINES)}")
    store = store or Store(graph.vertices.sparkSession, "plan")
    if filter == "label":
        c = filters.label(graph, query)
        index = build(c)
    else:
        edges = store.inner("edges")
        c = filters.make(filter, filters.narrowed(graph, query, store, edges), query, store, root).stored(store)
        spent = engine not in engines.READ_GRAPH and bool(edges.paths)  # what is read from now on is the index
        index = build(c, store, edges if spent else None)
        if spent:
            c.graph = index.graph()
            edges.clear()
    if isinstance(order, str):
        name, chosen = order, orders.make(order, query, index.stats(paths=order in ("tso", "cfl")) if order != "ri" else orders.Stats({}, {}))
    else:
        name, chosen = "given", orders.check(query, list(order))
    return Plan(index, chosen, symmetry.constraints(query) if symmetry_breaking else [], filter, name, engine, store)


@dataclass
class MatchReport:
    query: str
    data: str
    filter: str
    order: str
    engine: str
    load_s: float
    filter_s: float
    build_s: float
    plan_s: float
    enumerate_s: float
    preprocess_s: float
    total_s: float
    embeddings: int
    calls: int | None = None
    memory_mb: float = 0.0

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], "query string, data string, filter string, order string, engine string, load_s double, filter_s double, build_s double, plan_s double, enumerate_s double, preprocess_s double, total_s double, embeddings long, calls long, memory_mb double")

    def append_csv(self, spark, path: str) -> None:
        self.frame(spark).coalesce(1).write.mode("append").option("header", True).csv(path)

    def lines(self) -> str:
        rate = self.embeddings / self.enumerate_s if self.enumerate_s else 0.0
        per = self.enumerate_s * 1e9 / self.calls if self.calls else 0.0
        rows = [("load", self.load_s), ("filter", self.filter_s), ("build index", self.build_s), ("plan", self.plan_s), ("enumerate", self.enumerate_s), ("preprocess", self.preprocess_s), ("total", self.total_s)]
        return "\n".join([*(f"{k} seconds: {v:.4f}" for k, v in rows), f"embeddings: {self.embeddings}", f"calls: {self.calls}", f"memory MB: {self.memory_mb:.1f}", f"ns per call: {per:.1f}", f"embeddings per second: {rate:.1f}"])


def _memory_mb(spark) -> float:
    """Heap that the driver holds, and memory that the executors' stored blocks fill."""
    run = spark._jvm.java.lang.Runtime.getRuntime()
    status = spark._jsc.sc().getExecutorMemoryStatus().values().iterator()
    blocks = 0
    while status.hasNext():
        pair = status.next()
        blocks += pair._1() - pair._2()
    return (run.totalMemory() - run.freeMemory() + blocks) / 1e6


def match(
    graph: DataGraph, query: QueryGraph, *, filter: str = "nlf", order: str | list[int] = "gql", engine: str = "lftj", symmetry_breaking: bool = False,
    limit: int | None = None, count_calls: bool = False, root: int | None = None, names: tuple[str, str] = ("query", "data"),
) -> MatchReport:
    """Runs a query step by step and reports times and counts.  With a limit the count is min(total, limit)."""
    spark = graph.vertices.sparkSession
    if engine not in engines.ENGINES:
        raise ValueError(f"no engine {engine!r}; there are {', '.join(engines.ENGINES)}")
    store, t0 = Store(spark, "match"), time.perf_counter()
    graph = DataGraph(store.put(graph.vertices), store.put(graph.edges))
    t1 = time.perf_counter()
    c = filters.make(filter, graph, query, store, root).stored(store)
    t2 = time.perf_counter()
    index = build(c, store)
    t3 = time.perf_counter()
    chosen = orders.make(order, query, index.stats(paths=order in ("tso", "cfl"))) if isinstance(order, str) else orders.check(query, list(order))
    plan = Plan(index, chosen, symmetry.constraints(query) if symmetry_breaking else [], filter, order if isinstance(order, str) else "given", engine)
    t4 = time.perf_counter()
    n = plan.count_up_to(limit) if limit is not None else plan.count().first()[0]
    t5 = time.perf_counter()
    calls = sum(r.n for r in plan.level_counts().collect()) if count_calls else None
    store.clear()
    return MatchReport(names[0], names[1], filter, plan.order_name, engine, t1 - t0, t2 - t1, t3 - t2, t4 - t3, t5 - t4, t4 - t1, t5 - t0, n, calls, _memory_mb(spark))


def spectrum(graph: DataGraph, query: QueryGraph, *, orders_most: int = 100, time_limit: float = 60.0, filter: str = "nlf", engine: str = "lftj", symmetry_breaking: bool = False, on_result: Callable | None = None) -> list[tuple[list[int], int | None, float]]:
    """(order, embeddings, seconds) for each connected order; None where the time limit cancelled the run."""
    spark = graph.vertices.sparkSession
    store = Store(spark, "spectrum")
    index = build(filters.make(filter, graph, query, store).stored(store), store)
    less = symmetry.constraints(query) if symmetry_breaking else []
    out = []
    for k, order in enumerate(orders.spectrum(query, orders_most)):
        tag, began = f"{store.base}-{k}", time.perf_counter()
        timer = threading.Timer(time_limit, lambda t=tag: spark.interruptTag(t))
        spark.addTag(tag)
        timer.start()
        try:
            n = Plan(index, order, less, filter, "spectrum", engine).count().first()[0]
        except Exception:
            if timer.is_alive():  # no cancellation: a failure of its own
                raise
            n = None
        finally:
            timer.cancel()
            spark.removeTag(tag)
        out.append((order, n, time.perf_counter() - began))
        if on_result:
            on_result(*out[-1])
    store.clear()
    return out
