"""Command line: ``python -m sparkmatch.cli -d DATA -q QUERY -filter CFL -order GQL -engine LFTJ -num 1000``.

``python -m sparkmatch.cli convert TEXT PREFIX`` writes a text graph as the three files of binary CSR.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from sparkmatch.operators.engines import ENGINES
from sparkmatch.operators.filters import FILTERS
from sparkmatch.plans.order import ORDERS
from sparkmatch.session import match, prepare, spectrum
from sparkmatch.sources.csr import convert, read_csr
from sparkmatch.sources.text import read_graph, read_query


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sparkmatch")
    p.add_argument("-d", required=True, help="data graph: text file, or common path of CSR files with -csr")
    p.add_argument("-q", required=True, help="query graph: local text file")
    p.add_argument("-filter", default="cfl", type=str.lower, choices=list(FILTERS))
    p.add_argument("-order", default="gql", type=str.lower, choices=list(ORDERS))
    p.add_argument("-engine", default="lftj", type=str.lower, choices=[*ENGINES, "spectrum"])
    p.add_argument("-num", default="MAX", help="most embeddings, or MAX")
    p.add_argument("-time_limit", default=60.0, type=float, help="seconds for each order of a spectrum")
    p.add_argument("-order_num", default=100, type=int, help="orders of a spectrum")
    p.add_argument("-dis_file", help="where to write the number of embeddings of each data vertex, as Parquet")
    p.add_argument("-csr", action="store_true")
    p.add_argument("-symmetry", default=0, type=int, choices=[0, 1])
    p.add_argument("-record", help="folder to append the run's record to, as CSV")
    return p


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["convert"]:
        convert(SparkSession.builder.appName("sparkmatch").getOrCreate(), *argv[1:])
        return
    o = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sparkmatch").getOrCreate()
    graph, query = (read_csr if o.csr else read_graph)(spark, o.d), read_query(o.q)
    if "spectrum" in (o.order, o.engine):
        for order, n, seconds in spectrum(graph, query, orders_most=o.order_num, time_limit=o.time_limit, filter=o.filter, symmetry_breaking=bool(o.symmetry)):
            print(order, "time limit" if n is None else n, f"{seconds:.3f}")
        return
    limit = None if o.num == "MAX" else int(o.num)
    report = match(graph, query, filter=o.filter, order=o.order, engine=o.engine, symmetry_breaking=bool(o.symmetry), limit=limit, names=(o.q, o.d))
    print(report.lines())
    if o.record:
        report.append_csv(spark, o.record)
    if o.dis_file:
        prepare(graph, query, filter=o.filter, order=o.order, symmetry_breaking=bool(o.symmetry)).distribution().write.mode("overwrite").parquet(o.dis_file)


if __name__ == "__main__":
    main()
