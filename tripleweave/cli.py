"""Command line: ``python -m tripleweave build | query | server``."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from tripleweave.engine import Engine
from tripleweave.errors import ParseError, QueryError
from tripleweave.server import server
from tripleweave.sinks import tab_separated
from tripleweave.sources.ntriples import ntriples, queries_in
from tripleweave.sources.store import Store


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tripleweave", description="Graph-pattern queries on Spark.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("build", "make a store from a triple file"), ("query", "run the queries of a file, one a line"), ("server", "answer queries over HTTP")):
        c = commands.add_parser(name, help=what)
        c.add_argument("-d", "--database", required=True, help="the store's folder")
        if name != "server":
            c.add_argument("-f", "--file", required=True)
        if name == "build":
            c.add_argument("--encode", action="store_true", help="also store ids")
        else:
            c.add_argument("--strict", action="store_true", help="the grammar without extensions")
        if name == "query":
            c.add_argument("-t", "--thread", type=int, help="accepted; Spark decides")
        if name == "server":
            c.add_argument("--ip", default="0.0.0.0")
            c.add_argument("-p", "--port", type=int, default=8080)
    return top


def build(spark: SparkSession, database: str, file: str, encode: bool, out=sys.stdout) -> Store:
    began = time.perf_counter()
    loaded = ntriples(spark, file)
    store = Store.build(spark, loaded.triples, database, encode)
    print(f"{store.meta.n_triples} triples, {store.meta.n_predicates} predicates; {loaded.malformed.count()} malformed lines", file=out)
    print(f"built in {1000 * (time.perf_counter() - began):.0f} ms", file=out)
    return store


def query(spark: SparkSession, database: str, file: str, strict: bool = False, out=sys.stdout) -> int:
    """Runs all queries; an error is printed and the next one runs. Returns how many failed."""
    engine, failed = Engine(Store.open(spark, database), strict), 0
    for text in queries_in(file):
        print(text, file=out)
        try:
            t0 = time.perf_counter()
            df = engine.sparql(text)
            t1 = time.perf_counter()
            n = -1
            for n, line in enumerate(tab_separated(df)):  # noqa: B007
                print(line, file=out)
            t2 = time.perf_counter()
            print(f"{n} result(s).\nplan {1000 * (t1 - t0):.1f} ms, execute and print {1000 * (t2 - t1):.1f} ms, total {1000 * (t2 - t0):.1f} ms\n", file=out)
        except (ParseError, QueryError) as e:
            failed += 1
            print(f"error: {e}\n", file=out)
    return failed


def main(given: list[str] | None = None) -> int:
    a = arguments().parse_args(given)
    spark = SparkSession.builder.appName("tripleweave").getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    if a.command == "build":
        build(spark, a.database, a.file, a.encode)
        return 0
    if a.command == "query":
        return int(query(spark, a.database, a.file, a.strict) > 0)
    http = server(Engine(Store.open(spark, a.database), a.strict), a.ip, a.port)
    print(f"listening on {a.ip}:{a.port}")
    http.serve_forever()
    return 0
