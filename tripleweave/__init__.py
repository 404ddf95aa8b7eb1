"""A graph-pattern query engine on Spark: triples in, SPARQL basic graph patterns compiled to DataFrames.

    from tripleweave import Engine, Store
    store = Store.build(spark, ntriples(spark, "data.nt").triples, "warehouse/people")
    Engine(store).sparql("SELECT ?x WHERE { ?x <knows> <b> }").show()
"""

from tripleweave.engine import Engine
from tripleweave.errors import ParseError, QueryError
from tripleweave.sources.ntriples import ntriples
from tripleweave.sources.store import Store

__all__ = ["Engine", "ParseError", "QueryError", "Store", "ntriples"]
