"""New triple files are appended to a folder of triples as they arrive.

Each file is taken once (the checkpoint remembers them). Repeats stay: a graph is a set, and
``Store.build`` on the folder removes them, so the stream needs no state that grows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tripleweave.sources.ntriples import parsed


def start(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """once: takes what is there now and ends."""
    triples = parsed(spark.readStream.text(source)).triples
    writer = triples.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
