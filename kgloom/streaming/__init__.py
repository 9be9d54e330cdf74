"""Incremental loading of triples with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import SparkSession

from kgloom.sources.rdf import parse_lines


def load_continuously(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Append the triples of new N-Triples files in a folder to a Parquet table; each batch is free of repeats.

    Returns the started query (one micro-batch run over what is there; start it again for more).
    """

    def write(batch, number: int) -> None:
        batch.distinct().withColumn("_batch", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(number)).write.mode("append").partitionBy("_batch").parquet(target)

    lines = spark.readStream.schema("value string").text(source)
    return parse_lines(lines).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
