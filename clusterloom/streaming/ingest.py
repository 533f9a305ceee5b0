"""Streaming ingestion of extractions: the stateless text operators on a stream of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from clusterloom.functions.text import norm, parse_entities


def extractions(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of JSON-lines files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def entities(stream: DataFrame, output: str = "extraction") -> DataFrame:
    """One row for each bracketed entity with its normalised text; works on streams and tables alike."""
    keys = [c for c in stream.columns if c != output]
    rows = stream.select(*keys, F.posexplode(parse_entities(F.col(output))).alias("ord", "e"))
    return rows.select(*keys, "ord", "e.*", norm(F.col("e.text")).alias("norm"))
