"""Interval (B-/I-) markable annotation: one word a line with @-separated markables, minimum cores and referring tags."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, columns of the lines of all *.CONLL files under a path, headers left out; files are read in splits."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.CONLL").text(path)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("k")).alias("n"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"))
    return rows.where((F.col("line") != "") & ~F.col("line").startswith("TOKEN")).select("file", "n", F.split("line", r"\s+").alias("c"))


def markables(lines: DataFrame) -> DataFrame:
    """doc, markable, cluster, start, end, lo, hi, referring: word extents, minimum core (the extent where none is given) and tag.

    Columns are parted by white space: word, markables, cores (of four columns or more), and tags in the last column (of three or
    more).  Cores and tags count only where there are as many as markables.  The line that begins a markable gives its cluster, core and
    tag; later lines only extend it.  A cluster is referring or not as its first markable says.
    """
    at = F.row_number().over(W.partitionBy("file").orderBy("n")) - 1
    size = F.size("c")
    none = F.array().cast("array<string>")
    words = lines.select(
        F.col("file").alias("doc"),
        at.alias("word"),
        F.when(size > 1, F.split(F.get("c", F.lit(1)), "@")).otherwise(none).alias("m"),
        F.when(size >= 4, F.split(F.get("c", F.lit(2)), "@")).otherwise(none).alias("core"),
        F.when(size >= 3, F.split(F.element_at("c", -1), "@")).otherwise(none).alias("tag"),
    )
    given = lambda c: F.when(F.size(c) == F.size("m"), F.get(c, F.col("k")))
    each = words.select("doc", "word", "m", "core", "tag", F.posexplode("m").alias("k", "mark")).select("doc", "word", "k", "mark", given("core").alias("core"), given("tag").alias("tag"))
    each = each.where("mark rlike '^[BI]-markable_[0-9]+=.{4}'").withColumns({"markable": F.regexp_extract("mark", "_([0-9]+)=", 1).cast("long"), "begins": F.col("mark").startswith("B-")})
    low, high = (F.when(F.col("core").rlike(r), F.regexp_extract("core", r, 1).cast("long") - 1) for r in (r"word_(\d+)", r"\.\.word_(\d+)"))
    head = F.struct("word", F.regexp_extract("mark", "=.{4}(.*)$", 1).alias("cluster"), low.alias("lo"), F.coalesce(high, low).alias("hi"), F.coalesce(F.col("tag") == "non_referring", F.lit(False)).alias("non"), "k")
    out = each.groupBy("doc", "markable").agg(F.max_by(F.when(F.col("begins"), head), F.when(F.col("begins"), F.struct("word", "k"))).alias("b"), F.min(F.when(F.col("begins"), F.struct("word", "k"))).alias("seen"), F.max("word").alias("end"))
    out = out.where("b is not null")
    first = F.first("b.non").over(W.partitionBy("doc", "b.cluster").orderBy("seen"))
    return out.select("doc", "markable", F.col("b.cluster").alias("cluster"), F.col("b.word").alias("start"), "end", F.coalesce("b.lo", "b.word").alias("lo"), F.coalesce("b.hi", "end").alias("hi"), (~first).alias("referring"))


def split_referring(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(referring markables, first markable of each non-referring cluster)."""
    first = F.row_number().over(W.partitionBy("doc", "cluster").orderBy("start", "end"))
    return marks.where("referring"), marks.where("not referring").withColumn("_k", first).where("_k = 1").drop("_k")
