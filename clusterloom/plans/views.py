"""Coreference inputs derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, idx, gold, sys, in_key, in_sys, part: one mention for each order line."""
    order = W.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("topic"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        (F.col("l_suppkey") % 3).alias("gold"),
        (F.col("l_partkey") % 3).alias("sys"),
        (F.col("l_returnflag") != "A").alias("in_key"),
        (F.col("l_returnflag") != "R").alias("in_sys"),
        F.col("l_partkey").alias("part"),
    )


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mentions without in_key and in_sys.

    Order lines of one part and supplier are alike in what is left, so the order needs no other columns and only these are shuffled.
    """
    order = W.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("topic"),
        (F.row_number().over(order) - 1).cast("long").alias("idx"),
        (F.col("l_suppkey") % 3).alias("gold"),
        (F.col("l_partkey") % 3).alias("sys"),
        F.col("l_partkey").alias("part"),
    )


def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, mention, key, sys: clusters of both sides, null where the side lacks the mention."""
    m = mentions(spark, sf_dir)
    return m.select(F.col("topic").alias("doc"), F.col("idx").alias("mention"), F.when(F.col("in_key"), F.col("gold")).alias("key"), F.when(F.col("in_sys"), F.col("sys")).alias("sys")).where("key is not null or sys is not null")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, i, j, logit, label: all pairs i < j of a topic's mentions."""
    from clusterloom.operators.pairs import all_pairs

    p = all_pairs(places(spark, sf_dir).select("topic", "idx", "gold", "part"), "topic", "idx", ["gold", "part"])
    return p.select("topic", "i", "j", ((F.col("part_i") + F.col("part_j")) % 2001 / 500 - 2).alias("logit"), (F.col("gold_i") == F.col("gold_j")).cast("int").alias("label"))


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """topic, para, doc, tokens: eight neighbouring ids are the paragraphs of a topic, punctuation parted from words."""
    d = table(spark, sf_dir, "documents")
    topic = F.expr("doc_id div 8")
    para = F.row_number().over(W.partitionBy(topic).orderBy("doc_id")) - 1
    tokens = F.array_remove(F.split(F.regexp_replace(F.regexp_replace("text", r"([,.;:%()\[\]])", " $1 "), r"[ \t\n\x0b\f\r]+", " "), " "), "")
    return d.select(topic.alias("topic"), para.cast("long").alias("para"), F.col("doc_id").alias("doc"), tokens.alias("tokens"))


def hierarchy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(gold, sys) edges topic, src, dst: region -> nation -> supplier; the system lacks a third of the nations' suppliers."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    tops = n.select(F.col("n_regionkey").cast("long").alias("topic"), F.concat(F.lit("r"), "n_regionkey").alias("src"), F.concat(F.lit("n"), "n_nationkey").alias("dst"), F.col("n_nationkey").alias("nation"))
    leaves = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("long").alias("topic"), F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("s"), "s_suppkey").alias("dst"), F.col("n_nationkey").alias("nation"))
    gold = tops.unionByName(leaves)
    return gold.drop("nation"), gold.where("nation % 3 <> 0").drop("nation")
