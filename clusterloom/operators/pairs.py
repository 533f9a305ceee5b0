"""Pairs of mentions within a topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def all_pairs(mentions: DataFrame, topic: str, index: str, carry: list[str], ordered: bool = False) -> DataFrame:
    """topic, i, j and carried columns as c_i, c_j: pairs i < j, or all ordered pairs with themselves.

    The join is an equi-join on the topic, so topics are spread by hash and AQE splits a large one.
    """
    side = lambda s: mentions.select(F.col(topic).alias("topic"), F.col(index).alias(s), *[F.col(c).alias(f"{c}_{s}") for c in carry])
    a, b = side("i"), side("j")
    return a.join(b, "topic") if ordered else a.join(b, (a["topic"] == b["topic"]) & (F.col("i") < F.col("j"))).drop(b["topic"])


def positive_pairs(mentions: DataFrame, topic: str, index: str, cluster: str) -> DataFrame:
    """topic, i, j of pairs i < j in one cluster."""
    a = mentions.select(F.col(topic).alias("topic"), F.col(cluster).alias("cluster"), F.col(index).alias("i"))
    b = mentions.select(F.col(topic).alias("topic"), F.col(cluster).alias("cluster"), F.col(index).alias("j"))
    return a.join(b, ["topic", "cluster"]).where("i < j").select("topic", "i", "j")


def training_pairs(labelled: DataFrame, ratio: float = 1.0, seed: int = 13, fallback: int = 32) -> DataFrame:
    """All positives of topic, i, j, label and int(ratio * positives) negatives a topic; `fallback` negatives where none is positive.

    Negatives are those of least hash of (seed, i, j), so a topic's sample does not depend on others.
    """
    n_pos = F.sum("label").over(W.partitionBy("topic"))
    rank = F.row_number().over(W.partitionBy("topic", "label").orderBy(F.xxhash64(F.lit(seed), "i", "j"), "i", "j"))
    want = F.when(n_pos > 0, F.floor(F.lit(float(ratio)) * n_pos)).otherwise(fallback)
    return labelled.withColumns({"_rank": rank, "_want": want}).where((F.col("label") == 1) | (F.col("_rank") <= F.col("_want"))).drop("_rank", "_want")


def confusion(predicted: Column, label: Column) -> list[Column]:
    """tp, fp, fn, tn counts."""
    count = lambda c, n: F.count_if(c).cast("long").alias(n)
    return [count(predicted & (label == 1), "tp"), count(predicted & (label == 0), "fp"), count(~predicted & (label == 1), "fn"), count(~predicted & (label == 0), "tn")]


def log_loss(p: Column, label: Column, eps: float = 1e-8) -> Column:
    """Mean clipped negative log-likelihood."""
    y = label.cast("double")
    return F.avg(-(y * F.ln(F.greatest(p, F.lit(eps))) + (1 - y) * F.ln(F.greatest(1 - p, F.lit(eps)))))
