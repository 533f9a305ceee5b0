"""Whole stages as functions of keyword arguments: files or tables in, tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clusterloom.functions.scalars import sigmoid
from clusterloom.operators import align, cluster, diagnose, metrics, pairs, score
from clusterloom.sources import conll

#: Other names of metrics among the options of a scorer.
NAMES = {"mentions": "mention", "bcub": "b3"}


def score_options(words: list[str]) -> dict:
    """Keywords of score_files from option words in any order: metric names, all, remove_nested, remove_singletons; others are ignored."""
    named = [NAMES.get(w, w) for w in words]
    known = tuple(m for m in metrics.REGISTRY if m in named)
    return {"metric_names": known if known and "all" not in words else "all", "remove_nested": "remove_nested" in words, "keep_singletons": "remove_singletons" not in words}


def mentions_of(tokens: DataFrame, remove_nested: bool = False, keep_singletons: bool = True) -> DataFrame:
    """doc, start, end, cluster of annotated tokens (doc, pos, cell) after the filters of a scorer."""
    out = conll.decode(tokens)
    if not keep_singletons:
        out = metrics.drop_singletons(out, "doc", "cluster")
    if remove_nested:
        out = align.drop_nested(out.withColumn("id", F.struct("start", "end")), keep_singletons).drop("id")
    return out


def score_files(spark: SparkSession, key_path: str, sys_path: str, metric_names: tuple[str, ...] | str = "all", remove_nested: bool = False, keep_singletons: bool = True, missing: str = "raise") -> DataFrame:
    """metric, recall, precision, f1 of two annotation folders or files; a key document that the system lacks is an error unless it is skipped."""
    key, sys = conll.read(spark, key_path), conll.read(spark, sys_path)
    sides = [mentions_of(t, remove_nested, keep_singletons) for t in (key, sys)]
    return metrics.evaluate(metrics.align_mentions(*sides, key, sys, missing), metric_names)


def conll_line(scores: DataFrame) -> DataFrame:
    """line with the CoNLL score in hundredths, where all of its three metrics are there."""
    part = scores.where(F.col("metric").isin("muc", "b3", "ceafe")).agg(F.avg("f1").alias("f1"), F.count("*").alias("n"))
    return part.where("n = 3").select(F.concat(F.lit("CoNLL score: "), F.format_string("%.2f", F.round(100 * F.col("f1"), 2))).alias("line"))


def training_pairs(mentions: DataFrame, neg_pos_ratio: float = 1.0, seed: int = 13, topics_limit: int = -1) -> DataFrame:
    """topic, i, j, label and texts of training pairs from mentions topic, idx, cluster, signature."""
    if topics_limit > 0:
        mentions = mentions.join(mentions.select("topic").distinct().orderBy("topic").limit(topics_limit), "topic", "left_semi")
    p = pairs.all_pairs(mentions, "topic", "idx", ["cluster", "signature"])
    p = p.select("topic", "i", "j", (F.col("cluster_i") == F.col("cluster_j")).cast("int").alias("label"), F.col("signature_i").alias("text_a"), F.col("signature_j").alias("text_b"))
    return pairs.training_pairs(p, neg_pos_ratio, seed)


def predict_clusters(mentions: DataFrame, scorer: score.Scorer, distance_threshold: float = 0.5, method: str = "agglomerative", linkage: str = "average", temperature: float = 1.0) -> DataFrame:
    """topic, clusters: labels of mentions topic, idx, signature in their order."""
    p = pairs.all_pairs(mentions, "topic", "idx", ["signature"]).withColumnsRenamed({"signature_i": "text_a", "signature_j": "text_b"})
    scored = scorer(p).select("topic", "i", "j", sigmoid(F.col("logit"), temperature).alias("p"))
    labels = cluster.cluster(mentions.select("topic", "idx"), scored, method, distance_threshold, linkage)
    return labels.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]).alias("clusters"))


def sweep_thresholds(nodes: DataFrame, scored: DataFrame, gold: DataFrame, method: str = "agglomerative", linkage: str = "average", t_min: float = 0.1, t_max: float = 0.9, t_step: float = 0.02) -> DataFrame:
    """threshold, conll (in hundredths) of every threshold; `cluster.winner` takes the best.  gold: topic, idx, gold."""

    def conll_of(labels: DataFrame) -> DataFrame:
        both = labels.join(gold, ["topic", "idx"]).select(F.struct("threshold", "topic").alias("doc"), F.col("idx").alias("mention"), F.col("gold").alias("key"), F.col("label").alias("sys"))
        return metrics.evaluate(both, ("muc", "b3", "ceafe"), by="threshold").groupBy("threshold").agg((100 * F.sum("f1") / 3).alias("conll"))

    return cluster.sweep(nodes, scored, diagnose.grid(t_min, t_max, t_step), method, conll_of, linkage)
