"""Calibration, threshold and corpus diagnostics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterloom.functions.scalars import fbeta, pairs_of, ratio
from clusterloom.operators.durable import settle


def grid(low: float, high: float, step: float) -> list[float]:
    """Thresholds by repeated addition, as a sweep adds them up."""
    out, t = [], low
    while t <= high + 1e-9:
        out.append(t)
        t += step
    return out


def even_grid(low: float, high: float, step: float) -> list[float]:
    """low + i * step for i up to ceil((high - low) / step)."""
    return [low + i * step for i in range(math.ceil((high - low) / step - 1e-9) + 1) if low + i * step < high + 1e-9]


def tau_curve(scored: DataFrame, taus: list[float], by: list[str] | None = None) -> DataFrame:
    """by, tau, tp, fp, fn, precision, recall, f1 for every threshold (p >= tau).

    Pairs are read once: a group has one sum and one count for each threshold, and nothing else is sorted, joined or shuffled.
    """
    by = by or []
    p = F.col("p")
    sums = [x for i, t in enumerate(taus) for x in (F.sum(F.when(p >= float(t), F.col("label"))).cast("long").alias(f"_tp{i}"), F.count_if(p >= float(t)).alias(f"_n{i}"))]
    groups = (scored.groupBy(*by) if by else scored.groupBy(F.lit(1).alias("_all"))).agg(F.sum("label").cast("long").alias("all_pos"), *sums)
    marks = F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.coalesce(f"_tp{i}", F.lit(0)).cast("long").alias("tp"), F.col(f"_n{i}").alias("kept")) for i, t in enumerate(taus)])
    full = groups.select(*by, "all_pos", F.inline(marks))
    out = full.select(*by, "tau", "tp", (F.col("kept") - F.col("tp")).alias("fp"), (F.col("all_pos") - F.col("tp")).alias("fn"))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r}).withColumn("f1", fbeta(F.col("precision"), F.col("recall")))


def best_tau(curve: DataFrame, by: list[str]) -> DataFrame:
    """Row of largest f1 a group; nearly equal ones by precision, then by tau, both descending."""
    top = F.max("f1").over(W.partitionBy(*by)) if by else F.max("f1").over(W.partitionBy(F.lit(1)))
    close = F.abs(F.col("f1") - F.col("_top")) <= 1e-8 + 1e-5 * F.abs(F.col("_top"))
    rank = F.row_number().over((W.partitionBy(*by) if by else W.partitionBy(F.lit(1))).orderBy(F.desc("precision"), F.desc("tau")))
    return curve.withColumn("_top", top).where(close).withColumn("_rank", rank).where("_rank = 1").drop("_top", "_rank")


def pr_curve(scored: DataFrame) -> DataFrame:
    """threshold, tp, fp, precision, recall at every distinct p.

    Distinct scores are counted first; the running sums are windows over score ranges, then over their totals, so no
    task sees all scores of a large input.
    """
    counts = scored.groupBy("p").agg(F.sum("label").cast("long").alias("pos"), F.count("*").alias("n")).withColumn("slice", F.floor(F.col("p") * 1024))
    total = counts.groupBy("slice").agg(F.sum("pos").alias("s_pos"), F.sum("n").alias("s_n"))
    above = W.partitionBy(F.lit(1)).orderBy(F.desc("slice")).rowsBetween(W.unboundedPreceding, -1)  # 1025 rows at most
    total = total.select("slice", F.coalesce(F.sum("s_pos").over(above), F.lit(0)).alias("b_pos"), F.coalesce(F.sum("s_n").over(above), F.lit(0)).alias("b_n"), F.sum("s_pos").over(W.partitionBy(F.lit(1))).alias("all_pos"))
    run = W.partitionBy("slice").orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0)
    out = counts.join(F.broadcast(total), "slice").select(F.col("p").alias("threshold"), "slice", (F.sum("pos").over(run) + F.col("b_pos")).cast("long").alias("tp"), (F.sum("n").over(run) + F.col("b_n")).cast("long").alias("kept"), "pos", "all_pos")
    return out.select("threshold", "tp", (F.col("kept") - F.col("tp")).alias("fp"), ratio(F.col("tp"), F.col("kept")).alias("precision"), ratio(F.col("tp"), F.col("all_pos")).alias("recall"), ratio(F.col("pos"), F.col("all_pos")).alias("gain"))


def average_precision(scored: DataFrame) -> DataFrame:
    return pr_curve(scored).agg(F.sum(F.col("gain") * F.col("precision")).alias("average_precision"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the rank of value, ties averaged: the rows below it and half of its own.

    Rows are counted by value first, so only the distinct values (thresholds, counts of mentions) are put in order.
    """
    counts = df.groupBy(value).agg(F.count("*").alias("_n"))
    below = F.sum("_n").over(W.partitionBy(F.lit(1)).orderBy(value).rowsBetween(W.unboundedPreceding, -1))
    ranks = counts.select(value, (F.coalesce(below, F.lit(0)) + (F.col("_n") + 1) / 2.0).alias(name))
    return df.join(ranks, value)


def topic_stats(mentions: DataFrame, topic: str, cluster: str, paragraphs: DataFrame | None = None) -> DataFrame:
    """Mentions, clusters, sizes and pair counts a topic; ratios are 0 on a zero denominator.

    With paragraphs topic, n_tokens also n_docs, n_tokens and mentions_per_100_tokens, for topics without mentions too.
    """
    sizes = mentions.groupBy(F.col(topic).alias("topic"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("size"))
    out = sizes.groupBy("topic").agg(F.sum("size").alias("n_mentions"), F.count("*").alias("n_clusters"), F.max("size").alias("max_cluster_size"), F.min("size").alias("min_cluster_size"), F.sum(pairs_of(F.col("size"))).alias("pos_pairs"))
    total = pairs_of(F.col("n_mentions"))
    if paragraphs is not None:
        size = paragraphs.groupBy("topic").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        counts = [c for c in out.columns if c != "topic"]
        out = size.join(out, "topic", "left").select(*size.columns, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts])
        out = out.withColumn("mentions_per_100_tokens", 100 * ratio(F.col("n_mentions"), F.col("n_tokens")))
    return out.withColumn("total_pairs", total).withColumn("pos_rate", ratio(F.col("pos_pairs"), F.col("total_pairs")))


PERCENTILES = (0.1, 0.25, 0.5, 0.75, 0.9)


def describe(df: DataFrame, columns: list[str], percentiles: tuple[float, ...] = PERCENTILES) -> DataFrame:
    """One row for each column, from one aggregate: count, mean, std, min, max and interpolated percentiles."""

    def row(c: str) -> Column:
        v = F.col(c).cast("double")
        return F.struct(F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), *[F.percentile(v, F.lit(q)).alias(f"p{round(q * 100)}") for q in percentiles])

    return df.agg(F.array(*map(row, columns)).alias("rows")).select(F.inline("rows"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (0-based), n: equal widths, the last bin closed above."""
    v = F.col(column).cast("double")
    at = F.least(F.lit(bins - 1), F.floor((v - low) / ((high - low) / bins)).cast("int"))
    return df.where(v.between(low, high)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def logit_counts(scored: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """logit, label, n: equal pairs counted, settled; it has a row for each distinct logit and label, and the pairs are read once for it."""
    return settle(scored.groupBy(F.col(logit).alias("logit"), F.col(label).alias("label")).agg(F.count("*").alias("n")))


def fit_temperature(scored: DataFrame, logit: str = "logit", label: str = "label", pos_weight: bool = False, rounds: int = 6, width: int = 16) -> float:
    """T > 0 of least binary cross-entropy of sigmoid(logit / T).

    The loss is convex in 1 / T.  A round evaluates `width` values in one aggregate over the counts of equal pairs and narrows the
    bracket around the best; the pairs themselves are read once.
    """
    return _fit(logit_counts(scored, logit, label), pos_weight, rounds, width)


def _fit(counts: DataFrame, pos_weight: bool, rounds: int = 6, width: int = 16) -> float:
    low, high = -6.0, 6.0  # of log(1 / T)
    y, n = F.col("label").cast("double"), F.col("n")
    mean = lambda v: F.sum(v * n) / F.sum(F.when(v.isNotNull(), n))
    weight = F.lit(1.0)
    if pos_weight:
        rate = counts.agg(mean(y)).first()[0] or 0.5
        weight = F.when(y == 1, (1 - rate) / max(rate, 1e-9)).otherwise(1.0)
    for _ in range(rounds):
        marks = [low + (high - low) * i / (width - 1) for i in range(width)]
        loss = []
        for i, m in enumerate(marks):
            z = F.col("logit") * math.exp(m)
            loss.append(mean(weight * (F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z))))).alias(f"l{i}"))
        got = list(counts.agg(*loss).first())
        best = min(range(width), key=lambda i: got[i])
        low, high = marks[max(0, best - 1)], marks[min(width - 1, best + 1)]
    return math.exp(-(low + high) / 2)


def gold_pairs(dumped: DataFrame, gold: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topic, logit, label of the dumped pairs; topics that are skipped).

    dumped: topic_id, n, edges; gold: topic, idx, gold.  A topic is skipped if it has no dump or a dump for another number of mentions.
    """
    clusters = gold.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "gold"))), lambda x: x["gold"]).alias("c"))
    both = clusters.join(dumped.withColumnRenamed("topic_id", "topic"), "topic", "left").withColumn("ok", F.coalesce(F.size("c") == F.col("n"), F.lit(False)))
    pairs = both.where("ok").select("topic", "c", F.inline("edges")).select("topic", "logit", (F.get("c", F.col("i")) == F.get("c", F.col("j"))).cast("int").alias("label"))
    return pairs, both.where("not ok").select("topic")


def temperature_record(pairs: DataFrame, split: str, scores_path: str, pos_weight: bool = False) -> DataFrame:
    """One row: temperature, split, num_pairs, pos_rate, scores_path.  No pairs raise an error."""
    counts = logit_counts(pairs)
    y = F.col("label").cast("double")
    n, rate = counts.agg(F.sum("n"), F.sum(y * F.col("n")) / F.sum(F.when(y.isNotNull(), F.col("n")))).first()
    if not n:
        raise ValueError("no pairs to fit a temperature to")
    row = (_fit(counts, pos_weight), split, n, rate, scores_path)
    return pairs.sparkSession.createDataFrame([row], "temperature double, split string, num_pairs long, pos_rate double, scores_path string")
