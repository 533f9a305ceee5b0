"""Scores of cluster hierarchies: relations topic, src, dst and mentions topic, cluster, mention on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.functions.scalars import fbeta, path_part, ratio
from clusterloom.operators.durable import settle
from clusterloom.operators.graph import closure, derived_relations


def _expand(relations: DataFrame, mentions: DataFrame) -> DataFrame:
    m = lambda c, out: mentions.select("topic", F.col("cluster").alias(c), F.col("mention").alias(out))
    return relations.join(m("src", "a"), ["topic", "src"]).join(m("dst", "b"), ["topic", "dst"])


def _relations(edges: DataFrame, bag: bool) -> DataFrame:
    """topic, src, dst, n: direct relations (with their repeats as n, if bag) and derived ones."""
    direct = edges.groupBy("topic", "src", "dst").agg((F.count("*") if bag else F.lit(1).cast("long")).alias("n"))
    more = derived_relations(edges).withColumn("n", F.lit(1).cast("long"))
    return direct.unionByName(more.join(direct, ["topic", "src", "dst"], "left_anti"))


def _table(gold: DataFrame, gold_hit: DataFrame, sys: DataFrame, sys_hit: DataFrame) -> DataFrame:
    """topic, gold, gold_hit, sys, sys_hit sums, recall, precision, f1 a topic."""
    total = lambda df, n: df.groupBy("topic").agg(F.sum("n").cast("long").alias(n))
    out = total(gold, "gold").join(total(gold_hit, "gold_hit"), "topic", "full").join(total(sys, "sys"), "topic", "full").join(total(sys_hit, "sys_hit"), "topic", "full")
    out = out.select("topic", *[F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gold", "gold_hit", "sys", "sys_hit")])
    r, p = ratio(F.col("gold_hit"), F.col("gold")), ratio(F.col("sys_hit"), F.col("sys"))
    return out.withColumns({"recall": r, "precision": p}).withColumn("f1", fbeta(F.col("precision"), F.col("recall")))


def hypernym(gold: DataFrame, sys: DataFrame, gold_mentions: DataFrame, sys_mentions: DataFrame) -> DataFrame:
    """A relation counts if one of its mention pairs is a pair of the other side's relations; repeated direct relations count each."""
    g, s = settle(_relations(gold, True)), settle(_relations(sys, True))
    ge, se = _expand(g, gold_mentions), _expand(s, sys_mentions)
    hit = lambda a, b: a.join(b.select("topic", "a", "b").distinct(), ["topic", "a", "b"], "left_semi").select("topic", "src", "dst", "n").distinct()
    return _table(g, hit(ge, se), s, hit(se, ge))


def _candidates(own: DataFrame, other: DataFrame) -> DataFrame:
    """topic, cluster, cand: clusters of the other side that hold half of a cluster's mentions; null for a cluster without mentions, which any matches."""
    size = own.groupBy("topic", "cluster").agg(F.count("*").alias("size"))
    shared = own.join(other.select("topic", "mention", F.col("cluster").alias("cand")), ["topic", "mention"]).groupBy("topic", "cluster", "cand").agg(F.count("*").alias("k"))
    return size.join(shared, ["topic", "cluster"]).where("2 * k >= size").select("topic", "cluster", "cand")


def hypernym50(gold: DataFrame, sys: DataFrame, gold_mentions: DataFrame, sys_mentions: DataFrame) -> DataFrame:
    """A relation counts if some pair of candidates of its ends is a relation on the other side; relations are sets.

    Every cluster is a candidate of one without mentions.  That is no row for each of them: the relation then only needs one with
    the other end.
    """
    g, s = settle(_relations(gold, False)), settle(_relations(sys, False))

    def hit(a: DataFrame, b: DataFrame, am: DataFrame, bm: DataFrame) -> DataFrame:
        c = _candidates(am, bm)
        held = am.select("topic", "cluster").distinct()
        # both ends get their few candidates before the other side's relations are met
        for end, cand in (("src", "csrc"), ("dst", "cdst")):
            name = lambda df, *more: df.select("topic", F.col("cluster").alias(end), *more)  # noqa: B023, E731
            a = a.join(name(held, F.lit(True).alias(f"_{end}")), ["topic", end], "left").join(name(c, F.col("cand").alias(cand)), ["topic", end], "left")
        known = a.where("(_src is null or csrc is not null) and (_dst is null or cdst is not null)")
        part = lambda where, on: known.where(where).join(b.select("topic", F.col("src").alias("csrc"), F.col("dst").alias("cdst")).select("topic", *on).distinct(), ["topic", *on], "left_semi").select("topic", "src", "dst", "n")
        found = part("_src and _dst", ["csrc", "cdst"]).unionByName(part("_src is null and _dst", ["cdst"])).unionByName(part("_src and _dst is null", ["csrc"])).unionByName(part("_src is null and _dst is null", []))
        return found.distinct()

    return _table(g, hit(g, s, gold_mentions, sys_mentions), s, hit(s, g, sys_mentions, gold_mentions))


def micro(table: DataFrame) -> DataFrame:
    """recall, precision, f1 of summed counts, and the mean f1 of topics."""
    t = table.agg(*[F.sum(c).alias(c) for c in ("gold", "gold_hit", "sys", "sys_hit")], F.avg("f1").alias("macro_f1"))
    r, p = ratio(F.col("gold_hit"), F.col("gold")), ratio(F.col("sys_hit"), F.col("sys"))
    return t.select("gold", "gold_hit", "sys", "sys_hit", r.alias("recall"), p.alias("precision"), fbeta(p, r).alias("f1"), "macro_f1")


def path_lengths(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """topic, a, b, d for ordered mention pairs with a path: 1 in one cluster, else hops + 1."""
    c = mentions.select("topic", "cluster").distinct()
    far = closure(edges).where("src <> dst").select("topic", "src", "dst", (F.col("hops") + 1).alias("d"))
    near = c.select("topic", F.col("cluster").alias("src"), F.col("cluster").alias("dst"), F.lit(1).alias("d"))
    return _expand(far.unionByName(near), mentions).groupBy("topic", "a", "b").agg(F.min("d").alias("d"))


def path_ratio(gold: DataFrame, sys: DataFrame, gold_mentions: DataFrame, sys_mentions: DataFrame, with_tn: bool = False) -> DataFrame:
    """topic, total, pairs, path_ratio: min / max of gold and system path lengths over the ordered pairs of gold mentions.

    Pairs that neither side connects weigh nothing, or count as 1 with true negatives; they are counted, not built.
    """
    g, s = path_lengths(gold, gold_mentions).withColumnRenamed("d", "dg"), path_lengths(sys, sys_mentions).withColumnRenamed("d", "ds")
    both = g.join(s, ["topic", "a", "b"], "full").select("topic", F.coalesce("dg", F.lit(0)).alias("dg"), F.coalesce("ds", F.lit(0)).alias("ds"))
    part, weight = path_part(F.least("dg", "ds"), F.greatest("dg", "ds"), with_tn)
    out = both.groupBy("topic").agg(F.sum(part * weight).alias("total"), F.sum(weight).cast("long").alias("pairs"))
    if with_tn:
        n = gold_mentions.groupBy("topic").agg(F.countDistinct("mention").alias("_n"))
        out = n.join(out, "topic", "left").select("topic", (F.coalesce("total", F.lit(0.0)) + F.col("_n") * F.col("_n") - F.coalesce("pairs", F.lit(0))).alias("total"), (F.col("_n") * F.col("_n")).alias("pairs"))
    return out.withColumn("path_ratio", ratio(F.col("total"), F.col("pairs")))
