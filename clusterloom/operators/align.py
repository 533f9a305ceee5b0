"""Aligning extracted strings, spans, sentences and intervals."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clusterloom.functions.scalars import near, overlap
from clusterloom.functions.text import detok, norm


def token_index(tokens: Column) -> Column:
    """struct<low, ends> of tokens: each in lower case with straight quotes, and the characters before each and after the last."""
    low = F.transform(tokens, lambda t: F.translate(F.lower(t), "‘’“”", "''\"\""))
    ends = F.aggregate(low, F.array(F.lit(0)), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + F.char_length(F.replace(t, F.lit(" "), F.lit(""))))))
    return F.struct(low.alias("low"), ends.alias("ends"))


def spans_of(tokens: Column, index: Column, own: Column, max_tokens: int = 20) -> Column:
    """array<struct<start, end>>: for each start the shortest window (end exclusive) equal to the normalised text own; index is token_index(tokens), best a column.

    A window has as many characters, spaces aside, as own, so its end is looked up and only that window is normalised.
    """

    def of(x: Column) -> Column:
        part = lambda i, e: F.slice(tokens, i + 1, e - i)
        starts = F.filter(F.transform(index["low"], lambda t, i: F.when(F.startswith(x["own"], t), i)), lambda i: i.isNotNull())
        end = lambda i: F.array_position(index["ends"], F.get(index["ends"], i) + x["size"]).cast("int") - 1
        found = F.transform(starts, lambda i: F.struct(i.alias("start"), end(i).alias("end")))
        fits = lambda w: (w["end"] > w["start"]) & (w["end"] - w["start"] <= max_tokens) & (norm(detok(part(w["start"], w["end"]))) == x["own"])
        return F.when(x["own"] != "", F.filter(found, fits))

    return F.get(F.transform(F.array(F.struct(own.alias("own"), F.char_length(F.replace(own, F.lit(" "), F.lit(""))).alias("size"))), of), F.lit(0))


def first_span(tokens: Column, target: Column, max_tokens: int = 20) -> Column:
    """struct<start, end> (end exclusive) of the first, then shortest, window equal to the normalised target; null if none.  Row by row, nothing is shuffled."""
    return F.get(F.transform(F.array(token_index(tokens)), lambda x: F.get(spans_of(tokens, x, norm(target), max_tokens), F.lit(0))), F.lit(0))


def require(rows: DataFrame, other: DataFrame, keys: list[str], what: str) -> DataFrame:
    """rows with other's columns by keys; a row without one raises an error that names it."""
    found = other.withColumn("_there", F.lit(True))
    name = F.concat_ws(", ", *[F.concat(F.lit(f"{k} "), F.col(k).cast("string")) for k in keys])
    both = rows.join(found, keys, "left")
    there = F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no {what} for "), name)).cast("boolean"))
    return both.where(there).drop("_there")


def in_both(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys that stand on both sides, in order."""
    return a.select(*keys).intersect(b.select(*keys)).orderBy(*keys)


def find_spans(paras: DataFrame, targets: DataFrame, keys: list[str], max_tokens: int = 20) -> DataFrame:
    """keys, target, start, end: for each start the shortest window equal to the normalised target.

    A paragraph meets its targets in one row, so nothing is exchanged but paragraphs and targets, once.
    """
    wanted = targets.select(*keys, "target", norm(F.col("target")).alias("gram")).where("gram <> ''")
    own = wanted.groupBy(*keys).agg(F.collect_set(F.struct("target", "gram")).alias("_own"))
    rows = paras.join(own, keys).withColumn("_index", token_index(F.col("tokens")))
    each = rows.select(*keys, "tokens", "_index", F.inline("_own"))
    found = each.select(*keys, "target", F.inline(spans_of(F.col("tokens"), F.col("_index"), F.col("gram"), max_tokens)))
    return found.groupBy(*keys, "target", "start").agg(F.min("end").alias("end"))


def first_near(gold: DataFrame, entities: DataFrame, keys: list[str], delta_pos: int = 3, delta_len: int = 3) -> DataFrame:
    """gold rows with the ordinal of the first entity whose span lies near, null if none.  gold: id, g0, g1; entities: ord, e0, e1."""
    # starts are parted into stretches of delta_pos + 1, so a span meets those of its own and the two neighbouring ones only
    stretch = lambda c: F.floor(F.col(c) / (delta_pos + 1))
    a = gold.withColumn("_at", F.explode(F.sequence(stretch("g0") - 1, stretch("g0") + 1)))
    hit = a.join(entities.withColumn("_at", stretch("e0")), [*keys, "_at"]).where(near(F.col("g0"), F.col("g1"), F.col("e0"), F.col("e1"), delta_pos, delta_len))
    best = hit.groupBy(*keys, "id").agg(F.min("ord").alias("ord"))
    return gold.join(best, [*keys, "id"], "left")


def _greedy(delta_pos: int, delta_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = []
            for gold, pred in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                used, found = set(), []
                for g in gold:
                    hit = next((span for p in pred if (span := (p["s"], p["e"])) not in used and abs(g["s"] - p["s"]) <= delta_pos and abs((g["e"] - g["s"]) - (p["e"] - p["s"])) <= delta_len), None)
                    found.append(hit is not None)
                    used.add(hit)
                hits.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hits, pa.list_(pa.bool_()))], ["key", "g", "hits"])

    return run


def greedy_matches(gold: DataFrame, pred: DataFrame, key: str, delta_pos: int = 2, delta_len: int = 2) -> DataFrame:
    """key, ord, s, e, hit: each gold span (ord order) takes the first unused near predicted span; equal spans are used together.

    Rows without a hit are the miss table.
    """
    pack = lambda df, n: df.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")))).alias(n))
    empty = F.array().cast("array<struct<ord:bigint,s:bigint,e:bigint>>")
    both = pack(gold, "g").join(pack(pred, "p"), "key", "left").select("key", "g", F.coalesce(F.col("p"), empty).alias("p"))
    kind = both.schema["key"].dataType.simpleString()
    found = both.mapInArrow(_greedy(delta_pos, delta_len), f"key {kind}, g array<struct<ord:bigint,s:bigint,e:bigint>>, hits array<boolean>")
    return found.select("key", F.inline(F.arrays_zip("g", "hits"))).select("key", "g.*", F.col("hits").alias("hit"))


def greedy_recall(gold: DataFrame, pred: DataFrame, key: str, delta_pos: int = 2, delta_len: int = 2) -> DataFrame:
    """key, hits, gold counts of greedy_matches."""
    return greedy_matches(gold, pred, key, delta_pos, delta_len).groupBy("key").agg(F.count_if("hit").alias("hits"), F.count("*").alias("gold"))


def inside(start: Column, end: Column, sent_start: Column, sent_end: Column) -> Column:
    """Whether a right-open span lies within a right-open sentence."""
    return (start >= sent_start) & (end <= sent_end)


def best_sentence(sentences: Column, start: Column, end: Column) -> Column:
    """0-based index of the [start, end) sentence of largest overlap, the first of equals; 0 if none."""
    scored = F.transform(sentences, lambda s, i: F.struct(overlap(start, end, s[0], s[1]).alias("o"), (-i).alias("i")))
    return F.coalesce(-F.array_max(scored)["i"], F.lit(0))


def merge_intervals(points: DataFrame, keys: list[str], at: str, reach: int = 1, gap: int = 2) -> DataFrame:
    """keys, start, end, n: points x as [x - reach, x + reach], a new run where one starts over `gap` after the last end."""
    by = W.partitionBy(*keys).orderBy("_at")
    p = points.select(*keys, F.col(at).alias("_at"))
    fresh = F.coalesce((F.col("_at") - reach > F.lag("_at").over(by) + reach + gap).cast("int"), F.lit(1))
    runs = p.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg((F.min("_at") - reach).alias("start"), (F.max("_at") + reach).alias("end"), F.count("*").alias("n")).drop("_run")


def flatten_offsets(paras: DataFrame, topic: str, para: str, size: Column) -> DataFrame:
    """paras with flatten_offset: tokens of the topic before the paragraph."""
    run = W.partitionBy(topic).orderBy(para).rowsBetween(W.unboundedPreceding, 0)
    return paras.withColumn("flatten_offset", (F.sum(size).over(run) - size).cast("long"))


#: Words of a stretch of a document that markables are met in.
STRETCH = 32


def align_ranges(key: DataFrame, response: DataFrame) -> DataFrame:
    """doc, key_id, resp_id: the first response markable whose ends lie between the key's ends and its minimum core.

    key: doc, key_id, start, lo, hi, end; response: doc, resp_id, r0, r1, ord.  Starts are parted into stretches of STRETCH words,
    so a key meets the responses of its own stretches only.
    """
    stretch = lambda c: F.floor(F.col(c) / STRETCH)
    a = key.where("start <= lo").withColumn("_at", F.explode(F.sequence(stretch("start"), stretch("lo"))))
    hit = a.join(response.withColumn("_at", stretch("r0")), ["doc", "_at"]).where("r0 between start and lo and r1 between hi and end")
    return hit.groupBy("doc", "key_id").agg(F.min_by("resp_id", "ord").alias("resp_id"))


def drop_nested(mentions: DataFrame, keep_singletons: bool = True) -> DataFrame:
    """Mentions doc, cluster, id, start, end without those properly inside another of their cluster.

    A removal counts once for each mention around it.  A cluster of several mentions whose removals, so counted, are one fewer
    than its mentions is left as it is with singletons kept, and dropped otherwise.
    """
    other = mentions.select(F.col("doc"), F.col("cluster"), F.col("start").alias("o0"), F.col("end").alias("o1"))
    inside = mentions.join(other, ["doc", "cluster"]).where("o0 <= start and end <= o1 and (o0 < start or end < o1)").groupBy("doc", "cluster", "id").agg(F.count("*").alias("_in"))
    both = mentions.join(inside, ["doc", "cluster", "id"], "left")
    part = W.partitionBy("doc", "cluster")
    both = both.withColumns({"_left": F.count("*").over(part) - F.coalesce(F.sum("_in").over(part), F.lit(0)), "_n": F.count("*").over(part)})
    lone = (F.col("_left") == 1) & (F.col("_n") > 1)
    kept = both.where(F.when(lone, F.lit(keep_singletons)).otherwise(F.col("_in").isNull()))
    return kept.drop("_in", "_left", "_n")
