"""Coreference metrics over one contingency table.

The input is an alignment doc, mention, key, sys: the cluster of a mention on each side, null where
the side lacks it.  Cells n(K, S) with the cluster sizes give every metric by plain aggregation;
only CEAF needs an optimal assignment and runs a solver a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from clusterloom.functions.scalars import fbeta, pairs_of, ratio


def align_mentions(key: DataFrame, sys: DataFrame, key_docs: DataFrame | None = None, sys_docs: DataFrame | None = None, missing: str = "raise") -> DataFrame:
    """doc, mention, key, sys from mentions doc, start, end, cluster of both sides; mentions are equal if their spans are.

    A mention in several clusters of a side is in the last of them, clusters taken in the order of their first mention's end.  With
    the documents of both sides, a key document that the system lacks raises an error (missing="skip" leaves it out), and other
    system documents are ignored.
    """

    def last(side: DataFrame, name: str) -> DataFrame:
        order = side.groupBy("doc", "cluster").agg(F.min(F.struct("end", "start")).alias("_first"))
        return side.join(order, ["doc", "cluster"]).groupBy("doc", F.struct("start", "end").alias("mention")).agg(F.max_by("cluster", F.struct("_first", "cluster")).alias(name))

    out = last(key, "key").join(last(sys, "sys"), ["doc", "mention"], "full")
    if key_docs is None or sys_docs is None:
        return out
    there = sys_docs.select("doc").distinct().withColumn("_there", F.lit(True))
    docs = key_docs.select("doc").distinct().join(there, "doc", "left")
    absent = F.lit(False) if missing == "skip" else F.raise_error(F.concat(F.lit("the system has no document "), F.col("doc").cast("string"))).cast("boolean")
    return out.join(docs.where(F.when(F.col("_there"), F.lit(True)).otherwise(absent)).select("doc"), "doc", "left_semi")


def mask_unseen(mentions: DataFrame, seen: DataFrame, keep_singletons: bool = True) -> DataFrame:
    """Mentions doc, cluster, start, end that the other side has seen; clusters that lose some and keep one go without keep_singletons."""
    marked = mentions.join(seen.select("doc", "start", "end").distinct().withColumn("_seen", F.lit(True)), ["doc", "start", "end"], "left")
    part = W.partitionBy("doc", "cluster")
    marked = marked.withColumns({"_kept": F.count("_seen").over(part), "_n": F.count("*").over(part)}).where("_seen")
    return (marked if keep_singletons else marked.where("_kept > 1 or _kept = _n")).select(*mentions.columns)


def contingency(alignment: DataFrame) -> DataFrame:
    """doc, key, sys, n, size_key, size_sys; cells with a null side hold the mentions that the other side lacks.

    A document's cells are brought together once, after counting, so the sizes and all sums over clusters and documents need no
    further exchange.
    """
    cells = alignment.groupBy("doc", "key", "sys").agg(F.count("*").alias("n")).repartition("doc")
    size = lambda c: F.when(F.col(c).isNotNull(), F.sum("n").over(W.partitionBy("doc", c)))
    return cells.withColumns({"size_key": size("key"), "size_sys": size("sys")})


def _side(cells: DataFrame, own: str, other: str) -> DataFrame:
    """One row for each cluster of a side with what the link and overlap metrics need, and one for the mentions that the side lacks.

    No row is left out here: a filter would go below the exchange of the cells, which then were not the same for both sides.
    """
    both = F.col(other).isNotNull()
    n, size = F.col("n"), F.col(f"size_{own}")
    return (
        cells.groupBy("doc", own)
        .agg(
            F.max(size).alias("size"),
            F.sum(F.when(both, n).otherwise(0)).alias("mapped"),
            F.count_if(both).alias("linked"),
            F.sum(F.when(both, n * n).otherwise(0)).alias("squares"),
            F.sum(F.when(both, pairs_of(n)).otherwise(0)).alias("links"),
            F.max(F.when(both, F.col(f"size_{other}"))).alias("largest"),
        )
    )


def side_sums(cells: DataFrame, own: str, other: str, prefix: str) -> DataFrame:
    """doc and numerators and denominators of MUC, B-cubed, LEA and mentions for recall (own = key) or precision (own = sys)."""
    size = F.col("size")
    lea = F.when(size == 1, (F.col("largest") == 1).cast("double")).otherwise(ratio(F.col("links"), pairs_of(size)))
    total = lambda x, name: F.sum(F.when(F.col(own).isNotNull(), x)).cast("double").alias(name.format(prefix))
    sums = _side(cells, own, other).groupBy("doc").agg(
        total(F.col("mapped") - F.col("linked"), "muc_{}_num"),
        total(size - 1, "muc_{}_den"),
        total(F.col("squares") / size, "b3_{}_num"),
        total(size, "b3_{}_den"),
        total(size * F.coalesce(lea, F.lit(0.0)), "lea_{}_num"),
        total(size, "lea_{}_den"),
        total(F.col("mapped"), "mention_{}_num"),
        total(size, "mention_{}_den"),
        F.count(own).cast("double").alias(f"clusters_{prefix}"),
    )
    return sums.where(F.col(f"clusters_{prefix}") > 0)


def per_document(alignment: DataFrame, missing: str = "zero") -> DataFrame:
    """doc and all numerators and denominators (r_ and p_), one row for each document of the key.

    A key document without system mentions counts with zeros; missing="skip" drops it.  Extra system documents are ignored.
    """
    cells = contingency(alignment)
    r, p = side_sums(cells, "key", "sys", "r"), side_sums(cells, "sys", "key", "p")
    out = r.join(p, "doc", "inner" if missing == "skip" else "left")
    return out.select("doc", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in out.columns if c != "doc"])


def corpus(sums: DataFrame, metric: str, beta: float = 1.0) -> DataFrame:
    """recall, precision, f1 from summed numerators and denominators."""
    s = sums.agg(*[F.sum(f"{metric}_{x}").alias(x) for x in ("r_num", "r_den", "p_num", "p_den")])
    r, p = ratio(F.col("r_num"), F.col("r_den")), ratio(F.col("p_num"), F.col("p_den"))
    return s.select(r.alias("recall"), p.alias("precision"), fbeta(p, r, beta).alias("f1"))


def best_assignment(gain: np.ndarray) -> float:
    """Largest sum of a one-to-one choice of cells: shortest augmenting paths with potentials, O(n^3)."""
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    rows, cols = gain.shape
    if not rows:
        return 0.0
    cost = gain.max() - gain
    u, v = np.zeros(rows), np.zeros(cols)
    owner = np.full(cols, -1)
    for start in range(rows):
        row, back = start, np.full(cols, -1)
        least, done = np.full(cols, np.inf), np.zeros(cols, bool)
        at = -1
        while True:
            slack = cost[row] - u[row] - v
            better = ~done & (slack < least)
            least[better], back[better] = slack[better], at
            step = int(np.argmin(np.where(done, np.inf, least)))
            delta = least[step]
            u[start] += delta
            u[owner[done]] += delta
            v[done] -= delta
            least[~done] -= delta
            done[step] = True
            at = step
            if owner[step] < 0:
                break
            row = owner[step]
        while at >= 0:
            before = back[at]
            owner[at] = start if before < 0 else owner[before]
            at = before
    used = np.flatnonzero(owner >= 0)
    return float(gain[owner[used], used].sum())


#: Documents with at most so many clusters on their smaller side are solved together with the others of their shape.
NARROW = 5


def best_of_many(gain: np.ndarray) -> np.ndarray:
    """best_assignment of each gain[t, rows, columns] of few columns: rows one by one, best sums for each set of columns."""
    m, rows, cols = gain.shape
    best = np.zeros((1 << cols, m))
    for r in range(rows):
        for taken in range((1 << cols) - 1, 0, -1):  # smaller sets still are those of the rows before
            for c in range(cols):
                if taken >> c & 1:
                    np.maximum(best[taken], best[taken ^ (1 << c)] + gain[:, r, c], out=best[taken])
    return best[-1]


def _codes(values: pa.Array) -> np.ndarray:
    """A number for each distinct value, -1 for null."""
    return pc.fill_null(values.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells, docs = batch.column(1), batch.num_rows
        row = np.repeat(np.arange(docs), np.diff(cells.offsets.to_numpy()))
        flat = cells.flatten()
        n, size_key, size_sys = (np.nan_to_num(flat.field(c).to_numpy(zero_copy_only=False).astype(float)) for c in ("n", "size_key", "size_sys"))
        side, counts = {}, {}
        for c in ("key", "sys"):
            code = _codes(flat.field(c))
            there = np.unique(row[code >= 0] * (code.max(initial=0) + 1) + code[code >= 0])
            counts[c] = np.bincount(there // (code.max(initial=0) + 1), minlength=docs)
            side[c] = code
        met = (side["key"] >= 0) & (side["sys"] >= 0)
        r, n, sizes = row[met], n[met], (size_key + size_sys)[met]
        local, shape = {}, {}
        for c in ("key", "sys"):
            own = r * (side[c].max(initial=0) + 1) + side[c][met]
            there, at = np.unique(own, return_inverse=True)
            of = there // (side[c].max(initial=0) + 1)
            shape[c] = np.bincount(of, minlength=docs)
            local[c] = at - (np.cumsum(shape[c]) - shape[c])[r]
        turned = shape["key"] < shape["sys"]
        tall, wide = np.where(turned, shape["sys"], shape["key"]), np.where(turned, shape["key"], shape["sys"])
        i, j = np.where(turned[r], local["sys"], local["key"]), np.where(turned[r], local["key"], local["sys"])
        got = np.zeros((2, docs))
        cells_of = np.argsort(r, kind="stable")
        many = np.bincount(r, minlength=docs)
        starts = np.cumsum(many) - many
        forms, form = np.unique(np.stack([tall, wide]), axis=1, return_inverse=True)
        for k, (h, w) in enumerate(forms.T.tolist()):
            if not w:
                continue
            every = np.flatnonzero(form == k)
            step = max(1, (1 << 20) // (h * w)) if w <= NARROW else 1
            for lo in range(0, len(every), step):
                part = every[lo : lo + step]
                count = many[part]
                e = cells_of[np.repeat(starts[part] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                t = np.repeat(np.arange(len(part)), count)
                for phi, value in enumerate((2.0 * n[e] / sizes[e], n[e])):
                    gain = np.zeros((len(part), h, w))
                    gain[t, i[e], j[e]] = value
                    got[phi, part] = best_of_many(gain) if w <= NARROW else best_assignment(gain[0])
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, got), *(pa.array(counts[c].astype(float)) for c in ("key", "sys"))], ["doc", "ceafe_num", "ceafm_num", "clusters_r", "clusters_p"])


def ceaf_sums(alignment: DataFrame) -> DataFrame:
    """doc, ceafe_num, ceafm_num, clusters_r, clusters_p; both CEAFs divide by cluster counts."""
    cells = contingency(alignment)
    plain = lambda c: F.col(c) if isinstance(cells.schema[c].dataType, NumericType) else F.col(c).cast("string").alias(c)
    met = cells.groupBy("doc").agg(F.collect_list(F.struct(plain("key"), plain("sys"), "n", "size_key", "size_sys")).alias("cells"))
    doc = alignment.schema["doc"].dataType.simpleString()
    return met.mapInArrow(_solve, f"doc {doc}, ceafe_num double, ceafm_num double, clusters_r double, clusters_p double").where("clusters_r > 0")


def ceaf(sums: DataFrame, which: str, beta: float = 1.0) -> DataFrame:
    s = sums.agg(F.sum(f"{which}_num").alias("num"), F.sum("clusters_r").alias("r_den"), F.sum("clusters_p").alias("p_den"))
    r, p = ratio(F.col("num"), F.col("r_den")), ratio(F.col("num"), F.col("p_den"))
    return s.select(r.alias("recall"), p.alias("precision"), fbeta(p, r, beta).alias("f1"))


#: A metric is four sums of `per_document` and `ceaf_sums`: recall's numerator and denominator, then precision's.
REGISTRY: dict[str, tuple[str, str, str, str]] = {m: tuple(f"{m}_{x}" for x in ("r_num", "r_den", "p_num", "p_den")) for m in ("mention", "muc", "b3", "lea")}
REGISTRY |= {m: (f"{m}_num", "clusters_r", f"{m}_num", "clusters_p") for m in ("ceafe", "ceafm")}


def chosen(metrics: tuple[str, ...] | str = "all") -> tuple[str, ...]:
    """Names of registered metrics; all of them for "all"."""
    names = tuple(REGISTRY) if metrics == "all" else tuple(metrics)
    if unknown := set(names) - set(REGISTRY):
        raise ValueError(f"no metric {sorted(unknown)}; there are {sorted(REGISTRY)}")
    return names


def evaluate(alignment: DataFrame, metrics: tuple[str, ...] | str = ("mention", "muc", "b3", "ceafe", "ceafm", "lea"), beta: float = 1.0, by: str | None = None) -> DataFrame:
    """metric, recall, precision, f1 rows from one aggregate; with by, a field of a struct doc, for each value of it."""
    metrics = chosen(metrics)
    assigned = [m for m in metrics if m.startswith("ceaf")]
    if len(assigned) == len(metrics):
        sums = ceaf_sums(alignment)  # it has the counts of clusters, too
    else:
        sums = per_document(alignment)
        if assigned:
            sums = sums.join(ceaf_sums(alignment).drop("clusters_r", "clusters_p"), "doc", "left")
    used = sorted({c for m in metrics for c in REGISTRY[m]})
    keys = [F.col("doc")[by].alias(by)] if by else []
    totals = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in used])

    def row(m: str) -> Column:
        rn, rd, pn, pd = map(F.col, REGISTRY[m])
        r, p = ratio(rn, rd), ratio(pn, pd)
        return F.struct(F.lit(m).alias("metric"), r.alias("recall"), p.alias("precision"), fbeta(p, r, beta).alias("f1"))

    return totals.select(*([by] if by else []), F.inline(F.array(*map(row, metrics))))


def betas(alignment: DataFrame, metric: str, values: tuple[float, ...]) -> DataFrame:
    """beta, f1 of one metric for several beta, from one aggregate."""
    got = evaluate(alignment, (metric,))
    return got.select(F.explode(F.array(*[F.struct(F.lit(b).alias("beta"), fbeta(F.col("precision"), F.col("recall"), b).alias("f1")) for b in values])).alias("x")).select("x.*")


def report(scores: DataFrame) -> DataFrame:
    """line: the scores as a console report shows them, in hundredths, ordered by metric name."""
    pct = lambda c: F.format_string("%.2f", F.round(100 * F.col(c), 2))
    return scores.orderBy("metric").select(F.concat(F.rpad("metric", 10, " "), F.lit(" Recall: "), pct("recall"), F.lit("  Precision: "), pct("precision"), F.lit("  F1: "), pct("f1")).alias("line"))


def conll(alignment: DataFrame) -> DataFrame:
    """conll: mean F1 of MUC, B-cubed and CEAFe."""
    return evaluate(alignment, ("muc", "b3", "ceafe")).agg((F.sum("f1") / 3).alias("conll"))


def pairwise(alignment: DataFrame) -> DataFrame:
    """Pooled pairwise recall, precision, f1 in closed form: no pair is built."""
    cells = contingency(alignment)
    tp = cells.where("key is not null and sys is not null").agg(F.sum(pairs_of(F.col("n"))).alias("tp"))
    key = alignment.where("key is not null").groupBy("doc", "key").count().agg(F.sum(pairs_of(F.col("count"))).alias("key_pairs"))
    sys = alignment.where("sys is not null").groupBy("doc", "sys").count().agg(F.sum(pairs_of(F.col("count"))).alias("sys_pairs"))
    s = tp.crossJoin(key).crossJoin(sys)  # one row each
    r, p = ratio(F.col("tp"), F.col("key_pairs")), ratio(F.col("tp"), F.col("sys_pairs"))
    return s.select(F.coalesce("tp", F.lit(0)).alias("tp"), "key_pairs", "sys_pairs", r.alias("recall"), p.alias("precision"), fbeta(p, r).alias("f1"))


def drop_singletons(mentions: DataFrame, doc: str, cluster: str) -> DataFrame:
    """Mentions of clusters of two or more."""
    return mentions.withColumn("_n", F.count("*").over(W.partitionBy(doc, cluster))).where("_n > 1").drop("_n")


def identification(key: DataFrame, sys: DataFrame, on: list[str]) -> DataFrame:
    """Recall, precision, f1 of distinct items found on both sides (non-referring markables)."""
    k, s = key.select(*on).distinct().withColumn("_k", F.lit(1)), sys.select(*on).distinct().withColumn("_s", F.lit(1))
    c = k.join(s, on, "full").agg(F.count_if(F.col("_k").isNotNull() & F.col("_s").isNotNull()).alias("tp"), F.count("_k").alias("nk"), F.count("_s").alias("ns"))
    r, p = ratio(F.col("tp"), F.col("nk")), ratio(F.col("tp"), F.col("ns"))
    return c.select("tp", r.alias("recall"), p.alias("precision"), fbeta(p, r).alias("f1"))
