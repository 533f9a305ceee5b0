"""Mixing documents to target domain weights by soft membership.

Domains are the classes of the labelled table: good (quality 1, not toxic), poor (quality 0,
not toxic) and toxic.  One sparse logistic model a domain, learnt from at most `max_rows`
labelled documents, gives posteriors p that sum to 1.  With t the tokens of a document
and T those of all, rates r solve

    min  e' W e,   e_k = sum_d r_d t_d p_dk / T - scale * w_k,   r_d >= lower_d

by projected gradient steps r <- max(lower, r - h p' V e) from r = 1, where V is W or the same inverse over the
documents that the step can move, and V and h the best of a few.  W is the inverse of sum_d t_d p_d p_d' / T + RIDGE over all
documents, so it grows no further where documents hardly differ: a target that no document's posterior comes near costs
little, instead of rates that repeat the corpus for the sake of traces, and the other targets are met.  Steps go on until every domain is within TOLERANCE of its target or the objective stands still (targets that
no such rates can meet).  A step is two aggregates over the documents; only sums over domains reach the driver, and rates are
recomputed from their history, which is written down every SETTLE steps.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clusterloom.llm.text_arrays import U, chunks, mix, prefix_hash, scan
from clusterloom.llm.toxicity import BITS, Ftrl, fit
from clusterloom.operators.durable import Workspace, settle

DOMAINS = ("good", "poor", "toxic")
WEIGHTS = (0.94, 0.03, 0.03)
#: Largest distance of a domain's share from its target at which a fit is done.
TOLERANCE = 1e-4
#: Added to the mean square of posteriors along each direction.  It weighs errors that no rates remove against each other; targets that can be met are met with any.
RIDGE = 1e-3
#: SETTLE steps that lower the objective by less than this share end a fit that cannot meet its targets.
STILL = 0.02
#: Steps after which rates are written down.
SETTLE = 8
#: Lengths of a step in the metric of the documents that it can move, and in that of all.
MOVABLE, ALL = (1.0, 0.5, 0.25, 0.125, 0.03), (1.0, 4.0, 16.0, 64.0)
MODEL = Ftrl(alpha=3.0, l1=8.0, l2=0.1, epochs=2)


def features(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, rows, coordinates, row of each, words of each row): words, their first and last bytes."""
    for row, last, data, bounds in chunks(texts):
        w = scan(data, bounds, lower=True)
        doc = w.document()
        total, down = prefix_hash(w.data)
        parts, owners = [w.hash], [doc]
        for k in (4, 5):
            keep = w.end - w.start > k
            at = w.start[keep]
            parts.append(mix((total[at + k] - total[at]) * down[at] + U(k)))
            owners.append(doc[keep])
        keep = w.end - w.start > 2
        at = w.end[keep] - 2
        parts.append(mix((total[at + 2] - total[at]) * down[at] + U(99)))
        owners.append(doc[keep])
        yield row, last - row, (np.concatenate(parts) >> U(64 - BITS)).astype(np.int32), np.concatenate(owners), w.counts


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, n, at, owner, _ in features(batch.column(2)):
            cells = np.unique(owner.astype(np.int64) << 32 | at)
            first = np.searchsorted(cells, np.arange(n + 1) << 32)
            at = (cells & 0xFFFFFFFF).astype("<u4")
            blobs = pa.array([at[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), blobs], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """One model a domain from the max_rows labelled documents of least hash; without any, models of bias 0.

    Rows with a null id or quality are left out; null toxic is 0; a document labelled twice takes its
    largest toxic and least quality.
    """
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max(F.coalesce(F.col("toxic").cast("int"), F.lit(0))).alias("t"), F.min(F.col("quality").cast("int")).alias("q"))
        .select("doc_id", F.when(F.col("t") == 1, 2).when(F.col("q") == 0, 1).otherwise(0).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(marks), "doc_id")
    table = rows.select("doc_id", "y", "text").mapInArrow(_sparse, "doc_id long, y int, x binary").toArrow()
    held = sorted(zip(table["doc_id"].to_pylist(), table["x"].to_pylist(), table["y"].to_pylist(), strict=True))
    order = np.random.default_rng(0).permutation(len(held))
    return [fit([(np.frombuffer(held[i][1], "<u4"), int(held[i][2] == k)) for i in order], MODEL) for k in range(len(DOMAINS))]


def _posteriors(models: list[tuple[np.ndarray, np.ndarray, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    at = np.unique(np.concatenate([m[0] for m in models]))
    weight = np.zeros((len(models), len(at)))
    for k, (x, w, _) in enumerate(models):
        weight[k, np.searchsorted(at, x)] = w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(1 << BITS, bool)
        known[at] = True
        for batch in batches:
            for row, n, x, owner, words in features(batch.column(1)):
                hit = known[x]
                cells = np.unique(owner[hit].astype(np.int64) << 32 | x[hit])
                own, place = cells >> 32, np.searchsorted(at, cells & 0xFFFFFFFF)
                z = np.stack([np.bincount(own, weight[k, place], minlength=n) + models[k][2] for k in range(len(models))]) if len(cells) else np.repeat([[m[2]] for m in models], n, 1)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                p /= p.sum(0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array(words.astype(np.int64) + 1), *map(pa.array, p)], ["doc_id", "n_tokens", *DOMAINS])

    return run


def posteriors(docs: DataFrame, models: list[tuple[np.ndarray, np.ndarray, float]]) -> DataFrame:
    """(doc_id, n_tokens, good, poor, toxic) for each row; tokens are words and one end mark."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_posteriors(models), "doc_id long, n_tokens long, " + ", ".join(f"{d} double" for d in DOMAINS))


def fit_rates(soft: DataFrame, weights: tuple[float, ...] = WEIGHTS, keep: str | None = None) -> tuple[DataFrame, dict[str, float]]:
    """(soft with its rate, figures: steps, residual, objective, scale), settled.

    weights are scaled to sum 1; the expected tokens of each domain are to be its weight of all tokens.  With keep, documents
    at least half in that domain have rates of 1 or more, and the total grows just so far that the domain can keep its tokens.
    """
    w = np.array(weights) / sum(weights)
    k = len(DOMAINS)
    share = F.col("n_tokens")
    sums = soft.agg(F.sum("n_tokens").alias("t"), *[F.sum(share * F.col(d)).alias(f"s{i}") for i, d in enumerate(DOMAINS)], *[F.sum(share * F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(DOMAINS) for j, b in enumerate(DOMAINS)]).first()
    total = float(sums["t"] or 1)
    held = np.array([float(sums[f"s{i}"] or 0) for i in range(k)]) / total
    gram = np.array([[float(sums[f"g{i}_{j}"] or 0) for j in range(k)] for i in range(k)]) / total
    scale = max(1.0, held[DOMAINS.index(keep)] / w[DOMAINS.index(keep)]) if keep else 1.0
    inverse = np.linalg.inv(gram + RIDGE * np.eye(k))
    lower = F.when(F.col(keep) >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0)) if keep else F.lit(0.0)
    along = lambda v: sum((F.lit(float(x)) * F.col(d) for x, d in zip(v, DOMAINS, strict=True)), F.lit(0.0))
    residual = held - scale * w
    course = [float(residual @ inverse @ residual)]
    with Workspace(soft.sparkSession) as work:
        now, rate = soft.withColumn("rate", F.lit(1.0)), F.col("rate")
        while np.abs(residual).max() > TOLERANCE and sums["t"] and (len(course) <= SETTLE or course[-1] < (1 - STILL) * course[-1 - SETTLE]):
            movable = F.when((rate > lower) | (along(inverse @ residual) < 0), share)
            got = now.agg(*[F.sum(movable * F.col(DOMAINS[i]) * F.col(DOMAINS[j])).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)]).first()
            metric = np.array([[float(got[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in range(k)] for i in range(k)]) / total
            ways = [h * np.linalg.solve(metric + 1e-9 * np.eye(k), residual) for h in MOVABLE] + [h * (inverse @ residual) for h in ALL]
            tried = [F.greatest(lower, rate - along(v)) for v in ways]
            got = now.agg(*[F.sum(r * share * F.col(d)).alias(f"s{n}_{i}") for n, r in enumerate(tried) for i, d in enumerate(DOMAINS)]).first()
            ends = [np.array([float(got[f"s{n}_{i}"] or 0) for i in range(k)]) / total - scale * w for n in range(len(tried))]
            best = min(range(len(tried)), key=lambda n: float(ends[n] @ inverse @ ends[n]))
            residual, rate = ends[best], tried[best]
            course.append(float(residual @ inverse @ residual))
            if len(course) % SETTLE == 0:
                now, rate = work.table(now.withColumn("rate", rate)), F.col("rate")
        return settle(now.withColumn("rate", rate)), {"steps": len(course) - 1, "residual": float(np.abs(residual).max()), "objective": course[-1], "scale": scale}


def copies(rate: Column, key: Column) -> Column:
    """Whole copies with the rate as their expectation, by a hash of the key."""
    return F.floor(rate + F.pmod(F.xxhash64(key, F.lit(17)), F.lit(1_000_000)) / 1e6).cast("int")


def mix_rates(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rows: int = 4000, keep: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, good, poor, toxic, rate, copies, residual) for each row of docs.

    residual, alike in all rows, is the largest distance of a domain's expected share from its target.
    Null and empty texts have one token, the end mark, and the posterior of no words.  Repeated rows and ties are
    rated alike, each for itself.  Null ids stay null.  Targets that no nonnegative rates can meet are met
    as nearly as least squares allows.  An empty table gives no rows.  Other columns are ignored.
    """
    with Workspace(docs.sparkSession) as work:
        rated, figures = fit_rates(work.table(posteriors(docs, train(docs, labels, max_rows))), weights, keep)
    return rated.withColumn("copies", copies(F.col("rate"), F.col("doc_id"))).withColumn("residual", F.lit(figures["residual"]))


def mix_documents(docs: DataFrame, labels: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_rows: int = 4000, keep: str | None = None) -> DataFrame:
    """docs with each row as many times as mix_rates gives its doc_id; rows with a null id stay once.

    Rows that share an id take the most copies that any of them has.  Columns stay whatever their names.
    """
    key, times, again = (f"{c}_{uuid.uuid4().hex}" for c in ("id", "copies", "again"))
    plan = mix_rates(docs, labels, weights, max_rows, keep).where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.max("copies").alias(times))
    out = docs.join(plan, F.col("doc_id").cast("long") == F.col(key), "left")
    return out.select(*[docs[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(0), F.coalesce(times, F.lit(1)))).alias(again)).drop(again)
