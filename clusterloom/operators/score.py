"""Pair scorers: supplied logits, a lexical surrogate, and a trained logistic model over lexical features."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A scorer turns pairs with text_a and text_b into the same pairs with a logit.
Scorer = Callable[[DataFrame], DataFrame]


FEATURES = ("jaccard", "contained", "length")


def lexical_features(a: Column, b: Column) -> list[Column]:
    """Word Jaccard, containment and length ratio of two texts."""
    wa, wb = (F.array_distinct(F.array_remove(F.split(F.lower(x), r"[^\p{L}\p{N}]+"), "")) for x in (a, b))
    both = F.size(F.array_intersect(wa, wb)).cast("double")
    na, nb = F.size(wa), F.size(wb)
    safe = lambda n, d: F.coalesce(F.try_divide(n, d.cast("double")), F.lit(0.0))
    return [safe(both, na + nb - both).alias("jaccard"), safe(both, F.least(na, nb)).alias("contained"), safe(F.least(na, nb).cast("double"), F.greatest(na, nb)).alias("length")]


def lexical_scorer(pairs: DataFrame) -> DataFrame:
    """Fixed weights; deterministic."""
    f = lexical_features(F.col("text_a"), F.col("text_b"))
    return pairs.select("*", *f).withColumn("logit", -4.0 + 6.0 * F.col("jaccard") + 2.0 * F.col("contained")).drop("jaccard", "contained", "length")


def _features(df: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    pack = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    return pack.transform(df.select("*", *lexical_features(F.col("text_a"), F.col("text_b"))))


def _scorer(model) -> Scorer:
    """The margin of a fitted model as a plain expression, so scoring stays in generated code."""
    weights, bias = [float(w) for w in model.coefficients], float(model.intercept)

    def score(pairs: DataFrame) -> DataFrame:
        f = lexical_features(F.col("text_a"), F.col("text_b"))
        margin = sum((F.lit(w) * F.col(c) for w, c in zip(weights, FEATURES, strict=True)), F.lit(bias))
        return pairs.select("*", *f).withColumn("logit", margin).drop(*FEATURES)

    return score


def train_scorer(labelled: DataFrame, max_iter: int = 20, path: str | None = None) -> Scorer:
    """Logistic regression over lexical features of text_a, text_b, label pairs; with a path the model is saved there."""
    from pyspark.ml.classification import LogisticRegression

    model = LogisticRegression(maxIter=max_iter, labelCol="label").fit(_features(labelled.withColumn("label", F.col("label").cast("double"))))
    if path:
        save_scorer(model, path)
    return _scorer(model)


def arrow_scorer(function: Callable[[list[str], list[str]], list[float]], batch: int = 64) -> Scorer:
    """Scorer of a Python function from two lists of texts to logits, which gets at most `batch` pairs at a time.

    Rows come in Arrow batches; the function is pickled to the workers, so a model is loaded there, once a worker.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            left, right = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text_a", "text_b"))
            logits = [float(z) for lo in range(0, len(left), batch) for z in function(left[lo : lo + batch], right[lo : lo + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(logits, pa.float64())], [*b.schema.names, "logit"])

    def score(pairs: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{c}` {t}" for c, t in pairs.dtypes)
        return pairs.mapInArrow(run, f"{schema}, logit double")

    return score


def save_scorer(model, path: str) -> None:
    """Writes the fitted model of `train_scorer` to a folder that all executors share."""
    model.write().overwrite().save(path)


def load_scorer(path: str) -> Scorer:
    from pyspark.ml.classification import LogisticRegressionModel

    return _scorer(LogisticRegressionModel.load(path))


def validation_f1(scored: DataFrame) -> float:
    """F1 of logit >= 0 on labelled pairs; 0 without any."""
    hit = F.col("logit") >= 0
    tp, fp, fn = scored.agg(F.count_if(hit & (F.col("label") == 1)), F.count_if(hit & (F.col("label") == 0)), F.count_if(~hit & (F.col("label") == 1))).first()
    return 2 * tp / (2 * tp + fp + fn) if tp else 0.0


def dump_scores(scored: DataFrame) -> DataFrame:
    """topic_id, n, edges: pair logits of a topic in one row, i-major."""
    edges = F.array_sort(F.collect_list(F.struct(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("logit").cast("double").alias("logit"))))
    return scored.groupBy(F.col("topic").alias("topic_id")).agg((F.max("j") + 1).cast("int").alias("n"), edges.alias("edges"))
