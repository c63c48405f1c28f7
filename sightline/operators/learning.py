"""Training sets and linear models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import Tag
from .annotations import any_tag, tagged
from .indexing import ROWS_PER_TASK, checkpointed, few_tasks
from .items import predicted
from .partials import matrix_of, summed
from .ranking import first_rows, knn
from .solvers import lbfgs

SVM_NEGATIVES, DNN_NEGATIVES = 7, 10
SCALE = 1000.0


def training_set(items: DataFrame, annotations: DataFrame, positive: list[Tag], negative: list[Tag]) -> DataFrame:
    """(item_id, label) of the train split: 1 with any positive tag, else 0 with any negative one."""
    label = annotations.groupBy("item_id").agg(F.bool_or(any_tag(positive)).alias("pos"), F.bool_or(any_tag(negative)).alias("neg"))
    label = label.where("pos or neg").select("item_id", F.col("pos").cast("int").alias("label"))
    return items.where("not is_val").select("item_id").join(label, "item_id")


def seeded(item_id: Column, seed: int) -> Column:
    """A repeatable random key, the same in every engine."""
    return F.md5(F.concat_ws("|", item_id.cast("string"), F.lit(str(seed))))


def augmented(train: DataFrame, pool: DataFrame, factor: int = SVM_NEGATIVES, seed: int = 0) -> DataFrame:
    """Adds negatives from the pool until there are ``factor`` times as many as positives; they are a seeded sample.

    The sample are the first by a hash of the item.
    """
    counts = train.agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).first()
    extra = factor * counts["pos"] - counts["neg"]
    if extra <= 0:
        return train
    free = pool.select("item_id").join(train.select("item_id"), "item_id", "left_anti").distinct()
    chosen = first_rows(free.withColumn("_key", seeded(F.col("item_id"), seed)), extra, ["_key", "item_id"]).drop("_key")
    return train.unionByName(chosen.withColumn("label", F.lit(0)))


def buckets(annotations: DataFrame, pos: list[Tag], neg: list[Tag], val_pos: list[Tag], val_neg: list[Tag]) -> DataFrame:
    """(item_id, bucket) by the first of the four tag sets that an item matches."""
    sets = {"pos": pos, "neg": neg, "val_pos": val_pos, "val_neg": val_neg}
    found = annotations.groupBy("item_id").agg(*(F.bool_or(any_tag(tags)).alias(name) for name, tags in sets.items()))
    first = F.coalesce(*(F.when(F.col(name), F.lit(name)) for name in sets))
    return found.select("item_id", first.alias("bucket")).where("bucket is not null")


def unlabelled(items: DataFrame, annotations: DataFrame, *tag_sets: list[Tag]) -> DataFrame:
    """Train items without any tag of the sets."""
    used = tagged(annotations, [t for tags in tag_sets for t in tags]).select("item_id")
    return items.where("not is_val").join(used, "item_id", "left_anti")


def svm_loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray]:
    """The sum of squared hinges of rows ``x`` with labels of -1 and 1, and its gradient; the last weight is the intercept."""
    short = np.maximum(0, 1 - y * (x @ w[:-1] + w[-1]))
    pull = -2 * short * y
    return float(short @ short), np.append(pull @ x, pull.sum())


def fit_svm_weights(train: DataFrame, embeddings: DataFrame, c: float = 0.1, iterations: int = 200) -> np.ndarray:
    """Weights and, last, the intercept that minimise |w|²/2 + c · Σ max(0, 1 - y (w·x))², the intercept penalised like a weight.

    train: (item_id, label 0 or 1), embeddings: (item_id, embedding). Needs both labels. Vectors that are null, hold null
    or have another length than most are left out. Each step of the solver is one job: tasks sum up the loss and its
    gradient over blocks of rows, these sums are added up in groups, and a few vectors come to the driver.
    """
    rows = train.select("item_id", F.when(F.col("label") == 1, 1.0).otherwise(-1.0).alias("y")).join(embeddings.select("item_id", V.doubles(F.col("embedding")).alias("x")), "item_id")
    rows = rows.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull())).select("y", "x", F.size("x").alias("size"))
    rows = checkpointed(rows)
    counts = rows.groupBy("size", "y").count().collect()  # two rows a length
    sizes = sorted({r["size"] for r in counts}, key=lambda k: (-sum(r["count"] for r in counts if r["size"] == k), k))
    if not sizes or len([r for r in counts if r["size"] == sizes[0]]) < 2:
        raise ValueError("a positive and a negative item are needed")
    dim, n = sizes[0], sum(r["count"] for r in counts)
    tasks = -(-n // ROWS_PER_TASK)
    rows = few_tasks(rows, n).where(F.col("size") == dim).select("y", "x")

    def objective(w: np.ndarray) -> tuple[float, np.ndarray]:
        value, slope = summed(rows, lambda b: svm_loss(matrix_of(b.column("x"), dim), b.column("y").to_numpy(), w), dim + 1, tasks=tasks)
        return c * value + 0.5 * float(w @ w), c * slope + w

    return lbfgs(objective, np.zeros(dim + 1), iterations)[0]


def fit_svm(train: DataFrame, embeddings: DataFrame, c: float = 0.1, iterations: int = 200) -> list[float]:
    """Weights of a linear SVM with squared hinge loss, scaled, without the intercept; needs both labels."""
    return (fit_svm_weights(train, embeddings, c, iterations)[:-1] * SCALE).astype(np.float32).astype(float).tolist()


def svm_query(items: DataFrame, embeddings: DataFrame, weights: list[float], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Items with their dot product with the weights, scaled to [0, 1] over all embeddings, within the range."""
    one = embeddings.sparkSession.createDataFrame([(list(map(float, weights)),)], "query array<double>")
    return knn(items, embeddings, one, "dot", low, high)


def training_metrics(scored: DataFrame) -> DataFrame:
    """One row from (label, score): precision, recall, f1 and the numbers of positives and negatives; undefined ones are null."""
    hit = predicted(F.col("score"))
    real = F.col("label").cast("int") == 1
    sums = scored.agg(
        F.count_if(hit & real).cast("double").alias("tp"), F.count_if(hit).cast("double").alias("p"), F.count_if(real).alias("num_positives"), F.count_if(~real).alias("num_negatives")
    )
    precision, recall = F.try_divide("tp", "p"), F.try_divide(F.col("tp"), F.col("num_positives").cast("double"))
    return sums.select(precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"), "num_positives", "num_negatives")
