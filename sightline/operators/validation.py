"""Classifier validation from few labels: weighted estimates and adaptive importance sampling."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import Tag
from .annotations import any_tag
from .indexing import checkpointed
from .items import predicted
from .ranking import best, ranked

ALPHA = 0.5


def merged_weights(sample: DataFrame) -> DataFrame:
    """Rows drawn several times once, weights added."""
    return sample.groupBy("item_id").agg(F.first("label").alias("label"), F.first("score").alias("score"), F.sum("weight").alias("weight"))


def estimates(sample: DataFrame) -> DataFrame:
    """One row from (item_id, label boolean, score, weight): precision, recall and f1 with standard deviations, and counts.

    Each is a weighted mean of agreement, with weights on predicted positives, on real ones, or half each; it takes a
    handful of sums in one pass. What is undefined (no weight, or one row with all of it) is null.
    """
    hit, real = predicted(F.col("score")), F.col("label")
    right = (hit == real).cast("double")
    kinds = {"precision": hit.cast("double"), "recall": real.cast("double"), "f1": 0.5 * hit.cast("double") + 0.5 * real.cast("double")}
    sums = [F.count("*").cast("double").alias("n"), F.count_if(hit & ~real).alias("num_fp"), F.count_if(~hit & real).alias("num_fn")]
    for name, share in kinds.items():
        w = F.col("weight") * share
        sums += [F.sum(w).alias(f"{name}_0"), F.sum(w * right).alias(f"{name}_1"), F.sum(w * w).alias(f"{name}_2"), F.sum(w * w * right).alias(f"{name}_3")]
    row = merged_weights(sample).agg(*sums)
    out: list[Column] = []
    for name in kinds:
        s0, s1, s2, s2c = (F.col(f"{name}_{k}") for k in range(4))
        mean = F.try_divide(s1, s0)
        spread = ((1 - mean) * (1 - mean) * s2c + mean * mean * (s2 - s2c)) / F.col("n")
        weight = F.try_divide(s0, F.col("n")) * F.try_divide(s0, F.col("n")) * (1 - F.try_divide(s2, s0 * s0))
        out += [mean.alias(name), (F.sqrt(F.try_divide(spread, F.when(weight > 0, weight))) / F.sqrt("n")).alias(f"{name}_std")]
    return row.select(*out, F.col("n").cast("long").alias("num_labeled"), "num_fp", "num_fn")


def false_positives(sample: DataFrame) -> DataFrame:
    """With ``rank``: the surest first."""
    return ranked(sample.where(predicted(F.col("score")) & ~F.col("label")), [F.desc("score"), F.col("item_id")])


def false_negatives(sample: DataFrame) -> DataFrame:
    """With ``rank``: those of the lowest score first."""
    return ranked(sample.where(~predicted(F.col("score")) & F.col("label")), [F.col("score"), F.col("item_id")])


def metric_sample(labels: DataFrame, weights: DataFrame, scores: DataFrame) -> DataFrame:
    """Labelled items with their weight and score; those without either are left out."""
    return labels.join(weights.select("item_id", "weight"), "item_id").join(scores.select("item_id", "score"), "item_id")


def validation_examples(items: DataFrame, annotations: DataFrame, positive: list[Tag], negative: list[Tag], augment: list[Tag] = (), model: str | None = None) -> DataFrame:
    """(item_id, label) of the val split: true with any positive tag, else false with a negative or augmenting one, or as the
    other negatives of a model's active validation."""
    others = [*negative, *augment, *([(f"active:{model}", "NEGATIVE")] if model else [])]
    found = annotations.groupBy("item_id").agg(F.bool_or(any_tag(positive)).alias("label"), F.bool_or(any_tag(others)).alias("other")).where("label or other")
    return items.where("is_val").select("item_id").join(found.select("item_id", "label"), "item_id")


def calibrate(known: DataFrame):
    """A monotone map from score to the share of true labels; None without known rows. Outside the scores seen it is flat."""
    rows = known.select(array_to_vector(F.array(F.col("score").cast("double"))).alias("features"), F.col("label").cast("double").alias("label"))
    return IsotonicRegression().fit(rows) if rows.take(1) else None


def calibrated(model, scores: DataFrame, out: str = "p") -> DataFrame:
    vector = scores.withColumn("features", array_to_vector(F.array(F.col("score").cast("double"))))
    return model.transform(vector).withColumnRenamed("prediction", out).drop("features")


def sawade_weight(p: Column, hit: Column, g: float, alpha: float = ALPHA) -> Column:
    """How much a row is worth labelling, given its chance ``p`` of being positive and the F estimate ``g`` so far."""
    p = 0.98 * p + 0.01
    w1 = F.sqrt(p * (1 - F.lit(g)) * (1 - F.lit(g)) + (alpha * F.lit(g)) * (alpha * F.lit(g)) * (1 - p))
    w0 = (1 - alpha) * F.sqrt(p * F.lit(g) * F.lit(g))
    return F.when(hit, w1).otherwise(w0)


def uniform(i: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) for each row number: 52 bits of a hash, the same however rows are spread over tasks."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", i.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double")
    return bits / float(1 << 52)


#: Weights are rounded to so small a part of the largest that their sums are exact; a block's sum stays within a long.
UNIT = 1 << 40
#: Draws whose places are sent to all tasks at most, 16 MB; more are sorted among the rows.
SENT_DRAWS = 1 << 21


def _in_blocks(weights: DataFrame, unit: int) -> DataFrame:
    """(item_id, share, part, block, before): rows of some weight in order of item_id, and the sum of shares before each in its block.

    A block are the next rows of a partition, so few that their shares can't exceed a long.
    """
    most = weights.agg(F.max("w").alias("most"))
    whole = F.floor(F.coalesce(F.try_divide(F.col("w"), F.col("most")), F.lit(0.0)) * float(unit)).cast("long")
    rows = weights.crossJoin(F.broadcast(most)).select("item_id", whole.alias("share")).where("share > 0").withColumn("_tie", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("item_id", "_tie").sortWithinPartitions("item_id", "_tie").select("item_id", "share", F.spark_partition_id().alias("part"))
    size = max(1, (1 << 62) // unit)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = before = 0
        for batch in batches:
            while batch.num_rows:
                now = batch.slice(0, size - seen % size)
                share = now.column("share").to_numpy()
                ends = before + share.cumsum()
                block = pa.array(np.full(now.num_rows, seen // size))
                yield pa.RecordBatch.from_arrays([*now.columns, block, pa.array(ends - share)], ["item_id", "share", "part", "block", "before"])
                seen += now.num_rows
                before = 0 if seen % size == 0 else int(ends[-1])
                batch = batch.slice(now.num_rows)

    return checkpointed(rows.mapInArrow(add, T.StructType([*rows.schema, T.StructField("block", T.LongType()), T.StructField("before", T.LongType())])))


def _drawn_places(draws: DataFrame, total: int, starts: list[int]) -> DataFrame:
    """(draw, no, at): of each draw (draw, u) the number of the block that holds the place u * total, and the place in it."""

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [int(u * float(total)) for u in batch.column("u").to_pylist()]
            no = [bisect_right(starts, x) - 1 for x in places]
            at = pa.array([x - starts[k] for x, k in zip(places, no, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("draw"), pa.array(no, pa.int64()), at], ["draw", "no", "at"])

    return draws.mapInArrow(locate, "draw long, no long, at long")


def weighted_draws(weights: DataFrame, m: int, seed: int = 0, unit: int = UNIT, sent: int = SENT_DRAWS) -> DataFrame:
    """``m`` draws with replacement of rows (item_id, w), with chance proportional to w: (item_id, weight = 1/(chance·m)).

    Weights are summed up over all rows in order of item_id, which gives each row an interval of [0, total). They are
    rounded to a ``unit``-th of the largest, so that the sums are exact; a place is a block of rows and a place in the
    block, so that no sum exceeds a long, however many rows there are. The driver holds a number for each block (a
    partition or four million rows). The places of up to ``sent`` draws are sent to all tasks, which look up those in
    their own blocks; more draws and the intervals are put in one order by range partitioning, where each draw takes the
    last interval that begins before it: in its own partition or, at the beginning of one, in those before. Either way a
    row of great weight is no more than one row beside its many draws.
    """
    spark = weights.sparkSession
    placed = _in_blocks(weights, unit)
    sums = placed.groupBy("part", "block").agg(F.sum("share").alias("s")).collect()  # a row a block
    blocks = sorted((r["part"], r["block"], r["s"]) for r in sums)
    starts = [0, *accumulate(s for *_, s in blocks)]
    total = starts.pop()
    numbered = {(part, block): k for k, (part, block, _) in enumerate(blocks)}
    worth = (F.lit(float(total)) / (F.col("share") * F.lit(float(m)))).alias("weight")
    if not total or m <= 0:
        return placed.where(F.lit(False)).select("item_id", F.lit(0.0).alias("weight"))
    draws = _drawn_places(spark.range(m).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("u")), total, starts)
    if m <= sent:
        places = draws.select("no", "at").toArrow()
        no, at = (places.column(c).to_numpy() for c in ("no", "at"))
        order = np.lexsort((at, no))
        cuts = np.searchsorted(no[order], np.arange(len(blocks) + 1))
        own = {k: at[order[cuts[n] : cuts[n + 1]]] for k, n in numbered.items() if cuts[n + 1] > cuts[n]}

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part, block, before, share = (batch.column(c).to_numpy() for c in ("part", "block", "before", "share"))
                for a, b in pairwise([*np.flatnonzero(np.append(True, (block[1:] != block[:-1]) | (part[1:] != part[:-1]))[: len(block)]), len(block)]):
                    found = own.get((int(part[a]), int(block[a])))
                    if found is not None:
                        times = np.searchsorted(found, before[a:b] + share[a:b]) - np.searchsorted(found, before[a:b])
                        yield batch.select(["item_id", "share"]).take(pa.array(np.repeat(np.arange(a, b), times)))

        hits = placed.mapInArrow(take, T.StructType([placed.schema["item_id"], placed.schema["share"]]))
        return hits.select("item_id", worth)
    numbers = spark.createDataFrame([(*k, n) for k, n in numbered.items()], "part int, block long, no long")
    row = F.struct("item_id", "share")
    both = placed.join(F.broadcast(numbers), ["part", "block"]).select("no", F.col("before").alias("at"), F.lit(-1).cast("long").alias("draw"), row.alias("row"))
    both = both.unionByName(draws, allowMissingColumns=True).repartitionByRange("no", "at", "draw").sortWithinPartitions("no", "at", "draw")
    both = checkpointed(both.withColumn("_part", F.spark_partition_id()))
    ends = both.where("draw < 0").groupBy("_part").agg(F.max_by("row", F.struct("no", "at")).alias("end"))
    before = both.select("_part").distinct().join(ends, "_part", "left")
    before = before.select("_part", F.last("end", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("end"))  # a row per partition
    inside = F.last("row", True).over(Window.partitionBy("_part").orderBy("no", "at", "draw").rowsBetween(Window.unboundedPreceding, 0))
    hit = both.withColumn("hit", inside).where("draw >= 0").join(F.broadcast(before), "_part").select(F.coalesce("hit", "end").alias("hit"))
    return hit.select("hit.*").select("item_id", worth)


def draw_sample(pool: DataFrame, known: DataFrame, budget: int, g: float, alpha: float = ALPHA, seed: int = 0, exclude_known: bool = False) -> DataFrame:
    """(item_id, weight): all known rows with weight 1, then draws from the pool up to the budget.

    pool: (item_id, score); known: (item_id, label, score). The chance of a draw follows the calibrated worth of a row, and
    is even without known rows or worth. With more known rows than budget only these are returned.
    """
    ones = known.select("item_id", F.lit(1.0).alias("weight"))
    n = known.count()
    if n > budget:
        return ones
    rows = pool.join(known.select("item_id"), "item_id", "left_anti") if exclude_known else pool
    model = calibrate(known)
    even = rows.select("item_id", F.lit(1.0).alias("w"))
    if model is None:
        weights = even
    else:
        weights = calibrated(model, rows).select("item_id", sawade_weight(F.col("p"), predicted(F.col("score")), g, alpha).alias("w"))
        weights = weights if (weights.agg(F.sum("w")).first()[0] or 0) > 0 else even
    return ones.unionByName(weighted_draws(weights, budget - n, seed)) if budget > n else ones


def active_validation(scores: DataFrame, known: DataFrame, f1: float, seed: int = 0) -> DataFrame:
    """(item_id, weight) to label next: val items (item_id, score) by worth, within a domain around the predicted positives."""
    counts = scores.agg(F.count("*").alias("n"), F.count_if(predicted(F.col("score"))).alias("positive")).first()
    budget = max(2 * known.count(), 10)
    t = int(3 * (math.log2(budget / 10) + 1) * counts["positive"])
    domain = best(scores, t) if t < counts["n"] else scores
    drawn = checkpointed(draw_sample(domain, known, budget, f1, ALPHA, seed))
    scaled = drawn.withColumn("weight", F.col("weight") * (drawn.count() / counts["n"])) if counts["n"] else drawn
    mine = known.select("item_id", F.lit(True).alias("known")).distinct()
    # a known row's own weight overrides that of a draw
    merged = scaled.join(mine, "item_id", "left").groupBy("item_id").agg(F.min("weight").alias("least"), F.max("weight").alias("most"), F.bool_or("known").alias("known"))
    one = F.lit(drawn.count() / counts["n"] if counts["n"] else 1.0)
    return merged.select("item_id", F.when(F.col("known"), one).otherwise(F.col("most")).alias("weight"), F.coalesce("known", F.lit(False)).alias("labelled"))


def to_request(drawn: DataFrame) -> DataFrame:
    """Of what was drawn, the distinct items without a label yet."""
    return drawn.where("not labelled").select("item_id", "weight").dropDuplicates(["item_id"])


def labels_asked(drawn: DataFrame) -> DataFrame:
    """One row: how many draws there were, and of how many distinct items, which is what labelling them costs."""
    return drawn.agg(F.count("*").alias("num_draws"), F.count_distinct("item_id").alias("num_labeled"))


def ais_loop(scores: DataFrame, truth: DataFrame, budget: int, seed: int = 0) -> dict[str, float]:
    """Estimates F1 with about ``budget`` labels: rounds of doubling size, each drawn by what the last ones taught.

    scores: (item_id, score); truth: (item_id, label), which stands for the person who labels what is drawn. Of each round
    only an aggregate row comes to the driver. Returns f1, its deviation and the number of distinct items labelled.
    """
    rounds = int(math.log2(max(budget, 10) / 10)) + 1
    g, found, seen = 0.5, [], None
    everything = scores.join(truth, "item_id")
    for i in range(rounds):
        size = budget if i == rounds - 1 else 10 * 2**i
        known = everything.limit(0) if seen is None else everything.join(seen, "item_id", "left_semi")
        drawn = checkpointed(draw_sample(scores, known, size, g, ALPHA, seed + i))
        sample = drawn.join(everything, "item_id")
        e = estimates(sample).first()
        weight = sample.agg(F.sum(F.col("weight") * (0.5 * predicted(F.col("score")).cast("double") + 0.5 * F.col("label").cast("double")))).first()[0] or 0.0
        if e["f1"] is not None:
            g = 0.5 * g + 0.5 * e["f1"]
            found.append((e["f1"], e["f1_std"] or 0.0, weight + 1e-4))
        ids = drawn.select("item_id").distinct()
        seen = ids if seen is None else checkpointed(seen.union(ids).distinct())
    last = found[-4:]
    total = sum(w for *_, w in last)
    return {
        "f1": sum(f * w for f, _, w in last) / total if last else float("nan"),
        "f1_std": math.sqrt(sum((s * w / total) ** 2 for _, s, w in last)) if last else float("nan"),
        "num_labeled": seen.count() if seen is not None else 0,
    }
