"""Document quality by a sparse ensemble of rules over text statistics."""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.indexing import checkpointed

from .common import ship
from .shingles import bytes_of, small_batches, word_bounds, word_hashes

#: Labelled documents that the rules are learnt from at most; those with the smallest hash of their id.
MOST_LABELLED = 20_000
THRESHOLD = 0.3
FOLDS = 5

#: Byte classes whose shares of a text are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "symbol": b"#$%&*+/<=>@\\^_`{}~",
    "bracket": b"()[]\"'-",
}
STATISTICS = (
    *(f"share_{x}" for x in CLASSES), "share_high", "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "distinct_words", "top_word", "share_short", "share_long",
    "line_words", "distinct_lines", "repeated_lines", "bytes_per_stop",
)

_CLASS = np.zeros(256, np.uint8)
for _k, _chars in enumerate(CLASSES.values()):
    _CLASS[list(_chars)] = _k + 1
_CLASS[128:] = len(CLASSES) + 1


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each text; all finite, also for null and empty texts."""
    data, edges = bytes_of(texts)
    n, kinds = len(edges) - 1, len(CLASSES) + 2
    size = np.diff(edges)
    counts = np.zeros((n, kinds), np.int64)
    for i in range(n):
        for a in range(edges[i], edges[i + 1], 1 << 20):  # of a long text a part at a time
            counts[i] += np.bincount(_CLASS[data[a : min(a + (1 << 20), edges[i + 1])]], minlength=kinds)
    counts = counts[:, 1:]
    shares = counts / np.maximum(size, 1)[:, None]
    starts, ends = word_bounds(data, edges)
    bounds = np.searchsorted(starts, edges)
    lengths, words = (ends - starts).astype(float), np.diff(bounds)
    hashes = word_hashes(data, starts, ends)
    many = np.maximum(words, 1)

    def per_doc(values: np.ndarray) -> np.ndarray:
        sums = np.append(0.0, np.cumsum(values, dtype=float))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    mean = per_doc(lengths) / many
    spread = np.sqrt(np.maximum(0, per_doc(lengths**2) / many - mean**2))
    distinct, top, lines, fresh, twice = (np.zeros(n) for _ in range(5))
    breaks = np.flatnonzero(data == 10)
    line_at = np.searchsorted(breaks, edges)
    for i in range(n):
        own = np.sort(hashes[bounds[i] : bounds[i + 1]])
        if len(own):
            runs = np.diff(np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)))
            distinct[i], top[i] = len(runs), runs.max()
        cuts = np.concatenate([[edges[i] - 1], breaks[line_at[i] : line_at[i + 1]], [edges[i + 1]]])
        parts = [data[a + 1 : b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b - a > 20]
        lines[i], fresh[i] = len(cuts) - 1, len(set(parts)) / max(1, len(parts)) if parts else 1
        twice[i] = len(parts) - len(set(parts))
    return np.column_stack([
        shares, np.log1p(size), np.log1p(words), mean, spread, distinct / np.maximum(1, words) ** 0.9, top / many, per_doc(lengths <= 3) / many, per_doc(lengths >= 14) / many,
        words / np.maximum(lines, 1), fresh, np.log1p(twice), np.log1p(size / (1 + counts[:, list(CLASSES).index("stop")])),
    ])


def with_statistics(docs: DataFrame, text_col: str = "text", out: str = "statistics") -> DataFrame:
    """The rows with an array of their text's statistics added; columns pass through as they are."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_col):
            values = statistics(batch.column(text_col))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], [*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(out, T.ArrayType(T.DoubleType()))]))


Rule = tuple[tuple[int, bool, float], ...]  # of statistic, whether at most (else above), bound


def tree_rules(description: str) -> list[Rule]:
    """The paths from the root to every node of a printed tree, each a conjunction; bounds on one statistic are joined."""
    found, path = [], []
    for line in description.splitlines():
        m = re.match(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, (int(m[3]), m[4] == "<=", float(m[5])))]
        tight: dict[tuple[int, bool], float] = {}
        for _, (k, most, bound) in path:
            tight[k, most] = (min if most else max)(bound, tight.get((k, most), bound))
        found.append(tuple((k, most, bound) for (k, most), bound in sorted(tight.items())))
    return found


def holds(rule: Rule, values: Column) -> Column:
    return reduce(lambda a, b: a & b, [values[k] <= bound if most else values[k] > bound for k, most, bound in rule])


class RuleEnsemble:
    """Weighted rules, and the score that they give as one column expression."""

    def __init__(self, rules: list[tuple[Rule, float]], intercept: float):
        self.rules, self.intercept = rules, intercept

    def score(self, values: Column) -> Column:
        total = reduce(lambda a, b: a + b, [F.when(holds(rule, values), weight).otherwise(0.0) for rule, weight in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        return "\n".join(f"{w:+.3f}  " + " and ".join(f"{STATISTICS[k]} {'<=' if m else '>'} {b:.4g}" for k, m, b in r) for r, w in sorted(self.rules, key=lambda x: -abs(x[1])))


def fit(labelled: DataFrame, label_col: str = "label", trees: int = 16, depth: int = 3, penalty: float = 0.001) -> RuleEnsemble:
    """Learns the ensemble from rows of ``statistics`` and a 0/1 label.

    A random forest of small trees proposes rules: each path from a root is one. Rules that hold for almost all or almost
    no rows go. A logistic model over the rules' 0/1 values with an L1 penalty gives most rules no weight; what is left is
    the ensemble. With rows of one label only, the score is constant.
    """
    rows = labelled.select(F.col(label_col).cast("double").alias("label"), "statistics").persist()
    try:
        counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if len(counts) < 2:
            return RuleEnsemble([], 3.0 if counts.get(1.0) else -3.0 if counts else 0.0)
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="0.5", subsamplingRate=0.8, minInstancesPerNode=5)
        model = forest.fit(rows.select("label", array_to_vector("statistics").alias("features")))
        rules = list(dict.fromkeys(r for t in model.trees for r in tree_rules(t.toDebugString)))
        total = sum(counts.values())
        support = rows.select([F.sum(F.when(holds(r, F.col("statistics")), 1).otherwise(0)).alias(f"r{k}") for k, r in enumerate(rules)]).first()
        rules = [r for r, n in zip(rules, support, strict=True) if 0.002 * total <= n <= 0.998 * total]
        if not rules:
            share = counts[1.0] / total
            return RuleEnsemble([], math.log(share / (1 - share)))
        hits = array_to_vector(F.array(*[F.when(holds(r, F.col("statistics")), 1.0).otherwise(0.0) for r in rules]))
        lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False)
        fitted = lasso.fit(rows.select("label", hits.alias("features")))
        return RuleEnsemble([(r, float(w)) for r, w in zip(rules, fitted.coefficients, strict=True) if abs(w) > 1e-6], float(fitted.intercept))
    finally:
        rows.unpersist()


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from: crc32 of the id as text, modulo the number of folds, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", most: int = MOST_LABELLED) -> RuleEnsemble:
    """Fits on at most ``most`` labelled documents outside the held-out fold; the same ones in every run.

    Of rows that repeat an id, that with the least hash of its text is learnt from, so no document counts more than others.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col(id_col).isNotNull())
    known = known.where(~held_out(F.col(id_col))).groupBy(id_col).agg(F.max("label").alias("label"))
    known = known.orderBy(F.xxhash64(id_col), id_col).limit(most)
    rows = docs.select(id_col, "text").join(F.broadcast(known), id_col)  # at most ``most`` narrow rows
    rows = with_statistics(rows.withColumn("h", F.xxhash64("text"))).select(id_col, "label", F.struct("h", "statistics").alias("row"))
    # tasks send a row an id, however often it is repeated
    found = checkpointed(rows.groupBy(id_col, "label").agg(F.min("row").alias("row")).select(id_col, "label", "row.statistics"))
    # at most ``most`` rows of a few numbers: in one task and one order, what is learnt doesn't depend on how documents are dealt
    return fit(found.repartition(1).sortWithinPartitions(F.xxhash64(id_col), id_col, "statistics"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Scores every document with rules learnt from the labels outside the held-out fold.

    Statistics of whole texts are computed in one pass; the rules are column expressions over them. Null and empty texts
    are scored as empty texts; without usable labels all scores are 0.5. Repeated rows are scored each, rows with a null
    id too, as not held out. Further columns are ignored. Nothing but the labelled ids, at most ``MOST_LABELLED``, is
    broadcast; documents aren't shuffled.

    Returns: the id, held_out, score, predicted.
    """
    model = learn(docs, labels, id_col=id_col)
    score = model.score(F.col("statistics"))
    found = with_statistics(docs.select(id_col, "text")).select(id_col, held_out(F.col(id_col)).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns kept as they are, without those that the rules reject."""
    model = learn(docs, labels, id_col=id_col)
    own = f"statistics_{uuid.uuid4().hex}"  # no column of the documents has this name
    return with_statistics(docs, out=own).where(model.score(F.col(own)) >= threshold).select(docs.columns)
