"""Chat formatting: logged conversations that others continue are dropped, the rest rendered."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.operators.indexing import counted

from .common import sent_if_small, ship

TURN = "<|im_start|>%s\n%s<|im_end|>\n"
#: Rows that a task remembers, to leave out repeated ones before the shuffle; at that number it starts anew.
REMEMBERED = 100_000
#: Hashes of turns have so many hexadecimal digits; they are rolled modulo a prime above them, to a base that is as good as any.
DIGITS, PRIME, BASE = 30, (1 << 127) - 1, 0x5851F42D4C957F2D14057B7EF767814F
#: Characters of roles and texts that tasks are parted by; only turns that agree in id, number and these stay in one task.
BEGINNING = 256


def maximal_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Collapses cumulative snapshots: a conversation that is a prefix of a longer one goes, of equal ones the least id stays.

    Each turn gets a hash of the conversation up to it, rolled from the turn before: the previous hash times a fixed base plus
    the turn's own hash, modulo a prime. Such hashes of two runs of turns give that of both, so turns are sorted over all
    tasks, and a conversation of any length is cut where a task's rows end: each task rolls the hashes of its own runs, and
    a row for each later run says how many turns came before and what their hash is. The last hash of a conversation stands
    for the whole; the others for its proper prefixes. An anti-join of the whole hashes against the distinct prefix hashes
    leaves the maximal conversations. Both sides hold a row per distinct hash only (pre-aggregated before the shuffle), so
    an opening that a third of all conversations share is one row. Texts are shuffled once; repeated rows of a task go
    before that. Runs are rendered where they are rolled; only the kept conversations that were cut are brought together.
    A conversation is one row of the result, so that row holds it whole.

    Turns are ordered by turn number, then role and text; a repeated row counts once; turns with a null number come first.
    Null roles and texts count as empty. A row with a null conversation id is a conversation of its own, of one turn, and is
    never brought together with the others; it comes with a null id where no conversation with an id says the same.
    No rows: no rows. Further columns are ignored.

    Returns: conv_id, n_turns, n_copies (conversations equal to it, itself included), text (rendered).
    """
    ship(turns.sparkSession)
    narrow = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    fp = F.substring(F.sha2(F.concat(F.sha2("role", 256), F.sha2("text", 256)), 256), 1, DIGITS)
    rows = narrow.withColumn("fp", fp)
    kind = narrow.schema["conv_id"].dataType.simpleString()
    alone = rows.where("conv_id is null").groupBy("role", "text", "fp").agg(F.count_distinct(F.struct("turn")).alias("copies"))
    alone = alone.select(F.lit(None).cast(kind).alias("conv_id"), F.lit(1).cast("long").alias("n"), F.lpad("fp", 32, "0").alias("hash"), F.format_string(TURN, "role", "text").alias("text"), "copies")

    rows = rows.where("conv_id is not null").mapInArrow(_once, rows.schema)
    # bounds of tasks are sent to the driver: the beginnings of texts, in the same order as the texts
    ordered = rows.repartitionByRange("conv_id", "turn", F.substring("role", 1, BEGINNING), F.substring("text", 1, BEGINNING)).sortWithinPartitions("conv_id", "turn", "role", "text")
    rolled, _ = counted(ordered.withColumn("part", F.spark_partition_id()).mapInArrow(_rolled, f"conv_id {kind}, part int, n long, hash string, text string"))
    runs = rolled.where("text is not null")
    cut = runs.groupBy("conv_id").agg(F.count("*").alias("runs"), F.sort_array(F.collect_list(F.struct("part", "n", "hash"))).alias("all")).where("runs > 1")
    cut, seen = counted(cut)  # at most one for each task; its list has at most a run a task
    if seen.n:
        before = cut.select("conv_id", "all").mapInArrow(_before, f"conv_id {kind}, part int, n_before long, hash_before string, last boolean")
        placed = rolled.join(F.broadcast(before), ["conv_id", "part"], "left")
        alike = placed.where("n_before is null or n_before = 0")
        later = placed.where("n_before > 0").mapInArrow(_composed, placed.schema)
        ends = alike.unionByName(later).withColumn("whole", F.col("text").isNotNull() & F.coalesce("last", F.lit(True)))
    else:
        ends = rolled.withColumn("whole", F.col("text").isNotNull())
    own = F.concat_ws(":", "n", "hash").alias("own")
    prefixes = ends.where("not whole").select(own).distinct()
    ids = ends.where("whole").select("conv_id", own, F.lit(1).cast("long").alias("copies")).unionByName(alone.select("conv_id", own, "copies"))
    least = ids.groupBy("own").agg(F.min("conv_id").alias("kept_id"), F.sum("copies").alias("n_copies"))
    kept, found = counted(least.join(prefixes, "own", "left_anti"))
    kept = kept.withColumn("n_turns", F.split_part("own", F.lit(":"), F.lit(1)).cast("long"))
    named = sent_if_small(kept.where("kept_id is not null").withColumnRenamed("kept_id", "conv_id"), found.n)
    out = ["conv_id", "n_turns", "n_copies", "text"]
    of_one = runs.join(F.broadcast(cut.select("conv_id")), "conv_id", "left_anti").join(named, "conv_id") if seen.n else runs.join(named, "conv_id")
    nameless = sent_if_small(kept.where("kept_id is null").drop("kept_id"), found.n)
    result = of_one.select(out).unionByName(alone.select("conv_id", own, "text").join(nameless, "own").select(out))
    if not seen.n:
        return result
    pieces = runs.join(F.broadcast(cut.select("conv_id")), "conv_id", "left_semi").join(named, "conv_id")
    joined = pieces.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "").alias("text"))
    return result.unionByName(joined.select(out))


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[tuple] = set()
    for batch in batches:
        new = []
        for key in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "fp")), strict=True):
            new.append(key not in seen)
            seen.add(key)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield batch.filter(pa.array(new, pa.bool_()))


def _rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's sorted turns, a row for each beginning of its run of a conversation, with the run's text for the whole run."""
    ident, own, parts, last, out = None, 0, [], None, []
    schema, task = None, 0

    def sent() -> pa.RecordBatch:
        kinds = {"conv_id": schema, "part": pa.int32(), "n": pa.int64(), "hash": pa.string(), "text": pa.string()}
        done = pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), zip(*out, strict=True) if out else ([],) * 5, strict=True)})
        out.clear()
        return done

    for batch in batches:
        schema = batch.schema.field("conv_id").type
        for key, turn, role, text, fp, task in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "fp", "part")), strict=True):
            if parts and key != ident:
                out.append((ident, task, len(parts), f"{own:032x}", "".join(parts)))
                own, parts, last = 0, [], None
            elif parts:
                if (turn, fp) == last:  # a repeated row
                    continue
                out.append((ident, task, len(parts), f"{own:032x}", None))
            ident, own, last = key, (own * BASE + int(fp, 16)) % PRIME, (turn, fp)
            parts.append(TURN % (role, text))
        yield sent()
    if parts:
        out.append((ident, task, len(parts), f"{own:032x}", "".join(parts)))
        yield sent()


def _both(before: int, n: int, own: int) -> int:
    """The hash of a run behind another one, of ``n`` turns."""
    return (before * pow(BASE, n, PRIME) + own) % PRIME


def _before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each run of a cut conversation, how many turns come before it, their hash, and whether it is the last."""
    for batch in batches:
        out = []
        for key, runs in zip(batch.column("conv_id").to_pylist(), batch.column("all").to_pylist(), strict=True):
            n, own = 0, 0
            for run in runs:
                out.append((key, run["part"], n, f"{own:032x}", run is runs[-1]))
                n, own = n + run["n"], _both(own, run["n"], int(run["hash"], 16))
        kinds = {"conv_id": batch.schema.field("conv_id").type, "part": pa.int32(), "n_before": pa.int64(), "hash_before": pa.string(), "last": pa.bool_()}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), zip(*out, strict=True) if out else ([],) * 5, strict=True)})


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers and hashes of a later run's beginnings, with what comes before the run."""
    for batch in batches:
        at = {x: batch.column(x).to_pylist() for x in ("n", "hash", "n_before", "hash_before")}
        new = {
            "n": pa.array([a + b for a, b in zip(at["n"], at["n_before"], strict=True)], pa.int64()),
            "hash": pa.array([f"{_both(int(b, 16), n, int(h, 16)):032x}" for n, h, b in zip(at["n"], at["hash"], at["hash_before"], strict=True)], pa.string()),
        }
        yield pa.RecordBatch.from_pydict({x: new.get(x, batch.column(x)) for x in batch.schema.names})
