"""Writers: packed sequences, step logs, event records, and plans of sharded files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators.rules import step_log
from loomspark.operators.series import histogram
from loomspark.session import put_text


def write_packed(
    sequences: DataFrame, path: str, as_text: bool = False, order: str = "seq_id", tokens: str = "tokens", in_order: bool = False, codec: str | None = None, lines_per_file: int = 1 << 16
) -> None:
    """Packed sequences, as arrays in Parquet or as ids joined by a space, a sequence a line in order; ``in_order`` says that they are already, as ``pack`` without ``by`` gives them.

    ``codec`` (as ``gzip``) compresses the text, at its fastest level. Such a file is read by one task, so a task that writes more than ``lines_per_file`` lines puts them into several, whose names keep the order.
    """
    if not as_text:
        sequences.write.mode("overwrite").parquet(path)
        return
    lines = sequences if in_order else sequences.sort(order)
    text = lines.select(F.array_join(F.col(tokens).cast("array<string>"), " ").alias("value")).write.mode("overwrite")
    if codec:
        text = text.options(**{"compression": codec, "maxRecordsPerFile": lines_per_file, "zlib.compress.level": "BEST_SPEED"})
    text.text(path)


def write_step_log(steps: DataFrame, path: str) -> None:
    step_log(steps).write.mode("append").csv(path, header=True)


def scalar_events(rows: DataFrame, step: str, time: str, tags: list[str]) -> DataFrame:
    """(wall_time, step, tag, value): a row for each tag that has a value."""
    pairs = F.array(*[F.struct(F.lit(t).alias("tag"), F.col(t).cast("double").alias("value")) for t in tags])
    return rows.select(F.col(time).alias("wall_time"), F.col(step).alias("step"), F.explode(pairs).alias("p")).select("wall_time", "step", "p.*").where("value IS NOT NULL")


def histogram_events(rows: DataFrame, value: str, tag: str, step: int) -> DataFrame:
    """A histogram record: limits, counts, minimum, maximum, number, sum and sum of squares."""
    facts = rows.agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("num"), F.sum(value).alias("sum"), F.sum(F.col(value) * F.col(value)).alias("sum_squares"))
    bins = histogram(rows, value).agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    return facts.crossJoin(bins).select(F.lit(tag).alias("tag"), F.lit(step).alias("step"), "*")  # one row each


def shard_plan(spark: SparkSession, total_bytes: int, shard_bytes: int) -> DataFrame:
    """(shard, first, last): byte ranges of a sharded file."""
    n = max(1, -(-total_bytes // shard_bytes))
    s = F.col("id")
    return spark.range(n).select(s.alias("shard"), (s * shard_bytes).alias("first"), F.least((s + 1) * shard_bytes, F.lit(total_bytes)).alias("last"))


def write_json(path: str, record: dict) -> None:
    """A small record of the driver: tokenizer, history, benchmark."""
    put_text(path, json.dumps(record, ensure_ascii=False, indent=2))


def write_chat(messages: DataFrame, path: str) -> None:
    messages.write.mode("overwrite").json(path)
