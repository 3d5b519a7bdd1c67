"""Structured Streaming: token files, windows, early stopping and loss scaling as stateful operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql import functions as F

from loomspark.sources.readers import token_lines


def stream_tokens(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """Token lines of the files that arrive in a folder, a few files a batch."""
    return token_lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))


def windowed_means(events: DataFrame, time: str, value: str, late: str, width: str, *keys: str) -> DataFrame:
    """Count and mean of each key and event-time window; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


BUCKETS = 1024


def _folded(rows: DataFrame, value: str, state: dict[str, str], start: tuple, fold: Callable[[tuple, list], tuple], shown: list[str]) -> DataFrame:
    """(run_id, step, shown...) of the runs in each micro-batch: their values folded in step order, each run from where its state was left.

    A call costs much more than a row, so runs share ``BUCKETS`` groups by hash, and a group's state is that of its runs, as arrays.
    """
    given = rows.select(F.pmod(F.xxhash64("run_id"), F.lit(BUCKETS)).alias("bucket"), F.coalesce("run_id", F.lit(0)).cast("long").alias("run_id"), F.col("run_id").isNull().alias("none"), "step", F.col(value).alias("value"))

    def update(key: tuple, parts: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = {}
        if group.exists:
            runs, none, *columns = group.get
            held = dict(zip(zip(runs, none, strict=True), zip(*columns, strict=True), strict=True))
        come = pd.concat(list(parts)).sort_values(["none", "run_id", "step"], kind="stable")
        ids, none, values = come["run_id"].to_numpy(), come["none"].to_numpy(bool), come["value"].tolist()
        cuts = (np.flatnonzero((ids[1:] != ids[:-1]) | (none[1:] != none[:-1])) + 1).tolist()
        keys, last = [], come["step"].to_numpy()[[*(c - 1 for c in cuts), len(ids) - 1]]
        for lo, hi in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            keys.append((int(ids[lo]), bool(none[lo])))
            held[keys[-1]] = fold(held.get(keys[-1], start), values[lo:hi])
        group.update(([k[0] for k in held], [k[1] for k in held], *[list(c) for c in zip(*held.values(), strict=True)]))
        now = dict(zip(state, zip(*[held[k] for k in keys], strict=True), strict=True))
        yield pd.DataFrame({"run_id": pd.array([None if k[1] else k[0] for k in keys], "Int64"), "step": last} | {c: now[c] for c in shown})

    out = ", ".join(["run_id long", "step long", *[f"{c} {state[c]}" for c in shown]])
    kept = ", ".join(["runs array<long>", "none array<boolean>", *[f"{c} array<{t}>" for c, t in state.items()]])
    return given.groupBy("bucket").applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def early_stops(losses: DataFrame, patience: int, min_delta: float) -> DataFrame:
    """(run_id, step, best, stopped) after each micro-batch of (run_id, step, loss), in step order inside a batch.

    Micro-batches are folded as they come: rows of a later one with earlier steps count after those already folded.
    """

    def fold(held: tuple, values: list) -> tuple:
        best, bad, stopped = held
        for loss in values:
            if loss < best - min_delta:
                best, bad = float(loss), 0
            else:
                bad += 1
                stopped = stopped or bad >= patience
        return best, bad, stopped

    return _folded(losses, "loss", {"best": "double", "bad": "int", "stopped": "boolean"}, (float("inf"), 0, False), fold, ["best", "stopped"])


def loss_scales(flags: DataFrame, initial: float, factor: float = 2.0, window: int = 2000, low: float = 1.0, high: float = 32768.0) -> DataFrame:
    """(run_id, step, scale, overflows) after each micro-batch of (run_id, step, overflow), folded as they come like ``early_stops``."""

    def fold(held: tuple, values: list) -> tuple:
        scale, clean, n = held
        for bad in values:
            if bad:
                scale, clean, n = scale / factor, 0, n + 1
            else:
                clean += 1
                if clean >= window and scale * factor <= high:
                    scale, clean = scale * factor, 0
            scale = min(max(scale, low), high)
        return scale, clean, n

    return _folded(flags, "overflow", {"scale": "double", "clean": "int", "overflows": "int"}, (initial, 0, 0), fold, ["scale", "overflows"])
