"""Checkpoints of a run: any tables and a small state under a step, committed whole, restored, and kept by number.

A checkpoint is one commit of a log (``commitlog``): its tables are written first, then named together, so that a writer that stops
leaves no half checkpoint, and readers of an older one are not disturbed. Folds of the training series go on from a restored table of states.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.operators.commitlog import Change, CommitLog

STATE = "name string, schema string, state string"


class Checkpoints:
    """The checkpoints below a folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.log = spark, CommitLog(spark, path)

    def steps(self) -> list[int]:
        """Steps that have a checkpoint, in order."""
        return sorted({int(name.split("-")[0]) for name, folders in self.log.state().folders.items() if folders})

    def save(self, step: int, tables: dict[str, DataFrame], state: dict | None = None, keep: int | None = None) -> None:
        """Write the tables and the state of a step, in place of an earlier checkpoint of it; of all others only the newest ``keep`` stay."""
        if any("-" in name for name in tables) or "state" in tables:
            raise ValueError("names of tables hold no dash, and none is called state")

        def make(change: Change) -> None:
            self._drop(change, [step])
            for name, rows in tables.items():
                change.write(f"{step}-{name}", rows)
            facts = [(name, rows.schema.json(), "") for name, rows in tables.items()] + [("", "", json.dumps(state or {}))]
            change.write(f"{step}-state", self.spark.createDataFrame(facts, STATE).coalesce(1))
            if keep is not None:
                have = sorted({int(n.split("-")[0]) for n, folders in change.state.folders.items() if folders} | {step})
                self._drop(change, [s for s in have[: max(len(have) - keep, 0)] if s != step])

        self.log.transact(make)

    def _drop(self, change: Change, steps: list[int]) -> None:
        for name, folders in change.state.folders.items():
            if folders and int(name.split("-")[0]) in steps:
                change.touch(name, "all")
                change.drop(name, list(folders))

    def restore(self, step: int | None = None) -> tuple[int, dict[str, DataFrame], dict]:
        """Step, tables and state of a checkpoint, the latest one if no step is named."""
        folders = self.log.state().folders
        have = sorted({int(n.split("-")[0]) for n, f in folders.items() if f})
        if not have or (step is not None and step not in have):
            raise KeyError(f"no checkpoint {'' if step is None else step} among {have}")
        step = have[-1] if step is None else step
        facts = self.log.load(folders[f"{step}-state"], STATE).collect()
        tables = {r.name: self.spark.read.schema(StructType.fromJson(json.loads(r.schema))).parquet(*(f"{self.log.path}/{f}" for f in folders[f"{step}-{r.name}"])) for r in facts if r.name}
        return step, tables, json.loads(next(r.state for r in facts if not r.name))

    def retain(self, keep: int) -> list[int]:
        """Remove all but the newest checkpoints; returns the steps that went. Their files go with ``vacuum``."""
        gone: list[int] = []

        def make(change: Change) -> None:
            gone[:] = sorted({int(n.split("-")[0]) for n, f in change.state.folders.items() if f})[:-keep] if keep else self.steps()
            self._drop(change, gone)

        self.log.transact(make)
        return gone

    def vacuum(self) -> list[str]:
        return self.log.vacuum()


def resumed(series: DataFrame, key: str, step: str, states: DataFrame | None, state: str, fold: Callable[[Column, Column | None], Column], value: str, after: int | None = None) -> DataFrame:
    """(key, state): a fold of the ordered values of each key, from a restored table of states if one is given; keys without new values keep their state.

    ``fold`` takes the ordered values and the state before them (None at the start). ``after``: only values of later steps, those not folded yet.
    """
    rows = series if after is None else series.where(F.col(step) > after)
    ordered = rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, value))), lambda x: x[value]).alias("_x"))
    if states is None:
        return ordered.select(key, fold(F.col("_x"), None).alias(state))
    both = ordered.join(states, key, "full_outer")
    done = F.when(F.col("_x").isNull(), F.col(state)).when(F.col(state).isNull(), fold(F.col("_x"), None)).otherwise(fold(F.col("_x"), F.col(state)))
    return both.select(key, done.alias(state))
