"""A pipeline of named steps that a rerun skips where nothing changed.

A step's fingerprint covers its name and parameters, the files it reads (path, length, time of change) and the fingerprints of the steps
it depends on. Its table is committed to a log together with the fingerprint; a later run whose fingerprint is the same reads the
table instead of computing it, and starts no job for it. What depends on a changed step is done again, and nothing else.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from loomspark.operators.commitlog import Change, CommitLog


@dataclass
class Step:
    """``make`` takes (spark, tables of the steps in ``needs`` by name) and returns a table."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()
    files: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)


class StepPipeline:
    """Runs steps in the order of their needs and keeps their tables below a folder."""

    def __init__(self, spark: SparkSession, path: str, steps: list[Step]) -> None:
        self.spark, self.log = spark, CommitLog(spark, path)
        self.steps = self._ordered(steps)

    @staticmethod
    def _ordered(steps: list[Step]) -> list[Step]:
        by, out = {s.name: s for s in steps}, []
        if len(by) < len(steps):
            raise ValueError("two steps have one name")
        waiting: set[str] = set()

        def add(name: str) -> None:
            if name not in by or name in waiting:
                raise ValueError(f"step {name} is {'missing' if name not in by else 'its own input'}")
            if by[name] in out:
                return
            waiting.add(name)
            for need in by[name].needs:
                add(need)
            waiting.discard(name)
            out.append(by[name])

        for s in steps:
            add(s.name)
        return out

    def _listed(self, path: str) -> list:
        """(path, length, time of change) of every file below a path."""
        fs, at = self.log._fs(path)
        if not fs.exists(at):
            return [[path, "missing"]]
        found, more = [], fs.listFiles(at, True)
        while more.hasNext():
            f = more.next()
            found.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        return sorted(found)

    def run(self) -> tuple[dict[str, DataFrame], list[str]]:
        """Tables by step, and the names of the steps that were done now."""
        marks: dict[str, str] = {}
        tables: dict[str, DataFrame] = {}
        done: list[str] = []
        for step in self.steps:
            facts = [step.name, step.parameters, [self._listed(f) for f in step.files], [marks[n] for n in step.needs]]
            marks[step.name] = mark = hashlib.sha256(json.dumps(facts, sort_keys=True).encode()).hexdigest()
            folders = self.log.state().folders.get(f"{step.name}@{mark}", [])
            if not folders:
                rows = step.make(self.spark, {n: tables[n] for n in step.needs})
                schema = rows.schema

                def make(change: Change, step=step, mark=mark, rows=rows) -> None:
                    for name, old in change.state.folders.items():
                        if name.split("@")[0] == step.name and old:
                            change.touch(step.name, "all")
                            change.drop(name, list(old))
                    change.write(f"{step.name}@{mark}", rows)

                self.log._put(f"schemas/{step.name}@{mark}.json", schema.json())  # before the commit, which makes the step done
                self.log.transact(make)
                done.append(step.name)
                state = self.log.state().folders
            else:
                state = self.log.state().folders
                schema = StructType.fromJson(json.loads(self.log._get(f"schemas/{step.name}@{mark}.json")))
            tables[step.name] = self.spark.read.schema(schema).parquet(*(f"{self.log.path}/{f}" for f in state[f"{step.name}@{mark}"]))
        return tables, done
