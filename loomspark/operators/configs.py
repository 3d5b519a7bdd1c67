"""Configuration files: TOML texts to the rows that the configuration rules check.

A file has the sections dataset, preprocessing, model, training, hardware and logging. Settings keep their names, but for those that are choices with values of their
own (an optimizer with its betas, a schedule with its limits, a source with its address), written as a table with ``type``; the mix of datasets
is a list of tables, of which the row holds the sum and how many entries break a rule.
"""

from __future__ import annotations

import tomllib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomspark.operators.rules import CONFIG_COLUMNS
from loomspark.session import dealt

# Where a setting stands in the file, if not under its own name in one section: fixed values.
PLACES = {
    "size_gb": "dataset.size_gb", "num_shards": "dataset.num_shards", "source": "dataset.source.type", "local_path": "dataset.local_path", "url": "dataset.source.url",
    "attention": "model.attention.type", "num_groups": "model.attention.num_groups", "window_size": "model.attention.window_size", "kv_heads": "model.num_key_value_heads",
    "position": "model.position_encoding", "rms_eps": "model.rms_norm_eps", "max_positions": "model.max_position_embeddings", "scheduler": "training.lr_scheduler.type", "schedule_min": "training.lr_scheduler.min_lr",
    "restart_interval": "training.lr_scheduler.restart_interval", "max_rate": "training.lr_scheduler.max_lr", "pct_start": "training.lr_scheduler.pct_start", "optimizer": "training.optimizer.type",
    "beta1": "training.optimizer.beta1", "beta2": "training.optimizer.beta2", "epsilon": "training.optimizer.epsilon", "momentum": "training.optimizer.momentum", "max_checkpoints": "training.max_checkpoints_to_keep",
}
SECTIONS = ("dataset", "preprocessing", "model", "training", "hardware", "logging")
KINDS = {"int": int, "double": float, "string": str, "boolean": bool, "array<int>": list}


def settings(text: str) -> dict:
    """The settings of one TOML text by the names of the rules; a value of another kind counts as not given. Raises tomllib.TOMLDecodeError."""
    given = tomllib.loads(text)

    def at(path: str):
        value = given
        for part in path.split("."):
            value = value.get(part) if isinstance(value, dict) else value if part == "type" and isinstance(value, str) else None
        return value

    out = {}
    for name, kind in CONFIG_COLUMNS.items():
        value = at(PLACES[name]) if name in PLACES else next((x for s in SECTIONS if (x := at(f"{s}.{name}")) is not None), None)
        if kind == "double" and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        wanted = KINDS[kind]
        out[name] = value if isinstance(value, wanted) and not (wanted is int and isinstance(value, bool)) else None
    mix = at("dataset.mix")
    if isinstance(mix, list):
        rows = [m for m in mix if isinstance(m, dict)]
        share = [float(m["percentage"]) for m in rows if isinstance(m.get("percentage"), (int, float))]
        names = Counter(m.get("name") or "" for m in rows)
        out |= {"mix_total": sum(share), "mix_count": len(rows), "mix_unnamed": names[""], "mix_repeated": sum(n > 1 for k, n in names.items() if k), "mix_out_of_range": sum(not 0 <= x <= 1 for x in share)}
    return out


def read_configs(texts: DataFrame, key: str = "config_id", text: str = "text") -> DataFrame:
    """(key, problem, and a column for each setting of the rules) of each TOML text; ``problem`` says why a text cannot be read, and is null otherwise."""
    kind = dict(texts.dtypes)[key]
    schema = StructType.fromDDL(f"`{key}` {kind}, problem string, {', '.join(f'{c} {k}' for c, k in CONFIG_COLUMNS.items())}")
    target = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for one in batch.column(1).to_pylist():
                try:
                    rows.append({"problem": None, **settings(one or "")})
                except tomllib.TOMLDecodeError as e:
                    rows.append({"problem": str(e)})
            columns = [batch.column(0)] + [pa.array([r.get(f.name) for r in rows], f.type) for f in list(target)[1:]]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in target])

    return dealt(texts.select(key, text)).mapInArrow(run, schema)
