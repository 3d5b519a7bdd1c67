"""The tracking store: nine tables as append-only event rows, their lookups and their current state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.operators.commitlog import Change, CommitLog
from loomspark.operators.pack import ranked

# Columns of the nine tables: fixed values.
TABLES = {
    "datasets": "id long, name string, source string, size_gb double, num_shards long, download_status string, download_progress double, downloaded_at timestamp, error_message string, retry_count long, last_retry_at timestamp",
    "preprocessed_data": "id long, dataset_id long, vocab_size long, num_tokens long, num_sequences long, avg_sequence_length double, max_sequence_length long, min_sequence_length long, preprocessed_at timestamp, file_path string, file_size_mb double, checksum string",
    "training_runs": "id long, config_hash string, model_config string, training_config string, start_time timestamp, end_time timestamp, status string, current_step long, total_steps long, best_loss double, final_loss double, device_info string, num_parameters long, git_commit string, command_line string, hostname string, pid long",
    "checkpoints": "id long, run_id long, step long, loss double, eval_loss double, path string, is_best long, model_size_mb double, ema_model_size_mb double, created_at timestamp",
    "metrics": "id long, run_id long, step long, loss double, eval_loss double, learning_rate double, gradient_norm double, weight_norm double, tokens_per_second double, samples_per_second double, memory_usage_mb double, gpu_memory_mb double, gpu_utilization_pct double, gpu_temperature double, cpu_utilization_pct double, disk_io_read_mb double, disk_io_write_mb double, network_io_mb double, batch_time_ms double, recorded_at timestamp",
    "evaluation_results": "id long, run_id long, step long, dataset_name string, perplexity double, loss double, accuracy_top1 double, accuracy_top5 double, accuracy_top10 double, bleu_score double, rouge1 double, rouge2 double, rouge_l double, exact_match double, f1_score double, num_samples long, evaluated_at timestamp",
    "system_events": "id long, run_id long, event_type string, message string, severity string, source_file string, line_number long, recorded_at timestamp",
    "hardware_info": "id long, run_id long, cpu_model string, cpu_cores long, cpu_threads long, ram_total_mb double, gpu_model string, gpu_count long, gpu_memory_total_mb double, cuda_version string, driver_version string, os_info string, recorded_at timestamp",
    "hyperparameter_search": "id long, run_id long, param_name string, param_value double, trial_number long, objective_value double, status string, recorded_at timestamp",
}
DEFAULTS = {
    "datasets": {"download_status": "pending", "download_progress": 0.0, "retry_count": 0},
    "training_runs": {"status": "running", "current_step": 0},
    "checkpoints": {"is_best": 0},
    "evaluation_results": {"dataset_name": "validation"},
    "system_events": {"severity": "info"},
    "hyperparameter_search": {"status": "running"},
}
NOW = {"preprocessed_data": "preprocessed_at", "training_runs": "start_time", "checkpoints": "created_at", "metrics": "recorded_at", "evaluation_results": "evaluated_at", "system_events": "recorded_at", "hardware_info": "recorded_at", "hyperparameter_search": "recorded_at"}


class Store:
    """Nine tables in a commit log; a change of a row is a new version of it, the latest version counts.

    Each method is one commit, whatever number of tables it changes. Writers that work at a time lose nothing: of two that change
    one row or take one id, the later one repeats its change on what the other left. ``compact`` removes only the folders it has read.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.log_ = spark, CommitLog(spark, path)
        self.path = self.log_.path

    @staticmethod
    def _schema(name: str) -> str:
        return f"{TABLES[name]}, version long, deleted boolean"

    @staticmethod
    def _current(versions: DataFrame) -> DataFrame:
        last = versions.groupBy("id").agg(F.max_by(F.struct("*"), F.col("version")).alias("r"))
        return last.select("r.*").where("NOT deleted").drop("version", "deleted")

    def versions(self, name: str) -> DataFrame:
        return Change(self.log_, self.log_.state()).read(name, self._schema(name))

    def table(self, name: str) -> DataFrame:
        """Current rows, as of now: later commits do not reach the frame."""
        return self._current(self.versions(name))

    # ---- parts of a change
    def _put(self, change: Change, name: str, row: dict, version: int, stamp: str | None = None) -> None:
        names = [c.split()[0] for c in TABLES[name].split(", ")]
        unknown = set(row) - set(names)
        if unknown:
            raise ValueError(f"{name} has no columns {sorted(unknown)}")
        df = self.spark.createDataFrame([tuple(row.get(c) for c in names) + (version, False)], self._schema(name))
        if stamp:
            df = df.withColumn(stamp, F.current_timestamp())
        change.write(name, df.coalesce(1))

    def _insert(self, change: Change, name: str, /, **values) -> int:
        new = change.new_id(name)
        row = {"id": new, **DEFAULTS.get(name, {}), **values}
        stamp = NOW.get(name)
        self._put(change, name, row, 0, stamp=stamp if row.get(stamp) is None else None)
        return new

    def _row(self, change: Change, name: str, id: int) -> dict:
        """Latest version of a row, which nobody else may change before the commit."""
        change.touch(name, id)
        got = change.read(name, self._schema(name)).where(F.col("id") == id).orderBy(F.col("version").desc()).first()
        if got is None or got.deleted:
            raise KeyError(f"{name} {id}")
        return got.asDict()

    def _update(self, change: Change, name: str, id: int, stamp: str | None = None, **values) -> None:
        row = self._row(change, name, id)
        version = row.pop("version") + 1
        row.pop("deleted")
        self._put(change, name, {**row, **values}, version, stamp=stamp)

    # ---- any table
    def insert(self, name: str, /, **values) -> int:
        """Add a row and return its id."""
        return self.log_.transact(lambda c: self._insert(c, name, **values))

    def append(self, name: str, rows: DataFrame, *order: str) -> int:
        """Add the rows of a frame, numbered by ``order``, and return their count; columns that it lacks take their defaults."""
        names = [c.split()[0] for c in TABLES[name].split(", ")]
        unknown = set(rows.columns) - set(names) - set(order)
        if unknown or "id" in rows.columns:
            raise ValueError(f"{name} takes no columns {sorted(unknown) or ['id']}")
        placed = ranked(rows, *order, out="_rank")
        types = dict(c.split() for c in TABLES[name].split(", "))
        stamp = NOW.get(name)

        def value(column: str):
            if column in rows.columns:
                return F.col(column)
            return F.current_timestamp() if column == stamp else F.lit(DEFAULTS.get(name, {}).get(column))

        filled = placed.select("_rank", *[value(c).cast(types[c]).alias(c) for c in names if c != "id"])
        count = rows.count()

        def make(change: Change) -> int:
            first = change.reserve(name, count)
            change.write(name, filled.select((F.col("_rank") + first).alias("id"), *names[1:], F.lit(0).cast("long").alias("version"), F.lit(False).alias("deleted")))
            return count

        return self.log_.transact(make)

    def update(self, name: str, id: int, /, *, stamp: str | None = None, **values) -> None:
        """A new version of a row with some values changed; stamp: a column that takes the time of the change."""
        self.log_.transact(lambda c: self._update(c, name, id, stamp, **values))

    # ---- datasets
    def add_dataset(self, dataset: str, source: str, size_gb: float, num_shards: int) -> int:
        """Upsert on (name, source); the id stays."""

        def make(change: Change) -> int:
            change.touch("datasets", f"{dataset}\0{source}")  # two that add one dataset are in conflict
            now = self._current(change.read("datasets", self._schema("datasets")))
            found = now.where((F.col("name") == dataset) & (F.col("source") == source)).first()
            if found is None:
                return self._insert(change, "datasets", name=dataset, source=source, size_gb=size_gb, num_shards=num_shards)
            self._update(change, "datasets", found.id, size_gb=size_gb, num_shards=num_shards, **DEFAULTS["datasets"])
            return found.id

        return self.log_.transact(make)

    def set_download_status(self, id: int, status: str) -> None:
        """The other columns stay, as progress and error have setters of their own."""
        self.update("datasets", id, download_status=status)

    def set_download_error(self, id: int, error: str) -> None:
        def make(change: Change) -> None:
            tries = self._row(change, "datasets", id)["retry_count"] or 0
            self._update(change, "datasets", id, stamp="last_retry_at", download_status="error", error_message=error, retry_count=tries + 1)

        self.log_.transact(make)

    # ---- runs
    def update_run(self, id: int, step: int, loss: float, status: str) -> None:
        """Progress of a run and a metric row, in one commit; the best loss never rises."""

        def make(change: Change) -> None:
            best = self._row(change, "training_runs", id)["best_loss"]
            self._update(change, "training_runs", id, current_step=step, best_loss=loss if best is None else min(best, loss), status=status)
            self._insert(change, "metrics", run_id=id, step=step, loss=loss)

        self.log_.transact(make)

    def complete_run(self, id: int, final_loss: float) -> None:
        self.update("training_runs", id, stamp="end_time", status="completed", final_loss=final_loss)

    def fail_run(self, id: int, error: str) -> None:
        """The run's end and its event, in one commit."""

        def make(change: Change) -> None:
            self._update(change, "training_runs", id, stamp="end_time", status="failed")
            self._insert(change, "system_events", run_id=id, event_type="training_failed", message=error, severity="error")

        self.log_.transact(make)

    def pause_run(self, id: int) -> None:
        self.update("training_runs", id, status="paused")

    def resume_run(self, id: int) -> None:
        self.update("training_runs", id, status="running")

    def log(self, severity: str, message: str, run_id: int | None = None, kind: str | None = None) -> int:
        return self.insert("system_events", run_id=run_id, event_type=kind or severity, message=message, severity=severity)

    def delete_run(self, id: int) -> None:
        """A run and its child rows, in one commit. The run is touched, so that nobody else changes it meanwhile."""

        def make(change: Change) -> None:
            change.touch("training_runs", id)
            for name, key in (("training_runs", "id"), *((n, "run_id") for n, cols in TABLES.items() if ", run_id long" in cols)):
                gone = change.read(name, self._schema(name)).where(F.col(key) == id)
                last = gone.groupBy("id").agg(F.max_by(F.struct("*"), F.col("version")).alias("r")).select("r.*").where("NOT deleted")
                change.write(name, last.withColumn("version", F.col("version") + 1).withColumn("deleted", F.lit(True)))

        self.log_.transact(make)

    def counts(self) -> DataFrame:
        """Rows of each table, all as of one commit."""
        change = Change(self.log_, self.log_.state())
        parts = [self._current(change.read(n, self._schema(n))).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in TABLES]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self, name: str) -> None:
        """Replace the folders of a table by one with the latest version of each row. What others add meanwhile stays beside it."""

        def make(change: Change) -> None:
            folders = list(change.state.folders.get(name, []))
            if len(folders) > 1:
                last = change.read(name, self._schema(name)).groupBy("id").agg(F.max_by(F.struct("*"), F.col("version")).alias("r")).select("r.*")
                change.write(name, last)
                change.drop(name, folders)

        self.log_.transact(make)

    def vacuum(self) -> list[str]:
        """Delete folders that stopped writers and compactions left; only while nobody writes."""
        return self.log_.vacuum()


# ---- lookups over any frame of the right columns -----------------------------------------------------


def listed_datasets(datasets: DataFrame) -> DataFrame:
    """All datasets, the newest first, with a progress of 0 where none is known."""
    return datasets.withColumn("download_progress", F.coalesce("download_progress", F.lit(0.0))).orderBy(F.col("id").desc())


def by_run(rows: DataFrame, run_id: int) -> DataFrame:
    return rows.where(F.col("run_id") == run_id)


def best_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Per run the marked checkpoint of least loss, ties by step."""
    best = checkpoints.where("is_best = 1").groupBy("run_id").agg(F.min(F.struct("loss", "step", "path")).alias("b"))
    return best.select("run_id", "b.step", "b.loss", "b.path")


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """Per run the checkpoint of the highest step."""
    last = checkpoints.groupBy("run_id").agg(F.max(F.struct("step", "loss", "path")).alias("b"))
    return last.select("run_id", "b.step", "b.loss", "b.path")


def last_rows(rows: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.col(by).desc(), *[F.col(t).desc() for t in ties]).limit(n)


def last_per_key(rows: DataFrame, key: str, n: int, by: str, tie: str) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(F.col(by).desc(), F.col(tie).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def best_trials(trials: DataFrame, n: int) -> DataFrame:
    """Completed trials of least objective."""
    return trials.where("status = 'completed'").orderBy("objective_value", "id").limit(n)


def run_stats(metrics: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Per run: metric rows, least and mean loss (0 without any), evaluations and least perplexity."""
    m = metrics.groupBy("run_id").agg(F.count("*").alias("n_metrics"), F.min("loss").alias("min_loss"), F.avg("loss").alias("avg_loss"))
    e = evaluations.groupBy("run_id").agg(F.count("*").alias("n_evaluations"), F.min("perplexity").alias("best_perplexity"))
    j = m.join(e, "run_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return j.select("run_id", zero("n_metrics").alias("n_metrics"), F.coalesce("min_loss", F.lit(0.0)).alias("min_loss"), F.coalesce("avg_loss", F.lit(0.0)).alias("avg_loss"), zero("n_evaluations").alias("n_evaluations"), "best_perplexity")


def upsert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row of each key."""
    last = rows.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct(*order)).alias("r"))
    return last.select("r.*")


def retained(checkpoints: DataFrame, keep: int, time: str, tie: str) -> DataFrame:
    """Adds keep: the newest checkpoints of each run stay."""
    w = Window.partitionBy("run_id").orderBy(F.col(time).desc(), F.col(tie).desc())
    return checkpoints.withColumn("keep", F.row_number().over(w) <= keep)
