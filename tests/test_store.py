"""The commit log: writers at a time, changes of several tables, stopped writers, summaries."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from loomspark.operators import commitlog
from loomspark.operators.commitlog import Change, CommitLog, Conflict
from loomspark.operators.tracking import Store

SCHEMA = "id long, v long"


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA).coalesce(1)


def test_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    before = log.state()
    change = Change(log, log.state())
    change.write("a", rows(spark, (1, 1)))
    change.write("b", rows(spark, (1, 2)))
    assert log.load(log.state().folders.get("a", []), SCHEMA).count() == 0  # written, not committed
    assert log.commit(change)
    state = log.state()
    assert state.version == 1 and {k: log.load(v, SCHEMA).count() for k, v in state.folders.items()} == {"a": 1, "b": 1}
    assert log.load(before.folders.get("a", []), SCHEMA).count() == 0  # a reader keeps the state it began with
    stopped = Change(log, log.state())
    stopped.write("a", rows(spark, (2, 2)))  # never committed
    assert log.vacuum() == stopped.add["a"] and log.load(log.state().folders["a"], SCHEMA).count() == 1


def test_same_number_goes_to_one_writer(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    one, two, three = (Change(log, log.state()) for _ in range(3))
    one.touch("a", 5)
    two.touch("a", 6)
    three.touch("a", 5)
    assert log.commit(one) and log.commit(two) and not log.commit(three)
    assert log.state().version == 2
    four, five = Change(log, log.state()), Change(log, log.state())
    assert four.new_id("a") == five.new_id("a") == 1
    assert log.commit(four) and not log.commit(five) and Change(log, log.state()).new_id("a") == 2


def test_repeated_conflicts_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "ATTEMPTS", 3)
    log = CommitLog(spark, str(tmp_path / "log"))

    def disturbed(change):
        change.touch("a", 1)
        other = Change(log, log.state())
        other.touch("a", 1)
        assert log.commit(other)

    with pytest.raises(Conflict):
        log.transact(disturbed)


def test_summaries_give_the_same_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commitlog, "SUMMARY", 4)
    log = CommitLog(spark, str(tmp_path / "log"))
    for k in range(10):
        log.transact(lambda c, k=k: (c.new_id("a"), c.add.setdefault("a", []).append(f"f{k}")))
    assert [x for x in log._list("_log") if x.endswith(".state")] == ["000000000004.state", "000000000008.state"]
    state = log.state()
    assert (state.version, state.folders["a"], state.next["a"]) == (10, [f"f{k}" for k in range(10)], 11)


def test_two_writers_and_compactions_lose_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run = store.insert("training_runs", config_hash="h", total_steps=100)
    failed = []

    def work(offset: int) -> None:
        try:
            own = Store(spark, store.path)
            for k in range(5):
                own.update_run(run, offset + k, 10.0 - offset - k, "running")
        except Exception as e:
            failed.append(e)

    def tidy() -> None:
        try:
            for _ in range(3):
                Store(spark, store.path).compact("metrics")
                Store(spark, store.path).compact("training_runs")
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=work, args=(n,)) for n in (0, 5)] + [threading.Thread(target=tidy)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed
    metrics = store.table("metrics").orderBy("step").collect()
    assert [r.step for r in metrics] == list(range(10)) and len({r.id for r in metrics}) == 10
    row = store.table("training_runs").first()
    assert row.best_loss == 1.0 and store.versions("training_runs").agg(F.max("version")).first()[0] == 10


def test_append_numbers_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    first = store.insert("metrics", run_id=1, step=0, loss=1.0)
    assert store.append("metrics", spark.range(5).select(F.lit(2).alias("run_id"), F.col("id").alias("step"), (F.col("id") / 2).alias("loss")), "step") == 5
    got = store.table("metrics").orderBy("id").collect()
    assert [r.id for r in got] == list(range(first, first + 6)) and [r.step for r in got][1:] == [0, 1, 2, 3, 4]
    assert all(r.recorded_at is not None for r in got) and store.insert("metrics", run_id=3) == first + 6
    with pytest.raises(ValueError, match="takes no columns"):
        store.append("metrics", spark.range(1).select(F.lit(1).alias("nothing")), "nothing2")


def test_dataset_case(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    d = store.add_dataset("test_dataset", "huggingface", 1.5, 1)
    store.set_download_status(d, "completed")
    row = store.table("datasets").first()
    assert d > 0 and (row.download_status, row.download_progress, row.error_message) == ("completed", 0.0, None)
    assert store.insert("preprocessed_data", dataset_id=d, vocab_size=1000, num_tokens=10000, num_sequences=100, avg_sequence_length=100.0) > 0
    assert store.table("datasets").count() == 1
