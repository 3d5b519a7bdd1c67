"""Streaming batches over restarts, event files with damaged frames, checkpoints, steps, blocked attention and parameter tables."""

from __future__ import annotations

import glob
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.operators import attention, parameters, series
from loomspark.operators.checkpoints import Checkpoints, resumed
from loomspark.operators.steps import Step, StepPipeline
from loomspark.sources import event_records
from loomspark.streaming import batches


def simulated(ids: list[int], lane: int, size: int, seed: int, drop_last: bool) -> list[tuple]:
    """(batch, pos, seq_id, filled) of one lane, by the rule as it is told."""
    room, held, gave, turn = min(10 * size, 1000), [], [], 0
    for i in ids:
        held.append(i)
        if len(held) == 2 * room:
            held.sort(key=lambda x: (batches._draw(seed, turn, lane, x), x))
            gave, held, turn = gave + held[:room], held[room:], turn + 1
    gave += sorted(held, key=lambda x: (batches._draw(seed, turn, lane, x), x))
    out = [(k // size, k % size, i, False) for k, i in enumerate(gave)]
    own = len(gave) % size
    if own and drop_last:
        return out[:-own]
    if own:
        last = gave[-own:]
        out += [(len(gave) // size, pos, last[int(batches._draw(seed, "fill", lane, len(gave) // size, pos)[:8], 16) % own], True) for pos in range(own, size)]
    return out


@pytest.mark.parametrize("drop_last", [False, True])
def test_batches_over_micro_batches_and_a_restart(spark, tmp_path, drop_last):
    size, lanes, seed, length = 3, 2, 7, 4
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    schema = "seq_id long, tokens array<int>, last boolean"

    def put(ids):
        spark.createDataFrame([(i, [i, 1, 2, 3, 4] if i % 10 else [i, 1], False) for i in ids], schema).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        with batches.rocksdb_state(spark):
            rows = batches.shuffled_stream(stream, length, size, seed, lanes, drop_last)
            save = lambda b, n: b.write.mode("overwrite").parquet(f"{out}/epoch={n}")
            rows.writeStream.foreachBatch(save).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()

    for part in (range(1, 60), range(60, 95), range(95, 150)):
        put(part)
    run()
    first = spark.read.parquet(out).count()
    assert first > 0
    put(range(150, 211))
    batches.end_rows(spark, lanes).coalesce(1).write.mode("append").parquet(path)
    run()  # goes on from the state that the first run left
    rows = spark.read.parquet(out).collect()
    assert len(rows) > first and all(len(r.input) == len(r.target) == length for r in rows)
    for lane in range(lanes):
        ids = [i for i in range(1, 211) if i % lanes == lane and i % 10]  # short sequences are left out
        got = sorted((r.batch, r.pos, r.seq_id, r.filled) for r in rows if r.lane == lane)
        assert got == sorted(simulated(ids, lane, size, seed, drop_last))
    by = {}
    for r in rows:
        by.setdefault((r.lane, r.batch), []).append(r)
    assert all(len(b) == size for b in by.values())
    assert all(r.input == [r.seq_id, 1, 2, 3] and r.target == [1, 2, 3, 4] for r in rows if not r.filled)


def test_chunks_are_read_once_over_a_restart(spark, tmp_path):
    path, out, state, got = (str(tmp_path / x) for x in ("tokens.txt", "chunks", "state", "got"))
    lines = [" ".join(str(k) for k in range(i, i + 3 + i % 9)) for i in range(200)] + ["", "1 2", "x 5 6 7"]
    (tmp_path / "tokens.txt").write_text("\n".join(lines))
    batches.write_chunks(spark, path, out, 2, size=50)

    def run(limit):
        rows = batches.read_chunks(spark, out)
        save = lambda b, n: b.write.mode("overwrite").parquet(f"{got}/epoch={n}")
        q = rows.writeStream.foreachBatch(save).option("checkpointLocation", state)
        if limit:
            q = q.trigger(processingTime="0 seconds").start()
            while len(glob.glob(f"{got}/epoch=*/_SUCCESS")) < limit:
                assert q.isActive
                q.awaitTermination(0.2)
            q.stop()
        else:
            q.trigger(availableNow=True).start().awaitTermination()

    run(2)
    run(0)
    rows = spark.read.parquet(got).collect()
    assert sorted(r.seq_id for r in rows) == list(range(len(rows)))
    want = []
    for line in lines:
        t = [int(x) for x in line.split() if x.isdigit()]
        starts = [*range(0, len(t) - 2, 3), *([len(t) - 3] if len(t) > 3 and (len(t) - 3) % 3 else [])]
        want += [t[s : s + 3] for s in starts]
    assert [r.tokens for r in sorted(rows, key=lambda r: r.seq_id)] == want
    sizes = spark.read.parquet(got).groupBy("chunk").count().collect()
    assert max(r["count"] for r in sizes) == 50 and len(sizes) == math.ceil(len(want) / 50)


def test_event_files_and_damaged_frames(spark, tmp_path):
    path = str(tmp_path / "events")
    rows = spark.createDataFrame([(1, 1.5, "ä\nx" * 100), (2, None, ""), (300, -2.0, None), (300, 4.0, "z" * 300)], "step long, v double, t string").withColumn("at", F.lit("2024-01-02 03:04:05.5"))
    event_records.write_events(event_records.scalars(rows, "loss", "v", "step", "at"), path)
    event_records.write_events(event_records.texts(rows, "note", "t", "step", "at"), path)
    event_records.write_events(event_records.histograms(rows, "all", "v", "step", "at", bins=4), path)
    got = event_records.read_events(spark, path).collect()
    assert all(r.problem is None and r.wall_time == 1704164645.5 for r in got)
    assert sorted((r.step, r.value) for r in got if r.kind == "scalar") == [(1, 1.5), (300, -2.0), (300, 4.0)]
    assert sorted(r.text for r in got if r.kind == "text") == sorted(["ä\nx" * 100, "", "z" * 300])
    h = {r.step: r.histogram for r in got if r.kind == "histogram"}
    assert (h[300].min, h[300].max, h[300].num, h[300].sum, h[300].sum_squares, [tuple(b) for b in h[300].bins]) == (-2.0, 4.0, 2, 2.0, 20.0, [(0, 1), (3, 1)])
    # A torn last frame, a flipped byte, and rubbish.
    spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "step long, v double").withColumn("at", F.lit("2024-01-01")).coalesce(1).transform(lambda d: event_records.write_events(event_records.scalars(d, "x", "v", "step", "at"), str(tmp_path / "one")) or d)
    file = glob.glob(str(tmp_path / "one" / "part-*"))[0]
    data = open(file, "rb").read()
    frames = data.split(bytes(12))
    assert len(frames) == 4 and frames[3] == b""
    broken = bytearray(frames[1])
    broken[30] ^= 1
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "file").write_bytes(frames[0] + bytes(12) + bytes(broken) + bytes(12) + b"rubbish" + bytes(12) + frames[2][:-7])
    bad = event_records.read_events(spark, str(tmp_path / "bad")).collect()
    assert sorted((r.problem or "", r.step) for r in bad if r.problem is None) == [("", 1)]
    assert sorted(r.problem for r in bad if r.problem) == ["corrupt", "torn", "torn"] and all(r.step is None for r in bad if r.problem)


def test_checkpoints(spark, tmp_path):
    kept = Checkpoints(spark, str(tmp_path / "c"))
    with pytest.raises(KeyError):
        kept.restore()
    values = spark.createDataFrame([(k, s, math.sin(k + s)) for k in range(3) for s in range(20)] + [(9, 15, 0.5), (8, 2, 0.25)], "run long, step long, g double")
    fold = lambda g, start: series.adam_state(g, start, 0.01)
    for step in (5, 10):
        kept.save(step, {"optimizer": resumed(values.where(F.col("step") <= step), "run", "step", None, "s", fold, "g"), "other": spark.range(step)}, {"scale": 2.0 * step})
    assert kept.steps() == [5, 10]
    step, tables, state = kept.restore()
    assert (step, state, tables["other"].count()) == (10, {"scale": 20.0}, 10)
    whole = {r.run: r.s for r in resumed(values, "run", "step", None, "s", fold, "g").collect()}
    for at in (5, 10):
        step, tables, _ = kept.restore(at)
        got = {r.run: r.s for r in resumed(values, "run", "step", tables["optimizer"], "s", fold, "g", after=step).collect()}
        assert got.keys() == whole.keys() and all(got[k] == pytest.approx(whole[k]) for k in whole)
    kept.save(15, {"optimizer": spark.range(1)}, keep=2)
    assert kept.steps() == [10, 15]
    kept.save(15, {"optimizer": spark.range(2)})
    assert kept.restore()[1]["optimizer"].count() == 2 and kept.retain(1) == [10] and kept.steps() == [15]
    assert len(kept.vacuum()) >= 6 and kept.restore()[1]["optimizer"].count() == 2
    with pytest.raises(ValueError, match="no dash"):
        kept.save(1, {"a-b": spark.range(1)})


def test_steps_are_skipped_until_their_input_changes(spark, tmp_path):
    data = str(tmp_path / "data")
    spark.range(10).write.parquet(data)
    made = []

    def step(name, fn, **options):
        return Step(name, lambda s, t: made.append(name) or fn(s, t), **options)

    def pipeline(factor=2):
        return StepPipeline(spark, str(tmp_path / "steps"), [
            step("sum", lambda s, t: t["scaled"].agg(F.sum("x").alias("x")), needs=("scaled",)),
            step("scaled", lambda s, t: t["read"].select((F.col("id") * factor).alias("x")), needs=("read",), parameters={"factor": factor}),
            step("read", lambda s, t: s.read.parquet(data), files=(data,)),
            step("apart", lambda s, t: s.range(3)),
        ])

    tables, done = pipeline().run()
    assert done == ["read", "scaled", "sum", "apart"] and tables["sum"].first().x == 90
    made.clear()
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    tables, done = pipeline().run()
    assert (done, made) == ([], []) and set(tracker.getJobIdsForGroup(None)) == before  # no job at all
    assert tables["sum"].first().x == 90
    assert pipeline(3).run()[1] == ["scaled", "sum"]
    spark.range(10, 12).write.mode("append").parquet(data)
    tables, done = pipeline(3).run()
    assert done == ["read", "scaled", "sum"] and tables["sum"].first().x == 3 * 66
    with pytest.raises(ValueError, match="its own input"):
        StepPipeline(spark, str(tmp_path / "x"), [Step("a", None, needs=("b",)), Step("b", None, needs=("a",))])


@pytest.mark.parametrize(("causal", "window", "alibi"), [(True, None, True), (False, None, False), (True, 3, False), (False, 2, True)])
def test_blocked_attention(spark, monkeypatch, causal, window, alibi):
    monkeypatch.setattr(attention, "FAN_IN", 3)
    rng = np.random.default_rng(1)
    n, heads, kv, d = 23, 3, 2, 4
    q, k, v = rng.normal(size=(heads, n, d)) * 3, rng.normal(size=(kv, n, d)) * 3, rng.normal(size=(kv, n, 2))
    pad = [p % 6 == 0 for p in range(n)]
    queries = spark.createDataFrame([(1, h, p, q[h, p].tolist()) for h in range(heads) for p in range(n)], "seq long, head int, pos long, q array<double>")
    keys = spark.createDataFrame([(1, g, p, k[g, p].tolist(), v[g, p].tolist(), pad[p]) for g in range(kv) for p in range(n)], "seq long, kv_head int, pos long, k array<double>, v array<double>, pad boolean")
    got = {(r.head, r.pos): r.out for r in attention.blocked_attention(queries, keys, heads, kv, causal, window, alibi, block=2).collect()}
    of = [0, 0, 1]  # three heads over two: the first takes the remainder
    for h in range(heads):
        for p in range(n):
            seen = [x for x in range(n) if not pad[x] and (x <= p or not causal) and (window is None or abs(x - p) <= window)]
            if not seen:
                assert (h, p) not in got
                continue
            s = np.array([q[h, p] @ k[of[h], x] / 2 - (max(p - x, 0) * 2.0 ** (-8 - h) if alibi else 0) for x in seen])
            w = np.exp(s - s.max())
            assert got[h, p] == pytest.approx((w @ v[of[h], seen] / w.sum()).tolist())


def test_parameter_tables(spark):
    config = spark.createDataFrame([(1, 10, 4, 2, 8, 2, None, False, True, True, True, True), (2, 5, 2, 0, 4, 2, 7, True, False, False, False, False)], "config_id long, vocabulary long, hidden long, layers long, ffn long, kv_size long, positions long, tied boolean, attention_bias boolean, ffn_bias boolean, gated boolean, norm_bias boolean")
    tensors = parameters.catalogue(config)
    names = [r.tensor for r in tensors.where("config_id = 1").orderBy("ordinal").collect()]
    assert names[:3] == ["embedding", "lm_head", "q_proj"] and names[-2:] == ["final_norm", "final_norm_bias"] and len(names) == 2 + 2 * 18 + 2
    assert [r.tensor for r in tensors.where("config_id = 2").orderBy("ordinal").collect()] == ["embedding", "positions", "final_norm"]
    count = lambda c: {r.config_id: r.n for r in c.groupBy("config_id").agg(F.sum("n").alias("n")).collect()}
    assert count(parameters.parameter_counts(tensors))[2] == 10 + 14 + 2
    assert count(parameters.parameter_counts(tensors))[1] - count(parameters.parameter_counts(tensors, compat=True))[1] == 2 * (8 + 4 + 8)
    last = parameters.flat_offsets(tensors).where("config_id = 1").orderBy(F.desc("ordinal")).first()
    assert last.offset + last.rows * last.columns == count(parameters.parameter_counts(tensors))[1]
    p = spark.createDataFrame([(0, "a", 0, [1.0, 2.0]), (0, "a", 1, [3.0, 4.0])], "layer int, tensor string, row int, values array<double>")
    g = spark.createDataFrame([(0, "a", 1, [10.0, -10.0])], p.schema)
    assert sorted((r.row, r.values) for r in parameters.apply_gradients(p, g, 0.1).collect()) == [(0, [1.0, 2.0]), (1, [2.0, 5.0])]
    mean = {r.row: r.values for r in parameters.averaged(g, p, 0.9).collect()}
    assert mean[0] == [1.0, 2.0] and mean[1] == pytest.approx([9.3, -8.6])


def test_padding_is_not_seen(spark):
    from loomspark.plans import runs

    rng = random.Random(2)
    rows = [(1, p, rng.randrange(1, 16)) for p in range(6)]
    model = {"layers": 1, "heads": 2, "kv_heads": 1, "hidden": 8, "padding": 0}
    frame = lambda r: spark.createDataFrame(r, "seq long, pos long, token int")
    plain = {r.pos: r.logits for r in parameters.forward(frame(rows), runs.rule_parameters(spark), **model).collect()}
    longer = {r.pos: r.logits for r in parameters.forward(frame([*rows, (1, 6, 0), (1, 7, 3)]), runs.rule_parameters(spark), **model).collect()}
    assert all(plain[p] == pytest.approx(longer[p]) for p in plain)
    gap = {r.pos: r.logits for r in parameters.forward(frame([*rows, (1, 7, 3)]), runs.rule_parameters(spark), **model).collect()}
    assert gap[7] == pytest.approx(longer[7])


def test_generation_goes_on_from_what_it_made(spark):
    from loomspark.plans import runs

    rng = random.Random(4)
    rows = [(s, p, rng.randrange(16)) for s in range(4) for p in range(rng.randrange(1, 5))]
    frame = lambda r: spark.createDataFrame(r, "seq long, pos long, token int")
    model = {"layers": 1, "heads": 2, "kv_heads": 1, "hidden": 8}
    weights = runs.rule_parameters(spark)
    step = lambda r, **o: sorted(map(tuple, parameters.generate(frame(r), weights, end=5, penalty=1.5, newline=None, **o, **model).collect()))
    for options in ({}, {"temperature": 0.8, "top_p": 0.9, "seed": 3}):
        two = step(rows, at_most=2, **options)
        first = step(rows, at_most=1, **options)
        going = [r for r in rows if r[0] in {s for s, _, _ in first}] + first
        assert two == sorted(first + step(going, at_most=1, **options))
        assert all(t != 5 for _, _, t in two)
    assert step(rows, at_most=3, context=1 + max(p for _, p, _ in rows)) == [r for r in step(rows, at_most=3) if r[1] <= max(p for _, p, _ in rows)]
