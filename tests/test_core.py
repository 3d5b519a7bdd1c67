"""Value tests of the core operators on small literal inputs."""

from __future__ import annotations

import math
import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.functions.text import FOLD_FROM, FOLD_TO, is_not_blank, normalize
from loomspark.functions import registry
from loomspark.operators import chat, pack, rules, series, tokenize, vocab
from loomspark.operators import modelmath as mm
from loomspark.operators.tracking import Store
from loomspark.sources import extract, readers, writers


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize(spark):
    assert one(spark, normalize(F.lit("Héllo Wörld!"))) == "hello world!"
    assert len(FOLD_FROM) == len(FOLD_TO) == 57
    assert one(spark, normalize(F.lit("A"), prefix_space=True)) == " a"


def test_blank(spark):
    rows = spark.createDataFrame([(None,), ("",), (" 　 \n",), ("x",)], "t string")
    assert [r.b for r in rows.select(is_not_blank("t").alias("b")).collect()] == [False, False, False, True]


@pytest.mark.parametrize(
    ("line", "text"),
    [
        ('{"text": "Hello world", "id": 1}', "Hello world"),
        ('{"data": {"content": "Nested text", "meta": "info"}}', "Nested text"),
        ('{"messages": ["Hello", "World"]}', "Hello World"),
        ('{"a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6}', ""),
        ('{"z": "last", "k": true}', "true last"),
        ("plain ASCII", "plain ASCII"),
        ("pläin", ""),
        ("null", ""),
    ],
)
def test_json_line(line, text):
    assert extract.json_line_text(line) == text


def test_flat_json(spark):
    rows = spark.createDataFrame([('{"k": "v"}',), ('{"b": "2", "a": "1"}',), ('{"text": "t", "a": "1"}',)], "value string")
    assert [r.x for r in rows.select(extract.flat_json_text("value").alias("x")).collect()] == ["v", "1 2", "t"]


def test_column_names():
    assert [extract.is_text_column(n) for n in ("text_content", "my_sentence", "id", "timestamp")] == [True, True, False, False]


def test_plain_numbers(spark):
    values = [1.0, 0.5, -2.25, 1e21, 1.5e-7, 123456789.125, 0.0, float("nan")]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.x for r in rows.select(extract.plain_number(F.col("v")).alias("x")).collect()] == ["1", "0.5", "-2.25", "1000000000000000000000", "0.00000015", "123456789.125", "0", "NaN"]


def test_nested_extraction(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("data", T.StructType([T.StructField("a", T.ArrayType(T.StringType())), T.StructField("m", T.MapType(T.StringType(), T.IntegerType())), T.StructField("d", T.DateType())]))])
    rows = spark.createDataFrame([(1, (["x", None, "y"], {"k": 3}, None)), (2, None)], schema)
    assert [r.text for r in extract.extract_text(rows).collect()] == ["x y k 3", "2"]
    assert [r.text for r in extract.extract_text(rows, compat=True).collect()] == ["1", "2"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "one"}\n\n{"n": 2}\n')
    (tmp_path / "b.csv").write_text('id,Text\n1,"two, three"\n2,\n')
    (tmp_path / "c.txt").write_text("  four\n\nfive\n")
    texts, failed = readers.read_directory(spark, str(tmp_path))
    assert sorted((r.stem, r.text) for r in texts.collect()) == [("a", "2"), ("a", "one"), ("b", "two, three"), ("c", "  four"), ("c", "five")]
    assert failed == []
    assert readers.dataset_is_valid(spark, str(tmp_path / "c.txt"))
    assert readers.inspect_file(spark, str(tmp_path / "c.txt")).first().n_lines == 3
    spark.range(3).select(F.col("id").cast("string").alias("text")).coalesce(1).write.parquet(str(tmp_path / "p"))
    part = next((tmp_path / "p").glob("*.parquet"))
    part.rename(tmp_path / "odd.txt")
    assert readers.read_texts(spark, str(tmp_path / "odd.txt")).count() == 3


def test_csv_column_by_part_of_its_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,my_text\n1,one\n2,two\n")
    assert sorted(r.text for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()) == ["one", "two"]


def test_directory_isolates_bad_files(spark, tmp_path):
    for name, column in (("p one", "text"), ("q+two", "body")):
        spark.createDataFrame([(1, f"from {name}")], f"n long, {column} string").coalesce(1).write.parquet(str(tmp_path / "made"))
        next((tmp_path / "made").glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
        shutil.rmtree(tmp_path / "made")
    (tmp_path / "bad.parquet").write_bytes(b"nothing")
    (tmp_path / "ragged.csv").write_text("a,text\n1,x\n2,y,z\n")
    (tmp_path / "t.txt").write_text("line\n")
    (tmp_path / "j.json").write_text('{"text": "row"}\n')
    texts, failed = readers.read_directory(spark, str(tmp_path))
    assert sorted((r.stem, r.text) for r in texts.collect()) == [("j", "row"), ("p one", "from p one"), ("q+two", "from q+two"), ("t", "line")]
    assert sorted(p.rsplit("/", 1)[-1] for p, _ in failed) == ["bad.parquet", "ragged.csv"]


def test_valid_dataset_is_utf8(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("größe\nmore\n".encode())
    (tmp_path / "b.txt").write_bytes(b"one\n\xff\xfe\n")
    (tmp_path / "c.txt").write_bytes(b" \nx\n")
    assert [readers.dataset_is_valid(spark, str(tmp_path / f"{c}.txt")) for c in "abc"] == [True, False, False]
    assert readers.head(spark, str(tmp_path / "a.txt"), 4) == "grö".encode()


def test_extraction_by_own_patterns(spark):
    rows = spark.createDataFrame([(1, "a", "b"), (2, None, "c")], "n long, remark string, text string")
    assert [r.text for r in extract.extract_text(rows, patterns=["remark"]).collect()] == ["a", "2"]
    assert [r.text for r in extract.extract_text(rows, custom=F.upper("remark")).collect()] == ["A", "c"]
    assert [tuple(r) for r in extract.extract_text(rows, keep={"text": "kept"}).collect()] == [("1", "b"), ("2", "c")]


def test_tokens_file(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1, 2, 3]), (1, [4, 5, 6])], "seq_id long, tokens array<int>")
    writers.write_packed(rows, str(tmp_path / "t"), as_text=True)
    back = readers.read_tokens(spark, str(tmp_path / "t"))
    assert sorted(r.tokens for r in back.collect()) == [[1, 2, 3], [4, 5, 6]]
    assert readers.packed_file_is_valid(spark.read.text(str(tmp_path / "t")), 2)
    assert readers.token_lines(spark.createDataFrame([("1 x  3 -4",)], "value string")).first().tokens == [1, 3]


def test_functions_for_sql(spark):
    v = tokenize.Vocabulary(["ab", "a", "b"], [("a", "b")])
    assert registry.register(spark, v) == ["normalize_text", "json_line_text", "pack_tokens", "encode_text", "decode_ids"]
    row = spark.sql("""SELECT normalize_text('Héllo') AS n, json_line_text('{"text": "x"}') AS j, encode_text('ab') AS e, decode_ids(encode_text('aba')) AS d, encode_text(NULL) AS z""").first()
    assert (row.n, row.j, row.e, row.d, row.z) == ("hello", "x", [v.ids["ab"]], "ab a", [v.id("unk")])
    spark.createDataFrame([("x", 1, [1, 2, 3]), ("x", 2, [4, 5]), ("y", 1, [7]), ("x", 0, [0]), ("y", 2, None)], "k string, o int, tokens array<int>").createOrReplaceTempView("rows_to_pack")
    got = spark.sql("SELECT * FROM pack_tokens(TABLE(rows_to_pack) PARTITION BY (k) ORDER BY (o), 2)").collect()
    assert sorted(map(tuple, got)) == [("x", 0, [0, 1, 2]), ("x", 1, [3, 4, 5])]


def test_attention_masks(spark):
    rows = spark.createDataFrame([(1, p, [float(p)], [1.0], [float(p)], p == 2) for p in range(4)], "seq int, pos int, q array<double>, k array<double>, v array<double>, pad boolean")
    full = {r.pos: r.out[0] for r in mm.attention(rows).collect()}
    assert full == pytest.approx({p: sum(range(p + 1)) / (p + 1) for p in range(4)})
    near = {r.pos: r.out[0] for r in mm.attention(rows, window=1, padding="pad").collect()}
    assert near == pytest.approx({0: 0.0, 1: 0.5, 2: 1.0, 3: 3.0})
    both = {r.pos: r.out[0] for r in mm.attention(rows, window=1, causal=False).collect()}
    assert both == pytest.approx({0: 0.5, 1: 1.0, 2: 2.0, 3: 2.5})
    sloped = {r.pos: r.out[0] for r in mm.attention(rows, slope=1.0).collect()}
    w = [math.exp(-d) for d in range(4)]
    assert sloped[3] == pytest.approx(sum((3 - d) * w[d] for d in range(4)) / sum(w))


def test_dropout_keeps_the_mean(spark):
    rows = spark.range(200).select(mm.residual(F.array_repeat(F.lit(1.0), 50), F.array_repeat(F.lit(2.0), 50), 0.25, F.col("id")).alias("y"))
    values = [x for r in rows.collect() for x in r.y]
    assert {round(x, 9) for x in values} == {1.0, round(1 + 2 / 0.75, 9)} and abs(sum(values) / len(values) - 3) < 0.1
    assert one(spark, mm.dropout(F.array(F.lit(1.0)), 0.0)) == [1.0]


def test_special_tokens():
    v = tokenize.Vocabulary()
    assert len(v) == 11 and v.id("pad") == 0 and v.id("unk") == 3


def test_bpe_encode_ignores_rank():
    v = tokenize.Vocabulary(["a", "b", "c", "ab", "bc", "abc"], [("b", "c"), ("a", "b"), ("ab", "c")])
    assert [v.names[i] for i in tokenize.encode_bpe("abc", v)] == ["abc"]
    assert tokenize.encode_bpe("", v) == [v.id("unk")]


@pytest.mark.parametrize("algorithm", vocab.ALGORITHMS)
def test_trained_vocabulary_survives_a_file(spark, tmp_path, algorithm):
    rows = spark.createDataFrame([("hello world",), ("test message hello",), ("hello hello",)], "text string")
    v = vocab.train(rows, algorithm, 300 if algorithm == "bpe" else 60, byte_tokens=True)
    v.save(str(tmp_path / "v.json"), algorithm=algorithm)
    back = tokenize.Vocabulary.load(str(tmp_path / "v.json"))
    assert (back.ids, back.names, list(back.merges), back.special) == (v.ids, v.names, [tuple(m) for m in v.merges], v.special)
    encode = tokenize.ENCODERS[algorithm]
    assert encode("hello world", back) == encode("hello world", v) and v.id("unk") not in encode("hello", v)
    (tmp_path / "c.toml").write_text('vocab_size = 100\n[special_tokens]\nunk = "<?>"\n')
    assert tokenize.Vocabulary.load(str(tmp_path / "c.toml")).special["unk"] == "<?>"
    (tmp_path / "bad").write_text("{]")
    with pytest.raises(ValueError, match="neither"):
        tokenize.Vocabulary.load(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="unknown"):
        vocab.train(rows, "other", 10)


def test_wordpiece_training(spark):
    rows = spark.createDataFrame([("ab ab ab ca cb",)], "text string")
    got = [(r.left_token, r.right_token) for r in vocab.train_wordpiece(rows, 3).orderBy("rank").collect()]
    # c is in two words, each of its pairs once: 1 / (2 * 4); ab 3 / (4 * 4); then the rest.
    assert got[0] == ("a", "b") and len(got) == 3
    assert [(r.left_token, r.right_token) for r in vocab.train_wordpiece(rows, 3, compat=True).collect()] == [("a", "b")]


def test_wordpiece_and_unigram():
    v = tokenize.Vocabulary(["hel", "##lo", "h", "he", "llo"])
    assert [v.names[i] for i in tokenize.encode_wordpiece("hello help", v)] == ["hel", "##lo", "hel", "<|unk|>"]
    assert [v.names[i] for i in tokenize.encode_unigram("hellox", v)] == ["hel", "<|unk|>", "<|unk|>", "<|unk|>"]
    assert tokenize.decode_ids(tokenize.encode_wordpiece("hello", v), v) == "hello"


@pytest.mark.parametrize(("n", "want"), [(2, [1, 9, 9, 2, 0]), (3, [1, 9, 9, 9, 2]), (4, [1, 9, 9, 9, 9]), (5, [1, 9, 9, 9, 2]), (9, [1, 9, 9, 9, 2])])
def test_frame_batch(spark, n, want):
    assert one(spark, tokenize.frame_batch(F.array_repeat(F.lit(9), n), 1, 2, 5, 0)) == want


def test_attention_mask(spark):
    assert one(spark, tokenize.attention_mask(F.array(*[F.lit(x) for x in (1, 2, 0, 3, 0)]), 0)) == [1, 1, 0, 1, 0]


def test_bpe_training(spark):
    rows = spark.createDataFrame([("aaab",), ("aab",)], "text string")
    merges = [(r.left_token, r.right_token, r.n) for r in vocab.train_bpe(rows, 2).orderBy("rank").collect()]
    assert merges == [("a", "a", 3), ("a", "b", 1)]


def test_greedy_pieces(spark):
    assert one(spark, tokenize.greedy_pieces(F.lit("abcabd"), ["ab", "abc"])) == ["abc", "ab", "d"]


@pytest.mark.parametrize(("n", "starts"), [(4, []), (5, [0]), (6, [0, 1]), (10, [0, 5]), (11, [0, 5, 6])])
def test_line_windows(spark, n, starts):
    got = one(spark, pack.line_windows(F.sequence(F.lit(0), F.lit(n - 1)), 4))
    assert [w[0] for w in got] == starts and all(len(w) == 5 for w in got)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_pack_is_the_concatenation(spark, partitions):
    rows = spark.createDataFrame([(i, list(range(i * 10, i * 10 + i % 7))) for i in range(40)], "id long, tokens array<int>").repartition(partitions)
    flat = [x for i in range(40) for x in range(i * 10, i * 10 + i % 7)]
    got = {r.seq_id: r.tokens for r in pack.pack(rows, 8, "id").collect()}
    assert got == {k: flat[k * 9 : k * 9 + 9] for k in range(len(flat) // 9)}


@pytest.mark.parametrize(("n", "v"), [(1, 0), (2, 1), (10, 2), (11, 3)])
def test_validation_size(spark, n, v):
    rows = spark.range(n)
    assert pack.split(rows, "id", 0.2, 42).where("is_validation").count() == v


def test_stratified_split(spark):
    rows = spark.range(100).withColumn("len", F.col("id") % 20)
    got = pack.stratified_split(rows, "len", "id", 0.1, 42)
    assert got.count() == 100 and got.where("is_validation").count() == 20


def test_valid_batch(spark):
    lit = lambda rows: F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    a = lit([[1, 2, 3], [4, 5, 6]])
    assert one(spark, pack.valid_batch(a, lit([[2, 3, 4], [5, 6, 7]]), 100)) is True
    assert one(spark, pack.valid_batch(a, lit([[2, 3], [5, 6, 7]]), 100)) is False
    assert one(spark, pack.valid_batch(a, a, 5)) is False


def test_augment_rows_is_augment(spark):
    data = [(i, i % 3, list(range(i * 7 % 23))) for i in range(40)] + [(3, 1, [5, 6, 7, 8]), (3, 2, [5, 6, 7, 8]), (90, 0, None), (None, 0, [1, 2, 3])]
    rows = spark.createDataFrame(data, "id long, other int, tokens array<int>").repartition(3)
    for shuffle in (True, False):
        got = pack.augment_rows(rows, "tokens", "id", 50, 0.6, 4, shuffle, keep=("other",), out="y").collect()
        want = rows.where("id IS NOT NULL").select("id", "other", F.when(F.size("tokens") > 0, pack.augment(F.col("tokens"), F.col("id"), 50, 0.6, 4, shuffle)).otherwise(F.col("tokens")).alias("y")).collect()
        assert sorted(map(str, want)) == sorted(str(r) for r in got if r.id is not None) and len(got) == len(data)


def test_augment_keeps_length(spark):
    assert len(one(spark, pack.augment(F.array(*[F.lit(x) for x in range(5)]), F.lit(1), 100))) == 5


def test_fill_batch(spark):
    got = pack.fill_batch(spark.range(3), 4, "id", 1).collect()
    assert len(got) == 4 and sum(r.filled for r in got) == 1


def test_ema(spark):
    assert one(spark, series.ema(F.array(F.lit(1.0), F.lit(2.0)), 0.9)) == pytest.approx(1.1)


def test_loss_scale(spark):
    s = one(spark, series.loss_scale(F.array(F.lit(True), F.lit(False)), 65536.0))
    assert s.overflows == 1 and s.scale == 32768.0


def test_early_stop(spark):
    s = one(spark, series.early_stop(F.array(*[F.lit(x) for x in (3.0, 2.0, 2.0, 2.0, 1.0)]), 2, 0.0))
    assert s.best == 1.0 and s.stop_step == 4


@pytest.mark.parametrize(("n", "p99"), [(1, 1), (10, 10), (100, 100), (101, 101)])
def test_p99(spark, n, p99):
    rows = spark.range(1, n + 1).select(F.col("id").cast("double").alias("v"))
    assert series.latency(rows, "v").first().p99_ms == p99


def test_histogram_of_equal_values(spark):
    rows = spark.createDataFrame([(5.0,)] * 4, "v double")
    assert [(r.bin, r.n) for r in series.histogram(rows, "v").collect()] == [(0, 4)]


def test_bf16(spark):
    assert one(spark, series.bf16(F.lit(1.00390625 + 2**-9))) == 1.0
    assert one(spark, series.bf16(F.lit(-3.0))) == -3.0


def test_learning_rate(spark):
    lr = lambda s: one(spark, series.learning_rate(F.lit(s), "cosine", 1.0, 10, 110))
    assert lr(5) == pytest.approx(0.5) and lr(10) == pytest.approx(1.0) and lr(60) == pytest.approx(0.5) and lr(110) == pytest.approx(0.0, abs=1e-12)


def test_chat_keeps_the_last_messages(spark):
    rows = spark.createDataFrame([(0, 0, "system", "s")] + [(0, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(1, 30)], "c long, t long, role string, text string")
    p = chat.history(rows, "c", "t").select(chat.prompt(F.col("messages"), F.lit("now")).alias("p")).first().p
    assert p.startswith("<|system|>\ns\n") and "m8\n" not in p and "m9\n" in p and p.endswith("<|user|>\nnow\n<|assistant|>\n")


def test_responses(spark):
    assert one(spark, chat.split_responses(F.lit("Response 1\n---SEPARATOR---\n Response 2"), F.lit(3))) == ["Response 1", "Response 2", ""]


def test_rules(spark):
    mix = spark.createDataFrame([("a", 0.25), ("a", 0.25)], "name string, percentage double")
    assert sorted(r.severity for r in rules.mix_violations(mix).collect()) == ["error", "warning"]
    errors = spark.createDataFrame([("Config",), ("Network",), ("OutOfMemory",), ("Other",)], "error_type string")
    got = {r.error_type: (r.severity, r.recoverable, r.retry) for r in rules.classify_errors(errors).collect()}
    assert got == {"Config": ("error", False, False), "Network": ("warning", True, True), "OutOfMemory": ("critical", False, False), "Unknown": ("error", False, False)}


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    d = store.add_dataset("test_dataset", "hub", 1.5, 1)
    assert store.add_dataset("test_dataset", "hub", 2.0, 3) == d
    row = store.table("datasets").first()
    assert (row.size_gb, row.download_status, row.download_progress) == (2.0, "pending", 0.0)
    store.set_download_error(d, "gone")
    row = store.table("datasets").first()
    assert (row.retry_count, row.download_status, row.last_retry_at is not None) == (1, "error", True)
    run = store.insert("training_runs", config_hash="h", total_steps=10)
    store.update_run(run, 1, 2.0, "running")
    store.update_run(run, 2, 3.0, "running")
    assert store.table("training_runs").first().best_loss == 2.0
    assert {r.table_name: r.n for r in store.counts().collect()}["metrics"] == 2
    store.complete_run(run, 0.5)
    done = store.table("training_runs").first()
    assert (done.status, done.final_loss) == ("completed", 0.5) and done.end_time >= done.start_time
    failing = store.insert("training_runs", config_hash="g", total_steps=1)
    store.fail_run(failing, "lost")
    assert store.table("training_runs").where(F.col("id") == failing).first().end_time is not None
    assert store.table("system_events").first().event_type == "training_failed"
    store.delete_run(failing)
    store.compact("metrics")
    assert store.table("metrics").count() == 2
    store.delete_run(run)
    assert {r.table_name: r.n for r in store.counts().collect()} == dict.fromkeys([r.table_name for r in store.counts().collect()], 0) | {"datasets": 1}
    with pytest.raises(ValueError):
        store.insert("metrics", nothing=1)




def test_streams(spark, tmp_path):
    from loomspark.streaming import streams

    source = tmp_path / "in"
    spark.createDataFrame([(1, s, x) for s, x in enumerate([3.0, 2.0, 2.0, 2.0])], "run_id long, step long, loss double").coalesce(1).write.parquet(str(source))
    losses = spark.readStream.schema("run_id long, step long, loss double").parquet(str(source))
    query = streams.early_stops(losses, 2, 0.0).writeStream.format("memory").queryName("stops").outputMode("update").trigger(availableNow=True).start()
    query.awaitTermination(60)
    row = spark.table("stops").first()
    assert (row.best, row.stopped) == (2.0, True)


def test_first_violation(spark):
    v = lambda a, b: one(spark, pack.first_violation(F.array(*[F.array(*map(F.lit, x)) for x in a]), F.array(*[F.array(*map(F.lit, x)) for x in b]), 10))
    assert v([[1, 2]], [[2, 3]]) is None
    assert tuple(v([[1, 2], [3]], [[2, 3]])) == ("sizes", None, None)
    assert tuple(v([[1, 2], [3]], [[2, 3], [4, 5]])) == ("length", 1, None)
    assert tuple(v([[1, 12], [11]], [[20, 3], [4]])) == ("input", 0, 1)
    assert tuple(v([[1, 2], [3]], [[2, 3], [10]])) == ("target", 1, 0)


def test_nucleus_draws_follow_their_shares(spark):
    from loomspark.operators import modelmath as mm

    logits = F.array(*[F.lit(x) for x in (2.0, 1.0, 0.0, -3.0)])
    rows = spark.range(4000).select(mm.draw_nucleus(logits, 0.9, pack.uniform(1, F.col("id"))).alias("t")).groupBy("t").count().collect()
    got = {r.t: r["count"] / 4000 for r in rows}
    assert set(got) == {0, 1} or set(got) == {0, 1, 2}
    share = [math.exp(x) for x in (2.0, 1.0, 0.0)][: len(got)]
    assert all(abs(got[i] - s / sum(share)) < 0.03 for i, s in enumerate(share))
    assert one(spark, mm.draw_nucleus(logits, 0.5, F.lit(0.999999))) == 0


def test_stochastic_depth_keeps_the_first_layer(spark):
    from loomspark.operators import modelmath as mm

    rows = [r.k for r in spark.range(400).select(mm.kept_layers(F.lit(4), 0.8, F.col("id")).alias("k")).collect()]
    assert all(k[0] == 0 for k in rows) and abs(sum(3 in k for k in rows) / 400 - 0.4) < 0.1
    assert one(spark, mm.kept_layers(F.lit(0), 0.8, 1)) == []


def test_config_texts(spark):
    from loomspark.operators import configs, rules

    good = '[dataset]\nsize_gb = 2\nsource = "hub"\n[[dataset.mix]]\nname = "a"\npercentage = 1.0\n[model]\nnum_layers = "many"\nhidden_dim = 256\n[hardware]\ngpu_ids = [0, 0]\nuse_tf32 = true\n'
    got = {r.config_id: r for r in configs.read_configs(spark.createDataFrame([(1, good), (2, "x = ["), (3, None)], "config_id long, text string")).collect()}
    assert (got[1].size_gb, got[1].source, got[1].num_layers, got[1].hidden_dim, got[1].gpu_ids, got[1].use_tf32, got[1].mix_count) == (2.0, "hub", None, 256, [0, 0], True, 1)
    assert got[2].problem and got[2].hidden_dim is None and got[3].problem is None
    frame = configs.read_configs(spark.createDataFrame([(1, good.replace("256", "0"))], "config_id long, text string"))
    assert rules.config_violations(frame).where("section = 'model' AND severity = 'error'").count() > 0
