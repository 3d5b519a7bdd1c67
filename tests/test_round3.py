"""Findings of round 3, each with what failed before."""

from __future__ import annotations

import hashlib
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomspark.operators import attention, configs, draws, pack, parameters, series, tokenize
from tests.compare import DATA, check


@pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.1"), reason="no test tables")
def test_flat_parameters_round_as_floats(spark):
    assert check(spark, "flat_parameters", entry.queries()["flat_parameters"], entry.oracle_sql()["flat_parameters"], f"{DATA}/sf0.1") == 2000


def test_parameters_are_cut_at_their_sizes(spark):
    rows = spark.createDataFrame([("m", 2, [3.0, 4.0, 5.0]), ("m", 1, [1.0]), ("m", 3, []), (None, 1, [7.0])], "model string, name int, x array<float>")
    back = series.unflatten_parameters(series.flatten_parameters(rows, "model", "name", "x"), "model")
    assert {(r.model, r.name, tuple(r["values"])) for r in back.collect()} == {("m", 1, (1.0,)), ("m", 2, (3.0, 4.0, 5.0)), ("m", 3, ()), (None, 1, (7.0,))}


@pytest.mark.parametrize(("causal", "window", "alibi"), [(True, None, True), (False, None, False), (True, 3, False), (False, 2, True)])
def test_attention_over_many_tiles(spark, monkeypatch, causal, window, alibi):
    monkeypatch.setattr(attention, "FAN_IN", 3)
    monkeypatch.setattr(attention, "TILE", 4)
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


def _old_unigram(text, v):
    out, at = [], 0
    while at < len(text):
        end = next((e for e in range(min(len(text), at + tokenize.LONGEST_PIECE), at, -1) if text[at:e] in v.ids), None)
        out.append(v.id("unk") if end is None else v.ids[text[at:end]])
        at = at + 1 if end is None else end
    return out or [v.id("unk")]


def _old_wordpiece(text, v):
    out = []
    for word in text.split():
        at = 0
        while at < len(word):
            head = "##" if at else ""
            end = next((e for e in range(len(word), at, -1) if head + word[at:e] in v.ids), None)
            if end is None:
                out.append(v.id("unk"))
                break
            out.append(v.ids[head + word[at:end]])
            at = end
    return out or [v.id("unk")]


def _old_decode(ids, v):
    out = ""
    for i in ids:
        if i == v.id("eos"):
            break
        if i in {v.id("pad"), v.id("bos")}:
            continue
        token = v.names[i] if 0 <= i < len(v.names) else v.special["unk"]
        out += token[2:] if token.startswith("##") else " " + token[1:] if token.startswith("▁") else " " + token if out and not out.endswith(" ") else token
    return out.strip()


@pytest.mark.parametrize("tokens", [0, 2_000])
def test_encoders_agree_with_the_plain_rules(monkeypatch, tokens):
    monkeypatch.setattr(tokenize, "PATTERN_TOKENS", tokens)
    rng = random.Random(3)
    v = tokenize.Vocabulary(["ab", "abc", "abcabc", "b ", " ", "c", "▁", "▁ab", "##", "##b", "##bca", "x" * 25, "x" * 20, "x", "é"])
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", "c", " ", "x" * rng.randrange(1, 30), "é", "q", "\n"]) for _ in range(rng.randrange(40)))
        assert tokenize.encode_unigram(text, v) == _old_unigram(text, v)
        assert tokenize.encode_wordpiece(text, v) == _old_wordpiece(text, v)
        ids = [rng.randrange(-1, len(v) + 2) for _ in range(rng.randrange(30))]
        assert tokenize.decode_ids(ids, v) == _old_decode(ids, v), [v.names[i] if 0 <= i < len(v) else i for i in ids]


def test_unigram_takes_no_twenty_slices_for_each_character():
    v = tokenize.Vocabulary([*"abcdefgh", "abc", "de"])
    text = "abcdefghi" * 20_000
    times = []
    for one in (tokenize.encode_unigram, _old_unigram):
        start = time.perf_counter()
        one(text, v)
        times.append(time.perf_counter() - start)
    assert 2 * times[0] < times[1]


def test_packing_by_a_value(spark):
    data = [("a", 2, [1, 2, 3]), ("a", 1, [4, 5]), (None, 3, [6, 7, 8, 9]), (None, 0, [1]), ("b", 5, []), ("a", 9, list(range(20)))]
    got = pack.pack(spark.createDataFrame(data, "k string, o long, tokens array<int>"), 2, "o", by="k").collect()
    want = {}
    for k in ("a", None, "b"):
        flat = [x for _, _, xs in sorted((r for r in data if r[0] == k), key=lambda r: r[1]) for x in xs]
        want |= {(k, i): flat[3 * i : 3 * i + 3] for i in range(len(flat) // 3)}
    assert {(r.k, r.seq_id): r.tokens for r in got} == want


def test_costly_rows_of_one_file_are_dealt(spark):
    one = spark.range(40).coalesce(1)
    assert configs.read_configs(one.select(F.col("id").alias("config_id"), F.lit("[model]").alias("text"))).rdd.getNumPartitions() >= 4
    small = one.select(F.col("id").alias("config_id"), *[F.lit(2).alias(c) for c in ("vocabulary", "hidden", "layers", "ffn", "kv_size", "positions")], *[F.lit(True).alias(c) for c in ("tied", "attention_bias", "ffn_bias", "gated", "norm_bias")])
    assert parameters.catalogue(small).rdd.getNumPartitions() >= 4


@pytest.mark.parametrize("prefix", ["7:12345:", "", "1:" + "k" * 60 + ":"])
def test_draws_are_md5(prefix):
    n = 1205
    got = draws.place_draws(prefix, n)
    for i in (0, 9, 10, 99, 100, 999, 1000, n - 1):
        assert "".join(f"{x:08x}" for x in got[:, i].tolist()) == hashlib.md5(f"{prefix}{i}".encode()).hexdigest()
