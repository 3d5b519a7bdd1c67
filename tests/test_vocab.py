"""Merges learned in rounds against the plain loop, which takes one merge at a time."""

from __future__ import annotations

import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomspark.operators import vocab
from tests.compare import DATA


def plain(texts: list[str], n: int) -> list[tuple]:
    lines = Counter(line for t in texts for line in re.split(f"[\n{vocab.OPEN}{vocab.CLOSE}]", t))
    words = [(m, list(line)) for line, m in lines.items()]
    out = []
    for rank in range(n):
        pairs = Counter()
        for m, w in words:
            for p in zip(w, w[1:], strict=False):
                pairs[p] += m
        if not pairs:
            break
        (a, b), count = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        out.append((rank, a, b, count))
        for _, w in words:
            i = 0
            while i < len(w) - 1:
                if w[i] == a and w[i + 1] == b:
                    w[i : i + 2] = [a + b]
                i += 1
    return out


@pytest.mark.parametrize("seed", [0, 2, 4])
def test_rounds_agree_with_the_loop(spark, seed):
    rng = random.Random(seed)
    letters = "ab" if seed == 0 else "abc d" if seed < 3 else "abcdefgh ijé"
    texts = ["\n".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(4)) for _ in range(12)] + ["aaaa aaaaaaa", "", "x﷐y"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found, rounds = vocab.learn_merges(rows, 16)
    assert found == plain(texts, 16)
    assert rounds <= len(found)


def test_ties_that_a_new_pair_could_win(spark):
    texts = ["azy azy azy md md md", "zq"]  # after (a, z) the pair (az, y) ties with (m, d), and comes first
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert vocab.learn_merges(rows, 12)[0] == plain(texts, 12)
    assert vocab.learn_merges(rows, 12, look=3)[0] == plain(texts, 12)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_hundreds_of_merges(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").where(F.col("text").isNotNull()).select("text").collect()][:60]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    found, rounds = vocab.learn_merges(rows, 200)
    assert found == plain(texts, 200)
    assert len(found) == 200 and rounds < 80


@pytest.mark.parametrize(("size", "longest"), [(7, 4), (60, 3), (100_000, 5)])
def test_substrings_level_by_level(spark, size, longest):
    rng = random.Random(size)
    texts = ["\n".join("".join(rng.choice("ab cé") for _ in range(rng.randrange(12))) for _ in range(3)) for _ in range(15)] + ["", None]
    counts = Counter(line[i : i + n] for t in texts if t for line in t.split("\n") for i in range(len(line)) for n in range(1, longest + 1) if i + n <= len(line))
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [(r.token, r.n) for r in vocab.frequent_substrings(rows, size, longest).orderBy(F.desc("n"), "token").collect()]
    assert got == sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size]
    assert vocab.frequent_substrings(rows.limit(0), size, longest).count() == 0
