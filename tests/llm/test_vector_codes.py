"""Vector codes against a plain loop over Python's integers."""

from __future__ import annotations

import hashlib
import math
import os
import random
from collections import defaultdict

import pytest

from loomspark.llm import vector_codes as vc
from loomspark.llm.queries import op11_vector_codes
from tests.compare import DATA


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts) * parts
    kept = [(i, v + [0] * (width - len(v)), label) for i, v, label in kept]
    w = width // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    first = {}
    for i, v, _ in kept:
        first[i] = min(first.get(i, v), v)
    start = [first[i] for i in sorted(first, key=lambda i: (i is None, i or 0))[:entries]]
    books = [[cut(v)[p] for v in start] for p in range(parts)]

    def assign(v):
        code, error = [], 0
        for p, x in enumerate(cut(v)):
            d = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
            code.append(d.index(min(d)))
            error += min(d)
        return code, error

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v, _ in kept:
            for p, e in enumerate(assign(v)[0]):
                groups[p, e].append(cut(v)[p])
        for (p, e), xs in groups.items():
            books[p][e] = [sum(c) // len(c) for c in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    final = [(i, label, *assign(v)) for i, v, label in kept]
    by = defaultdict(int)
    for _, label, _, error in final:
        by[label] += error
    return sorted(((i, "".join(f"{c:02x}" for c in code), error, by[label], sha) for i, label, code, error in final), key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, label, "x") for i, v, label in rows], f"vec_id long, embedding array<{kind}>, label int, code string").repartition(3)


def got(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def vectors(seed, n, dim, pool=None):
    rng = random.Random(seed)
    draw = lambda: [rng.choice(pool) if pool else rng.randrange(-5000, 5000) / 4096 + 1 / 8192 for _ in range(dim)]
    return [(i, draw(), rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("dim", [8, 24])
def test_random_vectors(spark, dim):
    rows = vectors(dim, 150, dim)
    assert got(vc.report(frame(spark, rows))) == plain(rows)


def test_ties_and_unused_entries(spark):
    rows = vectors(5, 120, 16, [0.0, 0.25, -0.25])  # few different parts: equal entries, ties, entries that nobody uses
    assert got(vc.report(frame(spark, rows))) == plain(rows)


def test_dropped_repeated_short_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None, 1), (2, [1.0, None] * 8, 1), (3, [nan] * 16, 2), (4, [1.0] * 15 + [inf], 2), (5, [-inf] * 16, None)]
    rows = bad + vectors(7, 9, 16) + [(3, [0.5] * 16, 1), (3, [0.5] * 16, 1), (3, [-0.5] * 16, None), (None, [0.1] * 16, 7), (11, [0.5] * 3, 1), (12, [], 1)]
    assert got(vc.report(frame(spark, rows))) == plain(rows)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([1e9, -3e10, 2.5e11, 0.125]) for _ in range(8)], i % 2) for i in range(40)]
    want = [(i, c, min(e, vc.MAX_LONG), min(t, vc.MAX_LONG), s) for i, c, e, t, s in plain(rows)]
    assert got(vc.report(frame(spark, rows, "double"))) == want


def test_nothing_to_code(spark):
    assert got(vc.report(frame(spark, []))) == []
    assert got(vc.report(frame(spark, [(1, None, 1), (2, [None], 1)]))) == []
    assert [r[:4] for r in got(vc.report(frame(spark, [(1, [], 1)])))] == [(1, "", 0, 0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert got(op11_vector_codes(spark, f"{DATA}/sf0.001")) == plain(rows)
