"""The pipeline's stages on small tables, and its queries against their SQL."""

from __future__ import annotations

import os

import numpy as np
import pytest
import regex

import corpus_pipeline
from loomspark.llm import decontaminate, queries
from tests.compare import DATA, check, duck
from tests.llm.test_operators import near_components

SF = f"{DATA}/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    check(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, SF), f"test-{name}")
        now = {r.doc_id for r in out.select("doc_id").collect()}
        assert now and now <= ids
        assert out.columns == columns or name == "mixing"
        docs, ids = out, now
    assert {"shard", "epoch"} <= set(docs.columns)


def words_of(t):
    return (t or "").encode().lower().split()


def lines_left(texts: dict) -> dict:
    """Each text without its lines that are similar to an earlier one; without those that lose all their words so."""
    seen, out = [], {}
    for i in sorted(texts):
        kept = []
        for line in (texts[i] or "").split("\n"):
            s = frozenset(words_of(line))
            gone = bool(s) and any(5 * len(s & b) >= 4 * len(s | b) for b in seen)
            seen.append(s)
            kept += [] if gone else [line]
        text = "\n".join(kept)
        if words_of(text) or len(kept) == (texts[i] or "").count("\n") + 1:
            out[i] = text
    return out


def clean_of(texts: dict, items: list[str]) -> set:
    """Documents in which no item is aligned with enough equal tokens in a window, by trying every place."""
    cut = lambda t: [x for x in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if x]
    ids: dict[str, int] = {}
    number = lambda ts: np.array([ids.setdefault(x, len(ids)) for x in ts])
    bench = [number(t) for t in map(cut, items) if len(t) >= decontaminate.MIN_TOKENS]
    clean = set()
    for i, text in texts.items():
        tokens = number(cut(text or ""))
        hit = False
        for item in bench:
            n = len(item)
            padded = np.concatenate((np.full(n, -1), tokens, np.full(n, -2))) if len(tokens) else np.full(2 * n, -1)
            equal = np.lib.stride_tricks.sliding_window_view(padded, n) == item
            w = min(n, decontaminate.WINDOW)
            need = w if n < decontaminate.SPAN else -(-w * 4 // 5)
            total = np.cumsum(np.pad(equal.astype(int), ((0, 0), (1, 0))), axis=1)
            hit = hit or bool((total[:, w:] - total[:, :-w] >= need).any())
        clean |= set() if hit else {i}
    return clean


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = texts
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), f"brute-{name}")
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality_rules":
            kept = {i for i, k in duck(SF).execute(f"SELECT doc_id, kept FROM ({queries.oracle_sql()['op9_quality_rules']})").fetchall() if k}
            want = {i: t for i, t in want.items() if i in kept}
        elif name == "line_dedup":
            want = lines_left(want)
        elif name == "near_dup":
            want = {i: want[i] for i, (_, c) in near_components(want, 5).items() if i == c}
        else:
            clean = clean_of(want, items)
            want = {i: t for i, t in want.items() if i in clean}
        assert got == want, name
        assert len(got) < len(texts)


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    kept = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert len(kept & good) <= len(good) * 0.3
