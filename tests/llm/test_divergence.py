"""Source divergence against plain counting, and against its SQL on the smallest tables."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import pytest

from loomspark.llm import divergence as dv
from loomspark.llm import queries, query_sql
from tests.compare import DATA, check

B = 1_000_000_000


def plain(rows):
    docs = [(lang or "", source or "", re.findall(dv.TERM, (text or "").translate(str.maketrans(dv.UPPER, dv.LOWER)))) for lang, source, text in rows]
    holders, counts, groups = Counter(), Counter(), defaultdict(set)
    for lang, source, words in docs:
        groups[lang].add(source)
        holders.update({(lang, w) for w in words})
        counts.update((lang, source, w) for w in words)
    out = []
    for lang, sources in groups.items():
        kept = [t for (la, t), n in holders.items() if la == lang and n >= 3]
        v = len(kept)
        n = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + B * (counts[lang, s, t] + 1) // (n[s] + v) for t in kept} for s in sources}
        q = {t: 1 + B * (sum(counts[lang, s, t] for s in sources) + 1) // (sum(n.values()) + v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, None), ("term", terms, 200)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:top])]
    return sorted(out)


def got(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, term string").repartition(4)
    return sorted(map(tuple, dv.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()))


def texts(seed, n, vocabulary=40):
    rng = random.Random(seed)
    words = [w for i in range(vocabulary) for w in (f"w{'abcdefghij'[i % 10]}{'klmnop'[i // 10 % 6]}", f"Ünï{'abcd'[i % 4]}")]
    return [(rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"]), rng.choice(["", None, " ", "1 2"]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for _ in range(n)]


def test_random_texts(spark):
    rows = texts(1, 120)
    assert got(spark, rows) == plain(rows)


def test_pieces_shards_and_cut_texts(spark, monkeypatch):
    monkeypatch.setattr(dv, "PIECE_ROWS", 7)
    monkeypatch.setattr(dv, "COUNT_BYTES", 500)
    monkeypatch.setattr(dv, "CUT_CHARS", 20)
    rows = texts(2, 150)
    assert got(spark, rows) == plain(rows)


def test_edges(spark):
    assert got(spark, []) == []
    for rows in (
        [("en", "a", None), ("en", "b", "1 2"), (None, None, "x"), ("fr", "z", "un")],  # no kept terms anywhere
        [("en", "a", "Ab ab AB"), ("en", "a", "ab"), ("en", "b", "ab ab"), ("en", "b", ""), ("en", "c", None)],  # one term, a source without any
        [("en", s, "tie tae xÜyü") for s in "aab"] * 2,  # equal values, repeated rows
        [("en", "a", "word " * 30_000), ("en", "b", "word" * 30_000), ("en", "b", "word other"), ("en", "c", "word other"), ("en", "a", "other")],  # very long texts and words
    ):
        assert got(spark, rows) == plain(rows)


def test_large_counts_use_a_wider_type():
    assert "HUGEINT" in dv.piece_sql("HUGEINT")[0] and "1000000000::BIGINT" in dv.piece_sql("BIGINT")[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_as_its_sql(spark):
    assert check(spark, "op12_divergence", queries.op12_divergence, query_sql.op12(), f"{DATA}/sf0.01") > 1000
