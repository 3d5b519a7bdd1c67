"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, clashing columns and empty tables."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from loomspark.llm import decontaminate, html_text, line_dedup, mixing, near_dup, pii, quality_rules, quality_score, revisits, substring_dedup

# Names that the operators use for columns of their own.
EXTRA = "h size n label rep words key kind bucket line value row_id k1 at text_a".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in EXTRA)
BENCH = "one question about the river and the seven stones that lie under the old bridge in winter"
GOOD = "The river runs past the old house, and the people of the town walk there in the evening. They talk of the day and of the work that is to be done. "


def messy() -> list[tuple]:
    texts = [
        (None, GOOD * 3), (None, None), (1, None), (2, ""), (3, "  \n\t "), (4, GOOD * 4), (5, GOOD * 4), (5, GOOD * 4), (6, GOOD * 2 + "\n" + GOOD * 2), (6, GOOD * 2 + "\n" + GOOD * 2),
        (7, "word"), (8, "word"), (9, " ".join(f"w{i % 977}x{i % 89}" for i in range(60_000))), (10, "字" * 50_000), (11, "a " * 40_000), (12, "\n" * 20_000), (13, BENCH + " " + GOOD * 2), (14, "x" * 100_000),
        (15, GOOD.replace("river", "canal") * 4), (16, "mail a.b@c.example.org now"),
    ]
    return [(i, t, None if k % 3 else "en", None if k % 4 == 0 else "s", 0, *range(len(EXTRA))) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("messy") / "documents.parquet")
    spark.createDataFrame(messy(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, BENCH), (1, BENCH), (2, None), (3, ""), (None, "no id here but five words")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (5, 1, None), (6, 1, 0), (15, 1, 0), (10, 0, 0), (11, 0, 0), (14, 0, 0), (9, 0, 0), (None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")


N = len(messy())


def test_mixing(docs):
    rows = mixing.taken_words(mixing.plan_mix(docs)).collect()
    assert len(rows) == N and all(r.taken == 0 for r in rows if r["size"] == 0) and all(r.taken <= 3 * r["size"] for r in rows)
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "shard", "epoch"] and all(r.h == 0 and r.size_of == 1 for r in out.selectExpr("h", "size AS size_of").collect())
    assert mixing.mix(docs.limit(0)).count() == 0


def test_substrings(docs):
    rows = substring_dedup.dedup_report(docs).collect()
    assert len(rows) == N
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[1].n_bytes, by[1].n_removed, by[1].kept_sha256) == (0, 0, hashlib.sha256(b"").hexdigest())
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None) and by[4].n_removed > 0 and by[5].n_removed == by[5].n_bytes
    assert by[14].n_removed == 100_000 - 1 and by[10].n_removed == 150_000 - 3
    assert substring_dedup.dedup_report(docs.limit(0)).count() == 0


def test_quality_score(docs, labels):
    rows = quality_score.score_documents(docs, quality_score.fit_labels(docs, labels)).collect()
    assert len(rows) == N and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality_score.score_documents(docs.limit(0), 0.5).count() == 0 and quality_score.fit_labels(docs.limit(0), labels) == 0.5


def test_quality_score_is_the_density_difference():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(80, 4)) @ rng.normal(size=(4, 4)), rng.normal(size=(60, 4)) * 0.5 + 1])
    y = np.repeat([0, 1], [80, 60])
    model = quality_score._fit(x, y)
    z = (x - x.mean(0)) / (x.std(0) + 1e-6)
    covs = [np.cov(z[y == k].T, bias=True) for k in (0, 1)]
    pooled = (80 * covs[0] + 60 * covs[1]) / 140
    density = []
    for k, share in ((0, 80 / 140), (1, 60 / 140)):
        c = (1 - quality_score.POOLED_SHARE) * covs[k] + quality_score.POOLED_SHARE * pooled
        c = (1 - quality_score.RIDGE_SHARE) * c + quality_score.RIDGE_SHARE * np.trace(c) / 4 * np.eye(4)
        d = z - z[y == k].mean(0)
        density.append(np.log(share) - 0.5 * np.log(np.linalg.det(c)) - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.margin(x), density[1] - density[0])


def test_lines(docs):
    rows = line_dedup.report(docs, short=True).collect()
    assert len(rows) == N and all(r.n_removed == 0 for r in rows if r.doc_id is None)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_lines, by[2].n_lines, by[12].n_lines, by[8].n_removed) == (0, 1, 20_001, 1)
    out = line_dedup.dedup_lines(docs, short=True)
    assert out.columns == docs.columns and 8 not in {r.doc_id for r in out.collect()}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_many_removed_lines_of_one_document(spark):
    text = "\n".join(f"line {i % 3000} of many words {i % 3000} here" for i in range(9000))
    rows = spark.createDataFrame([(1, text), (2, " ".join(f"t{i}" for i in range(50_000)))], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.report(rows, short=True).collect()}
    assert (got[1].n_lines, got[1].n_removed, got[2].n_removed) == (9000, 6000, 0)
    assert got[1].kept_sha256 == hashlib.sha256("\n".join(text.split("\n")[:3000]).encode()).hexdigest()


def test_keys_grow_with_the_line():
    token = np.arange(1, 5001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys, ranks = np.zeros(line_dedup.SLOTS, np.uint64), np.zeros(line_dedup.SLOTS, np.uint64)
    slot = (token & np.uint64(line_dedup.SLOTS - 1)).astype(np.int64)
    keys[slot], ranks[slot] = token, (np.uint64(1) << np.uint64(18)) + np.arange(1, 5001, dtype=np.uint64)  # all of them very frequent
    assert len(line_dedup.line_keys(token, np.zeros(5000, np.int64), (keys, ranks))["key"]) < 5000


def test_pii(docs):
    rows = pii.find_pii(docs).collect()
    assert len(rows) == N and {r.doc_id: r.n_email for r in rows}[16] == 1 and not any(r.has_any for r in rows if r.doc_id in (1, 2, 12))
    assert pii.find_pii(docs.limit(0)).count() == 0


def test_near_duplicates(docs):
    rows = near_dup.find_groups(docs).collect()
    assert len(rows) == N
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_shingles, by[2].component_id, by[5].component_id, by[8].component_id, by[None].component_id) == (0, 2, 4, 7, None)
    out = near_dup.keep_one(docs)
    assert out.columns == docs.columns and out.where("doc_id IS NULL").count() == 2 and {5, 8}.isdisjoint({r.doc_id for r in out.collect()})
    assert near_dup.keep_one(docs.limit(0)).count() == 0


def test_decontamination(docs, bench):
    rows = decontaminate.report(docs, bench).collect()
    assert len(rows) == N and {r.doc_id for r in rows if r.contaminated} == {13}
    out = decontaminate.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and out.count() == N - 1
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == N and decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_quality_rules(docs):
    rows = quality_rules.score_rules(docs).select("doc_id", "_q.n_words", "_q.base_failed", "_q.kept").collect()
    assert len(rows) == N and all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3, 7, 11, 12))
    out = quality_rules.keep_good(docs)
    assert out.columns == docs.columns and quality_rules.keep_good(docs.limit(0)).count() == 0


def test_pages(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", "<p>" + "long text " * 30_000 + "</p>"), (2, None, "<" * 5000), (3, "v", "<div>" * 3000 + "deep text"), (4, "w", "<p>" + "字" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_text.extract_pages(pages.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    assert [r.n_chars for r in got][:3] == [0, 0, 299_999] and got[4].text == "deep text" and got[5].n_chars == 100_000
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def test_revisits(spark):
    pages = spark.createDataFrame([(None, None, None), (3, None, "x"), (6, "a.org", None), (6, "a.org", None)], "page_id long, url string, html string")
    done = revisits.resolve(revisits.records_of_pages(pages))
    assert done.where("canonical_url IS NULL AND coalesce(resolved, false)").count() == 0
    assert done.where("record_id = 49 AND resolved").count() == 2
    assert revisits.resolve(revisits.records_of_pages(pages.limit(0))).count() == 0


def test_stages(spark, docs, bench, tmp_path):
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        now = corpus_pipeline.materialize(stage(spark, now, str(tmp_path)), f"edge-{name}")
        assert now.columns[: len(columns)] == columns
    assert 13 not in {r.doc_id for r in now.collect()}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
