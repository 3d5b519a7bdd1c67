"""Rows of one doc_id with different texts, and class names of pages that are or are not page furniture."""

from __future__ import annotations

import hashlib

import pytest

import corpus_pipeline
from loomspark.llm import decontaminate, html_text, line_dedup, near_dup, quality_score, substring_dedup
from loomspark.llm.identity import with_key

LONG = "".join(chr(97 + i * 7 % 26) + chr(97 + i * i % 26) for i in range(150))
OTHER = "".join(chr(97 + i * 11 % 26) + chr(97 + (i * i + i // 3) % 26) for i in range(150))


def plain_substrings(rows, span=100):
    """Rows to (doc_id, n_removed, digest of the rest); texts of one doc_id follow each other by digest."""
    order = sorted({(i, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in rows if i is not None})
    seen, out = set(), {}
    for i, sha, t in order:
        data, gone = t.encode(), set()
        for k in range(len(data) - span + 1):
            s = data[k : k + span]
            if s in seen:
                gone.update(range(k, k + span))
            seen.add(s)
        out[i, t] = (len(gone), hashlib.sha256(bytes(b for k, b in enumerate(data) if k not in gone)).hexdigest())
    return sorted((i, len(t.encode()), *out.get((i, t), (0, hashlib.sha256(t.encode()).hexdigest()))) for i, t in rows)


@pytest.mark.parametrize(
    "rows",
    [
        [(1, LONG), (1, OTHER)],
        [(1, LONG), (1, OTHER), (2, LONG[:150]), (2, "x" + OTHER)],
        [(5, LONG + OTHER), (5, OTHER + LONG), (5, LONG + OTHER), (4, "short"), (9, LONG)],
        [(-3, OTHER), (7, LONG), (7, LONG), (8, "y" + LONG)],
        [(2**62, LONG), (2**62, LONG + "z"), (-(2**62), OTHER), (3, OTHER + LONG)],
    ],
)
def test_substrings_of_repeated_ids(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.dedup_report(docs).select("doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == plain_substrings(rows)


def test_lines_of_repeated_ids(spark):
    rows = [(1, "a b c d e f\none line of its own here"), (1, "x y z u v w\na b c d e f\nnot found anywhere else at all"), (1, "x y z u v w\na b c d e f\nnot found anywhere else at all"), (2, "x y z u v w"), (None, "a b c d e f")]
    order = sorted({(i, hashlib.sha256(t.encode()).hexdigest(), t) for i, t in rows if i is not None})
    seen, want = set(), {}
    for i, _, t in order:
        lines = t.split("\n")
        want[i, t] = sum(x in seen for x in lines)
        seen.update(lines)
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n_chars long").repartition(2)
    got = line_dedup.report(docs, short=True).collect()
    assert sorted((r.doc_id or 0, r.n_lines, r.n_removed) for r in got) == sorted((i or 0, t.count("\n") + 1, want.get((i, t), 0)) for i, t in rows)
    left = " ".join(r.text for r in corpus_pipeline.dedup_lines(spark, docs, "").collect())
    for unique in ("one line of its own here", "not found anywhere else at all", "x y z u v w", "a b c d e f"):
        assert unique in left


def test_other_operators_on_repeated_ids(spark):
    """A row for each row, and verdicts of a doc_id hold for all of its rows where documents are compared."""
    good = "The river runs past the old house and the people of the town walk there in the evening and talk of the day"
    passage = "what is the name of the seven stones that lie under the old bridge in winter time"
    rows = [(1, good), (1, passage + " " + good), (2, good), (2, None), (3, "something else that nobody wrote before at all")]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    bench = spark.createDataFrame([(9, passage), (4, passage), (None, "x")], "item_id long, text string")
    report = decontaminate.report(docs, bench).collect()
    assert len(report) == 5 and {r.doc_id for r in report if r.contaminated} == {1}
    assert {(r.doc_id, r.item_id) for r in decontaminate.alignments(docs, bench).collect()} == {(1, 4)}  # equal items count once, under their least id
    scores = quality_score.score_documents(docs, 0.25).collect()
    assert len(scores) == 5
    groups = near_dup.find_groups(docs, width=4).collect()
    assert len(groups) == 5 and all(r.component_id == r.doc_id or r.component_id == 1 for r in groups)


def test_keys(spark):
    rows = [(3, "a"), (3, "a"), (1, None), (None, "q"), (2, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r._key) for r in with_key(docs).collect()} == {(3, 3), (1, 1), (None, None), (2, 2)}
    more = with_key(docs.union(spark.createDataFrame([(3, "c"), (1, "")], docs.schema))).collect()
    assert len(more) == 7 and len({(r.doc_id, r._key) for r in more}) == 5
    by = sorted((r._key, r.doc_id) for r in more if r.doc_id is not None)
    assert [i for _, i in by] == [1, 1, 2, 3, 3, 3] and with_key(docs.limit(0)).count() == 0


KEPT = "social-studies market-share related-work ad-hoc cookie-recipes banner-year informed-consent modal-logic menu-of-the-day share-price comment-on-policy newsletter-history header-bidding-explained notice-of-award tags-and-labels sponsor-of-the-bill social-security promoted-officers respond-to-crisis".split()
GONE = "ad ads sidebar main-sidebar site-footer comments reader-comments comment-list user-comments social social-share social-links share share-buttons related related-posts related-articles cookie-notice cookie-banner cookie-consent newsletter-signup page-header site-header header top-menu menu main-nav nav-bar breadcrumbs banner-ad top-ad google-ad advert sponsored-content popup modal-overlay promo promo-box subscribe-form post-tags tags skip-link notice widget-area pagination".split()
PARAGRAPHS = "".join(f"<p>Paragraph {i} of this article says something about rivers, towns and the people who live there.</p>" for i in range(4))


@pytest.mark.parametrize("name", KEPT)
def test_plain_words_in_classes_keep_their_text(name):
    for page in (f'<article><p>First words of the article that stand before.</p><div class="{name}">{PARAGRAPHS}</div></article>', f'<article><section id="{name}">{PARAGRAPHS}</section></article>'):
        assert html_text.extract_text(page).count("Paragraph") == 4


@pytest.mark.parametrize("name", GONE)
def test_furniture_goes(name):
    page = f'<article>{PARAGRAPHS}<div class="{name}"><p>Unwanted words that stand here for whatever reason there is.</p></div>{PARAGRAPHS}</article>'
    got = html_text.extract_text(page)
    assert "Unwanted" not in got and got.count("Paragraph") == 8


def test_large_keys_are_searched_by_pairs_of_chunks():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = np.zeros(700, line_dedup.ROW)
    base = rng.integers(0, 1 << 62, 40, dtype=np.uint64)
    rows["doc"], rows["line"], rows["n"], rows["pos"] = np.arange(700) // 3, np.arange(700) % 3, 20, 0
    pick = rng.integers(0, 40, 700)
    rows["bits"], rows["more"] = base[pick] ^ (np.uint64(1) << rng.integers(0, 60, 700, dtype=np.uint64)), base[pick]
    lines = line_dedup._Lines(rows)
    i, j, _ = lines.pairs(0, 700, lines, slice(0, 700))
    every = {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a < b}
    size, found, more = 256, set(), {}
    cuts = [rows[k : k + size] for k in range(0, 700, size)]
    at = {(int(r["doc"]), int(r["line"])): k for k, r in enumerate(rows)}
    for x in range(len(cuts)):
        for y in range(x, len(cuts)):
            part = [(7, n, cuts[n].tobytes()) for n in {x, y}]
            got = line_dedup._meet_blocks(pa.table({"key": [p[0] for p in part], "no": [p[1] for p in part], "rows": [p[2] for p in part]})).to_pylist()
            pairs = {(at[r["doc_a"], r["line_a"]], at[r["doc_b"], r["line_b"]]) for r in got if r["kind"] == line_dedup.PAIR}
            assert pairs <= every
            found |= pairs
            for r in got:
                if r["kind"] == line_dedup.SEEKER:
                    more.setdefault(at[r["doc_b"], r["line_b"]], set()).add((x, y))
    assert len(every) > 2000
    for a, b in every - found:  # what is left out belongs to a line that seeks on in its own and all other chunks
        assert b in more
