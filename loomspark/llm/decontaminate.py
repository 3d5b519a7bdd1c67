"""Benchmark decontamination by spaced seeds.

Texts become lower-case runs of letters and digits. A mask names the token positions of a window
that count; the others are ignored, so that a substituted token there does not hide a passage. For
every position and mask the counted tokens of training documents and benchmark items are hashed and
joined. A hit fixes an alignment of an item with a document; along it the tokens are compared, and
the document is contaminated if some window of ``WINDOW`` aligned tokens (the whole item, if it is
shorter) agrees in at least ``SHARE`` of its places.

Items of fewer tokens than the longest mask but at least ``MIN_TOKENS`` are searched as one exact
run of their own length; shorter items are ignored, as they say nothing.

Only built-in functions run on the path. The benchmark side is broadcast only if its bytes, which are
counted first, are at most ``BROADCAST_BYTES``; otherwise the join shuffles. Items of equal tokens count once, under their least id.

Edge cases: null or empty texts and null items have no tokens, hence no hits; repeated rows of
documents each get the verdict of their doc_id's alignments (a null doc_id is its own key); an empty
benchmark contaminates nothing; extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.words import text_or_empty
from loomspark.session import materialize

# Counted positions of each mask: fixed values. They part the span into three, so that any two substitutions
# (the most a window of 12 or 13 tokens may have) leave one mask untouched.
MASKS = ((0, 3, 6, 9), (1, 4, 7, 10), (2, 5, 8, 11))
SPAN = 12
WINDOW = 13
SHARE = 0.8
MIN_TOKENS = 5
#: Bytes of seeds and item tokens up to which they are broadcast; a seed's row takes some SEED_BYTES in a hashed relation.
BROADCAST_BYTES = 64 << 20
SEED_BYTES = 64


def tokens(text: str | Column) -> Column:
    """Hashes of the lower-case letter and digit runs of a text."""
    return F.transform(F.array_remove(F.split(F.lower(text_or_empty(text)), "[^\\p{L}\\p{N}]+"), ""), lambda w: F.xxhash64(w))


def _seeds(token: Column, mask: tuple[int, ...], span: int, tag: int) -> Column:
    """Hash at every window start; the tag keeps masks apart."""
    n = F.size(token)
    at = lambda i: F.xxhash64(F.lit(tag), *[F.get(token, i + k) for k in mask])
    return F.when(n >= span, F.transform(F.sequence(F.lit(0), n - span), at))


def _exploded(rows: DataFrame, keep: list[str], seeds: Column) -> DataFrame:
    return rows.select(*keep, F.posexplode(seeds).alias("at", "seed"))


def _need(n: int) -> int:
    return math.ceil(SHARE * n - 1e-9)


def alignments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Verified (doc_id, item_id, shift, matched): item token j stands at document token j + shift."""
    bench = items.select("item_id", tokens("text").alias("b")).where(F.size("b") >= MIN_TOKENS).groupBy("b").agg(F.min("item_id").alias("item_id"))
    bench = materialize(bench, "decon-items")
    short = sorted(r.n for r in bench.where(F.size("b") < SPAN).select(F.size("b").alias("n")).distinct().collect())
    patterns = [*((m, SPAN, k) for k, m in enumerate(MASKS)), *((tuple(range(n)), n, 100 + n) for n in short)]
    token = docs.select("doc_id", tokens("text").alias("t"))
    long_items, b = bench.where(F.size("b") >= SPAN), F.col("b")
    parts = []
    for mask, span, tag in patterns:
        source = long_items if span == SPAN else bench.where(F.size("b") == span)
        parts.append(_exploded(source, ["item_id"], _seeds(b, mask, span, tag)))
    wanted = parts[0]
    for p in parts[1:]:
        wanted = wanted.unionByName(p)
    wanted = materialize(wanted.withColumnRenamed("at", "b_at").distinct(), "decon-seeds")
    held = wanted.limit(BROADCAST_BYTES // SEED_BYTES + 1).count() * SEED_BYTES + (bench.agg(F.sum(F.size("b"))).first()[0] or 0) * 8
    small = held <= BROADCAST_BYTES
    side = F.broadcast(wanted) if small else wanted
    # All masks of a position in one array, so that the tokens of a document are made once.
    n_tokens = F.size("t")
    every = F.concat(*[F.coalesce(F.transform(_seeds(F.col("t"), m, s, g), lambda h, i: F.struct(h.alias("seed"), i.alias("at"))), F.array().cast("array<struct<seed:bigint,at:int>>")) for m, s, g in patterns])
    emitted = token.where(n_tokens >= MIN_TOKENS).select("doc_id", F.explode(every).alias("e")).select("doc_id", "e.seed", "e.at")
    hits = emitted.join(side, "seed").select("doc_id", "item_id", (F.col("at") - F.col("b_at")).alias("shift")).distinct()
    hits = materialize(hits, "decon-hits")
    return _verify(hits, docs, bench, small)


def _verify(hits: DataFrame, docs: DataFrame, bench: DataFrame, small: bool) -> DataFrame:
    bench = F.broadcast(bench) if small else bench
    # Only hit documents travel to the comparison; their tokens meet their alignments by doc_id.
    ids = hits.select(F.col("doc_id").alias("_id")).distinct()
    hit_docs = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    rows = hits.select(F.col("doc_id").alias("_id"), "item_id", "shift").join(bench, "item_id")
    both = hit_docs.select("doc_id", tokens("text").alias("t")).join(rows, F.col("doc_id").eqNullSafe(F.col("_id")))
    n = F.size("b")
    agree = F.transform("b", lambda x, j: F.coalesce(F.get(F.col("t"), F.col("shift") + j) == x, F.lit(False)).cast("int"))
    flags = both.select("doc_id", "item_id", "shift", agree.alias("f"), F.least(n, F.lit(WINDOW)).alias("w"), n.alias("n"))
    in_window = lambda s: F.aggregate(F.slice(F.col("f"), s + 1, F.col("w")), F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("w")), in_window))
    need = F.when(F.col("n") < SPAN, F.col("w")).otherwise(F.ceil(F.col("w") * SHARE - 1e-9))
    total = F.aggregate("f", F.lit(0), lambda a, x: a + x)
    return flags.withColumn("best", best).where(F.col("best") >= need).select("doc_id", "item_id", "shift", total.cast("long").alias("matched"))


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_items, max_matched) of the contaminated documents only."""
    return alignments(docs, items).groupBy("doc_id").agg(F.countDistinct("item_id").alias("n_items"), F.max("matched").alias("max_matched"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Every row of docs with n_items, max_matched (0 if clean) and contaminated."""
    found = contamination(docs, items).withColumnRenamed("doc_id", "_id")
    out = docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    n = F.coalesce("n_items", F.lit(0).cast("long"))
    return out.select("doc_id", n.alias("n_items"), F.coalesce("max_matched", F.lit(0).cast("long")).alias("max_matched"), (n > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a verified overlap."""
    found = materialize(contamination(docs, items).select(F.col("doc_id").alias("_id")), "decon-found")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
