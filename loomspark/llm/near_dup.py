"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct word shingles. Documents of equal sets form a class, and only class
representatives (smallest doc_id) go on. Each keeps the ``SKETCH`` smallest hashes of its set. The
``POSTINGS`` smallest are posted to inverted lists; two sets of similarity 0.8 miss each other there
with probability 0.2 ** 24. Overlaps of a list are estimated from the bottom of the union of both
sketches, and those that pass are confirmed on the full sets.

Pairs inside a list are not all emitted. First each list links its members to its smallest one; what is
confirmed is contracted into components. Only links between components are still wanted, and lists that hold one
component are done. Of the others, short lists (up to ``POPULAR`` documents) try all their pairs of different components.

Long lists, of a passage that many documents share or of a family of edited copies, are settled by
prefix lists on full sets, so that neither a list nor a pair in it has to be dropped. A document whose
sketch shares under half of its values with other components cannot pass the union-sketch estimate and
leaves. Of the rest, values that only one component holds cannot be shared across components: a document
with over a fifth of these has no partner. What remains is ordered with those values first, then
rising by the number of holders, and two sets of similarity 0.8 share a value within the first fifth of both. The
place of that value bounds the overlap, which is tested inside the join, and pairs that pass go the
same way of estimate and exact check.

Edge cases: null or empty texts have empty sets and are linked with nothing; with fewer words than a
shingle has, the whole sequence is the one shingle; a repeated doc_id is one document for each
text it has; null doc_ids are never linked; ties cannot arise, as components carry their smallest
doc_id; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.components import components
from loomspark.llm.words import RangeHash, mix64, word_ranges
from loomspark.session import arrow_batches, discard, materialize

SIMILARITY = 80
SKETCH = 64
POSTINGS = 24
POPULAR = 16
BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 200_000
ESTIMATE = 0.5
CHUNK_BYTES = 1 << 19
CHECK_ROWS = 256
TEXT_ROWS = 500
CHECK_SETS = 2048


def chunks(texts: list[str | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, UTF-8 texts) in pieces of about limit bytes."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        held.append(b)
        size += len(b)
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, over lower-case words."""
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    start, end = word_ranges(data)
    if not len(start):
        return [np.empty(0, np.uint64)] * len(texts)
    word = RangeHash(data).ranges(start, end)
    bounds = np.searchsorted(start, np.concatenate(([0], np.cumsum(lengths))))
    rolled = np.zeros(max(len(word) - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = mix64(rolled + word[k : k + len(rolled)])
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            h = np.zeros(1, np.uint64)
            for k in range(lo, hi):
                h = mix64(h + word[k])
            out.append(mix64(h + np.uint64(hi - lo)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(values: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    with np.errstate(over="ignore"):
        a = int(np.add.reduce(mix64(values), dtype=np.uint64))
        b = int(np.add.reduce(mix64(values ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))
    return a - (1 << 63), b - (1 << 63)


def _sketcher(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for first, piece in chunks(texts):
                sets = shingle_sets(piece, width)
                keys = [set_key(s) for s in sets]
                # With the top bit flipped, signed order is the unsigned order the sketch was cut by.
                sketches = [(s[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sketches]))).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sketches)))
                yield pa.RecordBatch.from_arrays([ids.slice(first, len(piece)).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), listed], schema=schema)

    return run


def _checker(width: int):
    """Pairs with both texts to the pairs whose full sets are similar enough and are the sets meant."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, int]] = {}
        for batch in (whole.slice(k, CHECK_ROWS) for whole in batches for k in range(0, whole.num_rows, CHECK_ROWS)):
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            good: tuple[list, list] = ([], [])
            if len(known) > CHECK_SETS:
                known.clear()
            names = [t for t in dict.fromkeys([*cols["text_a"], *cols["text_b"]]) if t not in known]
            for first, piece in chunks(names):
                for name, s in zip(names[first : first + len(piece)], shingle_sets(piece, width), strict=True):
                    known[name] = (s, set_key(s)[0])
            for a, b, ka, kb, ta, tb in zip(cols["a"], cols["b"], cols["key_a"], cols["key_b"], cols["text_a"], cols["text_b"], strict=True):
                (x, kx), (y, ky) = known[ta], known[tb]
                if kx != ka or ky != kb:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= SIMILARITY * (len(x) + len(y) - both):
                    good[0].append(a)
                    good[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(good[0], pa.int64()), pa.array(good[1], pa.int64())], schema=schema)

    return run


def _estimate(x: Column, y: Column) -> Column:
    """Share of common values among the smallest values of the union of two sketches."""
    low = F.slice(F.sort_array(F.array_union(x, y)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(low, x), y)) / F.size(low)


def _fetch(rows: DataFrame, ids: DataFrame, key: str, how: str) -> DataFrame:
    """Join with a materialised side of fixed-size rows keyed _id, broadcast only if its counted rows are few."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, F.col(key) == F.col("_id"), how)


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Candidate pairs (a, b) of representatives to those whose estimate passes and whose sets are similar."""
    # The upper halves of the values keep their order and tell them apart well enough for an estimate.
    half = F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int"))
    side = lambda s: nodes.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("k1").alias(f"key_{s}"), half.alias(f"sketch_{s}"))
    known = pairs.join(side("a"), "a").join(side("b"), "b")
    near = known.where(_close("n_a", "n_b") & (_estimate(F.col("sketch_a"), F.col("sketch_b")) >= ESTIMATE))
    near = materialize(near.select("a", "b", "key_a", "key_b"), "near-candidates")
    ids = materialize(near.select(F.col("a").alias("_id")).unionByName(near.select(F.col("b").alias("_id"))).distinct(), "near-ids")
    texts = materialize(_fetch(docs.select("doc_id", "text"), ids, "doc_id", "left_semi"), "near-texts")
    # Few documents may make many pairs; their texts then go to the pairs, if their counted bytes allow it.
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b

    def text(s: str) -> DataFrame:
        named = texts.select(F.col("doc_id").alias(s), F.col("text").alias(f"text_{s}"))
        return F.broadcast(named) if size <= BROADCAST_BYTES else named

    rows = near.join(text("b"), "b").join(text("a"), "a").select("a", "b", "key_a", "key_b", "text_a", "text_b")
    with arrow_batches(docs.sparkSession, CHECK_ROWS):
        links = materialize(rows.mapInArrow(_checker(width), "a long, b long").distinct(), "near-links")
    for used in (near, ids, texts):
        discard(used)
    return links


def _lists(nodes: DataFrame) -> DataFrame:
    """Inverted lists (rep, n, value, first) of the posted values that several documents have, with the smallest of these."""
    posted = nodes.select("rep", "n", F.explode(F.slice("sketch", 1, POSTINGS)).alias("value"))
    met = posted.groupBy("value").agg(F.min("rep").alias("first"), F.count("*").alias("m")).where("m > 1").select("value", "first")
    return materialize(posted.join(met, "value"), "near-lists")


def _still_open(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Lists (rep, n, value, label, long) that hold more than one component."""
    labelled = lists.join(roots, lists["rep"] == roots["node"], "left").select("rep", "n", "value", F.coalesce("root", "rep").alias("label"))
    mixed = labelled.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    return materialize(labelled.join(mixed.select("value", (F.col("m") > POPULAR).alias("long")), "value"), "near-open")


def _list_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components in lists of bounded length."""
    other = lists.select("value", F.col("rep").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"))
    met = lists.join(other, "value").where("label < label_b").where(_close("n", "n_b"))
    return met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def _across(rows: DataFrame, *of: str) -> DataFrame:
    """Rows whose value more than one component (label) holds, with its number of holders and the number of such values of the document (of)."""
    held = rows.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("holders")).where("lo <> hi").select("value", "holders")
    return rows.join(held, "value").withColumn("useful", F.count("*").over(Window.partitionBy(*of)))


def _full_sets(width: int):
    """Documents with text to a row for each value of their set."""
    schema = pa.schema([("rep", pa.int64()), ("k1", pa.int64()), ("n", pa.int64()), ("label", pa.int64()), ("value", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names) if n != "text"}
            for first, piece in chunks(batch.column(batch.schema.names.index("text")).to_pylist()):
                # A repeated doc_id has several texts; the key tells which of them is meant.
                sets = [s if set_key(s)[0] == k else s[:0] for s, k in zip(shingle_sets(piece, width), cols["k1"][first:], strict=False)]
                sizes = [len(s) for s in sets]
                rows = [np.repeat(cols[c][first : first + len(piece)], sizes) for c in ("rep", "k1", "n", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (*rows, np.concatenate(sets).view(np.int64))], schema=schema)

    return run


def _prefix_pairs(hot: DataFrame, nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of different components among documents (rep, label) that can be similar by prefix lists on full sets."""
    known = _fetch(nodes, hot.withColumnRenamed("rep", "_id"), "rep", "inner").drop("_id")
    # Sets that share a repeated doc_id are counted as one here, which keeps both.
    sketched = _across(known.select("rep", "label", F.explode("sketch").alias("value")), "rep").select("rep", "useful").distinct()
    kept = known.join(sketched, "rep").where(F.col("useful") >= ESTIMATE * F.least("n", F.lit(SKETCH))).select("rep", "k1", "n", "label")
    kept = materialize(kept, "near-across")
    texts = _fetch(docs.select("doc_id", "text"), kept.withColumnRenamed("rep", "_id"), "doc_id", "inner").select(F.col("_id").alias("rep"), "k1", "n", "label", "text")
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        full = materialize(texts.mapInArrow(_full_sets(width), "rep long, k1 long, n long, label long, value long"), "near-full")
    discard(kept)
    shared = materialize(_across(full, "rep", "k1").where(100 * F.col("useful") >= SIMILARITY * F.col("n")).select("rep", "k1", "n", "label", "value"), "near-shared")
    discard(full)
    ranked = _across(shared, "rep", "k1")
    at = F.col("n") - F.col("useful") + F.row_number().over(Window.partitionBy("rep", "k1").orderBy("holders", "value")) - 1
    prefix = materialize(ranked.withColumn("at", at).where(100 * F.col("at") <= (100 - SIMILARITY) * F.col("n")).select("rep", "n", "label", "value", "at"), "near-prefix")
    discard(shared)
    other = prefix.select("value", F.col("rep").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("at").alias("at_b"))
    most = F.least(F.col("n") - F.col("at"), F.col("n_b") - F.col("at_b"))
    met = prefix.join(other, "value").where("label < label_b").where(_close("n", "n_b") & ((100 + SIMILARITY) * most >= SIMILARITY * (F.col("n") + F.col("n_b"))))
    return met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def _close(x: str, y: str) -> Column:
    return 100 * F.least(x, y) >= SIMILARITY * F.greatest(x, y)


def _star_pairs(lists: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's members with its smallest one."""
    centres = lists.where("rep = first").select("value", F.col("rep").alias("c"), F.col("n").alias("c_n"))
    return lists.join(centres, "value").where("rep <> c").where(_close("n", "c_n")).select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct()


def find_groups(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per document."""
    made = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_sketcher(width), "doc_id long, n long, k1 long, k2 long, sketch array<long>")
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        sketched = materialize(made, "near-sketches")
    key = ["n", "k1", "k2"]
    sets = materialize(sketched.select("doc_id", *key), "near-sets")
    live = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = materialize(sets.where(live).groupBy(*key).agg(F.min("doc_id").alias("rep")), "near-classes")
    leads = classes.select(*key, F.col("rep").alias("doc_id"))
    nodes = sketched.where(live).join(leads, [*key, "doc_id"], "left_semi").withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", *key])
    nodes = materialize(nodes, "near-nodes")
    discard(sketched)
    lists = _lists(nodes)
    tried = materialize(_star_pairs(lists), "near-pairs")
    links = _confirm(tried, nodes, docs, width)
    roots = components(links)
    left = _still_open(lists, roots)
    discard(lists)

    across = _list_pairs(left.where("NOT long"))
    hot = materialize(left.where("long").select("rep", "label").distinct(), "near-hot")
    if not hot.isEmpty():
        across = across.unionByName(_prefix_pairs(hot, nodes, docs, width)).distinct()
    more = materialize(across.join(tried, ["a", "b"], "left_anti"), "near-pairs")
    discard(left)
    roots = components(links.unionByName(_confirm(more, nodes, docs, width)))
    discard(nodes)

    by_class = classes.join(roots, classes["rep"] == roots["node"], "left").select(*key, F.coalesce("root", "rep").alias("component_id"))
    out = sets.join(by_class, key, "left")
    linked = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(linked, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The documents that are the smallest of their component."""
    dropped = materialize(find_groups(docs, width).where("doc_id <> component_id").select(F.col("doc_id").alias("_id")), "near-dropped")
    return docs.join(dropped, F.col("doc_id") == F.col("_id"), "left_anti")
