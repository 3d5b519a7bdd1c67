"""Removal of repeated byte strings with an enhanced suffix array and its common-prefix intervals.

A byte goes if some string of ``SPAN`` bytes that covers it also starts earlier in the corpus (smaller
doc_id, or the same document at an earlier byte). Whole-text copies are settled first by their digests.
Of the other texts every window of ``SPAN`` bytes holds an anchor: the smallest hash among its ``KGRAM``-byte
strings. Equal windows hold equal anchors at the same place, so repeats meet at their anchors' hashes.
Around an anchor lies its context, the bytes that windows holding it can reach. Occurrences of an
anchor with equal contexts repeat all of it. Where contexts differ, they are fetched, and a suffix
array with common-prefix lengths is built over them. A stack scan of the interval tree finds every interval
with a common prefix of at least ``SPAN`` bytes; it is a maximal repeat if the bytes to the left of its
occurrences differ, and then all but its first occurrence are marked (intervals that can be
extended to the left are covered by their extension).

Anchors travel as packed arrays in hash buckets, a row for each task and bucket; equal contexts of a task are
reduced to the first before that. A bucket's memory grows with the occurrences of its anchors with
different contexts, 30 bytes for each.

Edge cases: null text is empty; texts under ``SPAN`` bytes lose nothing; rows that repeat a doc_id are one
document if their texts agree, else documents of their own in the order of their digests; null doc_ids are kept whole; extra columns pass by; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.identity import with_key
from loomspark.llm.words import RangeHash
from loomspark.session import arrow_batches, materialize, shuffle_width

SPAN = 100
KGRAM = 32
REACH = SPAN - KGRAM
PIECE = 1 << 19
TEXT_ROWS = 500
MARGIN = 256
FLUSH = 1 << 18
BUCKET_BYTES = 1 << 24
BUCKET_CONTEXTS = 1 << 14
MARK = 255
# Bytes to the left and right of an anchor: every window of SPAN bytes around it holds one of these stretches.
STRETCHES = ((51, 0), (34, 17), (17, 34), (0, 51))
EMPTY = hashlib.sha256(b"").hexdigest()

COLUMNS = (("h", np.uint64), ("c", np.uint64), ("doc", np.int64), ("pos", np.int64), ("left", np.uint8), ("right", np.uint8), *((f"k{i}", np.uint32) for i in range(4)))


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[j : j + width] for every j with a whole window."""
    step, out = 1, x
    while step * 2 <= width:
        out = pick(out[:-step], out[step:])
        step *= 2
    return pick(out[: len(x) - width + 1], out[width - step : width - step + len(x) - width + 1]) if width > step else out


def _pieces(ids, texts: list[bytes]) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (doc, byte offset, whole length, bytes) of about PIECE bytes; long texts come in overlapping parts."""
    held, size = [], 0
    for doc, t in zip(ids, texts, strict=True):
        if len(t) < SPAN:
            continue
        for lo in range(0, len(t), PIECE):
            part = t[max(0, lo - MARGIN) : lo + PIECE + MARGIN]
            held.append((doc, max(0, lo - MARGIN), len(t), part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def find_anchors(parts: list[tuple[int, int, int, bytes]]) -> dict[str, np.ndarray]:
    """Anchors of some texts or parts of texts: hash, context hash, document, place, and how far the context reaches."""
    data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    n = len(data)
    if n < SPAN:
        return {k: np.empty(0, t) for k, t in COLUMNS}
    ends = np.cumsum([len(p[3]) for p in parts])
    begins = ends - np.array([len(p[3]) for p in parts])
    hashes = RangeHash(data)
    at = np.arange(n - KGRAM + 1)
    h = hashes.ranges(at, at + KGRAM)
    h |= np.uint64(1)
    cross = (ends[:-1, None] - np.arange(1, KGRAM)[None]).ravel()
    h[cross[(cross >= 0) & (cross < len(h))]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    window = REACH + 1
    if len(h) < window:
        least = np.array([h.min()])
    else:
        least = _slide(h, window, np.minimum)
    padded = np.zeros(len(least) + 2 * (window - 1), np.uint64)
    padded[window - 1 : window - 1 + len(least)] = least
    most = _slide(padded, window, np.maximum)[: len(h)]
    where = np.flatnonzero((h == most) & (h != np.uint64(0xFFFFFFFFFFFFFFFF)))
    part = np.searchsorted(ends, where, side="right")
    offset = np.array([p[1] for p in parts])[part]
    pos = where - begins[part] + offset
    length = np.array([p[2] for p in parts])[part]
    left = np.minimum(REACH, pos)
    right = np.minimum(REACH, length - pos - KGRAM)
    # Of overlapping parts each anchor is taken from the part whose middle holds it.
    own = offset == np.maximum(0, pos - pos % PIECE - MARGIN)
    ok = own & (left + KGRAM + right >= SPAN)
    where, pos, left, right, part = where[ok], pos[ok], left[ok], right[ok], part[ok]
    context = hashes.ranges(where - left, where + KGRAM + right) + left.astype(np.uint64)
    docs = np.array([p[0] for p in parts], np.int64)[part]
    out = {"h": h[where], "c": context, "doc": docs, "pos": pos, "left": left.astype(np.uint8), "right": right.astype(np.uint8)}
    for i, (before, after) in enumerate(STRETCHES):
        whole = (left >= before) & (right >= after)
        at = where[whole]
        out[f"k{i}"] = np.zeros(len(where), np.uint32)  # 0: the stretch is cut off
        out[f"k{i}"][whole] = hashes.ranges(at - before, at + KGRAM + after).astype(np.uint32) | np.uint32(1)
    return out


def _union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged intervals of each document."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    fresh = np.concatenate(([True], doc[1:] != doc[:-1]))
    group = np.cumsum(fresh) - 1
    wide = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * wide) - group * wide
    cut = fresh | np.concatenate(([False], start[1:] > reach[:-1]))
    first = np.flatnonzero(cut)
    return doc[first], start[first], np.maximum.reduceat(end, first)


def _first_of_class(c: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], tuple]:
    """The first occurrence of each (hash, context), and the merged spans of all others."""
    order = np.lexsort((c["pos"], c["doc"], c["c"], c["h"]))
    c = {k: v[order] for k, v in c.items()}
    same = np.concatenate(([False], (c["h"][1:] == c["h"][:-1]) & (c["c"][1:] == c["c"][:-1]))) if len(order) else np.empty(0, bool)
    if len(order):
        lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
        again = same & (c["doc"] == c["doc"][lead]) & (c["pos"] == c["pos"][lead])
    else:
        again = same
    gone = same & ~again
    left, right = c["left"].astype(np.int64), c["right"].astype(np.int64)
    spans = _union(c["doc"][gone], (c["pos"] - left)[gone], (c["pos"] + KGRAM + right)[gone])
    return {k: v[~same] for k, v in c.items()}, spans


def _emit(buckets: int):
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c, _ in COLUMNS]])

    def flush(held: list[dict]) -> Iterator[pa.RecordBatch]:
        c, (doc, start, end) = _first_of_class({k: np.concatenate([x[k] for x in held]) for k, _ in COLUMNS})
        full = lambda v: np.full(len(doc), v, np.uint8)
        marks = {"h": start.astype(np.uint64), "c": end.astype(np.uint64), "doc": doc, "pos": start, "left": full(MARK), "right": full(0)} | {f"k{i}": np.zeros(len(doc), np.uint32) for i in range(len(STRETCHES))}
        bucket = np.concatenate(((c["h"] >> np.uint64(1)) % np.uint64(buckets), doc.astype(np.uint64) % np.uint64(buckets))).astype(np.int32)
        c = {k: np.concatenate((c[k], marks[k])).astype(t) for k, t in COLUMNS}
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        have = np.flatnonzero(np.diff(cuts))
        c = {k: v[order] for k, v in c.items()}
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), *[pa.array([c[k][cuts[i] : cuts[i + 1]].tobytes() for i in have], pa.binary()) for k, _ in COLUMNS]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            for parts in _pieces(batch.column(0).to_pylist(), texts):
                held.append(find_anchors(parts))
                size += len(held[-1]["h"])
                if size >= FLUSH:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    return run


MEET = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("h", pa.int64())])


def _meet(packed: pa.Table) -> pa.Table:
    """One bucket: spans that repeat whole contexts (h 0), and contexts of anchors that have several (h the anchor)."""
    c = {k: np.concatenate([np.frombuffer(x, t) for x in packed.column(k).to_pylist()]) for k, t in COLUMNS}
    mark = c["left"] == MARK
    known = (c["doc"][mark], c["h"][mark].astype(np.int64), c["c"][mark].astype(np.int64))
    c, spans = _first_of_class({k: v[~mark] for k, v in c.items()})
    doc, start, end = _union(*(np.concatenate(x) for x in zip(known, spans, strict=True)))
    h = c["h"]
    several = np.zeros(len(h), bool)
    multi = np.flatnonzero(np.concatenate(([False], h[1:] == h[:-1])) | np.concatenate((h[1:] == h[:-1], [False]))) if len(h) else np.empty(0, np.int64)
    for i in range(len(STRETCHES)):
        # Only occurrences that share a stretch with another can share a window with it.
        rows = multi[c[f"k{i}"][multi] > 0]
        rows = rows[np.lexsort((c[f"k{i}"][rows], h[rows]))]
        if len(rows):
            same = (h[rows][1:] == h[rows][:-1]) & (c[f"k{i}"][rows][1:] == c[f"k{i}"][rows][:-1])
            several[rows[np.concatenate(([False], same)) | np.concatenate((same, [False]))]] = True
    left, right = c["left"].astype(np.int64)[several], c["right"].astype(np.int64)[several]
    pos = c["pos"][several]
    cols = [np.concatenate((doc, c["doc"][several])), np.concatenate((start, pos - left)), np.concatenate((end, pos + KGRAM + right)), np.concatenate((np.zeros(len(doc), np.int64), h[several].view(np.int64)))]
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in cols], schema=MEET)


def suffix_array(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, lcp, owner, offset) of all suffixes of some strings, by prefix doubling.

    lcp[i] is the common prefix of suffixes i - 1 and i within their strings; owner and offset say where a suffix starts.
    """
    sizes = np.array([len(s) for s in strings])
    n = int(sizes.sum()) + len(strings)
    symbols = np.zeros(n, np.uint16)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    offset = np.arange(n) - begins[owner]
    symbols[offset < sizes[owner]] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1  # the end sorts first
    room = sizes[owner] - offset
    wide = np.concatenate((symbols, np.zeros(4, np.uint16))).astype(np.uint64)
    key = (wide[:-4] << np.uint64(48)) | (wide[1:-3] << np.uint64(32)) | (wide[2:-2] << np.uint64(16)) | wide[3:-1]
    levels, length = [], 4
    while True:
        order = np.argsort(key)
        ranks = np.empty(n, np.int64)
        ranks[order] = np.cumsum(np.concatenate(([0], (key[order][1:] != key[order][:-1]).astype(np.int64))))
        levels.append((length, ranks.astype(np.int32)))
        if length >= int(sizes.max(initial=0)) or int(ranks.max(initial=0)) == n - 1:
            break
        after = np.zeros(n, np.int64)
        after[: n - length] = ranks[length:] + 1 if n > length else 0
        key = (ranks.astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
        length *= 2
    a, b = order[:-1], order[1:]
    common = np.zeros(max(n - 1, 0), np.int64)
    for length, ranks in reversed(levels):
        i, j = a + common, b + common
        inside = (i < n) & (j < n)
        common += length * (inside & (ranks[np.minimum(i, n - 1)] == ranks[np.minimum(j, n - 1)]))
    for _ in range(3):
        i, j = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += (symbols[i] == symbols[j]) & (symbols[i] > 0) & (common < room[a])
    lcp = np.zeros(n, np.int64)
    lcp[1:] = np.minimum(common, np.minimum(room[a], room[b]))
    return order, lcp, owner[order], offset[order]


def scan_intervals(lcp: np.ndarray, place: np.ndarray, left: np.ndarray, least: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """Maximal repeats (length, first row, last row, rows that are not first in place) of at least `least` symbols.

    place orders occurrences (equal places are one occurrence); left is the symbol before each, negative if it is unknown and so
    unlike any other. Rows follow the suffix array. A row is reported once, in the longest repeat in which it is not the first.
    """
    n = len(lcp)
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    breaks = np.flatnonzero(np.diff(deep) > 1)
    for lo, hi in zip(np.concatenate(([deep[0]], deep[breaks + 1])), np.concatenate((deep[breaks], [deep[-1]])), strict=True):
        rows = range(int(lo) - 1, int(hi) + 1)
        places, lefts, depth = place[rows.start : rows.stop].tolist(), left[rows.start : rows.stop].tolist(), lcp[rows.start : rows.stop].tolist()
        stack: list[list] = []  # [length, first row, row of the first place, left or None if diverse, later rows]
        leaf = lambda r: [None, r, r, lefts[r - rows.start] if lefts[r - rows.start] >= 0 else None, []]

        def absorb(node: list, child: list) -> None:
            x, y = node[2], child[2]
            px, py = places[x - rows.start], places[y - rows.start]
            if px <= py:
                if px < py:
                    node[4].append(y)
            else:
                node[4].append(x)
                node[2] = y
            if node[3] is not None and (child[3] is None or child[3] != node[3]):
                node[3] = None

        now = leaf(rows.start)
        for r in rows[1:]:
            h = depth[r - rows.start]
            while stack and stack[-1][0] > h:
                top = stack.pop()
                absorb(top, now)
                if top[3] is None:
                    yield top[0], top[1], r - 1, top[4]
                now = [None, top[1], top[2], top[3], []]
            if stack and stack[-1][0] == h:
                absorb(stack[-1], now)
            else:
                stack.append([h, now[1], now[2], now[3], []])
            now = leaf(r)
        while stack:
            top = stack.pop()
            absorb(top, now)
            if top[3] is None:
                yield top[0], top[1], rows[-1], top[4]
            now = [None, top[1], top[2], top[3], []]


def maximal_repeats(texts: list[bytes], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Maximal repeats of some texts: (length, all occurrences as (text, offset))."""
    order, lcp, owner, offset = suffix_array(texts)
    place = owner * (max(map(len, texts), default=0) + 1) + offset
    left = np.array([texts[o][k - 1] if k else -1 for o, k in zip(owner, offset, strict=True)], np.int64)
    return [(length, sorted((int(owner[r]), int(offset[r])) for r in range(lo, hi + 1))) for length, lo, hi, _ in scan_intervals(lcp, place, left, least)]


def _join_stretches(contexts: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    out: list[list] = []
    for i in np.lexsort((start, doc)).tolist():
        d, s, c = int(doc[i]), int(start[i]), contexts[i]
        if out and out[-1][0] == d and s <= out[-1][1] + len(out[-1][2]):
            out[-1][2] = out[-1][2] + c[max(0, out[-1][1] + len(out[-1][2]) - s) :]
        else:
            out.append([d, s, c])
    return [o[2] for o in out], np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64)


def _trim(contexts: list[bytes], doc: np.ndarray, start: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Contexts cut to the stretch whose windows occur at more than one place, without those that have none."""
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    sizes = np.array([len(c) for c in contexts])
    begins = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - SPAN + 1, 0)
    owner = np.repeat(np.arange(len(contexts)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = begins[owner] + offset
    h = RangeHash(flat).ranges(at, at + SPAN)
    # A window that two contexts of a document share is one place.
    order = np.argsort(h)
    h, w = h[order], order
    d, p = doc[owner[w]], start[owner[w]] + offset[w]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.empty(0, np.int64)
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    other = (d != d[first[group]]) | (p != p[first[group]])
    many = np.zeros(len(first), bool)
    many[group[other]] = True
    hit = w[many[group]]
    lo, hi = np.full(len(contexts), 1 << 40), np.full(len(contexts), -1)
    np.minimum.at(lo, owner[hit], offset[hit])
    np.maximum.at(hi, owner[hit], offset[hit])
    keep = np.flatnonzero(hi >= 0)
    return [contexts[i][lo[i] : hi[i] + SPAN] for i in keep], doc[keep], start[keep] + lo[keep]


def _search_contexts(rows: pa.Table) -> pa.Table:
    """Spans that repeat among the contexts of one bucket."""
    contexts, doc, start = _trim(rows.column("context").to_pylist(), rows.column("doc").to_numpy(), rows.column("start").to_numpy())
    if not contexts:
        return pa.table({n: pa.array([], pa.int64()) for n in ("doc", "start", "end")})
    # Contexts of one document that overlap are one stretch.
    contexts, doc, start = _join_stretches(contexts, doc, start)
    order, lcp, owner, offset = suffix_array(contexts)
    d, p = doc[owner], start[owner] + offset
    rank = np.lexsort((p, d))
    fresh = np.concatenate(([False], (d[rank][1:] != d[rank][:-1]) | (p[rank][1:] != p[rank][:-1])))
    place = np.empty(len(order), np.int64)
    place[rank] = np.cumsum(fresh)
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    begins = np.concatenate(([0], np.cumsum([len(c) for c in contexts])[:-1]))
    left = np.where(offset > 0, flat[np.maximum(begins[owner] + offset - 1, 0)].astype(np.int64), -1)
    found: list[tuple[int, int]] = [(r, length) for length, _, _, later in scan_intervals(lcp, place, left, SPAN) for r in later]
    r = np.array([f[0] for f in found], np.int64)
    spans = _union(d[r], p[r], p[r] + np.array([f[1] for f in found], np.int64)) if found else (r, r, r)
    return pa.table({"doc": pa.array(spans[0], pa.int64()), "start": pa.array(spans[1], pa.int64()), "end": pa.array(spans[2], pa.int64())})


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()), ("context", pa.binary())])
    for batch in batches:
        cols: tuple[list, list, list, list] = ([], [], [], [])
        for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                cols[0].append(w["h"])
                cols[1].append(doc)
                cols[2].append(w["start"])
                cols[3].append(data[w["start"] : w["end"]])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        rows = []
        for doc, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            kept, at, removed, runs = hashlib.sha256(), 0, 0, 0
            for a, b in merge_spans([(s["start"], s["end"]) for s in spans]):
                kept.update(data[at:a])
                at, removed, runs = b, removed + b - a, runs + 1
            kept.update(data[at:])
            rows.append((doc, removed, runs, kept.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc, start, end) byte spans to remove from documents (doc_id, text) that hold no whole-text copies; spans may overlap.

    Buckets are as many as the counted bytes and contexts need, so that one holds about BUCKET_BYTES of text, or BUCKET_CONTEXTS.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    least = 4 * shuffle_width(docs.sparkSession)
    buckets = max(least, size // BUCKET_BYTES)
    packed = docs.select("doc_id", "text").mapInArrow(_emit(buckets), "bucket int, h binary, c binary, doc binary, pos binary, left binary, right binary, k0 binary, k1 binary, k2 binary, k3 binary")
    met = materialize(packed.groupBy("bucket").applyInArrow(_meet, "doc long, start long, end long, h long"), "span-meet")
    asked = materialize(met.where("h <> 0").groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("h", "start", "end")).alias("wanted")), "span-asked")
    rows = docs.join(asked, docs["doc_id"] == asked["_id"]).select("doc_id", "text", "wanted")
    contexts = rows.mapInArrow(_fetch, "h long, doc long, start long, context binary")
    held = met.where("h <> 0").count()
    parts = max(least, held // BUCKET_CONTEXTS)
    searched = contexts.groupBy(F.pmod(F.xxhash64("h"), F.lit(parts)).alias("bucket")).applyInArrow(_search_contexts, "doc long, start long, end long")
    return met.where("h = 0").select("doc", "start", "end").unionByName(searched)


def dedup_report(docs: DataFrame) -> DataFrame:
    """A row per document: bytes, removed bytes, removed runs and the SHA-256 of what stays."""
    docs = with_key(docs.select(F.col("doc_id").cast("long").alias("_own"), F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    docs = docs.select("_own", F.col("_key").alias("doc_id"), "text")
    facts = materialize(docs.select("_own", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "span-docs")
    first = facts.where(F.col("doc_id").isNotNull() & (F.col("n_bytes") >= SPAN)).groupBy("sha").agg(F.min("doc_id").alias("rep"))
    facts = materialize(facts.join(first, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("rep"), F.lit(False))), "span-classes")
    alone = facts.where("NOT copy AND rep IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    copies = materialize(facts.where("copy").select(F.col("doc_id").alias("_id")).distinct().join(alone, "_id", "left_anti"), "span-copies")
    long = docs.where(F.col("doc_id").isNotNull())
    single = long.join(copies, F.col("doc_id") == F.col("_id"), "left_anti")
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        spans = materialize(repeated_spans(single).groupBy(F.col("doc").alias("_id")).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "span-marks")
    cut = docs.join(spans, F.col("doc_id") == F.col("_id")).select("doc_id", "text", "spans").mapInArrow(_cut, "doc long, n_removed long, n_spans long, kept_sha256 string").distinct()
    out = facts.join(cut, (facts["doc_id"] == cut["doc"]) & ~facts["copy"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.col("_own").alias("doc_id"),
        "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(F.col("copy"), F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
