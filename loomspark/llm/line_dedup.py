"""Line deduplication by an exact set-similarity join with prefix, positional and length filters.

A line (``\\n``-separated) is its set of distinct words, A-Z lowered. Lines of fewer than
``MIN_TOKENS`` distinct words are matched only with ``short``: one of four words can lie in one of five
(similarity 0.8) and is joined like longer ones; below four only equal sets are similar, and lines meet
by their whole set. A line is removed if an earlier line of the corpus
(smaller doc_id, or earlier in the same document) has Jaccard similarity of at least 0.8 with it.

Tokens of a line are ordered by rarity: tokens outside the table of frequent ones come first, by
hash, then frequent ones by their counts over all lines. The table holds tokens with a share of at
least 2 ** -17 of all tokens, so it has at most 2 ** 17 rows whatever the input. Two lines with
similarity 0.8 share a token within the first n // 5 + 1 of each. Tokens that are very frequent make
poor keys: there pairs of them within the first n // 5 + 2 are the keys instead, which two similar
lines share too; lines of over ``LONG`` words take a token with a band of lengths instead, so that keys stay
in proportion to the line. Lines meet by key. Lines of equal sets, told by 192 bits of digests over 64-bit word hashes, fall
together, first inside each task before anything is shuffled; all but the first of them are removed. The length and positional
filters and a bound from 128-bit parity bitmaps (the sets differ in at least as many tokens as the bitmaps
in bits) leave candidate pairs, which are verified on the words themselves. A line that
meets more than ``TRIES`` candidates at a key tries the first of these; only if none is similar, the key's lines,
kept in chunks that tasks share out, are searched for all other candidates of that line, which are verified too.
A key with more than ``CHUNK_ROWS`` lines is not searched in one task: its chunks meet in pairs, a task for each.

Keys travel as packed arrays in hash buckets, a row for each task and bucket.

Edge cases: null text has no lines and stays null; empty text has one empty line; repeated rows of a
doc_id are distinct copies at the same place in the order and do not remove each other; null doc_ids
are left as they are; rows of one doc_id with different texts are documents of their own, in the order of
their digests; extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.identity import with_key
from loomspark.llm.near_dup import TEXT_ROWS, chunks
from loomspark.llm.words import RangeHash, mix64, word_ranges
from loomspark.operators.modelmath import let
from loomspark.session import arrow_batches, discard, materialize, shuffle_width

MIN_TOKENS = 5
SMALL = 32
TRIES = 4
BLOCK = 128
SCAN = 64
CHUNK_ROWS = 1 << 13
SEEKERS = 1 << 10
LONG = 256
BUCKET_TOKENS = 19
PIECE = 1 << 19
RANKED_SHARE = 17
HOT_SHARE = 17
COUNT_TOKENS = 1 << 20
SLOTS = 1 << 20
FLUSH_KEYS = 1 << 17
BROADCAST_BYTES = 16 << 20
CHECK_CHUNKS = 64
TOKEN_BITS = np.uint64(44)
TOKEN_MASK = np.uint64((1 << 44) - 1)
RARE_MASK = np.uint64((1 << 43) - 1)


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line of each word of a chunk, and the text and number within the text of each line."""
    data = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", np.uint8)
    start, end = word_ranges(data)
    breaks = np.flatnonzero(data == 10)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    text_of = np.searchsorted(ends, breaks)
    first = np.searchsorted(breaks, np.concatenate(([-1], ends[:-1])), side="right")
    number = np.arange(len(breaks)) - first[text_of]
    line = np.repeat(np.arange(len(breaks)), np.diff(np.searchsorted(start, breaks), prepend=0))
    return RangeHash(data, two=False).ranges(start, end), line, text_of, number


def _count_frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: hashes and counts of tokens that may be frequent, and the number of tokens under hash 0."""
    held, counts, total = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def merge(parts: list[np.ndarray]) -> None:
        nonlocal held, counts, total
        token, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (held[:0], counts[:0])
        total += int(n.sum())
        both, c = np.concatenate((held, token)), np.concatenate((counts, n))
        order = np.argsort(both, kind="stable")
        both = both[order]
        first = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.empty(0, np.int64)
        c = np.add.reduceat(c[order], first) if len(first) else c
        # What is rarer than a quarter of the least share so far cannot be called frequent here.
        keep = c > total >> (RANKED_SHARE + 2)
        held, counts = both[first][keep], c[keep]

    parts: list[np.ndarray] = []
    for batch in batches:
        for _, piece in chunks(batch.column(0).to_pylist(), PIECE):
            data = np.frombuffer(b"\n".join(t.lower() for t in piece) + b"\n", np.uint8)
            parts.append(RangeHash(data, two=False).ranges(*word_ranges(data)))
            if sum(map(len, parts)) >= COUNT_TOKENS:
                merge(parts)
                parts = []
    merge(parts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held.view(np.int64), 0)), pa.array(np.append(counts, total))], names=["h", "c"])


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Direct-mapped table of frequent tokens, hash and rank (0 none, then rising with the count, hot ones above 2 ** 18), and the number of all tokens."""
    counted = materialize(docs.select("text").mapInArrow(_count_frequent, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")), "line-tokens")
    total = counted.where("h = 0").agg(F.sum("c")).first()[0] or 0
    rows = counted.where((F.col("h") != 0) & (F.col("c") >= max(2, total >> RANKED_SHARE))).orderBy("c", "h").toArrow()
    h, c = rows.column("h").to_numpy().view(np.uint64), rows.column("c").to_numpy()
    rank = np.arange(1, len(h) + 1, dtype=np.uint64) + (c >= max(2, total >> HOT_SHARE)) * np.uint64(1 << 18)
    keys, ranks = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
    slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
    keys[slot], ranks[slot] = h, rank  # of two tokens in a slot the more frequent stays
    return keys, ranks, total


def _whole_keys(token: np.ndarray, line: np.ndarray, at: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Keys of the lines ``few`` (indices into ``at``, the numbers of the lines with words) by all their distinct words."""
    of = np.searchsorted(at, line)
    wanted = np.zeros(len(at), bool)
    wanted[few] = True
    chosen = wanted[of]
    of, token = of[chosen], token[chosen]
    order = np.lexsort((token, of))
    of, token = of[order], token[order]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (token[1:] != token[:-1])))
    of, token = of[new], token[new]
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    n = np.diff(np.append(first, len(of))).astype(np.uint64)
    return mix64(np.add.reduceat(mix64(token), first) + n)


def line_keys(token: np.ndarray, line: np.ndarray, table: tuple[np.ndarray, np.ndarray], short: bool = False) -> dict[str, np.ndarray]:
    """Join keys of the lines of a chunk: key, line, position of the key's first token, and by line n and class."""
    slot = (token & np.uint64(SLOTS - 1)).astype(np.int64)
    rank = np.where(table[0][slot] == token, table[1][slot], np.uint64(0))
    ident = np.where(rank > 0, (RARE_MASK + np.uint64(1)) | rank, (token >> np.uint64(20)) & RARE_MASK)
    packed = (line.astype(np.uint64) << TOKEN_BITS) | ident
    order = np.argsort(packed)
    packed, token = packed[order], token[order]
    if len(packed):
        new = np.concatenate(([True], packed[1:] != packed[:-1]))
        packed, token = packed[new], token[new]
    at, ident = (packed >> TOKEN_BITS).astype(np.int64), packed & TOKEN_MASK
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(at)))
    group = np.repeat(np.arange(len(first)), n)
    pos = np.arange(len(at)) - first[group] if len(at) else np.empty(0, np.int64)
    # Digests of the set are taken over whole hashes of its words.
    full = mix64(token)
    name = np.add.reduceat(full, first) if len(first) else np.empty(0, np.uint64)
    bit = full & np.uint64(127)
    one, zero = np.uint64(1) << (bit & np.uint64(63)), np.uint64(0)
    parity = [np.bitwise_xor.reduceat(np.where((bit >> np.uint64(6)) == np.uint64(k), one, zero), first) if len(first) else np.empty(0, np.uint64) for k in (0, 1)]
    # The prefix and one token more of each line that has enough tokens.
    limit = np.where(n >= (MIN_TOKENS - 1 if short else MIN_TOKENS), n // 5 + 1, -1)
    near = np.flatnonzero(pos <= limit[group])
    of, place, value = group[near], pos[near], ident[near]
    size, inside = n[of], place < limit[of]
    hot = (value > RARE_MASK) & ((value & RARE_MASK) >= np.uint64(1 << 18))
    one = np.flatnonzero(inside & ~hot)
    keys, rows, places = [mix64(value[one])], [of[one]], [place[one]]
    # Of two similar lines both are within LONG * 5 / 4 or both over LONG.
    far = np.flatnonzero(inside & hot & (size > LONG))
    if len(far):
        band = (np.log(size[far]) // np.log(1.26)).astype(np.uint64)
        for step in (0, 1):
            keys.append(mix64(mix64(value[far]) + band + np.uint64(step)))
            rows.append(of[far])
            places.append(place[far])
    wide = np.flatnonzero(hot & (4 * size <= 5 * LONG))
    step = 1
    while len(wide) > step:
        a, b = wide[:-step], wide[step:]
        same = (of[a] == of[b]) & (b - a == step)
        if not same.any():
            break
        a, b = a[same], b[same]
        keys.append(mix64(mix64(value[a]) + value[b]))
        rows.append(of[a])
        places.append(place[a])
        step += 1
    few = np.flatnonzero(n < MIN_TOKENS - 1) if short else first[:0]
    if len(few):
        keys.append(_whole_keys(token, at, at[first], few))
        rows.append(few)
        places.append(np.zeros(len(few), np.int64))
    return {"key": np.concatenate(keys), "row": np.concatenate(rows), "pos": np.concatenate(places), "line": at[first] if len(first) else at, "n": n, "name": name, "bits": parity[0], "more": parity[1]}


COLUMNS = (("key", np.uint64), ("name", np.uint64), ("bits", np.uint64), ("more", np.uint64), ("doc", np.int64), ("line", np.int32), ("n", np.int32), ("pos", np.uint16))
ROW = np.dtype([("doc", "<i8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<u2"), ("bits", "<u8"), ("more", "<u8"), ("name", "<u8")])
GONE = 65535  # the place of a line that an equal one of its own task precedes
LEAST = np.int32(1 << 30)  # added to the size at the least key of a line, the one that reports it if an equal line comes earlier


def _gone_here(lines: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which lines an equal set precedes among these, and which only repeat a row of the same document and line."""
    order = np.lexsort((lines["line"], lines["doc"], lines["name"]))
    c = {k: v[order] for k, v in lines.items()}
    same = np.concatenate(([False], np.logical_and.reduce([c[k][1:] == c[k][:-1] for k in ("name", "n", "bits", "more")])))
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    again = (c["doc"] == c["doc"][lead]) & (c["line"] == c["line"][lead])
    gone, repeat = np.empty(len(order), bool), np.empty(len(order), bool)
    gone[order], repeat[order] = same & ~again, same & again
    return gone, repeat


def _emit_keys(table, buckets: int, short: bool):
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c, _ in COLUMNS]])

    def flush(held: list[tuple[dict, dict]]) -> Iterator[pa.RecordBatch]:
        lines = {c: np.concatenate([h[0][c] for h in held]) for c in held[0][0]}
        base = np.cumsum([0, *[len(h[0]["doc"]) for h in held]])
        row = np.concatenate([h[1]["row"] + at for h, at in zip(held, base, strict=False)])
        key, pos = (np.concatenate([h[1][c] for h in held]) for c in ("key", "pos"))
        gone, repeat = _gone_here(lines)
        least = np.full(len(lines["doc"]), np.iinfo(np.uint64).max)
        np.minimum.at(least, row, key)
        # A line that goes here already keeps its first key only, to carry it to the result.
        keep = ~gone[row] & ~repeat[row]
        one, at = np.unique(row[gone[row]], return_index=True)
        at = np.flatnonzero(gone[row])[at]
        row, key, pos = np.concatenate((row[keep], one)), np.concatenate((key[keep], key[at])), np.concatenate((np.minimum(pos[keep], GONE - 1), np.full(len(one), GONE)))
        b = (key % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(b.astype(np.uint16) if buckets < 1 << 16 else b, kind="stable")
        cuts = np.searchsorted(b[order], np.arange(buckets + 1))
        have = np.flatnonzero(np.diff(cuts))
        row = row[order]
        key = key[order]
        cols = {"key": key, "pos": pos[order], **{c: v[row] for c, v in lines.items()}}
        cols["n"] = cols["n"] + (key == least[row]) * LEAST
        cols = {c: cols[c].astype(t) for c, t in COLUMNS}
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), *[pa.array([cols[c][cuts[i] : cuts[i + 1]].tobytes() for i in have], pa.binary()) for c, _ in COLUMNS]], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = table.value
        held, size = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, piece in chunks(batch.column(1).to_pylist(), PIECE):
                token, line, text_of, number = _tokens(piece)
                k = line_keys(token, line, (keys, ranks), short)
                at = k["line"]
                held.append(({"doc": ids[first + text_of[at]], "line": number[at], **{c: k[c] for c in ("n", "name", "bits", "more")}}, {c: k[c] for c in ("key", "row", "pos")}))
                size += len(k["key"])
                if size >= FLUSH_KEYS:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return run


MEET = pa.schema([("kind", pa.int8()), ("key", pa.int64()), ("doc_a", pa.int64()), ("line_a", pa.int32()), ("doc_b", pa.int64()), ("line_b", pa.int32()), ("rows", pa.binary())])
MEET_COLUMNS = "kind byte, key long, doc_a long, line_a int, doc_b long, line_b int, rows binary"
REMOVED, PAIR, SEEKER, CHUNK, BLOCKS = 0, 1, 2, 3, 4


class _Lines:
    """Lines of one key or bucket, a contiguous array a fact."""

    def __init__(self, rows: np.ndarray) -> None:
        self.n = rows["n"].astype(np.int32)
        self.rest = self.n - rows["pos"]  # tokens from the key's first one on
        self.bits, self.more = np.ascontiguousarray(rows["bits"]), np.ascontiguousarray(rows["more"])

    def near(self, a: np.ndarray, other: _Lines, b: np.ndarray) -> np.ndarray:
        """Which pairs pass the length filter and the positional one, the latter as if they met at the first token they share."""
        na, nb = self.n[a].astype(np.int64), other.n[b].astype(np.int64)
        return (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb)) & (9 * np.minimum(self.rest[a], other.rest[b]).astype(np.int64) >= 4 * (na + nb))

    def pairs(self, first: int, last: int, other: _Lines, late: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places (i, j) of the pairs of two blocks that pass all filters, and how far apart their bitmaps are."""
        apart = np.bitwise_count(self.bits[first:last, None] ^ other.bits[late][None])
        apart += np.bitwise_count(self.more[first:last, None] ^ other.more[late][None])
        i, j = np.nonzero(np.multiply(apart, 9, dtype=np.int32) <= self.n[first:last, None] + other.n[late][None])
        at = np.arange(first, last)[i]
        ok = self.near(at, other, (np.arange(late.start, late.stop) if isinstance(late, slice) else late)[j])
        return at[ok], j[ok], apart[i[ok], j[ok]]


def _first_candidates(rows: np.ndarray, early: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a large group's rows, up to TRIES or a scan's best for each later row, and the rows that may have more.

    ``early``: only pairs of one of the first so many rows with one of the others.
    """
    lines = _Lines(rows)
    found_a, found_b, more = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for lo in range(early or 0, len(rows), BLOCK):
        hi = min(lo + BLOCK, len(rows))
        end = hi if early is None else early
        have = np.zeros(hi - lo, np.int64)
        at, step = 0, SCAN
        while at < end:
            open_ = np.flatnonzero(have < TRIES)
            if not len(open_):
                break
            late = lo + open_ if len(open_) < hi - lo else slice(lo, hi)
            i, j, apart = lines.pairs(at, min(at + step, end), lines, late)
            j = open_[j]
            ok = i < lo + j
            i, j = i[ok], j[ok]
            count = np.bincount(j, minlength=hi - lo)
            have += count
            if len(j) and count.max() > TRIES:
                order = np.lexsort((i, apart[ok], j))
                i, j = i[order], j[order]
                take = np.arange(len(j)) - (np.cumsum(count) - count)[j] < TRIES
                i, j = i[take], j[take]
            found_a.append(i)
            found_b.append(lo + j)
            at, step = at + step, min(2 * step, CHUNK_ROWS)
        more.append(lo + np.flatnonzero(have >= TRIES))
    return np.concatenate(found_a), np.concatenate(found_b), np.concatenate(more)


def _in_order(group: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order by group, document and line; packed into one number where they fit, which only sorts faster."""
    if len(doc) and doc.min() >= 0:
        of_doc, of_line = int(doc.max()).bit_length(), int(line.max()).bit_length()
        if int(group.max()).bit_length() + of_doc + of_line < 64:
            return np.argsort((group << (of_doc + of_line)) | (doc << of_line) | line)
    return np.lexsort((line, doc, group))


def _meet(packed: pa.Table) -> pa.Table:
    """The lines of one bucket: repeats of equal sets, candidate pairs, and for lines with many candidates the lines of their key in chunks."""
    c = {name: np.concatenate([np.frombuffer(x, t) for x in packed.column(name).to_pylist()]) for name, t in COLUMNS}
    out: list[tuple] = []

    def add(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, rows: list[bytes] | None = None) -> None:
        blobs = pa.array(rows, pa.binary()) if rows else pa.nulls(len(key), pa.binary())
        out.append((np.full(len(key), kind, np.int8), key.view(np.int64), a["doc"], a["line"], b["doc"], b["line"], blobs))

    gone = c["pos"] == GONE
    if gone.any():
        dead = {k: v[gone] for k, v in c.items()}
        add(REMOVED, dead["key"], dead, dead)
        c = {k: v[~gone] for k, v in c.items()}
    order = np.argsort(c["key"])
    key = c["key"][order]
    follows = np.concatenate(([False], key[1:] == key[:-1])) if len(key) else np.empty(0, bool)
    order = order[follows | np.append(follows[1:], False)] if len(key) else order
    key, rows = c["key"][order], np.empty(len(order), ROW)
    for name in ROW.names:
        rows[name] = c[name][order]
    reports = rows["n"] >= LEAST
    rows["n"] -= reports * LEAST
    group = np.cumsum(np.concatenate(([False], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
    order = _in_order(group, rows["doc"], rows["line"])
    key, rows, reports = key[order], rows[order], reports[order]
    if len(rows):
        # Equal sets of a key side by side; the first in corpus order leads them.
        by_set = np.argsort(mix64(key) + rows["name"])
        k, r = key[by_set], rows[by_set]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | np.logical_or.reduce([r[c][1:] != r[c][:-1] for c in ("name", "n", "bits", "more")])))
        lead = np.empty(len(key), np.int64)
        lead[by_set] = np.minimum.reduceat(by_set, np.flatnonzero(fresh))[np.cumsum(fresh) - 1]
        same = lead != np.arange(len(key))
        # A repeated row of the same document and line is no earlier line.
        repeat = same & reports & ((rows["doc"] != rows["doc"][lead]) | (rows["line"] != rows["line"][lead]))
        add(REMOVED, key[repeat], rows[repeat], rows[repeat])
        key, rows = key[~same], rows[~same]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        group = np.repeat(np.arange(len(first)), size)
        members, lines = size[group], _Lines(rows)
        n, bits = lines.n, lines.bits
        rest = np.flatnonzero((members <= SMALL) & (members > 1))
        for step in range(1, SMALL):
            rest = rest[members[rest] > step]
            a = rest[rest + step < len(group)]
            a = a[group[a] == group[a + step]]
            if not len(a):
                break
            # Half of the bitmap alone settles most pairs.
            a = a[9 * np.bitwise_count(bits[a] ^ bits[a + step]).astype(np.int32) <= n[a] + n[a + step]]
            apart = np.bitwise_count(bits[a] ^ bits[a + step]).astype(np.int32) + np.bitwise_count(lines.more[a] ^ lines.more[a + step])
            a = a[(9 * apart <= n[a] + n[a + step]) & lines.near(a, lines, a + step)]
            add(PAIR, key[a], rows[a], rows[a + step])
        for g in np.flatnonzero(size > SMALL):
            own = rows[first[g] : first[g] + size[g]]
            if len(own) > CHUNK_ROWS:  # other tasks take its chunks in pairs
                some = own[::CHUNK_ROWS].copy()
                held = [own[k : k + CHUNK_ROWS].tobytes() for k in range(0, len(own), CHUNK_ROWS)]
                some["line"] = np.arange(len(some))
                last = some.copy()
                last["line"] = len(some) - 1
                add(BLOCKS, np.repeat(key[first[g]], len(some)), some, last, held)
                continue
            a, b, more = _first_candidates(own)
            add(PAIR, np.repeat(key[first[g]], len(b)), own[a], own[b])
            if len(more):
                add(SEEKER, np.repeat(key[first[g]], len(more)), own[more], own[more], [own[k : k + 1].tobytes() for k in more])
                starts = range(0, len(own), CHUNK_ROWS)
                some = own[list(starts)]
                add(CHUNK, np.repeat(key[first[g]], len(some)), some, some, [own[k : k + CHUNK_ROWS].tobytes() for k in starts])
    if not out:
        return MEET.empty_table()
    cols = [np.concatenate([o[i] for o in out]) for i in range(6)]
    return pa.Table.from_arrays([*[pa.array(v, f.type) for v, f in zip(cols, MEET, strict=False)], pa.concat_arrays([o[6] for o in out])], schema=MEET)


def _meet_blocks(chunks_: pa.Table) -> pa.Table:
    """The candidate pairs of two chunks of a key's lines, or of one with itself, and the lines that may have more."""
    order = np.argsort(chunks_.column("no").to_numpy())
    parts = [np.frombuffer(chunks_.column("rows")[int(i)].as_py(), ROW) for i in order]
    rows = np.concatenate(parts)
    a, b, more = _first_candidates(rows, None if len(parts) == 1 else len(parts[0]))
    key = chunks_.column("key")[0].as_py()
    out = [(PAIR, rows[a], rows[b], pa.nulls(len(b), pa.binary())), (SEEKER, rows[more], rows[more], pa.array([rows[k : k + 1].tobytes() for k in more], pa.binary()))]
    columns = lambda kind, x, y, blobs: [pa.array([kind] * len(x), pa.int8()), pa.array([key] * len(x), pa.int64()), *(pa.array(np.ascontiguousarray(v[c]), t) for v in (x, y) for c, t in (("doc", pa.int64()), ("line", pa.int32()))), blobs]
    return pa.concat_tables([pa.Table.from_arrays(columns(*o), schema=MEET) for o in out])


def _more_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, seekers) of a key to all pairs of a seeker with an earlier line of the chunk that pass the filters."""
    schema = pa.schema([("doc_a", pa.int64()), ("line_a", pa.int32()), ("doc_b", pa.int64()), ("line_b", pa.int32())])
    for batch in batches:
        for chunk, seekers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows, late = np.frombuffer(chunk, ROW), np.frombuffer(b"".join(seekers), ROW)
            i, j, _ = _Lines(rows).pairs(0, len(rows), _Lines(late), slice(0, len(late)))
            a, b = rows[i], late[j]
            ok = (a["doc"] < b["doc"]) | (a["doc"] == b["doc"]) & (a["line"] < b["line"])
            a, b = a[ok], b[ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[c])) for x in (a, b) for c in ("doc", "line")], schema=schema)


def _pick_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("line", pa.int32()), ("words", pa.string())])
    for batch in batches:
        docs, numbers, picked = [], [], []
        for doc, text, wanted in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            parts = (text or "").split("\n")
            for w in wanted:
                if w < len(parts):
                    docs.append(doc)
                    numbers.append(w)
                    picked.append(parts[w])
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(picked, pa.string())], schema=schema)


def word_set(line: str) -> frozenset[bytes]:
    return frozenset(line.encode("utf-8", "surrogatepass").lower().split())


def similar(x: frozenset, y: frozenset) -> bool:
    both = len(x & y)
    return 5 * both >= 4 * (len(x) + len(y) - both)


def _verify_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc", pa.int64()), ("line", pa.int32())])
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        sets = {t: word_set(t) for t in {*a, *b}}
        keep = pa.array([similar(sets[x], sets[y]) for x, y in zip(a, b, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], schema=schema).filter(keep)


def _join_docs(docs: DataFrame, side: DataFrame, numbers: str, how: str, key: str = "doc_id") -> DataFrame:
    """Join by a document's key with a materialised side keyed _id that holds an array of line numbers, broadcast only if its counted bytes are few."""
    size = side.agg(F.coalesce(F.sum(32 + 4 * F.size(numbers)), F.lit(0)).alias("b")).first().b
    return docs.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, docs[key] == side["_id"], how)


def removed_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """(_id, lines): numbers from 0 of the removed lines of each document that has some, where each doc_id has one text; short: also of lines under MIN_TOKENS words."""
    with arrow_batches(docs.sparkSession, TEXT_ROWS):
        return _removed_lines(docs, short)


def _removed_lines(docs: DataFrame, short: bool) -> DataFrame:
    spark = docs.sparkSession
    plain = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    keys, ranks, total = frequent_tokens(plain)
    table = spark.sparkContext.broadcast((keys, ranks))
    buckets = max(4 * shuffle_width(spark), total >> BUCKET_TOKENS)
    packed = plain.mapInArrow(_emit_keys(table, buckets, short), "bucket int, key binary, name binary, bits binary, more binary, doc binary, line binary, n binary, pos binary")
    met = materialize(packed.groupBy("bucket").applyInArrow(_meet, MEET_COLUMNS), "line-meet")
    large = met.where(F.col("kind") == BLOCKS).select("key", F.col("line_a").alias("no"), F.col("line_b").alias("last"), "rows")
    split = None
    if not large.isEmpty():
        # Each chunk goes to every pair that it is part of.
        sides = large.select("key", "no", "rows", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
        pairs_of = sides.groupBy("key", F.least("no", "other").alias("i"), F.greatest("no", "other").alias("j"))
        split = materialize(pairs_of.applyInArrow(_meet_blocks, MEET_COLUMNS), "line-blocks")
        met_rows = met.unionByName(split)
    else:
        met_rows = met
    exact = materialize(met.where(F.col("kind") == REMOVED).select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line")).distinct(), "line-repeats")
    gone = exact.select(F.col("doc").alias("doc_b"), F.col("line").alias("line_b"))
    # A line already removed as a repeat needs no further match, but its first occurrence stands for it.
    pairs = met_rows.where(F.col("kind") == PAIR).select("doc_a", "line_a", "doc_b", "line_b").distinct().join(gone, ["doc_b", "line_b"], "left_anti")
    pairs = materialize(pairs, "line-pairs")
    verified = _verified(plain, pairs)
    seekers = met_rows.where(F.col("kind") == SEEKER).select("key", F.col("doc_b").alias("doc"), F.col("line_b").alias("line"), F.col("rows").alias("seeker"))
    seekers = materialize(seekers.join(exact.unionByName(verified), ["doc", "line"], "left_anti"), "line-seekers")
    if not seekers.isEmpty():
        parts = seekers.groupBy("key").agg(F.ceil(F.count("*") / SEEKERS).alias("parts"))
        asking = seekers.join(parts, "key").groupBy("key", F.pmod(F.xxhash64("doc", "line"), "parts").alias("part")).agg(F.collect_list("seeker").alias("seekers"))
        open_chunks = met.where(F.col("kind").isin(CHUNK, BLOCKS)).select("key", "rows").join(asking, "key").select("rows", "seekers")
        with arrow_batches(spark, CHECK_CHUNKS):
            others = open_chunks.mapInArrow(_more_candidates, "doc_a long, line_a int, doc_b long, line_b int").distinct()
            others = materialize(others.join(pairs, ["doc_a", "line_a", "doc_b", "line_b"], "left_anti"), "line-pairs")
        verified = verified.unionByName(_verified(plain, others))
    every = exact.unionByName(verified).distinct()
    out = materialize(every.groupBy(F.col("doc").alias("_id")).agg(F.sort_array(F.collect_list("line")).alias("lines")), "line-removed")
    discard(met)
    if split is not None:
        discard(split)
    return out


def _verified(plain: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, line) of the later lines of the pairs (materialised) that are similar to one of their earlier ones by their words."""
    ask = pairs.select(F.col("doc_a").alias("doc"), F.col("line_a").alias("line")).unionByName(pairs.select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line")))
    asked = materialize(ask.groupBy(F.col("doc").alias("_id")).agg(F.collect_set("line").alias("wanted")), "line-asked")
    found = _join_docs(plain, asked, "wanted", "inner").select("doc_id", "text", "wanted").mapInArrow(_pick_lines, "doc long, line int, words string").distinct()
    found = materialize(found, "line-texts")
    side = lambda s: found.select(F.col("doc").alias(f"doc_{s}"), F.col("line").alias(f"line_{s}"), F.col("words").alias(s))

    def verify(some: DataFrame) -> DataFrame:
        both = some.join(side("a"), ["doc_a", "line_a"]).join(side("b"), ["doc_b", "line_b"]).select(F.col("doc_b").alias("doc"), F.col("line_b").alias("line"), "a", "b")
        return materialize(both.mapInArrow(_verify_pairs, "doc long, line int").distinct(), "line-verified")

    # Most lines match the earliest candidate; only the others try the rest of theirs.
    earliest = pairs.groupBy("doc_b", "line_b").agg(F.min(F.struct("doc_a", "line_a")).alias("a"), F.count("*").alias("m"))
    earliest = materialize(earliest.select("a.*", "doc_b", "line_b", "m"), "line-first")
    verified = verify(earliest.drop("m"))
    more = earliest.where("m > 1").select("doc_b", "line_b", F.col("doc_a").alias("fa"), F.col("line_a").alias("la"))
    more = more.join(verified.select(F.col("doc").alias("doc_b"), F.col("line").alias("line_b")), ["doc_b", "line_b"], "left_anti")
    rest = pairs.join(more, ["doc_b", "line_b"]).where("doc_a <> fa OR line_a <> la").select("doc_a", "line_a", "doc_b", "line_b")
    verified = verified.unionByName(verify(rest))
    for used in (asked, found, earliest):
        discard(used)
    return verified


def _marked(docs: DataFrame, short: bool) -> DataFrame:
    """docs with _left (the text that stays), _n (lines before) and _gone (lines removed)."""
    docs = with_key(docs)
    removed = removed_lines(docs.select(F.col("_key").alias("doc_id"), "text"), short)
    rows = _join_docs(docs, removed, "lines", "left", "_key").drop("_key")
    count = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    # The runs between removed lines, whose numbers are sorted: each line is looked at once, however many go.
    run = lambda p, ends: lambda k: F.slice(p, F.get(ends, k) + 2, F.get(ends, k + 1) - F.get(ends, k) - 1)
    runs = lambda p: let(F.concat(F.array(F.lit(-1)), F.col("_out"), F.array(F.size(p))), lambda ends: F.flatten(F.transform(F.sequence(F.lit(0), F.size(ends) - 2), run(p, ends))))
    rows = rows.withColumn("_n", F.coalesce(count, F.lit(0))).withColumn("_out", F.filter("lines", lambda x: x < F.col("_n")))
    left = F.when(F.coalesce(F.size("_out"), F.lit(0)) == 0, F.col("text")).otherwise(F.array_join(let(F.split("text", "\n"), runs), "\n"))
    return rows.withColumn("_left", left).withColumn("_gone", F.coalesce(F.size("_out"), F.lit(0))).drop("_id", "lines", "_out")


def report(docs: DataFrame, short: bool = False) -> DataFrame:
    """A row per document: lines, removed lines, characters left and the SHA-256 of the text left."""
    rows = _marked(docs.select("doc_id", "text"), short)
    return rows.select("doc_id", F.col("_n").cast("long").alias("n_lines"), F.col("_gone").cast("long").alias("n_removed"), F.length("_left").cast("long").alias("n_chars_kept"), F.sha2("_left", 256).alias("kept_sha256"))


def dedup_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """docs with their removed lines taken out; documents that lose all their words so are dropped."""
    rows = _marked(docs, short)
    rows = rows.withColumn("text", F.col("_left")).where((F.col("_gone") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    cols = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return rows.select(*cols)
