"""Byte-level BPE by a tokenization automaton.

``compile_automaton`` builds a deterministic automaton over tokens that accepts exactly the sequences the merges
produce. At first one state has an arc for every byte, back to itself. Each merge (u, v) -> w, in order of
rank, adds a gadget: the state that u leads to is split from its likes and loses its arc v, and wherever an arc u
stands, an arc w appears that leads where v led. States that u, v and w share stay shared, so the automaton is
held as a state for each class of last tokens, a class for each kind of next token, and a bit for each
missing arc (14,637 x 10,600 bits for 50,000 merges).

Encoding walks a word left to right. The sequence of a prefix of a word is unique, so exactly one token that ends at
a position has an arc from the state where it starts: a table of token prefixes proposes the tokens, the bits
choose. Work is linear in the word, times the longest token. Decoding joins the labels of the arcs.

Words are split by the byte-level pattern of the vocabulary file; strings of added tokens are cut out before it. Arcs for tokens that begin
with a space are only kept after white space, as the pattern never has a space inside any other word.

Edge cases: null and empty texts have no tokens and decode to an empty text; null doc_ids and repeated rows are coded row
by row; an empty table gives no rows; extra columns are not read, whatever their names; a text of any length, with or without spaces,
is coded whole. Ids that are no tokens fail the decoding; bytes that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts are coded in pieces of so many bytes before their rows leave the worker.
PIECE_BYTES = 8 << 20
#: A worker remembers the codes of so many distinct words, and then begins anew: memory only, codes do not depend on it.
REMEMBERED_WORDS = 300_000
#: Words are coded together, those of over LONG_BYTES one by one.
LONG_BYTES = 64
SEGMENT_CHARS = 1 << 20

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Letters and numbers given after Unicode 16.0, which the tokenizers library takes for other characters.
LATER = (
    "\\u0558\\u058B-\\u058C\\u088F\\u0C5C\\u0CDC\\u208F\\u209D-\\u209F\\uA7CE-\\uA7CF\\uA7D2\\uA7D4\\uA7DD\\uA7E2\\uA7F1\\uAB6C-\\uAB6D"
    "\\U000107BB-\\U000107BF\\U00010940-\\U00010959\\U00010EC5-\\U00010EC7\\U00010ED9-\\U00010EEE\\U00011B0A\\U00011DB0-\\U00011DDB"
    "\\U00011DE0-\\U00011DE9\\U00011DF1\\U0001246F\\U00012475-\\U0001247F\\U00012550-\\U00012686\\U00016EA0-\\U00016EB8"
    "\\U00016EBB-\\U00016ED3\\U00016FF2-\\U00016FF6\\U000187F8-\\U000187FF\\U00018CD6-\\U00018CDA\\U00018D09-\\U00018D20"
    "\\U00018D80-\\U00018DF2\\U00018E00-\\U00019191\\U000191A0-\\U000191D2\\U0001B123-\\U0001B128\\U0001B168\\U0001D6A6"
    "\\U0001DF1F-\\U0001DF24\\U0001DF2B-\\U0001DF81\\U0001DF90-\\U0001DF96\\U0001DFCD-\\U0001DFFF\\U0001E6C0-\\U0001E6DE"
    "\\U0001E6E0-\\U0001E6E2\\U0001E6E4-\\U0001E6E5\\U0001E6E7-\\U0001E6ED\\U0001E6F0-\\U0001E6F4\\U0001E6FE-\\U0001E6FF"
    "\\U0002B73A-\\U0002B73F\\U0002B81E\\U0002CEA2-\\U0002CEAD\\U000323B0-\\U00033479\\U0003D000-\\U0003FC3F"
)


def _split_pattern() -> re.Pattern:
    """SPLIT over the characters up to U+FFFF, with classes that the faster of both regular-expression modules holds as a table."""
    letters, numbers, spaces = (
        "".join(f"{re.escape(m.group()[0])}-{re.escape(m.group()[-1])}" for m in regex.finditer(kind, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)]))))
        for kind in (rf"(?:(?![{LATER}])\p{{L}})+", rf"(?:(?![{LATER}])\p{{N}})+", r"\s+")
    )
    return re.compile(rf" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


_SPLIT = _split_pattern()
_SPLIT_ALL = regex.compile(SPLIT.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{LATER}])").replace(r"\p{L}+", rf"(?:(?![{LATER}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{LATER}])\p{{N}})+"))
_BETWEEN = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def split_words(text: str) -> list[str]:
    """The words that are coded apart; together they are the text."""
    return (_SPLIT if text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text) else _SPLIT_ALL).findall(text)


def segments(text: str) -> Iterator[str]:
    """The text in parts of some SEGMENT_CHARS, cut where a word that is coded apart begins in any case: at a space between two plain letters."""
    at = 0
    while len(text) - at > SEGMENT_CHARS and (m := _BETWEEN.search(text, at + SEGMENT_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes for themselves, the others from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in own}
    for n, b in enumerate(b for b in range(256) if b not in set(own)):
        out[chr(256 + n)] = b
    return out


#: Bytes that white-space characters consist of.
SPACE_BYTES = frozenset(b for c in map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]) for b in c.encode())


def _inner(token: bytes) -> bool:
    """Whether the token can stand after another one of its word."""
    return token[0] != 0x20 or SPACE_BYTES.issuperset(token)


@dataclass
class Automaton:
    """States, classes and missing arcs; labels of arcs; token prefixes; added tokens."""

    labels: list[bytes | None]  # of an arc, by id
    state: list[int]  # where an arc leads, by id
    kind: list[int]  # class of an arc, by id; -1: never inside a word
    missing: bytes  # bits [state, class]
    stride: int
    prefixes: dict[bytes, int]  # of all labels: the id if it is a label itself, else -1
    added: dict[str, int]
    digest: str

    def __post_init__(self) -> None:
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The prefixes as a table, made by each process for itself: [prefix, byte] is the number of the longer prefix, or 0; and the ids of numbered prefixes, or -1."""
        inner = [b"", *sorted({x[:n] for x in self.prefixes for n in range(1, len(x))})]  # these are followed by others, and have the first numbers
        number = {x: n for n, x in enumerate(inner)}
        for x in self.prefixes:
            number.setdefault(x, len(number))
        follow, spells = np.zeros((len(inner), 256), np.int32), np.full(len(number), -1, np.int32)
        for x, n in number.items():
            if x:
                follow[number[x[:-1]], x[-1]] = n
                spells[n] = self.prefixes[x]
        return follow, spells

    def accepts(self, before: int, token: int) -> bool:
        """Whether the state after token ``before`` has an arc ``token``."""
        k = self.kind[token]
        return k >= 0 and self.state[before] >= 0 and not self.missing[self.state[before] * self.stride + (k >> 3)] >> (k & 7) & 1

    def encode_word(self, word: bytes) -> list[int]:
        """The only path of arcs that spells the word."""
        n = len(word)
        arc, start = [-1] * (n + 1), [0] * (n + 1)
        prefixes, state, kind, missing, stride = self.prefixes, self.state, self.kind, self.missing, self.stride
        for i in range(n):
            before = arc[i]
            row = state[before] * stride if i else -1
            for j in range(i + 1, n + 1):
                t = prefixes.get(word[i:j])
                if t is None:
                    break
                if t < 0:
                    continue
                if row >= 0:
                    k = kind[t]
                    if k < 0 or missing[row + (k >> 3)] >> (k & 7) & 1:
                        continue
                arc[j], start[j] = t, i
        out = []
        while n:
            out.append(arc[n])
            n = start[n]
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The packed paths of many short words, position by position for all of them at once."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        longest = len(words[order[0]])
        size = np.array([len(words[i]) for i in order])
        data = np.frombuffer(b"".join([words[i].ljust(longest, b"\0") for i in order]), np.uint8).reshape(len(words), longest)
        left = np.searchsorted(-size, -np.arange(longest + 1), side="left")  # words of more than so many bytes
        arc, start = np.full((longest + 1, len(words)), -1, np.int32), np.zeros((longest + 1, len(words)), np.uint8)
        state, kind, missing = np.array(self.state), np.array(self.kind), np.frombuffer(self.missing, np.uint8)
        follow, spells = self.table
        for i in range(longest):
            at = np.arange(left[i])
            row, node = state[arc[i, at]] * self.stride, np.zeros(len(at), np.int32)
            for j in range(i, longest):
                on = np.flatnonzero((at < left[j]) & (node < len(follow)))
                at, row, node = at[on], row[on], node[on]
                node = follow[node, data[at, j]]
                go = np.flatnonzero(node)
                if not len(go):
                    break
                at, row, node = at[go], row[go], node[go]
                t = spells[node]
                own = t >= 0
                if i:
                    k = kind[t]
                    own &= (k >= 0) & ((missing[row + (k >> 3)] >> (k & 7).astype(np.uint8) & 1) == 0)
                arc[j + 1, at[own]], start[j + 1, at[own]] = t[own], i
        path, n, pos, every = np.zeros((len(words), longest), "<u4"), np.zeros(len(words), np.int64), size.copy(), np.arange(len(words))
        while len(on := every[pos > 0]):
            n[on] += 1
            path[on, longest - n[on]] = arc[pos[on], on]
            pos[on] = start[pos[on], on]
        out: list[bytes] = [b""] * len(words)
        flat, end = path.tobytes(), 0
        for i, count in zip(order, n.tolist(), strict=True):
            end += 4 * longest
            out[i] = flat[end - 4 * count : end]
        return out

    def _learn(self, words: set[str], known: dict[str, bytes]) -> list[str]:
        """Codes of all ``words`` are in ``known`` from now on; returns the long ones, which are not worth remembering."""
        new = words - known.keys()
        if len(known) + len(new) > REMEMBERED_WORDS:
            known.clear()
            new = words
        raw = {w: w.encode() for w in new}
        short = [w for w, b in raw.items() if len(b) <= LONG_BYTES]
        for n in range(0, len(short), 1 << 15):
            some = short[n : n + (1 << 15)]
            known.update(zip(some, self.encode_words([raw[w] for w in some]), strict=True))
        long = [w for w, b in raw.items() if len(b) > LONG_BYTES]
        for w in long:
            known[w] = np.array(self.encode_word(raw[w]), "<u4").tobytes()
        return long

    def encode_texts(self, texts: Iterable[str], known: dict[str, bytes] | None = None) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. ``known``: codes of words met before, added to here."""
        known = {} if known is None else known
        waiting: list[list[list[str] | bytes]] = []  # texts in parts, words or their codes; the last one may still grow
        chars = 0

        def code() -> None:
            nonlocal chars
            long = self._learn({w for parts in waiting for p in parts if isinstance(p, list) for w in p}, known)
            for parts in waiting:
                parts[:] = [b"".join([b"".join(map(known.__getitem__, p)) if isinstance(p, list) else p for p in parts])]
            for w in long:
                del known[w]
            chars = 0

        for text in texts:
            if chars >= SEGMENT_CHARS:
                code()
                yield from (parts[0] for parts in waiting)
                waiting = []
            waiting.append([])
            for n, piece in enumerate(self.cut.split(text) if self.cut else [text]):
                if n % 2:
                    waiting[-1].append(np.array([self.added[piece]], "<u4").tobytes())
                    continue
                for segment in segments(piece):
                    waiting[-1].append(split_words(segment))
                    chars += len(segment)
                    if chars >= 2 * SEGMENT_CHARS:
                        code()
        code()
        yield from (parts[0] for parts in waiting)

    def encode(self, text: str) -> bytes:
        return next(self.encode_texts([text]))

    def decode(self, ids: bytes) -> str:
        return spelled(self.labels, ids)


def spelled(labels: list[bytes | None], ids: bytes) -> str:
    """Text of the arc labels of ids that are packed as ``encode`` packs them."""
    return b"".join([labels[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def _room(merges: list[tuple[int, int, int]], labels: list[bytes | None]) -> tuple[int, int]:
    """States and classes that there are after all merges, at most."""
    state, kind = [-1] * len(labels), [-1] * len(labels)
    for t, label in enumerate(labels):
        if label is not None and len(label) == 1:
            state[t], kind[t] = 0, 0 if _inner(label) else -1
    states = kinds = 1
    in_state, in_kind = Counter(state), Counter(kind)
    for u, v, w in merges:
        if state[u] < 0 or state[v] < 0 or state[w] >= 0:
            raise ValueError("a merge uses a token before it is made, or makes one twice")
        was = state[v]
        if kind[v] >= 0:
            if in_state[state[u]] > 1 or u == v:
                in_state[state[u]] -= 1
                state[u], states = states, states + 1
                in_state[state[u]] = 1
            if in_kind[kind[v]] > 1:
                in_kind[kind[v]] -= 1
                kind[v], kinds = kinds, kinds + 1
                in_kind[kind[v]] = 1
        state[w] = was
        in_state[was] += 1
        if _inner(labels[w]):
            kind[w] = kind[u]
            in_kind[kind[u]] += 1
    return states, kinds


def compile_automaton(vocab: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int] | None = None) -> Automaton:
    """The automaton of a byte-level vocabulary and its merges in order of rank."""
    added = added or {}
    letter = byte_letters()
    labels: list[bytes | None] = [None] * (max([*vocab.values(), *added.values()], default=-1) + 1)
    for token, i in vocab.items():
        if token not in added:
            labels[i] = bytes(letter[c] for c in token)
    pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
    states, kinds = _room(pairs, labels)
    stride = (kinds + 7) // 8
    missing = np.zeros((states, stride), np.uint8)
    # The gadgets: a split copies a row or a column. A merge whose arcs never follow each other makes no arc.
    now_s, now_k = [0 if x is not None and len(x) == 1 else -1 for x in labels], [0 if x is not None and len(x) == 1 and _inner(x) else -1 for x in labels]
    in_state, in_kind = Counter(now_s), Counter(now_k)
    n_s = n_k = 1
    for u, v, w in pairs:
        was, k = now_s[v], now_k[v]
        if now_s[u] < 0 or was < 0 or k < 0 or missing[now_s[u], k >> 3] >> np.uint8(k & 7) & 1:
            continue
        if in_state[now_s[u]] > 1 or u == v:
            in_state[now_s[u]] -= 1
            missing[n_s] = missing[now_s[u]]
            now_s[u], n_s = n_s, n_s + 1
            in_state[now_s[u]] = 1
        if in_kind[k] > 1:
            in_kind[k] -= 1
            missing[:n_s, n_k >> 3] |= (missing[:n_s, k >> 3] >> np.uint8(k & 7) & np.uint8(1)) << np.uint8(n_k & 7)
            now_k[v], k, n_k = n_k, n_k, n_k + 1
            in_kind[k] = 1
        missing[now_s[u], k >> 3] |= np.uint8(1 << (k & 7))
        now_s[w] = was
        in_state[was] += 1
        if _inner(labels[w]):
            now_k[w] = now_k[u]
            in_kind[now_k[u]] += 1
    prefixes: dict[bytes, int] = {}
    for t, label in enumerate(labels):
        if now_s[t] >= 0:
            for n in range(1, len(label)):
                prefixes.setdefault(label[:n], -1)
            prefixes[label] = t
    for token, i in added.items():
        labels[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
    digest = hashlib.sha256(json.dumps([sorted(vocab.items()), merges, sorted(added.items())]).encode()).hexdigest()
    return Automaton(labels, now_s, now_k, missing.tobytes(), stride, prefixes, added, digest)


def load_automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file of the tokenizers library. Files with settings that change codes and are not built here are refused."""
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    model, split = given["model"], given.get("pre_tokenizer") or {}
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
    bare = not given.get("normalizer") and all(not t.get(k) for t in given["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if model["type"] != "BPE" or not plain or not bare or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        raise ValueError(f"{path} is no plain byte-level vocabulary")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    return compile_automaton(model["vocab"], merges, {t["content"]: t["id"] for t in given["added_tokens"]})


_known: dict[str, dict[str, bytes]] = {}


def _pieces(rows: Iterator[tuple], schema: pa.Schema, weight: int) -> Iterator[pa.RecordBatch]:
    """Batches of rows, closed once their values in column ``weight`` hold PIECE_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight])
        if size >= PIECE_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row; ids are packed as little-endian unsigned 32-bit integers.

    The automaton is broadcast: its size is bounded by its vocabulary, not by the documents.
    """
    sent = docs.sparkSession.sparkContext.broadcast(automaton)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        known = _known.setdefault(a.digest, {})

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, ids in zip(batch.column(0), a.encode_texts((text.as_py() or "" for text in batch.column(1)), known), strict=True):
                yield doc_id.as_py(), len(ids) // 4, ids

        for batch in batches:
            yield from _pieces(rows(batch), pa.schema([("doc_id", batch.schema.field(0).type), ("n_tokens", pa.int64()), ("ids", pa.binary())]), 2)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids binary")


def decode(coded: DataFrame, automaton: Automaton) -> DataFrame:
    """``coded`` (doc_id, n_tokens, ids) with the text that its ids spell."""
    sent = coded.sparkSession.sparkContext.broadcast(automaton.labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = sent.value

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            for doc_id, n, ids in zip(*batch.columns, strict=True):
                packed = ids.as_py() or b""
                yield doc_id.as_py(), n.as_py(), packed, spelled(labels, packed)

        for batch in batches:
            yield from _pieces(rows(batch), pa.schema([*batch.schema, ("text", pa.string())]), 2)

    return coded.select("doc_id", "n_tokens", "ids").mapInArrow(run, f"doc_id {dict(coded.dtypes)['doc_id']}, n_tokens long, ids binary, text string")


def report(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """Digests of the ids of every row and of the text decoded from them."""
    back = decode(encode(docs, automaton), automaton)
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
