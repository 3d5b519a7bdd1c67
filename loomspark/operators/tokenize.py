"""Encoding and decoding with a vocabulary."""

from __future__ import annotations

import json
import re
import tomllib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.session import get_text, put_text

# Special tokens and their order of registration: fixed values.
SPECIAL_TOKENS = {
    "pad": "<|pad|>", "bos": "<|im_start|>", "eos": "<|endoftext|>", "unk": "<|unk|>", "mask": "<|mask|>", "sep": "<|sep|>", "cls": "<|cls|>",
    "im_end": "<|im_end|>", "user": "<|user|>", "assistant": "<|assistant|>", "system": "<|system|>",
}
LONGEST_PIECE = 20
PORTION = 1 << 22
PATTERN_TOKENS = 2_000  # of so many tokens a pattern is built
WORDS_KEPT, LONGEST_WORD_KEPT = 100_000, 64


@dataclass
class Vocabulary:
    """Special tokens first, then the learned tokens; ids are dense from 0."""

    tokens: Sequence[str] = ()
    merges: Sequence[tuple[str, str]] = ()
    special: dict[str, str] = field(default_factory=lambda: dict(SPECIAL_TOKENS))

    def __post_init__(self) -> None:
        self.ids: dict[str, int] = {}
        for token in [*self.special.values(), *self.tokens]:
            self.ids.setdefault(token, len(self.ids))
        self.names = list(self.ids)

    def id(self, role: str) -> int | None:
        """Id of a special token by its role."""
        return self.ids.get(self.special.get(role, ""))

    def __len__(self) -> int:
        return len(self.ids)

    def __contains__(self, token: str) -> bool:
        return token in self.ids

    def save(self, path: str, **settings) -> None:
        """A JSON file of the tokens with their ids, the merges in order, the special tokens and any settings."""
        record = {"vocab": self.ids, "merges": [list(m) for m in self.merges], "special_tokens": self.special, "vocab_size": len(self), **settings}
        put_text(path, json.dumps(record, ensure_ascii=False, indent=2))

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """A saved vocabulary; from a TOML configuration (special_tokens), one with the special tokens only."""
        text = get_text(path)
        try:
            record = json.loads(text)
        except ValueError:
            try:
                record = tomllib.loads(text)
            except tomllib.TOMLDecodeError as e:
                raise ValueError(f"{path} holds neither a JSON vocabulary nor a TOML configuration") from e
        special = {**SPECIAL_TOKENS, **record.get("special_tokens", {})}
        ids = record.get("vocab", {})
        if sorted(ids.values()) != list(range(len(ids))):
            raise ValueError(f"{path}: ids must be dense from 0")
        out = cls(sorted(ids, key=ids.get), [tuple(m) for m in record.get("merges", [])], special)
        if ids and out.ids != ids:
            out.ids, out.names = dict(sorted(ids.items(), key=lambda x: x[1])), sorted(ids, key=ids.get)
        return out

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(t, i) for t, i in self.ids.items()], "token string, id int")


def encode_bpe(text: str, vocabulary: Vocabulary) -> list[int]:
    """Left-to-right passes that merge any known pair, whatever its rank, until nothing changes."""
    pairs, tokens = set(map(tuple, vocabulary.merges)), list(text)
    for _ in range(2 * len(tokens)):
        out: list[str] = []
        rest = iter(tokens)
        current = next(rest, None)
        changed = False
        for following in rest:
            if (current, following) in pairs:
                current, changed = current + following, True
            else:
                out.append(current)
                current = following
        if current is not None:
            out.append(current)
        tokens = out
        if not changed:
            break
    unk = vocabulary.id("unk")
    return [vocabulary.ids.get(t, unk) for t in tokens] or [unk]


def _ends(vocabulary: Vocabulary, longest: int | None = None, head: str = "") -> dict[str, tuple[int, ...]]:
    """The lengths of the tokens that begin with a character, longest first; with ``head``, of what follows it."""
    lengths: dict[str, set[int]] = {}
    for token in vocabulary.ids:
        rest = token[len(head) :] if token.startswith(head) else ""
        if rest and (longest is None or len(rest) <= longest):
            lengths.setdefault(rest[0], set()).add(len(rest))
    return {c: tuple(sorted(n, reverse=True)) for c, n in lengths.items()}


def _kept(vocabulary: Vocabulary, name: str, make):
    """What an encoder derives from a vocabulary, made once in each process for its present tokens."""
    held = vocabulary.__dict__.setdefault("_derived", {})
    if name not in held or held[name][0] != len(vocabulary.ids):
        held[name] = len(vocabulary.ids), make()
    return held[name][1]


def _longest_first(vocabulary: Vocabulary) -> re.Pattern | None:
    """A pattern of the longest token at a place, else of one character, by a tree of what tokens begin with; None for a large vocabulary."""
    tokens = [t for t in vocabulary.ids if 0 < len(t) <= LONGEST_PIECE]
    if len(tokens) > PATTERN_TOKENS:
        return None
    tree: dict = {}
    for token in tokens:
        node = tree
        for c in token:
            node = node.setdefault(c, {})
        node[""] = True

    def pattern(node: dict) -> str:
        # Of two branches that begin with different characters at most one fits, and the greedy "?" tries what goes on before what ends.
        inner = "|".join(re.escape(c) + pattern(x) for c, x in node.items() if c)
        return inner and f"(?:{inner})" + "?" * ("" in node)

    return re.compile("|".join([*([pattern(tree)] if tree else []), "[\\s\\S]"]))


def encode_wordpiece(text: str, vocabulary: Vocabulary) -> list[int]:
    """Longest known prefix of each word, then continuations with ``##``; a miss gives unk and leaves the word."""
    unk, ids, out = vocabulary.id("unk"), vocabulary.ids, []
    first, later, words = _kept(vocabulary, "wordpiece", lambda: (_ends(vocabulary), _ends(vocabulary, head="##"), {}))
    for word in text.split():
        known = words.get(word)
        if known is None:
            known, at = [], 0
            while at < len(word):
                head = "##" if at else ""
                for n in (later if at else first).get(word[at], ()):
                    if at + n <= len(word) and (i := ids.get(head + word[at : at + n])) is not None:
                        known.append(i)
                        at += n
                        break
                else:
                    known.append(unk)
                    break
            if len(words) >= WORDS_KEPT:
                words.clear()
            if len(word) <= LONGEST_WORD_KEPT:
                words[word] = known
        out += known
    return out or [unk]


def encode_unigram(text: str, vocabulary: Vocabulary) -> list[int]:
    """Greedy longest match of at most LONGEST_PIECE characters; a miss gives unk for one character."""
    found = _kept(vocabulary, "pattern", lambda: _longest_first(vocabulary))
    unk, out, at, end = vocabulary.id("unk"), [], 0, len(text)
    if found is not None:
        known = vocabulary.ids
        return [known.get(t, unk) for t in found.findall(text)] or [unk]
    ends, ids, add = _kept(vocabulary, "unigram", lambda: _ends(vocabulary, LONGEST_PIECE)).get, vocabulary.ids.get, out.append
    while at < end:
        for n in ends(text[at], ()):
            # A slice that the end cuts short is a shorter token, which is tried at its own length.
            if (i := ids(text[at : at + n])) is not None and at + n <= end:
                add(i)
                at += n
                break
        else:
            add(unk)
            at += 1
    return out or [unk]


ENCODERS = {"bpe": encode_bpe, "wordpiece": encode_wordpiece, "unigram": encode_unigram, "sentencepiece": encode_unigram}


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """A batch in portions whose column has about ``PORTION`` bytes, so that ids of few rows are held at once."""
    rows = max(1, int(PORTION * batch.num_rows / max(batch.column(column).nbytes, 1)))
    for lo in range(0, batch.num_rows, rows):
        part = batch.slice(lo, rows)
        yield part, part.column(column)


def encode(texts: DataFrame, vocabulary: Vocabulary, algorithm: str = "bpe", text: str = "text", out: str = "tokens") -> DataFrame:
    """Input columns plus the ids of a (normalised) text; null and empty texts give one unk."""
    one = ENCODERS[algorithm]
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            for part, rows in _portions(batch, at):
                ids, ends = array("i"), [0]
                for t in rows:
                    ids.extend(one(t.as_py() or "", shared.value))
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*batch.schema.names, out])

    return texts.mapInArrow(run, ", ".join([*(f"`{n}` {k}" for n, k in texts.dtypes), f"`{out}` array<int>"]))


def greedy_pieces(text: Column, pieces: Sequence[str]) -> Column:
    """Greedy longest-match pieces without Python, for vocabularies that fit one pattern; a miss is one character."""
    longest_first = sorted({p for p in pieces if 0 < len(p) <= LONGEST_PIECE}, key=lambda p: (-len(p), p))
    pattern = "(" + "|".join([*(re.escape(p) for p in longest_first), "[\\s\\S]"]) + ")"
    return F.regexp_extract_all(text, F.lit(pattern), 1)


def frame_batch(ids: Column, bos: int, eos: int, max_length: int, pad: int | None = None) -> Column:
    """BOS + ids; longer than max_length: cut to max_length - 1 and EOS; shorter: EOS and optional padding; equal: as it is."""
    full = F.concat(F.array(F.lit(bos)), ids)
    n = F.size(full)
    framed = F.when(n > max_length, F.concat(F.slice(full, 1, max_length - 1), F.array(F.lit(eos)))).when(n < max_length, F.concat(full, F.array(F.lit(eos)))).otherwise(full)
    if pad is None:
        return framed
    return F.concat(framed, F.array_repeat(F.lit(pad), F.greatest(F.lit(max_length) - F.size(framed), F.lit(0))))


def attention_mask(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: F.when(x == pad, F.lit(0.0)).otherwise(F.lit(1.0)).cast("float"))


def _spoken(vocabulary: Vocabulary) -> tuple:
    """By id, and last for ids that are no tokens: what a token adds to a text, without and with a space before it; whether it is skipped, asks for a space, or ends with one."""
    skip = {vocabulary.id("pad"), vocabulary.id("bos")}
    names = [*vocabulary.names, vocabulary.special["unk"]]
    parts = [(t[2:], False) if t.startswith("##") else (" " + t[1:], False) if t.startswith("▁") else (t, True) for t in names]
    pieces = [p for p, _ in parts]
    skipped = np.array([i in skip or not p and not parted for i, (p, parted) in enumerate(parts)])  # a bare ## adds nothing
    return [*pieces, *(" " + p for p in pieces)], skipped, np.array([parted for _, parted in parts]), np.array([p.endswith(" ") for p in pieces])


def decode_ids(ids: Sequence[int], vocabulary: Vocabulary) -> str:
    """Tokens with a space between any two, but ``##`` continues a word and the word mark starts one; pad and bos are skipped, eos ends."""
    pieces, skipped, parted, spaced = _kept(vocabulary, "spoken", lambda: _spoken(vocabulary))
    at, n, end = np.asarray(ids, np.int64), len(skipped), vocabulary.id("eos")
    if end is not None and len(stop := np.flatnonzero(at == end)):
        at = at[: stop[0]]
    at = np.where((at >= 0) & (at < n - 1), at, n - 1)
    at = at[~skipped[at]]
    apart = parted[at]
    apart[:1] = False
    apart[1:] &= ~spaced[at[:-1]]
    return "".join([pieces[i] for i in (at + n * apart).tolist()]).strip()


def decode(rows: DataFrame, vocabulary: Vocabulary, ids: str = "tokens", out: str = "text") -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lists in _portions(batch, batch.schema.get_field_index(ids)):
                texts = pa.array([decode_ids(x.values.to_numpy() if x.is_valid else [], shared.value) for x in lists], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, ", ".join([*(f"`{n}` {k}" for n, k in rows.dtypes), f"`{out}` string"]))
