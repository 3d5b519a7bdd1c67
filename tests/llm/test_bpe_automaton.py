"""The tokenization automaton against the tokenizers library and against plain merging."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomspark.llm import bpe_automaton as ba
from loomspark.llm.queries import op13_bpe
from tests.compare import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def automaton():
    return ba.load_automaton(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(word: bytes, merges: list[tuple[bytes, bytes]]) -> list[bytes]:
    parts = [word[i : i + 1] for i in range(len(word))]
    for a, b in merges:  # every merge over the whole word, in order of rank
        i, out = 0, []
        while i < len(parts):
            if parts[i : i + 2] == [a, b]:
                out.append(a + b)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def small(seed: int, letters: str = "abc", n: int = 12):
    rng, known, merges = random.Random(seed), list(letters), []
    while len(merges) < n:
        a, b = rng.choice(known), rng.choice(known)
        if a + b not in known:
            known.append(a + b)
            merges.append((a, b))
    return {t: i for i, t in enumerate(known)}, merges


@pytest.mark.parametrize("seed", range(25))
def test_small_automata_code_every_word(seed):
    vocab, merges = small(seed)
    a = ba.compile_automaton(vocab, merges)
    words = [bytes(w) for n in range(1, 8) for w in itertools.product(b"abc", repeat=n)]
    raw = [(x.encode(), y.encode()) for x, y in merges]
    for word, code in zip(words, a.encode_words(words), strict=True):
        want = [vocab[t.decode()] for t in plain(word, raw)]
        assert a.encode_word(word) == want == np.frombuffer(code, "<u4").tolist(), (word, merges)


@pytest.mark.parametrize("seed", range(5))
def test_automaton_accepts_only_what_merges_produce(seed):
    vocab, merges = small(seed, n=8)
    a = ba.compile_automaton(vocab, merges)
    raw = [(x.encode(), y.encode()) for x, y in merges]
    for n in (2, 3):
        for tokens in itertools.product(vocab, repeat=n):
            produced = plain("".join(tokens).encode(), raw) == [t.encode() for t in tokens]
            path = all(a.state[vocab[t]] >= 0 for t in tokens) and all(a.accepts(vocab[s], vocab[t]) for s, t in itertools.pairwise(tokens))
            assert produced == path, (tokens, merges)


def agree(automaton, library, texts):
    for text, ids, e in zip(texts, automaton.encode_texts(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, text[:80]
        assert automaton.decode(ids) == library.decode(e.ids, skip_special_tokens=False) == text


def test_random_texts_as_the_library(automaton, library):
    rng = random.Random(3)
    parts = ["a", "b", "the", "in", " ", "  ", "\n", "\t", "é", " ", "　", "x", "er", "1", "23", "!", "...", "--", "<|endoftext|>", "\0", "\x1c", "日本", "😀", "'s", "'ll", "\r\n", "ing", "՘", " ", "\u0085", "𐐷"]
    agree(automaton, library, ["".join(rng.choice(parts) for _ in range(rng.randrange(50))) for _ in range(5000)])


def test_characters_as_the_library(automaton, library):
    """All of the first planes' scripts, what is newer than the library and its neighbours, and every 13th of the rest."""
    later = [i for a, b in re.findall(r"\\[uU]([0-9A-F]+)(?:-\\[uU]([0-9A-F]+))?", ba.LATER) for i in (int(a, 16) - 1, int(a, 16), int(b or a, 16), int(b or a, 16) + 1)]
    every = [chr(c) for c in sorted({*range(0x3400), *later, *range(0x3400, 0x110000, 13)}) if not 0xD800 <= c < 0xE000]
    agree(automaton, library, ["".join(f"a{c}1{c}.{c} {c}{c} b" for c in every[i : i + 2000]) for i in range(0, len(every), 2000)])


def test_long_texts_and_long_words(automaton, library, monkeypatch):
    agree(automaton, library, ["a" * 50_000, " " * 5001, "=" * 3333, "ab" * 20_000, "", "日" * 5000, "x " * 10_000])
    monkeypatch.setattr(ba, "SEGMENT_CHARS", 50)
    monkeypatch.setattr(ba, "REMEMBERED_WORDS", 30)
    agree(automaton, library, ["one, two three 4 five<|endoftext|>six  seven\n\neight it's " * 60, "", "no"])
    text = "one, two three 4 five six  seven " * 60
    assert len(list(ba.segments(text))) > 10 and "".join(ba.segments(text)) == text


def test_refused_files(tmp_path):
    with pytest.raises(ValueError, match="no plain byte-level"):
        ba.load_automaton(public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="before it is made"):
        ba.compile_automaton({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")])


def test_edges(spark, automaton, library):
    rows = [(1, "Hello there", "x"), (1, "Hello there", "x"), (None, "word", None), (2, None, "y"), (3, "", "z"), (4, "<|endoftext|>", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, ba.report(docs, automaton).collect()), key=str)

    def want(doc_id, text):
        e = library.encode(text or "", add_special_tokens=False)
        return doc_id, len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    assert got == sorted((want(*r[:2]) for r in rows), key=str)
    assert ba.report(docs.where("doc_id > 9"), automaton).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_as_the_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in op13_bpe(spark, f"{DATA}/sf0.01").collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        e = library.encode(text or "", add_special_tokens=False)
        back = library.decode(e.ids, skip_special_tokens=False)
        assert got[doc_id] == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
