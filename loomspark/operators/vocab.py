"""Vocabulary training: counts, and the BPE, WordPiece, Unigram and SentencePiece-like trainers.

Every step is a grouped count over the lines of the corpus; the driver only holds the merges found, and candidates for frequent substrings.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import substrings
from loomspark.operators.tokenize import Vocabulary
from loomspark.session import discard, materialize

BYTE_TOKENS = 256
WRITE_AFTER = 64  # merges that every round does again before the texts are written with them
CANDIDATES = 500_000  # strings that the driver and every task may hold while they are counted
OPEN, CLOSE = "\ufdd0", "\ufdd1"  # around a token: code points that Unicode keeps for use inside programs
WORD_MARK = "▁"


def lines(texts: DataFrame, text: str = "text") -> DataFrame:
    """One row per line of each text."""
    return texts.select(F.explode(F.split(F.col(text), "\n")).alias(text))


def char_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each character inside lines."""
    chars = lines(texts, text).select(F.explode(F.split(F.col(text), "")).alias("token"))
    return chars.where("token <> ''").groupBy("token").agg(F.count("*").alias("n"))


def char_vocabulary(texts: DataFrame, min_frequency: int = 2, keep_bytes: bool = True, text: str = "text") -> DataFrame:
    """Characters frequent enough, and the byte tokens ``<0xNN>`` at count 0."""
    chars = char_counts(texts, text).where(F.col("n") >= min_frequency)
    if not keep_bytes:
        return chars
    numbers = texts.sparkSession.range(BYTE_TOKENS)
    return chars.unionByName(numbers.select(F.format_string("<0x%02X>", "id").alias("token"), F.lit(0).cast("long").alias("n")))


def _chars(text: Column) -> Column:
    """The characters of a text; bound to a column of its own before it is used in a lambda, so that it is split once."""
    return F.array_remove(F.split(text, ""), "")


def _neighbours(chars: str) -> Column:
    """Each two adjacent characters of an array, joined: linear in the line, as no substring is searched from its start."""
    less = F.greatest(F.size(chars) - 1, F.lit(0))
    return F.zip_with(F.slice(chars, 1, less), F.slice(chars, 2, less), lambda x, y: F.concat(x, y))


def pair_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of each pair of adjacent characters inside a line."""
    counted = texts.select(text).mapInArrow(substrings.local_pairs, "left_token string, right_token string, n long")
    return counted.groupBy("left_token", "right_token").agg(F.sum("n").alias("n"))


def top_k(counts: DataFrame, k: int, by: str = "n") -> DataFrame:
    """The k largest counts, ties by the remaining columns in order."""
    rest = [c for c in counts.columns if c != by]
    return counts.orderBy(F.col(by).desc(), *rest).limit(k)


def _wrapped(text: Column) -> Column:
    """Every character between marks, so that a literal replacement of two neighbours merges from left to right."""
    return F.regexp_replace(text, "([\\s\\S])", f"{OPEN}$1{CLOSE}")


def _wrapped_pairs(rows: DataFrame) -> DataFrame:
    cut = F.split(F.rtrim(F.ltrim(F.col("w"), F.lit(OPEN)), F.lit(CLOSE)), CLOSE + OPEN)
    # Bound to a column of its own: inside the lambda the split would be repeated for every token.
    bound = rows.where("w <> ''").select("m", cut.alias("t"))
    pairs = F.zip_with(F.slice("t", 1, F.size("t") - 1), F.slice("t", 2, F.size("t") - 1), lambda x, y: F.struct(x.alias("left_token"), y.alias("right_token")))
    return bound.where(F.size("t") > 1).select("m", F.explode(pairs).alias("p")).groupBy("p.left_token", "p.right_token").agg(F.sum("m").alias("n"))


def _next_merges(top: list, all_seen: bool, known: set[str], room: int) -> list:
    """The first of the pairs in order of count that the plain loop would merge one after the other, whatever the counts become meanwhile.

    A merge (a, b) only lowers counts of pairs (x, a) and (b, y), whose occurrences can overlap its own, and makes pairs (x, ab) and (ab, y) that are no more frequent than
    these were. So a following pair is next if it is no such pair of one before it, as long as ties cannot put a new pair before it: (x, ab) comes after (x, a) in
    any case, (ab, y) may not, so that a pair (b, y) of the same count ends the list. So do pairs of a token with itself, and tokens that exist already.
    """
    out: list = []
    lefts: set[str] = set()
    rights: set[str] = set()
    for k, pair in enumerate(top[:room]):
        a, b = pair.left_token, pair.right_token
        alone = a == b or a + b in known
        if out:
            tied = [x for x in top[k:] if x.n == pair.n]
            tie_open = not all_seen and top[-1].n == pair.n
            if alone or a in rights or b in lefts or a + b in {x.left_token + x.right_token for x in out} or tie_open or any(x.left_token in rights for x in tied):
                break
        out.append(pair)
        lefts.add(a)
        rights.add(b)
        if alone:
            break
    return out


def _unused(known: set[str]) -> Iterator[str]:
    """Characters that no text holds, those for private use first."""
    return (c for c in map(chr, chain(range(0xF0000, 0x110000), range(0xE000, 0xF900), range(0x30000, 0xE0000))) if c not in known)


def learn_merges(texts: DataFrame, n_merges: int, text: str = "text", look: int = 400) -> tuple[list[tuple[int, str, str, int]], int]:
    """(rank, left token, right token, count) of each merge, and the rounds that it took; see ``train_bpe``."""
    pairs_of = "left_token string, right_token string, n long"
    rows = materialize(texts.select(F.translate(text, OPEN + CLOSE, "\n\n").alias("w")).where("w <> ''"), "bpe-texts")
    counts = materialize(pair_counts(rows, "w"), "bpe-counts")
    letters = counts.select(F.explode(F.array("left_token", "right_token")).alias("t")).distinct()
    known = {r.t for r in letters.toLocalIterator()}  # an alphabet
    code = {t: t for t in known}  # the character that stands for a token
    fresh = _unused(set(known))
    done: list[tuple[str, str]] = []  # merges that the written texts still lack
    found: list[tuple[int, str, str, int]] = []
    rounds = 0
    while len(found) < n_merges:
        top = counts.orderBy(F.col("n").desc(), "left_token", "right_token").limit(look).collect()
        chosen = _next_merges(top, len(top) < look, known, n_merges - len(found))
        if not chosen:
            break
        rounds += 1
        found += [(len(found) + k, r.left_token, r.right_token, r.n) for k, r in enumerate(chosen)]
        known |= {r.left_token + r.right_token for r in chosen}
        if len(found) >= n_merges:
            break
        new = []
        for r in chosen:
            one = code.setdefault(r.left_token + r.right_token, "") or next(fresh)
            code[r.left_token + r.right_token] = one
            new.append((code[r.left_token] + code[r.right_token], one))
        names = {c: t for t, c in code.items() if c != t}
        change = rows.mapInArrow(substrings.merge_changes(done, new, names), pairs_of)
        old, counts = counts, materialize(counts.unionByName(change).groupBy("left_token", "right_token").agg(F.sum("n").alias("n")).where("n > 0"), "bpe-counts")
        discard(old)
        done += new
        if len(done) >= WRITE_AFTER:
            before, rows = rows, materialize(rows.mapInArrow(substrings.apply_merges(done), "w string"), "bpe-texts")
            discard(before)
            done = []
    discard(counts)
    discard(rows)
    return found, rounds


def train_bpe(texts: DataFrame, n_merges: int, text: str = "text", look: int = 400) -> DataFrame:
    """(rank, left_token, right_token, n): the merges learned, ties by the smaller pair.

    Lines are the unit, as merges never cross them; two code points that Unicode keeps for use inside programs part lines too. Pairs are counted once over all lines. A token
    is one character of the texts, a merged one a character that they lack. A round merges as many of the ``look`` most frequent pairs as cannot disturb each other, and adds
    to the counts what it changed: only lines that hold one of these pairs are counted again. Texts are written anew after every ``WRITE_AFTER`` merges. Superseded tables are deleted.
    """
    found, _ = learn_merges(texts, n_merges, text, look)
    return texts.sparkSession.createDataFrame(found, "rank int, left_token string, right_token string, n long")


def wordpiece_scores(texts: DataFrame, text: str = "text") -> DataFrame:
    """score = count(ab) / (count(a) * count(b)) for adjacent characters of words."""
    words = texts.select(F.explode(F.split(F.trim(F.col(text)), "\\s+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("m"))
    chars = words.select("m", F.explode(F.split("w", "")).alias("token")).where("token <> ''").groupBy("token").agg(F.sum("m").alias("n"))
    pairs = words.select("m", _chars(F.col("w")).alias("t")).select("m", F.explode(_neighbours("t")).alias("pair")).groupBy("pair").agg(F.sum("m").alias("n"))
    left = chars.select(F.col("token").alias("left_token"), F.col("n").alias("n_left"))
    right = chars.select(F.col("token").alias("right_token"), F.col("n").alias("n_right"))
    named = pairs.select(F.substring("pair", 1, 1).alias("left_token"), F.substring("pair", 2, 1).alias("right_token"), "n")
    scored = named.join(left, "left_token").join(right, "right_token")
    return scored.select("left_token", "right_token", "n", (F.col("n") / (F.col("n_left") * F.col("n_right"))).alias("score"))


def _wrapped_tokens(rows: DataFrame) -> DataFrame:
    cut = F.split(F.rtrim(F.ltrim(F.col("w"), F.lit(OPEN)), F.lit(CLOSE)), CLOSE + OPEN)
    return rows.where("w <> ''").select("m", F.explode(cut).alias("token")).groupBy("token").agg(F.sum("m").alias("n"))


def train_wordpiece(texts: DataFrame, n_merges: int, text: str = "text", compat: bool = False, cut_every: int = 4) -> DataFrame:
    """(rank, left_token, right_token, score): the pairs of best score count(ab) / (count(a) * count(b)) inside words, ties by the smaller pair.

    Each pair found is merged before the next is sought; with ``compat`` it is not, so that the same pair stays best and is the only one.
    Equal words are counted once.
    """
    words = texts.select(F.explode(F.split(F.trim(F.col(text)), f"[\\s{OPEN}{CLOSE}]+")).alias("w")).where("w <> ''").groupBy("w").agg(F.count("*").alias("m"))
    base = rows = materialize(words.select("m", _wrapped(F.col("w")).alias("w")), "wordpiece-words")
    found: list[tuple] = []
    for rank in range(min(n_merges, 1) if compat else n_merges):
        tokens = _wrapped_tokens(rows)
        left, right = (tokens.select(F.col("token").alias(f"{s}_token"), F.col("n").alias(f"n_{s}")) for s in ("left", "right"))
        score = F.col("n") / (F.col("n_left") * F.col("n_right"))
        scored = _wrapped_pairs(rows).join(left, "left_token").join(right, "right_token").select("left_token", "right_token", score.alias("score"))
        top = scored.orderBy(F.col("score").desc(), "left_token", "right_token").first()
        if top is None:
            break
        found.append((rank, top.left_token, top.right_token, top.score))
        rows = rows.withColumn("w", F.replace("w", F.lit(f"{OPEN}{top.left_token}{CLOSE}{OPEN}{top.right_token}{CLOSE}"), F.lit(f"{OPEN}{top.left_token}{top.right_token}{CLOSE}")))
        if rank % cut_every == cut_every - 1:
            before, base = base, materialize(rows, "wordpiece-words")
            rows = base
            discard(before)
    discard(base)
    return texts.sparkSession.createDataFrame(found, "rank int, left_token string, right_token string, score double")


ALGORITHMS = ("bpe", "wordpiece", "unigram", "sentencepiece")


def train(texts: DataFrame, algorithm: str, size: int, min_frequency: int = 2, byte_tokens: bool = True, text: str = "text") -> Vocabulary:
    """A vocabulary of at most ``size`` tokens, special ones included, by one of the four algorithms.

    BPE starts from the frequent characters and byte tokens, WordPiece from all characters, and both add merges; the
    other two take the most frequent substrings. The driver holds the tokens of the vocabulary only.
    """
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm}")
    base = Vocabulary()
    room = max(size - len(base), 0)
    if algorithm in ("unigram", "sentencepiece"):
        counts = (train_unigram if algorithm == "unigram" else train_sentencepiece)(texts, room, text=text)
        return Vocabulary([r.token for r in counts.orderBy(F.col("n").desc(), "token").toLocalIterator()])
    if algorithm == "bpe":
        chars = char_vocabulary(texts, min_frequency, byte_tokens, text).orderBy(F.col("n").desc(), "token").limit(room)
    else:
        chars = char_counts(texts, text).where(~F.col("token").rlike("\\s")).orderBy(F.col("n").desc(), "token").limit(room)
    tokens = [r.token for r in chars.toLocalIterator()]
    learned = (train_bpe if algorithm == "bpe" else train_wordpiece)(texts, max(room - len(tokens), 0), text=text)
    merges = [(r.left_token, r.right_token) for r in learned.orderBy("rank").collect()]
    if algorithm == "bpe":
        return Vocabulary([*tokens, *(a + b for a, b in merges)], merges)
    whole = [*tokens, *(a + b for a, b in merges)]
    return Vocabulary([*whole, *(f"##{t}" for t in whole)], merges)


def train_files(spark: SparkSession, paths: list[str], algorithm: str, size: int, at_most: int | None = None, **options) -> Vocabulary:
    """The same over the lines of text files, of at most a number of lines if one is given."""
    lines_of = spark.read.text(paths).select(F.col("value").alias("text")).where(F.trim("text") != "")
    return train(lines_of if at_most is None else lines_of.limit(at_most), algorithm, size, **options)


def substring_counts(texts: DataFrame, longest: int, text: str = "text") -> DataFrame:
    """Occurrences of every substring of 1 to `longest` characters inside lines."""
    at = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("t") - i + 1)), lambda n: F.array_join(F.slice("t", i, n), ""))
    every = F.flatten(F.transform(F.sequence(F.lit(1), F.size("t")), at))
    # Equal lines are cut up once.
    rows = lines(texts, text).groupBy(text).agg(F.count("*").alias("m"))
    return rows.select("m", _chars(F.col(text)).alias("t")).where(F.size("t") > 0).select("m", F.explode(every).alias("token")).groupBy("token").agg(F.sum("m").alias("n"))


def _by_windows(texts: DataFrame, size: int, longest: int, text: str = "text") -> DataFrame:
    """What ``frequent_substrings`` gives where its candidates are too many: substrings grow level by level. Every place of a line is a window of at most ``longest`` characters, equal windows are one row; at each length only the
    windows whose shorter substring is among the ``size`` most frequent so far go on, as no longer one can be more frequent than what it begins with. So
    the windows thin out quickly, and what is counted and shuffled with them.
    """
    rows = lines(texts, text).groupBy(text).agg(F.count("*").alias("m")).select("m", _chars(F.col(text)).alias("t")).where(F.size("t") > 0)
    window = lambda i: F.array_join(F.slice("t", i, longest), "")
    every = rows.select("m", F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), window)).alias("w"))
    windows = materialize(every.groupBy("w").agg(F.sum("m").alias("m")), "substring-windows")
    found, level = None, None
    try:
        for n in range(1, longest + 1):
            counts = windows.where(F.length("w") >= n).groupBy(F.substring("w", 1, n).alias("token")).agg(F.sum("m").alias("n"))
            both = counts if found is None else found.unionByName(counts)
            old, found = found, materialize(top_k(both, size), "substring-found")
            if old is not None:
                discard(old)
            have, least = found.agg(F.count("*"), F.min("n")).first()
            if not have or n == longest:
                break
            full = have >= size
            kept = windows.where(F.length("w") > n)
            if full:
                level = materialize(counts.where(F.col("n") >= least).select("token"), "substring-level")  # ``size`` rows, and ties
                kept = kept.join(level, F.substring("w", 1, n) == F.col("token"), "left_semi")
            before, windows = windows, materialize(kept, "substring-windows")
            discard(before)
            if level is not None:
                discard(level)
                level = None
    finally:
        discard(windows)
    return found


def frequent_substrings(texts: DataFrame, size: int, longest: int, text: str = "text") -> DataFrame:
    """The ``size`` most frequent substrings of 1 to ``longest`` characters inside lines, ties by the smaller substring: (token, n).

    Three passes over the texts, of which none shuffles them. The most frequent substrings of each chunk, added up, give a count that ``size`` substrings reach at least.
    A substring that reaches it in all texts has its share in some chunk; those are the candidates, and they are counted everywhere. Inside a chunk
    substrings grow letter by letter, and only at places whose shorter substring stayed. Texts of which too many substrings are candidates are counted by windows.
    """
    rows = materialize(texts.select(text).where(F.col(text) != ""), "substring-texts")
    counts_of, chosen = "token string, n long", None
    try:
        tops = materialize(rows.mapInArrow(substrings.local_tops(longest, size), counts_of).groupBy("token").agg(F.sum("n").alias("n")), "substring-tops")
        total = tops.where("token IS NULL").agg(F.sum("n")).first()[0] or 0
        best = top_k(tops.where("token IS NOT NULL"), size).agg(F.count("*").alias("have"), F.min("n").alias("least")).first()
        discard(tops)
        if not total or size <= 0:
            return texts.sparkSession.createDataFrame([], counts_of)
        least = best.least if best.have == size else 1
        chosen = materialize(rows.mapInArrow(substrings.local_candidates(longest, least, total), counts_of).select("token").distinct(), "substring-candidates")
        if chosen.count() > CANDIDATES:
            return _by_windows(rows, size, longest, text)
        by_length: list[list[str]] = [[] for _ in range(longest)]
        for r in chosen.toLocalIterator():
            by_length[len(r.token) - 1].append(r.token)
        shared = texts.sparkSession.sparkContext.broadcast(by_length)
        counts = rows.mapInArrow(substrings.chosen_counts(longest, lambda: shared.value), counts_of).groupBy("token").agg(F.sum("n").alias("n"))
        return materialize(top_k(counts, size), "substring-found")
    finally:
        discard(rows)
        if chosen is not None:
            discard(chosen)


def train_unigram(texts: DataFrame, size: int, longest: int = 10, text: str = "text") -> DataFrame:
    return frequent_substrings(texts, size, longest, text)


def train_sentencepiece(texts: DataFrame, size: int, longest: int = 16, text: str = "text") -> DataFrame:
    marked = texts.select(F.concat(F.lit(WORD_MARK), F.replace(F.col(text), F.lit(" "), F.lit(" " + WORD_MARK))).alias(text))
    return frequent_substrings(marked, size, longest, text)
