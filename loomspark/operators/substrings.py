"""Counts of short strings inside lines by arrays of code points: a task counts its texts a chunk at a time, and Spark adds up the chunks' counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa

CHUNK = 1 << 22  # characters counted together
LINE_END = 10
COUNTS = pa.schema([("token", pa.string()), ("n", pa.int64())])
PAIRS = pa.schema([("left_token", pa.string()), ("right_token", pa.string()), ("n", pa.int64())])

#: (found keys, their counts, strings so far, letters) -> which of the found stay. A key is the place of a string's beginning among the strings so far, times the letters, plus its last letter.
Keep = Callable[[np.ndarray, np.ndarray, list[str], list[str]], np.ndarray]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    """The texts of the first column, joined by line ends to chunks of about ``CHUNK`` characters."""
    held, n = [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                held.append(text)
                n += len(text)
                if n >= CHUNK:
                    yield "\n".join(held)
                    held, n = [], 0
    if held:
        yield "\n".join(held)


def letters(chunk: str) -> tuple[np.ndarray, list[str], int]:
    """The letter at each place by its number, -1 at line ends; the letters; and how many places hold one."""
    codes = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
    seen = np.bincount(codes, minlength=LINE_END + 1)
    seen[LINE_END] = 0
    there = np.flatnonzero(seen)
    number = np.full(len(seen), -1, np.int32)
    number[there] = np.arange(len(there), dtype=np.int32)
    return number[codes], [chr(c) for c in there], int(seen.sum())


def counted(keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys that occur, ascending, and how often."""
    if width <= 4 * len(keys) + 65536:
        every = np.bincount(keys, minlength=1)
        found = np.flatnonzero(every)
        return found, every[found]
    return np.unique(keys, return_counts=True)


def grown(at_place: np.ndarray, alphabet: list[str], longest: int, keep: Keep) -> Iterator[tuple[list[str], np.ndarray]]:
    """(strings, counts) of each length that ``keep`` leaves; only places whose shorter string stayed are looked at again."""
    width = len(alphabet)
    at = np.flatnonzero(at_place >= 0)
    keys = at_place[at].astype(np.int64)
    names, size = [""], width
    for n in range(1, longest + 1):
        found, counts = counted(keys, size)
        stay = keep(found, counts, names, alphabet)
        found, counts = found[stay], counts[stay]
        names = [names[k // width] + alphabet[k % width] for k in found.tolist()]
        yield names, counts
        if not names or n == longest:
            return
        group = np.searchsorted(found, keys) if size > 4 * len(keys) + 65536 else _numbered(found, size)[keys]
        group = np.minimum(group, len(found) - 1)
        on = (group >= 0) & (found[group] == keys) & (at + n < len(at_place))
        at, group = at[on], group[on]
        following = at_place[at + n]
        on = following >= 0
        at, size = at[on], len(names) * width
        keys = group[on].astype(np.int64) * width + following[on]
        if not len(at):
            return


def _numbered(found: np.ndarray, size: int) -> np.ndarray:
    number = np.full(size, -1, np.int32)
    number[found] = np.arange(len(found), dtype=np.int32)
    return number


def local_tops(longest: int, size: int):
    """Of each chunk its own ``size`` most frequent strings, and under a null string its places."""

    def keep() -> Keep:
        best = np.zeros(0, np.int64)

        def stay(found, counts, names, alphabet):
            nonlocal best
            both = np.concatenate([best, counts])
            best = np.partition(both, len(both) - size)[-size:] if len(both) > size else both
            return counts >= (best.min() if len(best) == size else 0)

        return stay

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            places, alphabet, n = letters(chunk)
            tokens: list[str | None] = []
            counts: list[int] = []
            for names, some in grown(places, alphabet, longest, keep()):
                tokens += names
                counts += some.tolist()
            if len(tokens) > size:
                best = np.argsort(-np.array(counts), kind="stable")[:size].tolist()
                tokens, counts = [tokens[i] for i in best], [counts[i] for i in best]
            yield pa.RecordBatch.from_arrays([pa.array([*tokens, None], pa.string()), pa.array([*counts, n], pa.int64())], schema=COUNTS)

    return run


def local_candidates(longest: int, least: int, total: int):
    """Of each chunk the strings whose share of its places is at least least / total: a string of that share in all texts has it in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[str] = set()
        for chunk in chunks(batches):
            places, alphabet, n = letters(chunk)
            low = -(-least * n // total)
            for names, _ in grown(places, alphabet, longest, lambda found, counts, *_, low=low: counts >= low):
                new = [x for x in names if x not in sent]
                if len(sent) < 1 << 20:  # only saves rows
                    sent.update(new)
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()), pa.array([0] * len(new), pa.int64())], schema=COUNTS)

    return run


def chosen_counts(longest: int, by_length: Callable[[], Sequence[list[str]]]):
    """The occurrences of chosen strings in each chunk, given by their length; what a chosen string begins with is chosen too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = by_length()

        def keep() -> Keep:
            level = iter(chosen)

            def stay(found, counts, names, alphabet):
                index, number = {x: i for i, x in enumerate(names)}, {x: i for i, x in enumerate(alphabet)}
                keys = [index[x[:-1]] * len(alphabet) + number[x[-1]] for x in next(level) if x[:-1] in index and x[-1] in number]
                return np.isin(found, np.array(keys, np.int64))

            return stay

        for chunk in chunks(batches):
            places, alphabet, _ = letters(chunk)
            for names, counts in grown(places, alphabet, longest, keep()):
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], schema=COUNTS)

    return run


def chunk_pairs(chunk: str) -> tuple[list[str], list[str], np.ndarray]:
    """Left and right letter of each pair of neighbours inside a line, and how often they occur."""
    places, alphabet, _ = letters(chunk)
    width = len(alphabet)
    left, right = places[:-1], places[1:]
    inside = (left >= 0) & (right >= 0)
    found, counts = counted(left[inside].astype(np.int64) * width + right[inside], width * width)
    return [alphabet[k // width] for k in found.tolist()], [alphabet[k % width] for k in found.tolist()], counts


def local_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        left, right, n = chunk_pairs(chunk)
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string()), pa.array(n, pa.int64())], schema=PAIRS)


def merged(chunk: str, merges: Sequence[tuple[str, str]]) -> str:
    """A text in which every token is one character, after merges of two characters to one, each from left to right."""
    for pair, one in merges:
        chunk = chunk.replace(pair, one)
    return chunk


def merge_changes(done: Sequence[tuple[str, str]], new: Sequence[tuple[str, str]], names: dict[str, str]):
    """What new merges change in the counts of pairs after those that are done: lines that they leave alone are not counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            before = merged(chunk, done)
            after = merged(before, new)
            if len(after) == len(before):
                continue
            lines = [(x, y) for x, y in zip(before.split("\n"), after.split("\n"), strict=True) if len(x) != len(y)]
            for side, sign in ((0, -1), (1, 1)):
                left, right, n = chunk_pairs("\n".join(x[side] for x in lines))
                named = [pa.array([names.get(t, t) for t in ts], pa.string()) for ts in (left, right)]
                yield pa.RecordBatch.from_arrays([*named, pa.array(n * sign, pa.int64())], schema=PAIRS)

    return run


def apply_merges(merges: Sequence[tuple[str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([merged(t or "", merges) for t in batch.column(0).to_pylist()], pa.string())], names=batch.schema.names)

    return run
