"""Personal data and credentials: fixed patterns, and a linear-chain conditional random field for the rest.

The base finds email addresses, IP addresses, card numbers and phone numbers by fixed patterns. The
field labels tokens around suspicious ones (those with digits, ``@``, ``=`` or a bracketed at/dot) in
BIO form by word-shape features of a token and its neighbours, and adds what patterns miss: credentials,
spelled-out addresses, phone numbers without a country code, and dashed identity numbers. It is trained
by gradient ascent on a small labelled table that a rule writes out (``labelled_table``), and windows
are decoded by Viterbi in numpy batches. A span that overlaps a base span is dropped; base spans stay.

Offsets are code points, end exclusive.

Limits of the features, none of them of the search: a place sees ``CONTEXT`` tokens on each side, those before it within
``REACH`` characters each; the shape of a token is that of its first ``SHAPED`` characters. Every token of
every text is looked at, whatever its length, and scanning takes time in proportion to the text.

Edge cases: null text is empty and has no spans; digits and letters are ASCII in the patterns; a doc
without any suspicious token costs one scan; repeated rows, null ids and extra columns pass through.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "identity", "secret")
BASE_KINDS = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where its run of digits does, so long runs are passed over once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NON_DIGIT = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Pattern matches in the order of kinds, then start; leftmost and non-overlapping within a kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NON_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NON_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# ---- the random field -------------------------------------------------------------------------

LABELS = ("O", *(f"{p}-{k}" for k in ("email", "phone", "identity", "secret") for p in "BI"))
N_FEATURES = 1 << 12
PER_TOKEN = 8
EPOCHS = 120
RATE = 0.15
PENALTY = 1e-3
CONTEXT = 4
REACH = 200
SHAPED = 64
SUSPICIOUS = re.compile(r"[0-9@=]|[(\[](?:at|dot)[)\]]")
TOKEN = re.compile(r"\S+")
KEY_WORDS = frozenset("password passwd pwd secret token api_key apikey key credential auth bearer".split())
CALL_WORDS = frozenset("call phone tel telephone mobile fax dial ring".split())
ID_WORDS = frozenset("ssn social identity passport id number".split())


def _bucket(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % (N_FEATURES - 1) + 1


def shape(token: str) -> str:
    """Letters and digits by class, with run lengths up to 4."""
    out, last, run = [], "", 0
    for c in token[:SHAPED]:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        run = run + 1 if k == last else 1
        if run <= 4:
            out.append(k)
        last = k
    return "".join(out)


def token_features(token: str) -> tuple[int, ...]:
    return _features(token) if len(token) > SHAPED else _cached_features(token)


def _features(token: str) -> tuple[int, ...]:
    core = token.strip(".,;:!?\"'()[]")
    low = core.lower()
    s = shape(core)
    bare = re.sub(r"(.)\1+", r"\1", s)
    mixed = bool(re.fullmatch(r"[A-Za-z0-9+/=_-]{16,}", core)) and any(c.isdigit() for c in core) and any(c.isalpha() for c in core)
    value = low.partition("=")
    names = [
        "shape:" + s[:12],
        "bare:" + bare[:8],
        f"mixed:{mixed}",
        f"hex:{bool(re.fullmatch(r'[0-9a-f]{16,}', low)) and not low.isdigit()}",
        f"assign:{value[0] in KEY_WORDS and len(value[2]) >= 8}",
        "word:" + (low if low in KEY_WORDS | CALL_WORDS | ID_WORDS or token in ("=", ":", "(at)", "[at]", "(dot)", "[dot]") else "-"),
        f"length:{min(len(core) // 4, 8)}",
        f"digits:{min(sum(c.isdigit() for c in core), 12)}",
    ]
    return tuple(_bucket(n) for n in names)


_cached_features = lru_cache(maxsize=100_000)(_features)


def encode(tokens: list[str]) -> np.ndarray:
    """Feature ids (token, PER_TOKEN)."""
    return np.array([token_features(t) for t in tokens], np.int32).reshape(len(tokens), PER_TOKEN)


class Field:
    """Weights of a chain: emissions by features of the token before, at and after a place, and transitions."""

    def __init__(self) -> None:
        n = len(LABELS)
        self.emit = np.zeros((3, N_FEATURES, n))
        self.move = np.zeros((n + 1, n))  # the last row starts a chain

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """(batch, time, label) emissions of padded ids (batch, time, PER_TOKEN); id 0 is padding."""
        out = self.emit[1][ids].sum(2)
        out[:, 1:] += self.emit[0][ids[:, :-1]].sum(2)
        out[:, :-1] += self.emit[2][ids[:, 1:]].sum(2)
        return out

    def decode(self, ids: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Viterbi over a padded batch."""
        e = self.scores(ids)
        size, steps, n = e.shape
        best = e[:, 0] + self.move[n]
        back = np.zeros((size, steps, n), np.int8)
        for t in range(1, steps):
            via = best[:, :, None] + self.move[None, :n]
            back[:, t] = via.argmax(1)
            best = np.where((t < length)[:, None], via.max(1) + e[:, t], best)
        path = np.zeros((size, steps), np.int8)
        now = best.argmax(1)
        for t in range(steps - 1, -1, -1):
            live = t < length
            path[live, t] = now[live]
            now = np.where(live & (t > 0), back[np.arange(size), t, now], now)
        return path


def pad(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), int(length.max()), *rows[0].shape[1:]), rows[0].dtype)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out, length


def train_field(table: list[tuple[list[str], list[str]]]) -> Field:
    """Maximum likelihood by forward-backward and gradient ascent with per-weight rates."""
    field, n = Field(), len(LABELS)
    ids, length = pad([encode(t) for t, _ in table])
    gold, _ = pad([np.array([LABELS.index(x) for x in tags], np.int64) for _, tags in table])
    size, steps = gold.shape
    mask = np.arange(steps)[None] < length[:, None]
    one = np.eye(n)
    # The table has few different tokens and features: counts of these make a small matrix, and scores and gradients products with it.
    kinds, kind = np.unique(ids[mask], axis=0, return_inverse=True)
    used = np.unique(kinds)
    counts = np.zeros((len(kinds), len(used)))
    np.add.at(counts, (np.arange(len(kinds))[:, None], np.searchsorted(used, kinds)), 1)
    by_kind = np.argsort(kind, kind="stable")
    starts = np.searchsorted(kind[by_kind], np.arange(len(kinds)))
    part, around = np.zeros((size, steps, 3 * n)), np.zeros((size, steps, 3, n))
    weights = {"emit": np.zeros((3, len(used), n)), "move": field.move}
    grads = {k: np.zeros_like(v) for k, v in weights.items()}
    seen = {k: np.full_like(v, 1e-8) for k, v in grads.items()}
    for _ in range(EPOCHS):
        part[mask] = (counts @ weights["emit"].transpose(1, 0, 2).reshape(len(used), 3 * n))[kind]
        e = part[:, :, n : 2 * n].copy()
        e[:, 1:] += part[:, :-1, :n]
        e[:, :-1] += part[:, 1:, 2 * n :]
        # Forward and backward sums, scaled to 1 at each place.
        move, local = np.exp(field.move[:n]), np.exp(e - e.max(2, keepdims=True))
        alpha, beta, scale = np.empty((size, steps, n)), np.ones((size, steps, n)), np.ones((size, steps))
        for t in range(steps):
            step = local[:, 0] * np.exp(field.move[n]) if t == 0 else (alpha[:, t - 1] @ move) * local[:, t]
            scale[:, t] = step.sum(1)
            alpha[:, t] = step / scale[:, t, None] if t == 0 else np.where(mask[:, t, None], step / scale[:, t, None], alpha[:, t - 1])
        for t in range(steps - 2, -1, -1):
            step = ((local[:, t + 1] * beta[:, t + 1] / scale[:, t + 1, None]) @ move.T)
            beta[:, t] = np.where(mask[:, t + 1, None], step, 1.0)
        node = alpha * beta * mask[:, :, None]
        want = one[gold] * mask[:, :, None]
        gap = want - node
        around[:, :-1, 0], around[:, :, 1], around[:, 1:, 2] = gap[:, 1:], gap, gap[:, :-1]
        pulled = counts.T @ np.add.reduceat(around[mask].reshape(-1, 3 * n)[by_kind], starts)
        grads["emit"][:] = pulled.reshape(len(used), 3, n).transpose(1, 0, 2)
        m = grads["move"]
        m[n] = gap[:, 0].sum(0)
        m[:n] = 0
        for t in range(1, steps):
            live = mask[:, t]
            edge = (alpha[live, t - 1].T @ (local[live, t] * beta[live, t] / scale[live, t, None])) * move
            m[:n] += want[live, t - 1].T @ want[live, t] - edge
        for name, grad in grads.items():
            w = weights[name]
            grad -= PENALTY * w
            seen[name] += grad * grad
            w += RATE * grad / np.sqrt(seen[name])
    field.emit[:, used] = weights["emit"]
    return field


def labelled_table(rows: int = 60, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The training table: sentences of filler words with one entity or one harmless number each."""
    rng = np.random.default_rng(seed)
    syllables = "an be ca do en fu ga he in jo ka le mo na or pe qua re st tu un ve wi xa yo za".split()
    word = lambda: "".join(rng.choice(syllables, int(rng.integers(1, 4))))
    number = lambda n: "".join(str(int(x)) for x in rng.integers(0, 10, n))
    text = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    hexa = lambda n: text("0123456789abcdef", n)
    base64 = lambda n: text("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", n)
    upper = lambda n: text("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", n)
    pick = lambda xs: str(rng.choice(sorted(xs)))
    makers = [
        lambda: (["AKIA" + upper(16)], "secret", 0),
        lambda: ([f"{pick(['password', 'passwd', 'pwd', 'secret'])}={hexa(int(rng.integers(12, 33)))}"], "secret", 0),
        lambda: ([pick(["token", "secret", "key", "api_key"]), "=", f'"{hexa(int(rng.integers(24, 65)))}"'], "secret", 2),
        lambda: ([pick(["token", "bearer", "key"]), base64(int(rng.integers(24, 41)))], "secret", 1),
        lambda: ([f"{pick(['api_key', 'token', 'auth'])}={base64(int(rng.integers(20, 41)))}"], "secret", 0),
        lambda: ([word(), pick(["(at)", "[at]"]), word(), pick(["(dot)", "[dot]"]), pick(["com", "org", "net"])], "email", 0),
        lambda: ([pick(CALL_WORDS), f"{number(3)}-{number(3)}-{number(4)}"], "phone", 1),
        lambda: ([f"({number(3)})", f"{number(3)}-{number(4)}"], "phone", 0),
        lambda: ([pick(CALL_WORDS), f"{number(3)}.{number(3)}.{number(4)}"], "phone", 1),
        lambda: ([pick(["ssn", "identity", "social"]), f"{number(3)}-{number(2)}-{number(4)}"], "identity", 1),
        lambda: ([f"{number(3)}-{number(2)}-{number(4)}"], "identity", 0),
    ]
    harmless = [
        lambda: [number(int(rng.integers(1, 6))) + pick([".", ",", ""])],
        lambda: [f"{number(1)}.{number(1)}."], lambda: ["version", number(1) + "."], lambda: [f"{number(4)}-{number(2)}-{number(2)}"],
        lambda: [f"{number(2)}.{number(3)}.{number(2)}.{number(3)}"], lambda: [number(16)], lambda: [" ".join(number(4) for _ in range(4))],
        lambda: [f"{word()}.{number(2)}@{word()}{number(1)}.example.com"], lambda: ["+" + number(1), f"({number(3)})", f"{number(3)}-{number(4)}"],
        lambda: [f"{number(1)},{number(3)}.{number(2)}"], lambda: [word() + number(2)], lambda: [f"{word()}={word()}"], lambda: [word().upper() + "-" + number(4)],
        lambda: [f"{number(2)}:{number(2)}"], lambda: [f"{number(2)}%"], lambda: [pick(KEY_WORDS), "=", word()], lambda: [word(), pick(KEY_WORDS), word()], lambda: [pick(CALL_WORDS), word()], lambda: [f"{number(4)}-{number(4)}-{number(4)}-{number(4)}"],
    ]
    table = []
    for _ in range(rows):
        for make in makers:
            before, after = ([word() for _ in range(int(rng.integers(0, CONTEXT + 1)))] for _ in range(2))
            tokens, kind, start = make()
            tags = ["O"] * start + [f"B-{kind}"] + [f"I-{kind}"] * (len(tokens) - start - 1)
            table.append(([*before, *tokens, *after], ["O"] * len(before) + tags + ["O"] * len(after)))
        for make in harmless:
            tokens = [w for x in make() for w in x.split()]
            before, after = ([word().capitalize() if rng.random() < 0.2 else word() for _ in range(int(rng.integers(0, CONTEXT + 1)))] for _ in range(2))
            table.append(([*before, *tokens, *after], ["O"] * (len(before) + len(tokens) + len(after))))
    return table


def _token_before(text: str, end: int, least: int) -> tuple[int, int] | None:
    """The token that ends before ``end``, not before ``least``; cut where it is longer than REACH."""
    low = max(least, end - REACH)
    while end > low and text[end - 1].isspace():
        end -= 1
    start, low = end, max(least, end - REACH)
    while start > low and not text[start - 1].isspace():
        start -= 1
    return (start, end) if start < end else None


def windows(text: str) -> list[list[tuple[int, int]]]:
    """Token offsets of the stretches around suspicious tokens: each with CONTEXT tokens on both sides, stretches that touch in one."""
    out: list[list[tuple[int, int]]] = []
    end = 0  # of the last stretch
    hint = SUSPICIOUS.search(text)
    while hint:
        if hint.start() < end:
            place = next(i for i in range(len(out[-1]) - 1, -1, -1) if out[-1][i][0] <= hint.start())
        else:
            start = hint.start()
            while start > end and not text[start - 1].isspace():
                start -= 1
            before: list[tuple[int, int]] = []
            while len(before) < CONTEXT and (t := _token_before(text, before[-1][0] if before else start, end)):
                before.append(t)
            if not out or text[end : before[-1][0] if before else start].strip():
                out.append([])
            out[-1] += [*reversed(before), TOKEN.match(text, start).span()]
            place = len(out[-1]) - 1
        token_end = out[-1][place][1]
        while len(out[-1]) <= place + CONTEXT and (t := TOKEN.search(text, out[-1][-1][1])):
            out[-1].append(t.span())
        end = out[-1][-1][1]
        hint = SUSPICIOUS.search(text, token_end)
    return out


BATCH = 2048


def field_spans(texts: list[str], field: Field) -> list[list[Span]]:
    """Spans that the field finds in each text."""
    found: list[list[Span]] = [[] for _ in texts]
    jobs = [(i, w) for i, t in enumerate(texts) for w in windows(t)]
    jobs.sort(key=lambda j: len(j[1]))
    for k in range(0, len(jobs), BATCH):
        part = jobs[k : k + BATCH]
        ids, length = pad([encode([texts[i][a:b] for a, b in w]) for i, w in part])
        for (i, w), path in zip(part, field.decode(ids, length), strict=True):
            open_kind, start, end = "", 0, 0
            for (a, b), label in zip([*w, (0, 0)], [*path[: len(w)], 0], strict=True):
                name = LABELS[label]
                if open_kind and name != f"I-{open_kind}":
                    found[i].append((open_kind, start, end))
                    open_kind = ""
                if name[0] == "B" or name[0] == "I" and not open_kind:
                    open_kind, start = name[2:], a
                end = b
    return found


def _trim(text: str, span: Span) -> Span:
    kind, a, b = span
    while b > a and text[b - 1] in ".,;:!?\"'":
        b -= 1
    while a < b and text[a] in "\"'":
        a += 1
    return kind, a, b


def find(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, each by kind and start."""
    out = []
    for text, extra in zip(texts, field_spans(texts, field), strict=True):
        base = base_spans(text)
        taken = sorted((a, b) for _, a, b in base)
        added = []
        for span in (_trim(text, s) for s in extra):
            if span[1] < span[2] and not any(a < span[2] and span[1] < b for a, b in taken):
                added.append(span)
        order = lambda s: (KINDS.index(s[0]), s[1])
        out.append((base, sorted([*base, *added], key=order)))
    return out


def _finder(field: Field):
    schema = pa.schema([("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("has_any", pa.bool_())])
    name = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find([t or "" for t in batch.column(1).to_pylist()], field)
            cols = [[sum(s[0] == k for s in base) for base, _ in found] for k in BASE_KINDS]
            cols += [[hashlib.sha256(name(base).encode()).hexdigest() for base, _ in found], [name(every) for _, every in found], [len(every) - len(base) for base, every in found], [bool(every) for _, every in found]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)]], names=["doc_id", *schema.names])

    return run


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train_field(labelled_table())


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """A row per document: counts and digest of the base spans, all spans as kind:start:end, how many the field added, and whether there is any."""
    kind = dict(docs.dtypes)["doc_id"]
    weights = docs.sparkSession.sparkContext.broadcast(field or default_field())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _finder(weights.value)(batches)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, has_any boolean")
