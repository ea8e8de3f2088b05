"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

Base kinds, leftmost and without overlap within a kind: ``assign`` (a credential's name, : or =, a value of 6
characters or more), ``access`` (access key ids) and ``hex`` (long hexadecimal runs).  The method adds the
kind ``guess``: the value behind a credential's name, or behind the further names below, whose cheapest
segmentation into words, dates, repeats, keyboard walks and brute-force spans still costs ``MIN_COST`` guesses
(as a power of ten) or more.  The value goes to the next white space, quote, bracket, comma or semicolon, past where
``assign`` ends, and a scheme's word before it (``Bearer``, ``Basic``, ...) is passed over; where the whole costs less,
the value of ``assign`` alone may still be a guess.  Behind ``bearer`` without a sign, values with a digit or of 20
characters count.  Placeholders and weak passwords cost less and add no span.

Null text counts as empty and has no spans; repeated rows give repeated results, an empty table none.  Whole
texts are scanned, in time proportional to their length.  Words and their ranks are those of ``WORDS`` and of a public
tokenizer's vocabulary, whose path is a parameter.
"""

from __future__ import annotations

import functools
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from strandmill.llm.common import id_text, rows, tune

KINDS = ("assign", "access", "hex", "guess")
#: Names that open a credential's context; (?a) keeps case folding to ASCII letters.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
CONTEXT = re.compile(
    r"""(?ai)(?:(?:passwd|password|passphrase|passcode|pwd|secret|token|api[_-]?key|credential|private[_-]?key|access[_-]?key|authorization|bearer)s?["']?\x20*(?:[:=]|\bis\b|bearer)\x20*["']?(?:(?:bearer|basic|digest|negotiate|token|apikey)\x20+["']?)?"""
    r"""|\bbearer\x20+["']?(?=[^\s"'<>,;]{0,64}[0-9]|[^\s"'<>,;]{20}))(?!(?:bearer|basic|digest|negotiate|token|apikey)(?![^\s"'<>,;]))([^\s"'<>,;]{6,})"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without any of these, in lower case, has no credential's context.
HINTS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "private", "access", "authoriz", "bearer")
#: Guesses, as a power of ten, from which a value counts as a secret.
MIN_COST = 10.0
#: Where further words come from.
DICTIONARY = "word_bpe_49k.json"

#: Words that guesses of passwords start with, the likeliest first.
WORDS = (
    "password", "admin", "letmein", "welcome", "monkey", "dragon", "master", "login", "princess", "football", "baseball", "shadow",
    "sunshine", "iloveyou", "superman", "secret", "changeme", "default", "example", "test", "guest", "root", "user", "pass", "hello",
    "freedom", "whatever", "trustno", "batman", "michael", "jordan", "hunter", "ranger", "charlie", "summer", "winter", "spring", "autumn",
    "love", "god", "money", "your", "here", "none", "null", "true", "false", "token", "key", "api", "value", "placeholder", "string", "demo",
    "sample", "dummy", "temp", "qwerty", "abc", "the", "and", "this", "that", "with", "for", "not", "please", "insert", "my", "is",
)
#: Rows of a keyboard.
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
KNOWN = {w: i + 1 for i, w in enumerate(WORDS)}
#: Letters of the longest word looked for.
LONGEST = 24
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.ASCII)
PLACE = {c: (x, y) for y, row in enumerate(KEYBOARD) for x, c in enumerate(row)}


def _near(a: str, b: str) -> bool:
    if a not in PLACE or b not in PLACE or a == b:
        return False
    (x, y), (u, v) = PLACE[a], PLACE[b]
    return abs(x - u) <= 1 and abs(y - v) <= 1


def _step(keys: str, k: int) -> tuple[int, int]:
    """From the key before the k-th to the k-th."""
    (x, y), (u, v) = PLACE[keys[k - 1]], PLACE[keys[k]]
    return u - x, v - y


def _alphabet(value: str) -> int:
    """Symbols that a brute-force search of the value's characters has to try."""
    if re.fullmatch(r"[0-9]+", value):
        return 10
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 16
    return max(2, sum(n for n, c in ((26, r"[a-z]"), (26, r"[A-Z]"), (10, r"[0-9]"), (33, r"[!-/:-@\[-`{-~]"), (100, r"[^\x00-\x7f]")) if re.search(c, value)))


@functools.lru_cache(maxsize=2)
def dictionary(path: str) -> dict[str, int]:
    """word -> rank: ``WORDS``, then the whole words of a public tokenizer's vocabulary, in its order, which is that of frequency."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    words = (t[:-4] for t in sorted(vocabulary, key=vocabulary.get) if t.endswith("</w>"))
    common = [w for w in words if 3 <= len(w) <= LONGEST and w.isascii() and w.isalpha() and w not in KNOWN]
    return KNOWN | {w: len(KNOWN) + i + 1 for i, w in enumerate(common)}


class Starts:
    """Starts i of a segment whose cost is v + log10(length), as far as one may yet be the cheapest.

    Of two, the later has the shorter segment; so it goes once it costs no less, and the earlier goes at once where its v
    is no less.  What is left is short: its v rise with i, by less than the logarithm of the length in all.
    """

    def __init__(self):
        self.kept: list[tuple[int, float]] = []

    def add(self, i: int, v: float) -> None:
        while self.kept and self.kept[-1][1] >= v:
            self.kept.pop()
        self.kept.append((i, v))

    def least(self, j: int) -> float:
        best, kept = math.inf, []
        for i, v in self.kept:
            cost = v + math.log10(j - i)
            if cost < best:
                best = cost
                kept.append((i, v))
        self.kept = kept
        return best


def guess_cost(value: str, rank: dict[str, int] = KNOWN) -> float:
    """Guesses, as a power of ten, of the cheapest segmentation; 0 for an empty value.

    best[j] is the least cost of the first j characters, over all last segments; each segment after the first
    doubles the guesses, as where it starts has to be guessed too.  Segments: one character by brute force; a word
    of the dictionary; a date; three or more times one character; a walk of four or more neighbouring keys, dearer with
    each turn.  Repeats and walks may start anywhere in their run.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # a capital whose lower case is two characters
        low = value
    each, extra, turn_cost = math.log10(_alphabet(value)) if value else 0.0, math.log10(2), math.log10(4)
    best = [0.0] + [math.inf] * n
    spans: dict[int, list[tuple[int, float]]] = {}  # by end: start, cost
    for i in range(n):
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            if r := rank.get(low[i:j]):
                spans.setdefault(j, []).append((i, math.log10(2 * r) + (0.3 if value[i:j] != low[i:j] else 0)))
        if (m := DATE.match(value, i)) is not None:
            spans.setdefault(m.end(), []).append((i, math.log10(365 * 130) if m.end() - i > 4 else math.log10(130)))
    same = walk = 0  # where the runs that reach here start
    repeats, walks = Starts(), Starts()
    turns = [0, 0]  # turns[k]: before the k-th character, of this and earlier runs
    for j in range(1, n + 1):
        if j > 1 and value[j - 1] != value[j - 2]:
            same, repeats = j - 1, Starts()
        if j > 1 and not _near(low[j - 2], low[j - 1]):
            walk, walks = j - 1, Starts()
        turns.append(turns[-1] + (j - walk > 2 and _step(low, j - 1) != _step(low, j - 2)))
        options = [best[j - 1] + each]
        if (i := j - 3) >= same:
            repeats.add(i, best[i])
            options.append(repeats.least(j) + each + extra)
        if (i := j - 4) >= walk:
            walks.add(i, best[i] - turns[i + 3] * turn_cost)
            options.append(walks.least(j) + math.log10(len(PLACE)) + turns[j + 1] * turn_cost + extra)
        options += [best[i] + cost + extra for i, cost in spans.get(j, ())]
        best[j] = min(options)
    return best[n]


def find_secrets(text: str, min_cost: float = MIN_COST, rank: dict[str, int] = KNOWN) -> list[tuple[int, int, int]]:
    """(start, kind as in KINDS, end) of all spans, in order."""
    out: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        base, alone = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6], []
        i = 0
        for m in CONTEXT.finditer(text):
            inside = []
            while i < len(base) and base[i][0] < m.end(1):
                if base[i][1] > m.start(1):
                    inside.append(base[i])
                elif base[i][0] < m.start():  # else it is the scheme's word
                    alone.append(base[i])
                i += 1
            a, b = m.span(1)
            if guess_cost(text[a:b], rank) >= min_cost:
                out.append((a, 3, b))
            else:  # a cheaper end can make the whole cheaper than the base span's value
                alone += [x for x in inside if x != (a, b)]
        out += [(a, 3, b) for a, b in alone + base[i:] if guess_cost(text[a:b], rank) >= min_cost]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def written(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, *, min_cost: float = MIN_COST, words: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans (kind:start:end, comma-joined, end exclusive)."""
    tune(docs.sparkSession)
    words = words or public_tokenizers.path(DICTIONARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            found = [find_secrets(t, min_cost, dictionary(words)) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in f) for f in found], pa.int64()) for i in range(4)]
            base = [hashlib.sha256(written([x for x in f if x[1] < 3], KINDS).encode()).hexdigest() for f in found]
            yield pa.record_batch([b.column(0), *counts, pa.array(base, pa.string()), pa.array([written(f, KINDS) for f in found], pa.string())], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans"]
    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")
