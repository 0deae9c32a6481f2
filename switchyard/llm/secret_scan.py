"""Secrets: fixed patterns, and a battery of randomness tests for what no pattern knows.

Kinds of the base contract: assign, access, hex.  The method adds ``random``: every run of 20 or more
characters of [A-Za-z0-9+/_=-] outside the base spans is a candidate.  Its encoding is inferred from the
characters it uses (base 16, 32, 36, 62 or 64), and three tests ask how likely ordinary text would look so random:

* chi-squared uniformity over the alphabet: ordinary text has a non-central statistic that grows with the
  length, so a small one is unlikely (Sankaran's approximation of the lower tail);
* runs of character classes (lower, upper, digit; signs that join words are left out): ordinary words stay in a class, so many runs are unlikely;
* lag-one serial correlation of class changes: ordinary text alternates in long steps, so a correlation
  near zero around many changes is unlikely.

The three tails are combined by Fisher's rule, and candidates of one text pass a Benjamini-Hochberg step
with weights that grow with the length (longer candidates carry more evidence and get a larger share of
the false-discovery level ``Q``).  Only candidates that mix letters with digits are tested.

Defined cases: a null or empty text has no spans; texts are scanned whole, in linear time; an empty table
gives an empty result; repeated rows and other columns are passed over.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from switchyard.llm.spans import Span, find_spans

KINDS = ("assign", "access", "hex", "random")
BASE = 3
ASSIGN, ACCESS, HEX, RANDOM = range(4)

ASSIGNED = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
KEY_ID = re.compile(r"AKIA[A-Z0-9]+")
HEXADECIMAL = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
HINT = re.compile(r"(?ai:passw|secret|token|api_?key)")

#: False-discovery level over the candidates of one text.
Q = 1e-3
#: Chance that two letters of ordinary text agree (index of coincidence of English, a fixed value), and the
#: least excess of the chi-squared statistic per character that it is taken to cause.
COINCIDENCE, LEAST_EXCESS = 0.066, 0.5
#: Mean share of class changes between neighbouring letters and digits of joined words, camel case included.
CHANGES = 0.25
#: Fewer letters and digits than this carry no evidence.
SHORTEST = 16
SIGNS = str.maketrans("", "", "+/_=-")
#: Character classes by set of characters: (alphabet size, allowed characters), smallest first.
ENCODINGS = (
    (16, frozenset("0123456789abcdef")), (16, frozenset("0123456789ABCDEF")),
    (32, frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")), (36, frozenset("abcdefghijklmnopqrstuvwxyz0123456789")),
    (36, frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")),
    (62, frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")),
)


def alphabet(token: str) -> int:
    used = set(token.rstrip("="))
    return next((n for n, allowed in ENCODINGS if used <= allowed), 64)


def normal_tail(z: float) -> float:
    """P(Z >= z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def uniformity(token: str, size: int) -> float:
    """Lower tail of the chi-squared statistic under ordinary (uneven) text."""
    n, counts = len(token), Counter(token)
    statistic = sum(c * c for c in counts.values()) * size / n - n
    k, extra = size - 1, max(LEAST_EXCESS, size * COINCIDENCE - 1) * n
    mean = k + extra
    h = 1 - 2 * mean * (k + 3 * extra) / (3 * (k + 2 * extra) ** 2)
    p, m = (k + 2 * extra) / mean**2, (h - 1) * (1 - 3 * h)
    spread = h * math.sqrt(2 * p) * (1 + m * p / 2)
    z = ((max(statistic, 0.0) / mean) ** h - 1 - h * p * (h - 1 - (2 - h) * m * p / 2)) / spread
    return normal_tail(-z)


def changes(token: str) -> list[int]:
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" for c in token]
    return [int(a != b) for a, b in zip(kinds, kinds[1:])]


def many_runs(changed: list[int]) -> float:
    """Upper tail of the number of class changes under ordinary text."""
    n = len(changed)
    return normal_tail((sum(changed) - CHANGES * n - 0.5) / math.sqrt(n * CHANGES * (1 - CHANGES)))


def unordered(changed: list[int]) -> float:
    """Upper tail of neighbouring changes: ordinary words change class alone, random strings also in a row."""
    pairs = sum(a & b for a, b in zip(changed, changed[1:]))
    n, p = len(changed) - 1, CHANGES * CHANGES
    return normal_tail((pairs - p * n - 0.5) / math.sqrt(n * p * (1 - p)))


def fisher(tails: list[float]) -> float:
    """Combined tail of three tests: chi-squared with six degrees of freedom."""
    x = -sum(math.log(max(t, 1e-300)) for t in tails)
    return math.exp(-x) * (1 + x + x * x / 2)


def randomness(token: str) -> float:
    """How likely ordinary text would look so random; small for secrets."""
    letters = token.translate(SIGNS)
    if len(letters) < SHORTEST:
        return 1.0
    changed = changes(letters)
    return fisher([uniformity(letters, alphabet(token)), many_runs(changed), unordered(changed)])


def discoveries(tails: list[float], lengths: list[int], level: float = Q) -> list[int]:
    """Weighted Benjamini-Hochberg: indexes of the tails that pass at ``level``."""
    mean = sum(lengths) / len(lengths) if lengths else 1
    ranked = sorted((t * mean / n, i) for i, (t, n) in enumerate(zip(tails, lengths)))
    last = max((r for r, (t, _) in enumerate(ranked, 1) if t <= level * r / len(ranked)), default=0)
    return sorted(i for _, i in ranked[:last])


def base_spans(text: str) -> list[Span]:
    out = []
    if HINT.search(text):
        out += [(m.start(), ASSIGN, m.end()) for m in ASSIGNED.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), ACCESS, m.end()) for m in KEY_ID.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), HEX, m.end()) for m in HEXADECIMAL.finditer(text)]


def mixed(token: str) -> bool:
    """Letters and digits, and not a path or a joined list of words."""
    return any(c.isdigit() for c in token) and any(c.isalpha() for c in token)


def find(text: str) -> list[Span]:
    base = base_spans(text)
    free = [m for m in CANDIDATE.finditer(text) if mixed(m[0])]
    if not free:
        return base
    taken = bytearray(len(text))
    for a, _, b in base:
        taken[a:b] = b"\1" * (b - a)
    free = [m for m in free if not any(taken[m.start() : m.end()])]
    passed = discoveries([randomness(m[0]) for m in free], [len(m[0]) for m in free])
    return base + [(free[i].start(), RANDOM, free[i].end()) for i in passed]


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", detail: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (and the found values with ``detail``)."""
    return find_spans(docs, find, KINDS, BASE, doc_id, text, detail)
