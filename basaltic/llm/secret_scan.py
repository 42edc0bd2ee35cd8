"""Secrets in texts: fixed patterns, and credential values that would take many guesses.

The base kinds are assignments (``assign``), access keys (``access``) and hexadecimal runs
(``hex``). The method adds ``guess`` spans: a value in credential context (after a credential
word and a separator, in ``login as user/value``, or between user and host of a URL) is cut
into words, dates, repeats, sequences, keyboard walks and brute-force stretches so that the
product of their guess counts is smallest, by dynamic programming over its ends; a value whose
cheapest cut still costs ``GUESSES_LOG10`` (``LETTERS_LOG10`` if it is letters only) is a
secret. Its span may overlap base spans, which stay whatever their values cost. Words are those
of a public vocabulary file, by their rank there, after a short list of common passwords.

Spans are in code points, end exclusive; texts and values are taken whole, whatever their
length. Cases: a null or empty text has no span; repeated rows have equal results; an empty
table gives an empty result; other columns are ignored by ``scan`` and carried by ``redact``.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from basaltic.llm.tokens import settle, sole

KINDS = ("assign", "access", "hex", "guess")
LEAST = {"assign": 6, "access": 20, "hex": 24}

# Fixed values of the patterns that are asked for.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Where the method looks for values: a credential word, some separator, and what stands in
#: quotes or, without them, before white space, a comma, a semicolon, a quote or a tag; the same
#: after a user's name; or before the ``@`` of a URL.
_VALUE = r"""(?:"(?P<{0}2>[^"\n]+)"|'(?P<{0}1>[^'\n]+)'|`(?P<{0}0>[^`\n]+)`|["'`]?(?P<{0}3>[^\s,;"'`<>]+))"""
CONTEXT = re.compile(
    r"(?<![A-Za-z])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|credentials?|api[ _-]?key|auth[ _-]?key|private[ _-]?key)"
    r"[\"'`]?\x20*(?:\x20is\x20|:=|=>|[:=])\x20*" + _VALUE.format("w") + r"|(?<![A-Za-z])log(?:in|[ -]in|ged[ -]in)\x20+(?:as|with)\x20+[^\s/]+\x20*/\x20*" + _VALUE.format("u") + r"|://[^\s/:@]+:(?P<host>[^\s/@]+)@",
    re.IGNORECASE | re.ASCII,
)
CONTEXT_HINTS = ("pass", "pwd", "pin", "secret", "token", "credential", "key", "log", "://")
CLOSERS = ".!?:)]}"

#: Decimal log of the guesses from which a value counts as secret, and one of letters only.
GUESSES_LOG10, LETTERS_LOG10 = 8.0, 12.0
LEAST_VALUE = 6
#: Log10 of guesses for one character that nothing explains, and for one more part.
BRUTE, PART = 1.0, 0.3
#: A repeated block has so many characters at most.
LONGEST_BLOCK = 32

#: Common passwords' stems and words around credentials, which come before all other words.
COMMON = "password passwd pass admin root user login welcome letmein secret token changeme default test guest example qwerty dragon monkey master shadow".split()
LEET = str.maketrans("4301!5$7@", "aeoiissta")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {a: b for row in ROWS for a, b in zip(row, row[1:], strict=False)}
DATE = re.compile(r"(?=((?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d))")
YEAR = re.compile(r"(?=((?:19|20)\d\d))")


def ranked_words(path: str) -> dict[str, int]:
    """Words of three letters and more by rank: ``COMMON``, then those that a ``tokenizers``
    file holds whole, in its order."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)["model"]["vocab"]
    whole = [t.removesuffix("</w>").removeprefix("Ġ").lower() for t, _ in sorted(held.items(), key=lambda x: x[1]) if t.endswith("</w>") or t.startswith("Ġ")]
    words = dict.fromkeys([*COMMON, *(w for w in whole if len(w) > 2 and w.isascii() and w.isalpha())])
    return {w: i for i, w in enumerate(words, 1)}


def _runs(value: str, follows) -> Iterator[tuple[int, int]]:
    """Longest stretches of three characters or more of which each ``follows`` the one before."""
    start = 0
    for i in range(1, len(value) + 1):
        if i == len(value) or not follows(value[i - 1], value[i]):
            if i - start > 2:
                yield start, i
            start = i


def _blocks(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, size) of each longest stretch in which a block of ``size`` characters
    follows itself."""
    for size in range(2, min(LONGEST_BLOCK, len(value) // 2) + 1):
        start = 0
        for i in range(size, len(value) + 1):
            if i == len(value) or value[i] != value[i - size]:
                if i - start >= 2 * size:
                    yield start, start + (i - start) // size * size, size
                start = i - size + 1


class Guesser:
    """Costs of values, in decimal logs of guesses."""

    def __init__(self, words: dict[str, int]) -> None:
        self.words, self.longest = words, max(map(len, words), default=0)

    def matches(self, value: str) -> list[tuple[int, int, float]]:
        """(start, end, cost) of each stretch that something explains."""
        low, found, words = value.lower(), [], self.words
        if len(low) != len(value):  # a letter whose lower case is longer
            low = "".join(c.lower()[:1] for c in value)
        plain = low.translate(LEET)
        for start in range(len(value)):
            for end in range(start + 3, min(len(value), start + self.longest) + 1):
                rank, twist = words.get(low[start:end]), 0.0
                if rank is None and (rank := words.get(plain[start:end])):
                    twist = 0.6
                if rank:
                    cased = value[start:end]
                    twist += 0.0 if cased == low[start:end] else 0.3 if cased.istitle() or cased.isupper() else 0.9
                    found.append((start, end, math.log10(rank + 10) + twist))
        for pattern, cost in ((DATE, 4.6), (YEAR, 2.1)):
            found += [(m.start(), m.end(1), cost) for m in pattern.finditer(value)]
        found += [(a, b, BRUTE + math.log10(b - a)) for a, b in _runs(low, lambda x, y: x == y)]
        for step in (1, -1):
            found += [(a, b, 1.5 + math.log10(b - a)) for a, b in _runs(low, lambda x, y, s=step: x.isalnum() and y.isalnum() and ord(y) - ord(x) == s)]
        for walk in (lambda x, y: NEXT.get(x) == y, lambda x, y: NEXT.get(y) == x):
            found += [(a, b, 2.0 + math.log10(b - a)) for a, b in _runs(low, walk)]
        return found + [(a, b, min(n * BRUTE, 6.0) + math.log10((b - a) // n)) for a, b, n in _blocks(low)]

    def cost(self, value: str) -> float:
        """Log10 of the guesses for the cheapest cut of ``value``."""
        by_end: dict[int, list[tuple[int, float]]] = {}
        for start, end, cost in self.matches(value):
            by_end.setdefault(end, []).append((start, cost))
        best = [0.0]
        for end in range(1, len(value) + 1):
            best.append(min([best[end - 1] + BRUTE, *(best[start] + cost + PART for start, cost in by_end.get(end, ()))]))
        return best[-1]


def is_secret(value: str, cost: float) -> bool:
    return len(value) >= LEAST_VALUE and cost >= (LETTERS_LOG10 if value.isalpha() else GUESSES_LOG10)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, in order."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def credential_values(text: str) -> Iterator[tuple[int, int]]:
    """Places of the values in credential context, without closing marks after those that
    aren't quoted."""
    low = text.lower()
    if any(h in low for h in CONTEXT_HINTS):
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastgroup)
            if m.lastgroup in ("w3", "u3"):
                while end > start and text[end - 1] in CLOSERS:
                    end -= 1
            if end > start:
                yield start, end


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


Span = tuple[int, int, int]


def scan_text(text: str | None, guesser: Guesser) -> tuple[list[Span], list[Span], list[tuple[int, int, float]]]:
    """Base spans, and all spans, each by start and then kind; (start, end, cost) of every
    value in credential context."""
    base = base_spans(text or "")
    costs = [(a, b, guesser.cost(text[a:b])) for a, b in credential_values(text or "")]
    return base, sorted(base + [(a, 3, b) for a, b, cost in costs if is_secret(text[a:b], cost)]), costs


def guesser(words_path: str) -> Guesser:
    return sole(("guesses", words_path), lambda: Guesser(ranked_words(words_path)))


def scan(docs: DataFrame, words_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and costs (start, end and log10 of
    the guesses of every value in credential context) of every row. words_path: a vocabulary of
    the ``tokenizers`` library whose words have ranks."""
    kind = docs.schema[id_col].dataType.simpleString()
    cost_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log10", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = guesser(words_path)
        for batch in batches:
            for part in (batch.slice(a, 1_000) for a in range(0, batch.num_rows, 1_000)):
                counts, shas, spans, costs = [], [], [], []
                for t in part.column(1):
                    base, every, found = scan_text(t.as_py(), held)
                    counts.append([sum(k == i for _, k, _ in base) for i in range(3)])
                    shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                    spans.append(joined(every))
                    costs.append([{"start": a, "end": b, "log10": c} for a, b, c in found])
                n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "costs"]
                yield pa.RecordBatch.from_arrays([part.column(0), *n, pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(costs, cost_type)], names=names)
            settle()

    shape = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, costs array<struct<start:bigint,end:bigint,log10:double>>"
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, {shape}")


def redact_text(text: str | None, held: Guesser, mark: str = "[SECRET]") -> str | None:
    """``text`` with each span, overlapping ones merged, replaced."""
    if not text:
        return text
    out, at = [], 0
    for start, _, end in scan_text(text, held)[1]:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, words_path: str, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced; ``chars_col``, where there is one, is counted anew for
    changed texts. Columns and their order stay."""
    places = {c: i for i, c in enumerate(docs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = guesser(words_path)
        for batch in batches:
            for part in (batch.slice(a, 1_000) for a in range(0, batch.num_rows, 1_000)):
                before = part.column(places[text_col]).to_pylist()
                after = [redact_text(t, held) for t in before]
                arrays = list(part.columns)
                arrays[places[text_col]] = pa.array(after, arrays[places[text_col]].type)
                if chars_col in places:
                    old = arrays[places[chars_col]]
                    arrays[places[chars_col]] = pa.array([n if a == b else len(b) for n, a, b in zip(old.to_pylist(), before, after, strict=True)], old.type)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)
            settle()

    return docs.mapInArrow(run, docs.schema)
