"""Secret scans: fixed signatures, and values in credential contexts judged by the guesses they would cost."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import texts_of

#: Kinds in the order in which spans with one start are listed. The first three are the base.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Further contexts whose values are judged by their cost, each on its own over the whole text: names before a value (a scheme word before
#: it is passed over), credentials in an address, a bearer header.
CONTEXTS = (
    re.compile(
        r"""(?ai:(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credential|auth|(?:api|access|private|client|secret|encryption|signing)[_-]?key)s?)["']?\x20*(?::=|=>|[:=])\x20*["']?"""
        r"""(?:(?ai:bearer|basic)\x20+["']?)?([^\x00-\x20"'<>,;]{6,})"""
    ),
    re.compile(r"""://[^\x00-\x20"'/:@]+:([^\x00-\x20"'/:@]{6,})@"""),
    re.compile(r"""(?ai:bearer)\x20+([A-Za-z0-9._~+/=-]{16,})"""),
)
#: What stands for a secret in a redacted text.
MASK = "[REDACTED]"
#: log10 of the guesses from which a value counts as a secret.
GUESSES = 9.0
#: A sieve in one pass: texts without a match have no span. It may let through more.
SIEVE = r"(?i:pass|pwd|secret|token|credential|auth|key|bearer)|://|AKIA[A-Z0-9]|[0-9a-f]{16}"

#: Words that guessers try first, the likeliest first.
COMMON = """password 123456 12345678 123456789 qwerty abc123 letmein monkey dragon master login admin welcome shadow sunshine princess football
baseball superman batman trustno1 iloveyou starwars whatever hello freedom secret changeme default root test guest example user
summer winter spring autumn monday friday january love money computer internet server database access token system manager
service account private public company office test123 pass temp sample dummy placeholder your none null true false value string""".split()
#: Keyboard rows.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4830!1$57", "aabeoiisst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0?[1-9]|1[0-2])(?:[-/._]?(?:0?[1-9]|[12]\d|3[01]))?)?|(?:0?[1-9]|[12]\d|3[01])[-/._]?(?:0?[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", re.ASCII)


#: A public vocabulary whose whole words, in its order, follow the common ones; the shortest and longest words of it that count.
WORDS, SHORTEST, LONGEST = "word_bpe_49k.json", 3, 16


@cache
def dictionary(name: str | None = WORDS) -> dict[str, int]:
    """Words by rank, the likeliest first: COMMON, then the whole words of letters of an installed vocabulary (None: no more)."""
    ranks = {word: rank for rank, word in enumerate(COMMON)}
    if name:
        import public_tokenizers

        with open(public_tokenizers.path(name), encoding="utf-8") as file:
            model = json.load(file)["model"]
        suffix = model["end_of_word_suffix"]
        for token in sorted(model["vocab"], key=model["vocab"].get):
            word = token.removesuffix(suffix)
            if word is not token and word.isascii() and word.isalpha() and SHORTEST <= len(word) <= LONGEST:
                ranks.setdefault(word, len(ranks))
    return ranks


@cache
def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for y, row in enumerate(ROWS):
        for x, key in enumerate(row):
            near[key] = {ROWS[b][a] for b in (y - 1, y, y + 1) if 0 <= b < len(ROWS) for a in (x - 1, x, x + 1) if 0 <= a < len(ROWS[b])} - {key}
    return near


def _alphabet(value: str) -> int:
    """Characters that a brute-force guess must choose from, by the kinds seen."""
    size = 10 * any("0" <= c <= "9" for c in value) + 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value)
    return max(2, size + 32 * any(not c.isalnum() and c < "\x80" for c in value) + 100 * any(c >= "\x80" for c in value))


def _spans(value: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, log10 guesses) of the words, dates, repeats and keyboard walks in value."""
    lower, n = value.lower(), len(value)
    plain = lower.translate(LEET)
    ranks = dictionary()
    for at in range(n - SHORTEST + 1):
        for end in range(at + SHORTEST, min(n, at + LONGEST) + 1):
            for text, extra in ((lower, 0.0), (plain, 0.5)):
                if (rank := ranks.get(text[at:end])) is not None and (extra == 0.0 or text[at:end] != lower[at:end]):
                    case = 0.0 if value[at:end].islower() or lower[at:end].isdigit() else 0.5
                    yield at, end, math.log10(rank + 2) + extra + case
    for at in range(n):
        if m := DATE.match(value, at):
            yield at, m.end(), math.log10(130 * 365 * 4 if m.end() - at > 4 else 130)
    for width in (1, 2, 3, 4):
        at = 0
        while at + 2 * width <= n:
            end = at + width
            while end < n and lower[end] == lower[end - width]:
                end += 1
            times = (end - at) // width
            if times >= (3 if width == 1 else 2):
                yield at, at + times * width, width * math.log10(_alphabet(value[at : at + width])) + math.log10(times)
                at = end - width + 1
            else:
                at += 1
    near, at = _neighbours(), 0
    while at < n:
        end = at + 1
        while end < n and lower[end] in near.get(lower[end - 1], ()):
            end += 1
        if end - at >= 3:
            turns = sum(1 for i in range(at + 2, end) if ord(lower[i]) - ord(lower[i - 1]) != ord(lower[i - 1]) - ord(lower[i - 2]))
            yield at, end, math.log10(47) + 0.9 * math.log10(end - at) + 0.65 * (1 + min(turns, end - at))
        at = max(end - 1, at + 1)


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of value takes.

    Segments are words of the dictionary (with case and look-alike variants), dates, repeats, keyboard walks, and brute-force spans;
    a segmentation costs the product of its parts' guesses, times two for each part after the first.
    Of a repeat or a walk only the longest span counts, so the work is linear in the value.
    """
    n, each = len(value), math.log10(_alphabet(value)) if value else 0.0
    best = [0.0] + [math.inf] * n
    brute = [0.0] + [math.inf] * n  # with a brute-force span at the end
    ends: dict[int, list[tuple[int, float]]] = {}
    for a, b, cost in _spans(value):
        ends.setdefault(b, []).append((a, cost))
    join = math.log10(2)
    for i in range(1, n + 1):
        brute[i] = min(brute[i - 1] + each if i > 1 else each, best[i - 1] + each + (join if i > 1 else 0.0))
        best[i] = min([brute[i], *(best[a] + cost + (join if a else 0.0) for a, cost in ends.get(i, ()))])
    return best[n]


def scan(text: str) -> tuple[list[tuple[int, int, int]], float]:
    """((start, place in KINDS, end) of every span in order, the largest guess cost) of a text; ends are exclusive."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    most, values = 0.0, set()
    for context in CONTEXTS:
        at = 0
        while m := context.search(text, at):
            cost = guess_cost(m[1])
            most = max(most, cost)
            if cost >= GUESSES:
                values.add(m.span(1))
            at = m.end() if cost >= GUESSES else m.start(1)  # a cheap value may itself be a name before one
    end = 0
    for a, e in sorted(values, key=lambda v: (v[0], -v[1])):
        if e > end:  # else within one listed before
            found.append((a, 3, e))
            end = e
    return sorted(found), most


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess, max_guess), one row per input row.

    spans lists kind:start:end of all spans, in code points, by start and then kind; base_sha256 is the digest of the base spans
    listed so. kind guess marks a value in a credential context whose guess_cost is GUESSES or more; max_guess is the
    text's largest cost. A null or empty text has none: counts 0, spans empty, the digest that of the empty text. Texts are
    read whole; a row's work is its own, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sieved = pc.match_substring_regex(b.column(1), SIEVE).to_pylist()
            rows = []
            for doc, may, text in zip(b.column(0).to_pylist(), sieved, b.column(1), strict=True):
                spans, most = scan(text.as_py()) if may else ([], 0.0)
                listed = [f"{KINDS[k]}:{a}:{e}" for a, k, e in spans]
                base = ",".join(x for x, s in zip(listed, spans, strict=True) if s[1] < 3)
                n = [sum(s[1] == k for s in spans) for k in range(4)]
                rows.append((doc, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(), ",".join(listed), n[3], most))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64())
                names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "max_guess"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, max_guess double"
    return texts_of(docs, id_col, text_col).mapInArrow(run, schema)


def redact(text: str) -> str:
    """The text with MASK in the place of every secret; of an assignment the name stays and the value goes."""
    values = [(a, e) for a, k, e in scan(text)[0] if k != 0]
    values += [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out, at = [], 0
    for a, e in sorted(values):
        if e > at:
            if a >= at:
                out += [text[at:a], MASK]
            at = e
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All rows of docs, secrets in the text replaced by MASK; length_col, if there is one, follows. A null text stays null."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(place)
            may = pc.match_substring_regex(column, SIEVE).to_pylist()
            texts = [redact(t.as_py()) if m else t.as_py() for m, t in zip(may, column, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == place else c for i, c in enumerate(b.columns)], names=b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col in docs.columns else out
