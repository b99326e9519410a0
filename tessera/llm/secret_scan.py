"""Secret scan (operator 7): fixed patterns plus sliding-window entropy.

Candidate strings are maximal runs of token characters. A window slides over
each run, one for every character class it can belong to; the counts of the
window are updated by the character that enters and the one that leaves, and
the sum of c * log2(c) with them, so a step costs the same whatever the window.
Overlapping windows above the class's threshold merge into one span. Allow-list
patterns suppress spans of the entropy method that they fit as a whole, or that
are none without the parts they fit; spans of the fixed patterns always stay.

A row is scanned by itself in one pass over its whole text; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import in_batches, lean

# Fixed patterns of the base rules: kind, pattern, group that is measured, its least length.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                          re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


class CharClass(NamedTuple):
    kind: str
    member: re.Pattern        # a run of this class
    window: int
    bits: float               # least entropy of a window, in bits per character
    needs: tuple[str, ...]    # patterns that a span must contain


# Windows and thresholds by class. Random base64 of 24 characters has about 4.3
# bits, base36 about 4.1, base32 about 4.0, hex about 3.5; words of one case stay
# below 3.8 and are held off by the digits or the two cases that a span must have.
CLASSES = (
    CharClass("entropy_hex", re.compile(r"[0-9a-fA-F]{24,}"), 24, 3.0, (r"[0-9]", r"[a-fA-F]")),
    CharClass("entropy_base64", re.compile(r"[A-Za-z0-9+/_=-]{24,}"), 24, 3.9, (r"[0-9]", r"[a-z]", r"[A-Z]")),
    CharClass("entropy_lower", re.compile(r"[a-z0-9]{24,}"), 24, 3.6, (r"(?:[0-9][^0-9]*){2}", r"(?:[g-z][^g-z]*){4}")),
    CharClass("entropy_upper", re.compile(r"[A-Z0-9]{24,}"), 24, 3.6, (r"(?:[0-9][^0-9]*){2}", r"(?:[G-Z][^G-Z]*){4}")),
)
KINDS = tuple(k for k, *_ in BASE) + tuple(c.kind for c in CLASSES)

_ALPHABET = "|".join("abcdefghijklmnopqrstuvwxyz"[:k] for k in range(26, 5, -1))
# Spans that look random and are known not to be secrets. They are held against
# the span that was found, or (words) a part of it between separators.
ALLOW = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",      # UUID
    r"(.{1,4})\1{3,}.{0,3}",                                                              # a short unit again and again
)
ALLOW_PARTS = (
    r"(?i)(?:my|your|an?|the|is|this|key|token|secret|example|sample|placeholder|changeme|dummy|xxxx+)+[0-9]{0,2}",
    rf"(?i)(?:{_ALPHABET}|01234567(?:89?)?|123456789?0?)+",
)

_PART = re.compile(r"[A-Za-z0-9]+")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
SCHEMA = ("n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")


def entropy_spans(s: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged [start, end) of the windows of ``s`` whose Shannon entropy is at least ``bits``.

    H = log2(w) - (sum c log2 c) / w; a step changes two of the counts.
    """
    n = len(s)
    if n < window:
        return []
    clog = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    count: dict[str, int] = {}
    total, out = 0.0, []
    most = (math.log2(window) - bits) * window + 1e-9
    for i, ch in enumerate(s):
        c = count.get(ch, 0)
        total += clog[c + 1] - clog[c]
        count[ch] = c + 1
        if i >= window:
            old = s[i - window]
            c = count[old]
            total += clog[c - 1] - clog[c]
            count[old] = c - 1
        if i >= window - 1 and total <= most:
            a, b = i - window + 1, i + 1
            if out and out[-1][1] >= a:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


def _spans(s: str, c: CharClass) -> list[tuple[int, int]]:
    """Spans of a run that fulfil the class."""
    if not all(re.search(p, s) for p in c.needs):
        return []
    return [(a, b) for a, b in entropy_spans(s, c.window, c.bits) if all(re.search(p, s[a:b]) for p in c.needs)]


def _is_allowed(span: str, c: CharClass, allow, parts) -> bool:
    """Is the span as a whole known, or without a span once its known parts are out?"""
    if any(re.fullmatch(p, span) for p in allow):
        return True
    rest, start = [], 0
    for m in _PART.finditer(span):
        if any(re.fullmatch(p, m[0]) for p in parts):
            rest.append(span[start:m.start()])
            start = m.end()
    return bool(rest) and not any(_spans(x, c) for x in (*rest, span[start:]))


def scan(text: str | None, classes=CLASSES, allow=ALLOW, parts=ALLOW_PARTS) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text by start, then kind as in KINDS."""
    if not text:
        return []
    found = [(kind, m.start(), m.end()) for kind, pattern, group, least in BASE
             for m in pattern.finditer(text) if len(m[group]) >= least]
    for m in _CANDIDATE.finditer(text):
        for c in classes:
            for run in c.member.finditer(m[0]):
                for a, b in _spans(run[0], c):
                    if not _is_allowed(run[0][a:b], c, allow, parts):
                        found.append((c.kind, m.start() + run.start() + a, m.start() + run.start() + b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _join(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, counts by kind, base_sha256, spans.

    A NULL or empty text has no spans ('' and the SHA-256 of ''). Offsets are
    code points, end exclusive. Other columns are not read.
    """
    kind = dict(docs.dtypes)[doc_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_kinds = {k for k, *_ in BASE}
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for t in batch.column(1):
                spans = scan(t.as_py())
                base = [s for s in spans if s[0] in base_kinds]
                for j, k in enumerate(("assign", "access", "hex")):
                    cols[j].append(sum(s[0] == k for s in base))
                cols[3].append(len(spans) - len(base))
                cols[4].append(hashlib.sha256(_join(base).encode()).hexdigest())
                cols[5].append(_join(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]),
                 *(pa.array(c, pa.string()) for c in cols[4:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return in_batches(docs).selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInArrow(lean(run), f"doc_id {kind}, {SCHEMA}")
