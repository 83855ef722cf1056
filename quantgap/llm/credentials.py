"""Secret scan by linking the parts of a credential.

Sure findings stand alone: assignments to a password-like name, access identifiers of a known form, long hexadecimal runs.
Weak parts (account names, unlabelled long keys, service addresses) mean little alone and are reported only where
complementary parts meet: the intervals of identifiers, secrets and endpoints are joined with those of the scopes, the
sections of a text, however far apart they are in one.  The join sweeps sorted intervals within a row; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgap.llm.common import ship

# Forms of the sure findings; letters of the names in either case.
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
HINT = re.compile(r"(?i:password|passwd|secret|token|api_?key)", re.A)
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
BASE = KINDS[:3]

# Weak parts, each a complement of another.
WEAK = {
    "identifier": re.compile(r"(?i:\b(?:client|account|user|access|tenant|app)[_-]?(?:id|name|key_?id)|\b(?:username|login|user)\b)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}", re.A),
    "key": re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/=_-])", re.A),
    "endpoint": re.compile(r"(?i:\b(?:https?|ftp|sftp|ssh|jdbc:[a-z]+|mongodb(?:\+srv)?|postgres(?:ql)?|mysql|redis|amqps?|s3)://[^\s\"'<>]+|\b(?:host|endpoint|server|region|bucket)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.:-]{3,})", re.A),
}
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "key": "secret", "endpoint": "endpoint"}
COMPLEMENTS = {"identifier": ("secret",), "secret": ("identifier", "endpoint"), "endpoint": ("secret",)}
# A section begins at a heading of an INI or Markdown text, a rule of signs, a form feed or an armoured block; a text without is one scope.
SCOPE = re.compile(r"^(?:\[[^\]\n]+\][^\S\n]*$|\#{1,6}\x20[^\n]*$|(?:-{3,}|={3,}|\*{3,}|_{3,})[^\S\n]*$|-----BEGIN\b)|\x0c", re.M)

ship(__name__)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Sure findings as ``(start, kind order, end)``, in order; positions count code points."""
    found = []
    if HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts that a sure finding does not cover, in the same form."""
    starts, reach, furthest = [b[0] for b in base], [], 0
    for b in base:
        furthest = max(furthest, b[2])
        reach.append(furthest)
    found = []
    for kind, pattern in WEAK.items():
        for m in pattern.finditer(text):
            k = bisect_left(starts, m.end())
            if not k or reach[k - 1] <= m.start():
                found.append((m.start(), KINDS.index(kind), m.end()))
    return sorted(found)


def linked_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Sure findings, and all findings: the sure ones and the weak ones that meet a complement in their scope."""
    base = base_spans(text)
    weak = weak_spans(text, base)
    if not weak:
        return base, base
    breaks = [m.start() for m in SCOPE.finditer(text)]
    scope = lambda start: bisect_right(breaks, start)
    held = {(scope(start), ROLE[KINDS[kind]]) for start, kind, _ in base + weak}
    kept = [(start, kind, end) for start, kind, end in weak if any((scope(start), role) in held for role in COMPLEMENTS[ROLE[KINDS[kind]]])]
    return base, sorted(base + kept)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans)`` per row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                base, spans = linked_spans(value.as_py() or "")
                counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
                rows.append((*counts, len(spans) - len(base), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans"]
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_linked bigint, base_sha256 string, spans string"
    )
