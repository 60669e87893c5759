"""Secret scans (3): an Aho-Corasick keyword prefilter, regular expressions anchored near hits, then checksums.

One pass over each lower-cased text finds all keywords; a regular expression is
tried only at the place that a keyword fixes, so nothing else of the text is
matched.  Long hexadecimal runs have no keyword: they are found by probing every
16th character, since a run of 32 covers two such places.  Token formats that
carry a checksum or a checkable part count only if it is right.  The time is
proportional to the text: where many hits look ahead over the same run of
characters, its end is found once (``Scanner``).

Base kinds, as the contract fixes them: ``assign``, ``access``, ``hex``.  Further
kinds: ``github`` and ``npm`` (CRC-32 in base 62), ``jwt`` (header is JSON with an
algorithm), ``pem`` (private key blocks).

Nulls and empty texts have no spans; positions count code points of the whole
text; equal rows are scanned each; empty tables give an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

Span = tuple[int, int, str]
#: Order of kinds at equal starts.
KINDS = ["assign", "access", "hex", "github", "npm", "jwt", "pem"]
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_SEGMENT = re.compile(r"[A-Za-z0-9_-]*")
_PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*)PRIVATE KEY-----")
_PEM_END = re.compile(r"(?=(-----END ((?:[A-Z0-9]+ )*)PRIVATE KEY-----))")
_PEM_BODY = re.compile(r"[A-Za-z0-9+/=:,\s.-]*")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = _DIGITS[r] + out
    return out.rjust(width, "0")


def _crc_right(m: re.Match) -> bool:
    return base62(zlib.crc32(m[1].encode()), 6) == m[2]


def _header_right(head: str) -> bool:
    try:
        return isinstance(json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))).get("alg"), str)
    except (ValueError, AttributeError, RecursionError):
        return False


class Scanner:
    """One text at the places of its hits, in ascending order; what a hit finds out about the text ahead serves the next ones."""

    def __init__(self, text: str):
        self.text = text
        self.runs: dict[re.Pattern, tuple[int, int]] = {}
        self.tails: dict[int, int | None] = {}
        self.ends: dict[str, tuple[list[int], list[int]]] | None = None

    def run(self, pattern: re.Pattern, at: int) -> int:
        """The end of the run of a set of characters that holds place ``at``."""
        a, b = self.runs.get(pattern, (0, 0))
        if not a <= at < b:
            a, b = self.runs[pattern] = at, pattern.match(self.text, at).end()
        return b

    def plain(self, pattern: re.Pattern, at: int, right: Callable[[re.Match], bool]) -> tuple[int, bool] | None:
        """The end of a match at ``at``, and whether it passes the check."""
        return (m.end(), right(m)) if (m := pattern.match(self.text, at)) else None

    def jwt(self, at: int) -> tuple[int, bool] | None:
        """Three parts with points between; the first two begin like JSON objects in base 64."""
        head = self.run(_SEGMENT, at)
        if head not in self.tails:
            body = _SEGMENT.match(self.text, head + 1).end() if self.text.startswith(".eyJ", head) else 0
            end = _SEGMENT.match(self.text, body + 1).end() if body > head + 4 and self.text.startswith(".", body) else 0
            self.tails[head] = end if end > body + 1 else None
        end = self.tails[head]
        return (end, _header_right(self.text[at:head])) if end and head > at + 3 else None

    def pem(self, at: int) -> tuple[int, bool] | None:
        """A key block up to the first end line with the label of its begin line, with nothing but a block's characters between."""
        if not (m := _PEM_BEGIN.match(self.text, at)):
            return None
        if self.ends is None:
            self.ends = {}
            for e in _PEM_END.finditer(self.text):
                for places, place in zip(self.ends.setdefault(e[2], ([], [])), e.span(1), strict=True):
                    places.append(place)
        begins, ends = self.ends.get(m[1], ([], []))
        k = bisect_left(begins, m.end())
        return (ends[k], True) if k < len(begins) and begins[k] <= self.run(_PEM_BODY, m.end()) else None


#: keyword (lower case) -> kind, and what is tried where it begins: the end of a match and whether it counts
_RULES = {
    **{k: ("assign", lambda s, at: s.plain(_ASSIGN, at, lambda m: len(m[2]) >= 8)) for k in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": ("access", lambda s, at: s.plain(_ACCESS, at, lambda m: len(m[0]) >= 16)),
    **{f"gh{c}_": ("github", lambda s, at: s.plain(_GITHUB, at, _crc_right)) for c in "pousr"},
    "npm_": ("npm", lambda s, at: s.plain(_NPM, at, _crc_right)),
    "eyj": ("jwt", lambda s, at: s.jwt(at) if s.text.startswith("eyJ", at) else None),
    "-----begin ": ("pem", Scanner.pem),
}
_HEX_CHARS = frozenset("0123456789abcdef")
HEX_LEAST = 32


@lru_cache(maxsize=1)
def _keywords():
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, rule in _RULES.items():
        found.add_word(k, (len(k), *rule))
    found.make_automaton()
    return found


def lowered(text: str) -> str:
    """A-Z in lower case and nothing else changed, so that places stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def hex_runs(text: str) -> list[Span]:
    """Maximal runs of hexadecimal digits of 32 characters or more."""
    probe, out, end = text[::16], [], 0
    for m in _HEX.finditer(probe):
        if m.end() - m.start() < 2:
            continue
        for k in range(m.start(), m.end()):
            a = 16 * k
            if a < end:
                continue
            while a and text[a - 1] in _HEX_CHARS:
                a -= 1
            run = _HEX.match(text, a)
            end = run.end()
            if end - a >= HEX_LEAST:
                out.append((a, end, "hex"))
    return out


def spans(text: str | None) -> list[Span]:
    """All secrets as (start, end, kind), in order of start, then of kind; leftmost and not overlapping within a kind."""
    if not text:
        return []
    out, done, scanner = hex_runs(text), dict.fromkeys(KINDS, 0), Scanner(text)
    hits = [(last - n + 1, kind, tried) for last, (n, kind, tried) in _keywords().iter(lowered(text))]
    hits.sort(key=lambda h: h[0])
    for start, kind, tried in hits:
        if start >= done[kind] and (found := tried(scanner, start)):
            done[kind] = found[0]
            if found[1]:
                out.append((start, found[0], kind))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def redacted(text: str | None, found: list[Span]) -> str | None:
    """Each secret, overlapping ones as one, replaced by the kind of the first in brackets."""
    if not found:
        return text
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def joined(found: Iterable[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` with counts of the base kinds, the digest of the base spans, and all spans, of ``doc_id, text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spans(t.as_py()) for t in batch.column("text")]
            counts = [pa.array([sum(s[2] == k for s in own) for own in found], pa.int64()) for k in BASE]
            base = [hashlib.sha256(joined(s for s in own if s[2] in BASE).encode()).hexdigest() for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([joined(own) for own in found], pa.string())], ["doc_id", *[x.split()[0] for x in SCAN.split(", ")]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id long, {SCAN}")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with the secrets of the text column replaced."""
    schema = T.StructType([T.StructField(f.name, T.StringType() if f.name == text else f.dataType) for f in docs.schema])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            new = pa.array([redacted(t, spans(t)) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(lean(run), schema)
