"""Secret scans by assignment-aware lexing.

Three fixed patterns give the base spans.  The lexer then reads source and configuration syntax as (name, value)
pairs, remembers which name holds which literal, follows names that are assigned other names, joins literals and names
that are added or stand side by side, reads the elements of lists, and scores the value that reaches a name by how
sensitive that name is and how much the value looks like a key.  The literals of values that score ``THRESHOLD`` or more
and lie outside all base spans are added as spans of kind ``literal``, a joined value's each by itself.

Positions are code points, ends exclusive.  A null text is empty and has no spans; null ids and repeated rows are kept.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import each_slice, each_text

KINDS = ("assign", "access", "hex", "literal")
THRESHOLD = 0.5
#: Characters, and literals, of a joined value at most; what follows is read by itself.
JOINED = 65_536

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")

#: Parts of names and how sensitive a name with that part is.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "accesskey": 1.0, "privatekey": 1.0,
    "secretkey": 1.0, "authkey": 0.9, "signingkey": 0.9, "encryptionkey": 0.9, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.7,
}
#: A text without any of these has neither base spans nor sensitive names.
_HINT = r"(?i)pass|pwd|secret|token|key|credential|bearer|auth|AKIA|[0-9a-f]{16}"

#: A literal in any quotes.
_QUOTED = (
    r"""[bBrRuUfF]{0,2}(?P<triple>\"{3}|'{3})(?P<long>(?:\\[\s\S]|(?!(?P=triple))[^\\])*+)(?P=triple)"""
    r"""|[bBrRuUfF]{0,2}(?P<quote>["'`])(?P<quoted>(?:\\.|(?!(?P=quote))[^\\\n])*+)(?P=quote)"""
)
#: No part has a bound; possessive repeats keep the search linear.
_PAIR = re.compile(
    r"""(?<![A-Za-z0-9_$.\-])(?P<name>[A-Za-z_$][A-Za-z0-9_$.\-]*+)["']?\]?[ \t]*+(?::[ \t]*+[A-Za-z_][\w.\[\]]*+[ \t]*+(?==[^=]))?(?::=|=>|=(?![=~])|:(?![:/]))[ \t]*+"""
    rf"""(?:{_QUOTED}|(?P<list>\[)|(?P<bare>\$?\{{?[^\s"'`,;#<>()\[\]{{}}]++))"""
)
#: What goes on a value: a literal or a name after a plus, a literal right after one.
_MORE = re.compile(rf"""[ \t]*+(?:(?P<plus>\+)(?:[ \t]*+\\?\n)?+[ \t]*+)?(?:{_QUOTED}|(?P<bare>[A-Za-z_$][A-Za-z0-9_$.]*+)(?![(\[]))""")
#: An element of a list.
_ELEMENT = re.compile(rf"""[\s,]*+(?:{_QUOTED})""")
#: An address without a password in it.
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s@]*$")
#: Where the lines of a triple-quoted literal are joined, and what surrounds it.
_FOLD = re.compile(r"\s*\n\s*")
_AROUND = re.compile(r"(?:\\?\s)*+")
_REFERENCE = re.compile(r"\$?\{?([A-Za-z_$][A-Za-z0-9_$.\-]*)$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_PLACEHOLDER = re.compile(r"(?i)^(?:none|null|true|false|changeme|example.*|your.*|x+|\*+|<.*|todo|test|dummy|placeholder|\.+|-+)$")


class Span(NamedTuple):
    """A find: kind and range, and the range of the secret value in it."""

    kind: str
    start: int
    end: int
    value_start: int
    value_end: int

    @property
    def order(self) -> tuple[int, int, int]:
        return self.start, KINDS.index(self.kind), self.end


def base_spans(text: str) -> list[Span]:
    found = [Span("assign", *m.span(), *m.span(2)) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [Span("access", *m.span(), *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [Span("hex", *m.span(), *m.span()) for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda s: s.order)


def name_weight(name: str) -> float:
    """How sensitive a target name is: its words, and pairs of neighbouring words, looked up in SENSITIVE."""
    parts = [p.lower() for p in _WORDS.findall(name)]
    return max((SENSITIVE.get(x, 0.0) for x in [*parts, *map("".join, zip(parts, parts[1:], strict=False))]), default=0.0)


def literal_quality(value: str) -> float:
    """0 to 1: long, varied literals look like keys; placeholders, prose and short words don't."""
    if len(value) < 8 or _PLACEHOLDER.match(value) or _ADDRESS.match(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, bits / 4.0) * min(1.0, n / 12) * (1.0 if classes >= 2 else 0.5)


class _Value(NamedTuple):
    """A value: its text, and the ranges of the literals that make it up."""

    text: str
    ranges: tuple[tuple[int, int], ...]


def _literal(text: str, m: re.Match) -> _Value:
    if m["triple"]:
        start = _AROUND.match(text, *m.span("long")).end()
        value = text[start : m.end("long")].rstrip()
        return _Value(_FOLD.sub("", value), ((start, start + len(value)),))
    return _Value(m["quoted"], (m.span("quoted"),))


def _values(text: str, m: re.Match, holds: dict[str, _Value]) -> tuple[list[_Value], int]:
    """(values, end) of an assignment: one value, or the elements of a list."""
    at = m.end()
    if m["list"]:
        found = []
        while e := _ELEMENT.match(text, at):
            found.append(_literal(text, e))
            at = e.end()
        return found, at
    if m["quote"] or m["triple"]:
        value = _literal(text, m)
    else:
        bare = m["bare"].rstrip(".")
        ref = _REFERENCE.match(bare)
        if not ref or ref[1] not in holds:
            return [_Value(bare, ((m.start("bare"), m.start("bare") + len(bare)),))], at
        value = holds[ref[1]]
    parts, ranges, size = [value.text], list(value.ranges), len(value.text)
    while e := _MORE.match(text, at):
        if not e["plus"] and not (e["quote"] or e["triple"]):
            break
        if e["bare"]:
            if e["bare"] not in holds:
                break
            more = holds[e["bare"]]
        else:
            more = _literal(text, e)
        size += len(more.text)
        if max(size, len(ranges) + len(more.ranges)) > JOINED:
            break
        parts.append(more.text)
        ranges += more.ranges
        at = e.end()
    return [_Value("".join(parts), tuple(ranges))] if len(parts) > 1 else [value], at


def literal_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals that reach a sensitive name, directly or through other names; a name means its latest assignment."""
    holds: dict[str, _Value] = {}
    found: set[Span] = set()
    quality: dict[tuple, float] = {}
    at = 0
    while m := _PAIR.search(text, at):
        values, at = _values(text, m, holds)
        if not m["list"]:
            holds[m["name"]] = values[0]
        if not (weight := name_weight(m["name"])):
            continue
        for value in values:
            if value.ranges not in quality:
                quality[value.ranges] = literal_quality(value.text)
            if weight * quality[value.ranges] >= threshold:
                found.update(Span("literal", a, b, a, b) for a, b in value.ranges if a < b)
    return sorted(found, key=lambda s: s.order)


def find(text: str, threshold: float = THRESHOLD) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each in order."""
    base = base_spans(text)
    starts, reach = [s.start for s in base], list(accumulate((s.end for s in base), max))
    # a literal is new unless a base span that begins no later ends no earlier
    more = [s for s in literal_spans(text, threshold) if not (k := bisect_right(starts, s.start)) or reach[k - 1] < s.end]
    return base, sorted([*base, *more], key=lambda s: s.order)


def mask(text: str, spans: list[Span], replacement: str = "[secret]") -> str:
    """The text with every secret value (overlaps merged) replaced."""
    out, at, end = [], 0, -1
    for a, b in sorted((s.value_start, s.value_end) for s in spans):
        if a > end:
            if end >= 0:
                out.append(replacement)
                at = end
            out.append(text[at:a])
            at = a
        end = max(end, b)
    if end >= 0:
        out.append(replacement)
        at = end
    out.append(text[at:])
    return "".join(out)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def _scan(texts: pa.Array) -> Iterable[tuple[str | None, list[Span], list[Span]]]:
    """Per text: the text (None where nothing can be found), base spans and all spans."""
    likely = pc.match_substring_regex(texts, _HINT)
    for hit, t in zip(likely.to_pylist(), texts, strict=True):
        text = t.as_py() if hit else None
        yield (text, *find(text)) if hit else (None, [], [])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of every text."""

    def work(ids: pa.Array, texts: pa.Array) -> Iterable[pa.RecordBatch]:
        rows = [(*(sum(s.kind == k for s in base) for k in KINDS[:3]), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)) for _, base, spans in _scan(texts)]
        columns = list(zip(*rows, strict=True))
        types = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return each_text(docs, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work, id_col, text_col)


def masked_texts(docs: DataFrame, text_col: str = "text", replacement: str = "[secret]") -> DataFrame:
    """``docs`` with the secret values of ``text_col`` replaced; all other columns, and null texts, stay."""
    place = docs.columns.index(text_col)

    def work(rows: pa.RecordBatch, texts: pa.Array) -> pa.RecordBatch:
        new = [t.as_py() if not spans else mask(text, spans, replacement) for t, (text, _, spans) in zip(rows.column(place), _scan(texts), strict=True)]
        columns = [pa.array(new, rows.column(place).type) if i == place else c for i, c in enumerate(rows.columns)]
        return pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return each_slice(docs, text_col, work)
