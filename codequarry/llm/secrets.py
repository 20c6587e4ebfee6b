"""Secret scan with multipart credential linking.

Base spans stand on their own: assignments to a secret's name, access identifiers, long hexadecimal runs. Weak candidates mean
little alone: account names, opaque strings, endpoints. Parts are joined over intervals: an identifier's scope is its paragraph, however long,
and secrets and endpoints that lie in the scope are linked to it. A blank line ends a paragraph, and so do GAP or more blanks in a row.
Weak candidates are reported only if such a link completes them:

- an account name, with a base secret in scope, or with an opaque string and an endpoint;
- an opaque string, with an access identifier in scope, or with an account name and an endpoint;
- an endpoint, with an identifier and a secret that are reported.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from hashlib import sha256
from itertools import accumulate
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_texts

#: Kinds in order, base patterns, words without which an assignment can't occur.
KINDS = ("assign", "access", "hex", "account", "opaque", "endpoint")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

ACCOUNT = re.compile(r"\b(?:user(?:name)?|login|account|client_?id|access_?key_?id)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@=-]{3,}", re.IGNORECASE | re.ASCII)
ACCOUNT_WORDS = (b"user", b"login", b"account", b"client", b"access")
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ADDRESS = re.compile(r"https?://[^\s\"'<>]{4,}|(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?::\d{2,5})?(?![\d.])", re.ASCII)
PORT, HOST_START = re.compile(r":\d{2,5}\b", re.ASCII), re.compile(r"\b[a-z0-9-]", re.ASCII)
HOST_SIGNS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789.-")
GAP = 400
PARAGRAPH = re.compile(rf"\n[\x20\t\r]*\n|[\x20\t]{{{GAP},}}")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def __str__(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind, in order of start, then kind."""
    found, low = [], text.encode("utf-8", "surrogatepass").lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _endpoints(text: str) -> list[Span]:
    """Leftmost non-overlapping URLs, IP addresses, and names of two or more labels with a port, in time linear in the text.

    Names are found from their port backwards: a run of signs that names are made of has no colon, so it is walked once.
    """
    found = [Span(m.start(), 5, m.end()) for m in ADDRESS.finditer(text)]
    for port in PORT.finditer(text):
        first = stop = port.start()
        while first and text[first - 1] in HOST_SIGNS:
            first -= 1
        first = max(first, text.rfind("..", first, stop) + 2 if ".." in text[first:stop] else first)
        m = HOST_START.search(text, first, stop)
        if m and text[stop - 1] != "." and text.find(".", m.start(), stop) >= 0:
            found.append(Span(m.start(), 5, port.end()))
    apart, end = [], 0
    for s in sorted(found, key=lambda s: s.start):
        if s.start >= end:
            apart.append(s)
            end = s.end
    return apart


def _weak_spans(text: str, base: list[Span]) -> tuple[list[Span], list[Span], list[Span]]:
    low = text.encode("utf-8", "surrogatepass").lower()
    accounts = [Span(m.start(), 3, m.end()) for m in ACCOUNT.finditer(text)] if any(w in low for w in ACCOUNT_WORDS) else []
    if not accounts and not any(s.kind == 1 for s in base):
        return [], [], []  # without an identifier there is no scope
    opaque, starts, ends = [], [s.start for s in base], [0, *accumulate((s.end for s in base), max)]
    for m in OPAQUE.finditer(text):
        s = m[0]
        if not (any(c.isdigit() for c in s) and any(c.isupper() for c in s) and any(c.islower() for c in s)):
            continue
        if ends[bisect_left(starts, m.end())] <= m.start():  # no base span that starts before the string's end reaches into it
            opaque.append(Span(m.start(), 4, m.end()))
    return accounts, opaque, _endpoints(text)


def _within(parts: list[Span], starts: list[int], low: int, high: int) -> list[int]:
    """Indices of the parts that start and end in [low, high]."""
    return [i for i in range(bisect_left(starts, low), bisect_left(starts, high)) if parts[i].end <= high]


def scan(text: str | None) -> tuple[list[Span], list[Span], list[tuple[Span, Span]]]:
    """Base spans, all reported spans, and the links between an identifier and a secret."""
    text = text or ""
    base = base_spans(text)
    accounts, opaque, endpoints = _weak_spans(text, base)
    identifiers = sorted([s for s in base if s.kind == 1] + accounts)
    if not identifiers:
        return base, base, []
    secrets = sorted([s for s in base if s.kind != 1] + opaque)
    breaks = [0, *(m.end() for m in PARAGRAPH.finditer(text)), len(text) + 1]
    secret_starts, endpoint_starts = [s.start for s in secrets], [s.start for s in endpoints]
    reported, pairs = set(base), []
    for who in identifiers:
        k = bisect_left(breaks, who.start + 1)
        low, high = breaks[k - 1], breaks[k]
        near = _within(endpoints, endpoint_starts, low, high)
        linked = [secrets[i] for i in _within(secrets, secret_starts, low, high) if not (who.kind == 3 and secrets[i].kind == 4 and not near) and secrets[i].start != who.start]
        if linked:
            pairs += [(who, s) for s in linked]
            reported |= {who, *linked, *(endpoints[i] for i in near)}
    return base, sorted(reported), pairs


def _join(spans: list[Span]) -> str:
    return ",".join(map(str, spans))


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_links, links for every row; columns of docs beside these two aren't read.

    A null or empty text has no spans: zero counts, the digest of nothing, an empty string. Repeated rows keep their rows; an empty table gives an
    empty result. spans is kind:start:end in code points, end exclusive, by start and then kind; links pairs an identifier with a secret.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def report(text: str | None) -> tuple:
        base, spans, pairs = scan(text)
        n = [sum(s.kind == k for s in base) for k in range(3)]
        return *n, sha256(_join(base).encode()).hexdigest(), _join(spans), len(pairs), ",".join(f"{a}>{b}" for a, b in pairs)

    return map_texts(rows, lambda: report, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_links long, links string")
