"""Secret scans: keyword prefilter, anchored regular expressions near hits, embedded checksums.

An Aho-Corasick automaton finds the keywords in the ASCII-lower-cased text in one pass. Only where a keyword starts is
its kind's regular expression tried, anchored there. Long hexadecimal runs have no keyword; any run of 24 covers four
positions of a stride of six, so the strided text is searched for four such characters in a row and the run is read
off around a hit. Tokens that carry a checksum of their own (a CRC-32 in base 62 at the end) count only if it is right.

Base kinds, leftmost and non-overlapping per kind: assign, access, hex. Kinds that the method adds: checked (tokens with
a right checksum), jwt (three base64url parts whose first is a JSON header with "alg"), pem (private key blocks).
Spans are code points, end exclusive, of the whole match.

Nulls: a null text counts as empty. Rows are independent: repeated rows repeat, an empty table is empty.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame

from timberline.llm.common import map_texts

KINDS = ("assign", "access", "hex", "checked", "jwt", "pem")
BASE = KINDS[:3]
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LEAST = {"assign": 6, "access": 20, "hex": 24}
STRIDE = LEAST["hex"] // 4

#: Keyword (lower case) -> kind. A match of the kind starts where one of its keywords starts.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked",
    "eyj": "jwt",
    "-----begin ": "pem",
}
PATTERNS = {
    "assign": re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "checked": re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{16,}"),
    "pem": re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[^-]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----"),
}
HEX_RUN = re.compile(r"[0-9a-f]+")
HEX_BACK = re.compile(r"[0-9a-f]*")
HEX_STRIDED = re.compile(r"[0-9a-f]{4,}")
LOWER = {c: c + 32 for c in range(65, 91)}


def base62_crc(data: str) -> str:
    n, out = zlib.crc32(data.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def json_header(part: str) -> bool:
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
    except (ValueError, TypeError):
        return False


def holds(kind: str, m: re.Match) -> bool:
    """The validation behind a kind's match."""
    if kind == "assign":
        return len(m[2]) >= LEAST["assign"]
    if kind == "access":
        return m.end() - m.start() >= LEAST["access"]
    if kind == "checked":
        return base62_crc(m[1]) == m[2]
    return kind != "jwt" or json_header(m[1])


def keyword_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def hex_runs(text: str) -> list[tuple[int, int]]:
    found = []
    for m in HEX_STRIDED.finditer(text[::STRIDE]):
        at, last = m.start() * STRIDE, m.end() * STRIDE
        while at < last:  # the strided hit may go over several runs
            start = at - HEX_BACK.match(text[max(0, at - STRIDE) : at][::-1]).end()
            end = HEX_RUN.match(text, at).end()
            if end - start >= LEAST["hex"]:
                found.append((start, end))
            at = -(-end // STRIDE) * STRIDE
    return found


def scan(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans of a text as (start, kind's place, kind:start:end), in order."""
    if not text:
        return []
    past = dict.fromkeys(KINDS, 0)
    spans = [(s, KINDS.index("hex"), f"hex:{s}:{e}") for s, e in hex_runs(text)]
    low = text.lower()
    if len(low) != len(text):  # a letter that lower-cases to two; positions must stay
        low = text.translate(LOWER)
    for last, (length, kind) in automaton.iter(low):
        at = last - length + 1
        if at >= past[kind] and (m := PATTERNS[kind].match(text, at)):
            past[kind] = m.end()
            if holds(kind, m):
                spans.append((at, KINDS.index(kind), f"{kind}:{at}:{m.end()}"))
    return sorted(spans)


def digest(spans: list[tuple[int, int, str]]) -> tuple:
    n = [sum(1 for _, k, _ in spans if k == i) for i in range(3)]
    base = ",".join(s for _, k, s in spans if k < len(BASE))
    return (*n, hashlib.sha256(base.encode()).hexdigest(), ",".join(s for *_, s in spans))


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans. No shuffle."""

    def make():
        automaton = keyword_automaton()
        return lambda texts: [digest(scan(t, automaton)) for t in texts]

    return map_texts(docs, text, {"doc_id": doc_id}, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make)
