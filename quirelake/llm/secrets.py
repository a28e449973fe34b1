"""Secret scans: a keyword automaton finds candidates, anchored expressions and checksums decide.

An Aho-Corasick automaton runs once over the lower-cased text and reports where a keyword starts; only there an
expression is tried, anchored. Runs of hex digits have no keyword of their own, so their prefilter works on a
text in which every such digit is mapped to one letter: the keyword is a run of 24 of them. Tokens that embed a
checksum (six base-62 digits of the CRC-32 of what precedes) are reported only if it holds.

Kinds are searched independently, leftmost and without overlaps within a kind, as one pass of each
expression over the text would; a match that fails its condition still uses up its text.

Cases: null and empty texts have no spans. Positions are code points, ends exclusive. Repeated rows are reported
once each; extra columns are kept by ``find`` and dropped by ``report``.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.llm.common import lean

BASE = ("assign", "access", "hex")
#: Order of kinds at one start: the base kinds, then those the checksum adds.
KINDS = (*BASE, "github", "npm")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
# What starts a candidate, lower-cased, and the kind it may be.
_KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign",
    "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github",
    "ghr_": "github", "npm_": "npm",
}
_HEX_RUN = "h" * 24
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
# Every hex digit becomes "h", every other character something else; over bytes, and over characters.
_HEX_BYTES = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))
_HEX_CLASS = {ord("h"): ".", **{ord(c): "h" for c in "0123456789abcdef"}}
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


@functools.cache
def _hex_automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word(_HEX_RUN, len(_HEX_RUN))
    a.make_automaton()
    return a


def checksum_holds(body: str, digits: str) -> bool:
    """Whether six base-62 digits are the CRC-32 of ``body``."""
    crc = zlib.crc32(body.encode())
    want = ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        want = _DIGITS[d] + want
    return want == digits


def _lowered(text: str) -> str:
    """Lower case, character by character, so that positions hold."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def scan(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets in ``text``, by start, then in the order of ``KINDS``."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    starts = sorted((end - n + 1, kind) for end, (n, kind) in _automaton().iter(_lowered(text)))
    used = dict.fromkeys(KINDS, 0)
    for at, kind in starts:
        if at < used[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(text, at)
            ok = m and len(m[2]) >= 6
        elif kind == "access":
            m = _ACCESS.match(text, at)
            ok = m and len(m[0]) >= 20
        else:
            m = _CHECKED.match(text, at)
            ok = m and checksum_holds(m[1], m[2])
        if m:
            used[kind] = m.end()
        if ok:
            found.append((m.start(), m.end(), kind))
    over = 0
    some = _HEX_RUN.encode() in text.encode().translate(_HEX_BYTES)
    for end, n in _hex_automaton().iter(text.translate(_HEX_CLASS)) if some else ():
        start = end - n + 1
        if start >= over:
            m = _HEX.match(text, start)
            over = m.end()
            found.append((m.start(), m.end(), "hex"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array(
            [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t)] for t in texts.to_pylist()], _ARROW
        )


def _redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([redact(t) for t in texts.to_pylist()], pa.string())


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with every secret replaced; spans that overlap become one mark."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += (text[at:start], mark)
        at = max(at, end)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``docs`` plus the array of secrets in each text."""
    return lean(docs).withColumn(out, F.arrow_udf(_scanned, _TYPE)(F.col(text).cast("string")))


def redact_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with all secrets in ``text`` replaced by a mark."""
    return lean(docs).withColumn(text, F.arrow_udf(_redacted, "string")(F.col(text).cast("string")))


def _listed(spans: Column) -> Column:
    one = F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    return F.array_join(one, ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The digest per document of ``find``."""
    rows = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), out="__spans")
    spans = F.col("__spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s.kind == kind)).cast("bigint")
    base = F.filter(spans, lambda s: s.kind.isin(*BASE))
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"),
    )
