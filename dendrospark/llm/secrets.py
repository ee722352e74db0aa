"""Secret scans: keyword prefilter, anchored patterns near hits, embedded checksums.

An Aho-Corasick automaton finds the keywords of every rule in one pass over a
text. A rule's pattern is tried only where its keyword stands, anchored there,
so text without keywords costs one automaton pass. Rules whose secret embeds a
checksum or has an inner structure are kept only if that holds.

Base kinds (``assign``, ``access``, ``hex``) follow fixed patterns and are
always reported. Further kinds add spans, which may lie inside a base span (a
token that is assigned is reported as both):

* ``github``, ``npm``: ``ghp_``/``gho_``/``ghu_``/``ghs_``/``ghr_``/``npm_`` and 36
  base-62 characters, of which the last six are the CRC-32 of the first thirty;
* ``jwt``: three base64url parts whose first decodes to a JSON object with ``alg``;
* ``pem``: a private-key block of any length from its BEGIN to its END line, with or
  without header lines; another BEGIN line in between ends the search.

``hex`` has no keyword; maximal runs of 24 or more hex digits are its matches.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import mapped, slices

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")
BASE = KINDS[:3]
# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
PEM_BODY = re.compile(r"\s*+((?:[A-Za-z][A-Za-z0-9-]*+:[^\n]*+\n)*+)([A-Za-z0-9+/=\s]*+)")  # possessive: each character is read once
PEM_LEAST = 16
TOKEN = re.compile(r"[A-Za-z0-9_-]*+")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "pem",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        *[T.StructField(f"n_{k}", T.LongType()) for k in BASE],
        T.StructField("found", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
    ]
)


@cache
def automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        auto.add_word(word, (len(word), kind))
    auto.make_automaton()
    return auto


def checksum_ok(body: str) -> bool:
    """Whether the last six base-62 digits are the CRC-32 of what stands before them."""
    crc, digits = zlib_crc(body[:-6]), ""
    for _ in range(6):
        crc, low = divmod(crc, 62)
        digits = BASE62[low] + digits
    return digits == body[-6:]


def zlib_crc(text: str) -> int:
    return binascii.crc32(text.encode())


def jwt_ok(head: str) -> bool:
    try:
        parsed = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(parsed, dict) and "alg" in parsed


def pem_ok(text: str, start: int, end: int) -> bool:
    """Whether header lines, if any, and then ``PEM_LEAST`` or more characters of a key's body fill a place."""
    m = PEM_BODY.fullmatch(text, start, end)
    return bool(m) and end - (m.start(2) if m[1] else start) >= PEM_LEAST


def find(text: str) -> list[tuple[int, int, str, int]]:
    """Spans (start, order of kind, kind, end) of one text, by start, then kind."""
    low = text.encode().lower().decode()  # A-Z only, so positions stay
    near: dict[str, list[int]] = {}
    for last, (size, kind) in automaton().iter(low):
        near.setdefault(kind, []).append(last - size + 1)
    out: list[tuple[int, int, str, int]] = []
    end = 0
    for at in sorted(near.get("assign", ())):
        if at >= end and (m := ASSIGN.match(low, at)):
            end = m.end()
            if m.end(2) - m.start(2) >= 6:
                out.append((at, 0, "assign", end))
    end = 0
    for at in near.get("access", ()):
        if at >= end and (m := ACCESS.match(text, at)):
            end = m.end()
            if end - at >= 20:
                out.append((at, 1, "access", end))
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    for kind, pattern in (("github", GITHUB), ("npm", NPM)):
        end = 0
        for at in near.get(kind, ()):
            if at >= end and (m := pattern.match(text, at)) and checksum_ok(m[1]):
                end = m.end()
                out.append((at, KINDS.index(kind), kind, end))
    end = 0
    for at in near.get("jwt", ()):
        if at < end or not text.startswith("eyJ", at):
            continue
        # Only the first mark of a run of token characters can begin a token, so a run is read once.
        end = TOKEN.match(text, at).end()
        if (m := JWT.match(text, at)) and jwt_ok(m[1]):
            end = m.end()
            out.append((at, KINDS.index("jwt"), "jwt", end))
    begins = near.get("pem", [])
    for at, stop in zip(begins, [*begins[1:], len(text)], strict=False):
        if m := PEM.match(text, at):
            last = text.find(f"-----END {m[1]}-----", m.end(), stop)
            if last >= 0 and pem_ok(text, m.end(), last):
                out.append((at, KINDS.index("pem"), "pem", last + len(m[1]) + 14))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of base kinds, all spans, digest of base spans.

    A map over partitions, no shuffle. Null text counts as empty; repeated rows
    and null ids give a row each; very long texts are searched whole, in time linear
    in their length; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find(text) if text else []
                base = [s for s in spans if s[1] < len(BASE)]
                counts = [sum(s[1] == k for s in base) for k in range(len(BASE))]
                rows.append((*counts, [{"kind": s[2], "start": s[0], "end": s[3]} for s in spans], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True))
            span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], span), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], names=SCHEMA.names
            )

    return mapped(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), run, SCHEMA)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret replaced by ``mark``; overlapping spans are replaced once, ``n_chars`` follows where present.

    Every document stays and rows without secrets are unchanged.
    """
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def clean(text: str | None) -> str | None:
        spans = find(text) if text else []
        if not spans:
            return text
        parts, end = [], 0
        for start, _, _, stop in spans:
            if start >= end:
                parts += [text[end:start], mark]
            end = max(end, stop)
        return "".join([*parts, text[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            old = batch.column(at).to_pylist()
            new = [clean(t) for t in old]
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.string())
            if count is not None:
                was = cols[count].to_pylist()
                cols[count] = pa.array([n if a == b else len(b) for n, a, b in zip(was, old, new, strict=True)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return mapped(docs, run, docs.schema)
