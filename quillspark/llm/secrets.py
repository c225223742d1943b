"""Secret scanning: keyword automaton first, anchored patterns only near its hits, checksums last.

Kinds and their base patterns (leftmost, not overlapping within a kind, a match that fails its
check is dropped without a retry):
  assign  keyword, separator and a value of 8 or more characters; keywords in either ASCII case
  access  AKIA and upper-case letters or digits, 16 or more characters
  hex     lower-case hexadecimal digits, 32 or more
Added by the method: ``checked``, tokens of the form prefix_ + 30 letters or digits + 6 that are
the base-62 CRC-32 of these 30; only a matching checksum counts.

The automaton finds keywords and prefixes in one pass over the lower-cased bytes; patterns are
matched at the hits alone. A run of 32 hexadecimal digits covers four neighbouring positions of
every eighth, so that the hex pattern runs only where four such samples in a row are digits.

A null or empty text has no secrets; rows come back one for one; extra columns are not read."""

from __future__ import annotations

import hashlib
import re
import zlib

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_type

#: Keywords, token prefixes, and the digits of base 62 as the issuers order them.
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "checked")

ASSIGN = re.compile(rb"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"[a-z]{3}_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
HEX = re.compile(rb"[0-9a-f]{32,}")
SAMPLES = re.compile(rb"[0-9a-f]{4,}")


def base62(n: int, width: int = 6) -> bytes:
    out = ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS62[d] + out
    return out.rjust(width, "0").encode()


class Scanner:
    def __init__(self):
        self.find = ahocorasick.Automaton()
        for kind, words in (("assign", KEYWORDS), ("access", ("akia",)), ("checked", PREFIXES)):
            for w in words:
                self.find.add_word(w, (kind, len(w)))
        self.find.make_automaton()

    def hexes(self, data: bytes):
        # a run that counts lies between the samples before and after those in a row that it covers
        for m in SAMPLES.finditer(data[::8]):
            for run in HEX.finditer(data, max(0, 8 * m.start() - 7), 8 * m.end()):
                yield run.span()

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) in code points, sorted."""
        data = text.encode()
        ends = dict.fromkeys(KINDS, 0)
        found = [(a, 2, b) for a, b in self.hexes(data)]
        for last, (kind, size) in self.find.iter(data.lower().decode("latin-1")):
            at = last + 1 - size
            if at < ends[kind]:
                continue
            if kind == "assign":
                if m := ASSIGN.match(data, last + 1):
                    ends[kind] = m.end()
                    if len(m[1]) >= 8:
                        found.append((at, 0, m.end()))
            elif kind == "access":
                if m := ACCESS.match(data, at):
                    ends[kind] = m.end()
                    if m.end() - at >= 16:
                        found.append((at, 1, m.end()))
            elif m := CHECKED.match(data, at):
                if base62(zlib.crc32(m[1])) == m[2]:
                    ends[kind] = m.end()
                    found.append((at, 3, m.end()))
        found.sort()
        if found and len(data) != len(text):
            points, done, n = {}, 0, 0
            for b in sorted({x for a, _, e in found for x in (a, e)}):
                n += len(data[done:b].decode())
                done, points[b] = b, n
            found = [(points[a], k, points[e]) for a, k, e in found]
        return found


def spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Returns doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_checked for every row."""

    def run(batches):
        scanner = Scanner()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = scanner.scan(text or "")
                kinds = [k for _, k, _ in spans]
                base = spelled([x for x in spans if x[1] < 3])
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), spelled(spans), kinds.count(3)))
            cols = list(zip(*rows)) if rows else [()] * 6
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked"])

    schema = f"doc_id {id_type(docs)}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_checked bigint"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
