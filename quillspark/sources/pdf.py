"""A small reader of PDF page trees, for Spark's binaryFile source: one row for each page.

Reads classic files: objects in clear or in flate-compressed object streams. It knows page counts,
media boxes and rotation, both inherited, and the text of simple content streams; it never fails
a job: a bad file is a row with the reason."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "path string, document string, total_pages int, page_index int, width double, height double, rotation int, text string, text_chars int, error string"

OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
BOX = re.compile(rb"/MediaBox\s*\[\s*([-0-9.]+)\s+([-0-9.]+)\s+([-0-9.]+)\s+([-0-9.]+)\s*\]")
REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|')|\[((?:[^\[\]\\]|\\.)*)\]\s*TJ", re.S)


class BadPdf(ValueError):
    pass


class Pdf:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise BadPdf("not a PDF")
        if re.search(rb"/Encrypt\b", data):
            raise BadPdf("encrypted PDFs are not supported")
        self.objects = {int(m[1]): m[3] for m in OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if re.search(rb"/Type\s*/ObjStm\b", body):
                self.unpack(body)
        kids = [n for n, b in self.objects.items() if re.search(rb"/Type\s*/Catalog\b", b)]
        if not kids:
            raise BadPdf("no catalogue")
        root = re.search(rb"/Pages\s+(\d+)\s+\d+\s+R", self.objects[kids[-1]])
        if not root or int(root[1]) not in self.objects:
            raise BadPdf("no page tree")
        self.pages: list[tuple[bytes, dict[str, bytes]]] = []
        todo, seen = [(int(root[1]), {})], set()
        while todo:
            number, given = todo.pop()
            body = self.objects.get(number)
            if body is None or number in seen:
                continue
            seen.add(number)
            own = dict(given)
            if m := BOX.search(body):
                own["box"] = m[0]
            if m := re.search(rb"/Rotate\s+([^/>\s]+)", body):
                own["rotate"] = m[1]
            if m := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
                todo += [(int(k), own) for k in reversed(REF.findall(m[1]))]
            elif re.search(rb"/Type\s*/Page\b(?!s)", body):
                self.pages.append((body, own))
        if not self.pages:
            raise BadPdf("PDF contains no pages")

    def stream(self, body: bytes) -> bytes:
        m = STREAM.search(body)
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]

    def unpack(self, body: bytes) -> None:
        n, first = (re.search(rb"/%s\s+(\d+)" % k, body) for k in (b"N", b"First"))
        try:
            data = self.stream(body)
            heads = [int(x) for x in data[: int(first[1])].split()][: 2 * int(n[1])]
        except (TypeError, ValueError, zlib.error):
            return
        ends = [*heads[3::2], len(data) - int(first[1])]
        for number, at, end in zip(heads[::2], heads[1::2], ends, strict=False):
            self.objects.setdefault(number, data[int(first[1]) + at : int(first[1]) + end])

    def page(self, i: int, limit: int) -> tuple[float, float, int, str, int]:
        body, given = self.pages[i]
        m = BOX.search(given.get("box", b""))
        x1, y1, x2, y2 = (float(v) for v in m.groups()) if m else (0.0, 0.0, 612.0, 792.0)
        try:
            rotation = int(given.get("rotate", b"0"))
        except ValueError:
            rotation = 0
        text = ""
        if limit > 0:
            found = re.search(rb"/Contents\s+(?:\[(.*?)\]|(\d+\s+\d+\s+R))", body, re.S)
            for ref in REF.findall(found[1] or found[2]) if found else ():
                try:
                    text += shown(self.stream(self.objects.get(int(ref), b"")))
                except zlib.error:
                    continue
        return abs(x2 - x1), abs(y2 - y1), rotation, text[:limit], len(text)


def shown(content: bytes) -> str:
    parts = []
    for one, several in SHOWN.findall(content):
        for s in [one] if one else re.findall(rb"\(((?:[^()\\]|\\.)*)\)", several):
            parts.append(re.sub(rb"\\([()\\])", rb"\1", s).decode("latin-1"))
    return "\n".join(parts)


def read_pages(spark: SparkSession, path: str, *, text_limit: int = 0, max_bytes: int = 120 << 20) -> DataFrame:
    """One row for each page of each file below path; files too large are refused unread, as their
    contents are pruned from the scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, length, content in zip(batch["path"], batch["length"], batch["content"], strict=True):
                document = re.sub(r"\.pdf$", "", name.rsplit("/", 1)[-1], flags=re.I)
                try:
                    if length > max_bytes:
                        raise BadPdf(f"larger than {max_bytes} bytes")
                    pdf = Pdf(bytes(content))
                    for i in range(len(pdf.pages)):
                        rows.append((name, document, len(pdf.pages), i, *pdf.page(i, text_limit), None))
                except (BadPdf, ValueError, zlib.error) as e:
                    rows.append((name, document, 0, None, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PAGES.split(", ")], dtype=object)
            yield out

    guarded = files.select("path", "length", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))
    return guarded.mapInPandas(run, PAGES)


def page_ref(job, page):
    """The reference that a task carries instead of bytes."""
    return F.concat(F.lit("pdf:"), job, F.lit("#"), page)
