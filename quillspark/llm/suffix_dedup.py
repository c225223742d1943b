"""Exact substring removal over suffixes sorted in two stages.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller id.
Sorting every suffix of a corpus together would move each byte fifty times, so suffixes are first
thinned out without losing a match: each LENGTH-byte window is filed under the smallest hash of
the SEED-byte strings in it. Equal windows have equal hashes; a run of neighbouring windows with
the same hash is a fragment, about one for 15 bytes. Three passes follow:

1. Fragments meet by hash. Where a hash is shared by fragments of several documents, these are asked
   for; all else ends here. A map task sends no fragment twice: of a chunk's fragments with equal
   bytes those of later documents are covered at once, so that a passage in a third of all
   documents reaches no task as a third of all rows.
2. The bytes of the fragments asked for meet by hash. Equal ones become one, and the suffixes of all
   are sorted: directly those smaller than their successor, the rest induced by a scan over buckets
   of the first byte; common prefixes of neighbours in this order give classes of equal windows,
   and their smallest id. Hashes only bring fragments together: what is covered has been compared
   byte by byte. There are as many hash ranges as there are RANGE bytes of text, so that what a task
   holds at a time does not grow with the corpus (but for a single hash shared by many fragments
   that differ, which are sorted together).
3. Covers join the texts and are cut out.

Odd rows: a null text is empty; a text under LENGTH bytes loses nothing; rows come back one for
one (an empty table gives none), and rows with equal ids never cover each other (an id stands for one text: of rows that share
an id but not the text, all lose what any of them would lose at the same place); a row with a null id loses nothing and
covers nothing; ids must be integers; extra columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, id_type

LENGTH, SEED = 50, 20
SLIDE = LENGTH - SEED + 1
#: Windows in a fragment at most (longer runs, in periodic text, are cut), and bytes handled at once.
MOST, CHUNK = 128, 2_000_000
#: Bytes of text for each hash range.
RANGE = 16 << 20
PAD = 64
U = np.uint64
C1, C2, C3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def words_at(b: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit words that start at each byte."""
    x = b[:-1].astype(np.uint16) | (b[1:].astype(np.uint16) << np.uint16(8))
    y = x[:-2].astype(np.uint32) | (x[2:].astype(np.uint32) << np.uint32(16))
    return y[:-4].astype(U) | (y[4:].astype(U) << U(32))


def mixed(x: np.ndarray, w: np.ndarray, c: np.uint64) -> np.ndarray:
    x = (x ^ w) * c
    return x ^ (x >> U(29))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have < w:
        step = min(have, w - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def fragments(texts: list[bytes]) -> tuple:
    """Of texts of LENGTH bytes or more: hash, content hash, text number, first window, windows; and a
    comparison of fragments by their bytes."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    b = np.frombuffer(b"".join(texts) + bytes(PAD), np.uint8)
    u = words_at(b)
    n = int(ends[-1])
    h = mixed(mixed(mixed(np.full(n, C3), u[:n], C1), u[8 : n + 8], C2), u[12 : n + 12], C3)
    low = sliding_min(h, SLIDE)
    low = low[: n - LENGTH + 1]
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
    ok = np.arange(len(low)) + LENGTH <= ends[owner]
    p = np.flatnonzero(ok)
    low, owner = low[p], owner[p]
    cut = np.ones(len(p), bool)
    cut[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(cut)
    runs = np.diff(np.append(starts, len(p)))
    if len(runs) and runs.max() > MOST:
        more = np.arange(len(p)) - np.repeat(starts, runs)
        starts = np.flatnonzero(more % MOST == 0)
        runs = np.diff(np.append(starts, len(p)))
    at, size = p[starts], runs + LENGTH - 1
    x = size.astype(U) * C2
    for j in range(0, int(size.max(initial=0)), 8):
        on = np.flatnonzero(size > j)
        if len(on) == len(x):
            x = mixed(x, u[np.minimum(at + j, at + size - 8)], C1)
        else:
            x[on] = mixed(x[on], u[np.minimum(at + j, at + size - 8)[on]], C1)
    who = owner[starts]

    def equal(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether fragments i and j, of as many windows, have the same bytes."""
        same = size[i] == size[j]
        for k in range(0, int(size[i].max(initial=0)), 8):
            on = np.flatnonzero(same & (size[i] > k))
            p, q = i[on], j[on]
            same[on] = u[np.minimum(at[p] + k, at[p] + size[p] - 8)] == u[np.minimum(at[q] + k, at[q] + size[q] - 8)]
        return same

    # a least hash is small; mixed once more, keys fill their range evenly
    return mixed(low[starts], C3, C2), x ^ (x >> U(32)), who, at - (ends - sizes)[who], runs, equal


def part_of(key: np.ndarray, parts: int) -> np.ndarray:
    return ((key >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def packed(cols: list[np.ndarray], kinds: list[str]) -> bytes:
    return len(cols[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c, k).tobytes() for c, k in zip(cols, kinds, strict=True))


def unpacked(blobs: list[bytes], kinds: list[str]) -> list[np.ndarray]:
    out = [[] for _ in kinds]
    for blob in blobs:
        n, at = int.from_bytes(blob[:8], "little"), 8
        for o, k in zip(out, kinds, strict=True):
            o.append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return [np.concatenate(o) if o else np.zeros(0, k) for o, k in zip(out, kinds, strict=True)]


#: key, id less the chunk's least, first window, windows
SENT = ["<u8", "<u4", "<u4", "u1"]
#: Records of a document's blobs, one after the other: first window, windows; with the key before.
COVER = np.dtype([("at", "<u4"), ("n", "u1")])
ASKED = np.dtype([("key", "<u8"), ("at", "<u4"), ("n", "u1")])
#: id, first byte, the hash's lower half, bytes
FETCHED = ["<i8", "<u4", "<u4", "<u2"]


def by_doc(doc: np.ndarray, cols: list[np.ndarray], kind: np.dtype) -> tuple[np.ndarray, pa.Array]:
    """Packs records by document: ids in order, and a blob of records for each, all cut from one buffer."""
    order = np.argsort(doc, kind="stable")
    doc, records = doc[order], np.empty(len(doc), kind)
    for name, c in zip(kind.names, cols, strict=True):
        records[name] = c[order]
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    offsets = np.append(edge, len(doc)).astype(np.int64) * kind.itemsize
    blobs = pa.Array.from_buffers(pa.large_binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(records.view(np.uint8))])
    return doc[edge], blobs.cast(pa.binary())


def records(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), kind)


def firsts(key: np.ndarray, frag: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order by key, content and id; in it, the place of the first of each record's (key, content)."""
    order = np.lexsort((doc, frag, key))
    k, f = key[order], frag[order]
    new = np.append(True, (k[1:] != k[:-1]) | (f[1:] != f[:-1])) if len(k) else np.zeros(0, bool)
    return order, np.flatnonzero(new)[np.cumsum(new) - 1] if len(k) else order


def send(parts: int):
    """Map side: fragments of each chunk of texts, packed by hash range, and the covers known at once."""

    def chunk(ids: list[int], texts: list[bytes]):
        key, frag, who, at, n, equal = fragments(texts)
        doc = np.array(ids, np.int64)[who]
        order, first = firsts(key, frag, doc)
        key, doc, at, n = (x[order] for x in (key, doc, at, n))
        late = doc > doc[first]
        late[late] = equal(order[late], order[first[late]])
        covers = by_doc(doc[late], [at[late], n[late]], COVER)
        key, doc, at, n = (x[~late] for x in (key, doc, at, n))
        low = int(doc.min(initial=0)) if len(doc) else 0
        wide = len(doc) and int(doc.max()) - low >= 1 << 32
        part = part_of(key, parts)
        edge = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
        for a, b in zip(edge, np.append(edge[1:], len(part)).astype(int) if len(part) else [], strict=True):
            for own in [np.arange(a, b)] if not wide else [np.array([i]) for i in range(a, b)]:
                base = int(doc[own].min())
                yield int(part[a]), base, packed([key[own], doc[own] - base, at[own], n[own]], SENT)
        for k, (d, blob) in enumerate(zip(covers[0].tolist(), covers[1].to_pylist(), strict=True)):
            yield -1 - (d + k) % parts, d, blob

    def run(batches):
        def rows():
            ids, texts, size = [], [], 0
            for batch in batches:
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    t = (t or "").encode()
                    if d is None or len(t) < LENGTH:
                        continue
                    ids.append(d), texts.append(t)
                    size += len(t)
                    if size >= CHUNK:
                        yield from chunk(ids, texts)
                        ids, texts, size = [], [], 0
            if texts:
                yield from chunk(ids, texts)

        yield from batched(rows(), [pa.int32(), pa.int64(), pa.binary()], ["part", "base", "blob"])

    return run


def batched(rows, types, names, most: int = 4_000_000):
    """Record batches of a bounded number of bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types, strict=True)], names)
            held, size = [], 0
    cols = zip(*held) if held else ([] for _ in types)
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


FOUND = "doc_id bigint, covers binary, asked binary"


def found_table(docs: np.ndarray | list, covers: pa.Array | None = None, asked: pa.Array | None = None) -> pa.Table:
    none = pa.nulls(len(docs), pa.binary())
    return pa.table({"doc_id": pa.array(docs, pa.int64()), "covers": none if covers is None else covers, "asked": none if asked is None else asked})


def meet(table: pa.Table) -> pa.Table:
    """One hash range: the fragments whose bytes have to be compared, as their hash has fragments of
    other documents."""
    part, base, blob = (table.column(c).to_pylist() for c in ("part", "base", "blob"))
    if part[0] < 0:  # covers found on the map side pass through
        return found_table(base, covers=table.column("blob"))
    key, doc, at, n = unpacked(blob, SENT)
    doc = doc + np.repeat(np.array(base, np.int64), [int.from_bytes(b[:8], "little") for b in blob])
    order = np.argsort(key, kind="stable")
    key, doc, at, n = (x[order] for x in (key, doc, at, n))
    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    ask = np.repeat(np.minimum.reduceat(doc, edge) < np.maximum.reduceat(doc, edge), np.diff(np.append(edge, len(key))))
    docs, asked = by_doc(doc[ask], [key[ask], at[ask], n[ask]], ASKED)
    return found_table(docs, asked=asked)


def fetch(parts: int):
    """The bytes of the fragments asked for, packed by hash range."""

    def rows(batches):
        for batch in batches:
            held: dict[int, list] = {}
            size = 0
            for d, t, asked in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                t = (t or "").encode()
                key, at, n = (records(asked, ASKED)[c] for c in ASKED.names)
                at, ends = at.tolist(), (at.astype(np.int64) + n + LENGTH - 1).tolist()
                for p, k, a, e in zip(part_of(key, parts).tolist(), (key & U(0xFFFFFFFF)).tolist(), at, ends, strict=True):
                    if e > len(t):  # of another text with this id
                        continue
                    held.setdefault(p, []).append((d, a, k, t[a:e]))
                    size += e - a
                if size > 1_000_000:
                    yield from sent(held)
                    held, size = {}, 0
            yield from sent(held)

    def sent(held):
        for p, x in held.items():
            d, a, k, t = zip(*x)
            yield p, packed([np.array(d), np.array(a), np.array(k), np.array([len(s) for s in t])], FETCHED) + b"".join(t)

    return lambda batches: batched(rows(batches), [pa.int32(), pa.binary()], ["part", "blob"])


def sorted_suffixes(t: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted positions of t, by the LENGTH bytes that follow, in two stages.

    t ends with PAD zeros, and so does each text in it. Positions smaller than their successor are
    sorted directly. The others follow from their successors: buckets of the first byte are scanned
    in ascending order, and each suffix in order puts its predecessor, if that is larger, at the next
    place of the predecessor's bucket. Besides the wanted positions only those needed to induce them
    take part."""
    n = len(t)
    nxt = np.append(t[1:], np.uint8(0))
    # a position compares to its successor as the next position does whose byte differs from the one after
    at = np.where(t != nxt, np.arange(n, dtype=np.int32), np.int32(n))[::-1]
    at = np.minimum.accumulate(at)[::-1]
    larger = np.append(t > nxt, False)[at]
    del at, nxt
    part = np.zeros(n, bool)
    todo = wanted
    while len(todo):  # successors of larger positions, until one is smaller than its own
        part[todo] = True
        todo = todo[larger[todo]] + 1
        todo = todo[~part[todo]]
    direct = np.flatnonzero(part & ~larger)
    u = words_at(np.concatenate([t, np.zeros(PAD, np.uint8)]))
    order = np.arange(len(direct))
    for j in range(48, -1, -8):
        order = order[np.argsort(u[np.minimum(direct[order] + j, n)].byteswap(), kind="stable")]
    direct = direct[order]
    del u, order
    heads = np.searchsorted(t[direct], np.arange(257))
    induced = part & larger
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        bucket, level = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(level):  # runs of one byte: each round one byte further to the left
            bucket.append(level)
            before = level[level > 0] - 1
            level = before[induced[before] & (t[before] == c)]
        bucket.append(direct[heads[c] : heads[c + 1]])
        waiting[c] = []
        here = np.concatenate(bucket)
        out.append(here)
        before = here[here > 0] - 1
        before = before[induced[before] & (t[before] > c)]
        order = np.argsort(t[before], kind="stable")
        before = before[order]
        cuts = np.searchsorted(t[before], np.arange(257))
        for x in np.unique(t[before]).tolist():
            waiting[x].append(before[cuts[x] : cuts[x + 1]])
    return np.concatenate(out)


def equal_before(t: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether the common prefix with the neighbour before is LENGTH bytes or more."""
    u = words_at(np.concatenate([t, np.zeros(PAD, np.uint8)]))
    same = np.zeros(len(order), bool)
    live = np.arange(1, len(order))
    for j in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        live = live[u[order[live] + j] == u[order[live - 1] + j]]
    same[live] = True
    return same


def compare(table: pa.Table) -> pa.Table:
    """One hash range: equal windows among the fragments, as covers."""
    found: dict[int, dict[bytes, list[tuple[int, int]]]] = {}
    for blob in table.column("blob").to_pylist():
        doc, at, key, size = unpacked([blob], FETCHED)
        pos = 8 + len(doc) * 18
        for d, a, k, n in zip(doc.tolist(), at.tolist(), key.tolist(), size.tolist(), strict=True):
            found.setdefault(k, {}).setdefault(blob[pos : pos + n], []).append((d, a))
            pos += n
    # where all fragments of a hash are the same bytes, nothing is left to sort
    doc_out, at_out, n_out, texts = [], [], [], {}
    for group in found.values():
        if len(group) > 1:
            texts |= group
            continue
        ((data, places),) = group.items()
        first = min(places)[0]
        for d, a in places:
            if d > first:
                doc_out.append(d), at_out.append(a), n_out.append(len(data) - LENGTH + 1)
    if texts:
        for out, more in zip((doc_out, at_out, n_out), windows_covered(texts), strict=True):
            out += more
    docs, covers = by_doc(np.array(doc_out, np.int64), [np.array(at_out, np.int64), np.array(n_out, np.int64)], COVER)
    return found_table(docs, covers=covers)


def windows_covered(texts: dict[bytes, list[tuple[int, int]]]) -> tuple[list[int], list[int], list[int]]:
    """Id, first window and number of windows of what is covered among differing texts at (id, place)."""
    body = list(texts)
    sizes = np.array([len(x) for x in body], np.int64)
    t = np.frombuffer(b"".join(x + bytes(PAD) for x in body), np.uint8)
    begin = np.cumsum(sizes + PAD) - sizes - PAD
    windows = sizes - LENGTH + 1
    owner = np.repeat(np.arange(len(body), dtype=np.int32), windows)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    wanted = begin[owner] + offset
    text_of = np.full(len(t), -1, np.int32)
    text_of[wanted] = owner
    order = sorted_suffixes(t, wanted)
    order = order[text_of[order] >= 0]
    least = np.array([min(x)[0] for x in texts.values()], np.int64)[text_of[order]]
    edge = np.flatnonzero(~equal_before(t, order))
    low = np.repeat(np.minimum.reduceat(least, edge), np.diff(np.append(edge, len(order))))
    first = np.empty(len(t), np.int64)
    first[order] = low
    low = first[wanted]
    doc_out, at_out, n_out = [], [], []
    cuts = np.append(np.cumsum(windows) - windows, len(owner))
    hit = np.unique(owner[low < np.array([max(x)[0] for x in texts.values()], np.int64)[owner]])
    for k in hit.tolist():
        w = low[cuts[k] : cuts[k + 1]]
        for d, a in texts[body[k]]:
            on = np.flatnonzero(w < d)
            if len(on):
                cut = np.flatnonzero(np.append(True, np.diff(on) > 1))
                runs = np.diff(np.append(cut, len(on)))
                doc_out += [d] * len(cut)
                at_out += (a + on[cut]).tolist()
                n_out += runs.tolist()
    return doc_out, at_out, n_out


def cut(batches):
    for batch in batches:
        rows = []
        for t, blobs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (t or "").encode()
            if not blobs:
                rows.append((len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                continue
            found = records(blobs, COVER)
            at = found["at"].astype(np.int64)
            change = np.bincount(np.minimum(at, len(data)), minlength=len(data) + 1)
            change -= np.bincount(np.minimum(at + found["n"] + LENGTH - 1, len(data)), minlength=len(data) + 1)
            gone = np.cumsum(change)[:-1] > 0
            left = np.frombuffer(data, np.uint8)[~gone].tobytes()
            spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(bool(len(gone) and gone[0]))
            rows.append((len(data), int(np.count_nonzero(gone)), spans, hashlib.sha256(left).hexdigest()))
        cols = list(zip(*rows)) if rows else [()] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.string(),), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row. parts: hash ranges,
    each handled in memory by one task at a time; one for RANGE bytes of text unless given, and eight
    times the shuffle partitions at least."""
    spark = docs.sparkSession
    tables = Tables(spark, "suffixes")
    body = docs.select("doc_id", "text")
    if parts is None:
        size = body.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(8 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE + 1)
    sent = body.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(send(parts), "part int, base bigint, blob binary")
    met = tables.write(sent.groupBy("part").applyInArrow(meet, FOUND), "met")
    del sent
    asked = met.where("asked is not null").groupBy("doc_id").agg(F.collect_list("asked").alias("asked"))
    near = body.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(asked, "doc_id").select("doc_id", "text", "asked")
    compared = tables.write(near.mapInArrow(fetch(parts), "part int, blob binary").groupBy("part").applyInArrow(compare, FOUND), "compared")
    del near
    covers = met.select("doc_id", "covers").unionByName(compared.select("doc_id", "covers")).where("covers is not null")
    covers = covers.groupBy("doc_id").agg(F.collect_list("covers").alias("covers"))
    joined = body.join(covers.withColumnRenamed("doc_id", "cover_id"), F.col("doc_id") == F.col("cover_id"), "left").select("doc_id", "text", "covers")
    return joined.mapInArrow(cut, f"doc_id {id_type(docs)}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


#: DuckDB SQL for remove_repeats(): all windows spelled out in hexadecimal.
ORACLE = f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, {2 * LENGTH}) as s from d, lateral (select unnest(range(0, greatest(0, length(h) // 2 - {LENGTH - 1}))) as i)),
c as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as m from w) where m < doc_id),
b as (select distinct doc_id, b from c, lateral (select unnest(range(i, i + {LENGTH})) as b)),
r as (select doc_id, count(*) as n, count(*) filter (where p is null or p < b - 1) as spans from (select doc_id, b, lag(b) over (partition by doc_id order by b) as p from b) group by doc_id),
k as (select a.doc_id, string_agg(substr(h, 2 * a.b + 1, 2), '' order by a.b) as h from (select doc_id, h, unnest(range(0, length(h) // 2)) as b from d) a left join b on b.doc_id = a.doc_id and b.b = a.b where b.b is null group by a.doc_id)
select d.doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(r.n, 0)::bigint as n_removed, coalesce(r.spans, 0)::bigint as n_spans, sha256(unhex(coalesce(k.h, ''))) as kept_sha256
from d left join r using (doc_id) left join k on k.doc_id = d.doc_id
"""
