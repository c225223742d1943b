"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of two neighbouring blocks of BLOCK words. Words are folded to
lower-case letters and digits and hashed into DIMS terms; document frequencies are counted over
all passages. A randomised SVD of all passages (of one block each) sums their projections on RANK random
directions in the tasks, term by direction, orthogonalises the sum and projects all passages on it once
more, which gives the matrix of their products in RANK columns (by Nystroem). The items' vectors are put
beside these columns, and the singular vectors of both together, from the small matrix of their products
on the driver, are the latent space. Sizes there depend on DIMS, RANK and ITEMS alone. Items,
which the search is for, weigh as much as all passages, so that the space keeps what tells them apart.

Every passage of every document is then projected and compared with all items (a stated query set,
in blocks of ITEMS, as many as RANK directions tell apart, each block with a space of its own; a
pass over the documents serves GROUP blocks). Cosines are to the passage's full norm, so
that words outside the space count against it. Candidates are checked on words: an item is found
if the longest common subsequence with the text around the passage covers COVER of the item, or
PARAPHRASE of it and its answer (the item's rarest words) is there too.

Odd rows: a null or empty text or item holds no words and is never found; rows come back one for
one, ids as they are; an item with a null id makes a text contaminated, but there is no id to list;
items with equal ids or texts are found each and listed once; item ids may be of any type that can
be ordered; an empty table gives an empty result, an empty benchmark leaves everything clean; extra
columns pass through. Items are dealt to spaces by id and text, so that a benchmark with the same
rows has the same spaces."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Tables, id_type

BLOCK, DIGITS, RANK = 24, 14, 96
DIMS = 1 << DIGITS
COSINE, COVER, PARAPHRASE, ANSWER = 0.15, 0.8, 0.6, 5
#: Items that share a space, and spaces that are broadcast for one pass over the documents. A space of
#: RANK directions holds about as many items; with more, cosines fall below COSINE.
ITEMS, GROUP = 100, 8
#: Parts in which sums over all terms come to the driver.
STRIPS = 32
#: Passages that are compared with the items of a space at once.
SLICE = 4096
#: Blocks whose terms are one row of the table of terms, and places from which a term's are added all at once there.
ROW, OFTEN = 1024, 16
#: Blocks whose words are added up at once.
SUMS = 512
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
BLANK = np.zeros(256, bool)
BLANK[list(b" \t\n\r\x0b\x0c")] = True
#: An odd multiplier and its inverse modulo 2^64, for the word hash.
P = 0x9E3779B97F4A7C15
P_INVERSE = pow(P, -1, 1 << 64)
CHUNK, FEW = 1 << 18, 1 << 13


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode().translate(None, PUNCTUATION)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return folded(text).split()


@lru_cache(3)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def up(m: int) -> np.ndarray:
        x = np.full(n + 1, m, np.uint64)
        x[0] = 1
        return np.multiply.accumulate(x)

    return up(P), up(P_INVERSE)


def term_numbers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The terms of a folded text, and where its words begin: a polynomial hash of each word from
    differences of one running sum, without a step for each word."""
    b = np.frombuffer(data, np.uint8)
    blank = BLANK[b]
    edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    # items and single passages need few powers, which is all that the driver ever asks for
    up, down = powers(FEW if len(b) <= FEW else max(CHUNK * 2, 1 << len(b).bit_length()))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[: len(b)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    return ((h * np.uint64(P)) >> np.uint64(64 - DIMS.bit_length() + 1)).astype(np.int64), starts


def terms_of(ws: list[bytes]) -> np.ndarray:
    return term_numbers(b" ".join(ws))[0]


def blocks(n: int) -> np.ndarray:
    """Block of each of n words; the last is never short, unless it is the only one."""
    return np.minimum(np.arange(n) // BLOCK, max(0, n // BLOCK - 1))


class Space:
    """What the tasks need: term weights, the projection, and the items in it."""

    def __init__(self, weights: np.ndarray, basis: np.ndarray, items: list[tuple[int, list[bytes]]], rare: dict[int, frozenset]):
        self.weights, self.rare, self.items = weights.astype(np.float32), rare, items
        self.where = [places(ws) for _, ws in items]
        self.rows = (basis * self.weights[:, None]).astype(np.float32)
        q = []
        for _, ws in items:
            t = terms_of(ws)
            full = np.linalg.norm(tf(t) * self.weights) if len(t) else 0.0
            q.append(self.rows[t].sum(axis=0) / full if full else np.zeros(basis.shape[1], np.float32))
        self.queries = np.array(q, np.float32).reshape(len(items), basis.shape[1])


def tf(t: np.ndarray) -> np.ndarray:
    return np.bincount(t, minlength=DIMS).astype(np.float32)


def passages(t: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the terms of several texts: each word's block (numbered through), and each block's text."""
    cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    size = np.diff(np.append(cut, len(doc)))
    own = np.concatenate([blocks(n) for n in size.tolist()]) if len(size) else np.zeros(0, np.int64)
    many = np.maximum(1, size // BLOCK)
    return own + np.repeat(np.cumsum(many) - many, size), np.repeat(doc[cut], many)


def sorted_keys(block: np.ndarray, t: np.ndarray) -> np.ndarray:
    """block * DIMS + t in order, in 32 bits where these do (with a block to spare)."""
    return np.sort((block * DIMS + t).astype(np.int32 if block[-1] < (1 << 31) // DIMS - 2 else np.int64))


def lcs(a: list[bytes], where: dict[bytes, int], size: int) -> int:
    """Length of the longest common subsequence of a and a text given by its words' position bits."""
    row, full = (1 << size) - 1, (1 << size) - 1
    for bits in filter(None, map(where.get, a)):
        hit = row & bits
        row = ((row + hit) | (row - hit)) & full
    return size - row.bit_count()


def places(item: list[bytes]) -> dict[bytes, int]:
    """The places of each word of an item, as bits."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    return where


def verified(item: list[bytes], rare: frozenset, text: list[bytes], where: dict[bytes, int] | None = None) -> bool:
    where = where or places(item)
    here = where.keys() & text
    # no more words are in common than there are places of words that the text has at all
    if sum(where[w].bit_count() for w in here) < min(COVER, PARAPHRASE) * len(item):
        return False
    common = lcs(text, where, len(item))
    return common >= COVER * len(item) or common >= PARAPHRASE * len(item) and rare <= set(text)


def survey(docs: DataFrame) -> tuple[np.ndarray, int, np.ndarray]:
    """Of all passages of all texts: how many have each term, their number, and their columns().

    One pass over the texts writes the passages' terms; a task returns a vector of fixed size besides,
    and these are added up in a few tasks first."""

    def run(batches):
        total, n = np.zeros(DIMS, np.int64), 0

        def out(df, count, terms, starts):
            return pa.RecordBatch.from_arrays([pa.array([df], pa.binary()), pa.array([count], pa.int64()), pa.array([terms], pa.binary()), pa.array([starts], pa.binary())], ["df", "n", "terms", "starts"])

        for batch in batches:
            for t, doc in tokenised(batch.column(0).to_pylist()):
                if not len(t):
                    continue
                block, _ = passages(t, doc)
                n += int(block[-1]) + 1
                key = sorted_keys(block, t)
                total += np.bincount(key[np.append(True, key[1:] != key[:-1])] & (DIMS - 1), minlength=DIMS)
                cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(t))
                for i in range(0, len(cuts) - 1, ROW):
                    part = cuts[i : i + ROW + 1]
                    yield out(None, None, t[part[0] : part[-1]].astype("<u2").tobytes(), (part[:-1] - part[0]).astype("<i4").tobytes())
        yield out(total.astype("<i8").tobytes(), n, None, None)

    tables = Tables(docs.sparkSession, "latent")
    seen = tables.write(docs.select("text").mapInArrow(run, "df binary, n bigint, terms binary, starts binary"), "survey")
    df, n = np.zeros(DIMS, np.int64), 0
    for r in tree_sum(seen.where("df is not null").select("df", "n"), "<i8", 8).toLocalIterator():
        df, n = df + np.frombuffer(r.df, "<i8"), n + r.n
    own = columns(seen.where("terms is not null").select("terms", "starts"), idf(df, n)) if n else np.zeros((DIMS, 0), np.float32)
    tables.drop(seen)
    return df, n, own


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((n + 1) / (df + 1)) + 0.05


def tree_sum(df: DataFrame, kind, parts: int) -> DataFrame:
    def add(batches):
        total, n = None, 0
        for batch in batches:
            for v, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(v.as_buffer(), kind)
                total, n = x.copy() if total is None else total + x, n + k
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["df", "n"])

    return df.repartition(parts).mapInArrow(add, "df binary, n bigint")


def tokenised(texts: list):
    """Terms of texts and the row each belongs to, about CHUNK bytes at a time; whole texts."""
    held, rows, size = [], [], 0

    def out():
        t, at = term_numbers(b"\n".join(held))
        cuts = np.cumsum([len(x) + 1 for x in held])
        return t, np.array(rows, np.int64)[np.searchsorted(cuts, at, side="right")]

    for i, text in enumerate(texts):
        data = folded(text)
        if data:
            held.append(data), rows.append(i)
            size += len(data)
        if size >= CHUNK:
            yield out()
            held, rows, size = [], [], 0
    if held:
        yield out()


def block_sums(rows: np.ndarray, t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows[t] over blocks that begin at starts: one word of every block at a time, the longest
    blocks first, so that those with a word there are the first ones."""
    size = np.diff(np.append(starts, len(t)))
    by = np.argsort(-size, kind="stable")
    total = np.empty((len(starts), rows.shape[1]), rows.dtype)
    hold = np.empty((min(SUMS, len(starts)), rows.shape[1]), rows.dtype)
    for i in range(0, len(by), SUMS):
        some = by[i : i + SUMS]
        first, falling = starts[some], -size[some]
        sums = rows[t[first]]
        for k, on in enumerate(np.searchsorted(falling, -np.arange(1, -falling[0])).tolist(), 1):
            sums[:on] += rows.take(t[first[:on] + k], 0, hold[:on], "clip")
        total[some] = sums
    return total


def add_terms(total: np.ndarray, latent: np.ndarray, term: np.ndarray, block: np.ndarray) -> None:
    """Adds latent[block] to total[term], of terms in order: one place of every term at a time, the most
    frequent first; terms with OFTEN places or more all at once, by how often they are in each block."""
    first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    size = np.diff(np.append(first, len(term)))
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    often = int(np.searchsorted(-size, -OFTEN, side="right"))
    for i in range(0, often, SUMS):
        start, n = first[i : min(often, i + SUMS)], size[i : min(often, i + SUMS)]
        at = np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())
        times = np.bincount(np.repeat(np.arange(len(n)) * len(latent), n) + block[at], minlength=len(n) * len(latent))
        total[term[start]] += times.astype(latent.dtype).reshape(len(n), -1) @ latent
    first, size = first[often:], size[often:]
    if len(first):
        hold, sums = np.empty((len(first), latent.shape[1]), latent.dtype), latent.take(block[first], 0)
        for k in range(1, int(size[0])):
            on = int(np.searchsorted(-size, -k))
            sums[:on] += latent.take(block[first[:on] + k], 0, hold[:on], "clip")
        total[term[first]] += sums


def gram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x-transposed y in double precision, strip by strip, so that no wider copy of either is made."""
    return sum((a.T.astype(np.float64) @ b for a, b in zip(np.split(x, STRIPS), np.split(y, STRIPS), strict=True)), np.zeros((x.shape[1], y.shape[1])))


def turned(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """x times by, strip by strip."""
    out = np.empty((len(x), by.shape[1]), np.float32)
    for to, part in zip(np.split(out, STRIPS), np.split(x, STRIPS), strict=True):
        to[:] = part @ by
    return out


def orthonormal(x: np.ndarray) -> np.ndarray:
    """Orthonormal columns with the range of x, from the small matrix of its columns' products; twice,
    as the first time leaves the rounding of nearly equal columns."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(gram(x, x))
        on = values > 1e-12 * values.max()
        x = turned(x, vectors[:, on] / np.sqrt(values[on]))
    return x


def columns(terms: DataFrame, weights: np.ndarray) -> np.ndarray:
    """RANK columns F such that F times F-transposed is close to A-transposed A, the products of the terms'
    weights over all passages A (terms, starts), each passage of length one."""
    spark = terms.sparkSession
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))

    def times(right: np.ndarray) -> np.ndarray:
        """A-transposed A times right, added up from the tasks' rows of A."""
        given, shape = spark.sparkContext.broadcast(right), right.shape

        def run(batches):  # knows the shape alone: with the matrix it would carry that a second time
            w, total = shared.value, np.zeros(shape, np.float32)
            rows = given.value * w[:, None]
            for batch in batches:
                for blob, cut in zip(batch.column(0), batch.column(1), strict=True):
                    t, starts = np.frombuffer(blob.as_buffer(), "<u2").astype(np.int32), np.frombuffer(cut.as_buffer(), "<i4").astype(np.int64)
                    m = len(starts)
                    # each term's blocks, term by term
                    key = np.sort((t << m.bit_length()) + np.repeat(np.arange(m, dtype=np.int32), np.diff(np.append(starts, len(t)))))
                    term, block = key >> m.bit_length(), key & ((1 << m.bit_length()) - 1)
                    edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                    c = np.diff(np.append(edge, len(key))).astype(np.float32)
                    norm = np.bincount(block[edge], (c * w[term[edge]]) ** 2, m)
                    latent = (block_sums(rows, t, starts) / norm[:, None]).astype(np.float32)
                    add_terms(total, latent, term, block)
            total *= w[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(range(STRIPS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, STRIPS)], pa.binary())], ["strip", "v"])

        def add(batches):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    x = np.frombuffer(v.as_buffer(), np.float32)
                    sums[k] = sums[k] + x if k in sums else x
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["strip", "v"])

        # added up strip by strip before the driver sees it: of fixed size, whatever the corpus
        strips = terms.mapInArrow(run, "strip int, v binary").repartition(STRIPS, "strip").mapInArrow(add, "strip int, v binary")
        total = np.empty(shape, np.float32)
        for r in strips.collect():
            np.split(total, STRIPS)[r.strip][:] = np.frombuffer(r.v, np.float32).reshape(-1, shape[1])
        given.destroy()
        return total

    q = orthonormal(times(np.random.default_rng(7).standard_normal((DIMS, min(RANK, DIMS)), np.float32)))
    onto = times(q)
    values, vectors = np.linalg.eigh(gram(q, onto))
    on = values > 1e-6 * values.max()
    shared.destroy()
    return turned(onto, vectors[:, on] / np.sqrt(values[on]))


def fit(seen: tuple[np.ndarray, int, np.ndarray], items: list[tuple[int, list[bytes]]]) -> Space:
    """The space of one block of items; seen is what survey() found in the documents."""
    df, n, own = seen
    weights = idf(df, n)
    vectors = np.array([tf(terms_of(ws)) * weights for _, ws in items if ws], np.float32).reshape(-1, DIMS)
    vectors *= (max(1.0, n / max(1, len(vectors))) ** 0.5 / np.maximum(1e-12, np.linalg.norm(vectors, axis=1)))[:, None]
    both = np.concatenate([own, vectors.T], axis=1)
    # the RANK largest singular vectors, from the small matrix of the columns' products
    values, turns = np.linalg.eigh(gram(both, both))
    on = np.flatnonzero(values > 1e-9 * max(1e-300, values.max(initial=0.0)))[-RANK:]
    q = turned(both, turns[:, on] / np.sqrt(values[on]))
    rare = {}
    for k, (_, ws) in enumerate(items):
        known = sorted(set(ws))
        count = dict(zip(known, df[terms_of(known)].tolist(), strict=True))
        rare[k] = frozenset(sorted(known, key=lambda w: (count[w], w))[: min(ANSWER, max(1, len(ws) // 4))])
    return Space(weights, q, items, rare)


def search(spaces: list[Space], texts: list) -> list[list[tuple[int, int]]]:
    """The items found in each text, as (space, index in it); the spaces have the same term weights."""
    found: list[set[tuple[int, int]]] = [set() for _ in texts]
    spaces = [s for s in spaces if s.items]
    if not spaces or not len(texts):
        return [[] for _ in texts]
    weights = spaces[0].weights
    for t, doc in tokenised(texts):
        if not len(t):
            continue
        block, text_of = passages(t, doc)
        n = len(text_of)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        # squared norms of one block, and of two together, over term frequencies
        pair = np.append(text_of[1:] == text_of[:-1], False)
        key = sorted_keys(block, t)
        cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        uniq, c = key[cut], np.diff(np.append(cut, len(key)))
        w2, at = weights[uniq & (DIMS - 1)] ** 2, uniq >> DIGITS
        one = np.bincount(at, c * c * w2, n)
        nxt = np.searchsorted(uniq, uniq + DIMS)
        ok = nxt < len(uniq)
        ok[ok] = uniq[nxt[ok]] == uniq[ok] + DIMS
        cross = np.bincount(at[ok], c[ok] * c[nxt[ok]] * w2[ok], n)
        norm = one.copy()
        norm[:-1][pair[:-1]] += one[1:][pair[:-1]]
        norm[pair] += 2 * cross[pair]
        least = (COSINE * np.sqrt(np.maximum(norm, 1e-9)))[:, None]
        first = np.searchsorted(text_of, text_of)
        cache: tuple[int, list[bytes]] = (-1, [])
        for s, space in enumerate(spaces):
            latent = block_sums(space.rows, t, starts)
            both = latent.copy()
            both[:-1][pair[:-1]] += latent[1:][pair[:-1]]
            m = len(space.items)
            hits = np.concatenate([np.flatnonzero(both[i : i + SLICE] @ space.queries.T >= least[i : i + SLICE]) + i * m for i in range(0, n, SLICE)])
            done = set()
            for b, k in zip((hits // m).tolist(), (hits % m).tolist(), strict=True):
                row = int(text_of[b])
                if (s, k) in found[row]:
                    continue
                if cache[0] != row:
                    cache = (row, words(texts[row]))
                ws = cache[1]
                size = len(space.items[k][1])
                at = (b - int(first[b])) * BLOCK
                a, e = max(0, at - size), at + 2 * BLOCK + size + BLOCK
                if (row, k, a) not in done and verified(space.items[k][1], space.rare[k], ws[a:e], space.where[k]):
                    found[row].add((s, k))
                done.add((row, k, a))
    return [sorted(x) for x in found]


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, list[bytes]]]]:
    """The items with words, in order, ITEMS at a time; each block is a query set of its own."""
    rows = ((r.item_id, words(r.text)) for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator())
    rows = (x for x in rows if x[1])
    while block := list(islice(rows, ITEMS)):
        yield block


def spaces_of(docs: DataFrame, benchmark: DataFrame) -> Iterator[list[Broadcast]]:
    """The broadcast spaces of the benchmark's blocks, GROUP at a time; documents are surveyed once."""
    spark, blocks, seen = docs.sparkSession, item_blocks(benchmark), None
    while group := list(islice(blocks, GROUP)):
        seen = seen or survey(docs)
        yield [spark.sparkContext.broadcast(fit(seen, items)) for items in group]


class Passes:
    """What one group of spaces leaves is written before the next, as no task can hold all spaces."""

    def __init__(self, docs: DataFrame):
        self.tables, self.group, self.last = Tables(docs.sparkSession, "decontaminate"), [], None

    def start(self, so_far: DataFrame, group: list[Broadcast]) -> DataFrame:
        if self.group:
            so_far = self.tables.write(so_far, "pass")
            for b in self.group:
                b.destroy()
            if self.last is not None:
                self.tables.drop(self.last)
            self.last = so_far
        self.group = group
        return so_far


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, items (ids of the benchmark items found, sorted), contaminated, for every row."""
    kind = f"array<{id_type(benchmark, 'item_id')}>"
    arrow = pa.list_(to_arrow_type(benchmark.schema["item_id"].dataType))
    found = docs.select("doc_id", "text", F.array().cast(kind).alias("items"), F.lit(False).alias("contaminated"))
    passes = Passes(docs)
    for group in spaces_of(docs, benchmark):
        found = passes.start(found, group)

        def run(batches, group=group):
            spaces = [b.value for b in group]
            for batch in batches:
                hits = search(spaces, batch.column(1).to_pylist())
                ids = [sorted({*old, *(i for s, k in x if (i := spaces[s].items[k][0]) is not None)}) for old, x in zip(batch.column(2).to_pylist(), hits, strict=True)]
                dirty = [old or bool(x) for old, x in zip(batch.column(3).to_pylist(), hits, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, arrow), pa.array(dirty, pa.bool_())], ["doc_id", "text", "items", "contaminated"])

        found = found.mapInArrow(run, f"doc_id {id_type(docs)}, text string, items {kind}, contaminated boolean")
    return found.drop("text")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, in which no benchmark item is found."""
    at, left = docs.columns.index("text"), docs
    passes = Passes(docs)
    for group in spaces_of(docs, benchmark):
        left = passes.start(left, group)

        def run(batches, group=group):
            spaces = [b.value for b in group]
            for batch in batches:
                found = search(spaces, batch.column(at).to_pylist())
                yield batch.filter(pa.array([not x for x in found], pa.bool_()))

        left = left.mapInArrow(run, docs.schema)
    return left
