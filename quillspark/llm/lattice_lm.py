"""Language-model scoring: the likelihood of a text over all segmentations into subwords.

The vocabulary is an existing one: the pieces of a public subword file, with the marker that opens
a word, and single bytes as a way out. The file's scores are merge ranks, not log probabilities; a
piece's first probability is taken in proportion to one over its rank, and expectation-maximisation
on the training documents goes on from there until it converges: expected counts of pieces over the
lattices of all distinct training words (forward and backward recursions in log space), weighted by
how often each word occurs. No piece crosses a word's end, so a text's probability is the product
over its words and the end mark of the sum over all segmentations, found by a forward recursion in
log space. The recursions run over all words of a batch at once, one position of each at a time.

Word counts over all training documents come first, pre-aggregated in the tasks and summed in a
shuffle; the distinct words are then scored once. The words above a count that at most HOT (a fixed
number) reach, found from a histogram of counts, go to the tasks that read texts; every other
occurrence is sent to its word's row by a join and summed back, so that nothing that grows with the
corpus is broadcast or passes through one task, and no word is left out.

Odd rows: a null or empty text is its end mark alone; rows come back one for one, ids as they are
(a null id is in training, as its check sum is null); an empty table gives an empty result; with
no training document all counts are 0 and pieces keep their first probabilities; words of any
length and of characters outside the vocabulary are summed like any other, by their bytes; words
of equal counts are frequent together or not at all."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, id_type

FOLDS, HELD_OUT = 7, 2
#: Words sent to all tasks; entries that a task holds before it passes its counts on.
HOT, HELD = 300_000, 800_000
#: EM ends when a round raises the log likelihood by less than this share of it; rounds at most.
CONVERGED, ROUNDS = 1e-3, 60
MARK, END = "▁", "\x00end"
#: Added to every piece's count. Characters of words handled at once.
PRIOR, CHUNK = 0.1, 1 << 16


def pieces_of(path: str) -> dict[str, float]:
    """The subword pieces of a SentencePiece file that can stand inside one word (words have A-Z in
    lower case), and the rank that the file's score gives each, 1 the first."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, float] = {}
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or MARK in p[1:] or p.encode().lower() != p.encode()):
            out.setdefault(p, max(0.0, -sp.get_score(i)) + 1)
    return dict(sorted(out.items()))


class Numbers(dict):
    """Numbers of the frequent words; -1 for any other."""

    def __missing__(self, word: bytes) -> int:
        return -1


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64)


class Trie:
    """The pieces as a trie in arrays: nodes are their prefixes, node 0 the empty one."""

    def __init__(self, pieces: list[str]):
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        number = {"": 0} | {p: i + 1 for i, p in enumerate(prefixes)}
        self.letters = np.unique(code_points("".join(p[-1] for p in prefixes)))
        last = self.numbers(code_points("".join(p[-1] for p in prefixes)))
        keys = np.array([number[p[:-1]] for p in prefixes], np.int64) * (len(self.letters) + 1) + last
        order = np.argsort(keys)
        self.keys, self.child = keys[order], np.arange(1, len(prefixes) + 1)[order]
        self.piece = np.full(len(prefixes) + 1, -1, np.int64)
        self.piece[[number[p] for p in pieces]] = np.arange(len(pieces))
        self.inner = np.zeros(len(prefixes) + 1, bool)
        self.inner[[number[p[:-1]] for p in prefixes]] = True
        self.inner[0] = False

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The numbers of letters from 1, 0 for what stands in no piece."""
        if not len(self.letters):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        return np.where(self.letters[at] == codes, at + 1, 0)

    def step(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes' children by a letter, 0 where there is none."""
        if not len(self.keys):
            return np.zeros(len(nodes), np.int64)
        key = nodes * (len(self.letters) + 1) + letters
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (letters > 0), self.child[at], 0)


class Words:
    """The lattices of some words, each behind MARK, longest first. States are places between
    characters, numbered place by place: those of one place stand together, a word's state at the same
    offset in each, so that a step of all words is a slice."""

    def __init__(self, trie: Trie, words: list[str], sizes: np.ndarray):
        """words have falling sizes (with MARK)."""
        longest = int(sizes[0])
        self.many = len(sizes) - np.searchsorted(sizes[::-1], np.arange(longest + 1))  # words with each place
        self.at = np.cumsum(self.many) - self.many
        states = int(self.many.sum())
        self.place = np.repeat(np.arange(longest + 1), self.many)
        word = np.arange(states) - np.repeat(self.at, self.many)
        self.end = self.at[sizes] + np.arange(len(sizes))
        codes = code_points("".join([MARK + w for w in words]))
        inner = self.place < sizes[word]
        # the character after each state; there is none at a word's end
        code = np.zeros(states, np.int64)
        code[inner] = codes[(np.cumsum(sizes) - sizes)[word[inner]] + self.place[inner]]
        letters = trie.numbers(code)
        self.wide = np.where(inner, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 0)
        #: For each length the states where a piece of it begins, and the piece.
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        at, size = np.flatnonzero(inner & (letters > 0)), 1
        node = trie.step(np.zeros(len(at), np.int64), letters[at])
        while len(at):
            on = trie.piece[node] >= 0
            self.pieces.append((at[on], trie.piece[node[on]]))
            on = trie.inner[node] & (self.place[at] + size < sizes[word[at]])
            at, node = at[on], node[on]
            letter = letters[self.at[self.place[at] + size] + word[at]]
            node, size = trie.step(node, letter), size + 1
            on = node > 0
            at, node = at[on], node[on]

    def values(self, scores: np.ndarray, byte: float) -> list[np.ndarray]:
        """For bytes, and for each length of pieces, the log probability of the edge from each state."""
        out = [self.wide * byte]
        for at, piece in self.pieces:
            v = np.full(len(self.place), -np.inf)
            v[at] = scores[piece]
            out.append(v)
        return out

    def steps(self, j: int, n: int) -> list[tuple[int, slice]]:
        """The kinds of edges that end at place j, and the states that they come from."""
        return [(k, slice(self.at[j - max(1, k)], self.at[j - max(1, k)] + n)) for k in range(min(j, len(self.pieces)) + 1)]

    def forward(self, values: list[np.ndarray]) -> np.ndarray:
        """Of each state the log of the summed probability of all ways there."""
        a = np.zeros(len(self.place))
        for j in range(1, len(self.many)):
            n = int(self.many[j])
            x = np.empty((min(j, len(self.pieces)) + 1, n))
            for k, src in self.steps(j, n):
                np.add(a[src], values[k][src], out=x[k])
            top = x.max(axis=0)
            x -= top
            np.exp(x, out=x)
            a[self.at[j] : self.at[j] + n] = top + np.log(x.sum(axis=0))
        return a

    def carried(self, values: list[np.ndarray], a: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Backward: the expected passes through each edge, kinds as in values."""
        share = np.zeros(len(self.place))
        share[self.end] = weights
        out = [np.zeros(len(self.place)) for _ in values]
        for j in range(len(self.many) - 1, 0, -1):
            n = int(self.many[j])
            here = slice(self.at[j], self.at[j] + n)
            for k, src in self.steps(j, n):
                x = np.exp(a[src] + values[k][src] - a[here])
                x *= share[here]
                out[k][src] = x
                share[src] += x
        return out


class Lattice:
    """Forward and backward recursions over many words at once; scores hold the pieces' log
    probabilities in the trie's order, byte that of one byte."""

    def __init__(self, trie: Trie, scores: np.ndarray, byte: float):
        self.trie, self.scores, self.byte = trie, np.asarray(scores, np.float64), byte

    def chunks(self, words: list[str]):
        """Numbers and lattices of words, longest first, about CHUNK characters at a time."""
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        order = np.argsort(-sizes, kind="stable")
        cut = np.cumsum(sizes[order]) // CHUNK
        for part in np.split(order, np.flatnonzero(np.diff(cut)) + 1) if len(order) else []:
            yield part, Words(self.trie, [words[i] for i in part.tolist()], sizes[part])

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words))
        for part, w in self.chunks(words):
            out[part] = w.forward(w.values(self.scores, self.byte))[w.end]
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> tuple[np.ndarray, float, float]:
        """Expected counts of the pieces and of bytes, and the log likelihood, of weighted words."""
        counts, bytes_, total = np.zeros(len(self.scores)), 0.0, 0.0
        for part, w in self.chunks(words):
            values = w.values(self.scores, self.byte)
            a = w.forward(values)
            total += float(weights[part] @ a[w.end])
            by_byte, *by_piece = w.carried(values, a, weights[part])
            bytes_ += float(by_byte @ w.wide)
            for x, (at, piece) in zip(by_piece, w.pieces, strict=True):
                counts += np.bincount(piece, x[at], len(counts))
        return counts, bytes_, total


def log_scores(counts: np.ndarray, bytes_: float, ends: float) -> tuple[np.ndarray, float, float]:
    """Log probabilities of pieces, of one byte, and of the end mark; they sum to one."""
    total = math.fsum((counts + PRIOR).tolist()) + bytes_ + 256 * PRIOR + ends + PRIOR
    return np.log((counts + PRIOR) / total), math.log((bytes_ / 256 + PRIOR) / total), math.log((ends + PRIOR) / total)


def _expected(df: DataFrame, trie, model: tuple[np.ndarray, float, float]) -> tuple[np.ndarray, float, float]:
    """Expected counts over all rows (word, c): a row for each piece from each task, summed before the
    driver sees them, so that what reaches it is bounded by the vocabulary. Sums are exact fractions
    of 2^-20, so that their order doesn't matter."""
    scores, byte, _ = model
    given = df.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        lattice = Lattice(trie.value, given.value, byte)
        counts, bytes_, total = np.zeros(len(scores)), 0.0, 0.0
        for batch in batches:
            c, b, t = lattice.expected(batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(np.float64))
            counts, bytes_, total = counts + c, bytes_ + b, total + t
        at = np.flatnonzero(counts)
        values = [*counts[at].tolist(), bytes_, -total]
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1, -2], pa.int32()), pa.array([round(v * (1 << 20)) for v in values], pa.decimal128(38, 0))], ["piece", "v"])

    rows = df.select("word", "c").mapInArrow(run, "piece int, v decimal(38,0)").groupBy("piece").agg(F.sum("v").alias("v")).collect()
    given.destroy()
    sums = {r.piece: int(r.v) / (1 << 20) for r in rows}
    counts = np.zeros(len(scores))
    for k, v in sums.items():
        if k >= 0:
            counts[k] = v
    return counts, sums.get(-1, 0.0), -sums.get(-2, 0.0)


def fit(counts: DataFrame, trie, ranks: np.ndarray, ends: int, log: list | None = None) -> tuple[np.ndarray, float, float]:
    """EM from one over the ranks until a round adds less than CONVERGED of the log likelihood; log
    collects the likelihoods of the rounds."""
    first = 1 / ranks
    model = log_scores(first / max(first.sum(), 1e-300) * max(1, len(ranks)), 1.0, float(ends))
    before = -math.inf
    for _ in range(ROUNDS):
        pieces, bytes_, likelihood = _expected(counts, trie, model)
        if log is not None:
            log.append(likelihood)
        model = log_scores(pieces, bytes_, ends)
        if likelihood - before <= CONVERGED * abs(likelihood):
            break
        before = likelihood
    return model


def count_words(docs: DataFrame) -> DataFrame:
    """word, c: how often each word occurs in the texts; END counts the texts."""

    def run(batches):
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "c"])

        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update((text or "").encode().lower().split())
                held[END.encode()] += 1
                if len(held) > HELD:
                    yield out({w.decode(): c for w, c in held.items()})
                    held.clear()
        yield out({w.decode(): c for w, c in held.items()})

    return docs.select("text").mapInArrow(run, "word string, c bigint").groupBy("word").agg(F.sum("c").alias("c"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def score(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row. vocabulary:
    path of a SentencePiece file, read by the driver; its pieces (tens of thousands) are broadcast."""
    spark = docs.sparkSession
    tables = Tables(spark, "lattice")
    body = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    counts = tables.write(count_words(body.where(~F.col("held_out"))), "counts")
    facts = counts.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("c"))), F.lit(0)).alias("ends")).first()
    n, v, ends = facts.n, facts.v, facts.ends
    inside = counts.where(F.col("word") != END)
    pieces = pieces_of(vocabulary)
    trie = spark.sparkContext.broadcast(Trie(list(pieces)))
    model = fit(inside, trie, np.array(list(pieces.values()), np.float64), ends)
    shared = spark.sparkContext.broadcast(model)

    def rate(batches):
        scores, byte, _ = shared.value
        lattice = Lattice(trie.value, scores, byte)
        for batch in batches:
            logs = lattice.log_probabilities(batch.column(0).to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], ["word", "c", "lp"])

    # the least class of counts from which on there are no more than HOT words
    size = F.floor(F.log2("c") * 8).cast("int")
    classes = sorted(inside.groupBy(size.alias("k")).count().collect(), key=lambda r: -r.k)
    total, least = 0, None
    for r in classes:
        total += r["count"]
        if total > HOT:
            break
        least = r.k
    hot = [] if least is None else inside.where(size >= least).mapInArrow(rate, "word string, c bigint, lp double").collect()
    frequent = spark.sparkContext.broadcast([(r.word.encode(), r.c, r.lp) for r in hot])
    base_of = lambda c: math.log10((c + 1) / (n + 1 * (v + 1)))
    end_base, end_score = base_of(ends), model[2] / math.log(10)
    end_known = int(ends > 0)

    def read(batches):
        number = Numbers((w, i) for i, (w, *_) in enumerate(frequent.value))
        base_at, own_at = np.array([base_of(c) for _, c, _ in frequent.value]), np.array([lp for *_, lp in frequent.value])
        for batch in batches:
            cols = [[] for _ in range(4)]
            rare_words, rare_counts, ends_at = [], [], [0]
            for text in batch.column(2).to_pylist():
                ws = (text or "").encode().lower().split()
                ids = np.fromiter(map(number.__getitem__, ws), np.int32, len(ws))
                off = np.flatnonzero(ids < 0)
                rare = Counter([ws[i] for i in off.tolist()])
                ids = np.delete(ids, off)
                row = len(ws) + 1, len(ids) + end_known, end_base + float(base_at[ids].sum()), end_score + float(own_at[ids].sum())
                rare_words += rare
                rare_counts += rare.values()
                ends_at.append(len(rare_words))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            pairs = pa.StructArray.from_arrays([pa.array(rare_words, pa.binary()).cast(pa.string()), pa.array(rare_counts, pa.int64())], ["word", "k"])
            listed = pa.ListArray.from_arrays(pa.array(ends_at, pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True)), listed], ["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "own", "rare"])

    schema = f"rid bigint, doc_id {id_type(docs)}, held_out boolean, n_tokens bigint, n_known bigint, base double, own double, rare array<struct<word:string,k:bigint>>"
    numbered = body.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "held_out")
    rows = tables.write(numbered.mapInArrow(read, schema), "rows")
    rest = rows.select("rid", F.inline("rare"))
    known = inside.withColumnRenamed("word", "w")
    met = rest.join(known, rest.word == known.w, "left").select("rid", "word", "k", F.coalesce("c", F.lit(0)).alias("c"))
    base = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))

    def rate_rare(batches):
        scores, byte, _ = shared.value
        lattice = Lattice(trie.value, scores, byte)
        for batch in batches:
            once = batch.column("word").dictionary_encode()
            logs = lattice.log_probabilities(once.dictionary.to_pylist()) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("k"), batch.column("c"), pa.array(logs[once.indices.to_numpy()], pa.float64())], ["rid", "k", "c", "lp"])

    rated = met.mapInArrow(rate_rare, "rid bigint, k bigint, c bigint, lp double")
    tail = rated.groupBy("rid").agg(F.sum(F.col("k") * base).alias("tb"), F.sum(F.col("k") * F.col("lp")).alias("ts"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("tk"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.drop("rare").join(tail, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("tk")).alias("n_known"), F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("tb", F.lit(0.0))).alias("base_score"), (F.col("own") + F.coalesce("ts", F.lit(0.0))).alias("score"),
    )
