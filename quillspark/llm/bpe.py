"""Byte-pair encoding by backtracking over longest matches, and decoding through an offset table.

An Aho-Corasick automaton of all token byte strings reads the longest vocabulary matches in a row in
one pass over a piece of text. The encoder takes the longest match, and keeps it only if it is
*compatible* with the token before it; else it tries the next shorter one (of the matches at a place
each begins the longer ones, so that a table by token gives it), and backs up when none is left; the
automaton reads on from places that the first pass did not come to.
Two neighbours are compatible if byte-pair merging of their joined bytes gives just these two; a
sequence in which all neighbours are compatible is the one that merging gives. Positions found
dead are marked, so that each (position, token) is tried once and time stays linear.

Results for odd rows: a null or empty text has no tokens; rows come back one for one, repeated
ids included, and a null id stays null; extra columns are not read."""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_type

#: The split pattern of byte-level BPE vocabularies (\s read as Unicode White_Space).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for text within Latin-1, whose letters, numbers and white space these classes list, as the plainer module does that faster.
LETTERS, NUMBERS, BLANKS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
#: Pieces this long are encoded anew each time; the cache of shorter ones holds two generations of at most CACHE entries.
LONG_PIECE, CACHE = 64, 200_000
#: Places of the table of answers about pairs (a power of two, eight bytes each), and texts that are encoded before their rows go on.
PAIRS, SLICE = 1 << 19, 512
#: What deals pairs to places; small, as products below 2 ** 30 are the fastest.
SPREAD = 10_007
#: No pair of ids, which are below 2 ** 31.
NO_PAIR = (1 << 64) - 1


def printable_bytes() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others moved up from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PairTable:
    """Whether token b may follow token a. Answers are kept in a table of fixed size, the pair and its
    answer in one number; a pair takes the place of an older one that falls on the same place."""

    def __init__(self, rank: dict[tuple[int, int], int], parts: dict[int, tuple[int, int]], born: dict[int, int]):
        self.rank, self.parts, self.born, self.known = rank, parts, born, array("Q", [NO_PAIR]) * PAIRS

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along the outer edge of a token's merge tree, each with the rank that consumes it."""
        out, eaten = [], float("inf")
        while True:
            out.append((token, eaten))
            if token not in self.parts:
                return out
            eaten, token = self.born[token], self.parts[token][side]

    def fits(self, a: int, b: int) -> bool:
        key, at = a << 31 | b, (a * SPREAD + b) & PAIRS - 1
        held = self.known[at]
        if held >> 1 == key:
            return bool(held & 1)
        # a merge across the border wins if it comes before both neighbours are consumed inside
        # their own tokens; of equal ranks the left one is applied first
        right = self.spine(b, 0)
        got = not any((r := self.rank.get((x, y))) is not None and r < until and r <= end for x, until in self.spine(a, 1) for y, end in right)
        self.known[at] = key << 1 | got
        return got


class Encoder(dict):
    """Maps a piece of text to its ids as little-endian 32-bit bytes; also the cache of pieces seen. When
    it is full it becomes the older generation, from which pieces seen again come back."""

    def __init__(self, spec: dict):
        super().__init__()
        self.older: dict[str, bytes] = {}
        model, code = spec["model"], printable_bytes()
        ids = model["vocab"]
        raw = {i: bytes(code[c] for c in t) for t, i in ids.items()}
        rank, parts, born = {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            whole = ids[a + b]
            rank[ids[a], ids[b]] = r
            if whole not in born:
                parts[whole], born[whole] = (ids[a], ids[b]), r
        self.pairs = PairTable(rank, parts, born)
        self.size = {i: len(b) for i, b in raw.items()}
        self.find = ahocorasick.Automaton()
        made = {b: i for i, b in raw.items() if i in born or len(b) == 1}
        for b, i in made.items():
            self.find.add_word(b.decode("latin-1"), i)
        self.find.make_automaton()
        # the next shorter match at the place of each, or -1
        self.shorter = {i: next((made[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in made), -1) for b, i in made.items()}
        self.any_pieces, self.latin_pieces = regex.compile(PIECES).findall, re.compile(LATIN).findall
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        raw |= {i: t.encode() for t, i in self.special.items()}
        last = max(raw)
        self.offsets = np.zeros(last + 2, np.int64)
        self.offsets[1:] = np.cumsum([len(raw.get(i, b"")) for i in range(last + 1)])
        self.blob = np.frombuffer(b"".join(raw.get(i, b"") for i in range(last + 1)), np.uint8)

    def piece(self, data: bytes) -> list[int]:
        size, fits, run, shown, n = self.size, self.pairs.fits, self.find.iter_long, data.decode("latin-1"), len(data)
        known, mask, spread, last, out = self.pairs.known, PAIRS - 1, SPREAD, -1, []
        for _, token in run(shown):
            if last >= 0:  # as fits(), but for a call where the answer is known
                held = known[last * spread + token & mask]
                if not (held & 1 if held >> 1 == last << 31 | token else fits(last, token)):
                    break
            out.append(token)
            last = token
        else:
            return out  # the longest matches in a row are compatible, as half of all pieces' are
        pos, dead, longest = sum(map(size.__getitem__, out)), set(), {}
        while pos < n:
            while token >= 0 and (pos + size[token] in dead or out and not fits(out[-1], token)):
                token = self.shorter[token]
            if token < 0:
                dead.add(pos)
                token = out.pop()  # the single bytes make some sequence fit, so there is one; its end is dead now
                pos -= size[token]
                continue
            out.append(token)
            pos += size[token]
            if pos < n:
                if pos not in longest:
                    for end, token in run(shown, pos):
                        start = end + 1 - size[token]
                        if start in longest:
                            break
                        longest[start] = token
                token = longest[pos]
        return out

    def __missing__(self, text: str) -> bytes:
        out = self.older.get(text)
        if out is None:
            out = array("I", self.piece(text.encode())).tobytes()
        if len(text) < LONG_PIECE:
            if len(self) >= CACHE:
                self.older = dict(self)
                self.clear()
            self[text] = out
        return out

    def split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.any_pieces(text)
        return self.latin_pieces(text)

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.split(text)))
        out = []
        for part in self.cut(text):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            else:
                out += map(self.__getitem__, self.split(part))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        tokens = np.frombuffer(ids, "<u4")
        first = self.offsets[tokens]
        sizes = self.offsets[tokens + np.uint32(1)] - first
        ends = np.cumsum(sizes)
        where = np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.blob[where].tobytes().decode("utf-8", "replace")


_made: dict[str, Encoder] = {}


def encoder(spec: str) -> Encoder:
    """One encoder for each vocabulary and worker process."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(json.loads(spec))
    return _made[key]


def encode_documents(docs: DataFrame, vocabulary: str, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes every whole text. vocabulary: path of a byte-level BPE file (JSON), read
    once by the driver and broadcast (its size is that of a fixed file, some MB). Returns doc_id,
    n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded text is the text), and with
    keep_ids the ids."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        enc = encoder(spec.value)
        for batch in (whole.slice(i, SLICE) for whole in batches for i in range(0, whole.num_rows, SLICE)):
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = enc.encode(text)
                back = enc.decode(ids)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text, ids))
            n, a, b, same, ids = zip(*rows, strict=True)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip"]
            if keep_ids:
                cols.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"doc_id {id_type(docs)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * keep_ids)
