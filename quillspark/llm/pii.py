"""Personal data: base patterns, then bootstrapped contextual extraction.

The base finds four kinds by fixed patterns, leftmost and not overlapping within a kind; a match
that fails its check (parts, length, Luhn sum) is dropped without a retry. Patterns are written
with possessive quantifiers and a guard on where a match may begin, which changes no match but
keeps the time linear and the stack flat on very long texts.

The method then learns from the base matches. Instances are whole entities: the base spans, which are
seeds, and runs of identifier-like tokens (with a digit or an at sign) that touch none. An
instance's lexical patterns are its shape (letters and digits folded) between the words around it:
two to the left, one to the left and one to the right, or all three; words hold letters and stand
in the gap between identifiers, no further than EDGE characters off. Scores go back and forth over
the graph of distinct (pattern, instance) edges: a pattern's score for a kind is the summed score of
its instances over one more than their number, an instance's is the best of its patterns' (these are
parts of each other, and so no independent evidence), if that is CONFIDENT at least. A pattern is trusted with SEEDS distinct seeds, a score of SCORE, and GAIN of the way from chance
(the share of seeds of the kind among all instances of the shape) to certainty; instances that no
base span touches and that a trusted pattern holds become new spans. Only DataFrame functions are
used, and all of them are linear in a text's length, but for running sums, which go in blocks.

Odd rows: a null or empty text has no spans; rows come back one for one, repeated ids included (a
repeated row adds no distinct seed); extra columns are not read; offsets are code points, ends
exclusive; an empty table gives an empty result. Scores are rounded before they are compared, so
that the order of sums decides nothing; of kinds with equal scores the first in the list is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, by kind, and a substring or class without which there is no match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]++)++",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9]\S*+)*+"
#: A pattern counts from so many distinct seeds on, from this score on, and this far above chance; rounds of scoring.
SEEDS, SCORE, GAIN, ROUNDS = 4, 0.75, 0.6, 3
#: The score from which on a pattern speaks for its instances.
CONFIDENT = 0.5
#: Characters beside an instance in which its words are looked for; entries of a running sum that are added in one go.
EDGE, BLOCK = 48, 64

SPANS = "array<struct<s:int,e:int,m:string,l:string,r:string>>"


def running(sizes: Column) -> Column:
    """Running sums of an array, block by block, as appending to an array copies it."""
    n = F.size(sizes)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))

    def sums(xs: Column) -> Column:
        none = F.struct(F.lit(0).alias("p"), F.array().cast("array<int>").alias("o"))
        return F.aggregate(xs, none, lambda a, x: F.struct((a.p + x).alias("p"), F.array_append(a.o, a.p + x).alias("o")), lambda a: a.o)

    def joined(own: Column) -> Column:
        ends = sums(F.transform(own, lambda o: F.element_at(o, -1)))
        return F.flatten(F.transform(own, lambda o, b: F.transform(o, lambda v: v + F.coalesce(F.get(ends, b - 1), F.lit(0)))))

    return F.when(n > 0, F.transform(F.array(F.transform(blocks, sums)), joined)[0]).otherwise(F.array().cast("array<int>"))


def spans(text: Column, pattern: str, has: Column) -> Column:
    """All matches as array<struct<s, e, m, l, r>> with code-point offsets, where has holds; m is the
    match, l and r the ends of the gaps to its left and right.

    Matches come in order from one scan, the gaps between them from another; lengths add up to offsets."""
    found = F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))

    def placed(x: Column) -> Column:
        sizes = F.transform(x.m, lambda m, i: F.length(F.get(x.g, i)) + F.length(m))
        return F.transform(F.array(running(sizes)), lambda ends: F.transform(x.m, lambda m, i: F.struct(
            (ends[i] - F.length(m)).alias("s"), ends[i].alias("e"), m.alias("m"), F.right(F.get(x.g, i), F.lit(EDGE)).alias("l"), F.left(F.get(x.g, i + 1), F.lit(EDGE)).alias("r"))))[0]

    both = F.when(F.size(found) > 0, F.struct(found.alias("m"), F.split(text, pattern, -1).alias("g")))
    return F.when(both.isNotNull(), F.transform(F.array(both), placed)[0]).otherwise(F.array().cast(SPANS))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """True if the weighted digit sum, from the right, is a multiple of ten."""
    ds = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")

    def weigh(c, i):
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(ds, weigh), F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """The check that a base match of the kind has to pass."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.try_to_number(F.lpad(part(p), 3, "0"), F.lit("999")), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits(m)).between(12, 19) & luhn(F.right(digits(m), F.lit(19)))
    if kind == "phone":
        return F.length(digits(m)).between(9, 15)
    return F.lit(True)


ENTITY = "array<struct<s:int,k:int,e:int,m:string,l:string,r:string>>"


def base_entities(text: Column) -> Column:
    """ENTITY of all base matches, by start and then kind as listed."""

    def of(k: int, kind: str) -> Column:
        has = text.contains(NEEDS[kind]) if NEEDS[kind] else text.rlike("[0-9]")
        ok = F.filter(spans(text, PATTERNS[kind], has), lambda x: valid(kind, x.m))
        return F.transform(ok, lambda x: F.struct(x.s.alias("s"), F.lit(k).alias("k"), x.e.alias("e"), x.m.alias("m"), x.l.alias("l"), x.r.alias("r")))

    return F.sort_array(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def spelled(found: Column) -> Column:
    kind = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kind(x.k), x.s.cast("string"), x.e.cast("string"))), ",")


def candidates(text: Column) -> Column:
    """SPANS of runs of identifier-like tokens without the punctuation at their ends."""

    def trimmed(x):
        tail = F.regexp_replace(x.m, "^[^A-Za-z0-9+(]+", "")
        body = F.regexp_replace(tail, "[^A-Za-z0-9)]+$", "")
        at = x.s + F.length(x.m) - F.length(tail)
        return F.struct(at.alias("s"), (at + F.length(body)).alias("e"), body.alias("m"), x.l.alias("l"), x.r.alias("r"))

    return F.filter(F.transform(spans(text, TOKEN, text.rlike("[0-9@]")), trimmed), lambda x: F.length(x.m) >= 4)


def patterns(m: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """An instance's shape, and its lexical patterns."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, r"\p{L}+", "a"), r"[0-9]+", "9"), r"(?:[-. ()]*9){2,}", "9-9")
    words = lambda x: F.filter(F.split(F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}\s]", " ")), r"\s+"), lambda w: w.rlike(r"\p{L}"))
    lw, rw = words(left), words(right)
    l1, l2, r1 = F.get(lw, F.size(lw) - 1), F.get(lw, F.size(lw) - 2), F.get(rw, F.lit(0))
    each = F.array(F.concat(l2, F.lit(" "), l1, F.lit(" _ "), shape), F.concat(l1, F.lit(" _ "), shape, F.lit(" _ "), r1), F.concat(l2, F.lit(" "), l1, F.lit(" _ "), shape, F.lit(" _ "), r1))
    return shape, F.filter(each, lambda p: p.isNotNull())


def learned(seen: DataFrame) -> DataFrame:
    """seen (pattern, shape, inst, k; k null where the base found nothing) to trusted (pattern, kind, score)."""
    edges = seen.groupBy("pattern", "shape", "inst").agg(F.min("k").alias("k"))
    seeds = edges.where("k is not null").select("inst", "k", F.lit(1.0).alias("score")).distinct()
    sizes = edges.groupBy("pattern", "shape").agg(F.count("*").alias("n"))
    support = edges.where("k is not null").groupBy("pattern", "k").agg(F.count("*").alias("seeds"))
    # chance: how often an instance of the shape is one of the kind, whatever stands around it
    shapes = edges.groupBy("shape", "inst").agg(F.min("k").alias("k"))
    chance = shapes.where("k is not null").groupBy("shape", "k").count().join(shapes.groupBy("shape").agg(F.count("*").alias("all")), "shape").select("shape", "k", (F.col("count") / F.col("all")).alias("chance"))
    links, scores = edges.select("pattern", "inst"), seeds
    for _ in range(ROUNDS):
        rated = links.join(scores, "inst").groupBy("pattern", "k").agg(F.sum("score").alias("total")).join(sizes, "pattern")
        rated = rated.select("pattern", "shape", "k", F.round(F.col("total") / (F.col("n") + 1), 9).alias("score"))
        spread = links.join(rated.where(F.col("score") >= CONFIDENT), "pattern").groupBy("inst", "k").agg(F.max("score").alias("score"))
        scores = spread.unionByName(seeds).groupBy("inst", "k").agg(F.max("score").alias("score"))
    good = rated.join(support, ["pattern", "k"]).join(chance, ["shape", "k"]).where((F.col("seeds") >= SEEDS) & (F.col("score") >= SCORE))
    # of n instances at most n out of n + 1 are certain, so chance is held against that
    sure = good.join(sizes.select("pattern", "n"), "pattern").where(F.col("score") * (F.col("n") + 1) / F.col("n") >= F.col("chance") + GAIN * (1 - F.col("chance")))
    best = sure.groupBy("pattern").agg(F.max(F.struct("score", (-F.col("k")).alias("k"))).alias("b"))
    return best.select("pattern", (-F.col("b.k")).alias("kind"), F.col("b.score").alias("score"))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_learned for every row."""
    tables = Tables(docs.sparkSession, "pii")
    body = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    any_digit = F.col("text").rlike("[0-9@]")
    none, empty = F.array().cast(SPANS), F.array().cast(ENTITY)
    first = body.select("doc_id", F.when(any_digit, base_entities(F.col("text"))).otherwise(empty).alias("base"), F.when(any_digit, candidates(F.col("text"))).otherwise(none).alias("tokens"))
    rows = tables.write(first.select(F.monotonically_increasing_id().alias("rid"), "*"), "base")

    base, tokens = rows.select("rid", F.inline("base")), rows.select("rid", F.inline("tokens"))
    # candidates that touch a base span: both are filed under the stretches of text that they lie in
    stretches = F.explode(F.sequence(F.floor(F.col("s") / 64), F.floor((F.col("e") - 1) / 64))).alias("at")
    taken = base.select("rid", F.col("s").alias("bs"), F.col("e").alias("be"), stretches)
    touched = tokens.select("rid", "s", "e", stretches).join(taken, ["rid", "at"]).where("bs < e and s < be").select("rid", "s").distinct()
    free = tokens.join(touched, ["rid", "s"], "left_anti").withColumn("k", F.lit(None).cast("int"))
    shape, each = patterns(F.col("m"), F.col("l"), F.col("r"))
    both = base.select("rid", "s", "e", "m", "l", "r", "k").unionByName(free.select("rid", "s", "e", "m", "l", "r", "k"))
    seen = tables.write(both.select("rid", "s", "e", F.lower("m").alias("inst"), "k", shape.alias("shape"), F.explode(each).alias("pattern")), "seen")
    trusted = tables.write(learned(seen.select("pattern", "shape", "inst", "k")), "patterns")
    new = seen.where("k is null").join(trusted, "pattern").groupBy("rid", "s", "e").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
    more = new.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("b.k")).alias("k"), "e"))).alias("more"))
    cut = "array<struct<s:int,k:int,e:int>>"
    out = rows.select("rid", "doc_id", F.transform("base", lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"))).alias("base")).join(more, "rid", "left").withColumn("more", F.coalesce("more", F.array().cast(cut)))
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *(count(k) for k in range(4)), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(F.sort_array(F.concat("base", "more"))).alias("spans"), F.size("more").cast("bigint").alias("n_learned"))
