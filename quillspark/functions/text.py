"""Edit-distance scores over grapheme clusters, code points and words, as Catalyst expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("grapheme", "codepoint")
#: What str.split() takes for white space.
WHITE = r"[\x09-\x0D\x1C-\x1F\x20\x85\xA0  -     　]+"


@cache
def cluster_pattern() -> str:
    """A cluster: one character, then marks and joiners, and whatever follows a joiner or a virama
    (canonical combining class 9). The non-joiner extends a cluster but does not join."""
    viramas = "".join(f"\\x{{{c:X}}}" for c in range(0x110000) if unicodedata.combining(chr(c)) == 9)
    return rf"(?s).(?:[\p{{M}}\x{{200C}}\x{{200D}}]|(?<=[\x{{200D}}{viramas}]).)*"


#: What may extend a cluster; without any of these each code point is a cluster of its own.
EXTENDS = r"[\p{M}\x{200C}\x{200D}]"


def code_points(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def graphemes(text: Column) -> Column:
    return F.when(text.rlike(EXTENDS), F.regexp_extract_all(text, F.lit(cluster_pattern()), F.lit(0))).otherwise(code_points(text))


def grapheme_count(text: Column) -> Column:
    return F.when(text.rlike(EXTENDS), F.size(F.regexp_extract_all(text, F.lit(cluster_pattern()), F.lit(0)))).otherwise(F.length(text))


def words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """use(value), the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def token_distance(a: Column, b: Column) -> Column:
    """Edit distance of two token arrays: tokens become private code points, numbered within the pair."""

    def coded(tokens: Column, known: Column, codes: Column) -> Column:
        return F.array_join(F.transform(tokens, lambda t: F.get(codes, F.array_position(known, t).cast("int") - 1)), "")

    def code(_, i: Column) -> Column:
        return F.decode(F.unhex(F.lpad(F.hex((i + 0xF0000).cast("bigint")), 8, "0")), "UTF-32")

    def distance(p: Column, k: Column) -> Column:
        return F.levenshtein(coded(p.a, k.known, k.codes), coded(p.b, k.known, k.codes))

    def numbered(p: Column) -> Column:
        return bound(F.array_union(p.a, p.b), lambda known: bound(F.struct(known.alias("known"), F.transform(known, code).alias("codes")), lambda k: distance(p, k)))

    return bound(F.struct(a.alias("a"), b.alias("b")), numbered)


def units(text: Column, unit: str) -> Column:
    if unit == "grapheme":
        return graphemes(text)
    if unit == "word":
        return words(text)
    if unit == "codepoint":
        return code_points(text)
    raise ValueError(f"unit must be one of grapheme, codepoint, word; got {unit!r}")


def rate(errors: Column, length: Column) -> Column:
    """Errors over length; without any length 0 if there are no errors, else infinite. Unbounded above."""
    empty = F.when(errors == 0, F.lit(0.0)).otherwise(F.lit(float("inf")))
    return F.when(length == 0, empty).otherwise(errors / F.when(length != 0, length))


def score(reference: Column, hypothesis: Column, unit: str) -> Column:
    """struct<errors, length, unit>: never divided before it is summed."""
    ref, hyp = F.coalesce(reference, F.lit("")), F.coalesce(hypothesis, F.lit(""))
    if unit == "codepoint":
        return _scored(F.levenshtein(ref, hyp), F.length(ref), unit)
    return bound(F.struct(units(ref, unit).alias("a"), units(hyp, unit).alias("b")), lambda p: _scored(token_distance(p.a, p.b), F.size(p.a), unit))


def _scored(errors: Column, length: Column, unit: str) -> Column:
    return F.struct(errors.cast("bigint").alias("errors"), length.cast("bigint").alias("length"), F.lit(unit).alias("unit"))


def micro_average(scores: DataFrame, score_col: str, by: list[str]) -> DataFrame:
    """Summed errors over summed length for each group; scores of different units do not add up and
    raise an error."""
    s = F.col(score_col)
    total = scores.groupBy(*by).agg(F.sum(s.errors).alias("errors"), F.sum(s.length).alias("length"), F.min(s.unit).alias("unit"), F.max(s.unit).alias("other"))
    checked = F.when(F.col("unit") == F.col("other"), F.col("unit")).otherwise(F.raise_error(F.lit("scores of different units cannot be added")))
    return total.withColumn("unit", checked).drop("other").withColumn("rate", rate(F.col("errors"), F.col("length")))
