"""SimHash near duplicates by anchor-point covering.

Anchors are the words of a covering code of the 64-bit space: the words whose set-bit positions
XOR to zero (a Hamming code of the 63 positions 1..63, position 0 free). Its covering radius is 1,
and the positions' XOR (the syndrome) names the codewords near a fingerprint without a search.
Two fingerprints at distance 2 or less have a word between them that is within 1 of both, and an
anchor within the covering radius of that word; so each fingerprint is replicated to every anchor
within the radius plus half the threshold, 1 + 1 = 2: at most 33 of them. (Radius plus the whole
threshold would be 683 anchors each and finds the same links.)

Fingerprints, not documents, are compared: copies share one row. At an anchor a fingerprint is the
set of at most two positions by which it differs from the anchor, and two of them are within 2
if they share a position, if both have at most one, or if one is the anchor itself. So members are
hung on the smallest of each such position class; no pairs are spelled out, an anchor has at most
2,081 members, and no link between different fingerprints is lost for the components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, components, id_type

SEED, SHINGLE, BITS = 42, 3, 64


def fingerprint(text: str | None) -> int:
    """Signed 64-bit value; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: ASCII case and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    line = b" ".join(words)
    starts = [0]
    for w in words:
        starts.append(starts[-1] + len(w) + 1)
    h64 = xxhash.xxh64_intdigest
    last = min(SHINGLE, len(words))
    h = np.array([h64(line[a : b - 1], SEED) for a, b in zip(starts[:n], starts[last:], strict=True)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 4096):
        part = h[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (signed 64 bits) for every row; null texts are empty."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type(docs)}, fp bigint")


def replicas(fps: DataFrame) -> DataFrame:
    """fp, anchor, and the one or two positions (p, q; p <= q; null where fewer) by which they differ."""
    masks = [sum(1 << i for i in range(BITS) if i >> j & 1) for j in range(6)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    s = sum((F.bit_count(F.col("fp").bitwiseAND(F.lit(m))) % 2 * (1 << j) for j, m in enumerate(signed)), F.lit(0)).cast("int")
    none = F.lit(None).cast("int")
    one = F.array(F.struct(F.col("s").alias("p"), none.alias("q")))
    # all pairs of positions whose XOR is the syndrome; none where it is 0, but the word itself
    two = F.expr("transform(filter(sequence(0, 63), i -> i < (i ^ s)), i -> struct(i as p, i ^ s as q))")
    itself = F.array(F.struct(none.alias("p"), none.alias("q")))
    flips = F.when(F.col("s") == 0, F.concat(itself, one)).otherwise(F.concat(one, two))
    at = fps.withColumn("s", s).select("fp", F.inline(flips))
    bit = lambda c: F.coalesce(F.expr(f"shiftleft(1L, {c})"), F.lit(0))
    return at.withColumn("anchor", F.col("fp").bitwiseXOR(bit("p")).bitwiseXOR(bit("q")))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all of the distinct fingerprints fp within distance 2 of another."""
    members = replicas(fps).groupBy("anchor").agg(F.collect_list(F.struct("fp", "p", "q")).alias("m")).where("size(m) > 1")
    rows = members.select("anchor", F.inline("m"))
    # classes of positions: p and q; 64 holds those with one or none; the anchor itself is in all
    classes = F.when(F.col("p").isNull(), F.sequence(F.lit(0), F.lit(64))).when(F.col("q").isNull(), F.array("p", F.lit(64))).otherwise(F.array("p", "q"))
    small = rows.select("anchor", "fp", F.explode(classes).alias("c"))
    hung = small.groupBy("anchor", "c").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all")).where("size(all) > 1")
    return hung.select(F.explode("all").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Returns doc_id, fingerprint (16 hexadecimal digits), component_id for every row.

    component_id is the smallest doc_id reachable over links (fingerprints that differ in 2 bits or
    fewer), itself included. Texts without words have fingerprint zero and link like any other.
    Repeated rows come back as often as they came; a null id stays null and takes part in no
    minimum (a component of null ids alone has a null component_id)."""
    tables = Tables(docs.sparkSession, "simhash")
    prints = tables.write(fingerprints(docs), "prints")
    firsts = tables.write(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    roots = components(links(firsts.select("fp")), tables)
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of_fp = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
