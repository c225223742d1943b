"""A corpus pipeline of five training-data operators over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a
DataFrame, which is written as Parquet and read again; all but the last return the columns of
documents. Rows with a null id pass the stages that compare documents by id untouched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import bpe, decontaminate, line_dedup, quality, simhash
from quillspark.llm.common import Tables, table
from quillspark.llm.queries import vocabulary


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject go."""
    return quality.keep_good(docs)


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of similar lines stays; n_chars follows the text."""
    return line_dedup.dedup_lines(docs)


def one_of_a_kind(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: that with the smallest id. Rows with one id are one
    document: it stays or goes by any of its texts, and of rows that differ the one with the least hash
    over its columns stays, once. Documents left without words have equal fingerprints, and so one of
    them stays; rows with a null id stay."""
    first = simhash.near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    whole = F.xxhash64(*(docs[c] for c, kind in docs.dtypes if "map<" not in kind))
    least = docs.groupBy("doc_id").agg(F.min(whole).alias("__least")).join(first, "doc_id").withColumnRenamed("doc_id", "__first")
    kept = docs.join(least, (docs["doc_id"] == least["__first"]) & (whole == least["__least"]), "left_semi")
    return kept.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def unseen_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the check that they decode to the text."""
    out = bpe.encode_documents(docs, vocabulary("byte_bpe_50k.json"), keep_ids=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "round_trip", "ids")


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", fresh_lines),
    ("SimHash near-dedup", one_of_a_kind),
    ("benchmark decontamination", unseen_in_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: No SQL: SimHash, latent retrieval and byte-pair merges are beyond it; tests run brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents, a written table between each and the next."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = tables.write(stage(spark, docs, sf_dir), name.split()[0].lower())
        if hasattr(docs, "_quill_path"):
            tables.drop(docs)
        docs = done
    return docs
