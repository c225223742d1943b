"""What the training-data operators share: reading, shared-folder tables, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but ASCII white space; these are its characters.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: With this, a finished write leaves no shuffle files behind: the table it wrote has taken their place.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a folder of our own if
    there is one machine only (local mode, as in tests); else an error, as executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Tables:
    """Intermediate tables in the shared folder.

    A written table cuts the lineage and outlives lost executors. ``drop`` removes one that
    nothing lazy refers to any more; the rest stay until the shared folder is cleared."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex[:12]}", 0

    def write(self, df: DataFrame, name: str = "t", plain: bool = False) -> DataFrame:
        """plain: for columns of hashes, of which a dictionary would be made in vain."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not plain).lower()).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quill_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._delete(df._quill_path)

    def clear(self) -> None:
        """Removes all tables written here, where nothing lazy refers to any."""
        self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def id_type(df: DataFrame, name: str = "doc_id") -> str:
    return df.schema[name].dataType.simpleString()


def components(edges: DataFrame, tables: Tables) -> DataFrame:
    """Distributed union-find over edges (a, b): rows (node, root), root the smallest node reachable.

    Alternates two star contractions: first every larger neighbour of a node is hung on the node's
    smallest neighbour, then every node and its smaller neighbours on the smallest of these. A star
    forest is the fixed point, reached in about log(longest path) rounds. Minima are partial
    aggregates; the joins back to the edges are plain equi-joins that adaptive execution may split,
    so that a hub with a third of all edges does not land in one task. Null ends and loops are left
    out; nodes without an edge are not returned."""
    pair = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    now = tables.write(pair.where("lo < hi").distinct(), "edges")
    mark = None
    while True:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(now.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = tables.write(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "edges")
        seen = new.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        tables.drop(now)
        now = new
        if seen == mark:
            break
        mark = seen
    roots = now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
