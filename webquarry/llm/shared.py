"""Small helpers that need a Spark session: where to cut lineage, and connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a new one in local mode and an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def hand_out(spark: SparkSession, data: bytes, prefix: str) -> str:
    """Puts ``data`` as a file into the shared folder, from which Spark brings it to every executor; its name.

    Tasks open it with ``SparkFiles.get(name)`` and can map it into memory.
    """
    name = f"{prefix}-{uuid.uuid4().hex}.bin"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(shared_folder(spark), name)
    with tempfile.TemporaryDirectory() as folder:
        # Only from one process of the driver to the other.
        with open(os.path.join(folder, name), "wb") as out:
            out.write(data)
        target.getFileSystem(conf).copyFromLocalFile(jvm.org.apache.hadoop.fs.Path("file://" + folder, name), target)
    spark.sparkContext.addFile(target.toString())
    return name


def text_key() -> list[Column]:
    """128 bits of hash of the column ``text``, as two longs (two seeds); null texts share one key."""
    return [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the graph with the edges (a, b): rows (id, label), label the least id.

    Each round maps every node to the least of its neighbours and itself in a random order (by
    hash), contracts the edges along that map and drops those that became loops. A constant
    share of the nodes goes in each round, also on long paths, so the rounds are logarithmic;
    no neighbourhood is ever collected. Nodes without an edge to another node are not listed.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    live = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = live.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("root", F.col("id"))
    while not live.isEmpty():
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).union(live.select("b", "a"))
        step = cut(both.groupBy("u").agg(F.min(rank("v")).alias("m")).select("u", F.least("m", rank("u"))["id"].alias("to")))
        a, b = step.select(F.col("u").alias("a"), F.col("to").alias("ta")), step.select(F.col("u").alias("b"), F.col("to").alias("tb"))
        labels = labels.join(a.withColumnRenamed("a", "root"), "root", "left").select("id", F.coalesce("ta", "root").alias("root"))
        labels = cut(labels)
        moved = live.join(a, "a").join(b, "b").where("ta <> tb")
        live = cut(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    least = labels.groupBy("root").agg(F.min("id").alias("label"))
    return labels.join(least, "root").select("id", "label")
