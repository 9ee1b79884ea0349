"""Helpers shared by the training-data operators.

Scratch tables live in the folder that ``spark.checkpoint.dir`` names, so an
executor can be lost after a table is written; nothing is kept in an
executor's own folder.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder.

    Read from ``spark.checkpoint.dir``; only a local master may go without it
    (tests), then a private folder is made. Anything else is an error.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = "file://" + tempfile.mkdtemp(prefix="interlinear-shared-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def materialize(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later branches
    neither recompute it nor depend on executors staying alive."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/interlinear-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, tag: str) -> DataFrame:
    """``df`` with a unique long ``row``, written once: the numbers stay the same
    in every later scan, also when lost executors change how files are split."""
    return materialize(df.withColumn("row", F.monotonically_increasing_id()), tag)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def arrow_step(df: DataFrame, step: Callable, ddl) -> DataFrame:
    """``mapInArrow`` with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(step, ddl)


def utf8(column: str) -> Column:
    """Text as UTF-8 bytes, null as empty: what the Arrow steps read."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph; returns (id, component = smallest id).

    ``edges`` has long columns (a, b). Alternates large-star and small-star
    steps (each one grouped minimum plus one equi-join) until the edge set
    stops changing, which takes a logarithmic number of rounds. A hub's edges
    are never held in one group: the minimum is partially aggregated, and in the
    join back they stream past the hub's one row (through one task). Each step is
    written once, so lineage stays short, and read in as few tasks as its size asks
    for: the driver keeps track of every task. Vertices without edges are absent.
    """
    now = materialize(edges.where("a <> b")
                      .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "edges-low")
        large = (both.join(low, "a").where("b > a and b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))
        large = materialize(large.union(low.where("m < a").select("a", F.col("m").alias("b"))).distinct(), "edges-large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "edges-low")
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "edges")
        after = _state(now)
        if after == seen:
            break
        seen = after
    leaves = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Size and order-free digest of an edge set (one small row)."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())
