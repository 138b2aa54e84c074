"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel holds at once; a longer text goes alone and whole.
PIECE_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; a temporary one only where none is set, as in tests."""
    place = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-"))
        place = spark.sparkContext.getCheckpointDir()
    return place


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as Parquet below the checkpoint folder and read it again: this cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tidewell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pieces(batches: Iterable[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, in order, with about limit bytes in the column, one row at least."""
    for batch in batches:
        at = 0
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        while at < batch.num_rows:
            size, to = 0, at
            while to < batch.num_rows and (to == at or size + sizes[to] <= limit):
                size += int(sizes[to])
                to += 1
            yield batch.slice(at, to - at)
            at = to


def texts_of(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of whole texts; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver did, unless their path has it already."""
    root, known = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [x for x in (known.get("PYTHONPATH") or "").split(os.pathsep) if x]
    if root not in paths and root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        known["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of the undirected links (a, b); component is the least node reachable.

    Alternating large-star and small-star rounds on stars of least
    neighbours; each round is written to the checkpoint folder.  Nodes
    without links do not appear; no links give no rows.
    """
    edges = materialize(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
