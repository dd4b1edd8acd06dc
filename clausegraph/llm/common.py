"""What several operators share: partitions, ASCII lower-casing and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.session import cut_lineage, cut_table  # noqa: F401  cut_table: for the operators

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only.  ``lower`` does the same where all characters are ASCII, and is faster."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def spread_rows(df: DataFrame) -> DataFrame:
    """All cores for an input with fewer splits than cores; larger inputs pass through."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` with the smallest node of each connected component, for nodes with an edge.

    Alternating star contraction: every node first points its larger neighbours, then its smaller ones and
    itself, at the smallest node it knows.  A hub costs one aggregated row per task and a join that the
    adaptive runtime can split.  Edges are written to the shared checkpoint folder after each round; only
    two numbers reach the driver.  Null ends and self loops are ignored; an empty input gives no rows.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs = cut_lineage(pairs)
    mark = _signature(pairs)
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = cut_lineage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        last, mark = mark, _signature(pairs)
        if mark == last:
            break
    roots = pairs.select(F.col("v").alias("node")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))


def _signature(pairs: DataFrame) -> tuple:
    """Row count and an order-independent digest of an edge table."""
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]
