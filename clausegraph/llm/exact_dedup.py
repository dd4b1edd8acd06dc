"""Exact dedup with a heavy-hitter split.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import ascii_lower
from clausegraph.session import cut_lineage


def text_digest(text: str | Column = "text") -> Column:
    """SHA-256 (binary) of the text after lower-casing A-Z; null counts as empty."""
    column = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(ascii_lower(F.coalesce(column, F.lit(""))), 256))


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = 0.001) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Equal texts form a group and the row with the largest key stays.  Digests that own at least ``support`` of all
    rows are found by the Misra-Gries counters of ``freqItems`` (never more than 1/support candidates), counted
    exactly, and their winners are broadcast, so that these rows never move.  All other groups hold less than
    ``support`` of the rows and go through one shuffle by digest.

    Rows with a null key are counted, never stay while a row of their group has a key, and stay (``keep_id`` null)
    if none has.  Repeated rows with the winning key are all marked as kept.  Other columns are ignored; an empty
    table gives no rows.
    """
    slim = cut_lineage(docs.select(F.col(key).alias("doc_id"), text_digest(text).alias("digest")))
    frequent = slim.select(F.hex("digest").alias("d")).stat.freqItems(["d"], support)
    frequent = frequent.select(F.explode("d_freqItems").alias("d")).select(F.unhex("d").alias("digest"))
    exact = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = slim.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*exact).where("group_size > 1")
    winners = cut_lineage(winners)
    hot = slim.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    rest = slim.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "doc_id", F.max("doc_id").over(same).alias("keep_id"), F.count(F.lit(1)).over(same).alias("group_size"))
    return hot.unionByName(rest).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = 0.001) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, one per group.

    Rows that agree in key and text count as copies too: one of them stays (the first in the order of their other
    columns as JSON).  Such rows are counted on digests, and only they are grouped with their texts.
    """
    rows = docs.select(F.struct("*").alias("doc"), F.lower(F.hex(text_digest(text))).alias("sha"))  # no names to clash
    kept = exact_groups(docs, key, text, support).where("kept").groupBy("doc_id", "text_sha256").agg(
        F.count(F.lit(1)).alias("copies"))
    same = F.col("doc")[key].eqNullSafe(F.col("doc_id")) & (F.col("sha") == F.col("text_sha256"))
    joined = rows.join(kept, same)
    once = joined.where("copies = 1").select("doc")
    rest = [F.col("doc")[c].alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in (key, text)]
    order = Window.partitionBy("doc_id", "sha").orderBy(F.to_json(F.struct(F.lit(0).alias("c"), *rest)))
    again = joined.where("copies > 1").withColumn("number", F.row_number().over(order)).where("number = 1").select("doc")
    return once.unionByName(again).select("doc.*")
