"""Exact and near duplicate removal in corpus order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausegraph.functions import text as tx
from clausegraph.operators.scale import fits, lookup_join
from clausegraph.session import cut_table

#: Pairs that the groups have for each of their rows when all are compared at once.
PAIRS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def exact_dedupe(items: DataFrame, key: str, order: str, text: str = "text", digest: Column | None = None) -> DataFrame:
    """``(fingerprint, kept, copies)``: the first item of every fingerprint.

    An aggregate: a fingerprint shared by a third of the corpus costs one row per
    map task, not one task for the group.
    """
    mark = digest if digest is not None else tx.fingerprint(text)
    return items.groupBy(mark.alias("fingerprint")).agg(
        F.min_by(key, order).alias("kept"), F.count(F.lit(1)).alias("copies"))


def corpus_fingerprint(items: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row that changes with any change of the corpus, independent of row order."""
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), text))
    low, high = (F.conv(F.substring(digest, i, 8), 16, 10).cast("decimal(10,0)") for i in (1, 9))
    total = {name: F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").cast("string") for name, part in (("a", low), ("b", high))}
    return items.agg(F.count(F.lit(1)).alias("n"), total["a"].alias("a"), total["b"].alias("b"))


def shingle_sets(items: DataFrame, key: str, text: str = "text", size: int = 5) -> DataFrame:
    """``(id, s: array<bigint>)``: hashed word n-grams of the whole text, distinct and sorted; texts without words are left out.

    Texts with fewer words than ``size`` give one shingle of all their words.
    """
    words = items.select(F.col(key).alias("id"), F.transform(tx.words(text), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = np.r_[0, np.cumsum(pc.list_value_length(batch["w"]).to_numpy(zero_copy_only=False))].tolist()
            each = pc.list_flatten(batch["w"]).to_numpy(zero_copy_only=False).view(np.uint64)
            rolled = _mixed(each, min(size, len(each)))
            sets = [np.unique(rolled[a: b - size + 1] if b - a >= size else _mixed(each[a:b], b - a)) for a, b in zip(bounds, bounds[1:])]
            stops = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.ListArray.from_arrays(pa.array(stops), pa.array(flat.view(np.int64)))], ["id", "s"])

    schema = T.StructType([T.StructField("id", items.schema[key].dataType), T.StructField("s", T.ArrayType(T.LongType()))])
    return words.mapInArrow(run, schema)


def _mixed(each: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` neighbours."""
    count = len(each) - size + 1
    hashes = np.full(count, size, np.uint64)
    for at in range(size):
        hashes = (hashes ^ each[at: at + count]) * _MIX
        hashes ^= hashes >> np.uint64(29)
    return hashes


def _prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """``(id, n, token)``: the rarest shingles of every set, enough that similar sets share one.

    For Jaccard ≥ t two sets must meet in their first ``n - ceil(t·n) + 1`` elements
    under any common order; rare first keeps the groups small.  Shingles of one single set stand
    first there and meet nothing: of a set with ``c`` others the first ``c - ceil(t·n) + 1`` of those are left, mostly none.
    """
    tokens = sets.select("id", F.size("s").alias("n"), F.explode("s").alias("token"))
    shared = tokens.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1")
    ranked = shared.groupBy("id", "n").agg(F.collect_list(F.struct("df", "token")).alias("o"))
    length = F.size("o") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    heads = ranked.where(length > 0).select("id", "n", F.explode(F.slice(F.array_sort("o"), F.lit(1), length.cast("int"))).alias("p"))
    return heads.select("id", "n", F.col("p.token").alias("token"))


def _similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Keep pairs ``(a, b)`` whose exact Jaccard similarity reaches the threshold.

    Only the sets of the pairs cross the network while there are few enough pairs to broadcast.
    """
    pairs = cut_table(pairs)
    few = F.broadcast if fits(pairs) else lambda df: df
    left = sets.select(F.col("id").alias("a"), F.col("s").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("s").alias("sb"))
    both = left.join(few(pairs), "a").join(right.join(few(pairs.select("b").distinct()), "b", "left_semi"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    jaccard = common / (F.size("sa") + F.size("sb") - common)
    return both.where(jaccard >= threshold).select("a", "b")


def _first_come(edges: DataFrame) -> list[DataFrame]:
    """Parts of ``(id)``: what goes when, in the order of the ids, everything next to a kept one goes; ``edges(a, b)`` with ``a < b``."""
    parts = []
    few = F.broadcast if fits(edges) else lambda df: df
    while not edges.isEmpty():
        first = edges.select("a").distinct().join(few(edges.select(F.col("b").alias("a")).distinct()), "a", "left_anti")
        gone = cut_table(edges.join(few(first), "a", "left_semi").select("b").distinct())
        parts.append(gone.select(F.col("b").alias("id")))
        edges = cut_table(edges.join(few(gone), "b", "left_anti").join(few(gone.select(F.col("b").alias("a"))), "a", "left_anti"))
    return parts


def near_dedupe(items: DataFrame, key: str, text: str = "text", threshold: float = 0.8, size: int = 5) -> DataFrame:
    """``(id, kept)``: greedy first-come selection; an item goes when an earlier kept item is similar.

    Equal shingle sets collapse first.  Then rounds run over the groups of items
    that share a rare shingle: an item that is the first undecided one of all its
    groups is kept, and only kept items are compared with the rest of their
    groups, so a group of n copies costs n comparisons and not n².  Once the groups that are left have
    at most ``PAIRS`` pairs a row, all of them are compared at once, and further rounds run over the similar pairs only: their
    number does not grow with groups of unlike items.  Result equals the sequential selection.
    """
    sets = shingle_sets(items, key, text, size)
    unique = cut_table(sets.groupBy("s").agg(F.min("id").alias("id")).where("id IS NOT NULL").select("id", "s"))
    groups = cut_table(_prefixes(unique, threshold))
    near = F.least("n", "m") / F.greatest("n", "m") >= threshold  # size filter
    open_, dropped = groups, []
    while True:  # every round decides one item of each group at least
        counts = open_.groupBy("token").agg(F.count(F.lit(1)).alias("c"))
        left = counts.agg(F.sum("c").alias("rows"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("pairs")).first()
        if not left["rows"]:
            break
        if left["pairs"] <= PAIRS * left["rows"]:
            other = open_.select("token", F.col("id").alias("b"), F.col("n").alias("m"))
            pairs = open_.withColumnRenamed("id", "a").join(other, "token").where(near & (F.col("a") < F.col("b"))).select("a", "b").distinct()
            dropped += _first_come(cut_table(_similar(pairs, unique, threshold).distinct()))
            break
        heads = open_.groupBy("token").agg(F.min("id").alias("head"))
        state = lookup_join(open_, heads, "token")
        winners = cut_table(state.groupBy("id").agg(F.min(F.col("id") == F.col("head")).alias("all_first")).where("all_first").select("id"))
        lead = state.where(F.col("id") == F.col("head")).join(winners, "id", "left_semi").select(
            "token", F.col("id").alias("a"), F.col("n").alias("m"))
        pairs = lookup_join(state.where(F.col("id") > F.col("head")), lead, "token").where(near).select("a", F.col("id").alias("b")).distinct()
        dropped.append(cut_table(_similar(pairs, unique, threshold).select(F.col("b").alias("id")).distinct()))
        open_ = cut_table(open_.join(winners.unionByName(dropped[-1]), "id", "left_anti"))
    grouped = groups.select("id").distinct()
    kept = unique.join(grouped, "id", "left_anti").select("id")
    kept = kept.unionByName(grouped if not dropped else grouped.join(reduce(DataFrame.unionByName, dropped), "id", "left_anti"))
    return items.select(F.col(key).alias("id")).join(kept.withColumn("kept", F.lit(True)), "id", "left").select(
        "id", F.coalesce("kept", F.lit(False)).alias("kept"))
