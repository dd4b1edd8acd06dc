"""Evaluation: ranking metrics, masked rates, thresholds, splits and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.operators.scale import order_statistics


def hit_mrr(ranked: DataFrame, gold: DataFrame, depth: int = 5) -> DataFrame:
    """One row: ``cases, hit1, hit3, mrr`` over questions that have gold items.

    ``ranked(query_id, item_id, rank)``, ``gold(query_id, item_id)``.
    """
    gold = gold.select("query_id", "item_id").distinct()
    found = ranked.where(F.col("rank") <= depth).join(gold, ["query_id", "item_id"], "left_semi").groupBy("query_id").agg(
        F.min("rank").alias("first"))
    cases = gold.select("query_id").distinct().join(found, "query_id", "left")

    def rate(test):
        return F.coalesce(F.avg(F.when(test, 1.0).otherwise(0.0)), F.lit(0.0))

    return cases.agg(F.count(F.lit(1)).alias("cases"), rate(F.col("first") <= 1).alias("hit1"), rate(F.col("first") <= 3).alias("hit3"),
                     F.coalesce(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), F.lit(0.0)).alias("mrr"))


def masked_rates(df: DataFrame, keys: list[str], marks: dict[str, Column]) -> DataFrame:
    """Pass rate per mark; NULL means not applicable and leaves the denominator."""
    aggs = []
    for name, mark in marks.items():
        aggs += [F.avg(mark.cast("double")).alias(f"{name}_rate"), F.count(mark).alias(f"{name}_n")]
    return df.groupBy(*keys).agg(*aggs)


def case_metrics(results: DataFrame) -> DataFrame:
    """Route, refusal, severe, must and citation metrics of answered cases.

    ``results`` has ``intent, want_intent, refused, should_refuse (nullable), answer,
    ref_text, forbidden, musts, has_gold, cited, ref_items``.
    """
    corpus = F.concat_ws(" ", "answer", "ref_text")
    severe = F.size(F.filter("forbidden", lambda f: F.contains("answer", f)))
    must = F.when(F.col("has_gold") & (F.size("musts") > 0), F.forall("musts", lambda m: F.contains(corpus, m)))
    cite = F.when(F.col("has_gold") & (F.size("cited") > 0), F.size(F.array_except("cited", "ref_items")) == 0)
    refusal = F.when(F.col("should_refuse").isNotNull(), F.col("refused") == F.col("should_refuse"))
    zero = F.lit(0.0)
    return results.agg(
        F.count(F.lit(1)).alias("cases"), F.avg((F.col("intent") == F.col("want_intent")).cast("double")).alias("route_accuracy"),
        F.coalesce(F.avg(refusal.cast("double")), zero).alias("refusal_accuracy"),
        (F.sum(severe) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("severe_error_rate"),
        F.coalesce(F.avg(must.cast("double")), zero).alias("must_conclusion_accuracy"),
        F.coalesce(F.avg(cite.cast("double")), zero).alias("citation_accuracy"))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact element n div 2 (0-based) of the sorted values."""
    return order_statistics(df, keys, value, F.floor(F.col("n") / 2))


def threshold_sweep(df: DataFrame, keys: list[str], score: str, cross: str, pairs: list[tuple[float, float]]) -> DataFrame:
    """Rows below both thresholds, for every (score, cross) pair, in one pass over the data."""
    aggs = [F.count_if((F.col(score) < s) & F.coalesce(F.col(cross) < c, F.lit(False))).alias(f"c{i}") for i, (s, c) in enumerate(pairs)]
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs)
    rows = F.array(*[F.struct(F.lit(s).alias("score_th"), F.lit(c).alias("cross_th"), F.col(f"c{i}").alias("below"))
                     for i, (s, c) in enumerate(pairs)])
    return wide.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.*")


def split_sizes(n: Column, train: float, dev: float) -> tuple[Column, Column]:
    """Rounded train and dev sizes that leave at least one row for test where possible."""
    first, second = F.bround(n * train, 0).cast("bigint"), F.bround(n * dev, 0).cast("bigint")
    lack = (n - first - second) < 1
    dev_size = F.when(lack & (second > 0), second - 1).otherwise(second)
    still = (n - first - dev_size) < 1
    return F.when(still, F.greatest(first - 1, F.lit(0))).otherwise(first), dev_size


def stratified_split(df: DataFrame, stratum: str, key: str, train: float = 0.7, dev: float = 0.15, seed: int = 42) -> DataFrame:
    """Adds ``split``.  Rows are ordered by a 60-bit hash; the cut values of every
    stratum are exact order statistics, so no stratum is sorted in one task."""
    digest = F.conv(F.left(F.md5(F.concat_ws("#", F.col(key).cast("string"), F.lit(str(seed)))), F.lit(15)), 16, 10).cast("bigint")
    rows = df.withColumn("_h", digest)
    n_train, n_dev = split_sizes(F.col("n"), train, dev)
    cut1 = order_statistics(rows, [stratum], "_h", n_train - 1).select(stratum, F.col("_h").alias("_c1"))
    cut2 = order_statistics(rows, [stratum], "_h", n_train + n_dev - 1).select(stratum, F.col("_h").alias("_c2"))
    cuts = cut1.join(cut2, stratum, "full_outer")
    from clausegraph.operators.scale import lookup_join

    low = F.lit(-1).cast("bigint")
    joined = lookup_join(rows, cuts, stratum, "left")
    return joined.withColumn("split", F.when(F.col("_h") <= F.coalesce("_c1", low), "train")
                             .when(F.col("_h") <= F.coalesce("_c2", low), "dev").otherwise("test")).drop("_h", "_c1", "_c2")


def compare_sets(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``(key, status)`` with status common, fixed (only before) or new (only after)."""
    a = before.select(key).distinct().withColumn("_a", F.lit(True))
    b = after.select(key).distinct().withColumn("_b", F.lit(True))
    both = a.join(b, key, "full_outer")
    status = F.when(F.col("_a") & F.col("_b"), "common").when(F.col("_a"), "fixed").otherwise("new")
    return both.select(key, status.alias("status"))


def gold_drift(gold: DataFrame, items: DataFrame, phrases: DataFrame, skipped: tuple[str, ...] = ("", "119")) -> DataFrame:
    """Gold items that no longer exist and must-phrases missing from the gold text.

    ``gold(case_id, item_id)``, ``items(item_id, text)``, ``phrases(case_id, phrase)``.
    A phrase is fine when any gold item of its case contains it; ``skipped`` ones are no
    quotations of a text.
    """
    missing = gold.join(items.select("item_id"), "item_id", "left_anti").select(
        "case_id", F.lit("missing_item").alias("kind"), F.col("item_id").cast("string").alias("detail"))
    pairs = phrases.where(~F.col("phrase").isin(*skipped)).join(gold, "case_id").join(items, "item_id", "left")
    covered = pairs.groupBy("case_id", "phrase").agg(
        F.max(F.coalesce(F.contains("text", F.col("phrase")), F.lit(False))).alias("ok"))
    lost = covered.where(~F.col("ok")).select("case_id", F.lit("missing_phrase").alias("kind"), F.col("phrase").alias("detail"))
    return missing.unionByName(lost)


def weighted_score(checks: DataFrame, keys: list[str]) -> DataFrame:
    """``Σ score·weight / Σ weight`` per key with its band at 80 / 60 / 40."""
    score = F.sum(F.col("score") * F.col("weight")) / F.sum("weight")
    band = F.when(F.col("total") >= 80, "A").when(F.col("total") >= 60, "B").when(F.col("total") >= 40, "C").otherwise("D")
    return checks.groupBy(*keys).agg(score.alias("total")).withColumn("band", band)


def label_accuracy(df: DataFrame, keys: list[str], predicted: str, wanted: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(predicted) == F.col(wanted)).cast("double")).alias("accuracy"),
                                 F.count(F.lit(1)).alias("n"))


def training_pairs(ranked: DataFrame, gold: DataFrame, depth: int = 8, negatives: int = 4) -> DataFrame:
    """Positives are gold items, negatives the best ranked items that are not gold."""
    gold = gold.select("query_id", "item_id").distinct()
    wrong = ranked.where(F.col("rank") <= depth).join(gold, ["query_id", "item_id"], "left_anti")
    wrong = wrong.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    from clausegraph.operators.scale import top_per_key

    hard = top_per_key(wrong, ["query_id"], [F.col("rank").asc()], negatives, "_r").select("query_id", "item_id", F.lit(0).alias("label"))
    return gold.select("query_id", "item_id", F.lit(1).alias("label")).unionByName(hard)
