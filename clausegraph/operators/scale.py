"""Joins and windows that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 500_000


def fits(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``rows`` rows; never counts further than that."""
    return df.limit(rows + 1).count() <= rows


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for inputs with fewer splits than cores.

    A single small file arrives as one split.  Inputs that already have enough
    splits, as every large table does, pass through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def fan_out_partitions(df: DataFrame) -> int:
    """Partition number for a shuffle whose rows multiply afterwards.

    A fixed number keeps the runtime from merging partitions by their size
    before the fan-out; large clusters set ``spark.sql.shuffle.partitions`` to
    fit their data and that value is kept.
    """
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def lookup_join(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner",
                rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Join a fact side to a lookup side.

    The lookup is broadcast only after its row count was checked.  Beyond the
    bound both sides are shuffled on the key plus a salt: the fact side spreads
    each key over ``salts`` tasks and the lookup side is repeated per salt, so
    a key with a third of all rows is still split.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if fits(small, rows):
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how, salts)


def with_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a global aggregate (exactly one row) next to every row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one")


def salted_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16) -> DataFrame:
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in on] or [F.lit(0)]), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key.  An aggregate, so each map task sends one row per key."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    picked = F.min(F.struct(*order, *rest)).alias("_first")
    return df.groupBy(*keys).agg(picked).select(*keys, "_first.*").select(*df.columns)


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Top-k per key; Spark limits every map task to k rows per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def bucketed_lag(df: DataFrame, key: str, order: Column, columns: list[str], bucket: Column) -> DataFrame:
    """``lag(1)`` over ``key`` ordered by ``order`` without one task per key.

    Rows are windowed per (key, bucket).  The last row of each bucket is carried
    to the next non-empty one through a summary that has one row per bucket.
    ``bucket`` must be non-decreasing in ``order``.  Adds ``prev_<column>``.
    """
    rows = df.withColumn("_bucket", bucket).withColumn("_order", order)
    inner = Window.partitionBy(key, "_bucket").orderBy("_order")
    rows = rows.withColumn("_prev", F.lag(F.struct(*columns)).over(inner))
    tails = rows.groupBy(key, "_bucket").agg(F.max_by(F.struct(*columns), "_order").alias("_tail"))
    over = Window.partitionBy(key).orderBy("_bucket")
    carry = tails.withColumn("_carry", F.lag("_tail").over(over)).drop("_tail")
    joined = rows.join(carry, [key, "_bucket"], "left")
    prev = F.coalesce("_prev", "_carry")
    for c in columns:
        joined = joined.withColumn(f"prev_{c}", prev[c])
    return joined.drop("_bucket", "_order", "_prev", "_carry")


def order_statistics(df: DataFrame, keys: list[str], value: str, position: Column, buckets: int = 4096,
                     n: str = "n") -> DataFrame:
    """Exact element at 0-based ``position`` of the sorted values of every key.

    ``position`` may use column ``n`` (row count of the key).  Values are counted
    first (equal values collapse map-side), then a histogram of ``buckets`` cells
    per key locates the wanted cell and only that cell is sorted.  No task ever
    holds all values of a key.  Returns keys, ``n`` and ``value``.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    bounds = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(F.lit(1)).alias(n))
    bounds = bounds.withColumn("_pos", position.cast("bigint"))
    span = (F.col("_hi") - F.col("_lo")).cast("double")
    cell = F.when(span > 0, F.least(F.floor((F.col(value) - F.col("_lo")).cast("double") / span * buckets),
                                    F.lit(buckets - 1).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))
    if keys:
        placed = lookup_join(counts, bounds, keys)
    else:
        placed = with_scalars(counts, bounds)
    placed = placed.withColumn("_cell", cell)
    hist = placed.groupBy(*keys, "_cell", "_pos").agg(F.sum("_c").alias("_cc"))
    over_cells = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_before", F.coalesce(F.sum("_cc").over(over_cells), F.lit(0)))
    target = hist.where((F.col("_before") <= F.col("_pos")) & (F.col("_pos") < F.col("_before") + F.col("_cc")))
    target = target.select(*keys, "_cell", "_before")
    inside = placed.join(F.broadcast(target), [*keys, "_cell"]) if not keys else lookup_join(placed, target, [*keys, "_cell"])
    over_values = Window.partitionBy(*keys).orderBy(value)
    inside = inside.withColumn("_upto", F.sum("_c").over(over_values) + F.col("_before"))
    hit = inside.where((F.col("_upto") - F.col("_c") <= F.col("_pos")) & (F.col("_pos") < F.col("_upto")))
    return hit.select(*keys, n, value)
