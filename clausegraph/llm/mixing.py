"""Mix sources to target weights: Sainte-Lague quotas of equal-token blocks per shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import WORD
from clausegraph.operators.scale import lookup_join
from clausegraph.session import cut_lineage

#: Weights of the sources in code-point order, repeated.
WEIGHTS = (3.0, 1.0, 2.0)


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """0-based position in a total order: ranges are ranked apart and shifted by the sizes of earlier ranges."""
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    window = Window.partitionBy("_part").orderBy(*order)
    start = F.element_at(F.array(*map(F.lit, before or [0])), F.col("_part") + 1)
    return ranged.withColumn(name, (F.row_number().over(window) - 1 + start).cast("long")).drop("_part")


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    The sources share ``share`` of all words by weight.  A target stops at ``most`` times its source's size, and
    the excess is shared again by weight among the others until none is above.  Each round needs four sums, the
    only values that reach the driver.  If all sources stop, the rest of the total is not given out.
    """
    ranked = global_rank(sources, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("_weight", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most))))
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        above = F.col("_cap") <= F.col("_weight") * F.lit(level)
        row = ranked.agg(F.sum(F.when(above, F.col("_cap")).otherwise(0.0)).alias("caps"),
                         F.sum(F.when(above, 0.0).otherwise(F.col("_weight"))).alias("open"),
                         F.sum(above.cast("int")).alias("n")).first()
        if not row["open"] or row["n"] == stopped:
            break
        stopped, level = row["n"], (total - row["caps"]) / row["open"]
    target = F.when(F.col("_cap") <= F.col("_weight") * F.lit(level), F.col("_cap")).otherwise(F.col("_weight") * F.lit(level))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def sainte_lague(cells: DataFrame, seats: int, order: list[str], votes: str = "votes", grid: int = 32) -> DataFrame:
    """Add ``quota``: ``seats`` seats by the highest quotients votes/(2k+1); ties go in ``order``.

    Equivalent divisor form: a cell gets its votes over a common divisor, rounded at one half.  The divisor that
    hands out all seats is found by counting seats for ``grid`` divisors at once and narrowing the bracket, one
    aggregate per round.  Only cells whose next quotient lies in the last bracket (ties) are ranked.
    """
    found = cells.agg(F.sum(votes).alias("votes"), F.count(F.lit(1)).alias("n")).first()
    total = float(found["votes"] or 0.0)
    if not seats or total <= 0:
        return cells.withColumn("quota", F.lit(0).cast("long"))

    def given(divisor: float) -> Column:
        return F.floor(F.col(votes) / F.lit(divisor) + F.lit(0.5)).cast("long")

    # rounding moves each cell by half a seat at most
    slack = found["n"] / 2 + 1
    low, high = total / (seats + slack), total / (seats - slack) if seats > slack else total * 4
    while True:
        step = (high / low) ** (1.0 / grid)
        tried = [low * step**i for i in range(grid + 1)]
        counts = cells.agg(*[F.sum(given(d)).alias(f"d{i}") for i, d in enumerate(tried)]).first()
        enough = max((i for i in range(grid) if counts[i] >= seats), default=0)
        exact = [d for i, d in enumerate(tried) if counts[i] == seats]
        if exact:
            return cells.withColumn("quota", given(exact[-1]))
        low, high = tried[enough], tried[enough + 1]
        if high / low < 1 + 1e-13:
            break
    sure, most = given(high), given(low)
    short = seats - (cells.agg(F.sum(sure)).first()[0] or 0)
    tied = cells.where(most > sure).select(*order, F.lit(1).alias("_one")).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    extra = tied.limit(int(short))
    keys = [F.col(f"c.{c}").eqNullSafe(F.col(f"e.{c}")) for c in order]
    matched = cells.alias("c").join(extra.alias("e"), keys, "left")
    return matched.select("c.*", (sure + F.coalesce(F.col("e._one"), F.lit(0))).cast("long").alias("quota"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5,
        most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = 16, shard_words: int = 1 << 18,
        seed: int = 7) -> DataFrame:
    """``(doc_id, size, source_size, target, taken, whole, lo, hi, lo2, hi2)``, one row per row of ``docs``.

    The documents of a source are cut into shards of about ``shard_words`` words and ordered by a seeded hash in
    each; the words of a shard form blocks of ``block`` words.  Every (source, shard) cell gets an integer quota of
    blocks.  A quota takes every block of the shard as often as it fits, and the rest is a run of blocks from a
    seeded start (around the shard's end if need be), so that documents stay in one piece but for the run's ends.
    ``whole`` counts complete passes; ``[lo, hi)`` and ``[lo2, hi2)`` are the word ranges of the run in a document.

    A null text has size 0; a null source is a source of its own, last in order.  Rows are told apart by key, size
    and a hash of the text; rows that agree in all of these are alike, whichever comes first.  An empty table gives
    no rows.  All choices depend on the data and the seed alone, so reruns agree.
    """
    sized = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"),
                        F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("_order"))
    sized = cut_lineage(sized)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut_lineage(source_targets(sources, share, most, weights).withColumn("_null", F.col("source").isNull())
                          .withColumn("_name", F.coalesce("source", F.lit(""))).drop("source"))
    named = sized.withColumn("_null", F.col("source").isNull()).withColumn("_name", F.coalesce("source", F.lit("")))
    placed = lookup_join(named, targets, ["_null", "_name"])
    shards = F.greatest(F.ceil(F.col("source_size") / F.lit(shard_words)), F.lit(1))
    placed = placed.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed), F.col("_order")), shards))
    cell = ["_null", "_name", "_shard"]
    cells = placed.groupBy(*cell, "source_size", "target").agg(F.sum("size").alias("_words"))
    votes = F.when(F.col("source_size") > 0, F.col("target") * F.col("_words") / F.col("source_size")).otherwise(0.0)
    cells = cut_lineage(cells.withColumn("votes", votes))
    seats = round((targets.agg(F.sum("target")).first()[0] or 0.0) / block)
    quotas = sainte_lague(cells, seats, cell).withColumn("_blocks", F.ceil(F.col("_words") / F.lit(block)))
    quotas = quotas.withColumn("quota", F.least("quota", F.floor(F.col("_blocks") * F.lit(most)).cast("long")))
    some = F.greatest("_blocks", F.lit(1))
    start = F.pmod(F.xxhash64(F.lit(seed), *map(F.col, cell)), some)
    quotas = cut_lineage(quotas.select(*cell, F.floor(F.col("quota") / some).alias("whole"), F.col("_words"),
                                       (start * block).alias("_from"), ((start + F.col("quota") % some) * block).alias("_to"),
                                       (some * block).alias("_cycle")))
    line = Window.partitionBy(*cell).orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = placed.withColumn("_end", F.sum("size").over(line)).join(quotas, cell)
    begin = F.col("_end") - F.col("size")

    def inside(first: Column, last: Column) -> tuple[Column, Column]:
        lo = F.least(F.greatest(first - begin, F.lit(0)), F.col("size"))
        return lo, F.greatest(lo, F.least(last - begin, F.col("size")))

    lo, hi = inside(F.col("_from"), F.least("_to", "_cycle"))
    lo2, hi2 = inside(F.lit(0), F.greatest(F.col("_to") - F.col("_cycle"), F.lit(0)))
    rows = rows.select("doc_id", "size", "source_size", "target", "whole", lo.alias("lo"), hi.alias("hi"),
                       lo2.alias("lo2"), hi2.alias("hi2"), "_order")
    taken = F.col("whole") * F.col("size") + F.col("hi") - F.col("lo") + F.col("hi2") - F.col("lo2")
    return rows.withColumn("taken", taken.cast("long"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", **how) -> DataFrame:
    """The mix as documents with the columns of ``docs``: whole copies, and the cut pieces of the runs' ends.

    Copies keep the key.  ``n_chars`` of a cut piece is counted anew if that column exists.
    """
    seed = how.get("seed", 7)
    plan = mix(docs, key, text, **how).where("taken > 0")
    plan = plan.groupBy("doc_id", "_order").agg(F.max(F.struct("size", "whole", "lo", "hi", "lo2", "hi2")).alias("how"))
    part = lambda a, b: F.struct(F.col(f"how.{a}").alias("lo"), F.col(f"how.{b}").alias("hi"))
    full = F.array_repeat(F.struct(F.lit(0).cast("long").alias("lo"), F.col("how.size").alias("hi")), F.col("how.whole").cast("int"))
    parts = F.filter(F.concat(full, F.array(part("lo", "hi"), part("lo2", "hi2"))), lambda p: p.hi > p.lo)
    plan = plan.select("doc_id", "_order", F.col("how.size").alias("size"), parts.alias("parts"))
    rows = docs.select(F.struct("*").alias("doc"), F.xxhash64(F.lit(seed), F.col(key), F.col(text)).alias("mark"))  # no names to clash
    rows = rows.join(plan, (F.col("mark") == F.col("_order")) & F.col("doc")[key].eqNullSafe(F.col("doc_id")))
    rows = rows.withColumn("part", F.explode("parts"))
    cut = (F.col("part.lo") > 0) | (F.col("part.hi") < F.col("size"))
    words = F.regexp_extract_all(F.col("doc")[text], F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    piece = F.array_join(F.slice(words, (F.col("part.lo") + 1).cast("int"), (F.col("part.hi") - F.col("part.lo")).cast("int")), "")
    rows = rows.withColumn("piece", F.when(cut, piece).otherwise(F.col("doc")[text]))
    made = {text: F.col("piece")}
    if n_chars and n_chars in docs.columns:
        made[n_chars] = F.when(cut, F.char_length("piece").cast(docs.schema[n_chars].dataType)).otherwise(F.col("doc")[n_chars])
    return rows.select(*[made.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
