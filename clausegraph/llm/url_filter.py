"""URL filter: fixed host and path rules, then association rules over URL tokens."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import ascii_lower
from clausegraph.operators.scale import lookup_join
from clausegraph.session import cut_lineage

#: (verdict, host/path), as dealt.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BAD = "label:block"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or null.  For a short, fixed list of rules."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        domain, slash, tail = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + tail)
        text, verdict = F.when(fits, rule).otherwise(text), F.when(fits, name).otherwise(verdict)
    return text, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host labels and endings, path parts without digits, and names of query fields."""
    labels = F.split(host, r"\.")
    ending = F.concat(F.lit("end:"), F.regexp_extract(host, r"[^.]+\.[^.]+$", 0))
    parts = F.transform(F.split(F.lower(path), r"[/._-]+"), lambda p: F.concat(F.lit("path:"), F.regexp_replace(p, r"[0-9]+", "#")))
    fields = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)"), F.lit(1)), lambda q: F.concat(F.lit("field:"), q))
    scheme = F.array(F.concat(F.lit("scheme:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), "://", 1))))
    scheme = F.when(F.instr(url, "://") > 0, scheme).otherwise(F.array().cast("array<string>"))
    every = F.concat(F.transform(labels, lambda p: F.concat(F.lit("host:"), p)), F.array(ending), parts, fields, scheme)
    return F.array_sort(F.array_distinct(F.filter(every, lambda t: ~t.endswith(":"))))


def mine(transactions: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """``(rule_id, tokens, support, confidence, probe)`` for rules "tokens => block".

    ``transactions(items)`` hold the tokens of labelled rows and ``BAD`` for bad ones.  Rules of any length count, but
    for those that contain a shorter rule of the same or more confidence.
    ``probe`` is the rarest token of a rule, under which the index holds it.
    """
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0).fit(transactions)
    sets = cut_lineage(model.freqItemsets.withColumn("items", F.array_sort("items")))
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("tokens"), F.col("freq").alias("hits"))
    good = sets.where(~F.array_contains("items", BAD)).select(F.col("items").alias("tokens"), "freq")
    rules = bad.join(good, "tokens").withColumn("confidence", F.col("hits") / F.col("freq")).where(F.col("confidence") >= min_confidence)
    single = good.where(F.size("tokens") == 1).select(F.col("tokens")[0].alias("token"), F.col("freq").alias("seen"))
    rules = cut_lineage(rules.withColumn("rule_id", F.xxhash64("tokens")))
    shorter = rules.select(F.col("rule_id").alias("short_id"), F.col("tokens").alias("short"), F.col("confidence").alias("as_sure"))
    parts = rules.withColumn("token", F.explode("tokens"))
    over = parts.join(shorter.withColumn("token", F.element_at("short", 1)), "token").where(
        (F.size("short") < F.size("tokens")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("short", "tokens")) == 0))
    rules = rules.join(over.select("rule_id").distinct(), "rule_id", "left_anti")
    probe = rules.select("rule_id", F.explode("tokens").alias("token")).join(single, "token").groupBy("rule_id").agg(
        F.min(F.struct("seen", "token")).alias("rare"))
    return rules.join(probe, "rule_id").select("rule_id", "tokens", F.col("hits").alias("support"), "confidence", F.col("rare.token").alias("probe"))


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``(tokens, evidence)``: the surest rule that each token set contains, found under the rules' rarest tokens."""
    probes = sets.select("tokens", F.explode("tokens").alias("probe"))
    index = rules.select("probe", F.col("tokens").alias("needed"), "confidence", "support")
    found = lookup_join(probes, index, "probe", rows=50_000).where(F.size(F.array_except("needed", "tokens")) == 0)
    best = F.max(F.struct("confidence", "support", "needed")).alias("evidence")
    return found.groupBy("tokens").agg(best)


def judge(pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", label_key: str = "doc_id",
          rules: tuple[tuple[str, str], ...] = RULES, min_support: float = 0.002, min_count: int = 20,
          min_confidence: float = 0.5) -> DataFrame:
    """``(page_id, host, path, rule, verdict, evidence)``, one row per row of ``pages``.

    Where no rule fits, an association rule decides: the page is blocked if its tokens contain those of a mined rule
    (``evidence``), else allowed.  Rules are mined from pages whose id has a label: bad ones have quality 0 or
    toxic 1 (null labels count as good).  A rule must hold for ``min_support`` of the labelled pages and for
    ``min_count`` bad ones at least, and be right for ``min_confidence`` of the pages it matches.

    Null urls have an empty host and path and no tokens; without labels nothing is mined and the rest is allowed.
    A page with several labels is bad if one says so.  Other columns are ignored.
    """
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), F.col(url).alias("url"))
    rows = cut_lineage(rows.withColumn("tokens", url_tokens(F.col("url"), F.col("host"), F.col("path"))).drop("url"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    marks = labels.select(F.col(label_key).alias("page_id"), bad.alias("bad")).groupBy("page_id").agg(F.max("bad").alias("bad"))
    known = rows.join(marks, "page_id").where(F.size("tokens") > 0)
    items = F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens"))
    transactions = cut_lineage(known.select(items.alias("items")))
    sets = rows.where(F.size("tokens") > 0).select("tokens").distinct()
    known_rows = transactions.count()
    if known_rows < min_count:
        evidence = sets.select("tokens", F.lit(None).cast("struct<confidence:double,support:bigint,needed:array<string>>").alias("evidence")).where("false")
    else:
        evidence = match(cut_lineage(sets), cut_lineage(mine(transactions, max(min_support, min_count / known_rows), min_confidence)))
    judged = rows.join(cut_lineage(evidence), "tokens", "left")
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("evidence").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", text.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "evidence")
