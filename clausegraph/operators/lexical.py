"""Sentence units, BM25 and TF-IDF retrieval over a batch of questions.

Every scorer returns long rows ``(query_id, item_id, raw)``; :func:`normalized_top`
turns them into a ranked channel.  Units are scored, items answer: an item gets
the best score of its units.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.config import Bm25
from clausegraph.functions import text as tx
from clausegraph.functions.exact import SCALE, fixed_sum, from_fixed, to_fixed
from clausegraph.operators.ranking import Weights, best_items, best_of_units, document_frequencies, postings_of
from clausegraph.operators.scale import BROADCAST_ROWS, fan_out_partitions, fits, lookup_join, salted_join, top_per_key, with_scalars
from clausegraph.session import cut_lineage, cut_table
from clausegraph.sources import snapshots

#: Slices of a question batch whose weights are too many for one broadcast; a batch that needs more is joined with the postings.
MOST_PASSES = 32
UNIT_MARK = ""  # one pseudo-token per unit; carries unit counts and lengths


def explode_units(items: DataFrame, item: str = "item_id", text: str = "text", part: Column | None = None,
                  delimiters: str = tx.CJK_DELIMITERS) -> DataFrame:
    """``(part, item_id, unit_no, unit)``, numbering from 0 over non-empty sentences."""
    base = items.select(
        (part if part is not None else F.lit("all")).alias("part"),
        F.col(item).alias("item_id"),
        F.posexplode(tx.sentences(text, delimiters)).alias("unit_no", "unit"),
    )
    return base


def tokenized(units: DataFrame, tokenizer: tx.Tokenizer = tx.words) -> DataFrame:
    return units.withColumn("tokens", tokenizer(F.col("unit"))).withColumn("dl", F.size("tokens"))


def expand_queries(queries: DataFrame, synonyms: list[tuple[str, str]]) -> DataFrame:
    """``(query_id, variant, text)``: the question and each synonym of a contained key."""
    q = F.col("text")
    extra = [F.when(F.contains(q, F.lit(key)), F.lit(syn)) for key, syn in synonyms]
    variants = F.filter(F.array(q, *extra), lambda v: v.isNotNull())
    return queries.select("query_id", F.posexplode(variants).alias("variant", "text"))


def query_terms(queries: DataFrame, tokenizer: tx.Tokenizer = tx.words) -> DataFrame:
    """``(query_id[, variant], token, qtf)``."""
    keys = ["query_id", "variant"] if "variant" in queries.columns else ["query_id"]
    exploded = queries.select(*keys, F.explode(tokenizer(F.col("text"))).alias("token"))
    return exploded.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("qtf"))


def _join_terms(big: DataFrame, terms: DataFrame, on: list[str], small: bool) -> DataFrame:
    """Broadcast question terms whose number was checked, else salt both sides."""
    return big.join(F.broadcast(terms), on) if small else salted_join(big, terms, on)


def _restricted_postings(units: DataFrame, vocabulary: DataFrame, small: bool) -> DataFrame:
    """Postings of the asked tokens only, hash-partitioned by unit.

    All later per-unit aggregates reuse this one shuffle; what crosses the
    network is one slim row per token hit, before questions multiply it.
    ``is_unit`` is an aggregate, so filters on it stay above the shuffle and
    every reader of the postings shares the same exchange.
    """
    marks = F.concat(F.array(F.lit(UNIT_MARK)), F.col("tokens"))
    stream = units.select("part", "item_id", "unit_no", "dl", F.explode(marks).alias("token"))
    mark = vocabulary.sparkSession.range(1).select(F.lit(UNIT_MARK).alias("token"))
    wanted = vocabulary.select("token").distinct().unionByName(mark)
    kept = _join_terms(stream, wanted, ["token"], small)
    placed = kept.select("part", "item_id", "unit_no", "dl", "token").repartition(
        fan_out_partitions(kept), "item_id", "unit_no")
    return placed.groupBy("part", "item_id", "unit_no", "dl", "token").agg(
        F.count(F.lit(1)).alias("tf"), F.max(F.col("token") == UNIT_MARK).alias("is_unit"))


def variant_slots(terms: DataFrame, slots: int) -> DataFrame:
    """``(query_id, token, qtfs)``: the counts of a token in all variants of a question, next to each other.

    One row a token, however many variants hold it: a posting meets a question once.
    """
    held = F.map_from_entries(F.collect_list(F.struct("variant", "qtf")))
    packed = terms.groupBy("query_id", "token").agg(held.alias("_held"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.col("_held")[i], F.lit(0).cast("bigint")))
    return packed.select("query_id", "token", counts.alias("qtfs"))


def _bm25_statistics() -> tuple[Column, Column]:
    n, df = F.col("n_units"), F.col("df")
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf.alias("idf"), F.greatest(F.lit(1.0), F.col("total_dl") / n).alias("avgdl")


def _saturation(params: Bm25) -> Column:
    tf, dl = F.col("tf"), F.col("dl")
    return tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * dl / F.col("avgdl")))


def _bm25_hits(postings: DataFrame, sizes: DataFrame, terms: DataFrame, params: Bm25, small: bool, by_part: bool,
               dictionary: DataFrame | None = None, per_sub: int = 0) -> DataFrame:
    """Scores of ``postings`` of the asked tokens; ``terms`` has ``qtf``, or ``variant`` and ``qtf``.

    Variants stand side by side in slots: every posting is joined once per question, each unit keeps one sum per
    slot, and the slots come apart only at the maximum.  ``per_sub`` slots in a row belong to one sub-query, which
    then keeps scores of its own (column ``sub``); 0 takes the maximum over all.
    """
    if dictionary is None:
        dictionary = postings.groupBy("part", "token").agg(F.count(F.lit(1)).alias("df"))
    dictionary = dictionary.join(F.broadcast(sizes), "part").select("part", "token", *_bm25_statistics())
    slots = 1
    if "variant" in terms.columns:
        last = terms.agg(F.max("variant").alias("last")).first()["last"]
        slots = 1 + (last or 0)
        terms = variant_slots(terms, slots)
    else:
        terms = terms.select("query_id", "token", F.array("qtf").alias("qtfs"))
    weights = terms.join(dictionary, "token")
    saturation = _saturation(params)
    hits = _join_terms(postings, weights, ["part", "token"], small)
    item_keys = ["query_id", "part", "item_id"] if by_part else ["query_id", "item_id"]
    sums = [fixed_sum(F.col("qtfs")[i] * F.col("idf") * saturation).alias(f"_v{i}") for i in range(slots)]
    per_unit = hits.groupBy(*item_keys, "unit_no").agg(*sums)
    columns = [F.col(f"_v{i}") for i in range(slots)]
    if per_sub:
        groups = [columns[i: i + per_sub] for i in range(0, slots, per_sub)]
        tops = [(F.greatest(*g) if len(g) > 1 else g[0]).alias(f"_s{i}") for i, g in enumerate(groups)]
        items = per_unit.select(*item_keys, *tops).groupBy(*item_keys).agg(*[F.max(f"_s{i}").alias(f"_s{i}") for i in range(len(groups))])
        apart = F.posexplode(F.array(*[F.col(f"_s{i}") for i in range(len(groups))])).alias("sub", "raw")
        return items.select(*item_keys, apart).where(F.col("raw") > 0)
    best = F.greatest(*columns) if slots > 1 else columns[0]
    return per_unit.select(*item_keys, best.alias("raw")).where(F.col("raw") > 0).groupBy(*item_keys).agg(F.max("raw").alias("raw"))


def _passes(terms: DataFrame, rows: int) -> list[DataFrame] | None:
    """``terms`` in slices by question that have about ``rows`` rows at most; None if there would be too many."""
    if rows > 0 and fits(terms, rows):
        return [terms]
    if rows <= 0 or not fits(terms, MOST_PASSES * rows // 2):
        return None
    number = -(-2 * terms.count() // rows)
    return [terms.where(F.pmod(F.xxhash64("query_id"), F.lit(number)) == i) for i in range(number)]


def _columns(terms: DataFrame, codes: dict, values: str, keys: list[str], sub: int = 0) -> tuple[Weights, DataFrame] | None:
    """Weights of ``terms(query_id[, variant], token, <values>)`` and ``(group, query_id[, sub])``; None without any.

    ``codes[token]`` lists ``(tid, factor)``: a weight is the value times the factor.  One group per question, or per
    ``sub`` variants in a row of a question.
    """
    slot = F.col("variant") if "variant" in terms.columns else F.lit(0)
    slot = slot.cast("bigint")
    group = F.floor(slot / sub) if sub else F.lit(0)
    marked = terms.select("query_id", group.cast("bigint").alias("sub"), slot.alias("slot"), "token", F.col(values).alias("value"),
                          F.to_json(F.struct("query_id")).alias("mark"))
    rows = marked.toArrow()
    marks, subs, slots = rows["mark"].to_pylist(), rows["sub"].to_pylist(), rows["slot"].to_pylist()
    keyed = list(zip(marks, subs, slots, strict=True))
    columns = {key: i for i, key in enumerate(sorted(set(keyed)))}  # the columns of a group stand next to each other
    groups: dict[tuple, int] = {}
    group_of = np.array([groups.setdefault(key[:2], len(groups)) for key in columns], np.int64)
    first: dict[int, int] = {}
    entries = []
    for i, (key, token, value) in enumerate(zip(keyed, rows["token"].to_pylist(), rows["value"].to_pylist(), strict=True)):
        first.setdefault(groups[key[:2]], i)
        entries += [(tid, columns[key], value * factor) for tid, factor in codes.get(token, ())]
    if not entries:
        return None
    tids, cols, values_ = zip(*entries, strict=True)
    weights = Weights(np.array(tids, np.int64), np.array(cols, np.int64), np.array(values_, np.float64), group_of)
    order = sorted(first)
    names = rows.select(["query_id", "sub"]).take(pa.array([first[g] for g in order])).append_column("group", pa.array(order, pa.int64()))
    schema = marked.select("query_id", "sub", F.lit(0).cast("bigint").alias("group")).schema
    return weights, terms.sparkSession.createDataFrame(names.combine_chunks(), schema).select("group", "query_id", *keys)


def _numbered(dictionary: DataFrame, sizes: DataFrame) -> tuple[pa.Table, dict[str, list]]:
    """``(part, token, idf, avgdl)`` of the asked tokens, numbered by their row, and ``(number, idf)`` of each token."""
    known = dictionary.join(F.broadcast(sizes), "part").select("part", "token", *_bm25_statistics()).toArrow()  # asked tokens only
    codes: dict[str, list] = {}
    for tid, (token, idf) in enumerate(zip(known["token"].to_pylist(), known["idf"].to_pylist(), strict=True)):
        codes.setdefault(token, []).append((tid, idf))
    return known, codes


def _asked_tokens(terms: DataFrame) -> pa.Array:
    """The tokens of a batch whose terms were found to fit."""
    return terms.select("token").distinct().toArrow()["token"].combine_chunks().sort()


def _per_pass(postings: DataFrame, passes: list[DataFrame], codes: dict, by_part: bool, per_sub: int, best) -> DataFrame:
    """``best(weights)`` of every slice of the questions, under their ids."""
    keys = ["sub"] if per_sub else []
    parts = []
    for terms in passes:
        made = _columns(terms, codes, "qtf", keys, per_sub)
        if made:
            parts.append(best(made[0]).join(F.broadcast(made[1]), "group"))
    columns = ["query_id", *(["part"] if by_part else []), "item_id", *keys, "raw"]
    if not parts:
        fields = passes[0].select("query_id").crossJoin(postings.select(F.lit("all").alias("part"), "item_id"))
        fields = fields.withColumns({"sub": F.lit(0).cast("bigint"), "raw": F.lit(0).cast("bigint")})
        return postings.sparkSession.createDataFrame([], fields.select(*columns).schema)
    return reduce(DataFrame.unionByName, parts).select(*columns)


def _bm25_top(postings: DataFrame, sizes: DataFrame, passes: list[DataFrame], params: Bm25, by_part: bool, dictionary: DataFrame | None,
              per_sub: int, k: int) -> DataFrame:
    """The best ``k`` rows of ``_bm25_hits`` per question (sub-query, part)."""
    if dictionary is None:
        dictionary = postings.groupBy("part", "token").agg(F.count(F.lit(1)).alias("df"))
    known, codes = _numbered(dictionary, sizes)
    tids = pa.array(range(known.num_rows), pa.int32())
    numbered = postings.sparkSession.createDataFrame(known.select(["part", "token", "avgdl"]).append_column("tid", tids).combine_chunks(),
                                                     "part string, token string, avgdl double, tid int")
    rows = postings.join(F.broadcast(numbered), ["part", "token"]).withColumn("x", _saturation(params))
    return _per_pass(postings, passes, codes, by_part, per_sub, lambda weights: best_items(rows, weights, k))


def _stored_bm25_top(index, terms: DataFrame, passes: list[DataFrame], params: Bm25, by_part: bool, per_sub: int, k: int) -> DataFrame:
    """``_bm25_top`` over the units of a stored index, where they lie: no posting crosses the network."""
    forward, tokens = index.forward(), _asked_tokens(terms)
    dictionary = document_frequencies(forward, tokens)
    if not by_part:
        dictionary = dictionary.groupBy("token").agg(F.sum("df").alias("df")).withColumn("part", F.lit("all"))
    known, codes = _numbered(dictionary, index.sizes(one_part=not by_part))
    place = {token: i for i, token in enumerate(tokens.to_pylist())}
    numbers: dict[str, tuple[np.ndarray, float]] = {}
    for tid, (part, token, avgdl) in enumerate(zip(*(known[c].to_pylist() for c in ("part", "token", "avgdl")), strict=True)):
        if part not in numbers:
            numbers[part] = np.full(len(tokens), -1), avgdl
        numbers[part][0][place[token]] = tid
    return _per_pass(forward, passes, codes, by_part, per_sub, lambda weights: best_of_units(forward, tokens, numbers, weights, k, params, not by_part))


def bm25_scores(units: DataFrame, queries: DataFrame, params: Bm25 = Bm25(), tokenizer: tx.Tokenizer = tx.words,
                broadcast_rows: int = BROADCAST_ROWS, by_part: bool = False, parts: int = 2, per_sub: int = 0, k: int = 0) -> DataFrame:
    """``(query_id[, part], item_id, raw)``: best unit and best query variant per item.

    ``units`` needs ``tokens`` and ``dl``, or is a stored index (``sources.index``), of which only the buckets of the asked
    tokens are read.  Statistics are kept per ``part`` so that separate indexes have separate idf universes.  ``parts`` bounds
    how many of them there are: weights have at most terms times parts rows.  With ``k`` the best ``k`` items per
    question (sub-query, part) are enough: they are found without a row per posting and question.
    """
    terms = query_terms(queries, tokenizer)
    passes = _passes(terms, broadcast_rows // parts) if k else None
    small = passes is not None and len(passes) == 1 or fits(terms, broadcast_rows // parts)
    if not isinstance(units, DataFrame):
        if passes is not None and units.in_all_buckets(terms):
            return _stored_bm25_top(units, terms, passes, params, by_part, per_sub, k)
        postings, sizes, dictionary = units.postings(terms, one_part=not by_part), units.sizes(one_part=not by_part), None
    else:
        postings = _restricted_postings(units, terms, small)
        per_token = postings.groupBy("part", "token").agg(
            F.count(F.lit(1)).alias("df"), F.sum("dl").cast("bigint").alias("total_dl"),
            F.max("is_unit").alias("is_unit"))
        sizes = per_token.where("is_unit").select("part", F.col("df").alias("n_units"), "total_dl")
        dictionary = per_token.where("not is_unit").select("part", "token", "df")
        postings = postings.where("not is_unit")
    if passes is not None:
        return _bm25_top(postings, sizes, passes, params, by_part, dictionary, per_sub, k)
    return _bm25_hits(postings, sizes, terms, params, small, by_part, dictionary, per_sub)


def normalized_top(scores: DataFrame, k: int, keys: tuple[str, ...] = ("query_id",), raw: str = "raw") -> DataFrame:
    """Top-k strictly positive scores per key, divided by the best one."""
    order = [F.col(raw).desc(), F.col("item_id").asc()]
    top = top_per_key(scores.where(F.col(raw) > 0), list(keys), order, k)
    best = F.max(raw).over(Window.partitionBy(*keys))
    return top.withColumn("score", F.col(raw) / best).withColumn("rank", F.col("rank").cast("bigint"))


def bm25_search(units: DataFrame, queries: DataFrame, k: int = 5, **kw) -> DataFrame:
    """``(query_id, item_id, score, rank)`` with one index over all units."""
    return normalized_top(bm25_scores(units, queries, k=k, **kw), k).select("query_id", "item_id", "score", "rank")


def sub_slots(subs: DataFrame, synonyms: list[tuple[str, str]] = ()) -> DataFrame:
    """``(query_id, variant, text)`` of ``subs(query_id, sub, text)``: each sub-query and its synonyms in slots of their own."""
    wide = [F.when(F.contains("text", F.lit(key)), F.lit(syn)) for key, syn in synonyms]
    variants = subs.select("query_id", "sub", F.posexplode(F.array(F.col("text"), *wide)).alias("place", "text")).where(F.col("text").isNotNull())
    return variants.select("query_id", (F.col("sub") * (len(synonyms) + 1) + F.col("place")).cast("int").alias("variant"), "text")


def bm25_sub_search(units: DataFrame, subs: DataFrame, pool: int, synonyms: list[tuple[str, str]] = (), **kw) -> DataFrame:
    """``(query_id, sub, item_id, score)``: the best items of every sub-query, each list divided by its own best score.

    ``subs(query_id, sub, text)`` numbers the sub-queries of a question from 0; synonyms widen each of them.  All
    sub-queries and synonyms of a question are scored in one pass over the postings.
    """
    scores = bm25_scores(units, sub_slots(subs, synonyms), per_sub=len(synonyms) + 1, k=pool, **kw)
    return normalized_top(scores, pool, ("query_id", "sub")).select("query_id", "sub", "item_id", "score")


def bm25_two_index_search(units: DataFrame, queries: DataFrame, gates: list[tuple[str, str]], pool: int,
                          laws: DataFrame, discount: float = 0.72, core: str = "core", **kw) -> DataFrame:
    """Core index always, specialty parts only for questions with a gate keyword.

    ``units.part`` is ``core`` for core items and ``special`` otherwise;
    ``laws(item_id, law)`` names the collection a gate opens.  ``gates`` are
    ``(law, keyword)`` pairs.  Specialty scores are discounted before the merge.
    """
    scored = bm25_scores(units, queries, by_part=True, k=pool, **kw)
    ranked = normalized_top(scored, pool, ("query_id", "part")).select("query_id", "part", "item_id", "score")
    opened = queries.select(
        "query_id",
        F.explode(F.array_distinct(F.filter(
            F.array(*[F.when(F.contains("text", F.lit(word)), F.lit(law)) for law, word in gates]),
            lambda g: g.isNotNull()))).alias("law"))
    special = (ranked.where(F.col("part") != core)
               .join(laws, "item_id").join(opened, ["query_id", "law"], "left_semi")
               .select("query_id", "item_id", (F.col("score") * discount).alias("score")))
    merged = (ranked.where(F.col("part") == core).select("query_id", "item_id", "score")
              .unionByName(special).groupBy("query_id", "item_id").agg(F.max("score").alias("raw")))
    return normalized_top(merged, pool).select("query_id", "item_id", "score", "rank")


def full_postings(units: DataFrame) -> DataFrame:
    """All postings.  The token arrays are shuffled once, before they are exploded."""
    placed = units.select("item_id", "unit_no", "tokens").repartition(fan_out_partitions(units), "item_id", "unit_no")
    marks = F.concat(F.array(F.lit(UNIT_MARK)), F.col("tokens"))
    return (placed.select("item_id", "unit_no", F.explode(marks).alias("token"))
            .groupBy("item_id", "unit_no", "token")
            .agg(F.count(F.lit(1)).alias("tf"), F.max(F.col("token") == UNIT_MARK).alias("is_unit")))


def attach_dictionary(postings: DataFrame, dictionary: DataFrame, hot_df: int = 1_000_000,
                      rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join postings to their token statistics.

    A small dictionary is broadcast.  A large one is split: tokens with more
    than ``hot_df`` postings join by broadcast, the rest has no heavy key left
    and joins by shuffle.  ``hot_df`` is raised until the heavy ones fit.
    """
    if fits(dictionary, rows):
        return postings.join(F.broadcast(dictionary), "token")
    hot = dictionary.where(F.col("df") > hot_df)
    while not fits(hot, rows):
        hot_df = 4 * max(hot_df, 1)
        hot = dictionary.where(F.col("df") > hot_df)
    cold = dictionary.where(F.col("df") <= hot_df)
    warm = postings.join(F.broadcast(hot), "token")
    rest = postings.join(F.broadcast(hot.select("token")), "token", "left_anti").join(cold, "token")
    return warm.unionByName(rest.select(*warm.columns))


def tfidf_search(units: DataFrame, queries: DataFrame, k: int = 5, tokenizer: tx.Tokenizer = tx.mixed_features,
                 broadcast_rows: int = BROADCAST_ROWS, hot_df: int = 1_000_000, normalize: bool = False) -> DataFrame:
    """Cosine over ``(1+ln tf)·(ln((N+1)/(df+1))+1)``; best unit per item.

    Returns ``(query_id, item_id, score, rank)``; ``normalize`` divides by the
    best score of the question.  ``units`` may be a stored index.
    """
    if isinstance(units, DataFrame):
        postings = full_postings(units)
        per_token = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.max("is_unit").alias("is_unit"))
        total = per_token.where("is_unit").select(F.col("df").alias("n_units"))
        dictionary, postings = per_token.where("not is_unit"), postings.where("not is_unit")
    else:
        return _stored_tfidf(units, queries, k, tokenizer, broadcast_rows, hot_df, normalize)
    weighted = attach_dictionary(postings, _tfidf_dictionary(dictionary, total), hot_df, broadcast_rows)
    weighted = weighted.select("item_id", "unit_no", "token", _tfidf_weight().alias("w"))
    terms = query_terms(queries, tokenizer)
    passes = _passes(terms, broadcast_rows)
    if passes is not None:
        held = weighted.join(F.broadcast(terms.select("token").distinct()), "token", "left_semi") if len(passes) == 1 else weighted
        return _tfidf_best(held, _tfidf_dictionary(dictionary, total), passes, _unit_norms(weighted), k, normalize)
    asked = _join_terms(weighted, _query_weights(terms, _tfidf_dictionary(dictionary, total)), ["token"], fits(terms, broadcast_rows))
    return _tfidf_top(asked, _unit_norms(weighted), k, normalize)


def _tfidf_dictionary(df_by_token: DataFrame, total: DataFrame) -> DataFrame:
    idf = F.log((F.col("n_units") + 1) / (F.col("df") + 1)) + 1
    return with_scalars(df_by_token, total).select("token", "df", idf.alias("idf"))


def _tfidf_weight() -> Column:
    return (1 + F.log("tf")) * F.col("idf")


def _query_weights(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    known = terms.join(dictionary, "token").select("query_id", "token", ((1 + F.log("qtf")) * F.col("idf")).alias("qw"))
    q_norm = F.sqrt(from_fixed(fixed_sum(F.col("qw") * F.col("qw")).over(Window.partitionBy("query_id"))))
    return known.select("query_id", "token", (F.col("qw") / q_norm).alias("qw"))


def _unit_norms(weighted: DataFrame) -> DataFrame:
    return weighted.groupBy("item_id", "unit_no").agg(F.sqrt(from_fixed(fixed_sum(F.col("w") * F.col("w")))).alias("dn"))


def _tfidf_top(asked: DataFrame, norms: DataFrame, k: int, normalize: bool) -> DataFrame:
    dots = asked.join(norms, ["item_id", "unit_no"]).groupBy("query_id", "item_id", "unit_no").agg(
        fixed_sum(F.col("qw") * (F.col("w") / F.col("dn"))).alias("raw"))
    return _tfidf_ranked(dots.where(F.col("raw") > 0).groupBy("query_id", "item_id").agg(F.max("raw").alias("raw")), k, normalize)


def _tfidf_ranked(best: DataFrame, k: int, normalize: bool) -> DataFrame:
    top = normalized_top(best, k)
    score = F.col("score") if normalize else F.col("raw") / F.lit(float(SCALE))
    return top.select("query_id", "item_id", score.alias("score"), "rank")


def _stored_statistics(index, broadcast_rows: int = BROADCAST_ROWS, hot_df: int = 1_000_000) -> dict[str, DataFrame]:
    """``dictionary(token, df, idf)`` and ``norms(item_id, unit_no, dn)`` of an index version.

    Every document frequency enters the norms, so each version has its own, written once.  The units are read once to count and once to weigh.
    """
    folder = f"{index.folder}/norms-{index.version}"

    def build() -> dict[str, DataFrame]:
        postings = postings_of(index.forward()).select("item_id", "unit_no", "token", "tf")  # a unit's rows stand together: one sum each is sent
        counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
        dictionary = cut_table(_tfidf_dictionary(counts, index.sizes(True).select("n_units")))
        weighted = attach_dictionary(postings, dictionary, hot_df, broadcast_rows)
        return {"dictionary": dictionary, "norms": _unit_norms(weighted.select("item_id", "unit_no", _tfidf_weight().alias("w")))}

    snapshots.build_if_absent(index.spark, folder, build)
    return snapshots.open_snapshot(index.spark, folder)


def stored_norms(index, broadcast_rows: int = BROADCAST_ROWS, hot_df: int = 1_000_000) -> DataFrame:
    """``(item_id, unit_no, dn)`` of an index version."""
    return _stored_statistics(index, broadcast_rows, hot_df)["norms"]


def _tfidf_best(weighted: DataFrame, dictionary: DataFrame, passes: list[DataFrame], norms: DataFrame, k: int, normalize: bool) -> DataFrame:
    """``_tfidf_top`` of ``weighted(item_id, unit_no, token, w)`` without a row per posting and question."""
    spark, parts = weighted.sparkSession, []
    one = F.lit("all").alias("part")
    norms = norms.where(F.col("item_id").isNotNull()).select(one, "item_id", "unit_no", F.col("dn").alias("x"))
    for terms in passes:
        asked = terms.select("token").distinct()
        own = dictionary.join(F.broadcast(asked), "token", "left_semi")
        q = _query_weights(terms, own)
        tokens = q.select("token").distinct().toArrow()
        codes = {token: [(tid, 1.0)] for tid, token in enumerate(tokens["token"].to_pylist())}
        made = _columns(q, codes, "qw", [])
        if made is None:
            continue
        numbered = spark.createDataFrame(tokens.append_column("tid", pa.array(range(len(codes)), pa.int32())).combine_chunks(), "token string, tid int")
        rows = weighted.where(F.col("item_id").isNotNull()).join(F.broadcast(numbered), "token").select(one, "item_id", "unit_no", "tid", F.col("w").alias("x"))
        parts.append(best_items(rows, made[0], k, norms).join(F.broadcast(made[1]), "group").select("query_id", "item_id", "raw"))
    if not parts:
        empty = passes[0].select("query_id").crossJoin(weighted.select("item_id")).withColumns({"raw": F.lit(0).cast("bigint")})
        parts = [spark.createDataFrame([], empty.schema)]
    return _tfidf_ranked(reduce(DataFrame.unionByName, parts), k, normalize)


def _stored_tfidf(index, queries: DataFrame, k: int, tokenizer: tx.Tokenizer, broadcast_rows: int, hot_df: int, normalize: bool) -> DataFrame:
    terms = query_terms(queries, tokenizer)
    passes = _passes(terms, broadcast_rows)
    if passes is not None and index.in_all_buckets(terms):
        postings = postings_of(index.forward(), _asked_tokens(terms)).select("item_id", "unit_no", "token", "tf")
    else:
        postings = index.postings(terms).select("item_id", "unit_no", "token", "tf")
    known = _stored_statistics(index, broadcast_rows, hot_df)
    dictionary = lookup_join(known["dictionary"], terms.select("token").distinct(), "token")
    if passes is not None:
        held = cut_lineage(dictionary)  # asked tokens only; every slice and the postings read it
        weighted = attach_dictionary(postings, held, hot_df, broadcast_rows).select("item_id", "unit_no", "token", _tfidf_weight().alias("w"))
        return _tfidf_best(weighted, held, passes, known["norms"], k, normalize)
    q = _query_weights(terms, dictionary).join(dictionary.select("token", "idf"), "token")
    hits = _join_terms(postings, q, ["token"], fits(terms, broadcast_rows))
    asked = hits.select("query_id", "item_id", "unit_no", "qw", _tfidf_weight().alias("w"))
    return _tfidf_top(asked, known["norms"], k, normalize)


__all__ = [
    "attach_dictionary", "bm25_scores", "bm25_search", "bm25_sub_search", "bm25_two_index_search", "expand_queries", "explode_units",
    "full_postings", "normalized_top", "query_terms", "stored_norms", "sub_slots", "tfidf_search", "to_fixed", "tokenized", "variant_slots",
]
