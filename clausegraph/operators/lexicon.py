"""Phrase lexicons: one containment pass per text, rules on the result."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NATIVE_PHRASES = 256
AUTOMATON_PHRASES = 200_000


def _automaton_udf(spark, phrases: list[str], ids: list[int]):
    """Arrow UDF returning the ids of all phrases contained in a text (one pass per text)."""
    shared = spark.sparkContext.broadcast((phrases, ids))

    @F.pandas_udf("array<bigint>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        words, numbers = shared.value
        machine = ahocorasick.Automaton()
        for word, number in zip(words, numbers):
            machine.add_word(word, machine.get(word, ()) + (number,))
        machine.make_automaton()
        for texts in batches:
            yield texts.map(lambda t: sorted({n for _, ns in machine.iter(t) for n in ns}) if t else [])

    return hits


class PhraseMatcher:
    """Finds which of a fixed phrase list each text contains.

    ``annotate`` adds an array of phrase numbers; ``any_of`` / ``all_of`` are then
    cheap array predicates, so a rule set reads every text once.
    """

    def __init__(self, phrases: Iterable[str], column: str = "_phrases"):
        self.phrases = list(dict.fromkeys(p for p in phrases if p))
        self.index = {p: i for i, p in enumerate(self.phrases)}
        self.column = column

    def annotate(self, df: DataFrame, text: Column | str) -> DataFrame:
        c = F.col(text) if isinstance(text, str) else text
        c = F.coalesce(c, F.lit(""))
        if not self.phrases:
            return df.withColumn(self.column, F.array().cast("array<bigint>"))
        if len(self.phrases) > NATIVE_PHRASES:
            udf = _automaton_udf(df.sparkSession, self.phrases, list(range(len(self.phrases))))
            return df.withColumn(self.column, udf(c))
        entries = F.array(*[F.struct(F.lit(i).cast("bigint").alias("i"), F.lit(p).alias("p"))
                            for p, i in self.index.items()])
        found = F.transform(F.filter(entries, lambda e: F.contains(c, e.p)), lambda e: e.i)
        # A one-element explode keeps later filters from copying the scan of the
        # text into every predicate they test.
        return df.withColumn(self.column, F.explode(F.array(found)))

    def _numbers(self, phrases: Iterable[str]) -> list[int]:
        return [self.index[p] for p in phrases if p in self.index]

    def any_of(self, phrases: Iterable[str]) -> Column:
        numbers = self._numbers(phrases)
        if not numbers:
            return F.lit(False)
        return F.arrays_overlap(F.col(self.column), F.array(*[F.lit(n).cast("bigint") for n in numbers]))

    def canonicals(self, mapping: Iterable[tuple[str, Iterable[str]]]) -> Column:
        """Names whose phrases occur, in the order of ``mapping``, each once."""
        names = [F.when(self.any_of(phrases), F.lit(name)) for name, phrases in mapping]
        if not names:
            return F.array().cast("array<string>")
        return F.filter(F.array(*names), lambda n: n.isNotNull())

    def first(self, mapping: Iterable[tuple[str, Iterable[str]]]) -> Column:
        """First name of ``mapping`` with a contained phrase, else NULL."""
        names = [F.when(self.any_of(phrases), F.lit(name)) for name, phrases in mapping]
        return F.coalesce(*names) if names else F.lit(None).cast("string")


def contains_join(texts: DataFrame, terms: DataFrame, text: str = "text", term: str = "term", term_id: str = "term_id",
                  chunk: int = AUTOMATON_PHRASES) -> DataFrame:
    """Rows of ``texts`` with every ``term_id`` whose term occurs in them.

    Whole texts are read once per chunk of the term table.  A chunk has a checked
    number of terms, so the automaton that every task builds is bounded; larger
    term tables simply need further passes.
    """
    spark = texts.sparkSession
    total = terms.count()
    passes = 1 if total <= chunk else -(-total * 2 // chunk)
    out = None
    for number in range(passes):
        part = terms if passes == 1 else terms.where(F.pmod(F.xxhash64(term_id), F.lit(passes)) == number)
        rows = part.select(F.col(term_id).cast("bigint"), term).limit(chunk + 1).collect()
        if len(rows) > chunk:
            raise ValueError("term chunk exceeds its bound; use a larger chunk")
        kept = [(r[0], r[1]) for r in rows if r[1]]
        if not kept:
            continue
        udf = _automaton_udf(spark, [t for _, t in kept], [i for i, _ in kept])
        hit = texts.withColumn(term_id, F.explode(udf(F.coalesce(text, F.lit("")))))
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        out = texts.limit(0).withColumn(term_id, F.lit(None).cast("bigint"))
    return out


def unknown_terms(texts: DataFrame, known: DataFrame, pattern: str, item: str = "item_id", text: str = "text",
                  skip: Iterable[str] = (), k: int = 40) -> DataFrame:
    """Frequent pattern runs that no lexicon knows, with the first item they occur in."""
    runs = texts.select(item, F.explode(F.regexp_extract_all(text, F.lit(pattern), F.lit(1))).alias("term"))
    counted = runs.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("first_item"))
    for word in skip:
        counted = counted.where(~F.contains("term", F.lit(word)))
    fresh = counted.join(known.select("term").distinct(), "term", "left_anti")
    return fresh.orderBy(F.col("n").desc(), F.col("term").asc()).limit(k)
