"""Toxicity from the nearest labelled examples by TF-IDF cosine over all their terms, weighted by class contrast, with a block-max inverted index."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import spread_rows
from clausegraph.session import cut_lineage

#: Labelled examples of each class that are fitted at most, by the smallest seeded hash of their key.
PER_CLASS = 2000
#: Neighbours that vote, and examples of a block.
NEIGHBOURS, BLOCK = 25, 32
TERM = re.compile(r"[^\W\d_]+")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def terms(text: str | None) -> Counter:
    return Counter(TERM.findall((text or "").lower()))


def term_counts(docs: DataFrame, extra: str) -> DataFrame:
    """``(id, label, term, n)`` of every text of ``docs(id, label, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = terms(batch.column(2)[at].as_py())
                take = pa.array([at] * len(found), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
                    ["id", "label", "term", "n"])

    return docs.mapInArrow(run, f"id {extra}, label int, term string, n long")


def class_contrast(counts: list[dict[str, int]], labels: np.ndarray, names: dict[str, int]) -> np.ndarray:
    """z of each term: the log-odds of holding it in the one class against the other, over their standard error (0.5 added to each count)."""
    held = np.zeros((2, len(names)))
    for label, own in zip(labels.tolist(), counts, strict=True):
        held[int(label), [names[t] for t in own]] += 1
    total = np.array([(labels == y).sum() for y in (0, 1)], float)[:, None]
    with_, without = held + 0.5, total - held + 0.5
    odds = np.log(with_ / without)
    return (odds[1] - odds[0]) / np.sqrt((1 / with_ + 1 / without).sum(0))


def spread(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and the size of each range."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes), sizes


class Examples:
    """Labelled examples as a block-max inverted index.

    A term weighs its inverse document frequency times ``1 + z ** 2`` (``class_contrast``): every term counts, those that
    tell the classes apart count more, and an equal text still has a cosine of 1.  Postings list the examples that
    hold a term with their weights, in blocks of examples, with the largest weight of each block.  A query adds up
    these largest weights to a bound for each block; the best blocks are scored first, then only those whose bound
    reaches the k-th best cosine: the result is exact.  ``scored`` and ``offered`` count blocks.
    """

    def __init__(self, ids: list, labels: np.ndarray, counts: list[dict[str, int]], weights: dict[int, float]) -> None:
        found = Counter(t for c in counts for t in c)
        self.terms = {t: i for i, t in enumerate(sorted(found))}
        self.idf = np.array([math.log((1 + len(ids)) / (1 + found[t])) + 1 for t in self.terms]) * (1 + class_contrast(counts, labels, self.terms) ** 2)
        self.scored = self.offered = 0
        rows = [self.vector(c) for c in counts]
        order = sorted(range(len(ids)), key=lambda i: (len(rows[i][0]) == 0, rows[i][0][rows[i][1].argmax()] if len(rows[i][0]) else 0, labels[i], i))
        self.ids, self.labels = [ids[i] for i in order], labels[order].astype(np.float64)
        self.vote = np.array([weights[int(y)] for y in self.labels])
        self.rows = [rows[i] for i in order]
        self.blocks = -(-len(ids) // BLOCK)
        owner = np.repeat(np.arange(len(self.rows)), [len(r[0]) for r in self.rows])
        columns, values = (np.concatenate([r[i] for r in self.rows]) for i in range(2))
        by_term = np.argsort(columns, kind="stable")  # examples ascend within a term
        columns, self.owner, self.values = columns[by_term], owner[by_term].astype(np.int32), values[by_term]
        block = self.owner // BLOCK
        fresh = np.ones(len(block), bool)
        fresh[1:] = (block[1:] != block[:-1]) | (columns[1:] != columns[:-1])
        heads = np.flatnonzero(fresh)
        #: one entry for each term and block: its first posting, block and largest weight; ``cuts`` has the entries of each term
        self.heads, self.block = np.append(heads, len(block)), block[heads]
        self.most = np.maximum.reduceat(self.values, heads) if len(heads) else self.values
        self.cuts = np.searchsorted(columns[heads], np.arange(len(self.terms) + 1))
        empty = np.array([not len(r[0]) for r in self.rows], bool)
        #: share of label 1 among examples without a known term, or among all
        self.base = self.share(self.labels[empty], self.vote[empty]) if empty.any() else self.share(self.labels, self.vote)
        self.steps = self.calibrate()

    @staticmethod
    def share(labels: np.ndarray, weights: np.ndarray) -> float:
        return float((labels * weights).sum() / weights.sum()) if weights.sum() else 0.0

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers and unit weights of the known terms, in the order of the numbers."""
        columns = np.fromiter(map(self.terms.get, counts, repeat(-1)), np.int64, len(counts))
        numbers = np.fromiter(counts.values(), np.float64, len(counts))[columns >= 0]
        columns = columns[columns >= 0]
        order = np.argsort(columns)
        columns = columns[order]
        values = (1 + np.log(numbers[order])) * self.idf[columns]
        return columns, values / math.sqrt((values * values).sum()) if len(values) else values

    def nearest(self, columns: np.ndarray, values: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines; equal cosines in the order of the index."""
        if not len(columns):
            return np.zeros(0, np.int64), np.zeros(0)
        entries, sizes = spread(self.cuts[columns], self.cuts[columns + 1])
        block, weight = self.block[entries], np.repeat(values, sizes)
        bound = np.bincount(block, self.most[entries] * weight, minlength=self.blocks)
        scores = np.zeros(self.blocks * BLOCK)

        def score(chosen: np.ndarray) -> None:
            mine = chosen[block]
            places, sizes = spread(self.heads[entries[mine]], self.heads[entries[mine] + 1])
            np.add(scores, np.bincount(self.owner[places], self.values[places] * np.repeat(weight[mine], sizes), minlength=len(scores)), out=scores)
            if skip >= 0:
                scores[skip] = 0.0

        first = np.zeros(self.blocks, bool)
        count = min(self.blocks, -(-2 * (k + 1) // BLOCK))
        first[np.argpartition(-bound, count - 1)[:count]] = True
        score(first)
        least = np.partition(scores, -k)[-k] if len(scores) >= k else 0.0
        rest = (bound >= least - 1e-12) & (bound > 0) & ~first
        score(rest)
        self.scored += int(count + rest.sum())
        self.offered += self.blocks
        at = np.flatnonzero(scores > 0)
        if len(at) > k:
            at = at[scores[at] >= np.partition(scores[at], -k)[-k] - 1e-11]  # ties at the end are ordered below
        order = np.lexsort((at, -scores[at].round(12)))[:k]
        return at[order], scores[at[order]]

    def raw(self, columns: np.ndarray, values: np.ndarray, skip: int = -1) -> tuple[float, np.ndarray, np.ndarray]:
        """Share of label 1 in the votes, each by the squared cosine and the weight of its class."""
        at, cosine = self.nearest(columns, values, NEIGHBOURS, skip)
        vote = cosine**2 * self.vote[at]
        lone = max(0.0, 1.0 - float(cosine[0]) if len(cosine) else 1.0) * 1e-3  # far neighbours lean on the base rate
        return float(((vote * self.labels[at]).sum() + lone * self.base) / (vote.sum() + lone)) if len(at) else self.base, at, cosine

    def calibrate(self) -> tuple[np.ndarray, np.ndarray]:
        """Isotonic steps from the votes that each example gets from the others to the share of label 1."""
        pairs = sorted((self.raw(*row, skip=i)[0], i) for i, row in enumerate(self.rows) if len(row[0]))
        pools: list[list[float]] = []  # score, weighted labels, weight
        for score, i in pairs:
            pools.append([score, self.labels[i] * self.vote[i], self.vote[i]])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1][1] += last[1]
                pools[-1][2] += last[2]
        return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])

    def score(self, counts: Counter) -> tuple[float, list[tuple]]:
        """Calibrated score and the five nearest examples ``(id, cosine, label)``."""
        columns, values = self.vector(counts)
        if not len(columns):
            return round(self.base, 6), []
        raw, at, cosine = self.raw(columns, values)
        score = float(np.interp(raw, *self.steps)) if len(self.steps[0]) else raw
        return round(min(1.0, max(0.0, score)), 6), [(self.ids[i], round(float(c), 6), int(self.labels[i])) for i, c in zip(at[:5].tolist(), cosine[:5].tolist(), strict=True)]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = PER_CLASS) -> Examples | None:
    """Index of at most ``per_class`` labelled examples of each class; None without any.

    All terms of the examples count, each by its inverse document frequency and ``1 + z ** 2``.  Classes are weighted back to their shares among all labelled rows.  Held-out rows and null
    labels teach nothing; of several labels of one row the largest counts.
    """
    marks = labels.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label")).where(
        F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out("id")).groupBy("id").agg(F.max("label").alias("label"))
    marks = cut_lineage(marks)
    totals = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64(F.lit(3), "id"), F.col("id")]
    chosen = cut_lineage(marks.where("label = 1").orderBy(*order).limit(per_class).unionByName(marks.where("label = 0").orderBy(*order).limit(per_class)))
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "label", "text")
    counts = cut_lineage(term_counts(texts, kind))
    # one text of terms and one of counts an example: much smaller on the driver than a row a term
    held = counts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("term", "n"))).alias("found")).select(
        "id", F.array_join("found.term", " ").alias("terms"), F.array_join(F.col("found.n").cast("array<string>"), " ").alias("n"))
    rows = chosen.join(held, "id").orderBy("id").collect()  # bounded by ``per_class``
    if not rows:
        return None
    weights = {y: totals[y] / max(1, sum(r["label"] == y for r in rows)) for y in totals}
    found = [dict(zip(map(sys.intern, r["terms"].split(" ")), map(int, r["n"].split(" ")), strict=True)) for r in rows]
    return Examples([r["id"] for r in rows], np.array([r["label"] for r in rows]), found, weights)


def score(docs: DataFrame, examples: Examples | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)``, one row per row of ``docs``.

    Texts without a known term, null and empty ones too, get the share of label 1 among such examples; without any
    example all scores are 0.  ``evidence`` lists the nearest examples.  Other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(examples)  # at most 2 x per_class examples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[bytes, tuple] = {}
        for batch in batches:
            out = []
            for value in batch.column(2):
                plain = value.as_py() or ""
                own = xxhash.xxh3_128_digest(plain)
                if own not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[own] = model.score(terms(plain)) if model else (0.0, [])
                out.append(known[own])
            evidence = pa.array([[{"id": e[0], "cosine": e[1], "label": e[2]} for e in x[1]] for x in out],
                                pa.list_(pa.struct([("id", batch.schema.field(0).type), ("cosine", pa.float64()), ("label", pa.int32())])))
            scores = pa.array([x[0] for x in out], pa.float64())
            predicted = pa.array([int(x[0] >= 0.5) for x in out], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores, predicted, evidence], ["doc_id", "held_out", "score", "predicted", "evidence"])

    slim = spread_rows(docs.select(F.col(key).alias("doc_id"), held_out(key).alias("held_out"), F.col(text).cast("string").alias("text")))
    return slim.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence array<struct<id:{kind},cosine:double,label:int>>")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all rows of ``docs`` from the labelled rows that are not held out."""
    return score(docs, fit(docs, labels))
