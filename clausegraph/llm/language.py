"""Language identification with hyperdimensional profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from clausegraph.llm.common import spread_rows

DIMS = 1024
GRAM = 3
#: Contrast of the cosines in the score.
CONTRAST = 24.0
UNKNOWN = "und"


@lru_cache(1)
def letter_table() -> np.ndarray:
    """Code point of every letter, 0 for anything else."""
    table = np.arange(0x110000, dtype=np.int32)
    table[[not chr(c).isalpha() for c in range(0x110000)]] = 0
    return table


def letter_vectors(letters: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """(letters, dims) of -1 and 1: pseudo-random bits of a hash of letter and position."""
    words = np.arange(dims // 64, dtype=np.uint64)[None, :] + letters.astype(np.uint64)[:, None] * np.uint64(0x1F123BB5)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            words = (words + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(factor)
            words ^= words >> np.uint64(shift)
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(letters), -1), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n-grams of whole texts: letters (distinct), grams (n columns of letter numbers), rows and columns of the counts
    are returned as ``letters, grams, pair, count`` with ``pair = row * len(grams) + column``.

    Texts are lower-cased; runs of anything but letters are one boundary mark, also at both ends.
    """
    coded = []
    table = letter_table()
    for row, text in enumerate(texts):
        codes = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        codes = np.concatenate(([0], codes, [0]))
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0)
        codes = codes[keep]
        coded.append(codes if len(codes) >= GRAM else codes[:0])
    lengths = np.array([len(c) for c in coded])
    flat = np.concatenate(coded) if coded else np.zeros(0, np.int32)
    if not len(flat):
        none = np.zeros(0, np.int64)
        return none, np.zeros((0, GRAM), np.int64), none, none
    present = np.zeros(0x110000, bool)
    present[flat] = True
    letters = np.flatnonzero(present)
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(len(letters))
    small, k = number[flat], len(letters)
    gram = (small[:-2] * k + small[1:-1]) * k + small[2:]
    rows = np.repeat(np.arange(len(texts)), lengths)
    inside = rows[:-2] == rows[2:]
    gram, rows = gram[inside], rows[:-2][inside]
    if k**GRAM <= 1 << 24:
        seen = np.flatnonzero(np.bincount(gram, minlength=1))
        place = np.zeros(int(seen[-1]) + 1, np.int64)
        place[seen] = np.arange(len(seen))
        column = place[gram]
    else:
        seen, column = np.unique(gram, return_inverse=True)
    grams = np.stack((seen // (k * k), seen // k % k, seen % k), axis=1)
    return letters, grams, rows * len(seen) + column, np.ones(len(column), np.int64)


def gram_vectors(letters: np.ndarray, grams: np.ndarray, dims: int) -> np.ndarray:
    """Bind the letters of each n-gram: earlier letters are permuted (rotated) once more than later ones."""
    base = letter_vectors(letters, dims)
    bound = base[grams[:, GRAM - 1]]
    for place in range(GRAM - 1):
        bound = bound * np.roll(base, GRAM - 1 - place, axis=1)[grams[:, place]]
    return bound


def in_pieces(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` characters and at most 256 rows."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most or i + 1 - start >= 256:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", dims: int = DIMS) -> dict[str, np.ndarray]:
    """Prototype of every language: the bundle (sum) of the n-gram vectors of all its texts.

    Every task sums its texts; integer sums per language are added up by Spark.  The result is one vector per
    language, whatever the input.  Null languages and texts teach nothing.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in in_pieces(texts):
                letters, grams, pair, _ = gram_counts(texts[a:b])
                if not len(grams):
                    continue
                vectors = gram_vectors(letters, grams, dims)
                known = {n: i for i, n in enumerate(dict.fromkeys(names[a:b]))}
                owner = np.array([known[n] for n in names[a:b]])[pair // len(grams)]
                counts = np.bincount(owner * len(grams) + pair % len(grams), minlength=len(known) * len(grams))
                bundle = counts.reshape(len(known), -1).astype(np.float64) @ vectors.astype(np.float64)
                for name, i in known.items():
                    sums[name] = sums.get(name, 0) + bundle[i].astype(np.int64)
        names = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([sums[n].tolist() for n in names], pa.list_(pa.int64()))], ["lang", "v"])

    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = spread_rows(rows).mapInArrow(run, "lang string, v array<long>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("lang", "v.x")
    return {r["lang"]: np.array(r["x"], np.float64) for r in sorted(found.collect(), key=lambda r: r["lang"])}


def classify(texts: list[str | None], names: list[str], prototypes: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of whole texts; (``und``, 0) without letters or without any prototype."""
    labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not names:
        return labels, scores
    dims = prototypes.shape[1]
    unit = prototypes / np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    for a, b in in_pieces(texts):
        letters, grams, pair, _ = gram_counts([t or "" for t in texts[a:b]])
        if not len(grams):
            continue
        counts = np.bincount(pair, minlength=(b - a) * len(grams)).reshape(b - a, -1)
        exact = np.float32 if counts.sum(1).max() < 1 << 24 else np.float64  # integer sums stay exact
        bundle = (counts.astype(exact) @ gram_vectors(letters, grams, dims).astype(exact)).astype(np.float64)
        size = np.linalg.norm(bundle, axis=1)
        cosine = bundle @ unit.T / np.maximum(size, 1e-12)[:, None]
        weight = np.exp(CONTRAST * (cosine - cosine.max(1, keepdims=True)))
        best = cosine.round(9).argmax(1)
        share = (weight / weight.sum(1, keepdims=True))[np.arange(b - a), best]
        for i in np.flatnonzero(counts.sum(1)).tolist():
            labels[a + i], scores[a + i] = names[int(best[i])], round(float(share[i]), 6)
    return labels, scores


def held_out(key: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with all columns, the nearest language by cosine and a score from 0 to 1.

    Scores are the share of the winner among the exponentials of the scaled cosines.  Null texts, texts without a
    letter, and all texts if no language was learned give ``und`` and 0; equal cosines give the first language by
    name.  Existing columns named like the new ones are replaced.
    """
    names = list(prototypes)
    matrix = np.stack([prototypes[n] for n in names]) if names else np.zeros((0, DIMS))
    kept = docs.drop(label, score)
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, scores = classify(batch.column(place).to_pylist(), names, matrix)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels, pa.string()), pa.array(scores)], [*batch.schema.names, label, score])

    schema = StructType([*kept.schema.fields, StructField(label, StringType()), StructField(score, DoubleType())])
    return spread_rows(kept).mapInArrow(run, schema)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", dims: int = DIMS) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``, learned from the rows that are not held out.

    Rows with a null key are never held out.  Other columns are ignored; an empty table gives no rows.
    """
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).alias("lang"))
    prototypes = train(slim.where(~held_out()), "lang", "text", dims)
    return identify(slim.select("doc_id", held_out().alias("held_out"), "text"), prototypes).drop("text")
