"""Spelling variants: words one edit apart, found through one-edit neighbourhoods over a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import cut_table, spread_rows
from clausegraph.session import cut_lineage

#: Code points of a word and its occurrences, at least.
LENGTH, COUNT = 7, 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: Symbols of the reduced alphabet; a letter's symbol is its code point modulo this.
SYMBOLS = 8
#: One run of a document in so many loses a letter.
DAMAGE = 31
#: Distinct words, and their characters, that a task adds up before it passes them on.
HELD, HELD_CHARACTERS = 300_000, 1 << 24
#: Reduced words that are hashed at once, by their letters.
CHUNK = 200_000
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LENGTH)  # a shorter run gives no word
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def ascii_lower(text: str) -> str:
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def damaged(key, run: str) -> str:
    """The run, or the run without one letter where the crc32 of ``key:run`` says so."""
    h = zlib.crc32(f"{key}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1:] if h % DAMAGE == 0 else run


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, n)`` of all words of ``LENGTH`` or more code points that occur ``COUNT`` times or more.

    A task adds up the words it meets before they are shuffled, so a frequent word costs a few rows a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                prefix = "null" if doc is None else doc
                for own, n in Counter(RUN.findall(ascii_lower(value.as_py() or ""))).items():
                    word = damaged(prefix, own)
                    if len(word) >= LENGTH:
                        if word not in held:
                            size += len(word)
                        held[word] += n
                if len(held) >= HELD or size >= HELD_CHARACTERS:
                    yield out()
                    held.clear()
                    size = 0
        yield out()

    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    found = spread_rows(slim).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= COUNT)


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (from 1) of all letters of the words in a row, and the length of each word."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return codes % np.uint64(SYMBOLS) + np.uint64(1), np.array([len(w) for w in words], np.int64)


def finish(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mix the polynomial with the length, so that close words get distant numbers."""
    mixed = (hashes ^ (sizes.astype(np.uint64) * _MIX)) * _MIX
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def powers(count: int) -> np.ndarray:
    out = np.full(count, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def reduced_keys(words: list[str]) -> np.ndarray:
    """64-bit hash of each reduced word."""
    codes, sizes = symbols(words)
    starts = np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(starts, sizes)
    return finish(np.add.reduceat(codes * powers(int(sizes.max()))[place], starts), sizes)


def neighbour_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``(owner, key)``: hashes of the one-edit neighbourhoods of the reduced words, in arrays over all of them.

    Of each neighbourhood the shorter words and those with a larger symbol are listed; the rest would only give the
    same pairs of reduced words again, seen from the other one.
    """
    codes, sizes = symbols(words)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(codes)) - starts[owner]
    weight = powers(int(sizes.max()) + 1)
    terms = codes * weight[place]
    run = np.cumsum(terms, dtype=np.uint64)  # wraps, as all sums here do
    total = np.add.reduceat(terms, starts)
    before = run - terms - (run[starts] - terms[starts])[owner]  # sum of the earlier letters of the word
    after = total[owner] - before - terms
    inverse = np.uint64(pow(int(_BASE), -1, 2**64))
    owners, keys = [owner], [finish(before + after * inverse, sizes[owner] - 1)]  # without the letter the later ones move up
    for step in range(1, SYMBOLS):
        fits = codes + np.uint64(step) <= np.uint64(SYMBOLS)
        owners.append(owner[fits])
        keys.append(finish(total[owner[fits]] + np.uint64(step) * weight[place[fits]], sizes[owner[fits]]))
    return np.concatenate(owners), np.concatenate(keys)


def with_keys(words: DataFrame) -> DataFrame:
    """``(word, n, key)`` with the hash of the reduced word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = pa.array(reduced_keys(batch.column(0).to_pylist()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), keys], ["word", "n", "key"])

    return words.mapInArrow(run, "word string, n long, key long")


def neighbourhoods(words: DataFrame) -> DataFrame:
    """``(key, near)``: the key of each reduced word next to the keys of its neighbourhood, from ``words(word, key)`` with one word a key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, own = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ends = np.cumsum([len(w) for w in words])
            at = 0
            while at < len(words):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
                owner, keys = neighbour_keys(words[at:stop])
                order = np.lexsort((keys, owner))  # the same neighbour can be reached by several edits
                owner, keys = owner[order], keys[order]
                fresh = np.ones(len(keys), bool)
                fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(own[at:stop][owner[fresh]]), pa.array(keys[fresh])], ["key", "near"])
                at = stop

    return words.select("word", "key").mapInArrow(run, "key long, near long")


def one_edit(a: Column, b: Column) -> Column:
    """Exactly one inserted, deleted or replaced code point; the distance is cut off at one, so long words cost no square."""
    return F.levenshtein(a, b, 1) == 1


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``(a, na, b, nb)`` of words one edit apart, each pair once, from ``words(word, n, key)``.

    Two such words have equal reduced words, or reduced words one edit apart.  Slim pairs of reduced words are joined
    first; the words behind them then meet and are compared letter by letter.
    """
    one = words.groupBy("key").agg(F.min("word").alias("word"), F.count(F.lit(1)).alias("members"))
    one = cut_table(one)
    listed = neighbourhoods(one).join(one.select(F.col("key").alias("near")), "near").select("key", "near")
    left = words.select("key", F.col("word").alias("a"), F.col("n").alias("na"))
    right = words.select(F.col("key").alias("near"), F.col("word").alias("b"), F.col("n").alias("nb"))
    across = listed.join(left, "key").join(right, "near").where(one_edit(F.col("a"), F.col("b")))
    several = words.join(one.where("members > 1").select("key"), "key", "left_semi")
    same = several.select("key", F.col("word").alias("a"), F.col("n").alias("na")).join(
        several.select("key", F.col("word").alias("b"), F.col("n").alias("nb")), "key").where((F.col("a") < F.col("b")) & one_edit(F.col("a"), F.col("b")))
    pairs = across.unionByName(same.withColumn("near", F.col("key"))).select("a", "na", "b", "nb")
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms(word, form)``: the end of the chain of forms, by pointer doubling.

    A form is ``RATIO`` times as frequent as its word, so chains have at most as many steps as counts have digits, and
    a form has at most its one-edit neighbours behind it: no key is hot.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        later = now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved"))
        later = cut_lineage(later)
        now = later.select("word", "root")
        if later.where("moved").limit(1).count() == 0:
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per word of all whole texts.

    Words are the letter runs of the texts, A-Z in lower case, with the letter losses that ``damaged`` prescribes, of
    at least ``LENGTH`` code points and ``COUNT`` occurrences.  ``n_near`` counts the words one edit apart, ``form``
    is the most frequent of these (ties: the smallest in code-point order) if it occurs ``RATIO`` times as often as
    the word, and ``root`` follows the forms to the last.  Null and empty texts hold no words, a row counts as often
    as it is repeated, a null key reads as ``null`` in the rule of the letter losses, an empty table gives no rows, and
    other columns are ignored.
    """
    words = cut_table(with_keys(word_counts(docs, key, text)))
    pairs = cut_table(near_words(words))
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("least"), F.col("b").alias("near")).alias("other")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("least"), F.col("a").alias("near")).alias("other")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("other"))
    fits = -F.col("other.least") >= F.lit(RATIO) * F.col("n")
    known = cut_table(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("other.near")).alias("form"), F.when(fits, -F.col("other.least")).alias("form_n")))
    ends = roots(known.where("form IS NOT NULL"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
