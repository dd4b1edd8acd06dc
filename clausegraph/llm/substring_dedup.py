"""Repeated lines and passages: normalised units grouped by their digests, the earliest occurrence stays, offsets are kept.

Units are whole lines of ``LINE_WORDS`` words and more, and, for passages that start and end in mid-sentence, the word windows at
content-defined places."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import cut_table, spread_rows
from clausegraph.llm.mixing import global_rank

#: Words of a passage at least, and of a line that is a unit of its own: shorter lines are phrases that clean texts share.
MIN_WORDS, LINE_WORDS = 51, 25
#: A place in the corpus is one number: that of the text, then the word in this many bits (a text of that many words exceeds a cell).
PLACE_BITS = 27
WORD = re.compile(r"\S+")
#: Multipliers of the two parts (64 and 32 bits) of a window's hash; seeds use the first.
FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def word_hashes(text: str) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def gram_hashes(words: np.ndarray, size: int, factor: int = FACTORS[0]) -> np.ndarray:
    """64-bit hashes of all runs of ``size`` words, by differences of running sums."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    up = np.multiply.accumulate(np.full(len(words), factor, np.uint64))
    down = np.multiply.accumulate(np.full(count, pow(factor, -1, 1 << 64), np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)))
    hashes = (sums[size:] - sums[:-size]) * down
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(FACTORS[0])
    return hashes ^ (hashes >> np.uint64(29))


def seeds_of(words: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all seeds (runs of about half of ``min_words`` words), and of every window of ``min_words`` words the
    place of its smallest seed.  Equal windows have equal smallest seeds, at the same place in them."""
    size = min_words // 2 + 1
    grams = gram_hashes(words, size)
    return grams, _smallest(grams, min_words - size + 1)


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in every run of ``width`` values."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(count, np.int64)
    for at in range(0, count, 1 << 14):
        part = np.lib.stride_tricks.sliding_window_view(values[at: at + (1 << 14) + width - 1], width)
        out[at: at + len(part)] = part.argmin(1) + np.arange(at, at + len(part))
    return out


def slim_rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.col(text).cast("string").alias("text"))


def line_units(value: str, words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(first word, words, the two hashes)`` of the lines of ``least`` words and more."""
    sizes = np.array([len(line.split()) for line in value.split("\n")], np.int64)
    stops = np.cumsum(sizes)
    held = sizes >= least
    first, size = (stops - sizes)[held], sizes[held]
    hashes = []
    for factor in FACTORS:
        up = np.multiply.accumulate(np.full(len(words), factor, np.uint64))
        down = np.multiply.accumulate(np.full(len(words) + 1, pow(factor, -1, 1 << 64), np.uint64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)))
        h = (sums[first + size] - sums[first]) * down[first] + size.astype(np.uint64)
        h ^= h >> np.uint64(31)
        h *= np.uint64(FACTORS[0])
        hashes.append(h ^ (h >> np.uint64(29)))
    return first, size, hashes


def halves(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 bits of two hashes."""
    return first.view(np.int64), second.astype(np.uint32).view(np.int32)


def seeds(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``(doc_id, row, digest, words, pos, h, lines)`` of every text with words enough for a unit.

    ``row`` tells rows with one key apart by their text, ``digest`` is of the words in lower case, ``pos`` and ``h`` list its
    selected seeds, and ``lines`` the place, words and hashes of its line units.
    """
    kind = docs.schema[key].dataType.simpleString()
    line_type = pa.struct([("pos", pa.int32()), ("n", pa.int32()), ("h1", pa.int64()), ("h2", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                take, rows, places, hashes, lines = [], [], [], [], []
                for i, value in enumerate(batch.column(2)):
                    value = value.as_py() or ""
                    words = word_hashes(value)
                    if len(words) < min(min_words, line_words):
                        continue
                    if len(words) >= 1 << PLACE_BITS:
                        raise ValueError("a text has too many words")
                    grams, smallest = seeds_of(words, min_words)
                    pos = np.unique(smallest)
                    first, size, both = line_units(value, words, line_words)
                    take.append(i)
                    places.append(pos.astype(np.int32))
                    hashes.append(grams[pos].view(np.int64) if len(pos) else np.zeros(0, np.int64))
                    lines.append((first.astype(np.int32), size.astype(np.int32), *halves(*both)))
                    rows.append((xxhash.xxh3_128_digest(words.tobytes()), len(words)))
                cuts = pa.array(np.cumsum([0, *map(len, places)]).astype(np.int32))
                flat = [pa.array(np.concatenate(x) if x else np.zeros(0, kind)) for x, kind in ((places, np.int32), (hashes, np.int64))]
                line_cuts = pa.array(np.cumsum([0, *(len(x[0]) for x in lines)]).astype(np.int32))
                line_flat = [pa.array(np.concatenate([x[i] for x in lines]) if lines else np.zeros(0, np.int64), line_type.field(i).type) for i in range(4)]
                numbers = pa.array(take, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(numbers), batch.column(1).take(numbers), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()),
                     *[pa.ListArray.from_arrays(cuts, x) for x in flat],
                     pa.ListArray.from_arrays(line_cuts, pa.StructArray.from_arrays(line_flat, fields=list(line_type)))],
                    ["doc_id", "row", "digest", "words", "pos", "h", "lines"])

    return spread_rows(slim_rows(docs, key, text)).mapInArrow(
        run, f"doc_id {kind}, row long, digest binary, words int, pos array<int>, h array<long>, lines array<struct<pos:int,n:int,h1:long,h2:int>>")


def windows(marked: DataFrame, min_words: int) -> DataFrame:
    """``(place, h1, hn)`` of the windows whose smallest seed is in ``marked(ord, text, places)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                found = []
                for i in range(batch.num_rows):
                    words = word_hashes(batch.column(1)[i].as_py())
                    _, smallest = seeds_of(words, min_words)
                    pos = np.flatnonzero(np.isin(smallest, batch.column(2)[i].values.to_numpy()))
                    found.append(((batch.column(0)[i].as_py() << PLACE_BITS) + pos, *halves(*(gram_hashes(words, min_words, f)[pos] for f in FACTORS))))
                place, h1, h2 = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (place, h1, (h2.astype(np.int64) << 32) | min_words)], ["place", "h1", "hn"])

    return marked.select("ord", "text", "places").mapInArrow(run, "place long, h1 long, hn long")


def with_offsets(rows: DataFrame, kind: str) -> DataFrame:
    """``(doc_id, row, start, stop, words, first_doc_id)`` from ``rows(doc_id, row, text, spans)``: words become characters of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                take, made = [], []
                for i in range(batch.num_rows):
                    ends = [m.span() for m in WORD.finditer(batch.column(2)[i].as_py())]
                    for span in batch.column(3)[i].as_py():
                        take.append(i)
                        made.append((ends[span["a"]][0], ends[span["b"] - 1][1], span["b"] - span["a"], span["first_doc_id"]))
                numbers = pa.array(take, pa.int64())
                id_type = batch.schema.field(0).type
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(numbers), batch.column(1).take(numbers), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.int32()),
                     pa.array([m[2] for m in made], pa.int64()), pa.array([m[3] for m in made], id_type)], ["doc_id", "row", "start", "stop", "words", "first_doc_id"])

    return rows.select("doc_id", "row", "text", "spans").mapInArrow(run, f"doc_id {kind}, row long, start int, stop int, words long, first_doc_id {kind}")


def same_row(key: str = "_key", row: str = "_row") -> Column:
    return F.col("doc_id").eqNullSafe(F.col(key)) & (F.col("row") == F.col(row))


def numbered_texts(raw: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, row, digest, words, ord)`` once a text, and ``raw`` with ``ord``: the texts in order of key (null last) and ``row``.

    Whole keys that are small enough and belong to one text each are such numbers themselves; others are ranked.
    """
    slim = raw.select("doc_id", "row", "digest", "words").distinct()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        held = slim.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(
            F.max("n").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
        if held["n"] == 1 and not held["nulls"] and held["low"] >= 0 and held["high"] < 1 << (63 - PLACE_BITS):
            number = F.col("doc_id").cast("long")
            return slim.withColumn("ord", number), raw.withColumn("ord", number)
    slim = cut_table(global_rank(slim, [F.col("doc_id").asc_nulls_last(), F.col("row").asc()], "ord"))
    names = slim.select(F.col("doc_id").alias("_key"), F.col("row").alias("_row"), "ord")
    return slim, cut_table(raw.join(names, same_row()).select("digest", "pos", "h", "lines", "ord"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``(doc_id, row, start, stop, words, first_doc_id)``: every later occurrence of a line or passage, by offsets in its text.

    Words are compared in lower case, whatever white space is between them.  A line of ``line_words`` words or more goes if it
    stands before: in a row with a smaller key (null last) or earlier in the same text.  Passages are runs of words of
    which every ``min_words`` in a row occur before, without overlap in the same text; they may start and end anywhere.
    What touches is one passage; ``first_doc_id`` holds the first occurrence of its first unit.

    All of these are found.  Of every window of ``min_words`` words the smallest seed is looked up over the corpus
    (2 of 27 words start a selected seed); only windows whose seed occurs twice are hashed and grouped, so what is
    shuffled follows the repeated text.  Whole copies of a text are told by their digest and have no units.
    Null texts have no words; rows alike in key and text occur at one place and do not repeat each other; other
    columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()
    raw = cut_table(seeds(docs, key, text, min_words, line_words))
    numbered, every = numbered_texts(raw, kind)
    first = F.min("ord").alias("first")
    owners = numbered.groupBy("digest").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    numbered = cut_table(numbered.join(owners, "digest", "left").select("doc_id", "row", "ord", "words", F.when(F.col("first") != F.col("ord"), F.col("first")).alias("first")))
    names = numbered.select(F.col("doc_id").alias("_key"), F.col("row").alias("_row"), "ord")
    alone = numbered.where("first IS NULL").select(F.col("doc_id").alias("_key"), F.col("row").alias("_row"), "ord")
    # a whole copy has the same seeds at the same places: one occurrence
    each = every.select("ord", "digest", F.explode(F.arrays_zip("pos", "h")).alias("s")).select("ord", "s.pos", "s.h", F.xxhash64("digest", "s.pos").alias("at"))
    twice = each.groupBy("h").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low != high").select("h")
    marked = each.select("ord", "pos", "h").join(twice, "h", "left_semi").groupBy("ord").agg(F.collect_list("pos").alias("places"))
    marked = cut_table(marked.join(alone, "ord"))
    found = windows(slim_rows(docs, key, text).join(marked, same_row()), min_words)
    place = F.shiftleft(F.col("ord"), PLACE_BITS)
    lines = every.select("ord", "lines").join(alone.select("ord"), "ord", "left_semi").select("ord", F.explode("lines").alias("l")).select(
        (place + F.col("l.pos")).alias("place"), F.col("l.h1").alias("h1"),
        F.shiftleft(F.bitwise_not(F.col("l.h2")).cast("long"), 32).bitwiseOR(F.col("l.n").cast("long")).alias("hn"))
    units = found.unionByName(lines)  # read twice, from one exchange: less disk than a table of its own
    firsts = units.groupBy("h1", "hn").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first != last").select("h1", "hn", "first")
    own = F.shiftright("place", PLACE_BITS) == F.shiftright("first", PLACE_BITS)
    size = F.col("hn").bitwiseAND(F.lit((1 << 32) - 1))
    again = units.join(firsts, ["h1", "hn"]).where((F.col("place") != F.col("first")) & (~own | (F.col("place") >= F.col("first") + size)))
    word = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    again = again.select(F.shiftright("place", PLACE_BITS).alias("ord"), word.alias("a"), (word + size).alias("b"), F.shiftright("first", PLACE_BITS).alias("from"))
    by = Window.partitionBy("ord").orderBy("a", "b")
    apart = F.coalesce((F.col("a") > F.max("b").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    runs = again.withColumn("apart", apart).withColumn("run", F.sum("apart").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    passages = runs.groupBy("ord", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min(F.struct("a", "from"))["from"].alias("from")).drop("run")
    copies = numbered.where("first IS NOT NULL").select("ord", F.lit(0).cast("long").alias("a"), F.col("words").cast("long").alias("b"), F.col("first").alias("from"))
    gone = passages.unionByName(copies).join(numbered.select(F.col("ord").alias("from"), F.col("doc_id").alias("first_doc_id")), "from")
    spans = gone.groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("a", "b", "first_doc_id"))).alias("spans")).join(names, "ord")
    return with_offsets(slim_rows(docs, key, text).join(spans, same_row()), kind).distinct()  # rows alike


def without_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, line_words: int = LINE_WORDS) -> DataFrame:
    """``(doc_id, text, removed, first_doc_ids)`` for the rows that lose a line or passage.

    ``text`` is what remains, ``removed`` lists ``(start, stop, words, first_doc_id)`` by offset in the original text
    (characters), ``first_doc_ids`` the keys of the texts that keep the passages.
    """
    passages = repeated_passages(docs, key, text, min_words, line_words).groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_set(F.struct("start", "stop", "words", "first_doc_id"))).alias("removed"))
    source = docs.select(F.col(key).alias("_key"), F.xxhash64(key, text).alias("_row"), F.col(text).alias("_text"))
    joined = passages.join(source, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("row") == F.col("_row")))
    stops = F.concat(F.array(F.lit(0)), F.col("removed.stop"))
    starts = F.concat(F.col("removed.start"), F.array(F.char_length("_text")))
    kept = F.array_join(F.zip_with(stops, starts, lambda a, b: F.substr(F.col("_text"), a + 1, b - a)), "")
    return joined.select("doc_id", kept.alias("text"), "removed", F.array_distinct(F.col("removed.first_doc_id")).alias("first_doc_ids"))
