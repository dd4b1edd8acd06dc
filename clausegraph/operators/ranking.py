"""The best items of every question without a row per posting and question.

A question's score of a unit is a sum over the unit's postings.  As a join, every posting becomes a row for each question
that asks its token: frequent words times all questions.  Here the postings cross the network once, sorted by unit; every
task multiplies them with the weights that the questions give their tokens, a slice of the questions at a time, and keeps its
best ``k`` items per question.  The scores are the same scaled integers as those of the join.

Rows of a stored index hold whole units, so they need no shuffle (``best_of_units``).  The first block of a task is scored
whole; from then on a product in single precision, with a bound on its error, tells which sums can still reach the k-th best
score, and only these are computed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausegraph.config import Bm25
from clausegraph.functions.exact import SCALE
from clausegraph.operators.scale import fan_out_partitions

#: Columns of the weights that one product takes, postings of a product, scores held at once, and candidate rows before they are cut to the best.
WIDTH, POSTINGS, CELLS, KEPT = 256, 1 << 16, 1 << 23, 1 << 12
#: Sums and hits that a product holds at once; both fit a core's cache.
SUMS, HITS = 1 << 17, 1 << 16
#: Postings of the first block of a task, which is scored whole.
FIRST = 1 << 13


class Weights:
    """Weights of tokens in columns; equal columns are one.  Each output group takes the largest of its columns."""

    def __init__(self, tokens: np.ndarray, columns: np.ndarray, values: np.ndarray, groups: np.ndarray) -> None:
        """``tokens``, ``columns``, ``values``: the entries; ``groups[column]``: the output group of a column, ascending."""
        order = np.lexsort((tokens, columns))
        tokens, columns, values = tokens[order], columns[order], values[order]
        bounds = np.searchsorted(columns, np.arange(len(groups) + 1))
        known: dict[bytes, int] = {}
        entries, self.column_of = [], np.empty(len(groups), np.int64)
        for i in range(len(groups)):
            a, b = bounds[i], bounds[i + 1]
            mark = tokens[a:b].tobytes() + b"|" + values[a:b].tobytes()
            if mark not in known:
                known[mark] = len(entries)
                entries.append((tokens[a:b], values[a:b]))
            self.column_of[i] = known[mark]
        self.starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, np.int64)
        self.n_columns, self.n_groups = len(entries), len(self.starts)
        self.slices = []  # (first column, width, tokens in use, first entry of each and their end, column and value of the entries)
        for first in range(0, len(entries), WIDTH):
            part = entries[first: first + WIDTH]
            used, row = np.unique(np.concatenate([t for t, _ in part]), return_inverse=True)
            column = np.repeat(np.arange(len(part)), [len(t) for t, _ in part])
            by_token = np.argsort(row, kind="stable")
            heads = np.searchsorted(row[by_token], np.arange(len(used) + 1))
            self.slices.append((first, len(part), used, heads, column[by_token], np.concatenate([v for _, v in part])[by_token]))
        self.group_of = np.repeat(np.arange(self.n_groups), np.diff(np.r_[self.starts, len(groups)]))
        pairs = np.unique(np.stack([self.column_of, self.group_of]), axis=1)
        self.asking = pairs[1]  # the groups of each column, next to each other
        self.asking_heads = np.searchsorted(pairs[0], np.arange(self.n_columns + 1))

    def reaching(self, tokens: np.ndarray, x: np.ndarray, unit_starts: np.ndarray, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(unit, group, score)`` of all sums of ``products`` that are at least the ``floor`` of their group."""
        low = np.full(self.n_columns, np.inf)
        np.minimum.at(low, self.column_of, floor[self.group_of])
        length = np.diff(np.r_[unit_starts, len(tokens)])
        units, most = np.repeat(np.arange(len(unit_starts)), length), length.max(initial=0)
        # single precision: 2^-24 for each addition and each factor; half a unit of the scale for each rounded term; sums that count are positive
        bound = np.maximum(low / SCALE * (1 - (most + 8) * 2e-7) - (most + 1) / SCALE, 0.1 / SCALE).astype(np.float32)
        found = []
        for first, width, used, heads, column, value in self.slices:
            place = np.searchsorted(used, tokens)
            place[place == len(used)] = 0
            at = np.flatnonzero(used[place] == tokens)
            if not len(at):
                continue
            place, mass, unit = place[at], x[at], units[at]
            new = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            ends, number = np.r_[new[1:], len(at)], np.cumsum(np.r_[False, unit[1:] != unit[:-1]])
            table = np.zeros((len(used), width))
            table[np.repeat(np.arange(len(used)), np.diff(heads)), column] = value
            asked = np.diff(heads)
            often = np.bincount(place, minlength=len(used)) * asked > len(new) // 2  # cheaper as a dense product than a cell per hit
            dense, rank = table[often].astype(np.float32), np.cumsum(often) - 1
            step = max(1, SUMS // width)
            for lo in range(0, len(new), step):
                n = min(step, len(new) - lo)
                part = slice(new[lo], ends[lo + n - 1])
                where, own, row = place[part], mass[part], number[part] - lo
                frequent = often[where]
                cells = np.bincount(row[frequent] * len(dense) + rank[where[frequent]], own[frequent], n * len(dense))
                sums = cells.astype(np.float32).reshape(n, -1) @ dense if len(dense) else np.zeros((n, width), np.float32)
                rare = ~frequent
                if rare.any():
                    head, count = heads[where[rare]], asked[where[rare]]
                    entry = np.repeat(head - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    np.add.at(sums.reshape(-1), np.repeat(row[rare] * width, count) + column[entry],
                              (value[entry] * np.repeat(own[rare], count)).astype(np.float32))
                u, c = np.divmod(np.flatnonzero(sums >= bound[first: first + width]), width)
                if not len(u):
                    continue
                count = (ends - new)[lo + u]
                posting = np.repeat(new[lo + u] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                terms = table[place[posting], np.repeat(c, count)] * mass[posting] * float(SCALE)
                score = np.add.reduceat(np.floor(terms + 0.5), np.cumsum(count) - count)  # whole numbers below 2^53
                keep = score >= low[first + c]
                found.append((unit[new[lo + u[keep]]], first + c[keep], score[keep]))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        unit, column, score = (np.concatenate(f) for f in zip(*found, strict=True))
        count = np.diff(self.asking_heads)[column]
        group = self.asking[np.repeat(self.asking_heads[column] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        unit, score = np.repeat(unit, count), np.repeat(score, count)
        keep = score >= floor[group]
        return unit[keep], group[keep], score[keep]

    def products(self, tokens: np.ndarray, x: np.ndarray, unit_starts: np.ndarray, item_starts: np.ndarray) -> np.ndarray:
        """(items, groups) best unit of each item: sums over the postings of a unit of ``round(weight * x * SCALE)``."""
        units = np.repeat(np.arange(len(unit_starts)), np.diff(np.r_[unit_starts, len(tokens)]))
        item_of = np.searchsorted(item_starts, unit_starts, side="right") - 1
        best = np.zeros((len(item_starts), self.n_columns))
        for first, width, used, heads, column, value in self.slices:
            place = np.searchsorted(used, tokens)
            place[place == len(used)] = 0
            at = np.flatnonzero(used[place] == tokens)
            if not len(at):
                continue
            place = place[at]
            head, count = heads[place], heads[place + 1] - heads[place]
            new = np.flatnonzero(np.r_[True, units[at[1:]] != units[at[:-1]]])  # units that are hit, with their first posting
            hits = np.r_[0, np.cumsum(count)][np.r_[new, len(at)]]
            lo = 0
            while lo < len(new):  # whole units, as many as the bounds allow
                hi = max(lo + 1, min(lo + max(1, SUMS // width), int(np.searchsorted(hits, hits[lo] + HITS, side="right")) - 1))
                a, b = new[lo], new[hi] if hi < len(new) else len(at)
                sums = self._sums(head[a:b], count[a:b], x[at[a:b]], units[at[a:b]], column, value, width)
                item = item_of[units[at[new[lo:hi]]]]
                own = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
                rows = item[own]
                best[rows, first: first + width] = np.maximum(best[rows, first: first + width], np.maximum.reduceat(sums, own, axis=0))
                lo = hi
        return np.maximum.reduceat(best[:, self.column_of], self.starts, axis=1)

    @staticmethod
    def _sums(head: np.ndarray, count: np.ndarray, x: np.ndarray, unit: np.ndarray, column: np.ndarray, value: np.ndarray, width: int) -> np.ndarray:
        """(units, columns) sums of the entries ``head .. head + count`` of each posting: a cell per column that asks its token."""
        ends = np.cumsum(count)
        entry = np.repeat(head - (ends - count), count) + np.arange(ends[-1])
        cells = value[entry]
        cells *= np.repeat(x, count)
        cells *= float(SCALE)
        cells += 0.5  # weights are positive: halves go up, as in ``exact.to_fixed``
        np.floor(cells, out=cells)
        number = np.r_[0, np.cumsum(unit[1:] != unit[:-1])]
        key = np.repeat(number * width, count) + column[entry]
        # whole numbers below 2^53: exact in any order
        return np.bincount(key, cells, (number[-1] + 1) * width).reshape(-1, width)


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Where a row differs from the one before; nulls are equal."""
    codes = column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return codes[1:] != codes[:-1]


class _Best:
    """The best ``k`` items per part and group: by score, then by item."""

    def __init__(self, k: int, groups: int, item: pa.DataType) -> None:
        self.k, self.groups, self.kept, self.size = k, groups, [], 0
        self.schema = pa.schema([("part", pa.string()), ("group", pa.int64()), ("item_id", item), ("raw", pa.int64())])
        self.floor: dict[str, np.ndarray] = {}  # scores below cannot be among the best any more

    def add(self, part: str, items: pa.ChunkedArray, scores: np.ndarray) -> None:
        floor = self.floor.setdefault(part, np.ones(self.groups))
        if len(scores) >= self.k:  # its items are distinct: the k-th of them is a bound already
            np.maximum(floor, np.partition(scores, -self.k, axis=0)[-self.k], out=floor)
        row, group = np.nonzero(scores >= floor)
        self.add_rows(part, items, row, group, scores[row, group])

    def add_rows(self, part: str, items: pa.ChunkedArray, row: np.ndarray, group: np.ndarray, scores: np.ndarray) -> None:
        if len(row):
            taken = items.take(pa.array(row))
            columns = [pa.array([part] * len(row), pa.string()), pa.array(group), taken.combine_chunks() if isinstance(taken, pa.ChunkedArray) else taken,
                       pa.array(scores.astype(np.int64))]
            self.kept.append(pa.table(columns, schema=self.schema))
            self.size += len(row)
            if self.size > max(KEPT, 4 * self.k * self.groups * len(self.floor)):
                self.result()

    def result(self) -> pa.Table:
        if not self.kept:
            return self.schema.empty_table()
        # a long item can stand in several batches
        rows = pa.concat_tables(self.kept).group_by(["part", "group", "item_id"]).aggregate([("raw", "max")]).rename_columns({"raw_max": "raw"})
        keys = [("part", "ascending"), ("group", "ascending"), ("raw", "descending"), ("item_id", "ascending")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start")).combine_chunks()
        new = np.r_[True, _changes(rows["part"]) | _changes(rows["group"])]
        start = np.maximum.accumulate(np.where(new, np.arange(rows.num_rows), 0))
        rank = np.arange(rows.num_rows) - start
        last = rows.filter(pa.array(rank == self.k - 1))
        for part, group, raw in zip(last["part"].to_pylist(), last["group"].to_pylist(), last["raw"].to_pylist(), strict=True):
            self.floor[part][group] = max(self.floor[part][group], raw)
        rows = rows.filter(pa.array(rank < self.k)).select(self.schema.names).cast(self.schema)
        self.kept, self.size = [rows], rows.num_rows
        return rows


class _Scorer:
    """The best items of one task."""

    def __init__(self, weights: Weights, k: int, item: pa.DataType) -> None:
        self.weights, self.best = weights, _Best(k, weights.n_groups, item)
        self.step = max(1, CELLS // max(1, weights.n_columns + len(weights.column_of)))  # items whose scores are held at once

    def take(self, part: str, items: pa.ChunkedArray, tokens: np.ndarray, x: np.ndarray, unit_starts: np.ndarray, item_starts: np.ndarray) -> None:
        """``items`` has a row per posting; a unit's postings stand together, an item's units too."""
        if part not in self.best.floor:
            n = min(self.step, max(1, int(np.searchsorted(item_starts, FIRST))))
            end = item_starts[n] if n < len(item_starts) else len(tokens)
            scores = self.weights.products(tokens[:end], x[:end], unit_starts[unit_starts < end], item_starts[:n])
            self.best.add(part, items.take(pa.array(item_starts[:n])), scores)
            if end == len(tokens):
                return
            items, tokens, x, unit_starts = items.slice(end), tokens[end:], x[end:], unit_starts[unit_starts >= end] - end
        unit, group, score = self.weights.reaching(tokens, x, unit_starts, self.best.floor[part])
        self.best.add_rows(part, items, unit_starts[unit], group, score)


def _found(postings: DataFrame, run) -> DataFrame:
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("group", T.LongType()),
                           T.StructField("item_id", postings.schema["item_id"].dataType), T.StructField("raw", T.LongType())])
    return postings.mapInArrow(run, schema).groupBy("part", "group", "item_id").agg(F.max("raw").alias("raw"))


def best_items(postings: DataFrame, weights: Weights, k: int, norms: DataFrame | None = None) -> DataFrame:
    """``(part, group, item_id, raw)``: at most ``k`` rows per task, part and group, among them all of the overall best ``k``.

    ``postings(part, item_id, unit_no, tid, x)``: all rows of a unit add up.  ``norms(part, item_id, unit_no, x)`` has one
    row per unit, which divides the ``x`` of its postings; it travels with them.  An item that is among the best overall
    is among the best of the task that holds its best unit.
    """
    shared = postings.sparkSession.sparkContext.broadcast(weights)
    rows = postings.select("part", "item_id", "unit_no", "tid", "x")
    if norms is not None:
        rows = rows.unionByName(norms.select("part", "item_id", "unit_no", F.lit(-1).cast("int").alias("tid"), "x"))
    rows = rows.repartition(fan_out_partitions(rows), "item_id", "unit_no", "part")
    rows = rows.sortWithinPartitions("part", "item_id", "unit_no", *(["tid"] if norms is not None else []))
    normed = norms is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, held, size = None, [], 0

        def take(rows: pa.Table) -> None:
            if normed:  # the norm is the first row of its unit
                first = rows["tid"].to_numpy() < 0
                x = rows["x"].to_numpy()
                dn = x[np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))]
                rows = rows.set_column(rows.schema.get_field_index("x"), "x", pa.array(x / dn)).filter(pa.array(~first))
                if not rows.num_rows:
                    return
            part, item = _changes(rows["part"]), _changes(rows["item_id"])
            item |= part
            unit = item | _changes(rows["unit_no"])
            tokens, x = rows["tid"].to_numpy(), rows["x"].to_numpy()
            unit_starts, item_starts = (np.flatnonzero(np.r_[True, c]) for c in (unit, item))
            cuts = np.flatnonzero(np.r_[True, part])
            names = rows["part"].take(pa.array(cuts)).to_pylist()
            for name, a, b in zip(names, cuts, [*cuts[1:], rows.num_rows], strict=True):
                inside, own = (starts[(starts >= a) & (starts < b)] - a for starts in (unit_starts, item_starts))
                scorer.take(name, rows["item_id"].slice(a, b - a), tokens[a:b], x[a:b], inside, own)

        for batch in batches:
            if not batch.num_rows:
                continue
            if scorer is None:
                scorer = _Scorer(shared.value, k, batch.schema.field("item_id").type)
            held.append(batch)
            size += batch.num_rows
            if size < POSTINGS:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            unit = _changes(rows["part"]) | _changes(rows["item_id"]) | _changes(rows["unit_no"])
            ends = np.flatnonzero(unit)
            if len(ends):  # the last unit may go on
                cut = int(ends[-1]) + 1
                take(rows.slice(0, cut))
                rows = rows.slice(cut)
            held, size = rows.to_batches(), rows.num_rows
        if held:
            take(pa.Table.from_batches(held).combine_chunks())
        if scorer is not None:
            yield from scorer.best.result().to_batches()

    return _found(rows, run)


def unit_hits(batch: pa.RecordBatch, vocabulary: pa.Array | None) -> dict:
    """Counted tokens of rows ``(item_id, unit_no, parts, dls, tokens)`` of a stored index, a row per unit.

    The texts of a unit with the same part and length are one.  ``row``, ``part``, ``dl`` of each text; ``text``, ``token``
    (place in ``vocabulary``) and ``tf`` of each hit, by text.
    """
    parts, lengths = pc.list_flatten(batch["parts"]), pc.list_flatten(batch["dls"])
    row = pc.list_parent_indices(batch["parts"]).to_numpy()
    texts = pc.list_flatten(batch["tokens"])
    words, of = pc.list_flatten(texts), pc.list_parent_indices(texts).to_numpy()
    if vocabulary is None:
        coded = words.dictionary_encode(null_encoding="encode")
        vocabulary, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    else:
        codes = pc.fill_null(pc.index_in(words, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
        known = codes >= 0
        codes, of = codes[known], of[known]
    first = np.flatnonzero(np.r_[len(row) > 0, (row[1:] != row[:-1]) | _changes(pa.chunked_array([parts])) | _changes(pa.chunked_array([lengths]))])
    text_of = np.searchsorted(first, np.arange(len(row)), side="right") - 1
    key = np.sort(text_of[of].astype(np.int64) * max(1, len(vocabulary)) + codes)
    new = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]])
    text, token = np.divmod(key[new], max(1, len(vocabulary)))
    return {"row": row[first], "part": parts.take(pa.array(first)), "dl": lengths.take(pa.array(first)), "text": text, "token": token,
            "tf": np.diff(np.r_[new, len(key)]), "vocabulary": vocabulary}


def postings_of(forward: DataFrame, tokens: pa.Array | None = None) -> DataFrame:
    """``(part, item_id, unit_no, dl, token, tf)`` of the rows of a stored index, without a shuffle; those of ``tokens`` only, if given."""
    shared = forward.sparkSession.sparkContext.broadcast(tokens)
    item = forward.schema["item_id"].dataType
    schema = T.StructType([T.StructField("part", T.StringType()), T.StructField("item_id", item), T.StructField("unit_no", T.IntegerType()),
                           T.StructField("dl", T.IntegerType()), T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = unit_hits(batch, shared.value)
            text, row = pa.array(hits["text"]), pa.array(hits["row"][hits["text"]])
            columns = [hits["part"].take(text), batch["item_id"].take(row), batch["unit_no"].take(row), hits["dl"].take(text),
                       hits["vocabulary"].take(pa.array(hits["token"])), pa.array(hits["tf"].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["part", "item_id", "unit_no", "dl", "token", "tf"])

    return forward.mapInArrow(run, schema)


def document_frequencies(forward: DataFrame, tokens: pa.Array) -> DataFrame:
    """``(part, token, df)`` of ``tokens``: texts that hold them.  A task sends a row per part and token."""
    shared = forward.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            hits = unit_hits(batch, shared.value)
            names = hits["part"].dictionary_encode(null_encoding="encode")
            code = names.indices.to_numpy(zero_copy_only=False)[hits["text"]]
            for i, name in enumerate(names.dictionary.to_pylist()):
                own = np.bincount(hits["token"][code == i], minlength=len(shared.value))
                counts[name] = counts[name] + own if name in counts else own
        for name, own in counts.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), shared.value.take(pa.array(some)), pa.array(own[some])], ["part", "token", "df"])

    return forward.mapInArrow(run, "part string, token string, df long").groupBy("part", "token").agg(F.sum("df").alias("df"))


def best_of_units(forward: DataFrame, tokens: pa.Array, numbers: dict[str, tuple[np.ndarray, float]], weights: Weights, k: int, params: Bm25, one_part: bool) -> DataFrame:
    """``best_items`` for BM25 over the rows of a stored index, where they lie.

    ``numbers[part]``: the ``tid`` of each of ``tokens`` (-1: none) and the average length of the part's units.
    """
    spark = forward.sparkSession
    shared = spark.sparkContext.broadcast((tokens, numbers, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, numbers, weights = shared.value
        scorer = None
        for batch in batches:
            if scorer is None:
                scorer = _Scorer(weights, k, batch.schema.field("item_id").type)
            hits = unit_hits(batch, vocabulary)
            names = hits["part"].dictionary_encode(null_encoding="encode")
            code, dl = names.indices.to_numpy(zero_copy_only=False), hits["dl"].to_numpy(zero_copy_only=False)
            for i, name in [(None, "all")] if one_part else enumerate(names.dictionary.to_pylist()):
                if name not in numbers:
                    continue
                tids, avgdl = numbers[name]
                tid = tids[hits["token"]]
                own = tid >= 0 if i is None else (tid >= 0) & (code[hits["text"]] == i)
                if not own.any():
                    continue
                text, tf = hits["text"][own], hits["tf"][own]
                x = tf * (params.k1 + 1) / (tf + params.k1 * (1 - params.b + params.b * dl[text] / avgdl))
                row = hits["row"][text]
                unit_starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                rows = batch["item_id"].take(pa.array(row))
                item = _changes(pa.chunked_array([rows]))
                scorer.take(name, rows, tid[own], x, unit_starts, np.flatnonzero(np.r_[True, item]))
        if scorer is not None:
            yield from scorer.best.result().to_batches()

    return _found(forward, run)
