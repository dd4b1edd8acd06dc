"""Ranked lexical search: sparse ball trees over the documents, pruned best-first by centroid and radius, exact integer scores at the leaves."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from clausegraph.llm.common import cut_table, spread_rows

#: Documents of each item in the result.
TOP = 10
#: Distinct terms and items that one pass over the documents serves; an item with more terms has a pass of its own.
PASS_TERMS, PASS_ITEMS = 50_000, 2_000
#: Documents and vector entries of one tree, and documents of a leaf.
TREE_DOCS, TREE_ENTRIES, LEAF = 8_192, 2_000_000, 32
#: Neighbouring dimensions that share a radius.
WIDTH = 4
#: Tokens that are counted at once.
CHUNK = 1_000_000
#: All bytes of a term are digits, ASCII letters or parts of characters beyond ASCII; A-Z are lower-cased, the rest becomes a blank.
_PLAIN = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, repeats included."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def item_blocks(items: DataFrame, item: str, text: str, most_terms: int, most_items: int) -> Iterator[list[tuple]]:
    """``(number, item id, distinct terms)`` of all items in blocks that one pass serves.  Reads the items one partition at a time."""
    block: list[tuple] = []
    held: set[bytes] = set()
    rows = items.select(F.col(item).alias("id"), F.col(text).cast("string").alias("text")).orderBy("id", "text")
    for number, row in enumerate(rows.toLocalIterator()):
        own = sorted(set(terms(row["text"])))
        if block and (len(held | set(own)) > most_terms or len(block) >= most_items):
            yield block
            block, held = [], set()
        block.append((number, row["id"], own))
        held.update(own)
    if block:
        yield block


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n, ids, tfs)`` of the documents with a term: all its terms ``n``, and the counts of those of ``vocabulary``."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by PASS_TERMS and one item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            start, tokens, sizes = 0, [], []
            for at in range(batch.num_rows):
                own = terms(batch.column(1)[at].as_py())
                sizes.append(len(own))
                tokens += own
                if len(tokens) < CHUNK and at + 1 < batch.num_rows:
                    continue
                n = np.array(sizes, np.int64)
                ids = np.fromiter(map(number.get, tokens, repeat(-1)), np.int64, len(tokens))
                owner = np.repeat(np.arange(len(n)), n)[ids >= 0]
                pairs, tfs = np.unique(owner * len(number) + ids[ids >= 0], return_counts=True)
                cuts = np.searchsorted(pairs, np.arange(len(n) + 1) * max(1, len(number))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int32))) for x in (pairs % max(1, len(number)), tfs)]
                found = pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(n)), pa.array(n), *lists], ["doc_id", "n", "ids", "tfs"])
                yield found.filter(pa.array(n > 0))
                start, tokens, sizes = at + 1, [], []

    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return spread_rows(slim).mapInArrow(run, f"doc_id {kind}, n long, ids array<int>, tfs array<int>")


def term_weights(vocabulary: int, counts: dict[int, int], documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(i, 0) + 1))) for i in range(vocabulary)], np.int64)


def parts(ids: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, n: np.ndarray, weights: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What each entry adds to a score, in 64-bit integers."""
    tf = tfs.astype(np.int64)
    m = 10 + (90 * n * documents) // words
    return weights[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * np.repeat(m, sizes)))


class BallTree:
    """Binary tree of balls over sparse vectors (``cuts``, ``ids``, ``values``), none of them empty, ids ascending in each.

    A node halves its vectors by their projection on the line between two distant ones.  Its ball has a 32-bit centre
    and one radius for each ``width`` neighbouring dimensions, measured from that rounded centre and rounded up, so
    ``<q, centre>`` plus, for every such subspace, ``|q| * radius`` is never below the product of ``q`` with a vector
    of the node.  One radius over all dimensions would be wide: a text differs from others by terms that no query asks.
    """

    def __init__(self, cuts: np.ndarray, ids: np.ndarray, values: np.ndarray, dims: int, leaf: int = LEAF, width: int = WIDTH) -> None:
        self.cuts, self.ids, self.values, self.dims, self.width = cuts, ids, values, dims, width
        plain = values.astype(np.float64)
        norms = np.add.reduceat(plain * plain, cuts[:-1])
        spaces = np.arange(0, dims, width)
        self.centres: list[np.ndarray] = []
        self.radii: list[np.ndarray] = []
        self.children: list[list[int] | None] = []
        self.leaves: dict[int, tuple] = {}
        self.mask = np.zeros(dims, np.int64)
        todo = [(np.arange(len(cuts) - 1), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            node = len(self.radii)
            if parent >= 0:
                self.children[parent][side] = node
            where, starts = self.entries(rows)
            own_ids, own = ids[where], plain[where]
            centre = (np.bincount(own_ids, own, minlength=dims) / len(rows)).astype(np.float32)
            wide = centre.astype(np.float64)
            lengths = np.add.reduceat(wide * wide, spaces)
            space = own_ids // width
            fresh = np.ones(len(own), bool)
            fresh[1:] = space[1:] != space[:-1]
            fresh[starts] = True
            runs = np.flatnonzero(fresh)
            squares = np.add.reduceat(own * own, runs)
            near = np.add.reduceat(own * (own - 2 * wide[own_ids]), runs) + lengths[space[runs]]
            apart = lengths.copy()  # a vector without entries in a subspace is as far away as the centre is long
            np.maximum.at(apart, space[runs], near + 1e-9 * (squares + lengths[space[runs]]))  # beyond the rounding of these sums
            self.centres.append(centre)
            self.radii.append((np.sqrt(np.maximum(apart, 0)) * (1 + 1e-6)).astype(np.float32))  # 1e-6 is more than the 32-bit rounding
            if len(rows) <= leaf:
                self.children.append(None)
                self.leaves[node] = rows, own_ids, values[where], starts
                continue
            self.children.append([0, 0])
            line = self.row(rows[int((norms[rows] - 2 * np.add.reduceat(own * wide[own_ids], starts)).argmax())])
            away = norms[rows] - 2 * np.add.reduceat(own * line[own_ids], starts)
            line -= self.row(rows[int(away.argmax())])
            half = np.argpartition(np.add.reduceat(own * line[own_ids], starts), len(rows) // 2)
            todo += [(rows[half[: len(rows) // 2]], node, 0), (rows[half[len(rows) // 2:]], node, 1)]
        self.centres, self.radii = np.array(self.centres), np.array(self.radii)

    def row(self, at: int) -> np.ndarray:
        out = np.zeros(self.dims)
        out[self.ids[self.cuts[at]: self.cuts[at + 1]]] = self.values[self.cuts[at]: self.cuts[at + 1]]
        return out

    def entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of the rows, and where each row starts among them."""
        first, sizes = self.cuts[rows], self.cuts[rows + 1] - self.cuts[rows]
        starts = np.cumsum(sizes) - sizes
        return np.arange(int(sizes.sum())) + np.repeat(first - starts, sizes), starts

    def search(self, query: np.ndarray, best: list[tuple], keys: list, k: int = TOP) -> int:
        """Merge the rows with the largest sums over the dimensions ``query`` into ``best``; returns the leaves that were scored.

        ``best`` lists ``(-score, key is null, key)`` in ascending order.  A ball whose bound is below the k-th score
        is left out with all below it; equal bounds are searched, a smaller key may stand there.
        """
        if not len(query):
            return 0
        spaces, shared = np.unique(query // self.width, return_counts=True)
        reach = np.sqrt(shared)

        def bound(node: int) -> float:
            centre = self.centres[node].take(query).sum(dtype=np.float64)
            return float(centre + self.radii[node].take(spaces) @ reach) * (1 + 1e-9)

        self.mask[query] = 1
        heap, visited = [(-bound(0), 0)], 0
        while heap:
            limit, node = heapq.heappop(heap)
            least = -best[-1][0] if len(best) >= k else 1
            if -limit < least:
                break
            if self.children[node] is not None:
                for child in self.children[node]:
                    reached = bound(child)
                    if reached >= least:
                        heapq.heappush(heap, (-reached, child))
                continue
            visited += 1
            rows, ids, values, starts = self.leaves[node]
            scores = np.add.reduceat(values * self.mask[ids], starts)
            found = np.flatnonzero(scores >= least)
            for at in found:
                key = keys[rows[at]]
                best.append((-int(scores[at]), key is None, key if key is not None else 0))
            if len(found):
                best.sort()
                del best[k:]
        self.mask[query] = 0
        return visited


def best_of_tasks(found: DataFrame, block: list[tuple], vocabulary: dict[bytes, int], weights: np.ndarray, documents: int, words: int,
                  item_type, k: int, leaf: int = LEAF) -> DataFrame:
    """``(item, item_id, doc_id, score)``: the ``k`` best documents of every task for every item, from ``vectors``."""
    kind = found.schema["doc_id"].dataType.simpleString()
    queries = [(number, item, np.array([vocabulary[t] for t in own if weights[vocabulary[t]] > 0], np.int64)) for number, item, own in block]
    shared = found.sparkSession.sparkContext.broadcast((queries, weights))
    arrow_item = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = shared.value
        best: list[list[tuple]] = [[] for _ in asked]
        kind_of_key = None
        for batch in batches:
            kind_of_key = batch.schema.field("doc_id").type
            at = 0
            while at < batch.num_rows:
                lists = batch.column(2).slice(at, TREE_DOCS)
                sizes = np.diff(lists.offsets.to_numpy())
                rows = max(1, int(np.searchsorted(np.cumsum(sizes), TREE_ENTRIES, side="right")))
                part = batch.slice(at, rows)
                at += part.num_rows
                ids, tfs = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
                sizes = sizes[: part.num_rows]
                values = parts(ids, tfs, sizes, part.column(1).to_numpy(), weight, documents, words)
                owner = np.repeat(np.arange(part.num_rows), sizes)[values > 0]
                ids, values = ids[values > 0], values[values > 0]
                held, starts = np.unique(owner, return_index=True)
                if not len(held):
                    continue
                keys = part.column(0).take(pa.array(held)).to_pylist()
                tree = BallTree(np.append(starts, len(ids)), ids, values, len(weight), leaf)
                for (_, _, query), own in zip(asked, best, strict=True):
                    tree.search(query, own, keys, k)
        rows = [(number, item, None if none else key, -score) for (number, item, _), own in zip(asked, best, strict=True) for score, none, key in own]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
        kinds = [pa.int64(), arrow_item, kind_of_key or pa.int64(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["item", "item_id", "doc_id", "score"])

    return found.mapInArrow(run, f"item long, item_id {item_type.simpleString()}, doc_id {kind}, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           k: int = TOP, most_terms: int = PASS_TERMS, most_items: int = PASS_ITEMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` documents with the highest scores above 0 for every row of ``items``.

    Terms, weights and scores follow the fixed integer formula of the module.  Documents are reduced to the terms that the items hold (no
    other term adds to a score), so a vector keeps few entries.  Every task builds ball trees over blocks of its
    documents and carries the k-th score of an item from one tree to the next; the tasks' lists then meet in one
    ranking.  Items are served in blocks of bounded vocabulary, one pass over the documents each.

    Null and empty texts have no terms and are never found; an item without terms has no rows.  Equal scores rank by
    ascending key, null last; rows that share a key are ranked each, and so are items that share an id.  Empty tables
    give no rows.  Other columns are ignored.
    """
    item_type = items.schema[item].dataType
    results = None
    for block in item_blocks(items, item, item_text, most_terms, most_items):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, own in block for t in own}))}
        found = cut_table(vectors(docs, vocabulary, key, text))
        total = found.agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("words")).first()
        if not total["documents"] or not vocabulary:
            continue
        held = found.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("df")).collect()  # bounded by the vocabulary
        weights = term_weights(len(vocabulary), {r["id"]: r["df"] for r in held}, total["documents"])
        own = best_of_tasks(found, block, vocabulary, weights, total["documents"], total["words"], item_type, k)
        results = own if results is None else results.unionByName(own)
    if results is None:
        kind = docs.schema[key].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"item_id {item_type.simpleString()}, rank int, doc_id {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
