"""SimHash near-dedup with bit-sliced comparison of fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import components, spread_rows
from clausegraph.session import cut_lineage

BITS = 64
#: Shingle hash seed.
SEED = 42
#: Fingerprints of one bucket that are compared in one piece; larger buckets are cut into pairs of chunks.
CHUNK = 2048
#: Up to this size the members of many buckets are compared side by side.
SMALL = 32


def fingerprint(text: str | None, size: int = 4) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a whole text; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], stops[:-1] + 1))
    last = max(len(words) - size, 0)
    spans = zip(starts[: last + 1].tolist(), stops[min(size, len(words)) - 1:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[s:e], SEED) for s, e in spans), np.uint64, last + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        octets = hashes[at: at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """``(doc_id, fp)``; ``fp`` is the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), size) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    slim = spread_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")))
    return slim.mapInArrow(run, f"doc_id {kind}, fp long")


def block_keys(fp: Column, radius: int, blocks: int) -> list[Column]:
    """Keys of which fingerprints within ``radius`` bits share at least one.

    At most ``radius`` of the ``blocks`` blocks differ, so the others agree: one key for each choice of them.
    """
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    part = [F.shiftrightunsigned(fp, cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1)) for i in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(number).cast("long")
        for i in chosen:
            key = F.shiftleft(key, cuts[i + 1] - cuts[i]).bitwiseOR(part[i])
        keys.append(key)
    return keys


def within(planes: Iterator[np.ndarray], radius: int) -> np.ndarray:
    """Lanes (bits) whose number of ones over all planes is at most ``radius`` (up to 7).

    ``planes`` are words in which each bit is a lane; every plane adds 0 or 1 to the lane's distance.  Counters are
    bit-sliced too: carry-save adders take planes two at a time, and eight or more sticks in ``over``.  When all
    lanes exceed the radius after some planes, the rest is not looked at.
    """
    ones = twos = fours = over = None
    pending = None

    def exceeds() -> np.ndarray:
        out = over.copy()
        for value in range(radius + 1, 8):
            lane = ones if value & 1 else ~ones
            lane = lane & (twos if value & 2 else ~twos) & (fours if value & 4 else ~fours)
            out |= lane
        return out

    for at, plane in enumerate(planes):
        if ones is None:
            ones, twos, fours, over = (np.zeros_like(plane) for _ in range(4))
        if pending is None:
            pending = plane
            continue
        mixed = ones ^ pending
        carry = (ones & pending) | (mixed & plane)
        ones = mixed ^ plane
        pending = None
        carry2 = twos & carry
        twos = twos ^ carry
        over = over | (fours & carry2)
        fours = fours ^ carry2
        if at % 8 == 7 and not (~exceeds()).any():
            return np.zeros_like(ones)
    return ~exceeds()


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): bit b of all values, packed, lane i in bit i."""
    octets = values.astype("<u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    width = -(-packed.shape[1] // 8) * 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, width - packed.shape[1])))).view("<u8")


def close_pairs(left: np.ndarray, right: np.ndarray, radius: int) -> np.ndarray:
    """Mask of the positions at which ``left`` and ``right`` differ in at most ``radius`` bits."""
    lanes = within(iter(bit_planes(left ^ right)), radius)
    return np.unpackbits(lanes.view(np.uint8), bitorder="little")[: len(left)].astype(bool)


def neighbours(values: np.ndarray, radius: int) -> np.ndarray:
    """(n, words) bit matrix: lane j of row i is set if values i and j are within the radius."""
    planes, n = bit_planes(values), len(values)
    rows = []
    for at in range(0, n, 512):
        asked = values[at: at + 512]
        flags = np.unpackbits(asked.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64)
        full = np.negative(flags)  # all ones where the bit is set
        rows.append(within((planes[b][None, :] ^ full[:, b][:, None] for b in range(BITS)), radius))
    matrix = np.concatenate(rows)
    lanes = np.zeros(matrix.shape[1] * 64, bool)
    lanes[:n] = True
    return matrix & np.packbits(lanes, bitorder="little").view("<u8")


def forest(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (root, member) of a spanning forest of the links within ``values``."""
    matrix = neighbours(values, radius)
    fresh = np.ones(len(values), bool)
    edges = []
    for root in range(len(values)):
        if not fresh[root]:
            continue
        fresh[root] = False
        front = np.array([root])
        while len(front):
            reach = np.bitwise_or.reduce(matrix[front], axis=0)
            seen = np.unpackbits(reach.view(np.uint8), bitorder="little")[: len(values)].astype(bool) & fresh
            front = np.flatnonzero(seen)
            fresh[front] = False
            edges.extend((root, m) for m in front.tolist())
    return edges


class UnionFind:
    """Over the members of one batch of buckets."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        path = []
        while (parent := self.up.setdefault(x, x)) != x:
            path.append(x)
            x = parent
        for p in path:
            self.up[p] = x
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> list[tuple[int, int]]:
        return [(self.find(x), x) for x in self.up if self.find(x) != x]


def _bucket_links(group: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> pa.RecordBatch:
    """Spanning edges of complete buckets; ``group`` numbers them in runs."""
    links = UnionFind()
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    small = np.repeat(sizes <= SMALL, sizes)
    for lag in range(1, min(int(sizes.max(initial=0)), SMALL)):
        at = np.flatnonzero(small[:-lag] & (group[:-lag] == group[lag:]))
        if len(at):
            for i in at[close_pairs(fp[at], fp[at + lag], radius)].tolist():
                links.join(int(node[i]), int(node[i + lag]))
    for start, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        members = node[start: start + size].tolist()
        for a, b in forest(fp[start: start + size], radius):
            links.join(members[a], members[b])
    edges = links.edges()
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])


def fingerprint_links(nodes: DataFrame, radius: int = 4, blocks: int = 6) -> DataFrame:
    """Edges ``(a, b)`` that connect all fingerprints within ``radius`` bits, from distinct ``(fp, node)``.

    Buckets are all fingerprints that agree in ``blocks - radius`` blocks.  More blocks give narrower buckets and
    more keys a fingerprint (15 with 6, 35 of 27 bits with 7); the links are the same.  Buckets of one are left out
    before the shuffle of rows; buckets beyond ``CHUNK`` are dealt out as pairs of chunks, so no task holds more
    than two chunks of a bucket.  A bucket gives a spanning forest of its links and not its pairs.
    """
    keyed = nodes.select("fp", "node", F.explode(F.array(*block_keys(F.col("fp"), radius, blocks))).alias("k"))
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keyed.join(shared, "k").withColumn("chunks", F.ceil(F.col("n") / F.lit(CHUNK)))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    rows = rows.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    rows = rows.select("k", (F.least("c", "d") * F.col("chunks") + F.greatest("c", "d")).alias("t"), "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            k, t = now[0], now[1]
            if not len(k):
                continue
            edge = np.concatenate(([False], (k[1:] != k[:-1]) | (t[1:] != t[:-1])))
            cut = int(np.flatnonzero(edge)[-1]) if edge.any() else 0  # the last bucket may go on
            held = [x[cut:] for x in now]
            if cut:
                yield _bucket_links(np.cumsum(edge[:cut]), now[2][:cut].view(np.uint64), now[3][:cut], radius)
        if held is not None and len(held[0]):
            yield _bucket_links(np.zeros(len(held[0]), np.int64), held[2].view(np.uint64), held[3], radius)

    return rows.repartition("k", "t").sortWithinPartitions("k", "t").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, radius: int = 4, blocks: int = 6) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per row of ``docs``.

    Fingerprints of ``size``-word shingles link at ``radius`` or fewer differing bits; ``component_id`` is the
    smallest key reachable.  Texts with fewer words have one shingle; null, empty and blank texts have fingerprint
    zero and link like any other.  Equal fingerprints (all copies) are one node, so groups of copies of any size
    cost one comparison.  Rows with a null key get the class of their fingerprint (null if it has no keys) and link
    nothing; other columns are ignored; an empty table gives no rows.  The key must be an integer.
    """
    marked = cut_lineage(fingerprints(docs, key, text, size))
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("node")))
    linked = components(fingerprint_links(nodes.where("node IS NOT NULL"), radius, blocks))
    classes = nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(classes, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
