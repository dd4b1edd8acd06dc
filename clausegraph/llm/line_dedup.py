"""Fuzzy line dedup: MinHash of character shingles, exact Jaccard verification, distributed union-find."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import components, cut_table, spread_rows
from clausegraph.llm.sentencepiece import pieces
from clausegraph.llm.simhash import UnionFind
from clausegraph.session import cut_lineage

#: Characters of a shingle, a power of two.
SHINGLE = 8
#: Lines at or above this Jaccard similarity of their shingle sets are copies.
THRESHOLD = 0.8
#: A similarity of 0.8 is found with a probability of 0.997, one of 0.9 with 0.99999.
BANDS, ROWS = 8, 3
#: Lines of one bucket that are compared in one piece.
CHUNK = 256
#: Members of one hub that a task reads.
SPOKES = 4096
#: Lines that a task remembers as passed on; more only costs repeated rows.
SEEN = 200_000
_EMPTY = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normalise(line: str) -> str:
    return " ".join(line.lower().split())


def line_digest(line: str) -> bytes:
    return hashlib.md5(line.encode("utf-8", "surrogatepass")).digest()


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the lines, and the line of each; a shorter line is one shingle."""
    padded = "".join(line.ljust(SHINGLE, "\0") for line in lines)
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([max(len(line), SHINGLE) for line in lines], np.int64)
    owner = np.repeat(np.arange(len(lines)), sizes)
    hashes, width = codes, 1
    while width < SHINGLE:  # two hashes of neighbouring characters give that of twice as many
        hashes = hashes[:-width] * _MIX + hashes[width:]
        hashes ^= hashes >> np.uint64(29)
        width *= 2
    hashes *= _MIX
    hashes ^= hashes >> np.uint64(32)
    count = len(hashes)
    whole = owner[:count] == owner[SHINGLE - 1:]
    return hashes[whole], owner[:count][whole]


def band_keys(lines: list[str], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(lines, bands) bucket keys.  One hash per shingle falls into one of bands x rows bins, the smallest of each
    bin is its signature, and an empty bin takes that of the next filled one."""
    bins = bands * rows
    hashes, owner = shingle_hashes(lines)
    signature = np.full(len(lines) * bins, _EMPTY, np.uint64)
    np.minimum.at(signature, owner * bins + (hashes % np.uint64(bins)).astype(np.int64), hashes // np.uint64(bins))
    signature = signature.reshape(len(lines), bins)
    for step in range(1, bins):
        empty = signature == _EMPTY
        if not empty.any():
            break
        signature = np.where(empty, np.roll(signature, -1, axis=1), signature)
    keys = np.zeros((len(lines), bands), np.uint64)
    for row in range(rows):
        keys = (keys ^ signature[:, row::rows]) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys * np.uint64(bands) + np.arange(bands, dtype=np.uint64)


def line_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(digest, line)``: the normalised lines that are not blank, a repeated one about once a task.

    A task remembers the digests of up to ``SEEN`` lines, so a line of a third of all rows costs one row a task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fresh: dict[bytes, str] = {}
            size = 0
            for whole in batch.column(0):
                for line in map(normalise, (whole.as_py() or "").split("\n")):
                    digest = line_digest(line)
                    if line and digest not in seen:
                        seen.add(digest)
                        fresh[digest] = line
                        size += len(line)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array(list(fresh.values()), pa.string())], ["digest", "line"])
                    fresh, size = {}, 0
                if len(seen) > SEEN:
                    seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.binary()), pa.array(list(fresh.values()), pa.string())], ["digest", "line"])

    return spread_rows(docs.select(F.col(text).cast("string").alias("text"))).mapInArrow(run, "digest binary, line string")


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, row, line_no, digest, keys)`` of all lines that are not blank, with the ``keys`` of their buckets."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            texts = whole.column(2).to_pylist()
            at = 0
            while at < len(texts):
                found: dict[str, int] = {}  # a repeated line is hashed once
                which: list[int] = []
                number: list[int] = []
                owner: list[int] = []
                while at < len(texts) and len(which) < 512:
                    for no, line in enumerate((texts[at] or "").split("\n")):
                        if line := normalise(line):
                            which.append(found.setdefault(line, len(found)))
                            number.append(no)
                            owner.append(at)
                    at += 1
                if not found:
                    continue
                take = pa.array(owner)
                distinct = list(found)
                digest = pa.array(list(map(line_digest, distinct)), pa.binary()).take(pa.array(which))
                flat = band_keys(distinct).view(np.int64)[which]
                keys = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * BANDS), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [whole.column(0).take(take), whole.column(1).take(take), pa.array(number, pa.int32()), digest, keys],
                    ["doc_id", "row", "line_no", "digest", "keys"])

    slim = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.col(text).cast("string").alias("text"))
    return spread_rows(slim).mapInArrow(run, f"doc_id {kind}, row long, line_no int, digest binary, keys array<long>")


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    """Jaccard similarity of two sorted shingle sets at or above the threshold; the sizes decide first."""
    small, large = sorted((len(a), len(b)))
    if small < threshold * large:
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = np.count_nonzero(both[1:] == both[:-1])
    return bool(common >= threshold * (small + large - common))


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct shingles of every line, sorted, hashed for all lines at once."""
    hashes, owner = shingle_hashes(texts)
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        hashes[a:b].sort()
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[fresh], owner[fresh]
    return np.split(hashes, np.searchsorted(owner, np.arange(1, len(texts))))[: len(texts)]


def bucket_forest(sets: list[np.ndarray], threshold: float = THRESHOLD, labels: list | None = None) -> list[tuple[int, int]]:
    """Links that connect all lines of a bucket which similar pairs connect, by their shingle sets.

    Each line is compared with the lines of every group found so far until one is similar, newest groups last; lines
    of one group are not compared again.  Lines of one label are known to belong together.
    """
    groups: list[list[int]] = []
    links = []
    known: dict = {}
    for i, own in enumerate(sets):
        if labels is not None and labels[i] in known:
            mate = known[labels[i]]
            home = next(g for g in groups if mate in g)
            rest = [g for g in groups if g is not home]
        else:
            home, rest = [], groups
        if labels is not None:
            known.setdefault(labels[i], i)
        apart, joined = [], [*home, i]
        for group in rest:
            hit = next((j for j in group if similar(own, sets[j], threshold)), None)
            if hit is None:
                apart.append(group)
            else:
                links.append((hit, i))
                joined = group + joined
        groups = [*apart, joined]
    return links


def hub_links(spokes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` of ``spokes(hub, digest)`` of similar lines; ``texts(_g, line)`` has both.

    A task holds one hub's set and streams its members; a hub of more than ``SPOKES`` members is split, with its line repeated.
    """
    sizes = spokes.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(SPOKES)).alias("parts"))
    member = spokes.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("digest"), F.col("parts")).alias("part"), F.lit(1).alias("role"), "digest")
    own = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("hub").alias("digest"))
    full = member.unionByName(own).join(texts, F.col("digest") == F.col("_g")).select("hub", "part", "role", "digest", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            for at, stop in pieces(pc.binary_length(batch.column(4)).to_pylist(), 1 << 20):
                hub, role, digest, line = (batch.column(i).slice(at, stop - at).to_pylist() for i in (0, 2, 3, 4))
                links = []
                for i, words in enumerate(shingle_sets(line)):
                    if role[i] == 0:  # sorted first
                        own = words
                    elif similar(own, words, threshold):
                        links.append((hub[i], digest[i]))
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return full.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(run, "a binary, b binary")


def similar_lines(nodes: DataFrame, texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Edges ``(a, b)`` between digests of similar lines, from ``nodes(digest, keys)`` of distinct lines.

    Their text is taken from ``texts(digest, line)``, which may repeat.  The lines of a bucket are compared with its
    first line, each such pair once over all buckets; buckets that are still in several classes are compared between
    these.  Those beyond ``CHUNK`` lines are dealt out as pairs of chunks, and a bucket gives links and not its pairs.
    """
    # numbers stand for digests until few rows are left; two digests of one number both come back
    keyed = nodes.select(F.xxhash64("digest").alias("h"), F.explode("keys").alias("k"))
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = cut_table(keyed.join(shared, "k"))
    # lines that share one band often share more: of buckets with the same members one is enough
    marks = [F.bit_xor(F.xxhash64("h", F.lit(i))).alias(f"x{i}") for i in range(2)]
    single = rows.groupBy("k", "n").agg(*marks).groupBy("n", "x0", "x1").agg(F.min("k").alias("k")).select("k")
    rows = rows.join(single, "k", "left_semi")
    named = rows.join(nodes.select("digest", F.xxhash64("digest").alias("h")), "h").drop("h")
    hubs = named.groupBy("k").agg(F.min("digest").alias("hub"))
    rows = cut_table(named.join(hubs, "k"))
    wanted = rows.select(F.col("digest").alias("_g")).distinct()
    found = cut_table(texts.join(wanted, texts["digest"] == F.col("_g")).groupBy("_g").agg(F.max("line").alias("line")))
    # each line meets the first line of its buckets once, however many buckets they share
    spokes = rows.where("digest != hub").select("hub", "digest").distinct()
    first = cut_table(hub_links(spokes, found, threshold))
    labels = components(first).withColumnRenamed("node", "digest")
    # buckets of two are settled; larger ones meet with their texts only where the first comparisons left several classes
    marked = rows.where("n > 2").join(labels, "digest", "left").select("k", "digest", "n", F.coalesce("component", "digest").alias("label"))
    marked = cut_table(marked)
    open_ = marked.groupBy("k").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high").select("k")
    rows = marked.join(open_, "k", "left_semi")
    chunks = F.ceil(F.col("n") / F.lit(CHUNK))
    tiles = rows.select("k", "digest", "label", chunks.alias("m"), F.pmod(F.xxhash64("digest"), chunks).alias("c"))
    tiles = tiles.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    tiles = tiles.select("k", (F.least("c", "d") * F.col("m") + F.greatest("c", "d")).alias("t"), "digest", "label")
    full = tiles.join(found, tiles["digest"] == found["_g"]).select("k", "t", "digest", "line", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links = UnionFind()
        now: tuple | None = None
        bucket: list[tuple[bytes, np.ndarray, bytes]] = []

        def close() -> None:
            if len(bucket) > 1:
                for a, b in bucket_forest([x[1] for x in bucket], threshold, [x[2] for x in bucket]):
                    links.join(bucket[a][0], bucket[b][0])

        def out() -> pa.RecordBatch:
            edges = links.edges()
            links.up.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for at, stop in pieces(pc.binary_length(batch.column(3)).to_pylist(), 1 << 20):
                k, t, digest, line, label = (batch.column(i).slice(at, stop - at).to_pylist() for i in range(5))
                fresh = dict(zip(digest, line, strict=True))  # a line stands in several buckets
                sets = dict(zip(fresh, shingle_sets(list(fresh.values())), strict=True))
                for place, own, name in zip(zip(k, t, strict=True), digest, label, strict=True):
                    if place != now:
                        close()
                        bucket, now = [], place
                    bucket.append((own, sets[own], name))
            yield out()
        close()
        yield out()

    rest = full.repartition("k", "t").sortWithinPartitions("k", "t", "digest").mapInArrow(run, "a binary, b binary")
    return first.unionByName(rest)


def line_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, line_no, keep_doc_id, keep_line_no, kept)``, one row per line that is not blank.

    Lines are compared in lower case with white space made even; equal lines, and lines whose shingle sets have a
    Jaccard similarity of ``threshold`` or more, belong together, and so do lines that such lines connect.  The line
    of the smallest key (null last) and number stays, the others go.  Blank lines and null texts are no lines and
    stay as they are.  Lines of rows alike in key and text are marked alike.  Other columns are ignored.
    """
    every = cut_table(lines(docs, key, text))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no")
    found = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line_no", "keys")  # equal lines, equal keys
    nodes = cut_table(every.groupBy("digest").agg(F.min(found).alias("found")).select(
        "digest", F.struct(*[f"found.{c}" for c in ("none", "doc_id", "row", "line_no")]).alias("first"), "found.keys"))
    edges = similar_lines(nodes, line_texts(docs, text), threshold)
    linked = components(edges)
    member = nodes.join(linked.withColumnRenamed("node", "digest"), "digest").select("digest", "component", "first")
    best = member.groupBy("component").agg(F.min("first").alias("best"))
    moved = cut_lineage(member.join(best, "component").select("digest", "best"))
    classes = nodes.select("digest", "first").join(moved, "digest", "left").select("digest", F.coalesce("best", "first").alias("best"))
    return every.join(classes, "digest").select(
        "doc_id", "line_no", F.col("best.doc_id").alias("keep_doc_id"), F.col("best.line_no").alias("keep_line_no"),
        place.eqNullSafe(F.col("best")).alias("kept"))


def without_copied_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text)`` of the rows that lose lines, without them."""
    gone = line_classes(docs, key, text).where("NOT kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("gone"))
    source = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_text"))
    numbered = F.transform(F.split("_text", "\n"), lambda line, i: F.struct(line.alias("line"), i.alias("no")))
    left = F.transform(F.filter(numbered, lambda x: ~F.array_contains("gone", x.no)), lambda x: x.line)
    return source.join(gone, "doc_id").select("doc_id", F.array_join(left, "\n").alias("text"))
