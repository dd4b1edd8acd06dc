"""Near copies of documents: SimHash fingerprints a few bits apart, and for those beyond their radius MinHash bands and signatures, give pairs to look at.

The exact Jaccard similarity of the word shingles decides on each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import components, cut_table, spread_rows
from clausegraph.llm.sentencepiece import pieces
from clausegraph.llm.simhash import UnionFind, fingerprint, fingerprint_links
from clausegraph.session import cut_lineage

#: Words of a shingle.
SHINGLE = 5
#: Documents at or above this Jaccard similarity of their shingle sets are near copies.
THRESHOLD = 0.8
#: A similarity of 0.8 shares no band with a probability of 0.5904 ** 32, 5 in 10 ** 8; one of 0.9 less than 10 ** -14.
BANDS, ROWS = 32, 4
#: Share of the threshold that equal signature bytes must reach for a pair to be looked at: at a similarity of 0.8 less than 0.6 of
#: them agree with a probability of 3 in 10 ** 8.
PLAUSIBLE = 0.75
#: Documents of one bucket that are compared in one piece, by signatures and with their texts, and members of one hub that a task reads.
CHUNK, TEXT_CHUNK, SPOKES = 8192, 1024, 4096
#: Shingles that a task remembers.
SEEN = 1 << 22
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd multipliers, one for each place of the signature.
_FACTORS = np.random.default_rng(1).integers(0, 2**63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only


def shingle_set(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles, sorted; fewer words are one shingle, no words are none."""
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    count = max(len(words) - size, 0) + 1
    hashes = np.zeros(count, np.uint64)
    for at in range(min(size, len(words))):
        hashes = (hashes ^ each[at: at + count]) * _MIX
        hashes ^= hashes >> np.uint64(29)
    hashes *= _MIX
    return np.unique(hashes ^ (hashes >> np.uint64(32)))


def signature(own: np.ndarray) -> np.ndarray:
    """The smallest product of the set with each multiplier; places of two sets agree with the probability of their similarity."""
    least = np.full(len(_FACTORS), np.uint64(2**64 - 1))
    for at in range(0, len(own), 512):
        np.minimum(least, (own[at: at + 512, None] * _FACTORS).min(0), out=least)
    return least


def band_keys(least: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    keys = np.zeros(bands, np.uint64)
    for row in range(rows):
        keys = (keys ^ least[row::rows]) * _MIX
        keys ^= keys >> np.uint64(31)
    return keys * np.uint64(bands) + np.arange(bands, dtype=np.uint64)


def word_digest(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, row, digest, fp, n, sig, keys)``: digest of the words, SimHash, size of the shingle set, a byte of each signature place, bucket keys."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, fp, size, sig, keys = [], [], [], [], []
            for value in batch.column(2):
                words = words_of(value.as_py())
                fp.append(fingerprint(value.as_py()))
                own = shingle_set(words)
                least = signature(own)
                digest.append(word_digest(words))
                size.append(len(own))
                sig.append((least >> np.uint64(20)).astype(np.uint8).tobytes())
                keys.append(band_keys(least).view(np.int64) if len(own) else np.zeros(0, np.int64))
            stops = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(np.array(fp, np.uint64).view(np.int64)),
                 pa.array(size, pa.int32()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(stops), flat)],
                ["doc_id", "row", "digest", "fp", "n", "sig", "keys"])

    slim = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.col(text).cast("string").alias("text"))
    return spread_rows(slim).mapInArrow(run, f"doc_id {kind}, row long, digest binary, fp long, n int, sig binary, keys array<long>")


def similar(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= threshold * (len(a) + len(b) - common)


def plausible(at: int, sigs: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which members of a bucket may be near copies of member ``at``, by size and signature."""
    fits = np.minimum(sizes, sizes[at]) >= threshold * np.maximum(sizes, sizes[at])
    fits[at] = False
    where = np.flatnonzero(fits)
    agree = (sigs[where] == sigs[at]).sum(1)
    fits[where] = agree >= PLAUSIBLE * threshold * sigs.shape[1]
    return fits


def hubs_of(sigs: np.ndarray, sizes: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """For each member of a bucket the member it is to be compared with first (itself: it is one such hub), -1 without a plausible partner."""
    hub = np.full(len(sizes), -1)
    for at in range(len(sizes)):
        if hub[at] >= 0:
            continue
        near = plausible(at, sigs, sizes, threshold)
        if near.any():
            fresh = near & (hub < 0)
            hub[at] = at if fresh.any() else int(np.flatnonzero(near)[0])
            hub[fresh] = at
    return hub


def tiles(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows(k, digest, size of the bucket m, ...)`` with a tile number ``t``: buckets beyond ``chunk`` are dealt out as pairs of chunks."""
    chunks = F.ceil(F.col("m") / F.lit(chunk))
    cut = rows.withColumn("_c", F.pmod(F.xxhash64("digest"), chunks)).withColumn("_d", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    return cut.withColumn("t", F.least("_c", "_d") * chunks + F.greatest("_c", "_d")).drop("_c", "_d")


def buckets(batches: Iterator[pa.RecordBatch], binary: int) -> Iterator[tuple[int, list[list]]]:
    """``(k, columns)`` of each complete bucket, from rows sorted by their first two columns, the bucket and its tile."""
    now: tuple | None = None
    held: list[tuple] = []
    for batch in batches:
        for at, stop in pieces(pc.binary_length(batch.column(binary)).to_pylist(), 1 << 22):
            part = [batch.column(i).slice(at, stop - at).to_pylist() for i in range(batch.num_columns)]
            for row in zip(*part, strict=True):
                if row[:2] != now:
                    if held:
                        yield now[0], list(zip(*held, strict=True))
                    held, now = [], row[:2]
                held.append(row[2:])
    if held:
        yield now[0], list(zip(*held, strict=True))


def bucket_hubs(rows: DataFrame, threshold: float) -> DataFrame:
    """``(k, digest, hub)`` of the members that have a plausible partner in their bucket, from ``rows(k, t, digest, n, sig)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), *[pa.array([o[i] for o in out], pa.binary()) for i in (1, 2)]],
                                              ["k", "digest", "hub"])
            out.clear()
            return made

        for k, (digest, n, sig) in buckets(batches, 4):
            if len(digest) > 1:
                found = hubs_of(np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1), np.array(n), threshold)
                out += [(k, digest[i], digest[h]) for i, h in enumerate(found.tolist()) if h >= 0]
            if len(out) > 20_000:
                yield batch()
        yield batch()

    return rows.select("k", "t", "digest", "n", "sig").repartition("k", "t").sortWithinPartitions("k", "t", "digest").mapInArrow(run, "k long, digest binary, hub binary")


def fingerprint_spokes(nodes: DataFrame) -> DataFrame:
    """``(hub, digest)``: pairs whose SimHash fingerprints are equal or linked by ``simhash.fingerprint_links``, from ``nodes(digest, fp)``.

    One digest stands for each fingerprint: a spanning forest of the links, never a row per pair.  What the forest connects has all
    pairs within the radius.
    """
    heads = cut_table(nodes.groupBy("fp").agg(F.min("digest").alias("hub")))
    equal = nodes.join(heads, "fp").where("digest != hub").select("hub", "digest")
    links = fingerprint_links(heads.select("fp", F.col("fp").alias("node")))
    linked = links.join(heads.withColumnRenamed("fp", "a"), "a").join(heads.select(F.col("fp").alias("b"), F.col("hub").alias("digest")), "b")
    return equal.unionByName(linked.select("hub", "digest"))


def verified_spokes(spokes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` of ``spokes(hub, digest)`` whose similarity is ``threshold`` or more.

    A task holds one hub's set at a time and streams its members.  Hubs of more than ``SPOKES`` members are split,
    their own text is repeated for each part.
    """
    sizes = spokes.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(SPOKES)).alias("parts"))
    member = spokes.join(sizes, "hub").select("hub", F.pmod(F.xxhash64("digest"), F.col("parts")).alias("part"), F.lit(1).alias("role"), "digest")
    own = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("hub").alias("digest"))
    full = member.unionByName(own).join(texts, "digest").select("hub", "part", "role", "digest", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            hub, role, digest = (batch.column(i).to_pylist() for i in (0, 2, 3))
            links = []
            for i, value in enumerate(batch.column(4)):
                words = shingle_set(words_of(value.as_py()))
                if role[i] == 0:  # sorted first
                    own = words
                elif similar(own, words, threshold):
                    links.append((hub[i], digest[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return full.repartition("hub", "part").sortWithinPartitions("hub", "part", "role").mapInArrow(run, "a binary, b binary")


def bucket_links(rows: DataFrame, threshold: float) -> DataFrame:
    """Links ``(a, b)`` that join the labels of each bucket which similar members connect, from ``rows(k, t, digest, label, n, sig, text)``.

    Members of one label are not compared, and neither are labels that a link has joined; never a row per pair.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (digest, label, n, sig, text) in buckets(batches, 6):
            sigs, sizes = np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1), np.array(n)
            names = {x: i for i, x in enumerate(dict.fromkeys(label))}
            mark = np.array([names[x] for x in label])
            sets: dict[int, np.ndarray] = {}
            links = []

            def of(i: int) -> np.ndarray:
                if i not in sets:
                    if sum(map(len, sets.values())) > SEEN:
                        sets.clear()
                    sets[i] = shingle_set(words_of(text[i]))
                return sets[i]

            for at in range(len(mark)):
                near = plausible(at, sigs, sizes, threshold)
                for other in np.flatnonzero(near[:at]).tolist():
                    if mark[other] != mark[at] and similar(of(at), of(other), threshold):
                        links.append((digest[at], digest[other]))
                        mark[mark == mark[other]] = mark[at]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    full = rows.select("k", "t", "digest", "label", "n", "sig", "text")
    return full.repartition("k", "t").sortWithinPartitions("k", "t", "digest").mapInArrow(run, "a binary, b binary")


def texts_of(wanted: DataFrame, docs: DataFrame, every: DataFrame, key: str, text: str) -> DataFrame:
    """``(digest, text)`` of one document of each wanted digest."""
    place = every.select("digest", "doc_id", "row").join(wanted, "digest").groupBy("digest").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("at"))
    place = place.select("digest", F.col("at.doc_id").alias("_id"), F.col("at.row").alias("_row"))
    source = docs.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("row"), F.col(text).cast("string").alias("text"))
    found = source.join(place, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    return cut_table(found.select("digest", "text").dropDuplicates(["digest"]))


def near_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, row, component_id)``, one row per row of ``docs``; ``row`` tells rows with one key apart by their text.

    Documents of equal words, and documents whose sets of ``SHINGLE``-word shingles have a Jaccard similarity of
    ``threshold`` or more, belong together, and so do those that such documents connect; ``component_id`` is the
    smallest key of the class (null if it has none).  Texts without words are equal.  Null texts are empty, an empty
    table gives no rows, other columns are ignored.

    Fingerprints within the radius of ``simhash`` propose pairs first: the links' spanning forest, and as a bucket all fingerprints that the
    links connect, so that a link which the texts refute hides none of the others.  A similarity of ``threshold`` can lie beyond that radius:
    MinHash bands give buckets for the rest.  In each bucket signatures alone tell who has a plausible partner, and a hub to be compared with.  Hubs and their
    members are compared by their texts, so n near copies cost n comparisons.  Only buckets whose documents are still
    in several classes then meet with their texts, and give links between classes, never a row per pair.
    """
    every = cut_table(sketches(docs, key, text))
    nodes = cut_table(every.groupBy("digest").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    links = cut_table(fingerprint_spokes(nodes.select("digest", "fp")))
    groups = components(links, "hub", "digest").select(F.col("node").alias("digest"), F.xxhash64("component").alias("k"))
    keyed = nodes.select("digest", F.explode("keys").alias("k")).unionByName(groups)
    # of buckets with the same members one is enough
    marks = [F.bit_xor(F.xxhash64("digest", F.lit(i))).alias(f"x{i}") for i in range(2)]
    shared = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("m"), *marks).where("m > 1").groupBy("m", "x0", "x1").agg(F.min("k").alias("k")).select("k", "m")
    rows = cut_table(keyed.join(shared, "k"))
    sketch = nodes.select("digest", "n", "sig")
    hubs = cut_table(bucket_hubs(tiles(rows, CHUNK).join(sketch, "digest"), threshold))
    spokes = cut_table(hubs.where("hub != digest").select("hub", "digest").unionByName(links).distinct())
    wanted = hubs.select("digest").unionByName(spokes.select("digest")).unionByName(spokes.select(F.col("hub").alias("digest"))).distinct()
    texts = texts_of(wanted, docs, every, key, text)
    first = cut_table(verified_spokes(spokes, texts, threshold))
    linked = components(first).withColumnRenamed("node", "digest")
    marked = cut_table(hubs.select("k", "digest").distinct().join(linked, "digest", "left").select("k", "digest", F.coalesce("component", "digest").alias("label")))
    open_ = marked.groupBy("k").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("low"), F.max("label").alias("high"), *marks).where("low != high")
    open_ = open_.groupBy("m", "x0", "x1").agg(F.min("k").alias("k")).select("k", "m")
    again = tiles(marked.join(open_, "k"), TEXT_CHUNK).join(sketch, "digest").join(texts, "digest")
    edges = cut_table(first.unionByName(bucket_links(again, threshold)))
    linked = components(edges).withColumnRenamed("node", "digest")
    member = nodes.join(linked, "digest").select("digest", "component", "least")
    best = member.groupBy("component").agg(F.min("least").alias("best"))
    moved = cut_lineage(member.join(best, "component").select("digest", "best"))
    classes = nodes.select("digest", "least").join(moved, "digest", "left").select("digest", F.coalesce("best", "least").alias("component_id"))
    return every.select("doc_id", "row", "digest").join(classes, "digest").select("doc_id", "row", "component_id")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with the smallest key of their class of near copies, with all columns.

    Rows without a key are kept.
    """
    dropped = near_classes(docs, key, text, threshold).where("doc_id != component_id").select(F.col("doc_id").alias("_key"), F.col("row").alias("_row")).distinct()
    return docs.join(dropped, (docs[key] == F.col("_key")) & (F.xxhash64(docs[key], docs[text]) == F.col("_row")), "left_anti")
