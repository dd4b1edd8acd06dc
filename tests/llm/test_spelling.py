"""Spelling variants against brute force over all pairs, and edge cases."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from clausegraph.llm import spelling


def plain_words(docs):
    found = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if key is None else key}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if n >= 2 and len(w) >= 7}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:p] + a[p + 1:] == b for p in range(len(a)))


def plain_variants(docs):
    words = plain_words(docs)
    close = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(close[w]), words[form[w]] if w in form else None))
    return sorted(out, key=repr)


def found(docs):
    return sorted(map(tuple, spelling.variants(docs).collect()), key=repr)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert found(docs) == want
    assert sum(r[4] for r in want) > 100


def test_chains_ties_and_edges(spark):
    rng = random.Random(3)
    base = ["gardeners", "mountains", "éclairées", "streetcar", "aaaaaaaa"]
    words = [(w, 3000) for w in base]
    for w in base:
        for _ in range(12):
            p = rng.randrange(len(w))
            once = rng.choice([w[:p] + w[p + 1:], w[:p] + rng.choice("abcdeé") + w[p + 1:], w[:p] + rng.choice("xyzü") + w[p:]])
            q = rng.randrange(len(once))
            words += [(once, 100), (once[:q] + rng.choice("klm") + once[q:], 5)]
    rows = [(i, " ".join([w] * n)) for i, (w, n) in enumerate(words)]
    rows += [(None, "gardenerz gardenerz"), (None, "gardenerz"), (9001, None), (9002, ""), (9003, "short words too"), (9003, "Gardeners GARDENERS"),
             (9004, "x" * 30_000), (9005, "x" * 30_000), (9006, "x" * 29_999 + "y"), (9007, "x" * 29_999 + "y"), (9008, "mountains×÷mountains×÷")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("key", F.lit(1)).repartition(5)
    want = plain_variants(rows)
    assert found(docs) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a chain of two steps
    assert found(docs.limit(0)) == []


def test_neighbourhoods_hold_every_reduced_neighbour():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghéü") for _ in range(rng.randint(7, 12))) for _ in range(30)]
    owner, keys = spelling.neighbour_keys(words)
    held = defaultdict(set)
    for o, k in zip(owner.tolist(), keys.tolist(), strict=True):
        held[o].add(k)
    for i, word in enumerate(words):
        for p in range(len(word)):
            shorter = word[:p] + word[p + 1:]
            assert int(spelling.reduced_keys([shorter])[0]) in held[i]
            for c in "abcdefghijé":
                other = word[:p] + c + word[p + 1:]
                a, b = (ord(word[p]) % spelling.SYMBOLS, ord(c) % spelling.SYMBOLS)
                if b > a:
                    assert int(spelling.reduced_keys([other])[0]) in held[i]
    assert len(np.unique(spelling.reduced_keys(words))) > 25
