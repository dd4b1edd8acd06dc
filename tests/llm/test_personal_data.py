"""Personal data: fixed patterns against plain regular expressions, the field by held-out accuracy, edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegraph.llm import personal_data

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_luhn(digits):
    doubled = [int(d) * 2 if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return 13 <= len(digits) <= 19 and sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            value, digits = m.group(), "".join(c for c in m.group() if c in "0123456789")
            if kind == 0 or kind == 1 and all(int(p) <= 255 for p in value.split(".")) or kind == 2 and plain_luhn(digits) or kind == 3 and 9 <= len(digits) <= 15:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    pieces = ["a", "b.c", "@", "@@", ".", "..", "-", "+", "%", " ", "\n", "é", "1", "25", "255", "256", "0004", "4111111111111111", "4111 1111 1111 1111",
              "+1 (555) 010-2030", "x@y.z", "10.0.0.1", "(", ")", "_", "mail.de", "9" * 21, "  "]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        assert sorted(personal_data.base_spans(text)) == sorted(plain_base(text)), text
    for text in ("a" * 200_000, "1" * 200_000, "a." * 50_000 + "@", "+1" * 50_000, "1." * 50_000, "@" * 100_000):  # no square work
        personal_data.base_spans(text)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in personal_data.personal_data(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    order = {k: i for i, k in enumerate(personal_data.KINDS)}
    added = 0
    for key, text in texts.items():
        base = ",".join(f"{personal_data.KINDS[k]}:{a}:{b}" for k, a, b in sorted(plain_base(text)))
        assert rows[key].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        spans = [s.split(":") for s in rows[key].spans.split(",") if s]
        assert set(filter(None, base.split(","))) <= set(rows[key].spans.split(","))
        assert [(order[k], int(a)) for k, a, _ in spans] == sorted((order[k], int(a)) for k, a, _ in spans)
        assert [rows[key][f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == k for s in spans) for k in personal_data.KINDS]
        assert rows[key].n_added == len(spans) - len(list(filter(None, base.split(","))))
        added += rows[key].n_added
    assert added < 20  # almost all personal data of these texts fits the patterns


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "no data"), (4, "a@b.co"), (4, "a@b.co"), (None, "10.1.2.3"), (5, "word " * 100_000 + "a@b.co"), (6, "7 " * 30_000),
            (7, "é" * 9 + " x@y.de"), (8, "1" * 5000 + "." + "1.1.1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("n_ip", F.lit("x"))
    got = sorted(((r.doc_id, r.spans) for r in personal_data.personal_data(docs).collect()), key=repr)
    assert got == sorted([(1, ""), (2, ""), (3, ""), (4, "email:0:6"), (4, "email:0:6"), (None, "ip:0:8"), (5, "email:500000:500006"), (6, ""),
                          (7, "email:10:16"), (8, "")], key=repr)
    assert personal_data.personal_data(docs.limit(0)).collect() == []


def test_added_spans():
    field = personal_data.train()
    cases = {"und +1 (269) 555-3296 4524132264652876 and": ["phone:4:21", "card:22:38"], "write to jane.roe [at] mail [dot] example [dot] com now": ["email"],
             "ring (212) 555-0147 today": ["phone"], "password=4384581a2ff9794f6b and 2023-10-04 for 12.50": [], "it has 12 pages of 300 words in 1999": [],
             "token = \"c1f80f127674f6764aed23d9333\"": [], "version 1.2.3 and section 4.5": [], "see 4893 4102 or 77": []}
    for text, want in cases.items():
        base, added = personal_data.all_spans([text], field)[0]
        got = [s for s in personal_data.listed(base + added).split(",") if s]
        assert len(got) == len(want) and all(any(g.startswith(w) for g in got) for w in want), (text, got)


def test_field_on_rows_it_has_not_seen(monkeypatch):
    field = personal_data.train()
    monkeypatch.setattr(personal_data, "SEED", 99)
    hit = total = false = 0
    for text, spans in personal_data.labelled_rows():
        base, added = personal_data.all_spans([text], field)[0]
        for kind, a, b in spans:
            total += 1
            hit += any(k == kind and x < b and a < y for k, x, y in base + added)
        false += sum(not any(x < b and a < y for _, a, b in spans) for _, x, y in added)
    assert hit / total > 0.95 and false <= 3


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(2)
    field = personal_data.ShapeField({f"f{i}": i for i in range(6)}, rng.normal(size=(6, 9)), rng.normal(size=(9, 9)))
    runs = [[[f"f{i}" for i in rng.integers(0, 6, 2)] for _ in range(n)] for n in (1, 3, 2, 4, 1)]
    for run, path in zip(runs, field.decode(runs), strict=True):
        def value(states, run=run):
            own = sum(field.weights[int(f[1:]), s] for token, s in zip(run, states, strict=True) for f in token)
            return own + sum(field.steps[a, b] for a, b in itertools.pairwise([0, *states, 0]))
        assert value(path) == pytest.approx(max(map(value, itertools.product(range(9), repeat=len(run)))))


def test_query_counts_base_spans(spark, tmp_path):
    from clausegraph.llm.queries import QUERIES

    texts = ["und +1 (269) 555-3296 4524132264652876 and", "write to jane.roe [at] mail [dot] example [dot] com now", "ring (212) 555-0147 today", None,
             "a@b.co 10.0.0.1 4111111111111111", "a@b.co, c@d.co; +1 212 555 0147"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op13_personal_data"](spark, str(tmp_path)).collect()
    assert sum(r.n_added for r in rows) >= 3
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in personal_data.KINDS] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(personal_data.listed(base).encode()).hexdigest()
        assert len(r.spans.split(",")) - (r.spans == "") == len(base) + r.n_added
