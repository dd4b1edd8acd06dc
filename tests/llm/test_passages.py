"""Passages of more than 50 words that start and end in mid-sentence, against brute force over word windows."""

import random

from clausegraph.llm import substring_dedup

from test_operators import EDGE, docs, sentence


def brute(rows, size=51, least=25):
    """Kept words of every row that loses some: word windows and whole lines that occur before."""
    seen, lines, out = {}, {}, []
    for key, text, *_ in sorted(dict.fromkeys(r[:2] for r in rows), key=lambda r: (r[0] is None, r[0])):
        words = (text or "").split()
        low = [w.lower() for w in words]
        gone = set()
        for at in range(len(low) - size + 1):
            first = seen.setdefault(tuple(low[at: at + size]), (key, at))
            if first[0] != key or at >= first[1] + size:
                gone.update(range(at, at + size))
        at = 0
        for line in (text or "").split("\n"):
            own = tuple(line.lower().split())
            if len(own) >= least and lines.setdefault(own, (key, at)) != (key, at):
                gone.update(range(at, at + len(own)))
            at += len(own)
        if gone:
            out.append((key, [w for i, w in enumerate(words) if i not in gone]))
    return sorted(out, key=str)


def test_passages_in_mid_sentence(spark):
    rng = random.Random(21)
    rows = []
    passages = [" ".join(sentence(rng, 17) for _ in range(8)).split() for _ in range(12)]
    for i in range(80):
        words = " ".join(sentence(rng, 14) for _ in range(10)).split()
        for _ in range(rng.randrange(3)):
            passage = rng.choice(passages)
            size = rng.choice([40, 50, 51, 60, 120])
            start = rng.randrange(len(passage) - size + 1)
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() if i % 3 == 0 else w for w in passage[start: start + size]]
        rows.append((i + 100, ("\n" if i % 5 == 0 else "  ").join(words), "en", "a"))
    rows += [(500, rows[7][1].upper(), "en", "a"), (501, "x " + " ".join(passages[0][3:60]) + " y " + " ".join(passages[0][3:60]), "en", "a"), (502, "same " * 300, "en", "a")]
    got = [(r["doc_id"], r["text"].split()) for r in substring_dedup.without_passages(docs(spark, rows + EDGE)).collect()]
    want = brute(rows + EDGE)
    assert len(want) > 20 and sorted(got, key=str) == want


def test_repeated_lines(spark):
    """A line of 25 words and more goes though no passage of more than 50 words repeats; shorter lines stay."""
    rng = random.Random(22)
    long, short = sentence(rng, 30), sentence(rng, 12)
    rows = [(i, "\n".join([sentence(rng, 9), long if i % 2 else long.upper().replace(" ", "  "), short, sentence(rng, 20)]), "en", "a") for i in range(1, 9)]
    rows += [(20, long + "\n" + sentence(rng, 40) + "\n" + long, "en", "a"), (21, long, "en", "a"), (None, sentence(rng, 30) + "\n" + long, "en", "a")]
    got = [(r["doc_id"], r["text"].split()) for r in substring_dedup.without_passages(docs(spark, rows + EDGE)).collect()]
    want = brute(rows + EDGE)
    assert {k for k, _ in want} >= {2, 3, 8, 20, 21, None} and sorted(got, key=str) == want
    spans = substring_dedup.repeated_passages(docs(spark, rows)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert all(texts[r["doc_id"]][r["start"]: r["stop"]].lower().split() == long.split() and r["first_doc_id"] == 1 and r["words"] == 30 for r in spans)
