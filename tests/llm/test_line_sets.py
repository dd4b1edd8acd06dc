"""Shingle sets as sorted arrays: the same sets and similarities as plain Python sets of substrings."""

import numpy as np

from clausegraph.llm import line_dedup as ld

LINES = ["a", "", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaa", "the quick brown fox jumps over the lazy dog",
         "the quick brown fox jumps over the lazy dog again", "čeština 漢字 \U0001f600 text with wide characters", "x" * 5000]


def plain(line: str) -> set[str]:
    line = line.ljust(ld.SHINGLE, "\0")
    return {line[i: i + ld.SHINGLE] for i in range(len(line) - ld.SHINGLE + 1)}


def test_sets_have_the_size_of_plain_sets_and_are_sorted():
    found = ld.shingle_sets(LINES)
    assert [len(s) for s in found] == [len(plain(line)) for line in LINES]
    assert all((np.diff(s.astype(object)) > 0).all() for s in found)
    assert ld.shingle_sets([]) == []
    for line, together in zip(LINES, found, strict=True):  # a line's set does not depend on its neighbours
        assert np.array_equal(ld.shingle_sets([line])[0], together)


def test_similarity_equals_that_of_plain_sets():
    found = ld.shingle_sets(LINES)
    for a, x in zip(LINES, found, strict=True):
        for b, y in zip(LINES, found, strict=True):
            exact = len(plain(a) & plain(b)) / len(plain(a) | plain(b))
            for threshold in (0.5, 0.8, 0.9):
                assert ld.similar(x, y, threshold) == (exact >= threshold)


def test_equal_lines_have_equal_bucket_keys_in_any_batch():
    keys = ld.band_keys(LINES)
    assert all(np.array_equal(ld.band_keys([line])[0], keys[i]) for i, line in enumerate(LINES))
