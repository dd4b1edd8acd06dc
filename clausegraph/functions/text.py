"""Text functions as Column expressions (all evaluated inside the JVM)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence borders, trimmed characters and the bracketed ordinals
# that separate list items in the source texts.
ORDINAL_MARK = "（[一二三四五六七八九十]+）"
CJK_DELIMITERS = "。；;\\n"
LATIN_DELIMITERS = ".。；;\\n"
WHITESPACE = " \t\n\r\x0b\x0c   　"
EDGE_MARKS = "（）：。；;"
CJK = "\\u4e00-\\u9fff"

Tokenizer = Callable[[Column], Column]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str, chars: str = WHITESPACE) -> Column:
    return F.btrim(_col(c), F.lit(chars))


def sentences(text: Column | str, delimiters: str = CJK_DELIMITERS) -> Column:
    """Array of non-empty sentences; empty pieces are dropped before numbering."""
    pieces = F.split(F.coalesce(_col(text), F.lit("")), f"{ORDINAL_MARK}|[{delimiters}]")
    cleaned = F.transform(pieces, lambda s: strip(strip(s), EDGE_MARKS))
    return F.filter(cleaned, lambda s: s != "")


def words(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(_col(text)), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def _run_grams(run: Column, n: int) -> Column:
    """n-grams of one string in linear time: characters are cut once, then joined."""
    def join(chars):
        size = F.size(chars)
        at = F.sequence(F.lit(1), size - F.lit(n - 1))
        grams = F.transform(at, lambda i: F.concat(*[F.element_at(chars, i + k) for k in range(n)]))
        return F.when(size >= n, grams).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(run, F.lit("(?s)(.)"), F.lit(1)), join)


def char_ngrams(text: Column | str, n: int) -> Column:
    """Overlapping character n-grams; texts shorter than ``n`` give none."""
    return _run_grams(_col(text), n)


def char_bigrams(text: Column | str) -> Column:
    return char_ngrams(text, 2)


def mixed_features(text: Column | str) -> Column:
    """Bigrams and trigrams of ideograph runs plus whole words of other scripts."""
    c = F.lower(_col(text))
    runs = F.regexp_extract_all(c, F.lit(f"([{CJK}]+)"), F.lit(1))
    other = F.regexp_extract_all(c, F.lit(f"([\\p{{L}}\\p{{N}}&&[^{CJK}]]+)"), F.lit(1))
    grams = F.flatten(F.transform(runs, lambda r: F.concat(_run_grams(r, 2), _run_grams(r, 3))))
    return F.concat(grams, other)


def compact(text: Column | str) -> Column:
    """Lower-cased ideographs, letters a-z and digits only."""
    return F.regexp_replace(F.lower(_col(text)), f"[^{CJK}a-z0-9]", "")


def key_terms(text: Column | str) -> Column:
    """Set of 2- to 4-grams over the compact form."""
    def grams(c):
        return F.array_distinct(F.concat(_run_grams(c, 2), _run_grams(c, 3), _run_grams(c, 4)))

    return let(compact(text), grams)


def normalize_space(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(text), "(?U)\\s+", " "))


def derive_title(text: Column | str, limit: int = 22) -> Column:
    head = F.split(_col(text), "[：；。（]", 2)[0]
    return F.when(F.char_length(head) > limit, F.concat(F.left(head, F.lit(limit)), F.lit("…"))).otherwise(head)


def fingerprint(text: Column | str) -> Column:
    """sha1 of ideographs, letters and digits; layout and punctuation do not count."""
    return F.sha1(F.regexp_replace(_col(text), f"[^{CJK}A-Za-z0-9]", ""))


def contains_any(text: Column | str, needles) -> Column:
    c = _col(text)
    test = F.lit(False)
    for needle in needles:
        test = test | F.contains(c, F.lit(needle))
    return test
