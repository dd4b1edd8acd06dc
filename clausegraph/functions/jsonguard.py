"""Repair of JSON in model output: a small per-text helper behind one Arrow UDF."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Defaults, confidence levels and the note of an answer record.
DEFAULTS = {"conditions": "无特殊限制", "supplement": "无", "confidence": "medium"}
LEVELS = ("high", "medium", "low")
EXCERPT = "（输出未通过 JSON 校验，已降级为原文摘录）"

_CLOSERS = {"{": "}", "[": "]"}


def _tokens(segment: str):
    """Yield ``(index, char, quoted, escaped)`` for every character."""
    quoted = escaped = False
    for i, ch in enumerate(segment):
        yield i, ch, quoted, escaped
        if escaped:
            escaped = False
        elif ch == "\\" and quoted:
            escaped = True
        elif ch == '"':
            quoted = not quoted


def close_open(segment: str) -> str:
    """Append the quotes and brackets a cut-off document still needs."""
    segment = segment.rstrip().rstrip(",")
    stack, open_string = [], False
    for _, ch, quoted, escaped in _tokens(segment):
        if escaped:
            continue
        if ch == '"':
            open_string = not quoted
        elif not quoted and ch in _CLOSERS:
            stack.append(_CLOSERS[ch])
        elif not quoted and ch in _CLOSERS.values() and stack:
            stack.pop()
    return segment + ('"' if open_string else "") + "".join(reversed(stack))


_CLOSING_QUOTE = re.compile(r'"(?=\s*(?:[,}\]:]|$))')


def escape_inner(segment: str) -> str:
    """Escape quotes inside strings: a closing quote is followed by ``, } ] :`` or the end."""
    out, pos = [], 0
    while True:
        start = segment.find('"', pos)
        if start < 0:
            return "".join([*out, segment[pos:]])
        out.append(segment[pos:start + 1])
        end = start + 1
        while True:
            match = _CLOSING_QUOTE.search(segment, end)
            if match is None:
                return "".join([*out, segment[start + 1:].replace('"', '\\"')])
            back = match.start() - 1
            slashes = 0
            while back >= start + 1 and segment[back] == "\\":
                slashes, back = slashes + 1, back - 1
            if slashes % 2 == 0:
                break
            end = match.end()
        body = re.sub(r'(?<!\\)"', '\\"', segment[start + 1:match.start()])
        out.append(body + '"')
        pos = match.end()


def _load(text: str):
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def repair(text: str | None) -> tuple[str | None, str]:
    """``(json text, how)`` with how in direct, brace_extract, quote_escape_repair, truncation_repair, fallback."""
    t = re.sub(r"\s*```$", "", re.sub(r"^```[a-zA-Z]*\s*", "", (text or "").strip())).strip()
    first, last = t.find("{"), t.rfind("}")
    attempts = [("direct", lambda: t)]
    if 0 <= first < last:
        inner = t[first:last + 1]
        attempts += [("brace_extract", lambda: inner), ("quote_escape_repair", lambda: escape_inner(inner))]
    if first >= 0:
        attempts.append(("truncation_repair", lambda: close_open(t[first:])))
    for how, make in attempts:
        value = _load(make())
        if value is not None:
            return json.dumps(value, ensure_ascii=False), how
    return None, "fallback"


@F.pandas_udf(T.StructType([T.StructField("json", T.StringType()), T.StructField("how", T.StringType())]))
def repair_json(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(t) for t in texts], columns=["json", "how"])


def normalize_fields(json_text: Column, refuse_text: str) -> Column:
    """Answer struct with defaults; unknown confidence levels become medium."""
    raw = F.from_json(json_text, "conclusion string, conditions string, basis string, supplement string, confidence string")
    items = F.from_json(raw.basis, "array<string>")
    basis = F.when(raw.basis.isNull(), F.array().cast("array<string>")).when(items.isNotNull(), items).otherwise(F.array(raw.basis))
    basis = F.filter(F.transform(basis, lambda b: F.trim(b)), lambda b: b != "")

    def text(c, default):
        return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(default)).otherwise(F.trim(c))

    level = F.lower(F.trim(F.coalesce(raw.confidence, F.lit(""))))
    return F.struct(
        text(raw.conclusion, refuse_text).alias("conclusion"), text(raw.conditions, DEFAULTS["conditions"]).alias("conditions"),
        basis.alias("basis"), text(raw.supplement, DEFAULTS["supplement"]).alias("supplement"),
        F.when(level.isin(*LEVELS), level).otherwise(F.lit(DEFAULTS["confidence"])).alias("confidence"))


def with_repaired(df: DataFrame, text: str, refuse_text: str) -> DataFrame:
    """Adds ``how`` and the normalised ``structured`` record; unrepairable text becomes a low-confidence excerpt."""
    out = df.withColumn("_r", repair_json(F.col(text)))
    low = F.to_json(F.struct(F.left(F.trim(text), F.lit(200)).alias("conclusion"), F.lit(EXCERPT).alias("supplement"), F.lit("low").alias("confidence")))
    return out.withColumn("how", F.col("_r.how")).withColumn(
        "structured", normalize_fields(F.coalesce(F.col("_r.json"), low), refuse_text)).drop("_r")
