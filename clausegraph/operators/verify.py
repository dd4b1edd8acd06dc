"""Checks of an answer against the texts it cites.

Rows carry ``answer, question, ref_texts: array<string>, ref_items: array<string>``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.functions.numerals import durations, fine_ranges, numeral_value

# Word lists and patterns of the checks.
LAW_LIKE = ["消防", "法规", "规定", "条款", "处罚", "罚款", "责令"]
PENALTY_INTENT = ["罚", "拘留", "处罚", "处罚款", "责令", "后果", "责任"]
PENALTY_TEXT = ["罚款", "拘留", "责令改正", "责令停产停业", "处罚", "警告"]
UNIT_PENALTY = "对单位|单位处|单位.{0,6}(?:罚款|处罚)"
PERSON_PENALTY = "对个人|个人处|个人.{0,6}(?:罚款|处罚)"
UNIT_WORD, PERSON_WORD, HIGH_RISE = "单位", "个人", "高层"
NUMBER = "\\d+(?:\\.\\d+)?"


def cited_articles(answers: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(answer_id, item_id)``: number and law alias on the same line of the answer.

    ``known(item_id, law, num)``, ``aliases(law, alias)``.  The number must not
    continue with a further numeral, so 第六条 does not match 第六十条; numbers like
    3.1 or 3.1.2 count too, and 3.1 does not match 3.10 or 3.1.2.
    """
    lines = answers.select("answer_id", F.explode(F.split("answer", "\\n")).alias("line")).withColumn(
        "line", F.replace("line", F.lit(" "), F.lit(""))).where(tx.contains_any("line", ["《", "条"]) | F.col("line").rlike(r"\d\.\d"))
    pattern = "(第[一二三四五六七八九十百零\\d]+条(?:之[一二三四五六七八九十])?|(?<![\\d.])\\d+(?:\\.\\d+){1,2}(?!\\.?\\d))"
    numbered = lines.select("answer_id", "line", F.explode(F.array_distinct(
        F.regexp_extract_all("line", F.lit(pattern), F.lit(1)))).alias("num"))
    keyed = numbered.join(known.select("item_id", "law", "num"), "num")
    named = keyed.join(aliases.withColumn("alias", F.replace("alias", F.lit(" "), F.lit(""))), "law")
    return named.where(F.contains("line", F.col("alias"))).select("answer_id", "item_id").distinct()


def fine_check(answer: Column, reference: Column, floor: int = 10000, tolerance: int = 1) -> Column:
    """True unless a range reaching ``floor`` has no counterpart within the tolerance."""
    refs = fine_ranges(reference)
    big = F.filter(fine_ranges(answer), lambda r: r.high >= floor)
    return F.forall(big, lambda r: F.exists(refs, lambda t: (F.abs(t.low - r.low) <= tolerance) & (F.abs(t.high - r.high) <= tolerance)))


def duration_check(answer: Column, reference: Column, question: Column) -> Column:
    allowed = F.concat(durations(reference), durations(question))
    return F.size(F.array_except(durations(answer), allowed)) == 0


def verify(df: DataFrame, cited: str = "cited", mentioned: str = "mentioned", high_rise_prefix: str = "高层规定·",
           high_rise_scene: Column | None = None) -> DataFrame:
    """Adds one boolean per check, ``issues`` and ``passed``.

    ``cited`` are cited items among the references, ``mentioned`` those among all
    known items.
    """
    answer, question = F.coalesce("answer", F.lit("")), F.coalesce("question", F.lit(""))
    refs = F.coalesce("ref_texts", F.array().cast("array<string>"))
    ref_text = F.array_join(refs, " ")

    def some(pattern_words):
        return F.exists(refs, lambda t: tx.contains_any(t, pattern_words))

    unit, person = answer.rlike(UNIT_PENALTY), answer.rlike(PERSON_PENALTY)
    refs_unit, refs_person = some([UNIT_WORD]), some([PERSON_WORD])
    penal_answer = tx.contains_any(answer, PENALTY_TEXT)
    tall = F.contains(question, F.lit(HIGH_RISE)) | (high_rise_scene if high_rise_scene is not None else F.lit(False))
    only_tall = (F.size("ref_items") > 0) & F.forall("ref_items", lambda a: a.startswith(high_rise_prefix))
    checks = {
        "citation_present": ~((F.size("ref_items") > 0) & (F.size(cited) == 0) & tx.contains_any(question, LAW_LIKE)),
        "citation_real": F.size(F.array_except(mentioned, "ref_items")) == 0,
        "fine_ok": fine_check(answer, ref_text),
        "duration_ok": duration_check(answer, ref_text, question),
        "subject_ok": ~((unit & ~person & refs_person & ~refs_unit) | (person & ~unit & refs_unit & ~refs_person)),
        "building_ok": ~(~tall & penal_answer & only_tall),
        "penalty_ok": ~(tx.contains_any(question, PENALTY_INTENT) & penal_answer & ~some(PENALTY_TEXT)),
    }
    out = df.withColumns(checks)
    issues = F.filter(F.array(*[F.when(~F.col(name), F.lit(name)) for name in checks]), lambda i: i.isNotNull())
    return out.withColumn("issues", issues).withColumn("passed", F.size("issues") == 0)


def article_number(text: Column) -> Column:
    """Numeric article number of 第十条, 第10条 or 》28."""
    named = F.regexp_extract(text, "第\\s*([一二三四五六七八九十零两\\d]+)\\s*条", 1)
    bare = F.regexp_extract(text, "》\\s*(\\d+)", 1)
    return F.coalesce(F.when(named != "", numeral_value(named)), F.when(bare != "", bare.try_cast("bigint")))


def canonical_citation(law_name: Column, num: Column, text: Column) -> Column:
    """《law》number：first 120 characters."""
    snippet = F.concat(F.rtrim(F.left(text, F.lit(120)), F.lit("。")), F.lit("。"))
    return F.concat(F.lit("《"), law_name, F.lit("》"), num, F.lit("："), snippet)


def validate_citations(basis: DataFrame, provided: DataFrame) -> DataFrame:
    """Basis entries that match a provided article by law and number, rewritten canonically.

    ``basis(answer_id, pos, entry)``, ``provided(answer_id, law_name, law, num, text)``.
    Adds ``valid`` and ``citation``.
    """
    left = basis.withColumn("n", article_number(F.col("entry")))
    right = provided.select("answer_id", article_number(F.col("num")).alias("n"), "law_name", "law",
                            canonical_citation(F.col("law_name"), F.col("num"), F.col("text")).alias("citation"))
    pairs = left.join(right, ["answer_id", "n"], "left")
    named = F.contains("entry", F.col("law_name")) | F.contains("entry", F.col("law")) | ~F.contains("entry", F.lit("《"))
    hit = F.when(F.coalesce(named, F.lit(False)), F.col("citation"))
    return pairs.groupBy("answer_id", "pos", "entry").agg(F.max(hit).alias("citation")).withColumn(
        "valid", F.col("citation").isNotNull())


def unsupported_numbers(conclusion: Column, question: Column, cited_text: Column) -> Column:
    """Numbers of a conclusion found neither in the question nor in the cited text."""
    pattern = F.lit(f"({NUMBER})")
    said, asked = F.regexp_extract_all(conclusion, pattern, F.lit(1)), F.regexp_extract_all(question, pattern, F.lit(1))
    stray = F.array_except(said, asked)
    return F.when(cited_text != "", F.filter(stray, lambda n: ~F.contains(cited_text, n))).otherwise(F.array().cast("array<string>"))


#: Runs of ideographs, or of letters, that count as a term of a question.
TERM = "[\u4e00-\u9fa5]{2,}|[A-Za-zÀ-ÿ]{4,}"


def zero_overlap(question: Column, cited_text: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """True where a cited text holds none of the terms of the question; a weak sign that it does not support the answer."""
    terms = F.regexp_extract_all(question, F.lit(f"({TERM})"), F.lit(1))
    if stopwords:
        terms = F.array_except(terms, F.array(*[F.lit(w) for w in stopwords]))
    return (cited_text != "") & (F.size(terms) > 0) & ~F.exists(terms, lambda t: F.contains(cited_text, t))


def unsupported_marks(conclusion: Column, question: Column, cited_text: Column, guards: Column, stopwords: tuple[str, ...] = ()) -> Column:
    """Signs that an answer whose citations match is still not supported by them: citation guards, stray numbers, no common term."""
    interfered = F.filter(guards, lambda g: F.startswith(g, F.lit("citation_")))
    stray = unsupported_numbers(conclusion, question, cited_text)
    return F.filter(F.array(
        F.when(F.size(interfered) > 0, F.concat(F.lit("guard:"), F.array_join(interfered, "/"))),
        F.when(F.size(stray) > 0, F.concat(F.lit("numbers:"), F.array_join(F.slice(F.array_sort(stray), 1, 5), "/"))),
        F.when(zero_overlap(question, cited_text, stopwords), F.lit("no common term"))), lambda m: m.isNotNull())


def unsupported_sentences(answers: DataFrame, evidence: DataFrame, sentences: Callable[[Column], Column], share: float = 0.5) -> DataFrame:
    """``(answer_id, pos, sentence)`` of answer sentences of which less than ``share`` of the terms stand in any evidence text.

    ``answers(answer_id, text)`` and ``evidence(answer_id, item_id, text)``.  A sentence meets an evidence text only through a
    common term of the same answer, so no sentence is paired with texts it shares nothing with.
    """
    def terms(text: Column) -> Column:
        return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1)))

    parts = answers.select("answer_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).withColumn("terms", terms(F.col("sentence")))
    parts = parts.where(F.size("terms") > 0)
    said = parts.select("answer_id", "pos", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    held = evidence.select("answer_id", "item_id", F.explode(terms(F.col("text"))).alias("term"))
    common = said.join(held, ["answer_id", "term"]).groupBy("answer_id", "pos", "n", "item_id").agg(F.count(F.lit(1)).alias("m"))
    backed = common.where(F.col("m") >= share * F.col("n")).select("answer_id", "pos").distinct()
    return parts.join(backed, ["answer_id", "pos"], "left_anti").select("answer_id", "pos", "sentence")
