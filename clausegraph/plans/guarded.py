"""Model answers behind the output guards: repair, citation check, one retry, rejection, protections.

A loop over a shrinking frame.  Every attempt is checkpointed under its number before it is looked at, so a lost
executor recomputes checks but never calls the model again for an attempt that was written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions import jsonguard
from clausegraph.operators import guards, verify
from clausegraph.session import cut_lineage

# What is added to a prompt whose answer cited nothing that was provided.
RETRY_SUFFIX = ("\n\n注意：上一次回答的 basis 引用未通过核验。basis 只能引用上述给定条款，"
                "格式为《法规名》第X条：原文摘录；不得引用未提供的法规、不得编造条款号。"
                "若给定条款确实不适用，则输出 basis 为空数组并说明无法依据给定条款回答。")
Model = Callable[[DataFrame], DataFrame]


def _refuses(structured: Column) -> Column:
    return structured["conclusion"].rlike(guards.REFUSE_MARK) & (F.size(structured["basis"]) == 0)


def _attempt(rows: DataFrame, prompt: Column, number: int, model: Model, refuse_text: str) -> DataFrame:
    """``(answer_id, how, structured)`` of one attempt; the replies are written before they are read."""
    asked = rows.select("answer_id", prompt.alias("prompt"), F.lit(number).alias("attempt"))
    replies = cut_lineage(model(asked).select("answer_id", "reply"))
    return jsonguard.with_repaired(replies, "reply", refuse_text).select("answer_id", "how", "structured")


def checked_citations(answers: DataFrame, provided: DataFrame) -> DataFrame:
    """``answers`` with ``kept``, the basis entries that name a provided article, rewritten, and ``n_dropped``."""
    entries = answers.select("answer_id", F.posexplode("structured.basis").alias("pos", "entry"))
    judged = verify.validate_citations(entries, provided)
    lists = judged.groupBy("answer_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("valid"), F.struct("pos", "citation")))).alias("kept"),
        F.count(F.when(~F.col("valid"), 1)).alias("n_dropped"))
    none = F.array().cast("array<string>")
    return answers.join(lists, "answer_id", "left").withColumns({
        "kept": F.coalesce(F.transform("kept", lambda k: k.citation), none), "n_dropped": F.coalesce("n_dropped", F.lit(0))})


def guarded_answers(requests: DataFrame, provided: DataFrame, model: Model, refuse: Column, emergency: Column, refuse_text: str,
                    retry_suffix: str = RETRY_SUFFIX) -> DataFrame:
    """``(answer_id, final, guards, attempts)`` for ``requests(answer_id, question, prompt, n_provided)``.

    ``provided(answer_id, law_name, law, num, text)`` are the articles of a prompt, ``n_provided`` their number, NULL for
    a request without an article context.  ``model`` gets ``(answer_id, prompt, attempt)`` and adds ``reply``.
    Answers whose citations are all foreign are asked once more with ``retry_suffix``; those that fail again are
    rejected.  Emergencies and refusals are not asked again.
    """
    base = requests.select("answer_id", "question", "prompt", "n_provided")
    first = _attempt(base, F.col("prompt"), 1, model, refuse_text)
    q = F.coalesce("question", F.lit(""))
    urgent = q.rlike(guards.FIRE_WORDS) & q.rlike(guards.ACTION_WORDS)
    asked = (F.coalesce("n_provided", F.lit(0)) > 0) & (F.col("how") != "fallback") & ~urgent & ~_refuses(F.col("structured"))
    one = cut_lineage(checked_citations(base.join(first, "answer_id"), provided).withColumn("cites", asked))
    good = F.col("cites") & (F.size("kept") > 0)
    again = one.where(F.col("cites") & (F.size("kept") == 0)).select("answer_id", "prompt")
    second = _attempt(again, F.concat("prompt", F.lit(retry_suffix)), 2, model, refuse_text)
    two = checked_citations(second, provided).select(
        "answer_id", F.col("how").alias("how2"), F.col("structured").alias("structured2"), F.col("kept").alias("kept2"))
    both = one.join(two, "answer_id", "left")
    tried = F.col("how2").isNotNull()
    lost = tried & ((F.col("how2") == "fallback") | (~_refuses(F.col("structured2")) & (F.size("kept2") == 0)))

    def cited(record: Column, basis: Column) -> Column:
        return F.struct(record["conclusion"].alias("conclusion"), record["conditions"].alias("conditions"), basis.alias("basis"),
                        record["supplement"].alias("supplement"), record["confidence"].alias("confidence"))

    def json_mark(how: str) -> Column:
        return F.when(F.col(how).isin("truncation_repair", "fallback"), F.concat(F.lit("json_"), F.col(how)))

    chosen = (F.when(lost, F.col("structured2")).when(tried & (F.size("kept2") > 0), cited(F.col("structured2"), F.col("kept2")))
              .when(tried, F.col("structured2")).when(good, cited(F.col("structured"), F.col("kept"))).otherwise(F.col("structured")))
    marks = F.filter(F.array(
        json_mark("how"), F.when(good & (F.col("n_dropped") > 0), F.lit("citation_guard")), F.when(tried, F.lit("citation_retry")), json_mark("how2")),
        lambda m: m.isNotNull())
    rows = both.select("answer_id", "question", "n_provided", F.lit("direct").alias("how"), chosen.alias("structured"), lost.alias("lost"),
                       marks.alias("marks"), F.when(tried, 2).otherwise(1).alias("attempts"))
    out = guards.protect(rows, refuse, emergency, rejected="lost")
    return out.select("answer_id", "final", F.concat("marks", "guards").alias("guards"), "attempts")
