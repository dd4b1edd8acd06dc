"""Protections applied to model output after JSON repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that recognise fires, actions, safety advice and refusals.
PLACEHOLDER = r"^\s*(无|未知|暂无|N/?A|不适用)\s*$"
REFUSE_MARK = r"超出.{0,12}(范围|知识库)|暂不回答|暂无.{0,4}(适用|条款)|无法回答|知识库外|非消防主题"
FIRE_WORDS = r"着火|起火|烧起来|烧着|冒烟|火势|被困|浓烟|呛|火灾现场|烧焦"
ACTION_WORDS = r"怎么办|怎么做|怎么处理|如何|能.{0,8}吗|要不要|还能|紧急|救命|逃生|下楼|撤离|跑不|快烧"
SAFE_ALARM = r"119|报警|呼救|求助"
SAFE_EVACUATE = r"疏散|撤离|逃生|远离|离开|避开|不[^，。]{0,8}(电梯|扶梯)"


def answer_record(conclusion: str, conditions: str, supplement: str) -> Column:
    return F.struct(F.lit(conclusion).alias("conclusion"), F.lit(conditions).alias("conditions"),
                    F.array().cast("array<string>").alias("basis"), F.lit(supplement).alias("supplement"), F.lit("high").alias("confidence"))


def protect(df: DataFrame, refuse: Column, emergency: Column, question: str = "question", structured: str = "structured",
            how: str = "how", provided: str = "n_provided", rejected: str | None = None) -> DataFrame:
    """Ordered protections; adds the final record and ``guards``.

    json fallback → emergency advice → no articles → canonical refusal.
    ``n_provided`` is NULL for requests without an article context.
    """
    q, s = F.coalesce(question, F.lit("")), F.col(structured)
    said = F.concat(s.conclusion, s.supplement)
    urgent = q.rlike(FIRE_WORDS) & q.rlike(ACTION_WORDS) & ~(said.rlike(SAFE_ALARM) & said.rlike(SAFE_EVACUATE))
    bare = ~urgent & F.coalesce(F.col(provided) == 0, F.lit(False))
    dropped = F.col(rejected) if rejected else F.lit(False)
    hollow = (F.size(s.basis) > 0) & F.forall(s.basis, lambda b: b.rlike(PLACEHOLDER))
    refusing = ~bare & ~dropped & ~urgent & (hollow | (s.conclusion.rlike(REFUSE_MARK) & (F.size(s.basis) == 0)))
    guards = F.filter(F.array(
        F.when(F.col(how).isin("truncation_repair", "fallback"), F.concat(F.lit("json_"), F.col(how))),
        F.when(dropped, F.lit("citation_rejected")), F.when(urgent, F.lit("emergency_guard")),
        F.when(bare, F.lit("no_articles_guard")), F.when(refusing, F.lit("refuse_guard"))), lambda g: g.isNotNull())
    final = F.when(urgent, emergency).when(bare | refusing | dropped, refuse).otherwise(s)
    return df.withColumn("guards", guards).withColumn("final", final)
