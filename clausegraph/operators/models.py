"""Learned classifiers on Spark ML: character n-gram TF-IDF with balanced logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions import text as tx
from clausegraph.operators.scale import lookup_join, with_scalars
from clausegraph.session import cut_table

#: Cells of the hashed gram counts.
FEATURES = 1 << 15


def char_grams(text: Column | str) -> Column:
    """2- to 4-grams inside blank-separated words, each padded with one blank."""
    words = F.filter(F.split(F.lower(text), "(?U)\\s+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.concat(*[tx.char_ngrams(w, n) for n in (2, 3, 4)])))


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight = rows / (classes · rows of the class)``; the class table is small."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    totals = sizes.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    weights = with_scalars(sizes, totals).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return lookup_join(df, weights, label)


def gram_counts(rows: DataFrame, text: str, features: int = FEATURES) -> DataFrame:
    """``rows`` without ``text``, with its hashed gram counts ``tf``, as a stored table: grams are made once for all that read it."""
    counts = _hashing(features).transform(rows.withColumn("grams", char_grams(text)))
    return cut_table(counts.drop("grams", text))


def _hashing(features: int) -> HashingTF:
    return HashingTF(inputCol="grams", outputCol="tf", numFeatures=features)


def train_text_classifier(rows: DataFrame, text: str, label: str, features: int = FEATURES, c: float = 2.0,
                          max_iter: int = 20) -> PipelineModel:
    """``regParam`` is ``1 / (C · rows)``, the scaling of an unaveraged loss.  ``rows`` of ``gram_counts`` are read as they are."""
    if "tf" not in rows.columns:
        rows = gram_counts(rows.select(text, label), text, features)
    data = balanced(rows.where(F.col(label).isNotNull()).select("tf", label), label)
    data = data.withColumn("_label", F.col(label).cast("string"))
    total = max(1, rows.count())
    stages = [
        StringIndexer(inputCol="_label", outputCol="label_index", stringOrderType="alphabetAsc"),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(featuresCol="features", labelCol="label_index", weightCol="weight", maxIter=max_iter,
                           regParam=1.0 / (c * total)),
    ]
    indexer, *learned = Pipeline(stages=stages).fit(data).stages
    return PipelineModel(stages=[indexer, _hashing(features), *learned])


def predict(model: PipelineModel, rows: DataFrame, text: str, prefix: str = "ml_") -> DataFrame:
    """Adds ``<prefix>intent`` and ``<prefix>confidence``; ``rows`` of ``gram_counts`` give up their ``tf``."""
    labels = model.stages[0].labels
    if "tf" in rows.columns:  # of ``gram_counts``
        scored = PipelineModel(stages=model.stages[2:]).transform(rows)
    else:
        scored = PipelineModel(stages=model.stages[1:]).transform(rows.withColumn("grams", char_grams(text)))
    probabilities = vector_to_array("probability")
    name = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("prediction").cast("int") + 1)
    return scored.withColumn(f"{prefix}intent", name).withColumn(f"{prefix}confidence", F.array_max(probabilities)).drop(
        "grams", "tf", "features", "rawPrediction", "probability", "prediction")


def pair_text(question: Column | str, text: Column | str) -> Column:
    return F.concat_ws("‖", question, text)
