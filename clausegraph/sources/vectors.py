"""Content-addressed vector store: one vector a distinct text, computed once, in generations that are only appended to.

A text is known by its SHA-256.  ``upsert`` hands the model only texts whose digest no generation holds.  Generations
and their order are published as versions (``sources.snapshots``); ``compact`` writes them as one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.sources.snapshots import Versions


def text_digest(text: str = "text"):
    """SHA-256 of a text; null texts have none."""
    return F.unhex(F.sha2(F.col(text), 256))


class VectorStore:
    """Pinned to the version it was opened at; ``upsert`` and ``compact`` return the next one."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None) -> None:
        self.spark, self.folder = spark, folder
        self.versions = Versions(spark, folder)
        found = self.versions.read(version)
        self.version, content = found if found else (0, {"generations": []})
        self.generations: list[str] = content["generations"]

    def rows(self) -> DataFrame | None:
        """``(digest, vector, generation)``; of a digest that two writers stored at once the earlier generation counts."""
        if not self.generations:
            return None
        parts = [self.spark.read.parquet(f"{self.folder}/{g}") for g in self.generations]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def upsert(self, texts: DataFrame, model: Callable[[DataFrame], DataFrame], text: str = "text") -> VectorStore:
        """Store vectors for ``texts``.  ``model`` gets ``(digest, text)``, one row for each text without a vector, and adds ``vector``.

        What the model returned is written before it is published, so nothing is computed again for it.  If every text is
        known the model is not called and no version is published.
        """
        wanted = texts.where(F.col(text).isNotNull()).select(text_digest(text).alias("digest"), F.col(text).alias("text"))
        wanted = wanted.groupBy("digest").agg(F.first("text").alias("text"))
        held = self.rows()
        if held is not None:
            wanted = wanted.join(held.select("digest"), "digest", "left_anti")
        place = f"generations/{uuid.uuid4().hex}"
        number = len(self.generations) + 1
        # the missing texts are settled first: the model must not run for a mere count
        waiting = f"{self.folder}/waiting/{uuid.uuid4().hex}"
        wanted.write.parquet(waiting)
        missing = self.spark.read.schema(wanted.schema).parquet(waiting)
        if missing.isEmpty():
            return self
        model(missing).select("digest", "vector", F.lit(number).alias("generation")).write.parquet(f"{self.folder}/{place}")
        version = self.versions.commit(lambda last: {"generations": [*(last["generations"] if last else []), place]})
        return VectorStore(self.spark, self.folder, version)

    def lookup(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """``texts`` with ``vector`` and ``generation``; NULL for texts that are not stored."""
        held = self.rows()
        if held is None:
            raise FileNotFoundError(f"{self.folder}: no vectors stored")
        if len(self.generations) > 1:
            held = held.groupBy("digest").agg(F.min_by(F.struct("vector", "generation"), "generation").alias("v")).select("digest", "v.*")
        return texts.withColumn("_digest", text_digest(text)).join(held.withColumnRenamed("digest", "_digest"), "_digest", "left").drop("_digest")

    def compact(self) -> VectorStore:
        """All generations as one file set; generations that were added meanwhile stay after it."""
        place, merged = f"generations/{uuid.uuid4().hex}", set(self.generations)
        held = self.rows().groupBy("digest").agg(F.min_by(F.struct("vector", "generation"), "generation").alias("v")).select("digest", "v.*")
        held.write.parquet(f"{self.folder}/{place}")

        def change(last: dict | None) -> dict:
            if not merged <= set(last["generations"]):
                raise RuntimeError("the generations were merged by another writer")
            return {"generations": [place, *[g for g in last["generations"] if g not in merged]]}

        return VectorStore(self.spark, self.folder, self.versions.commit(change))
