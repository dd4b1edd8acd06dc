"""Packs from lexicon tables: lexicons are data that users keep next to their corpus."""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.packs.base import Behavior, GraphPack, ScenePack

LEXICON_SCHEMA = "dimension string, prio int, name string, kind string, role string, phrase string"
MAX_PHRASES = 200_000


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines lexicon.  ``role`` is alias, verb, object or member; ``prio`` is the precedence of the name."""
    return spark.read.schema(LEXICON_SCHEMA).json(path)


def _rows(lexicon: DataFrame) -> list:
    rows = lexicon.orderBy("dimension", "prio", "role", F.col("phrase")).limit(MAX_PHRASES + 1).collect()
    if len(rows) > MAX_PHRASES:
        raise ValueError("lexicon too large for a pack; use contains_join on the table instead")
    return rows


def _mapping(rows: list, dimension: str) -> list[tuple[str, list[str]]]:
    names: dict[str, list[str]] = {}
    for r in sorted((r for r in rows if r["dimension"] == dimension), key=lambda r: r["prio"]):
        names.setdefault(r["name"], [])
        if r["phrase"]:
            names[r["name"]].append(r["phrase"])
    return list(names.items())


def graph_pack(lexicon: DataFrame, **words) -> GraphPack:
    """``dimension`` is subject, behavior, object, penalty or theme; ``words`` are the remaining lists."""
    rows = _rows(lexicon)
    behaviors: dict[str, Behavior] = {}
    for r in sorted((r for r in rows if r["dimension"] == "behavior"), key=lambda r: r["prio"]):
        b = behaviors.setdefault(r["name"], Behavior(r["name"], r["kind"], []))
        {"alias": b.aliases, "verb": b.verbs, "object": b.objects}[r["role"]].append(r["phrase"])
    themes: dict[str, tuple[str, list[str], list[str]]] = {}
    for r in sorted((r for r in rows if r["dimension"] == "theme"), key=lambda r: r["prio"]):
        theme = themes.setdefault(r["name"], (r["name"], [], []))
        theme[2 if r["role"] == "member" else 1].append(r["phrase"])
    return GraphPack(subjects=_mapping(rows, "subject"), behaviors=list(behaviors.values()), objects=_mapping(rows, "object"),
                     penalties=_mapping(rows, "penalty"), themes=list(themes.values()), **words)


def scene_pack(lexicon: DataFrame, **words) -> ScenePack:
    """``dimension`` is subjects, behaviors, venues, objects or intents."""
    rows = _rows(lexicon)
    maps = {f.name: _mapping(rows, f.name) for f in fields(ScenePack) if f.name in ("subjects", "behaviors", "venues", "objects", "intents")}
    return ScenePack(**maps, **words)
