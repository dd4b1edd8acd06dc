"""Shape of a domain pack: the lexicons and word lists the operators are driven by."""

from __future__ import annotations

from dataclasses import dataclass, field

Mapping = list[tuple[str, list[str]]]


@dataclass(frozen=True)
class Behavior:
    name: str
    kind: str
    aliases: list[str]
    verbs: list[str] = field(default_factory=list)
    objects: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class GraphPack:
    """Lexicons of the knowledge graph; order is precedence."""

    subjects: Mapping
    behaviors: list[Behavior]
    objects: Mapping
    penalties: Mapping
    themes: list[tuple[str, list[str], list[str]]]  # name, aliases, behavior names
    prohibit_words: list[str]
    breach_words: list[str]
    duty_words: list[str]
    unit_phrases: list[str]
    person_phrases: list[str]
    modal_words: list[str]
    punish_words: list[str]
    unit_subject: str
    person_subject: str
    subject_type: str = "subject"
    object_type: str = "object"
    penalty_type: str = "penalty"
    theme_type: str = "theme"
    violation_kind: str = "violation"
    duty_kinds: tuple[str, ...] = ("duty", "government")
    behavior_kinds: tuple[str, ...] = ("violation", "duty", "government")
    penalty_theme: str | None = None
    prohibit: str = "prohibit"
    duty: str = "duty"
    responsibility: str = "responsibility"
    involve: str = "involve"
    punish: str = "punish"


@dataclass(frozen=True)
class RoutePack:
    refuse_words: list[str]
    refuse_unless: str
    off_topic: list[str]
    domain: list[str]
    law_priority: list[str]
    law_scene: list[str]
    law_scene_anchor: str
    strong_emergency: list[str]
    weak_emergency: list[str]
    neutral_replace: tuple[str, str]
    alarm_words: list[str]
    alarm_context: list[str]
    duty_topics: list[str]
    duty_lacks: list[str]
    immediate: list[str]
    punish_words: list[str]
    chat: list[str]
    domain_unless: str
    short: int = 2


@dataclass(frozen=True)
class ScenePack:
    subjects: Mapping
    behaviors: Mapping
    venues: Mapping
    objects: Mapping
    intents: Mapping
    penalty_intent: str
    duty_intents: tuple[str, str]  # responsible body, obligation
    specific_channel_objects: list[str]
    specific_channel_words: list[str]
    channel_word: str
    channel_behaviors: list[str]
    actor_pattern: str
    global_markers: list[str]
    list_words: list[str]
    penalty_markers: list[str]
    duty_markers: list[str]
    duty_word: str
    duty_suffix: str
    penalty_suffix: str
    clarify: dict[str, str]
    clarify_one: str
    clarify_many: str


@dataclass(frozen=True)
class RiskPack:
    high_behaviors: list[str]
    reasons: dict[str, str]
    venues: list[str]
    venue_reason: str
    emergency_reason: str
    penalty_reason: str
