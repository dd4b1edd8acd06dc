"""A small pack for the generated multilingual text of the driver tables.

The phrases are frequent word pieces of that text; they exercise every rule of
the operators without any domain meaning.
"""

from __future__ import annotations

from clausegraph.packs.base import Behavior, GraphPack, RiskPack, RoutePack, ScenePack

GRAPH = GraphPack(
    subjects=[("reader", ["this was", "that are", " qui "]), ("keeper", ["than the", " und "]), ("warden", ["thing", "ción y"]),
              ("unit", ["thre the"]), ("person", ["those a"])],
    behaviors=[
        Behavior("block", "violation", ["anea", "oner the"], ["thnd", "erin"], ["hath", "ea."]),
        Behavior("store", "violation", ["thtion"], ["ered", " des "], ["ble of", "que les"]),
        Behavior("train", "duty", ["ertion", "keit "], ["ing the", "lich"], ["heed", "ung"]),
        Behavior("guard", "duty", [], ["onan", "ación"], ["hat", "en la"]),
        Behavior("inspect", "government", ["attion", "eaux"], [], []),
    ],
    objects=[("route", ["erat", "aux "]), ("hydrant", ["shha", "heit"]), ("door", ["thwh", "bleou", "doa"])],
    penalties=[("fine", ["thst", "mente"]), ("detention", ["erwh"]), ("order", ["ernd the", "schaft"])],
    themes=[("egress", ["route of", "thble"], ["block", "store"]), ("staff", ["thor "], ["train", "guard"]),
            ("sanction", ["wherthou"], []), ("unused", ["zzzz"], ["absent"])],
    prohibit_words=["edthe", " not ", "nicht"], breach_words=["thed", "ein "], duty_words=["inth", "pour ", "para "],
    unit_phrases=["of the"], person_phrases=[" to ", " une "], modal_words=["by the", "with", "dans"],
    punish_words=["st the", "ment "], unit_subject="unit", person_subject="person", penalty_theme="sanction",
)

SCENE = ScenePack(
    subjects=[("reader", ["this", " qui "]), ("keeper", ["than", " und "]), ("warden", ["thing", "los"])],
    behaviors=[("block", ["anea", "eaux"]), ("store", ["thtion", "que"]), ("train", ["ertion", "keit"])],
    venues=[("tower", ["heat", "ung "]), ("hall", ["ou the", "ando"])],
    objects=[("route", ["erat", "aux"]), ("hydrant", ["shha", "heit"])],
    intents=[("penalty", ["thst", "mente", "ment"]), ("responsible", ["erwh", "der "]), ("obligation", ["inth", "pour"])],
    penalty_intent="penalty", duty_intents=("responsible", "obligation"),
    specific_channel_objects=["route"], specific_channel_words=["there", "leur"], channel_word="th",
    channel_behaviors=["block"], actor_pattern="(of|de) [a-z]{4}",
    global_markers=["that are", "en las"], list_words=["the the", "the and", "de la"], penalty_markers=["thst the", "mentou"],
    duty_markers=["erwh", "erla"], duty_word="inth", duty_suffix="duty owner", penalty_suffix="penalty fine",
    clarify={"channel_type": "Which passage is meant?", "subject": "Is it a body or a person?"},
    clarify_one="Please add: ", clarify_many="Please add two facts: ",
)

ROUTE = RoutePack(
    refuse_words=["zuver", "ciónrr"], refuse_unless="heit", off_topic=["jaos", "ouxau"], domain=["the", "des", "und", "para"],
    law_priority=["thst", "aient", "keitlich"], law_scene=["hhe", "oui"], law_scene_anchor="ea",
    strong_emergency=["thble", "eauaux"], weak_emergency=["erwh"], neutral_replace=("erwhst", "[x]"),
    alarm_words=["thou", "ent"], alarm_context=["now", "with", "der"], duty_topics=["inth", "pour"], duty_lacks=[" not ", "sans", "of"],
    immediate=["onst", "ment"], punish_words=["edst", "isch"], chat=["hi ", "es", "ie"], domain_unless="zzz", short=2,
)

RISK = RiskPack(
    high_behaviors=["block"], reasons={"block": "way out blocked", "store": "goods stored"}, venues=["tower"],
    venue_reason="crowded place", emergency_reason="possible ongoing event", penalty_reason="penalty asked without a scene",
)
