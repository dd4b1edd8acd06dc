"""Tunable parameters of the engine.

The numbers are fixed values: results only match published behaviour when the
weights, thresholds and sizes below are used.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Fusion:
    bm25: float = 0.42
    vector: float = 0.33
    graph: float = 0.25
    rrf_k: int = 60
    demotion: float = 0.62
    inject_floor: float = 0.98
    global_non_core: float = 0.55
    global_hub: float = 1.08

    def weights(self) -> dict[str, float]:
        return {"bm25": self.bm25, "vector": self.vector, "graph": self.graph}


DEGRADED_FUSION = Fusion(bm25=0.72, vector=0.10, graph=0.18)


@dataclass(frozen=True)
class Rerank:
    base: float = 0.62
    coverage: float = 0.18
    title: float = 0.20
    long_text: int = 250
    long_penalty: float = -0.05
    penalty_match: float = 0.10
    duty_mismatch: float = -0.06
    evidence: float = 0.13
    injected: float = 0.08
    learned: float = 0.10
    cross_share: float = 0.50
    cross_top: int = 6


@dataclass(frozen=True)
class Gate:
    incorrect: float = 0.12
    ambiguous: float = 0.22
    refuse_fused: float = 0.63
    refuse_cross: float = 0.60
    weak_vector: float = 0.08
    weak_coverage: float = 0.5
    weak_score: float = 0.45


@dataclass(frozen=True)
class GraphWeights:
    name_hit: float = 1.0
    alias_hit: float = 0.95
    fuzzy_hit: float = 0.7
    punish_boost: float = 1.6
    subject: float = 0.45
    theme: float = 0.9
    theme_drill: float = 0.85
    punish_hop: float = 0.8


@dataclass(frozen=True)
class Settings:
    bm25: Bm25 = field(default_factory=Bm25)
    fusion: Fusion = field(default_factory=Fusion)
    rerank: Rerank = field(default_factory=Rerank)
    gate: Gate = field(default_factory=Gate)
    graph: GraphWeights = field(default_factory=GraphWeights)
    top_k: int = 5
    specialty_discount: float = 0.72

    @property
    def pool(self) -> int:
        return max(12, 4 * self.top_k)

    @property
    def dense_pool(self) -> int:
        return max(24, 6 * self.pool)
