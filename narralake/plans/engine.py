"""The engine: templates and rules by name, over one story of one owner; checks, caches and gated SQL."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from inspect import signature
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from narralake.operators import consistency, network, templates, temporal
from narralake.plans.adapter import Story
from narralake.plans.checks import parameter_errors
from narralake.plans.guard import guarded

Builder = Callable[..., DataFrame]
TEMPLATES: dict[str, Builder] = {
    "character_knowledge_at_time": templates.character_knowledge_at_time,
    "characters_in_scene": templates.characters_in_scene,
    "scene_location_details": templates.scene_location_details,
    "character_relationships_detailed": templates.character_relationships_detailed,
    "knowledge_by_type": templates.knowledge_by_type,
    "secret_knowledge": templates.secret_knowledge,
    "temporal_knowledge_conflicts": templates.temporal_knowledge_conflicts,
    "relationship_milestones_over_time": templates.relationship_milestones,
    "plot_thread_resolution_status": templates.plot_thread_resolution_status,
    "story_timeline_detailed": templates.story_timeline_detailed,
    "knowledge_propagation": templates.knowledge_propagation,
    "contradictions_by_severity": templates.contradictions_by_severity,
    "character_activity_timeline": templates.character_activity_timeline,
    "location_accessibility": templates.location_accessibility,
    "relationship_strength_analysis": templates.relationship_strength_analysis,
    "character_trust_network": templates.character_trust_network,
    "knowledge_sharing_patterns": templates.knowledge_sharing_patterns,
    "scene_participation_analysis": templates.scene_participation_analysis,
    "all_relationship_pairs": templates.all_relationship_pairs,
    "ownership_history": templates.ownership_history,
    "current_owner": templates.current_owner,
    "item_transfer_chain": templates.item_transfer_chain,
    "plot_holes": consistency.plot_holes,
    "coherence_score": consistency.coherence_score,
    "network_full": network.network_full,
    "network_ego": network.network_ego,
    "relationship_evolution": temporal.evolution_delta,
}


def query_hash(query: str, params: dict[str, Any]) -> str:
    return hashlib.md5(f"{query}:{json.dumps(params, sort_keys=True, default=str)}".encode()).hexdigest()


class QueryCache:
    """Results by query and parameters: `most` of them, and when one more comes, the oldest `drop` go."""

    def __init__(self, most: int = 100, drop: int = 20):
        self.most, self.drop, self.held = most, drop, {}

    def get(self, query: str, params: dict[str, Any], build: Callable[[], Any]) -> Any:
        key = f"{query}/{query_hash(query, params)}"
        if key not in self.held:
            self.held[key] = build()
            if len(self.held) > self.most:
                for old in list(self.held)[: self.drop]:
                    del self.held[old]
        return self.held[key]

    def forget(self, query: str) -> None:
        self.held = {k: v for k, v in self.held.items() if not k.startswith(f"{query}/")}


class TimedCache:
    """Results that are computed anew when they are older than `seconds`."""

    def __init__(self, seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.seconds, self.clock, self.held = seconds, clock, {}

    def get(self, key: Any, build: Callable[[], Any]) -> Any:
        now = self.clock()
        if key not in self.held or now - self.held[key][0] >= self.seconds:
            self.held[key] = now, build()
        return self.held[key][1]


class Engine:
    """Every query names a story and its owner and reaches nothing else."""

    def __init__(self, spark: SparkSession, sf_dir: str, allow_sql: bool = False):
        self.story, self.spark, self.allow_sql = Story(spark, sf_dir), spark, allow_sql
        self.templates, self.rules, self.cache = dict(TEMPLATES), dict(consistency.RULES), QueryCache()

    def add_template(self, name: str, builder: Builder) -> None:
        """A template under a name, in place of the one before, whose results are forgotten."""
        self.templates[name] = builder
        self.cache.forget(name)

    def add_rule(self, name: str, builder: Callable[[Story], DataFrame]) -> None:
        self.rules[name] = builder

    def template(self, name: str, **params: Any) -> DataFrame:
        """A template's rows; parameters that it doesn't know, lacks, or that break the schema are a ValueError."""
        if name not in self.templates:
            raise ValueError(f"Unknown template: {name}")
        errors = parameter_errors({k: v for k, v in params.items() if v is not None})
        own = {k: v for k, v in params.items() if k not in ("story_id", "user_id")}
        known = list(signature(self.templates[name]).parameters.values())[1:]
        errors += [f"Unknown parameter: {k}" for k in own if k not in {p.name for p in known}]
        errors += [f"Missing required parameter: {p.name}" for p in known if p.default is p.empty and p.name not in own]
        if errors:
            raise ValueError("; ".join(errors))
        return self.cache.get(name, params, lambda: self.templates[name](self.story.scoped(params["story_id"], params["user_id"]), **own))

    def scan(self, story_id: int, user_id: str) -> DataFrame:
        """All rules' findings in a story."""
        scope, found = self.story.scoped(story_id, user_id), None
        for rule in self.rules.values():
            found = rule(scope) if found is None else found.unionAll(rule(scope))
        return found

    def sql(self, text: str, story_id: int, user_id: str, **args: Any) -> DataFrame:
        """A query over the scope's tables, named as {name}, and nothing else (see plans.guard); off unless the engine was
        made with allow_sql."""
        if not self.allow_sql:
            raise PermissionError("free SQL is not allowed; make the engine with allow_sql=True")
        return guarded(self.story.scoped(story_id, user_id), text, args)

    def summary(self, story_id: int, user_id: str) -> DataFrame:
        """What is said of a story without a language model: its numbers of entities and relationships."""
        from pyspark.sql import functions as F

        scope, one = self.story.scoped(story_id, user_id), F.lit(1).alias("k")
        entities = scope["characters"].agg(F.count("*").alias("entity_count")).select("*", one)
        return entities.join(scope["relationships"].agg(F.count("*").alias("relationship_count")).select("*", one), "k").select("entity_count", "relationship_count", F.lit("basic_analysis").alias("model_used"))
