"""The engine's scope, checks, caches, session log and jobs."""

from __future__ import annotations

import datetime
import json
import time

import pytest
from pyspark.sql import functions as F

from narralake.plans import checks
from narralake.plans.engine import TEMPLATES, Engine, QueryCache, TimedCache, query_hash
from narralake.sources import episodes
from narralake.streaming import alerts, jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return Engine(spark, SF, allow_sql=True)


@pytest.fixture(scope="module")
def scope(engine):
    one = engine.story["characters"].orderBy("character_id").first()
    return {"story_id": one.story_id, "user_id": one.user_id}


PARAMETERS = {"character_knowledge_at_time": {"day": 19980615}, "relationship_milestones_over_time": {"start": 1, "end": 20}, "character_trust_network": {"min_trust_level": 1}, "network_ego": {"character_id": 0}}


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_templates_reach_one_owner_only(engine, scope, name):
    names = {r.name for r in engine.story["characters"].filter((F.col("story_id") == scope["story_id"]) & (F.col("user_id") == scope["user_id"])).collect()}
    ids = {r.character_id for r in engine.story["characters"].collect() if r.name in names}
    rows = engine.template(name, **scope, **PARAMETERS.get(name, {}))
    for column, allowed in {"name_1": names, "name_2": names, "owner": names, "previous_owner": names, "character_a": names, "character_id": ids, "character_1": ids, "character_2": ids, "src": ids, "dst": ids, "story_id": {scope["story_id"]}}.items():
        if column in rows.columns:
            assert {r[0] for r in rows.select(column).distinct().collect()} - {None} <= allowed
    other = engine.template(name, **{**scope, "user_id": "NOBODY"}, **PARAMETERS.get(name, {}))
    assert other.count() == 0


def test_templates_check_their_parameters(engine, scope):
    for params, message in (({}, "Missing required parameter: story_id; Missing required parameter: user_id"), ({**scope, "x": 1}, "Unknown parameter: x"), ({**scope, "day": 1, "character_name": "Nobody"}, None)):
        if message:
            with pytest.raises(ValueError, match=message):
                engine.template("secret_knowledge", **params)
        else:
            assert engine.template("character_knowledge_at_time", **params).count() == 0
    with pytest.raises(ValueError, match="Missing required parameter: day"):
        engine.template("character_knowledge_at_time", **scope)
    with pytest.raises(ValueError, match="Unknown template"):
        engine.template("nothing", **scope)
    with pytest.raises(ValueError, match="Parameter 'severity'"):
        engine.template("contradictions_by_severity", **scope, severity="Major")
    assert engine.template("secret_knowledge", **scope) is engine.template("secret_knowledge", **scope)


def test_free_sql_is_gated_and_scoped(engine, scope, spark):
    with pytest.raises(PermissionError):
        Engine(spark, SF).sql("SELECT 1", **scope)
    with pytest.raises(ValueError, match="Empty"):
        engine.sql("  ", **scope)
    assert engine.sql("SELECT count(DISTINCT story_id) AS n FROM {known} WHERE story_id >= :least", **scope, least=0).first().n == 1
    assert engine.summary(**scope).first().model_used == "basic_analysis"
    assert engine.scan(**scope).columns == ["rule", "character_id", "from_id", "to_id", "severity", "reason", "confidence"]


@pytest.mark.parametrize(
    ("query", "error"),
    [
        ("MATCH (c:Character {story_id: $story_id}) RETURN c", ""),
        ("MATCH (k {story_id: $story_id}) WHERE k.valid_from <= $t AND (k.valid_to IS NULL OR k.valid_to >= $t) RETURN k ORDER BY k.created_at", ""),
        ("MATCH (c {story_id: $story_id}) DELETE c", "Dangerous operation 'DELETE'"),
        ("MATCH (c) RETURN c", "story_id filter"),
        ("MATCH (c {story_id: $story_id} RETURN c", "Invalid Cypher syntax"),
        ("MATCH (k {story_id: $story_id}) RETURN k.valid_to", "temporal query pattern"),
        ("MATCH (k {story_id: $story_id}) WHERE k.severity = 'Major' RETURN k", "Enum value 'Major' has incorrect case"),
    ],
)
def test_query_checks(query, error):
    assert error in checks.query_error(query) and (error == "") == (checks.query_error(query) == "")


def test_strict_check_and_suggestions():
    query = "MATCH (k {story_id: $story_id}) RETURN k.created_at"
    assert checks.query_error(query) == "" and "CREATE" in checks.query_error(query, strict_substring=True)
    assert checks.suggestions("MATCH (c:Character)-[:KNOWS]->(k) RETURN k ORDER BY k.valid_from") == ["Consider using 'character_knowledge_at_time' template for character knowledge queries", "Add story_id filter for better performance and data isolation", "Add user_id filter for proper data isolation", "Consider adding appropriate indexes for ORDER BY clauses", "Use temporal indexes for better performance on temporal queries"]
    assert checks.parameter_errors({"story_id": 1, "user_id": 2, "trust_level": 11, "severity": "minor"}) == ["trust_level must be an integer between 1 and 10"]
    assert checks.enum_error("nothing", 1) and not checks.enum_error("severity", "major")


def test_caches():
    cache, built = QueryCache(), []
    for i in range(101):
        cache.get("q", {"i": i}, lambda: built.append(1))
    assert len(cache.held) == 81 and len(built) == 101
    cache.get("q", {"i": 100}, lambda: built.append(1))
    cache.get("q", {"i": 0}, lambda: built.append(1))
    assert len(built) == 102
    now = [0.0]
    timed = TimedCache(3600, lambda: now[0])
    assert timed.get("a", lambda: 1) == 1 and timed.get("a", lambda: 2) == 1
    now[0] = 3600
    assert timed.get("a", lambda: 2) == 2
    assert query_hash("q", {"b": 1, "a": 2}) == query_hash("q", {"a": 2, "b": 1})


def test_sessions_and_episodes(spark, tmp_path):
    log, registry = str(tmp_path / "episodes"), str(tmp_path / "sessions")
    group = episodes.open_session(spark, registry, "s1", "2024-01-01 00:00:00", "u")
    episodes.open_session(spark, registry, "s2", "2024-01-01 00:00:00")
    assert group.startswith("session_s1_") and len(group.rsplit("_", 1)[1]) == 8
    rows = spark.createDataFrame([(group, f"body {i}", None, datetime.datetime(2024, 1, 1 + i)) for i in range(5)], "group_id string, fact string, uuid string, reference_time timestamp_ntz")
    episodes.append_episodes(rows, log)
    episodes.append_episodes(rows.limit(1).select("group_id", "reference_time", F.lit("own").alias("id"), F.lit("x").alias("episode_body")), log)
    got = episodes.read_episodes(spark, log, group, "2024-01-04 00:00:00", 2).collect()
    assert {r.body for r in got} == {"body 2", "body 3"} and spark.read.parquet(log).filter("uuid = 'own' AND body = 'x'").count() == 1
    episodes.delete_story(spark, registry, "s1", "2024-02-01 00:00:00")
    assert [r.story_id for r in episodes.sessions(spark, registry).collect()] == ["s2"] and episodes.read_episodes(spark, log).count() == 6
    episodes.open_session(spark, registry, "s1", "2024-03-01 00:00:00", "u")
    assert episodes.sessions(spark, registry).count() == 2


def test_jobs():
    at = datetime.datetime(2024, 1, 1, 1, 30, 5)
    due = {name: jobs.next_run(when, at) for name, when in jobs.SCHEDULE.items()}
    assert due["temporal-contradiction-detection"] == at + datetime.timedelta(seconds=30)
    assert due["cleanup-old-contradictions"] == datetime.datetime(2024, 1, 1, 6) and due["nightly-continuity-validation"] == datetime.datetime(2024, 1, 1, 2, 30)
    assert jobs.next_run((1, 0), at) == datetime.datetime(2024, 1, 2, 1) and jobs.retry_delay(30) == 2 and jobs.retry_delay(7200) == 300
    calls = []

    def work():
        calls.append(1)
        if len(calls) == 1:
            raise ValueError("first")

    job = jobs.Job(work, 1)
    assert job.start() and not job.start()
    deadline = time.time() + 20
    while job.runs < 1 and time.time() < deadline:
        time.sleep(0.05)
    job.stop()
    assert job.failures == 1 and job.runs >= 1 and job.last_error == "first" and not job.status()["is_running"]


def test_published_alerts(spark):
    rows = spark.createDataFrame([(1, "u", datetime.datetime(2024, 1, 1), "Minor issue")], "event_id long, user_id string, ts timestamp, reason string")
    sent = json.loads(alerts.publish(rows).first().value)
    assert sent["alert_type"] == "contradiction_detected" and sent["timestamp"].startswith("2024-01-01")
    row = alerts.enrich(rows).first()
    assert (row.severity, row.status, row.alert_type, row.detected_at) == ("medium", "active", "contradiction_detected", datetime.datetime(2024, 1, 1))
    assert alerts.for_user(rows, "u").count() == 1 and alerts.for_user(rows, "v").count() == 0
