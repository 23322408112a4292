"""Durable changes, scheduled jobs, communities of any size, and dialogue trees."""

from __future__ import annotations

import datetime
import json
import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from narralake.operators import network, rpg
from narralake.plans.adapter import Story
from narralake.sources.store import KeyedStore, LostRace
from narralake.streaming import jobs

SCHEMA = "project_id string, name string, level int"


def rows_of(frame):
    return sorted(map(tuple, frame.collect()))


def test_changes_last_and_readers_keep_their_version(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    store = KeyedStore(spark, str(tmp_path / "places"), SCHEMA, "RPGLocation")
    assert store.read().isEmpty() and store.version() == 0
    store.create(make(("p", "a", 1), ("p", "b", 2), ("q", "a", 3)))
    before = store.read()
    store.update(make(("p", "a", 10), ("p", "z", 99)))
    store.upsert(make(("q", "a", 30), ("r", "n", 5)))
    assert rows_of(before) == [("p", "a", 1), ("p", "b", 2), ("q", "a", 3)]
    again = KeyedStore(spark, str(tmp_path / "places"), SCHEMA, "RPGLocation")  # a restart
    assert again.version() == 3 and rows_of(again.read()) == [("p", "a", 10), ("p", "b", 2), ("q", "a", 30), ("r", "n", 5)]
    again.replace("p", make(("p", "new", 7), ("x", "stays out", 0)))
    again.delete("q", "a")
    again.delete("r")
    assert rows_of(again.read()) == [("p", "new", 7)] and rows_of(again.read(1)) == rows_of(before)
    held = again._buckets(again.version())
    again.create(make(("q", "c", 1)))
    assert {b: f for b, f in again._buckets(again.version()).items() if b in held} == held  # other buckets are as they were


def test_a_lost_race_is_made_again(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, SCHEMA)
    store = KeyedStore(spark, str(tmp_path / "places"), SCHEMA, "RPGLocation")
    store.create(make(("p", "a", 1)))
    other, calls = KeyedStore(spark, str(tmp_path / "places"), SCHEMA, "RPGLocation"), []

    def first_time():
        calls.append(1)
        if len(calls) == 1:
            other.upsert(make(("p", "b", 2)))

    new = make(("p", "a", 5))
    store.change(new, lambda rows: rows.withColumn("level", F.col("level") + 10), first_time)
    assert len(calls) == 2 and rows_of(store.read()) == [("p", "a", 11), ("p", "b", 12)]
    with pytest.raises(LostRace):
        store.change(new, lambda rows: rows, lambda: other.create(make(("q", str(random.random()), 1))))
    with pytest.raises(ZeroDivisionError):
        store.change(new, lambda rows: rows, lambda: 1 // 0)
    assert rows_of(store.read().filter("project_id = 'p'")) == [("p", "a", 11), ("p", "b", 12)]


def test_scheduled_jobs_are_bound(spark, tmp_path):
    g = Story(spark, "/root/testdata/sf0.001")
    old = jobs.bound(g, str(tmp_path), "2024-01-01 00:00:00")
    assert set(old) == set(jobs.SCHEDULE) and all(old[n].interval == when for n, when in jobs.SCHEDULE.items())
    read = lambda: spark.read.parquet(str(tmp_path / "contradictions"))
    assert old["temporal-contradiction-detection"].run_once(), old["temporal-contradiction-detection"].last_error
    n = read().count()
    new = jobs.bound(g, str(tmp_path), "2024-03-01 00:00:00")
    assert n > 0 and new["temporal-contradiction-detection"].run_once() and read().count() == n
    assert new["cleanup-old-contradictions"].run_once() and read().count() == 0
    assert new["nightly-continuity-validation"].run_once() and spark.read.parquet(str(tmp_path / "unresolved_foreshadows")).columns == ["from_id", "to_id"]
    assert new["nightly-relationship-evolution-scan"].run_once(), new["nightly-relationship-evolution-scan"].last_error


def test_a_job_of_the_day_waits_for_its_hour():
    soon = datetime.datetime.now(datetime.UTC) + datetime.timedelta(hours=5)
    ran = threading.Event()
    job = jobs.Job(ran.set, (soon.hour, soon.minute))
    assert job.start()
    time.sleep(0.3)
    assert not ran.is_set() and job.status()["is_running"] and 3600 < job._pause(True) <= 5 * 3600 + 60
    job.stop()
    assert not ran.is_set()


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    n, size = 60, 12
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.5 if i // size == j // size else 0.04)]
    e = spark.createDataFrame([(1, *p) for i, j in pairs for p in ((i, j), (j, i))], "story_id int, src long, dst long")
    g = {"characters": spark.createDataFrame([(i, 1, f"n{i}") for i in range(n + 1)], "character_id long, story_id int, name string")}
    return g, e, [(i, j) for a, b in pairs for i, j in ((a, b), (b, a))]


def test_communities_by_joins_are_as_good_as_one_by_one(spark, planted):
    g, e, pairs = planted
    found = {r.character_id: r.community for r in network.louvain_by_joins(g, e).collect()}
    one = network.louvain_members(sorted(found), pairs)
    q = lambda members: network.modularity(spark.createDataFrame([(1, *m) for m in members.items()], "story_id int, character_id long, community long"), e).first().q
    assert q(found) >= 0.99 * q(one) > 0.3 and len(found) == 61 and found[60] == 60
    assert all(found[c] == c and c <= i for i, c in found.items())
    assert found == {r.character_id: r.community for r in network.louvain_by_joins(g, e).collect()}


def test_half_moves_of_a_story_are_those_of_tables(spark, planted, monkeypatch):
    g, e, _ = planted
    of = lambda rows: {r.character_id: r.community for r in rows.collect()}
    want = of(network.louvain_by_tables(g, e))
    monkeypatch.setattr(network, "_half_moves", None)
    assert of(network.louvain_by_joins(g, e)) == want and len(set(want.values())) < 20


def test_large_stories_go_by_joins(spark, planted, monkeypatch):
    g, e, _ = planted
    monkeypatch.setattr(network, "pairs", lambda _: e)
    small = {r.character_id: r.betweenness for r in network.betweenness(g).collect()}
    monkeypatch.setattr(network, "GROUP_STEPS", 10)
    monkeypatch.setattr(network, "GROUP_EDGES", 10)
    assert {r.character_id: r.betweenness for r in network.betweenness(g).collect()} == pytest.approx(small, abs=2e-4)
    assert {r.character_id: r.community for r in network.louvain(g).collect()}[60] == 60 and network.louvain(g).count() == 61


def test_shortest_pairs_stop_when_enough_are_met(spark, monkeypatch):
    chain = spark.createDataFrame([(1, i, i + 1) for i in range(6)], "story_id int, src long, dst long")
    g = {"characters": spark.createDataFrame([(i, f"n{i}") for i in range(7)], "character_id long, name string")}
    monkeypatch.setattr(network, "pairs", lambda _: chain)
    want = sorted((b - a, f"n{a}", f"n{b}") for a in range(7) for b in range(a + 1, 7))
    for top in (3, 9, 100):
        assert [(r.dist, r.name_1, r.name_2) for r in network.influence_paths(g, top).collect()] == want[:top]


def test_dialogue_trees(spark):
    choice = lambda to: {"text": "go", "next_node_id": to}
    node = lambda i, *to: {"id": i, "text": "hi", "choices": [choice(t) for t in to]}
    trees = [
        {"id": "ring", "nodes": [node("a", "b"), node("b", "c", "x"), node("c", "a"), node("lost", "a")]},
        {"id": "named", "start_node_id": "b", "nodes": [node("a", "b"), node("b")]},
        {"id": "empty"},
        {"id": "odd", "start_node_id": "nowhere", "nodes": [{"id": "a"}, node("b", None), {"id": "c", "text": "t", "choices": [{"next_node_id": "b"}]}]},
    ]
    rows = spark.createDataFrame([(json.dumps(t),) for t in trees] + [("no json",), (None,)], "j string")
    got = {(r.tree, r.node): (r.choices, r.depth, r.ends, r.dangling) for r in rpg.dialogue_report(rows, "j").collect()}
    assert got == {("ring", "a"): (1, 0, False, 0), ("ring", "b"): (2, 1, False, 1), ("ring", "c"): (1, 2, False, 0), ("ring", "lost"): (1, None, False, 0), ("named", "a"): (1, None, False, 0), ("named", "b"): (0, 0, True, 0), ("odd", "b"): (1, None, False, 1), ("odd", "c"): (0, None, True, 0)}


def test_typed_records_refuse_what_a_kind_does_not_know(spark):
    answer = {"locations": [{"name": "Inn"}, {"name": "Pit", "type": "dungeon", "events": ["fall"]}, {"type": "town"}, {"name": "Sky", "type": "cloud"}], "connections": [{"from_location": "Inn", "to_location": "Pit"}, {"from_location": "Inn", "to_location": "Pit", "direction": "left"}, {"from_location": "Inn"}]}
    places, ways = rpg.typed_locations(spark.createDataFrame([(1, json.dumps(answer)), (2, "{}"), (3, None)], "k int, j string"), "k", "j")
    assert rows_of(places) == [(1, "Inn", "other", None, []), (1, "Pit", "dungeon", None, ["fall"])] and rows_of(ways) == [(1, "Inn", "Pit", "path", None)]
    quests = [{"name": "Q", "objectives": [{"description": "d"}]}, {"name": "R", "quest_type": "odd"}, {"name": "S", "objectives": [{"type": "talk"}]}, {"quest_type": "main"}]
    got = rpg.typed_quests(spark.createDataFrame([(i, json.dumps(q)) for i, q in enumerate(quests)], "k int, j string"), "k", "j").collect()
    assert [(r.k, r.quest_type, r.status, r.objectives[0].type, r.objectives[0].is_mandatory, r.rewards) for r in got] == [(0, "side", "not_started", "other", True, [])]
