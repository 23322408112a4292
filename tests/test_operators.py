"""Facts about single operators on rows written here."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from narralake.functions.text import split_scenes
from narralake.operators import consistency, network, templates, temporal, validation
from narralake.operators.consistency import alert_severity
from narralake.operators.records import insert_missing, partial_update, statements
from narralake.operators.validation import validate_edges, variable_error
from narralake.plans.adapter import Story
from narralake.streaming import alerts

EDGE = "edge_type string, from_id string, from_created_at int, to_id string, to_valid_from int, to_valid_to int, to_scene_order int, created_at int, updated_at int, ownership_start int, ownership_end int, to_data_type string, to_value string, to_name string, to_is_on string, from_location string"


@pytest.mark.parametrize(
    ("edge", "message"),
    [
        ({"edge_type": "KNOWS", "from_created_at": 10, "to_valid_from": 5}, "Knowledge valid from 5 but character created at 10"),
        ({"edge_type": "KNOWS", "from_created_at": 5, "to_valid_from": 10}, ""),
        ({"edge_type": "KNOWS", "to_valid_from": 10}, "Character must have creation timestamp"),
        ({"edge_type": "KNOWS", "from_created_at": 5, "to_valid_from": 10, "to_valid_to": 9}, "Rule 'validate_temporal_consistency' failed: Knowledge valid_from cannot be after valid_to"),
        ({"edge_type": "KNOWS", "from_id": "1", "to_id": "1", "from_created_at": 5, "to_valid_from": 10}, ""),
        ({"edge_type": "RELATIONSHIP", "from_id": "1", "to_id": "1", "created_at": 11, "updated_at": 10}, "Rule 'prevent_relationship_self_loops' failed: Self-loop detected: character 1 cannot have relationship with itself"),
        ({"edge_type": "RELATIONSHIP", "from_id": "1", "to_id": "2", "created_at": 10, "updated_at": 11}, ""),
        ({"edge_type": "RELATIONSHIP", "from_id": "1", "to_id": "2", "created_at": 11, "updated_at": 10}, "created_at cannot be after updated_at"),
        ({"edge_type": "RELATIONSHIP", "from_id": "1"}, "Both nodes must have valid IDs"),
        ({"edge_type": "PRESENT_IN", "to_scene_order": -1}, "Scene order must be non-negative"),
        ({"edge_type": "PRESENT_IN", "to_scene_order": 1}, ""),
        ({"edge_type": "PRESENT_IN"}, "Scene must have scene_order"),
        ({"edge_type": "OWNS", "ownership_start": 9, "ownership_end": 3}, "Rule 'validate_ownership_temporal_logic' failed: ownership_start cannot be after ownership_end"),
        ({"edge_type": "HAS", "to_data_type": "integer", "to_value": "10"}, ""),
        ({"edge_type": "HAS", "to_data_type": "integer", "to_value": '"ten"'}, "Value 'ten' incompatible with integer"),
        ({"edge_type": "HAS", "to_data_type": "string", "to_value": "5"}, "Variable value must be a string"),
        ({"edge_type": "HAS", "to_name": '"Door"', "to_is_on": "true"}, ""),
        ({"edge_type": "HAS", "to_name": '""', "to_is_on": '"yes"'}, "Switch name cannot be empty"),
        ({"edge_type": "HAS", "to_name": '"Door"', "to_is_on": '"yes"'}, "Rule 'validate_rpg_switch' failed: Switch is_on must be boolean"),
        ({"edge_type": "CONNECTED_TO", "from_id": "Town", "to_id": "Town"}, "Rule 'validate_location_connection' failed: Location cannot connect to itself"),
        ({"edge_type": "CONNECTED_TO", "from_id": "Town", "to_id": "Forest"}, ""),
        ({"edge_type": "ROAD", "from_id": "Town", "to_id": "Town"}, ""),
        ({"edge_type": "ROAD", "from_id": "Town", "to_id": "Town", "from_location": "Town"}, "Location cannot connect to itself"),
    ],
)
def test_edges(spark, edge, message):
    names = [f.split()[0] for f in EDGE.split(", ")]
    row = validate_edges(spark.createDataFrame([tuple(edge.get(n) for n in names)], EDGE)).first()
    assert (message in row.error) and row.is_valid == (message == "") and (row.rule is None) == row.is_valid


def test_alert_severity(spark):
    reasons = ["Critical error detected", "Significant conflict found", "Minor inconsistency", "Some other issue"]
    got = [r.s for r in spark.createDataFrame([(x,) for x in reasons], "r string").select(alert_severity(F.col("r")).alias("s")).collect()]
    assert got == ["critical", "high", "medium", "low"]


def test_variable_types(spark):
    cases = {("integer", "10"): 1, ("integer", '"ten"'): 0, ("integer", '"7"'): 1, ("integer", '"7.5"'): 0, ("integer", "7.5"): 1, ("boolean", "true"): 1, ("boolean", '"False"'): 1, ("boolean", "1"): 0, ("float", '"x"'): 0, ("float", '"2.5"'): 1, ("string", '""'): 1, ("string", "true"): 0, ("integer", None): 1, (None, "x"): 1}
    d = spark.createDataFrame(list(cases), "k string, v string")
    assert [r.ok for r in d.select(variable_error(F.col("k"), F.col("v")).isNull().alias("ok")).collect()] == [bool(x) for x in cases.values()]


def test_properties(spark):
    rows = spark.createDataFrame([("c", None, 5, True), ("d", "minor", 12, False)], "content string, importance_level string, secret int, is_secret boolean")
    got = {(r.property, r.error): r.n for r in validation.property_violations(rows, "Knowledge").collect()}
    assert got == {("importance_level", "Value 'None' not in allowed enum values: ['critical', 'important', 'minor']"): 1, ("secret", "Property 'secret' not found for entity 'Knowledge'"): 2}
    edges = spark.createDataFrame([("friend", 0, 11), (None, 10, 1)], "relationship_type string, relationship_strength int, trust_level int")
    got = {(r.property, r.error) for r in validation.property_violations(edges, "RELATIONSHIP").collect()}
    assert got == {("relationship_type", "Required property 'relationship_type' cannot be null"), ("relationship_strength", "Value 0 below minimum 1"), ("trust_level", "Value 11 above maximum 10")}
    assert validation.property_violations(edges.limit(0), "RELATIONSHIP").count() == 0


def test_schema_status():
    assert validation.schema_status([], []) == (0, "incompatible", ["Add story_id indexes for data isolation", "Add user_id indexes for multi-tenancy", "Add temporal indexes for bi-temporal queries", "Add unique constraints for entity integrity", "Add performance indexes for common query patterns"])
    assert validation.schema_status(["a"] * 5, ["x_story_id", "x_user_id", "x_temporal", *"abcdefghijklmnopqr"])[:2] == (100, "compatible")
    assert validation.schema_status(["a"], ["x_story_id", "x_user_id"])[:2] == (65, "partial")


def test_statements(spark):
    text = "// head\nA (x)\n\n  RETURN 1;  \n-- no comment here;\nB;\nopen end"
    got = spark.createDataFrame([(text,)], "t string").select(statements(F.col("t")).alias("a"), statements(F.col("t"), "--", True).alias("b")).first()
    assert got.a == ["A (x) RETURN 1;", "-- no comment here;", "B;"] and got.b == ["// head A (x) RETURN 1", "B", "open end"]


def test_scenes_keep_their_numbers(spark):
    d = spark.createDataFrame([(1, "one two\n\n***\n\nthree\n---\nfour")], "id int, t string")
    assert [(r.scene_order, r.text) for r in split_scenes(d, "id", "t").orderBy("scene_order").collect()] == [(1, "one two"), (2, "***"), (3, "three"), (4, "four")]


def test_upserts(spark):
    have = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, n string, m string")
    assert sorted(map(tuple, partial_update(have, spark.createDataFrame([(2, None, "z")], "k int, n string, m string"), "k").collect())) == [(1, "a", "x"), (2, "b", "z")]
    assert sorted(map(tuple, insert_missing(have, spark.createDataFrame([(2, "c", "c"), (3, "d", "d")], have.schema), ["k"]).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, "d", "d")]


def test_isolation(spark):
    g = Story(spark, "/root/testdata/sf0.01")
    assert g.scoped(3, "NOBODY")["characters"].count() == 0
    one = g["characters"].orderBy("character_id").first()
    mine = g.scoped(one.story_id, one.user_id)
    own = {r.character_id for r in g["characters"].filter((F.col("story_id") == one.story_id) & (F.col("user_id") == one.user_id)).collect()}
    ids = lambda df, *columns: {v for r in df.select(*columns).distinct().collect() for v in r}
    assert own and ids(mine["characters"], "character_id") == own
    for table, columns in {"known": ["character_id"], "present_in": ["character_id"], "owns": ["character_id"], "sna_edges": ["src", "dst"], "relationships": ["src", "dst"], "years": ["src", "dst"]}.items():
        assert ids(mine[table], *columns) <= own, table
    assert mine["owns"].filter(~F.col("obtained_from").isin(list(own))).count() == 0
    assert ids(mine["scenes"], "scene_id") == ids(mine["present_in"], "scene_id")
    stories = g["characters"].select(F.col("character_id").alias("src"), F.col("story_id").alias("own"))
    assert g["met"].join(stories, "src").filter("story_id <> own").count() == 0


def test_token_bucket_folds_in_order(spark):
    assert alerts.take_tokens([0.0] * 7)[0] == [True] * 5 + [False] * 2
    base = datetime.datetime(2024, 1, 1)
    d = spark.createDataFrame([(1, i, base) for i in range(7)] + [(2, 10, base), (1, 9, base + datetime.timedelta(seconds=1))], "user_id long, event_id long, ts timestamp")
    got = {(r.user_id, r.event_id): r.allowed for r in alerts.token_bucket(d).collect()}
    assert [got[1, i] for i in range(7)] == [True] * 5 + [False] * 2 and got[2, 10] and got[1, 9]


def test_stream_equals_batch(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    seen, failed = [], []

    def broken(df, number):
        raise ValueError("no")

    q = alerts.fan_out(alerts.enrich(stream.withColumn("reason", F.col("event_type"))), {"broken": broken, "count": lambda df, n: seen.append(df.count())}, str(tmp_path / "c"), failed, availableNow=True)
    q.awaitTermination(120)
    assert sum(seen) == batch.count() and failed
    assert "detected_at" in alerts.enrich(batch.withColumn("reason", F.lit("x"))).columns
    out = alerts.token_bucket_stream(stream).writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    out.awaitTermination(180)
    assert sorted(map(tuple, spark.table("bucket").collect())) == sorted(map(tuple, alerts.token_bucket(batch).collect()))


def test_distances_have_no_bound(spark):
    """A path of seven characters: its ends are six hops apart."""
    g = {
        "characters": spark.createDataFrame([(i, f"c{i}", 1) for i in range(7)], "character_id long, name string, story_id int"),
        "sna_edges": spark.createDataFrame([(1, a, b, "KNOWS", 9) for i in range(6) for a, b in ((i, i + 1), (i + 1, i))], "story_id int, src long, dst long, type string, strength long"),
    }
    assert {r.start: (r.reachable, r.total) for r in network.closeness(g).collect()} == {i: (6, sum(abs(i - j) for j in range(7))) for i in range(7)}
    assert {r.dist: r.n for r in network.distance_histogram(g).collect()} == {d: 2 * (7 - d) for d in range(1, 7)}
    for way in (network.betweenness, network.betweenness_by_joins):
        assert {r.character_id: r.betweenness for r in way(g).collect()} == {i: 2.0 * i * (6 - i) for i in range(7)}


def modularity(edges, member):
    m = len(edges)
    inside = sum(member[a] == member[b] for a, b in edges) / m
    degree, total = {}, {}
    for a, b in edges:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    for n, d in degree.items():
        total[member[n]] = total.get(member[n], 0) + d
    return inside - sum((t / (2 * m)) ** 2 for t in total.values())


def test_louvain_finds_the_best_partition_of_small_graphs():
    import itertools
    import random

    rng = random.Random(4)
    cliques = [(a, b) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 4), 2)] + [(3, 10)]
    both = lambda edges: [(a, b) for a, b in edges] + [(b, a) for a, b in edges]
    assert network.louvain_members([*range(4), *range(10, 14), 99], both(cliques)) == {**{i: 0 for i in range(4)}, **{i: 10 for i in range(10, 14)}, 99: 99}
    for _ in range(20):
        edges = [e for e in itertools.combinations(range(6), 2) if rng.random() < 0.5]
        if not edges:
            continue
        found = network.louvain_members(list(range(6)), both(edges))
        best = max(modularity(edges, dict(enumerate(p))) for p in itertools.product(range(3), repeat=6))
        assert modularity(edges, found) >= best - 0.08


def test_ring_members(spark):
    links = [(1, 2), (2, 3), (3, 1), (4, 1), (5, 4), (6, None), (7, 6), (8, 8)]
    assert {r.episode for r in temporal.ring_members(spark.createDataFrame(links, "episode long, parent long")).collect()} == {1, 2, 3, 8}
    assert temporal.ring_members(spark.createDataFrame([], "episode long, parent long")).count() == 0


def test_conflicts_equal_all_pairs(spark):
    g = Story(spark, "/root/testdata/sf0.001")
    pairs = templates.temporal_knowledge_conflicts(g).groupBy("character_id").count()
    assert {tuple(r) for r in pairs.collect()} == {(r.character_id, r.conflicts) for r in consistency.temporal_conflict_counts(g).filter("conflicts > 0").collect()}


def test_findings_survive_the_log(spark):
    rows = spark.createDataFrame([("r", 1, "a", "b", "high", "why so", 0.95), ("r", 1, "c", "d", "medium", "x", 0.5)], "rule string, character_id long, from_id string, to_id string, severity string, reason string, confidence double")
    log = consistency.record(rows).unionByName(spark.createDataFrame([("n", "CONTRADICTION DETECTED:\nConfidence: much"), ("n", "hello")], "name string, body string"))
    got = sorted(map(tuple, consistency.parse_report(log).collect()))
    assert got == [("a", "b", "high", "why so", 0.95), ("c", "d", "medium", "x", 0.5), ("unknown", "unknown", "medium", "Contradiction detected via episodic analysis", 0.5)]


def test_idle_users_are_forgotten(spark, tmp_path):
    """State rows go once the watermark is a minute beyond a user's last event."""
    base = datetime.datetime(2024, 1, 1)
    source, n = tmp_path / "in", iter(range(100))

    def add(rows):
        spark.createDataFrame(rows, "user_id long, event_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(source))

    add([(1, next(n), base)] * 7)
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").parquet(str(source))
    held = []
    for hours in (0, 1, 2):
        if hours:
            add([(2, next(n), base + datetime.timedelta(hours=hours))])
        q = alerts.token_bucket_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        held.append(sum(o.numRowsTotal for o in q.lastProgress.stateOperators) if q.lastProgress else None)
    assert held[0] == 1 and held[-1] == 1
    got = [r.allowed for r in spark.read.parquet(str(tmp_path / "out")).filter("user_id = 1").collect()]
    assert sorted(got) == [False] * 2 + [True] * 5


def test_windowed_counts(spark, tmp_path):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(seconds=10 * i)) for i in range(9)]
    spark.createDataFrame(rows, "event_id long, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(str(tmp_path / "in"))
    q = alerts.windowed_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("windows").collect()) == [3, 3, 3]


def test_unlinked_counts_equal_the_pairs(spark, monkeypatch):
    """Each knowledge's number of opposed partners, with rows repeated under one id, without forming a pair."""
    g = {
        "known": spark.createDataFrame([(1, s, k, c, 1, 2, datetime.datetime(2024, 1, 1)) for s, k, c in [(1, "a", "hot ring"), (1, "a", "hot ring"), (1, "b", "old ring"), (1, "c", "new ring"), (1, "d", "ring"), (1, "e", "hot ring"), (2, "f", "new hat"), (2, "g", "small hat")]], "character_id long, story_id int, knowledge_id string, content string, valid_from int, valid_to int, valid_from_ts timestamp"),
        "contradicts": spark.createDataFrame([("d", "a"), ("d", "a"), ("e", "c")], "from_id string, to_id string"),
    }
    want = {r.knowledge_id_1: r["count"] for r in consistency.unlinked_pairs(g, *consistency.SUBSTITUTES).groupBy("knowledge_id_1").count().collect()}
    monkeypatch.setattr(consistency, "unlinked_content_pairs", None)
    assert {r.knowledge_id_1: r.n for r in consistency.unlinked_counts(g).collect()} == want == {"a": 6, "b": 1, "e": 4}


def test_conflicts_of_each_equal_the_pairs(spark):
    """Sums by first knowledge, also where a link takes the greatest partner away and where an id is repeated."""
    days = [(1, "a", 20240105, 20240110), (1, "b", 20240220, None), (1, "c", 20240201, 20240220), (1, "d", 20240401, 20240402), (1, "d", 20240501, 20240502), (1, "e", None, 20231201), (2, "f", 20240301, 20240101)]
    g = {"known": spark.createDataFrame(days, "character_id long, knowledge_id string, valid_from int, valid_to int"), "contradicts": spark.createDataFrame([("b", "e"), ("d", "c"), ("a", "b")], "from_id string, to_id string")}
    pairs = templates.temporal_knowledge_conflicts(g).groupBy("character_id", "knowledge_id_1").agg(F.count("*").alias("n"), F.max("valid_to_2").alias("last_end"), F.max("knowledge_id_2").alias("last_id"))
    assert sorted(map(tuple, templates.temporal_conflicts_of_each(g).collect())) == sorted(map(tuple, pairs.collect())) != []
    g["contradicts"] = g["contradicts"].limit(0)
    g["known"] = g["known"].filter("knowledge_id NOT IN ('d', 'f')")
    assert sorted(map(tuple, templates.temporal_conflicts_of_each(g).collect())) == [(1, "a", 1, 20231201, "e"), (1, "b", 2, 20240110, "e"), (1, "c", 2, 20240110, "e")]


def test_betweenness_of_bounded_paths(spark):
    """A path of ten characters has shortest paths of up to nine steps; with a bound of seven, pairs farther apart don't count."""
    from narralake import catalog

    g = {
        "characters": spark.createDataFrame([(i, f"c{i}", 1) for i in range(10)], "character_id long, name string, story_id int"),
        "sna_edges": spark.createDataFrame([(1, a, b, "KNOWS", 9) for i in range(9) for a, b in ((i, i + 1), (i + 1, i))], "story_id int, src long, dst long, type string, strength long"),
    }
    want = {i: 2.0 * sum(j - k <= 7 for k in range(i) for j in range(i + 1, 10)) for i in range(10)}
    for way in (network.betweenness, network.betweenness_by_joins):
        assert {r.character_id: r.betweenness for r in way(g, steps=catalog._STEPS).collect()} == want
        assert {r.character_id: r.betweenness for r in way(g).collect()} == {i: 2.0 * i * (9 - i) for i in range(10)}
    assert [r.betweenness for r in network.bridge_characters(g, 2, catalog._STEPS).collect()] == sorted(want.values(), reverse=True)[:2]


def test_betweenness_rounds_halves_up(spark):
    """One of 32 ways leads over each middle node; 1 / 32 rounds as in SQL, to 0.0313."""
    middle = range(1, 33)
    g = {
        "characters": spark.createDataFrame([(i, f"c{i}", 1) for i in range(34)], "character_id long, name string, story_id int"),
        "sna_edges": spark.createDataFrame([(1, *p, "KNOWS", 9) for i in middle for p in ((0, i), (i, 33))], "story_id int, src long, dst long, type string, strength long"),
    }
    for way in (network.betweenness, network.betweenness_by_joins):
        assert {r.betweenness for r in way(g).collect() if r.character_id in middle} == {0.0313}


def test_hop_counts_equal_distances(spark, monkeypatch):
    """Numbers of nodes by distance in two random directed stories, in many small tasks and blocks, without a table of pairs."""
    import random

    rng = random.Random(3)
    edges = sorted({(s, 100 * s + rng.randrange(30), 100 * s + rng.randrange(30)) for s in (1, 2) for _ in range(45)})
    g = {
        "characters": spark.createDataFrame([(100 * s + i, f"c{i}", s) for s in (1, 2) for i in range(30)], "character_id long, name string, story_id int"),
        "sna_edges": spark.createDataFrame([(*e, "KNOWS", 9) for e in edges], "story_id int, src long, dst long, type string, strength long"),
    }
    want = sorted(map(tuple, network.distances(g).filter("dist > 0").groupBy("start", "dist").count().collect()))
    by_joins = monkeypatch.setattr(network, "GROUP_EDGES", 0) or sorted(map(tuple, network.hop_counts(g).collect()))
    for name, value in (("GROUP_EDGES", 200_000), ("GROUP_STEPS", 300), ("BLOCK", 100), ("distances", None)):
        monkeypatch.setattr(network, name, value)
    assert sorted(map(tuple, network.hop_counts(g).collect())) == by_joins == want
    assert sum(r.n for r in network.distance_histogram(g).collect()) == sum(r.reachable for r in network.closeness(g).collect()) == sum(n for *_, n in want)
