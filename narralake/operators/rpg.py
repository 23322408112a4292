"""Game data from generators' answers: nested JSON parsed into typed rows, and dialogue trees as graphs.

An answer that lacks what a kind requires, or names a value outside its enumeration, gives no row. What is left out gets the
kind's default.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narralake.plans.adapter import Story
from narralake.plans.storage import written

#: Enumerations of a game's records; the default is named where a record says nothing.
LOCATION_TYPES, CONNECTION_TYPES = ("town", "dungeon", "building", "wilderness", "other"), ("path", "door", "portal", "other")
DIRECTIONS = ("north", "south", "east", "west", "up", "down")
QUEST_TYPES, QUEST_STATES = ("main", "side", "tutorial", "guild", "other"), ("not_started", "in_progress", "completed", "failed")
OBJECTIVE_TYPES = ("fetch", "eliminate", "explore", "talk", "other")

_CONDITION = "struct<variable:string,required_value:string,switch:string,description:string>"
PLACES = "locations array<struct<name:string,type:string,description:string,events:array<string>>>, connections array<struct<from_location:string,to_location:string,type:string,direction:string>>"
QUEST = f"name string, quest_type string, status string, description string, objectives array<struct<description:string,type:string,target_id:string,quantity:int,completion_condition:{_CONDITION},is_mandatory:boolean>>, rewards array<string>, prerequisites array<string>"
DIALOGUE = f"id string, start_node_id string, nodes array<struct<id:string,speaker:string,text:string,choices:array<struct<text:string,next_node_id:string,condition:{_CONDITION}>>>>, description string"


def _or(column: Column, default: str) -> Column:
    return F.coalesce(column, F.lit(default))


def _list(column: Column, kind: str) -> Column:
    return F.coalesce(column, F.array().cast(f"array<{kind}>"))


def typed_locations(rows: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """(key, name, type, description, events) and (key, from_location, to_location, type, direction) of answers."""
    x = rows.select(key, F.from_json(json, PLACES).alias("x"))
    place = x.select(key, F.explode("x.locations").alias("p")).select(key, "p.name", _or(F.col("p.type"), "other").alias("type"), "p.description", _list(F.col("p.events"), "string").alias("events"))
    way = x.select(key, F.explode("x.connections").alias("c")).select(key, "c.from_location", "c.to_location", _or(F.col("c.type"), "path").alias("type"), "c.direction")
    fits = F.col("type").isin(*CONNECTION_TYPES) & (F.col("direction").isNull() | F.col("direction").isin(*DIRECTIONS))
    return place.filter(F.col("name").isNotNull() & F.col("type").isin(*LOCATION_TYPES)), way.filter("from_location IS NOT NULL AND to_location IS NOT NULL").filter(fits)


def typed_quests(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, name, quest_type, status, description, objectives, rewards, prerequisites; one objective that is none spoils its quest."""
    x = rows.select(key, F.from_json(json, QUEST).alias("x")).select(key, "x.*")
    objectives = F.transform(F.coalesce("objectives", F.array()), lambda o: o.withField("type", _or(o["type"], "other")).withField("is_mandatory", F.coalesce(o["is_mandatory"], F.lit(True))))
    full = x.select(key, "name", _or(F.col("quest_type"), "side").alias("quest_type"), _or(F.col("status"), "not_started").alias("status"), "description", objectives.alias("objectives"), _list(F.col("rewards"), "string").alias("rewards"), _list(F.col("prerequisites"), "string").alias("prerequisites"))
    whole = ~F.exists("objectives", lambda o: o["description"].isNull() | ~o["type"].isin(*OBJECTIVE_TYPES))
    return full.filter(F.col("name").isNotNull() & F.col("quest_type").isin(*QUEST_TYPES) & F.col("status").isin(*QUEST_STATES) & whole)


def dialogue_graph(rows: DataFrame, json: str) -> tuple[DataFrame, DataFrame]:
    """(tree, place, node, speaker, text, choices, start) and (tree, node, next) of answers; start: where the tree begins, at the
    node it names or else its first one. Nodes without id or text fall away, and choices without text."""
    x = rows.select(F.from_json(json, DIALOGUE).alias("x")).filter("x.id IS NOT NULL").select(F.col("x.id").alias("tree"), F.col("x.start_node_id").alias("named"), F.filter(F.coalesce("x.nodes", F.array()), lambda n: n["id"].isNotNull() & n["text"].isNotNull()).alias("nodes"))
    nodes = x.select("tree", "named", F.posexplode("nodes").alias("place", "n")).select("tree", "place", F.col("n.id").alias("node"), "n.speaker", "n.text", F.filter(F.coalesce("n.choices", F.array()), lambda c: c["text"].isNotNull()).alias("c"), F.coalesce(F.col("named") == F.col("n.id"), F.col("place") == 0).alias("start"))
    edges = nodes.select("tree", "node", F.explode("c").alias("c")).select("tree", "node", F.col("c.next_node_id").alias("next"))
    return nodes.select("tree", "place", "node", "speaker", "text", F.size("c").alias("choices"), "start"), edges


def dialogue_report(rows: DataFrame, json: str) -> DataFrame:
    """tree, node, choices, depth (choices from the start; null if no path leads there), ends (it offers no choice), dangling (its
    choices that lead to no node). Depths grow level by level in all trees at once, until nothing new is reached."""
    nodes, edges = (written(t, "dialogue") for t in dialogue_graph(rows, json))
    known = nodes.select("tree", "node").distinct()
    paths = written(edges.join(known.withColumnRenamed("node", "next"), ["tree", "next"]).select("tree", "node", "next").distinct(), "paths")
    seen = frontier = written(nodes.filter("start").select("tree", "node").distinct().withColumn("depth", F.lit(0)), "reached")
    for depth in count(1):
        reached = frontier.join(paths, ["tree", "node"]).select("tree", F.col("next").alias("node")).distinct()
        frontier = written(reached.join(seen.select("tree", "node"), ["tree", "node"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    lost = edges.join(known.withColumnRenamed("node", "next"), ["tree", "next"], "left_anti").groupBy("tree", "node").agg(F.count("*").alias("dangling"))
    return nodes.select("tree", "node", "choices").join(seen, ["tree", "node"], "left").join(lost, ["tree", "node"], "left").select("tree", "node", "choices", "depth", (F.col("choices") == 0).alias("ends"), F.coalesce("dangling", F.lit(0)).alias("dangling"))


def location_answers(g: Story) -> DataFrame:
    """An answer for each part type: places named after its parts, and ways between parts of neighbouring keys."""
    p = g["part"].select("p_type", "p_partkey", "p_size", "p_name")
    kind = F.when(F.col("p_size") % 7 == 0, "castle").when(F.col("p_size") % 3 == 0, "dungeon").when(F.col("p_size") % 3 == 1, "town")
    place = F.struct(F.when(F.col("p_partkey") % 11 != 0, F.concat_ws(" ", "p_name", "p_partkey")).alias("name"), kind.alias("type"), F.when(F.col("p_partkey") % 2 == 0, F.array("p_name")).alias("events"))
    way = F.struct(F.concat_ws(" ", "p_name", "p_partkey").alias("from_location"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("place "), (F.col("p_partkey") + 1).cast("string"))).alias("to_location"), F.when(F.col("p_size") % 2 == 0, "portal").alias("type"), F.when(F.col("p_size") % 4 == 0, "north").when(F.col("p_size") % 4 == 1, "sideways").alias("direction"))
    return p.groupBy("p_type").agg(F.to_json(F.struct(F.collect_list(place).alias("locations"), F.collect_list(way).alias("connections"))).alias("answer"))


def generated_locations(g: Story) -> DataFrame:
    return typed_locations(location_answers(g), "p_type", "answer")[0].select("p_type", "name", "type", F.size("events").alias("n_events"))


def generated_connections(g: Story) -> DataFrame:
    return typed_locations(location_answers(g), "p_type", "answer")[1].select("p_type", "from_location", "to_location", "type", "direction")


def quest_answers(g: Story) -> DataFrame:
    """An answer for each order: its lines are objectives."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("fetch", "eliminate", "explore", "talk", "sing")]), F.col("l_linenumber") % 5 + 1)
    objective = F.struct(F.concat_ws(" ", F.lit("bring"), "l_partkey").alias("description"), F.when(F.col("l_linenumber") != 2, kind).alias("type"), F.col("l_partkey").cast("string").alias("target_id"), F.col("l_quantity").cast("int").alias("quantity"), F.when(F.col("l_linenumber") == 3, False).alias("is_mandatory"))
    lines = g["lineitem"].filter("l_linenumber <> 4 OR l_orderkey % 3 = 0").groupBy("l_orderkey").agg(F.collect_list(objective).alias("objectives"))
    o = g["orders"].join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    answer = F.struct(F.when(F.col("o_orderkey") % 13 != 0, F.concat(F.lit("Quest "), F.col("o_orderkey").cast("string"))).alias("name"), F.when(F.col("o_orderkey") % 4 == 0, "main").when(F.col("o_orderkey") % 4 == 1, "guild").alias("quest_type"), F.when(F.col("o_orderstatus") == "F", "completed").alias("status"), F.col("objectives"))
    return o.select("o_orderkey", F.to_json(answer).alias("answer"))


def generated_quests(g: Story) -> DataFrame:
    q = typed_quests(quest_answers(g), "o_orderkey", "answer")
    must = F.size(F.filter("objectives", lambda o: o["is_mandatory"]))
    return q.select("o_orderkey", "name", "quest_type", "status", F.size("objectives").alias("n_objectives"), must.alias("n_mandatory"), F.aggregate("objectives", F.lit(0), lambda s, o: s + o["quantity"]).alias("quantity"), F.size(F.filter("objectives", lambda o: o["type"] == "other")).alias("n_other"))


def dialogue_answers(g: Story) -> DataFrame:
    """An answer for each conversation: its turns are nodes, each with choices by its number: on to the next, past one, or none."""
    go = lambda step: F.struct(F.lit(f"on {step}").alias("text"), (F.col("turn") + step).cast("string").alias("next_node_id"))
    choices = F.when(F.col("turn") % 4 == 1, F.array().cast("array<struct<text:string,next_node_id:string>>")).when(F.col("turn") % 3 == 0, F.array(go(1), go(2))).otherwise(F.array(go(1)))
    node = F.struct("turn", F.struct(F.col("turn").cast("string").alias("id"), F.col("role").alias("speaker"), "text", choices.alias("choices")).alias("n"))
    nodes = F.transform(F.array_sort(F.collect_list(node)), lambda x: x["n"])
    return g["conversations"].groupBy("conv_id").agg(F.to_json(F.struct(F.concat(F.lit("tree-"), F.first("conv_id").cast("string")).alias("id"), F.when(F.first("conv_id") % 3 == 0, "1").alias("start_node_id"), nodes.alias("nodes"))).alias("answer"))


def generated_dialogues(g: Story) -> DataFrame:
    return dialogue_report(dialogue_answers(g), "answer")
