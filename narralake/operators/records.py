"""Record operators: lookups, seeds, back-fills, upserts, RPG documents, JSON and text splitting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.operators.consistency import alert_severity
from narralake.plans.adapter import Story


def scan_label(g: Story, key: int = 3) -> DataFrame:
    return g["characters"].filter(F.col("story_id") == key).select("character_id", "name", "story_id")


def scan_all_relationships(g: Story) -> DataFrame:
    a = g["sna_edges"].select("src", "dst", "type")
    return a.unionByName(g["relationships"].select("src", "dst", F.upper("relationship_type").alias("type")))


def rls_scope(g: Story, user_id: str = "ASIA") -> DataFrame:
    return g["characters"].filter(F.col("user_id") == user_id).select("character_id", "user_id")


def scope_counts(g: Story, tables: tuple[str, ...]) -> DataFrame:
    """Rows of each table in the scope of one story and its owner: that of the least character."""
    one = g["characters"].orderBy("character_id").first()
    scope = g.scoped(one.story_id, one.user_id)
    return reduce(DataFrame.unionAll, [scope[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in tables])


def partial_update(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Every non-null field of a change replaces the row's."""
    cols = [c for c in rows.columns if c != key]
    both = rows.join(changes.select(key, *[F.col(c).alias(f"{c}__new") for c in changes.columns if c != key]), key, "left")
    return both.select(key, *[F.coalesce(f"{c}__new", c).alias(c) if c in changes.columns else F.col(c) for c in cols])


def profile_partial_update(g: Story) -> DataFrame:
    rows = g["customer"].select("c_custkey", "c_name", "c_mktsegment")
    changes = rows.filter("c_custkey % 10 = 0").select("c_custkey", F.upper("c_mktsegment").alias("c_mktsegment"), F.lit(None).cast("string").alias("c_name"))
    return partial_update(rows, changes, "c_custkey")


def insert_missing(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key is free are appended; others are skipped."""
    return rows.unionByName(new.join(rows.select(*key), key, "left_anti").select(rows.columns))


def seed_profiles(g: Story) -> DataFrame:
    have = g["customer"].filter("c_custkey % 2 = 0").select("c_custkey", "c_name")
    return insert_missing(have, g["customer"].select("c_custkey", F.concat(F.lit("seed "), F.col("c_name")).alias("c_name")), ["c_custkey"])


def alerts_backfill(g: Story) -> DataFrame:
    alerts = g["events"].filter("event_type = 'error'").select("event_id", (F.col("user_id") % 25).cast("string").alias("story"))
    owners = g["nation"].select(F.col("n_nationkey").cast("string").alias("story"), F.col("n_name").alias("owner"))
    return alerts.join(owners, "story", "left").select("event_id", "story", F.coalesce("owner", F.lit("none")).alias("owner"))


def scenes_to_episodes(g: Story) -> DataFrame:
    have = g["scenes"].filter("scene_id % 3 = 0").select(F.concat(F.lit("chapter-"), F.col("scene_id").cast("string")).alias("episode_id"), F.lit("Arc").alias("kind"))
    new = g["scenes"].select(F.concat(F.lit("chapter-"), F.col("scene_id").cast("string")).alias("episode_id"), F.lit("Chapter").alias("kind"))
    return insert_missing(have, new, ["episode_id"])


def json_roundtrip(g: Story) -> DataFrame:
    j = g["events"].select("event_id", F.to_json(F.struct("event_id", "event_type")).alias("j"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    return j.select("event_id", F.from_json("j", "event_id long, event_type string")["event_type"].alias("event_type"), "k")


#: What tells rows of a game project's tables apart, besides the project.
RPG_KEYS = {
    "RPGProject": (),
    "ProjectStory": ("story_id",),
    "ExportConfiguration": ("name",),
    "RPGVariable": ("name",),
    "RPGSwitch": ("name",),
    "RPGCharacter": ("name",),
    "RPGLocation": ("name",),
    "LocationConnection": ("from_location", "to_location"),
    "RPGQuest": ("quest_id",),
    "DialogueTree": ("tree_id",),
}


def rpg_create(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Appended; nothing is looked up."""
    return rows.unionByName(new.select(rows.columns))


def rpg_get(rows: DataFrame, project_id: str) -> DataFrame:
    return rows.filter(F.col("project_id") == project_id)


def _same(rows: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    return rows.join(other.select(*keys).distinct(), keys, how)


def rpg_update(rows: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Rows of the same key take the new values; new rows without such a row are left out."""
    keys = ["project_id", *RPG_KEYS[kind]]
    return _same(rows, new, keys, "left_anti").unionByName(_same(new, rows, keys, "left_semi").select(rows.columns))


def rpg_upsert(rows: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Rows of the same key take the new values, the other new rows are appended."""
    return _same(rows, new, ["project_id", *RPG_KEYS[kind]], "left_anti").unionByName(new.select(rows.columns))


def rpg_replace(rows: DataFrame, project_id: str, new: DataFrame) -> DataFrame:
    """All of one project's rows are replaced by the new ones."""
    return rows.filter(F.col("project_id") != project_id).unionByName(new.select(rows.columns))


def rpg_delete(rows: DataFrame, project_id: str, kind: str | None = None, *key: str) -> DataFrame:
    """Without a key all of a project's rows go."""
    gone = F.col("project_id") == project_id
    for name, value in zip(RPG_KEYS[kind] if kind else (), key, strict=False):
        gone &= F.col(name) == value
    return rows.filter(~gone)


def rpg_items(g: Story) -> DataFrame:
    """Locations of game projects: a brand is a project."""
    return g["part"].select(F.col("p_brand").alias("project_id"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("level"))


def rpg_tables(g: Story, what: str) -> DataFrame:
    """One operation of the store on them, with rows of projects 1 and 2 as the new ones."""
    rows = rpg_items(g)
    some = rows.filter("project_id IN ('Brand#1', 'Brand#2')")
    new = some.select("project_id", F.when(F.col("level") % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("new "), "name")).alias("name"), (F.col("level") + 100).alias("level"))
    have = rows.filter("level % 4 <> 2")
    return {
        "create": lambda: rpg_create(have, new),
        "get": lambda: rpg_get(rows, "Brand#1"),
        "update": lambda: rpg_update(have, new, "RPGLocation"),
        "upsert": lambda: rpg_upsert(have, new, "RPGLocation"),
        "replace": lambda: rpg_replace(have, "Brand#1", new.filter("project_id = 'Brand#1'")),
        "delete": lambda: rpg_delete(rows, "Brand#1"),
        "delete_one": lambda: rpg_delete(rows, "Brand#1", "RPGLocation", "small ring 0"),
    }[what]()


#: A game character's statistics where none are given.
STATS = {"hp": 100, "mp": 0, "strength": 10, "agility": 10, "intelligence": 10, "charisma": 10}


def typed_variables(rows: DataFrame, json: str) -> DataFrame:
    """Variables parsed from JSON: an integer of the whole game where nothing else is said; those without a name fall away."""
    x = F.from_json(json, "name string, value string, data_type string, scope string, description string")
    parsed = rows.select(*[c for c in rows.columns if c != json], x.alias("x")).filter("x.name IS NOT NULL")
    return parsed.select(*[c for c in parsed.columns if c != "x"], "x.name", "x.value", F.coalesce("x.data_type", F.lit("integer")).alias("data_type"), F.coalesce("x.scope", F.lit("game")).alias("scope"), "x.description")


def typed_characters(rows: DataFrame, json: str) -> DataFrame:
    x = F.from_json(json, "name string, type string, level int, stats struct<" + ",".join(f"{k}:int" for k in STATS) + ">, description string")
    parsed = rows.select(*[c for c in rows.columns if c != json], x.alias("x")).filter("x.name IS NOT NULL")
    stats = F.struct(*[F.coalesce(F.col(f"x.stats.{k}"), F.lit(v)).alias(k) for k, v in STATS.items()])
    return parsed.select(*[c for c in parsed.columns if c != "x"], "x.name", F.coalesce("x.type", F.lit("npc")).alias("type"), F.coalesce("x.level", F.lit(1)).alias("level"), stats.alias("stats"), "x.description")


def generated_variables(g: Story) -> DataFrame:
    json = F.expr("""CASE event_id % 4 WHEN 0 THEN concat('{"name": "v', event_id, '", "value": ', event_id, '}') WHEN 1 THEN '{"value": 3}' WHEN 2 THEN concat('{"name": "', event_type, '", "value": "x", "data_type": "string", "scope": "local"}') ELSE 'no json' END""")
    return typed_variables(g["events"].select("event_id", json.alias("j")), "j").select("event_id", "name", "value", "data_type", "scope")


def generated_characters(g: Story) -> DataFrame:
    json = F.expr("""CASE character_id % 2 WHEN 0 THEN concat('{"name": "', name, '", "type": "hero", "level": 5, "stats": {"hp": 7, "strength": ', character_id, '}}') ELSE concat('{"name": "', name, '"}') END""")
    return typed_characters(g["characters"].select("character_id", json.alias("j")), "j").select("character_id", "name", "type", "level", "stats.hp", "stats.strength", "stats.charisma")


def statements(text: Column, comment: str = "//", keep_tail: bool = False) -> Column:
    """Statements of a script: comment lines and blanks fall away, a semicolon at a line's end ends a statement. What
    follows the last one is dropped; keep_tail keeps it, and drops the semicolons."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith(comment))
    marked = F.array_join(F.transform(lines, lambda x: F.concat(x, F.when(x.endswith(";"), "\x02").otherwise("\x01"))), "")
    parts = F.transform(F.split(marked, "\x02"), lambda x: F.trim(F.translate(x, "\x01", " ")))
    whole = F.slice(parts, 1, F.size(parts) - 1)
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, ";+$", "")), lambda x: x != "") if keep_tail else whole


def statement_split(g: Story) -> DataFrame:
    scripts = g["source_lines"].groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("script"))
    return scripts.select("file", F.posexplode(statements(F.col("script"))).alias("i", "statement"))


#: How sources read their environment.
ENVIRONMENT = (r"""os\.getenv\(["']([^"']+)["']""", r"""os\.environ\[["'](.*?)["']\]""", r"""os\.environ\.get\(["']([^"']+)["']""", r"""getenv\(["']([^"']+)["']""", r"""environ\[["'](.*?)["']\]""", r"""environ\.get\(["']([^"']+)["']""")


def regex_line_scan(g: Story, patterns: tuple[str, ...] = ENVIRONMENT) -> DataFrame:
    """The distinct names that a line reads, by any of the patterns."""
    names = F.array_distinct(F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in patterns]))
    return g["source_lines"].select("file", "line", F.explode(names).alias("name"))


def location_connections(g: Story, place: int = 3) -> DataFrame:
    e = g["sna_edges"].select((F.col("src") % 25).alias("from_location"), (F.col("dst") % 25).alias("to_location")).distinct()
    return e.filter((F.col("from_location") == place) | (F.col("to_location") == place))


def query_hash(g: Story) -> DataFrame:
    return g["nation"].select("n_nationkey", F.md5(F.concat(F.col("n_name"), F.lit(':{"story_id": '), F.col("n_nationkey").cast("string"), F.lit("}"))).alias("key"))


def vector_topk(g: Story, query: int = 0, top: int = 10) -> DataFrame:
    """Cosine search for one stored vector inside every group (label); the query is a scalar of one row."""
    e = g["embeddings"].select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    q = e.filter(F.col("vec_id") == query).select(F.col("v").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    s = e.withColumn("q", q.scalar()).select("vec_id", "label", F.round(dot("v", "q") / F.sqrt(dot("v", "v") * dot("q", "q")), 6).alias("score"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= top)


def quest_ready(g: Story) -> DataFrame:
    """A customer's order is ready when all the customer's earlier orders are done."""
    o = g["orders"].select("o_orderkey", "o_custkey", "o_orderstatus")
    open_ = o.filter("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first_open"))
    return o.join(open_, "o_custkey", "left").select("o_orderkey", (F.col("first_open").isNull() | (F.col("o_orderkey") <= F.col("first_open"))).alias("ready"))


def objective_completion(g: Story) -> DataFrame:
    return g["lineitem"].groupBy("l_orderkey").agg(F.count("*").alias("objectives"), F.sum((F.col("l_linestatus") == "F").cast("int")).alias("done")).withColumn("complete", F.col("objectives") == F.col("done"))


def dialogue_dangling(g: Story) -> DataFrame:
    """Turns whose next turn is missing from the conversation."""
    t = g["turns"]
    have = t.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return t.select("conv_id", "turn").join(have, ["conv_id", "turn"], "left_anti")


def alert_severity_rows(g: Story) -> DataFrame:
    reason = F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 4 == 0, " Critical error").when(F.col("p_partkey") % 4 == 1, " Significant conflict").when(F.col("p_partkey") % 4 == 2, " Minor issue").otherwise(""))
    return g["part"].select("p_partkey", alert_severity(reason).alias("severity"))


def edge_sample(g: Story, n: int = 5) -> DataFrame:
    return g["sna_edges"].orderBy("type", "src", "dst").limit(n).select("type", "src", "dst")
