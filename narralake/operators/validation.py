"""Edge, record, schema and constraint rules as Column expressions; the first rule that fails names the error."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.plans.adapter import Story
from narralake.plans.storage import written

Rule = Callable[[], Column]
RULES: dict[str, Rule] = {}
c = F.col

#: What a rule may ask of an edge; columns that an edge table lacks count as null. Values of open properties are JSON text.
EDGE_COLUMNS = ("edge_type", "from_id", "from_created_at", "from_location", "from_location_id", "to_id", "to_valid_from", "to_valid_to", "to_scene_order", "to_location_id", "to_name", "to_data_type", "to_value", "to_is_on", "created_at", "updated_at", "ownership_start", "ownership_end")


def rule(name: str) -> Callable[[Rule], Rule]:
    """Register a rule: null where an edge passes, otherwise the message. Order of registration is order of evaluation."""

    def add(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return add


def _text(column: str) -> Column:
    return c(column).cast("string")


@rule("prevent_invalid_knows_edges")
def _invalid_knows() -> Column:
    own = c("edge_type") == "KNOWS"
    late = F.concat(F.lit("Knowledge valid from "), _text("to_valid_from"), F.lit(" but character created at "), _text("from_created_at"))
    return F.when(own & c("from_created_at").isNull(), "Character must have creation timestamp").when(own & c("to_valid_from").isNull(), "Knowledge must have valid_from timestamp").when(own & (c("to_valid_from") < c("from_created_at")), late)


@rule("prevent_relationship_self_loops")
def _self_loops() -> Column:
    own = c("edge_type") == "RELATIONSHIP"
    loop = F.concat(F.lit("Self-loop detected: character "), _text("from_id"), F.lit(" cannot have relationship with itself"))
    return F.when(own & (c("from_id").isNull() | c("to_id").isNull()), "Both nodes must have valid IDs").when(own & (c("from_id") == c("to_id")), loop)


@rule("validate_temporal_consistency")
def _temporal() -> Column:
    return F.when(c("created_at") > c("updated_at"), "created_at cannot be after updated_at").when((c("edge_type") == "KNOWS") & (c("to_valid_from") > c("to_valid_to")), "Knowledge valid_from cannot be after valid_to")


@rule("validate_ownership_temporal_logic")
def _ownership() -> Column:
    return F.when((c("edge_type") == "OWNS") & (c("ownership_start") > c("ownership_end")), "ownership_start cannot be after ownership_end")


@rule("validate_scene_order")
def _scene_order() -> Column:
    own = c("edge_type") == "PRESENT_IN"
    return F.when(own & c("to_scene_order").isNull(), "Scene must have scene_order").when(own & (c("to_scene_order") < 0), "Scene order must be non-negative")


def variable_error(kind: Column, value: Column) -> Column:
    """Null if a JSON value fits its declared type, or is absent."""
    quoted = value.startswith('"')
    inner = F.when(quoted, F.substring(value, 2, F.length(value) - 2)).otherwise(value)
    flag = ~quoted & value.isin("true", "false")
    whole = flag | F.when(quoted, F.trim(inner).rlike(r"^[+-]?[0-9]+$")).otherwise(inner.try_cast("double").isNotNull())
    real = flag | inner.try_cast("double").isNotNull()
    unfit = F.concat(F.lit("Value '"), inner, F.lit("' incompatible with "), kind)
    return F.when(kind.isNull() | value.isNull() | (value == "null"), None).when((kind == "integer") & ~whole, unfit).when((kind == "float") & ~real, unfit).when((kind == "string") & ~quoted, "Variable value must be a string").when((kind == "boolean") & ~F.lower(inner).isin("true", "false"), "Variable value must be boolean")


@rule("validate_rpg_variable")
def _variable() -> Column:
    return variable_error(c("to_data_type"), c("to_value"))


def switch_error(name: Column, is_on: Column) -> Column:
    """name and is_on as JSON; a row without is_on is no switch."""
    return F.when(is_on.isNull(), None).when(name.isNull() | ~name.startswith('"') | (name == '""'), "Switch name cannot be empty").when(~is_on.isin("true", "false"), "Switch is_on must be boolean")


@rule("validate_rpg_switch")
def _switch() -> Column:
    return switch_error(c("to_name"), c("to_is_on"))


@rule("validate_location_connection")
def _connection() -> Column:
    own = c("edge_type").isin("LOCATION_CONNECTION", "CONNECTED_TO") | c("from_location").isNotNull() | c("from_location_id").isNotNull()
    here, there = F.coalesce(_text("from_location_id"), _text("from_id")), F.coalesce(_text("to_location_id"), _text("to_id"))
    return F.when(own & (here.isNull() | there.isNull()), "Both locations must have identifiers").when(own & (here == there), "Location cannot connect to itself")


def validate_edges(edges: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Adds rule (the first that fails), error (empty if valid) and is_valid."""
    whole = edges.select("*", *[F.lit(None).cast("string").alias(n) for n in EDGE_COLUMNS if n not in edges.columns])
    messages = {name: r() for name, r in (rules or RULES).items()}
    first = F.coalesce(*[F.when(m.isNotNull(), name) for name, m in messages.items()])
    error = F.coalesce(*[F.concat(F.lit(f"Rule '{name}' failed: "), m) for name, m in messages.items()], F.lit(""))
    return whole.select(*edges.columns, first.alias("rule"), error.alias("error"), first.isNull().alias("is_valid"))


def edges_of(g: Story) -> DataFrame:
    """Raw edges of the driver's tables, eight for each fact: order and ship dates are independent, so many are invalid. The
    facts are written once and read for each kind apart, so that a kind plans only the rules that can meet it."""
    no = lambda kind="string": F.lit(None).cast(kind)
    kinds = {"edge_type": "string", "from_created_at": "int", "to_valid_from": "int", "to_valid_to": "int", "to_scene_order": "int", "created_at": "int", "updated_at": "int", "ownership_start": "int", "ownership_end": "int"}
    parts = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "order_day", "ship_day")
    facts = written(g["facts"].select(*parts), "facts")
    dashed = [x for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship_day") for x in (F.lit("-"), _text(n))][1:]
    knowledge_id = F.concat(*dashed)

    def edge(kind: str, **own: Column) -> DataFrame:
        return facts.select(*[(F.lit(kind) if n == "edge_type" else own[n] if n in own else no(kinds.get(n, "string"))).cast(kinds.get(n, "string")).alias(n) for n in EDGE_COLUMNS])

    order, ship, who, what, line = c("order_day"), c("ship_day"), c("l_suppkey").cast("string"), c("l_partkey").cast("string"), c("l_linenumber")
    value = F.expr("CASE l_linenumber WHEN 1 THEN '10' WHEN 2 THEN '\"ten\"' WHEN 3 THEN '\"true\"' WHEN 4 THEN 'true' WHEN 5 THEN '2.5' WHEN 6 THEN '\"7\"' ELSE 'null' END")
    kind = F.expr("CASE l_partkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'boolean' ELSE 'string' END")
    edges = [
        edge("KNOWS", from_id=who, to_id=knowledge_id, from_created_at=F.when(line != 7, order), to_valid_from=ship, to_valid_to=F.lit(19990101), created_at=ship, updated_at=ship),
        edge("OWNS", from_id=who, to_id=what, ownership_start=ship, ownership_end=order),
        edge("RELATIONSHIP", from_id=F.when(line != 7, who), to_id=(c("l_partkey") % 10 + 1).cast("string"), created_at=order, updated_at=ship),
        edge("PRESENT_IN", from_id=who, to_id=c("l_orderkey").cast("string"), to_scene_order=F.when(line != 7, line - 2)),
        edge("HAS_VARIABLE", from_id=who, to_id=what, to_data_type=kind, to_value=value),
        edge("HAS_SWITCH", from_id=who, to_id=what, to_name=F.expr("CASE WHEN l_linenumber = 1 THEN '\"\"' WHEN l_linenumber = 2 THEN '5' ELSE '\"Door\"' END"), to_is_on=F.expr("CASE l_linenumber WHEN 3 THEN '\"yes\"' WHEN 4 THEN 'true' WHEN 5 THEN NULL ELSE 'false' END")),
        edge("CONNECTED_TO", from_id=(c("l_suppkey") % 25).cast("string"), to_id=F.when(line != 7, (c("l_partkey") % 25).cast("string"))),
        edge("LEADS_TO", from_id=(c("l_suppkey") % 25).cast("string"), from_location=F.when(line < 3, "here"), to_id=(c("l_partkey") % 25).cast("string")),
    ]
    return reduce(DataFrame.unionAll, edges)


def validation_counts(g: Story) -> DataFrame:
    """Valid edges, and edges that fail, by type and rule."""
    return validate_edges(edges_of(g)).groupBy("edge_type", F.coalesce("rule", F.lit("")).alias("rule")).agg(F.count("*").alias("n"))


def validation_errors(g: Story) -> DataFrame:
    """Messages without the values that stand in them."""
    general = F.regexp_replace(F.regexp_replace("error", "'[^']*' incompatible", "incompatible"), " [0-9]+", "")
    return validate_edges(edges_of(g)).filter("NOT is_valid").groupBy(general.alias("error")).agg(F.count("*").alias("n"))


def validation_stats(g: Story) -> DataFrame:
    """Of each rule, none left out: edges seen and edges that failed it."""
    spark = g.spark
    rules = " UNION ALL ".join(f"SELECT '{n}' AS rule" for n in RULES)
    found = validate_edges(edges_of(g)).groupBy("rule").agg(F.count("*").alias("n"))
    total = found.agg(F.sum("n").alias("total")).withColumn("k", F.lit(1))
    named = spark.sql(rules).join(found.filter("rule IS NOT NULL"), "rule", "left").withColumn("k", F.lit(1))
    return named.join(total, "k").select("rule", F.coalesce("n", F.lit(0)).alias("failed"), "total")


def rpg_variables(g: Story) -> DataFrame:
    e = g["events"].select("event_id", F.expr("CASE event_id % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'boolean' ELSE 'string' END").alias("data_type"), F.expr("CASE event_id % 5 WHEN 0 THEN CAST(event_id AS STRING) WHEN 1 THEN concat('\"', event_type, '\"') WHEN 2 THEN '\"true\"' WHEN 3 THEN '2.5' ELSE 'true' END").alias("value"))
    return e.withColumn("is_valid", variable_error(c("data_type"), c("value")).isNull())


def rpg_switches(g: Story) -> DataFrame:
    p = g["part"].select("p_partkey", F.when(c("p_partkey") % 5 == 0, '""').otherwise(F.concat(F.lit('"'), "p_name", F.lit('"'))).alias("name"), F.when(c("p_partkey") % 7 == 0, '"yes"').when(c("p_partkey") % 7 == 1, '"true"').when(c("p_partkey") % 2 == 0, "true").otherwise("false").alias("is_on"))
    return p.withColumn("is_valid", switch_error(c("name"), c("is_on")).isNull())


def iso_time(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def temporal_error(valid_from: Column, valid_to: Column) -> Column:
    """Of two ISO times, Z accepted; an open end is valid."""
    unread = F.when(iso_time(valid_from).isNull() | (valid_to.isNotNull() & iso_time(valid_to).isNull()), "Temporal validation error")
    late = F.when(iso_time(valid_from) > iso_time(valid_to), F.concat(F.lit("valid_from ("), valid_from, F.lit(") must be <= valid_to ("), valid_to, F.lit(")")))
    return F.coalesce(unread, late)


def temporal_pair(g: Story) -> DataFrame:
    iso = lambda day: F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00"))
    start = F.when(c("l_linenumber") == 5, "soon").otherwise(F.concat(iso("o_orderdate"), F.lit("Z")))
    end = F.when(c("l_linenumber") != 6, F.concat(iso("l_shipdate"), F.lit("+00:00")))
    return g["facts"].select("knowledge_id", F.coalesce(temporal_error(start, end), F.lit("")).alias("error"))


#: Allowed values by property.
ENUMS = {
    "knowledge_type": ("factual", "relationship", "emotional", "social", "secret"),
    "importance_level": ("critical", "important", "minor"),
    "verification_status": ("confirmed", "suspected", "false", "unknown"),
    "location_type": ("city", "building", "room", "outdoor"),
    "accessibility": ("public", "private", "restricted", "secret"),
    "participation_level": ("active", "passive", "mentioned", "background"),
    "relationship_type": ("family", "friend", "enemy", "ally", "romantic", "professional", "stranger"),
    "emotional_valence": ("love", "like", "neutral", "dislike", "hate"),
    "relationship_status": ("current", "past", "complicated", "unknown"),
    "power_dynamic": ("equal", "dominant", "submissive", "complex"),
    "confidence_level": ("certain", "probable", "suspected", "rumored"),
    "sharing_restrictions": ("can_share", "must_keep_secret", "conditional_sharing"),
    "emotional_impact": ("positive", "negative", "neutral", "shocking"),
    "contradiction_type": ("factual", "temporal", "logical", "character_behavior"),
    "severity": ("critical", "major", "minor", "potential"),
    "resolution_status": ("unresolved", "resolved", "false_positive", "ignored"),
    "implication_strength": ("certain", "probable", "possible", "weak"),
    "location_accessibility": ("public", "private", "restricted", "secret"),
}
_BASE = {"story_id": {"required": True}, "user_id": {"required": True}, "valid_from": {}, "valid_to": {}, "created_at": {}, "updated_at": {}}
_ENUM = lambda name, **more: {"values": ENUMS[name], **more}
_RANGE = lambda lo, hi=None: {"type": "integer", "min": lo, **({"max": hi} if hi is not None else {})}
#: Properties of nodes and edges; a property without more is text or a time.
SCHEMA: dict[str, dict[str, dict[str, Any]]] = {
    "Character": {"character_id": {"required": True}, "name": {"required": True}, "aliases": {"type": "array"}, "description": {}, "role": {}, "first_appearance": {}, "last_mentioned": {}, "is_active": {"type": "boolean"}, "deleted_at": {}, **_BASE},
    "Knowledge": {"knowledge_id": {"required": True}, "content": {"required": True}, "knowledge_type": _ENUM("knowledge_type"), "importance_level": _ENUM("importance_level"), "source_scene": {}, "is_secret": {"type": "boolean"}, "verification_status": _ENUM("verification_status"), **_BASE},
    "Scene": {"scene_id": {"required": True}, "title": {}, "content": {}, "scene_order": {"type": "integer", "required": True}, "timestamp_in_story": {}, "location": {}, "characters_present": {"type": "array"}, "word_count": {"type": "integer"}, **_BASE},
    "Location": {"location_id": {"required": True}, "name": {"required": True}, "description": {}, "location_type": _ENUM("location_type"), "accessibility": _ENUM("accessibility"), "first_mentioned": {}, "is_active": {"type": "boolean"}, **_BASE},
    "Item": {"item_id": {"required": True}, "name": {"required": True}, "description": {}, "item_type": {"values": ("weapon", "tool", "clothing", "artifact")}, **_BASE},
    "Episode": {"episode_id": {"required": True}, "title": {}, "episode_type": {"values": ("Arc", "Chapter", "Thread")}, "pov_character_id": {}, "mood": {}, "significance_score": _RANGE(0, 10), "timestamp_in_story": {}, **_BASE},
    "KNOWS": {"learned_at": {"required": True}, "learned_from": {}, "confidence_level": _ENUM("confidence_level"), "is_current": {}, "sharing_restrictions": _ENUM("sharing_restrictions"), "emotional_impact": _ENUM("emotional_impact"), **_BASE},
    "RELATIONSHIP": {"relationship_type": _ENUM("relationship_type", required=True), "relationship_strength": _RANGE(1, 10), "trust_level": _RANGE(1, 10), "emotional_valence": _ENUM("emotional_valence"), "relationship_status": _ENUM("relationship_status"), "established_at": {}, "last_interaction": {}, "is_mutual": {}, "power_dynamic": _ENUM("power_dynamic"), "milestone": {}, "trigger_event_id": {}, "secret_level": _RANGE(0, 10), **_BASE},
    "PRESENT_IN": {"arrival_time": {}, "departure_time": {}, "participation_level": _ENUM("participation_level"), "character_state": {}, "dialogue_count": _RANGE(0), "actions_performed": {}, **_BASE},
    "CONTRADICTS": {"contradiction_type": _ENUM("contradiction_type"), "severity": _ENUM("severity"), "detected_at": {}, "resolution_status": _ENUM("resolution_status"), "resolution_notes": {}, **_BASE},
    "IMPLIES": {"implication_strength": _ENUM("implication_strength"), "logical_basis": {}, **_BASE},
}
EDGE_KINDS = ("KNOWS", "RELATIONSHIP", "PRESENT_IN", "CONTRADICTS", "IMPLIES")


def property_error(kind: str, name: str, value: Column, data_type: str, schema: dict[str, dict[str, dict[str, Any]]] = SCHEMA) -> Column:
    """Null if a column's value fits; data_type is the column's. Edges' properties know no booleans and arrays."""
    what = "Relationship type" if kind in EDGE_KINDS else "Entity type"
    owner = "relationship" if kind in EDGE_KINDS else "entity"
    if kind not in schema:
        return F.lit(f"{what} '{kind}' not found in schema")
    if name not in schema[kind]:
        return F.lit(f"Property '{name}' not found for {owner} '{kind}'")
    own = schema[kind][name]
    text = value.cast("string") if not data_type.startswith(("array", "map", "struct")) else F.to_json(value)
    found = [F.when(value.isNull(), f"Required property '{name}' cannot be null")] if own.get("required") else []
    if "values" in own:
        found.append(F.when(value.isNull() | ~text.isin(*own["values"]), F.concat(F.lit("Value '"), F.coalesce(text, F.lit("None")), F.lit(f"' not in allowed enum values: {list(own['values'])}"))))
    expected = own.get("type")
    fits = {"integer": ("tinyint", "smallint", "int", "bigint"), "boolean": ("boolean",), "array": ("array",)}
    if expected and not (kind in EDGE_KINDS and expected != "integer"):
        if not data_type.startswith(fits[expected]):
            found.append(F.lit(f"Expected {expected}, got {data_type}"))
        else:
            found.append(F.when(value.isNull(), f"Expected {expected}, got null"))
            if "min" in own:
                found.append(F.when(value < own["min"], F.concat(F.lit("Value "), text, F.lit(f" below minimum {own['min']}"))))
            if "max" in own:
                found.append(F.when(value > own["max"], F.concat(F.lit("Value "), text, F.lit(f" above maximum {own['max']}"))))
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def property_violations(rows: DataFrame, kind: str, schema: dict[str, dict[str, dict[str, Any]]] = SCHEMA) -> DataFrame:
    """(kind, property, error, n) over all columns of a table, in one pass."""
    errors = F.array_compact(F.array(*[F.when(e.isNotNull(), F.struct(F.lit(n).alias("property"), e.alias("error"))) for n, t in rows.dtypes for e in [property_error(kind, n, c(n), t, schema)]]))
    return rows.select(F.explode(errors).alias("x")).groupBy(F.lit(kind).alias("kind"), "x.property", "x.error").agg(F.count("*").alias("n"))


def _stated_knowledge(g: Story) -> DataFrame:
    """Knowledge as its schema reads it. Properties that are only required say whether they are there, and the part's texts
    are joined last, so that no text is shuffled with the lines."""
    there = lambda *names: F.when(~missing(*names), True)
    owner = g["characters"].select("story_id", "user_id").distinct()
    own = g["supplier"].select("s_suppkey", c("s_nationkey").alias("story_id")).join(owner, "story_id").select("s_suppkey", there("story_id").alias("story_id"), there("user_id").alias("user_id"))
    lines = g["lineitem"].select("l_orderkey", "l_partkey", "l_suppkey", there("l_linenumber", "l_shipdate").alias("knowledge_id"), (c("l_linenumber") >= 6).alias("is_secret"), F.coalesce(c("l_linestatus") == "O", F.lit(False)).alias("open"))
    part = g["part"].select("p_partkey", there("p_name").alias("content"), c("p_type").alias("knowledge_type"), F.expr("CASE WHEN p_size <= 15 THEN 'low' WHEN p_size <= 35 THEN 'medium' ELSE 'high' END").alias("importance_level"))
    facts = lines.join(g["orders"].select("o_orderkey"), c("l_orderkey") == c("o_orderkey")).join(own, c("l_suppkey") == c("s_suppkey")).join(part, c("l_partkey") == c("p_partkey"))
    return facts.select("knowledge_id", "content", "knowledge_type", "importance_level", "is_secret", F.when(c("open"), "unverified").otherwise("verified").alias("verification_status"), "story_id", "user_id")


def schema_property(g: Story) -> DataFrame:
    tables = {
        "Character": g["characters"],
        "Knowledge": _stated_knowledge(g),
        "Location": g["locations"].select(c("location_id").alias("location_id"), "name", "accessibility"),
        "RELATIONSHIP": g["relationships"].select("relationship_type", "relationship_strength", "trust_level", "emotional_valence", "established_at"),
        "PRESENT_IN": g["present_in"].select("participation_level", (c("dialogue_count") - 2).alias("dialogue_count"), "character_state"),
    }
    # What a link says of itself comes from its line, so links are formed only if some line says what the schema doesn't allow.
    said = g["lineitem"].filter("l_returnflag = 'R'").select(F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' ELSE 'potential' END").alias("severity"), F.expr("CASE WHEN l_linestatus = 'O' THEN 'unresolved' ELSE 'resolved' END").alias("resolution_status"))
    if not property_violations(said, "CONTRADICTS").isEmpty():
        tables["CONTRADICTS"] = g["contradicts"].select("severity", "resolution_status", "detected_at")
    return reduce(DataFrame.unionByName, [property_violations(df, kind) for kind, df in tables.items()])


def repeated(*columns: str) -> Column:
    """Whether a row is the second one of its key: as many rows as there are keys that repeat. Rows are sorted by key after
    the shuffle; a hash table of keys that hardly ever repeat would hold all rows of a task before it."""
    return F.row_number().over(Window.partitionBy(*columns).orderBy(*columns)) == 2


def missing(*columns: str) -> Column:
    return reduce(lambda a, b: a | b, [c(x).isNull() for x in columns])


def out_of(column: str, low: int, high: int) -> Column:
    return ~c(column).between(low, high)


def not_among(column: str, values: tuple[str, ...]) -> Column:
    return ~c(column).isin(*values)


def counted(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(name, n): offending rows by check, all in one pass."""
    totals = rows.agg(*[F.count_if(bad).alias(name) for name, bad in checks.items()])
    return totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c(n).alias("n")) for n in checks])).alias("x")).select("x.*")


def constraint_violations(g: Story) -> DataFrame:
    """Offending rows (of unique keys, offending keys) by constraint; the names say the table and what must hold. A table is
    read once for its rows' checks, and once for each key that must be unique."""
    met = g.keep("met").select(c("n").alias("weight"), (c("lines") * 60).alias("overlap"), (c("n") % 12).alias("intensity"), F.when(c("n") % 3 == 0, "current").otherwise("over").alias("status"))
    characters, knowledge, scenes, places, items, episodes = (g[n] for n in ("characters", "knowledge", "scenes", "locations", "items", "episodes"))
    typed = g["parents"].select(c("episode").alias("episode_id"), F.expr("CASE WHEN parent IS NULL THEN 'Arc' WHEN episode % 10 = 0 THEN 'Chapter' WHEN episode % 10 = 5 THEN 'Scene' ELSE 'Thread' END").alias("episode_type"))
    scored = g["events"].select(F.floor(c("value") / 8).alias("significance_score"))
    bonds = g["relationships"].select("relationship_strength", "trust_level", c("established_at").alias("secret_level"))
    cast = g["casts"].join(scenes.select("scene_id", "scene_order"), "scene_id").select("story_id", "scene_order", "scene_id")
    by_order = Window.partitionBy("story_id", "scene_order").orderBy("scene_id")
    unique = {
        "episode_id_unique": (episodes, repeated("uuid")),
        "character_id_unique": (characters, repeated("character_id")),
        "scene_id_unique": (scenes, repeated("scene_id")),
        "location_id_unique": (places, repeated("location_id")),
        "item_id_unique": (items, repeated("item_id")),
        "character_name_per_story": (characters, repeated("name", "story_id", "user_id")),
        # The first row of the second scene of a story's place in order.
        "scene_order_per_story": (cast, (F.dense_rank().over(by_order) == 2) & (F.lag("scene_id").over(by_order) != c("scene_id"))),
        "location_name_per_story": (places, repeated("name")),
        "item_name_per_project": (items, repeated("name", "item_type")),
        "line_unique": (g["lineitem"].select("l_orderkey", "l_linenumber"), repeated("l_orderkey", "l_linenumber")),
    }
    stated = knowledge.select("knowledge_id", missing("content").alias("no_content"), missing("valid_to").alias("no_end")).withColumn("again", repeated("knowledge_id"))
    own = [
        counted(typed, {"episode_type_present": missing("episode_type"), "episode_type_allowed": not_among("episode_type", ("Arc", "Chapter", "Thread"))}),
        counted(episodes, {"episode_required": missing("uuid", "group_id", "created_at")}),
        counted(characters, {"character_required": missing("character_id", "name", "story_id", "user_id")}),
        counted(stated, {"knowledge_id_unique": c("again"), "knowledge_content_required": c("no_content"), "knowledge_end_required": c("no_end")}),
        counted(scored, {"significance_0_10": out_of("significance_score", 0, 10)}),
        counted(bonds, {"secret_level_0_10": out_of("secret_level", 0, 10), "strength_1_10": out_of("relationship_strength", 1, 10), "trust_1_10": out_of("trust_level", 1, 10)}),
        counted(met, {"intensity_1_10": out_of("intensity", 1, 10), "interaction_weight_1_10": out_of("weight", 1, 10), "screen_overlap_0_1440": out_of("overlap", 0, 1440), "partner_status_allowed": not_among("status", ("current", "past", "complicated", "unknown"))}),
        counted(alert_rows(g), {"alert_severity_allowed": not_among("severity", ("low", "medium", "high", "critical")), "alert_status_allowed": not_among("status", ("active", "resolved", "dismissed"))}),
    ]
    return reduce(DataFrame.unionAll, [*own, *[counted(rows.withColumn("again", again), {name: c("again")}) for name, (rows, again) in unique.items()]])


def alert_rows(g: Story) -> DataFrame:
    """Stored alerts, some of which break the table's checks."""
    return g["events"].filter("event_type = 'error'").select("event_id", F.expr("CASE event_id % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'fatal' END").alias("severity"), F.expr("CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'resolved' WHEN 2 THEN 'dismissed' ELSE 'lost' END").alias("status"))


def scene_gaps(g: Story) -> DataFrame:
    """Where the numbers of a customer's orders aren't one after another: orders of one customer are numbered by time, and the order of the numbers is checked against the ids'."""
    by_day, by_id = Window.partitionBy("o_custkey").orderBy("scene_order", "scene_id"), Window.partitionBy("o_custkey").orderBy("scene_id")
    numbered = g["scenes"].select("o_custkey", "scene_id", F.row_number().over(by_day).alias("number")).withColumn("previous", F.lag("number").over(by_id))
    return numbered.filter("number <> previous + 1").select("o_custkey", "scene_id", "previous", "number")


def early_presence(g: Story) -> DataFrame:
    """Presence in scenes before the character's first appearance: the first scene in which it speaks at least twice."""
    seen = g["present_in"].join(g["scenes"].select("scene_id", "scene_order"), "scene_id").select("character_id", "scene_order", "dialogue_count")
    first = seen.filter("dialogue_count >= 2").groupBy("character_id").agg(F.min("scene_order").alias("first_appearance"))
    return seen.join(first, "character_id").filter("scene_order < first_appearance").groupBy("character_id", "first_appearance").agg(F.count("*").alias("n"))


def early_ownership(g: Story) -> DataFrame:
    introduced = g["facts"].groupBy("l_partkey").agg(F.min("order_day").alias("introduced"))
    return g["owns"].join(introduced, c("item_id") == c("l_partkey")).filter("ownership_start < introduced").select("own_id", "item_id", "ownership_start", "introduced")


def schema_status(constraints: list[str], indexes: list[str]) -> tuple[int, str, list[str]]:
    """(score of 100, status, recommendations) of a schema from the names of its constraints and indexes."""
    has = {word: any(word in name for name in indexes) for word in ("story_id", "user_id", "temporal")}
    score = 25 * bool(constraints) + 25 * (len(indexes) > 10) + 20 * has["story_id"] + 20 * has["user_id"] + 10 * has["temporal"]
    wanted = [(not has["story_id"], "Add story_id indexes for data isolation"), (not has["user_id"], "Add user_id indexes for multi-tenancy"), (not has["temporal"], "Add temporal indexes for bi-temporal queries"), (len(constraints) < 5, "Add unique constraints for entity integrity"), (len(indexes) < 20, "Add performance indexes for common query patterns")]
    advice = [text for need, text in wanted if need] or ["Schema appears complete for story queries"]
    return score, "compatible" if score >= 80 else "partial" if score >= 50 else "incompatible", advice
