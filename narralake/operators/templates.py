"""Template queries over the story graph: pattern matches as equi joins, collections as sorted strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.operators.joins import among, before_pairs, crowded
from narralake.plans.adapter import Story, day
from narralake.plans.storage import written

#: Lines of a character that one task takes in order of time (about 50 MB).
CHARACTER_LINES = 200_000


def joined(*parts: str | Column) -> Column:
    return F.concat_ws(":", *parts)


def collected(column: Column, distinct: bool = True) -> Column:
    """The group's values as one string in order, which no engine's row order changes."""
    return F.array_join(F.array_sort((F.collect_set if distinct else F.collect_list)(column)), ",")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "critical", 1).when(severity == "major", 2).when(severity == "minor", 3).when(severity == "potential", 4).otherwise(5)


def _named(rows: DataFrame, column: str, name: str | None) -> DataFrame:
    return rows if name is None else rows.filter(F.col(column) == name)


def character_knowledge_at_time(g: Story, day: int, character_name: str | None = None) -> DataFrame:
    """What characters knew on a day; intervals are closed, and open-ended ones go on."""
    what = g["known"].filter((F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (F.col("valid_to") >= day)))
    who = _named(g["characters"], "name", character_name).select("character_id", "name")
    return what.join(who, "character_id").select("name", "knowledge_id", "content", "learned_at", "confidence_level", "emotional_impact", "valid_from")


def characters_in_scene(g: Story, scene_id: int | None = None) -> DataFrame:
    here = g["present_in"] if scene_id is None else g["present_in"].filter(F.col("scene_id") == scene_id)
    return here.join(g["characters"], "character_id").select("scene_id", "character_id", "name", "participation_level", "dialogue_count", "character_state")


def scene_location_details(g: Story, scene_id: int | None = None) -> DataFrame:
    here = g["occurs_in"] if scene_id is None else g["occurs_in"].filter(F.col("scene_id") == scene_id)
    return here.join(g["locations"], "location_id").select("scene_id", "location_id", "name", "time_of_day", "weather_conditions", "scene_duration")


def character_relationships_detailed(g: Story, character_name: str | None = None) -> DataFrame:
    c = g["characters"]
    a, b = c.select(F.col("character_id").alias("src"), F.col("name").alias("name_1")), c.select(F.col("character_id").alias("dst"), F.col("name").alias("name_2"))
    return g["relationships"].join(_named(a, "name_1", character_name), "src").join(b, "dst").select("name_1", "name_2", "relationship_type", "relationship_strength", "trust_level", "emotional_valence", "established_at", "updated_at")


def knowledge_by_type(g: Story, knowledge_type: str | None = None, importance_level: str | None = None) -> DataFrame:
    out = g["knowledge"]
    for name, value in (("knowledge_type", knowledge_type), ("importance_level", importance_level)):
        if value is not None:
            out = out.filter(F.col(name) == value)
    return out.select("knowledge_id", "content", "knowledge_type", "importance_level", "created_at")


def secret_knowledge(g: Story) -> DataFrame:
    secret = g["known"].filter(F.col("is_secret") & F.col("sharing_restrictions").isin("need_to_know", "top_secret"))
    return secret.join(g["characters"].select("character_id", "name"), "character_id").select("name", "knowledge_id", "content", "importance_level", "sharing_restrictions")


def unlinked(pairs: DataFrame, links: DataFrame, both_ways: bool = True) -> DataFrame:
    """Pairs (knowledge_id_1, knowledge_id_2) that no link (from_id, to_id) joins, in either direction or the given one."""
    one = links.select(F.col("from_id").alias("knowledge_id_1"), F.col("to_id").alias("knowledge_id_2"))
    if both_ways:
        one = one.unionAll(links.select(F.col("to_id").alias("knowledge_id_1"), F.col("from_id").alias("knowledge_id_2")))
    return pairs.join(one, ["knowledge_id_1", "knowledge_id_2"], "left_anti")


def temporal_knowledge_conflicts(g: Story) -> DataFrame:
    """Pairs of one character's knowledge, the second of which had ended when the first began. As many rows as there are
    such pairs; consistency.temporal_conflict_counts counts them without forming them."""
    k = written(g["known"].select("character_id", "knowledge_id", "valid_from", "valid_to"), "known")
    a = k.select("character_id", F.col("knowledge_id").alias("knowledge_id_1"), F.col("valid_from").alias("valid_from_1"))
    b = k.select("character_id", F.col("knowledge_id").alias("knowledge_id_2"), F.col("valid_to").alias("valid_to_2"))
    pairs = before_pairs(a, b, ["character_id"], "valid_from_1", "valid_to_2").filter("knowledge_id_1 <> knowledge_id_2")
    return unlinked(pairs, g["contradicts"], False).select("character_id", "knowledge_id_1", "knowledge_id_2", "valid_from_1", "valid_to_2")


def _conflicts_of_lines(g: Story) -> DataFrame:
    """`temporal_conflicts_of_each` of a graph whose keys don't repeat. Links lead to what begins no earlier and rows of one id
    have the same days, so that neither takes a partner away. Lines move twice, in numbers: to their order, and to
    their character, where what had ended is summed along time. A repeated id counts once for each of its rows."""
    lines = g["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(day("l_shipdate")).alias("ship_day"), F.coalesce(F.col("l_returnflag") != "N", F.lit(True)).alias("ends"))
    lines = among(among(lines, "l_partkey", g["part"], "p_partkey"), "l_suppkey", g["supplier"], "s_suppkey")
    orders = g["orders"].select(F.col("o_orderkey").alias("l_orderkey"), F.expr(day("o_orderdate")).alias("order_day"))
    rows = lines.join(orders, "l_orderkey").withColumnRenamed("l_suppkey", "character_id").repartition("character_id")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))  # noqa: E731  # SQL's concat skips nulls
    number = F.concat_ws("-", *[part(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "character_id", "ship_day")])
    rows = rows.filter("order_day IS NOT NULL OR ship_day IS NOT NULL").select("character_id", number.alias("id"), F.least("order_day", "ship_day").alias("begin"), F.when(F.col("ends"), F.greatest("order_day", "ship_day")).alias("end"))
    none, no_id = F.lit(None).cast("int"), F.lit(None).cast("string")
    asked = F.struct((2 * F.col("begin")).alias("mark"), F.col("id").alias("own"), none.alias("end"), no_id.alias("last"))
    ended = F.struct((2 * F.col("end") + 1).alias("mark"), no_id.alias("own"), F.col("end").alias("end"), F.col("id").alias("last"))
    marks = rows.select("character_id", F.explode(F.when(F.col("end").isNull(), F.array(asked)).otherwise(F.array(asked, ended))).alias("x")).select("character_id", "x.*")
    by = Window.partitionBy("character_id").orderBy("mark", "own")
    upto, same = by.rowsBetween(Window.unboundedPreceding, 0), by.rangeBetween(0, 0)
    found = marks.select("character_id", F.col("own").alias("knowledge_id_1"), (F.count("last").over(upto) * F.count("own").over(same)).alias("n"), F.max("end").over(upto).alias("last_end"), F.max("last").over(upto).alias("last_id"), F.lag("own").over(by).alias("before"))
    return found.filter("knowledge_id_1 IS NOT NULL AND n > 0 AND NOT before <=> knowledge_id_1").drop("before")


def temporal_conflicts_of_each(g: Story) -> DataFrame:
    """The pairs of `temporal_knowledge_conflicts` by their first knowledge: character_id, knowledge_id_1, n, last_end, last_id
    (the greatest end and id among the second ones), without forming them. What had ended is carried along time from month
    to month, so that a task gets a character's month. Only knowledge that a link, or its own id, takes a partner from is
    paired, as what is left may have another greatest end. While keys don't repeat and no character has more than
    CHARACTER_LINES lines, `_conflicts_of_lines` finds the same with less to move."""
    keys = {"part": "p_partkey", "orders": "o_orderkey", "supplier": "s_suppkey"}
    if isinstance(g, Story) and all(g.unique(t, c) for t, c in keys.items()) and not crowded(g["lineitem"].filter("l_suppkey IS NOT NULL"), ["l_suppkey"], CHARACTER_LINES):
        return _conflicts_of_lines(g)
    k = written(g["known"].select("character_id", "knowledge_id", "valid_from", "valid_to"), "known")
    ends = k.filter("valid_to IS NOT NULL")
    month = lambda t: F.floor(F.col(t) / 100).cast("int").alias("month")
    sums = [F.count("*").alias("n"), F.max("valid_to").alias("last_end"), F.max("knowledge_id").alias("last_id")]
    none, no_id, no = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("long")
    begun = k.filter("valid_from IS NOT NULL")
    # Every month that something begins in, with the sums of the months before it.
    monthly = ends.groupBy("character_id", month("valid_to")).agg(*sums).unionByName(begun.select("character_id", month("valid_from")).distinct().select("*", F.lit(0).cast("long").alias("n"), none.alias("last_end"), no_id.alias("last_id")))
    past = Window.partitionBy("character_id").orderBy("month").rangeBetween(Window.unboundedPreceding, -1)
    carried = monthly.select("character_id", "month", F.lit(0).alias("t"), F.lit(0).alias("later"), no_id.alias("knowledge_id"), F.sum("n").over(past).alias("n"), F.max("last_end").over(past).alias("last_end"), F.max("last_id").over(past).alias("last_id")).dropDuplicates(["character_id", "month"])
    ended = ends.select("character_id", month("valid_to"), F.col("valid_to").alias("t"), F.lit(1).alias("later"), no_id.alias("knowledge_id"), F.lit(1).cast("long").alias("n"), F.col("valid_to").alias("last_end"), F.col("knowledge_id").alias("last_id"))
    asked = begun.select("character_id", month("valid_from"), F.col("valid_from").alias("t"), F.lit(0).alias("later"), "knowledge_id", no.alias("n"), none.alias("last_end"), no_id.alias("last_id"))
    upto = Window.partitionBy("character_id", "month").orderBy("t", "later").rowsBetween(Window.unboundedPreceding, 0)
    marks = carried.unionByName(ended).unionByName(asked)
    found = marks.select("character_id", F.col("knowledge_id").alias("knowledge_id_1"), *[f(c).over(upto).alias(c) for f, c in ((F.sum, "n"), (F.max, "last_end"), (F.max, "last_id"))]).filter("knowledge_id_1 IS NOT NULL AND n > 0")
    a = k.select("character_id", F.col("knowledge_id").alias("knowledge_id_1"), F.col("valid_from").alias("valid_from_1"))
    b = k.select("character_id", F.col("knowledge_id").alias("knowledge_id_2"), F.col("valid_to").alias("valid_to_2"))
    links = g["contradicts"].select(F.col("from_id").alias("knowledge_id_1"), F.col("to_id").alias("knowledge_id_2"))
    less = links.join(a, "knowledge_id_1").join(b.withColumnRenamed("character_id", "other"), "knowledge_id_2").filter("character_id = other AND valid_from_1 > valid_to_2").select("character_id", "knowledge_id_1")
    # Ids that are repeated, by their hash: one that only shares a hash with another is paired too, which changes nothing.
    number = F.xxhash64("character_id", "knowledge_id").alias("number")
    repeated = k.groupBy(number).agg(F.count("*").alias("c")).filter("c > 1").select("number")
    own = k.filter("valid_from > valid_to").unionAll(k.withColumn("number", number).join(repeated, "number", "left_semi").drop("number")).select("character_id", F.col("knowledge_id").alias("knowledge_id_1"))
    less = written(less.unionAll(own).distinct(), "less")
    if less.isEmpty():
        return found
    pairs = before_pairs(a.join(less, ["character_id", "knowledge_id_1"], "left_semi"), b, ["character_id"], "valid_from_1", "valid_to_2").filter("knowledge_id_1 <> knowledge_id_2")
    exact = unlinked(pairs, g["contradicts"], False).groupBy("character_id", "knowledge_id_1").agg(F.count("*").alias("n"), F.max("valid_to_2").alias("last_end"), F.max("knowledge_id_2").alias("last_id"))
    return found.join(less, ["character_id", "knowledge_id_1"], "left_anti").unionByName(exact)


def relationship_milestones(g: Story, start: int, end: int, character_a: str | None = None, character_b: str | None = None) -> DataFrame:
    """Both orientations of every relationship with a date in the closed range, or of those of two characters."""
    cols = ["relationship_type", "relationship_strength", "trust_level", "emotional_valence", "established_at", "updated_at"]
    r = g["relationships"]
    both = r.select("src", "dst", *cols).unionAll(r.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *cols))
    dated = both.filter(F.col("established_at").between(start, end) | F.col("updated_at").between(start, end))
    c = g["characters"]
    a, b = (_named(c.select(F.col("character_id").alias(k), F.col("name").alias(n)), n, who) for k, n, who in (("src", "character_a", character_a), ("dst", "character_b", character_b)))
    return dated.join(a, "src").join(b, "dst").select("character_a", "character_b", *cols)


def _own_conflicts(g: Story) -> DataFrame:
    """knowledge_id, content, verification_status, conflicts where keys don't repeat: an id then has one character, content and
    order date, so its links lead to rows beside it in time, and rows of one id lie side by side."""
    f = g["lineitem"].join(g["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(g["part"], F.col("l_partkey") == F.col("p_partkey")).join(g["supplier"].select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    id_ = F.concat(*[x for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.expr(day("l_shipdate"))) for x in (F.lit("-"), (F.col(n) if isinstance(n, str) else n).cast("string"))][1:])
    rows = f.select("l_suppkey", "l_linenumber", "l_linestatus", "l_returnflag", F.col("p_name").alias("content"), id_.alias("knowledge_id"), F.least(F.expr(day("o_orderdate")), F.expr(day("l_shipdate"))).alias("at"))
    by = Window.partitionBy("l_suppkey", "content").orderBy("at", "knowledge_id")
    severity = F.expr("CASE l_linenumber % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' ELSE 'potential' END")
    state = F.when(F.col("l_linestatus") == "O", "unresolved").otherwise("resolved")
    said = lambda other: F.concat_ws(":", other, severity, state)
    to = F.lead("knowledge_id").over(by)
    linked = rows.withColumn("to_id", to).withColumn("link", (F.col("l_returnflag") == "R") & F.col("to_id").isNotNull())
    # A link of the row before stands at this row, which it leads to; it says that row's severity and state.
    met = linked.withColumn("onto", F.when(F.col("link"), said(F.col("to_id")))).withColumn("from", F.lag(F.when(F.col("link"), said(F.col("knowledge_id")))).over(by))
    same = Window.partitionBy("l_suppkey", "content", "at", "knowledge_id")
    around = F.array_distinct(F.concat(F.collect_set("onto").over(same), F.collect_set("from").over(same)))
    conflicts = F.when(F.col("knowledge_id").isNull(), "").otherwise(F.array_join(F.array_sort(around), ","))
    return met.select("knowledge_id", "content", F.when(F.col("l_linestatus") == "O", "unverified").otherwise("verified").alias("verification_status"), conflicts.alias("conflicts"))


def plot_thread_resolution_status(g: Story, verification_status: str | None = None) -> DataFrame:
    if type(g) is Story and all(g.unique(t, k) for t, k in (("part", "p_partkey"), ("orders", "o_orderkey"), ("supplier", "s_suppkey"))):
        own = _own_conflicts(g)
        return own if verification_status is None else own.filter(F.col("verification_status") == verification_status)
    k = g["knowledge"] if verification_status is None else g["knowledge"].filter(F.col("verification_status") == verification_status)
    c = g["contradicts"]
    both = c.select(F.col("from_id").alias("knowledge_id"), F.col("to_id").alias("other"), "severity", "resolution_status").unionAll(c.select(F.col("to_id").alias("knowledge_id"), F.col("from_id").alias("other"), "severity", "resolution_status"))
    around = both.groupBy("knowledge_id").agg(collected(joined("other", "severity", "resolution_status")).alias("conflicts"))
    return k.select("knowledge_id", "content", "verification_status").join(around, "knowledge_id", "left").na.fill("", ["conflicts"])


def story_timeline_detailed(g: Story) -> DataFrame:
    cast = g["present_in"].groupBy("scene_id").agg(collected(joined(F.col("character_id").cast("string"), "participation_level")).alias("cast"))
    where = g["occurs_in"].join(g["locations"], "location_id").select("scene_id", F.col("name").alias("location"), "time_of_day", "weather_conditions")
    return g["scenes"].select("scene_id", "scene_order").join(where, "scene_id", "left").join(cast, "scene_id", "left")


def knowledge_propagation(g: Story) -> DataFrame:
    k = g["knowledge"]
    a, b = k.select(F.col("knowledge_id").alias("from_id"), F.col("content").alias("content_1")), k.select(F.col("knowledge_id").alias("to_id"), F.col("content").alias("content_2"))
    return g["implies"].join(a, "from_id").join(b, "to_id").select("from_id", "to_id", "content_1", "content_2", "implication_strength", "logical_basis")


def contradictions_by_severity(g: Story, severity: str | None = None) -> DataFrame:
    return _named(g["contradicts"], "severity", severity).filter("resolution_status = 'unresolved'").select("from_id", "to_id", "severity", "detected_at", severity_rank(F.col("severity")).alias("severity_rank"))


def character_activity_timeline(g: Story, character_name: str | None = None) -> DataFrame:
    """A character's distinct scenes and knowledge, in order. They are gathered apart, so that no product of the two is formed."""
    s = g["present_in"].groupBy("character_id").agg(F.array_join(F.array_sort(F.collect_set("scene_id")), ",").alias("scenes"))
    k = g["knows"].groupBy("character_id").agg(collected(F.col("knowledge_id")).alias("knowledge"))
    return _named(g["characters"], "name", character_name).select("character_id", "name").join(s, "character_id", "left").join(k, "character_id", "left")


def location_accessibility(g: Story, accessibility: str | None = None) -> DataFrame:
    n = g["occurs_in"].groupBy("location_id").agg(F.count("scene_id").alias("scene_count"))
    return _named(g["locations"], "accessibility", accessibility).join(n, "location_id", "left").na.fill(0, ["scene_count"]).select("location_id", "name", "accessibility", "scene_count")


def relationship_strength_analysis(g: Story, min_strength: int | None = None) -> DataFrame:
    r = character_relationships_detailed(g)
    r = r if min_strength is None else r.filter(F.col("relationship_strength") >= min_strength)
    return r.select("name_1", "name_2", "relationship_strength", "trust_level")


def character_trust_network(g: Story, min_trust_level: int) -> DataFrame:
    return character_relationships_detailed(g).filter(F.col("trust_level") >= min_trust_level).select("name_1", "name_2", "trust_level", "relationship_type")


def knowledge_sharing_patterns(g: Story) -> DataFrame:
    """Pairs of a story's characters that came to know of the same part, the first before the second."""
    k = g["facts"].select("story_id", "l_partkey", "l_suppkey", "ship_day")
    a, b = k.toDF("story_id", "l_partkey", "character_1", "learned_at_1"), k.toDF("story_id", "l_partkey", "character_2", "learned_at_2")
    return a.join(b, ["story_id", "l_partkey"]).filter("character_1 <> character_2 AND learned_at_1 < learned_at_2").select("l_partkey", "character_1", "character_2", "learned_at_1", "learned_at_2")


def scene_participation_analysis(g: Story) -> DataFrame:
    p = g["present_in"].groupBy("scene_id").agg(collected(joined(F.col("character_id").cast("string"), "participation_level", F.col("dialogue_count").cast("string")), False).alias("participants"), F.count("*").alias("n"))
    return g["scenes"].select("scene_id").join(p, "scene_id", "left").na.fill(0, ["n"])


def all_relationship_pairs(g: Story) -> DataFrame:
    return g["sna_edges"].select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def strong_ties(g: Story, strength: int = 7, trust: int = 8) -> DataFrame:
    return character_relationships_detailed(g).filter((F.col("relationship_strength") >= strength) & (F.col("trust_level") >= trust)).select("name_1", "name_2", "relationship_strength", "trust_level")


def must_keep_secret(g: Story) -> DataFrame:
    return secret_knowledge(g).filter("sharing_restrictions = 'top_secret'").select("name", "knowledge_id", "content")


def ownership_history(g: Story, item_name: str | None = None) -> DataFrame:
    return g["owns"].join(_named(g["items"], "name", item_name), "item_id").join(g["characters"].select("character_id", F.col("name").alias("owner")), "character_id").select("item_id", "name", "owner", "ownership_start", "ownership_end", "transfer_method")


def current_owner(g: Story) -> DataFrame:
    latest = Window.partitionBy("story_id", "item_id").orderBy(F.col("ownership_start").desc(), F.col("own_id").desc())
    return g["owns"].filter("ownership_end IS NULL").withColumn("r", F.row_number().over(latest)).filter("r = 1").select("story_id", "item_id", "character_id", "ownership_start")


def item_transfer_chain(g: Story, item_id: int | None = None) -> DataFrame:
    previous = g["characters"].select(F.col("character_id").alias("obtained_from"), F.col("name").alias("previous_owner"))
    owned = g["owns"] if item_id is None else g["owns"].filter(F.col("item_id") == item_id)
    return owned.join(g["characters"].select("character_id", F.col("name").alias("owner")), "character_id").join(previous, "obtained_from", "left").select("item_id", "own_id", "owner", "previous_owner", "ownership_start", "transfer_method")
