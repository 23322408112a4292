"""Histories, as-of reads, episode logs, ownership and relationship evolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.operators import search
from narralake.plans.adapter import Story, day
from narralake.plans.storage import discard, written


def episodes_last_n(g: Story, reference: str = "2024-01-20 00:00:00", n: int = 5) -> DataFrame:
    """The newest n episodes up to a time, for every group; the limit per group is applied before the shuffle as well."""
    w = Window.partitionBy("group_id").orderBy(F.desc("created_at"), F.desc("uuid"))
    return g["episodes"].filter(F.col("created_at") <= F.lit(reference).cast("timestamp_ntz")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("group_id", "uuid", "body", "r")


def search_memory(g: Story, query: str = "the king was dead", top: int = 5) -> DataFrame:
    """The best turns of every conversation for a query, ranked by BM25 inside the conversation."""
    found = search.search(search.build(g["turns"], "conv_id", "turn", "text"), search.terms_of(g.spark, query), top)
    return found.select(F.col("group").alias("conv_id"), F.col("key").alias("turn"), "score", "place")


def character_knowledge(g: Story, names: tuple[str, ...] = ("Alice", "Bob", "Carol"), top: int = 20) -> DataFrame:
    """What a conversation holds on each character: up to `top` turns, ranked for the character's name."""
    t = g["turns"]
    who = t.select("conv_id").distinct().select("conv_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    found = search.search(search.build(t, "conv_id", "turn", "text"), search.queries_of(who, "name", "conv_id", "name"), top)
    return found.select(F.col("query").alias("name"), F.col("group").alias("conv_id"), F.col("key").alias("turn"), "score", "place")


def as_of_snapshot(g: Story, reference: str = "2024-01-20 00:00:00", word: str = "purchase", last: int = 20) -> DataFrame:
    """Of every group: the newest `last` episodes up to a time, and the newest that hold a word, tagged; repeats stay."""
    before = g["episodes"].filter(F.col("created_at") <= F.lit(reference).cast("timestamp_ntz"))
    newest = F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("created_at"), F.desc("uuid")))
    pick = lambda rows, tag: rows.withColumn("r", newest).filter(F.col("r") <= last).select("group_id", "uuid", "body", F.lit(tag).alias("tag"))
    return pick(before, "TEMPORAL_REFERENCE").unionAll(pick(before.filter(F.col("body").contains(word)), "SEARCH_MATCH"))


def temporal_context(g: Story, n: int = 5) -> DataFrame:
    """For every episode, how many of its group's are among the n before it, at its time, and among the n after it."""
    w, same = Window.partitionBy("group_id").orderBy("created_at", "uuid"), Window.partitionBy("group_id", "created_at")
    return g["episodes"].select("group_id", "uuid", F.count("*").over(w.rowsBetween(-n, -1)).alias("before"), F.count("*").over(same).alias("at"), F.count("*").over(w.rowsBetween(1, n)).alias("after"))


def relationship_by_year(g: Story) -> DataFrame:
    return g["years"].select("src", "dst", "year", "strength")


def evolution_delta(g: Story) -> DataFrame:
    w = Window.partitionBy("src", "dst").orderBy("year")
    return relationship_by_year(g).withColumn("before", F.lag("strength").over(w)).filter("before IS NOT NULL").select("src", "dst", "year", "before", "strength", (F.col("strength") - F.col("before")).alias("delta"))


def evolution_pair_series(g: Story) -> DataFrame:
    by = relationship_by_year(g)
    return by.groupBy("src", "dst").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", "strength"))), lambda x: F.concat_ws("=", x["year"].cast("string"), x["strength"].cast("string"))), ",").alias("series"))


def milestones_tension_spikes(g: Story, high: float = 0.8, low: float = 0.3) -> DataFrame:
    """Strengths as shares of a pair's best year: from `high` on a milestone, unless they are allies then; under `low` a tension spike."""
    b = g["bonds"].withColumn("after", F.col("strength") / F.max("strength").over(Window.partitionBy("src", "dst")))
    kind = F.when((F.col("after") >= high) & (F.col("relationship_type") != "ally"), "milestone").when(F.col("after") < low, "tension_spike")
    return b.select("src", "dst", F.col("created_at").alias("year"), F.round("after", 6).alias("after"), kind.alias("kind")).filter("kind IS NOT NULL")


def episode_tree(g: Story) -> DataFrame:
    """Region over nation over customer, as (episode, parent)."""
    name = lambda kind, key: F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"))
    arcs = g["region"].select(name("arc", "r_regionkey").alias("episode"), F.lit(None).cast("string").alias("parent"))
    chapters = g["nation"].select(name("chapter", "n_nationkey"), name("arc", "n_regionkey"))
    return arcs.unionAll(chapters).unionAll(g["customer"].select(name("thread", "c_custkey"), name("chapter", "c_nationkey")))


def episode_hierarchy(g: Story) -> DataFrame:
    """episode, parent, depth, children in order and their number. Depths follow level by level until none is below."""
    tree = written(episode_tree(g), "tree")
    level = done = tree.filter("parent IS NULL").select("episode", F.lit(0).alias("depth"))
    depth = 0
    while True:
        depth += 1
        level = written(tree.select("episode", "parent").join(level.select(F.col("episode").alias("parent")), "parent").select("episode", F.lit(depth).alias("depth")), "level")
        if level.isEmpty():
            break
        done = done.unionByName(level)
    below = tree.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("episode")).agg(F.count("*").alias("n_children"), F.array_join(F.array_sort(F.collect_list("episode")), ",").alias("children"))
    return tree.join(done, "episode").join(below, "episode", "left").select("episode", "parent", "depth", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("children", F.lit("")).alias("children"))


def ring_members(links: DataFrame) -> DataFrame:
    """links (episode, parent), a parent at most for each -> the episodes that are their own ancestors. Jumps are doubled
    until they are longer than any path, so what still has an ancestor has one on a ring."""
    jump = written(links.filter("parent IS NOT NULL").select("episode", "parent"), "jump")
    left = jump.count()
    for _ in range(left.bit_length()):
        before, jump = jump, written(jump.join(jump.select(F.col("episode").alias("parent"), F.col("parent").alias("top")), "parent").select("episode", F.col("top").alias("parent")), "jump")
        discard(before)
    return jump.select(F.col("parent").alias("episode")).distinct()


def hierarchy_cycles(g: Story) -> DataFrame:
    return ring_members(g["parents"])


def continuity_links(g: Story) -> DataFrame:
    """The log of typed links between episodes: appended as they are found."""
    link = lambda rows, kind: rows.select("from_id", "to_id", F.lit(kind).alias("type"))
    parents = g["parents"].filter("parent IS NOT NULL").select(F.col("parent").alias("from_id"), F.col("episode").alias("to_id"))
    resolved = foreshadows(g).join(unresolved_foreshadows(g), ["from_id", "to_id"], "left_anti").select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return append_links(link(parents, "PARENT_OF"), [link(foreshadows(g), "FORESHADOWS"), link(resolved, "RESOLVES")])


def append_links(log: DataFrame, more: list[DataFrame]) -> DataFrame:
    """A log of links (from_id, to_id, type) with further ones; a link that is there already isn't repeated."""
    for rows in more:
        log = log.unionByName(rows)
    return log.distinct()


def foreshadows(g: Story) -> DataFrame:
    """Every view foreshadows the user's next purchase."""
    w = Window.partitionBy("group_id").orderBy("created_at", "uuid").rowsBetween(1, Window.unboundedFollowing)
    next_ = F.first(F.when(F.col("body") == "purchase", F.col("uuid")), ignorenulls=True).over(w)
    return g["episodes"].withColumn("target", next_).filter("body = 'view' AND target IS NOT NULL").select(F.col("uuid").alias("from_id"), F.col("target").alias("to_id"))


def unresolved_foreshadows(g: Story, bound: float = 50.0) -> DataFrame:
    resolved = g["episodes"].filter((F.col("body") == "purchase") & (F.col("value") > bound)).select(F.col("uuid").alias("to_id"))
    return foreshadows(g).join(resolved, "to_id", "left_anti").select("from_id", "to_id")


def story_graph_counts(g: Story) -> DataFrame:
    """Rows of each table of the snapshot. Those that are as many as their source's rows are counted there once; links are
    counted in the same pass over the facts, which are joined with parts last, so that the first window lies as they do."""
    lines = g["lineitem"].join(g["orders"].select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(g["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(g["part"].select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    order_day, ship_day = F.expr(day("o_orderdate")), F.expr(day("l_shipdate"))
    rows = lines.select("s_nationkey", "l_suppkey", "l_partkey", "p_name", "l_orderkey", "l_linenumber", "l_returnflag", ship_day.alias("ship_day"), F.least(order_day, ship_day).alias("at"))
    id_ = F.concat_ws("-", *[F.col(n).cast("string") for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ship_day")])
    id_ = F.when(F.col("l_linenumber").isNotNull() & F.col("ship_day").isNotNull(), id_)

    def links(flag: str, *keys: str) -> Column:
        """Whether a row's flag makes a link to the next row of its group, which must have an id."""
        next_ = F.lead(F.col("l_linenumber").isNotNull() & F.col("ship_day").isNotNull()).over(Window.partitionBy(*keys).orderBy("at", id_))
        return (F.col("l_returnflag") == flag) & F.coalesce(next_, F.lit(False))

    found = rows.withColumn("implies", links("A", "s_nationkey", "l_partkey")).withColumn("contradicts", links("R", "l_suppkey", "p_name"))
    totals = found.agg(F.count("*").alias("rows"), *[F.count_if(n).alias(n) for n in ("contradicts", "implies")])
    names = [(n, "rows") for n in ("knowledge", "knows", "owns")] + [(n, n) for n in ("contradicts", "implies")]
    out = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(at).alias("n")) for n, at in names])).alias("x")).select("x.*")
    a, b = (g["casts"].select("scene_id", "story_id", F.col("character_id").alias(k)) for k in ("src", "dst"))
    met = a.join(b, ["scene_id", "story_id"]).filter("src < dst").select("story_id", "src", "dst").distinct()
    tables = [(n, g[n]) for n in ("characters", "scenes", "locations", "items", "present_in", "occurs_in")] + [("relationships", met)]
    for n, table in tables:
        out = out.unionByName(table.agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n"))
    return out


def edge_count(g: Story) -> DataFrame:
    return g["sna_edges"].agg(F.count("*").alias("n"))


def edge_count_by_type(g: Story) -> DataFrame:
    return g["sna_edges"].groupBy("type").agg(F.count("*").alias("n"))


def node_count(g: Story) -> DataFrame:
    return g["characters"].select("character_id").unionAll(g["locations"].select("location_id")).unionAll(g["items"].select("item_id")).agg(F.count("*").alias("n"))


def graph_statistics(g: Story, cap: int = 1000, recent: int = 50, sessions: int = 5) -> DataFrame:
    """One row: sessions, episodes (at most `cap` of each), kinds, and how many are recent: the newest `recent` of the first `sessions` sessions."""
    e = g["episodes"]
    by = e.groupBy("group_id").agg(F.least(F.count("*"), F.lit(cap)).alias("n"))
    some = e.join(by.orderBy("group_id").limit(sessions).select("group_id"), "group_id").withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy(F.desc("created_at"), F.desc("uuid")))).filter(F.col("r") <= recent)
    one = lambda df, **aggs: df.agg(*[a.alias(n) for n, a in aggs.items()]).withColumn("k", F.lit(1))
    total = one(by, active_sessions=F.count("*"), episodes=F.sum("n"))
    kinds, last = one(e, kinds=F.countDistinct("body")), one(some, recent=F.count("*"), sample_sessions=F.countDistinct("group_id"))
    return total.join(kinds, "k").join(last, "k").drop("k")


def memory_context(g: Story, n: int = 3) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    top = g["turns"].withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n)
    return top.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), "\n\n")).alias("context"))


def extract_facts(g: Story, query: str = "the king", top: int = 10) -> DataFrame:
    """Facts for a query: of every conversation the first hundred characters of its best turns."""
    t = g["turns"]
    found = search.search(search.build(t, "conv_id", "turn", "text"), search.terms_of(g.spark, query), top)
    best = found.select(F.col("group").alias("conv_id"), F.col("key").alias("turn"), "place")
    return best.join(t, ["conv_id", "turn"]).select("conv_id", "turn", "place", F.substring("text", 1, 100).alias("fact"), F.lit(0.8).alias("confidence"))


def delete_story(g: Story, story_id: int = 3) -> DataFrame:
    """Sessions after a story was deleted: its row stays as a tombstone, so that its episodes can be told from unknown ones."""
    return g["characters"].groupBy("story_id").agg(F.count("*").alias("n")).withColumn("is_deleted", F.col("story_id") == story_id)


def alert_windows(g: Story, width: str = "30 minutes") -> DataFrame:
    return g["events"].filter("event_type = 'error'").groupBy(F.window(F.col("ts").cast("timestamp"), width)).agg(F.count("*").alias("n")).select(F.unix_timestamp(F.col("window.start")).alias("start"), "n")
