"""The story graph over the driver's tables, in SQL that Spark and DuckDB both read.

Each entry may use the driver's tables and the entries before it, as {name}. Spark resolves the names to DataFrames, so
only what a query needs is planned; the oracle gets them as WITH clauses.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narralake.plans.storage import written

DRIVER = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_DAY = "(year({0}) * 10000 + month({0}) * 100 + day({0}))"


def day(column: str) -> str:
    """A date as the integer yyyymmdd."""
    return _DAY.format(column)


TABLES: dict[str, str] = {
    "characters": "SELECT s_suppkey AS character_id, s_name AS name, s_nationkey AS story_id, r_name AS user_id FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
    "scenes": f"SELECT o_orderkey AS scene_id, o_orderpriority AS title, {day('o_orderdate')} AS scene_order, o_custkey FROM {{orders}}",
    "locations": "SELECT n_nationkey AS location_id, n_name AS name, CASE n_nationkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'restricted' ELSE 'secret' END AS accessibility FROM {nation}",
    "occurs_in": "SELECT scene_id, scene_order, c_nationkey AS location_id, CASE scene_id % 4 WHEN 0 THEN 'dawn' WHEN 1 THEN 'day' WHEN 2 THEN 'dusk' ELSE 'night' END AS time_of_day, CASE scene_id % 3 WHEN 0 THEN 'clear' WHEN 1 THEN 'rain' ELSE 'fog' END AS weather_conditions, scene_id % 120 AS scene_duration FROM {scenes} JOIN {customer} ON o_custkey = c_custkey",
    "present_in": "SELECT l_suppkey AS character_id, l_orderkey AS scene_id, count(*) AS dialogue_count, CASE WHEN max(l_linestatus) = 'O' THEN 'major' ELSE 'minor' END AS participation_level, max(l_returnflag) AS character_state FROM {lineitem} GROUP BY l_suppkey, l_orderkey",
    "facts": f"SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST({day('l_shipdate')} AS STRING)) AS knowledge_id, s_nationkey AS story_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus, l_shipdate, o_orderdate, {day('l_shipdate')} AS ship_day, {day('o_orderdate')} AS order_day, p_name AS content, p_type AS knowledge_type, CASE WHEN p_size <= 15 THEN 'low' WHEN p_size <= 35 THEN 'medium' ELSE 'high' END AS importance_level, l_linenumber >= 6 AS is_secret FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{part}} ON l_partkey = p_partkey JOIN {{supplier}} ON l_suppkey = s_suppkey",
    # One row of facts is a knowledge node and its KNOWS edge; `known` has both, so that templates need not join them back.
    "known": "SELECT knowledge_id, story_id, content, knowledge_type, importance_level, is_secret, CASE WHEN l_linestatus = 'O' THEN 'unverified' ELSE 'verified' END AS verification_status, least(order_day, ship_day) AS valid_from, CASE WHEN l_returnflag = 'N' THEN NULL ELSE greatest(order_day, ship_day) END AS valid_to, least(o_orderdate, l_shipdate) AS valid_from_ts, order_day AS created_at, l_suppkey AS character_id, ship_day AS learned_at, CASE l_linenumber % 3 WHEN 0 THEN 'top_secret' WHEN 1 THEN 'need_to_know' ELSE 'open' END AS sharing_restrictions, CAST(l_quantity AS INT) % 10 + 1 AS confidence_level, CASE l_linenumber % 2 WHEN 0 THEN 'calm' ELSE 'shock' END AS emotional_impact FROM {facts}",
    "knowledge": "SELECT knowledge_id, story_id, content, knowledge_type, importance_level, is_secret, verification_status, valid_from, valid_to, valid_from_ts, created_at, character_id FROM {known}",
    "knows": "SELECT character_id, knowledge_id, learned_at, sharing_restrictions, confidence_level, emotional_impact FROM {known}",
    "contradicts": "SELECT from_id, to_id, CASE ln % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'major' WHEN 2 THEN 'minor' ELSE 'potential' END AS severity, CASE WHEN status = 'O' THEN 'unresolved' ELSE 'resolved' END AS resolution_status, detected_at FROM (SELECT knowledge_id AS from_id, lead(knowledge_id) OVER w AS to_id, l_linenumber AS ln, l_linestatus AS status, l_returnflag AS flag, ship_day AS detected_at FROM {facts} WINDOW w AS (PARTITION BY l_suppkey, content ORDER BY least(order_day, ship_day), knowledge_id)) x WHERE flag = 'R' AND to_id IS NOT NULL",
    "implies": "SELECT from_id, to_id, ln % 4 + 1 AS implication_strength, CASE ln % 2 WHEN 0 THEN 'deduction' ELSE 'evidence' END AS logical_basis FROM (SELECT knowledge_id AS from_id, lead(knowledge_id) OVER w AS to_id, l_linenumber AS ln, l_returnflag AS flag FROM {facts} WINDOW w AS (PARTITION BY story_id, l_partkey ORDER BY least(order_day, ship_day), knowledge_id)) x WHERE flag = 'A' AND to_id IS NOT NULL",
    "items": "SELECT p_partkey AS item_id, p_name AS name, p_brand AS item_type FROM {part}",
    "owns": "SELECT knowledge_id AS own_id, story_id, l_suppkey AS character_id, l_partkey AS item_id, ship_day AS ownership_start, lead(ship_day) OVER w AS ownership_end, lag(l_suppkey) OVER w AS obtained_from, CASE l_linenumber % 4 WHEN 0 THEN 'gift' WHEN 1 THEN 'exchange' WHEN 2 THEN 'theft' ELSE 'found' END AS transfer_method FROM {facts} WINDOW w AS (PARTITION BY story_id, l_partkey ORDER BY ship_day, knowledge_id)",
    # Characters of one story in one scene; a pair of different stories never meets.
    "casts": "SELECT scene_id, story_id, p.character_id, dialogue_count FROM {present_in} p JOIN {characters} c ON p.character_id = c.character_id",
    "met": "SELECT a.story_id, a.character_id AS src, b.character_id AS dst, count(*) AS n, max(a.scene_id) AS last_scene, sum(a.dialogue_count + b.dialogue_count) AS lines FROM {casts} a JOIN {casts} b ON a.scene_id = b.scene_id AND a.story_id = b.story_id AND a.character_id < b.character_id GROUP BY a.story_id, a.character_id, b.character_id",
    "relationships": "SELECT story_id, src, dst, CASE last_scene % 3 WHEN 0 THEN 'ally' WHEN 1 THEN 'rival' ELSE 'friend' END AS relationship_type, lines % 10 + 1 AS relationship_strength, (src + dst) % 10 + 1 AS trust_level, CASE WHEN (src * dst) % 2 = 0 THEN 'warm' ELSE 'cold' END AS emotional_valence, last_scene % 28 + 1 AS established_at, last_scene % 28 + 1 + n AS updated_at FROM {met}",
    # A pair's strength: how often they met against the usual pair of their story, cubed, so that some stay without a tie.
    "lifts": "SELECT m.story_id, src, dst, CAST(n AS DOUBLE) / usual AS lift FROM {met} m JOIN (SELECT story_id, avg(n) AS usual FROM {met} GROUP BY story_id) u ON u.story_id = m.story_id",
    "ties": "SELECT story_id, src, dst, CAST(floor(lift * lift * lift * 3) AS INT) AS strength FROM {lifts}",
    "sna_edges": "SELECT story_id, src, dst, strength, CASE WHEN strength >= 15 THEN 'FRIENDS_WITH' WHEN strength >= 8 THEN 'KNOWS' WHEN strength >= 3 THEN 'ACQUAINTED_WITH' ELSE 'MENTIONED_WITH' END AS type, least(CAST(floor(strength / 2) AS INT), 10) AS trust_level FROM (SELECT story_id, src, dst, strength FROM {ties} UNION ALL SELECT story_id, dst AS src, src AS dst, strength FROM {ties}) x",
    # Every tenth event opens a thread, the others belong to it; of every hundred, three are each other's ancestors.
    "parents": "SELECT event_id AS episode, CASE WHEN event_id % 100 IN (1, 2) THEN event_id + 1 WHEN event_id % 100 = 3 THEN event_id - 2 WHEN event_id % 10 <> 0 THEN event_id - event_id % 10 WHEN event_id % 100 <> 0 THEN event_id - event_id % 100 END AS parent FROM {events}",
    # Links that were recorded before: between scenes of one character on one day, and between characters.
    "scene_contradicts": "SELECT DISTINCT from_id, to_id FROM (SELECT p.scene_id AS from_id, lead(p.scene_id) OVER (PARTITION BY character_id, scene_order ORDER BY p.scene_id) AS to_id FROM {present_in} p JOIN {scenes} s ON p.scene_id = s.scene_id) x WHERE to_id IS NOT NULL AND from_id % 3 = 0",
    "character_contradicts": "SELECT src AS from_id, dst AS to_id FROM {met} WHERE (src + dst) % 5 = 0",
    # How often a pair of one story met in each year, and the state of their relationship then.
    "years": "SELECT a.story_id, a.character_id AS src, b.character_id AS dst, CAST(floor(scene_order / 10000) AS INT) AS year, count(*) AS strength FROM {casts} a JOIN {casts} b ON a.scene_id = b.scene_id AND a.story_id = b.story_id AND a.character_id < b.character_id JOIN {scenes} s ON s.scene_id = a.scene_id GROUP BY 1, 2, 3, 4",
    "bonds": "SELECT story_id, src, dst, year AS created_at, CASE (src + dst + year) % 4 WHEN 0 THEN 'enemy' WHEN 1 THEN 'ally' ELSE 'friend' END AS relationship_type, strength FROM {years}",
    # Lines of source files and scripts, one file for each user.
    "source_lines": "SELECT user_id AS file, event_id AS line, CASE event_id % 8 WHEN 0 THEN concat('x = os.getenv(\"', upper(event_type), '_KEY\", \"none\")') WHEN 1 THEN 'y = os.environ[\"HOME_DIR\"]' WHEN 2 THEN 'z = environ.get(\"MODE\") or os.getenv( \"OTHER\" )' WHEN 3 THEN '// a comment;' WHEN 4 THEN '' WHEN 5 THEN 'MATCH (n)' WHEN 6 THEN '  RETURN n;  ' ELSE concat('CREATE ', event_type, ';') END AS text FROM {events}",
    "episodes": "SELECT event_id AS uuid, user_id AS group_id, event_type AS body, ts AS created_at, value FROM {events}",
    # Conversations with story phrases put in by number, so that every text rule has rows that it meets and rows that it misses.
    "turns": "SELECT conv_id, turn, role, CASE (conv_id + 3 * turn) % 16 WHEN 0 THEN concat('Chapter 7 ', text) WHEN 1 THEN concat(text, ' Alice said to Bob that the king was dead.') WHEN 2 THEN concat(text, ' Bob recalled that Carol was alive.') WHEN 3 THEN 'THE LAST BATTLE' WHEN 4 THEN concat(text, ' Meanwhile, the enemy was hidden before anyone had mentioned it.') WHEN 5 THEN concat(text, ' Years later the friend will find a secret.') WHEN 6 THEN concat(text, ' Cut to the castle. Would you like more detail?') WHEN 7 THEN concat(text, ' Alice and Dan told The Story in dialogue: stop, that is enough.') WHEN 8 THEN concat(text, ' I remember my young sister, they were rich and happy.') WHEN 9 THEN concat(text, ' Old and poor, he was never married.') WHEN 10 THEN concat('Story Content: ', text, chr(10), chr(10), 'Entities: Alice, Bob') WHEN 11 THEN concat('MATCH (k:Knowledge) WHERE k.content CONTAINS ''dead'' RETURN k ', text) WHEN 12 THEN '12' WHEN 13 THEN concat(text, ' Little did she know that he was single.') WHEN 14 THEN concat(text, chr(10), '---', chr(10), 'Bob told Alice: as the seer had said, Carol will see.') WHEN 15 THEN concat(text, ' Dead or alive, the enemy was never her friend.') ELSE text END AS text FROM {conversations}",
    "entities": "SELECT p_partkey AS entity_id, concat(p_name, CASE p_partkey % 9 WHEN 0 THEN ' castle' WHEN 1 THEN ' sword' WHEN 2 THEN ' of the River' WHEN 3 THEN ' scroll' ELSE '' END) AS name, CASE p_partkey % 5 WHEN 0 THEN 'He said so' WHEN 1 THEN 'a meeting took place' WHEN 2 THEN 'it occurred' ELSE p_type END AS summary FROM {part}",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


class Story:
    """Story tables as DataFrames, made when asked for: g["knows"]."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}
        self._unique: dict[str, bool] = {}

    def unique(self, table: str, key: str) -> bool:
        """Whether no value of a driver table's key repeats; looked up once."""
        if table not in self._unique:
            self._unique[table] = self[table].filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
        return self._unique[table]

    def source(self, name: str) -> DataFrame:
        """A driver table as this graph may see it."""
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.sql(TABLES[name], **{n: self[n] for n in _needs(TABLES[name])})
            else:
                self._made[name] = self.source(name)
        return self._made[name]

    def keep(self, name: str) -> DataFrame:
        """Writes a table, so that all that is made from it hereafter reads it instead of computing it again."""
        self._made[name] = written(self[name], name)
        return self._made[name]

    def scoped(self, story_id: int, user_id: str) -> Scope:
        """The same graph over one story of one owner."""
        return Scope(self, story_id, user_id)


#: Who owns a driver table's rows, as a semi join with what the scope owns: name -> (table of the scope, condition). "owner"
#: is the scope's own row (story_id, region_id), which is missing if the story isn't the user's; nothing is left then. Rows
#: without an owner of their own belong to the story that their number gives (25 stories). A driver table that isn't named
#: here can't be read in a scope at all.
STORIES = 25
POLICIES: dict[str, tuple[str, str]] = {
    "region": ("owner", "r_regionkey = region_id"),
    "nation": ("places", "n_nationkey = place_id"),
    "supplier": ("owner", "s_nationkey = story_id"),
    "lineitem": ("supplier", "l_suppkey = s_suppkey"),
    "orders": ("lineitem", "o_orderkey = l_orderkey"),
    "part": ("lineitem", "p_partkey = l_partkey"),
    "customer": ("orders", "c_custkey = o_custkey"),
    **{table: ("owner", f"pmod({key}, {STORIES}) = story_id") for table, key in (("events", "user_id"), ("conversations", "conv_id"), ("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id"), ("pages", "page_id"), ("benchmark", "item_id"))},
}


class Scope(Story):
    """A graph that is bound at its sources: every driver table passes its policy before anything else is built on it, so no
    table and no query over this graph holds a row of another story. Places are the story's own and those its scenes are at."""

    def __init__(self, whole: Story, story_id: int, user_id: str):
        super().__init__(whole.spark, whole.sf_dir)
        self.story_id, self.user_id = int(story_id), user_id
        raw = super().source
        nation = raw("nation").filter(F.col("n_nationkey") == self.story_id)
        region = raw("region").filter(F.col("r_name") == user_id)
        self._owner = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("story_id"), F.col("r_regionkey").alias("region_id"))
        # The owner's characters need no other places than the story itself, and so no scan of its scenes.
        named = self["supplier"].select(F.col("s_suppkey").alias("character_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("story_id"))
        self._made["characters"] = named.withColumn("user_id", F.lit(user_id))

    def _bound(self, name: str) -> DataFrame:
        if name == "owner":
            return F.broadcast(self._owner)  # one row at most: nations have one key each
        if name == "places":
            return self._owner.select(F.col("story_id").alias("place_id")).unionByName(self["customer"].select(F.col("c_nationkey").alias("place_id")))
        return self[name]

    def source(self, name: str) -> DataFrame:
        if name not in POLICIES:
            raise PermissionError(f"table {name} has no policy, so a scope can't read it")
        by, on = POLICIES[name]
        return super().source(name).join(self._bound(by), F.expr(on), "left_semi")

    def scoped(self, story_id: int, user_id: str) -> Scope:
        if (int(story_id), user_id) != (self.story_id, self.user_id):
            raise PermissionError("a scope can't be changed to another one")
        return self


def oracle(text: str) -> str:
    """SQL over driver and story tables, named as {name}, as one statement for DuckDB."""
    order: list[str] = []

    def visit(sql: str) -> None:
        for n in _needs(sql):
            if n in TABLES and n not in order:
                visit(TABLES[n])
                order.append(n)

    visit(text)
    plain = lambda sql: re.sub(r"\{(\w+)\}", r"\1", sql)
    head = text.lstrip()
    with_ = ", ".join(f"{n} AS ({plain(TABLES[n])})" for n in order)
    if head.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {with_ + ', ' if with_ else ''}{plain(head[15:])}"
    if head.upper().startswith("WITH "):
        return f"WITH {with_ + ', ' if with_ else ''}{plain(head[5:])}"
    return (f"WITH {with_} " if with_ else "") + plain(head)
