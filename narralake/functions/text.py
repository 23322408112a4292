"""Rule-based text operators as Column expressions. Word lists and patterns are fixed values that callers may replace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.plans.adapter import Story

SCENE_BREAK = r"\n\s*\n|\n\s*---\s*\n|\n\s*\*\*\*\s*\n"
NOT_WORD = r"[^\p{L}\p{N}_]+"

#: How a chapter starts, and words of a jump in time, which is reported but starts no chapter.
CHAPTER_STARTS = (r"^\s*(chapter|ch\.?)\s+\d+", r"^\s*(part|book)\s+\d+", r"^\s*\d+\s*$", r"^\s*[IVX]+\s*$")
TIME_JUMP = r"\b(years? later|months? later|days? later|meanwhile|elsewhere)\b"
#: What marks an episode.
EPISODE_MARKS = (r"\b(scene|act)\s+\d+\b", r"\b(cut to|fade to|dissolve to)\b", r"\b(meanwhile|elsewhere|at the same time)\b", r"\b(hours? later|minutes? later|soon after)\b")
#: Words of the story-arc families, in order of precedence.
ARCS = {
    "exposition": ("introduce", "meet", "background", "setting", "world"),
    "rising_action": ("conflict", "problem", "challenge", "discover"),
    "climax": ("battle", "fight", "confrontation", "crisis", "decisive"),
    "falling_action": ("aftermath", "consequence", "result", "resolve"),
    "resolution": ("end", "conclude", "peace", "happy", "reunion"),
}
#: Pronouns of the narrator's person.
PERSONS = {
    "first": ("i", "me", "my", "mine", "we", "us", "our", "ours"),
    "second": ("you", "your", "yours"),
    "third": ("he", "him", "his", "she", "her", "hers", "they", "them", "their", "theirs"),
}
#: Mood words, in order of precedence; they count inside longer words too.
MOODS = {
    "happy": ("joy", "happy", "pleased", "delighted", "cheerful", "smile", "laugh"),
    "sad": ("sad", "sorrow", "grief", "melancholy", "despair", "cry", "tear"),
    "tense": ("tension", "suspense", "anxious", "worried", "nervous", "fear"),
    "dramatic": ("dramatic", "intense", "powerful", "striking", "significant"),
    "mysterious": ("mystery", "secret", "hidden", "unknown", "enigma", "puzzle"),
    "action": ("fight", "battle", "run", "chase", "attack", "escape", "rush"),
}
#: Phrases that call back to, or point forward at, other scenes, and the words that make one explicit.
CALLBACKS = (
    r"\b(remember|recalled?|flashback|flash back)\b",
    r"\b(foreshadow|foretold?|prophes|predict)\b",
    r"\b(earlier|before|previously|past)\b.*\b(mentioned|said|told)\b",
    r"\b(later|future|will|shall)\b.*\b(see|find|discover|learn)\b",
    r"\b(as .* had said|as .* predicted|just as .* warned)\b",
    r"\b(little did .* know|unbeknownst|unknown to)\b",
)
EXPLICIT = ("remember", "recalled", "earlier", "before", "later", "future")
#: Words in a name or in its context, in order of precedence.
LOCATION_NAMES = ("castle", "town", "forest", "mountain", "river", "room", "house")
CHARACTER_CONTEXT = ("said", "told", "spoke", "thought", "felt", "character")
ITEM_NAMES = ("sword", "potion", "key", "ring", "book", "scroll")
EVENT_CONTEXT = ("happened", "occurred", "event", "battle", "meeting")
#: Capitalised words that are no names.
NO_NAMES = ("The", "And", "But", "For", "Not", "With", "He", "She", "They", "Story", "Episode")
#: Edge types without a meaning of their own.
GENERIC_TYPES = ("RELATES_TO", "MENTIONS", "HAS_MEMBER")
#: An answer that asks whether to go on, and a reply that declines; both count inside words.
FOLLOW_UPS = ("would you like", "need more", "should i continue", "continue with", "more detail")
DECLINES = ("no", "no thanks", "stop", "that's all", "cancel", "don't")


def holds(text: Column, words: tuple[str, ...]) -> Column:
    """Whether any of the words stands in the text, in other words too."""
    return reduce(lambda x, y: x | y, [text.contains(w) for w in words])


def matches(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x | y, [text.rlike(f"(?i){p}") for p in patterns])


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def word_count(words: Column, wanted: tuple[str, ...]) -> Column:
    """How many of an array of words are among the wanted ones."""
    return F.size(F.filter(words, lambda w: w.isin(*wanted)))


def first_of(counts: dict[str, Column], none: str) -> tuple[Column, Column]:
    """(the first key whose count is the largest, that count); `none` if all are 0."""
    most = F.greatest(*counts.values())
    label = reduce(lambda acc, kv: acc.when(kv[1] == most, kv[0]), counts.items(), F.when(most == 0, none))
    return label, most


def joined(rows: DataFrame, key: str, order: str, text: str, name: str) -> DataFrame:
    """One text for each key: the rows' texts in order, with blank lines between."""
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n\n").alias(name))


def stories(g: Story) -> DataFrame:
    """One text for each conversation, turns joined by blank lines."""
    return joined(g["turns"], "conv_id", "turn", "text", "content")


def split_scenes(texts: DataFrame, id_col: str, content: str) -> DataFrame:
    """Scenes keep the number of the block they were, also where blank blocks before them fall away."""
    blocks = texts.select(id_col, F.posexplode(F.split(stripped(F.col(content)), SCENE_BREAK)).alias("i", "block"))
    return blocks.select(id_col, (F.col("i") + 1).alias("scene_order"), stripped(F.col("block")).alias("text")).filter("text <> ''").withColumn("word_count", F.size(F.split("text", r"\s+")))


def scenes(g: Story) -> DataFrame:
    return split_scenes(stories(g), "conv_id", "content")


def scene_counts(g: Story) -> DataFrame:
    return scenes(g).select("conv_id", "scene_order", "word_count", F.length("text").alias("n_chars"))


def chapter_boundary(g: Story) -> DataFrame:
    start = matches(F.col("text"), CHAPTER_STARTS)
    title = (F.col("word_count") <= 5) & (F.upper("text") == F.col("text")) & (F.lower("text") != F.col("text"))
    seen = scenes(g).select("conv_id", "scene_order", start.alias("pattern_match"), title.alias("title_like"), matches(F.col("text"), (TIME_JUMP,)).alias("time_jump"))
    return seen.select("*", (F.col("pattern_match") | F.col("title_like")).alias("is_boundary"), F.when(F.col("pattern_match"), 0.9).when(F.col("title_like"), 0.7).otherwise(0.3).alias("confidence"))


def episode_boundary(g: Story, long: int = 300, every: int = 4) -> DataFrame:
    """A marked scene, or a long one where a break would be natural, opens an episode."""
    i = F.col("scene_order") - 1
    seen = scenes(g).select("conv_id", "scene_order", matches(F.col("text"), EPISODE_MARKS).alias("marked"), (F.col("word_count") > long).alias("long"), ((i > 0) & (i % every == 0)).alias("natural"))
    return seen.select("*", (F.col("marked") | (F.col("long") & F.col("natural"))).alias("is_boundary"), F.when(F.col("marked"), 0.8).when(F.col("long"), 0.6).otherwise(0.4).alias("confidence"))


def chapter_episode_numbers(g: Story) -> DataFrame:
    """Chapters count boundaries; in a chapter every third block opens an episode."""
    w = Window.partitionBy("conv_id").orderBy("scene_order")
    b = chapter_boundary(g).withColumn("i", F.col("scene_order") - 1)
    chapters = b.withColumn("chapter", 1 + F.sum(F.col("is_boundary").cast("int")).over(w))
    opens = (~F.col("is_boundary") & (F.col("i") > 0) & (F.col("i") % 3 == 0)).cast("int")
    return chapters.withColumn("opens", opens).withColumn("episode", 1 + F.sum("opens").over(Window.partitionBy("conv_id", "chapter").orderBy("scene_order"))).select("conv_id", "scene_order", "chapter", "episode")


def story_arc(g: Story) -> DataFrame:
    words = g["documents"].select("doc_id", F.split(F.lower("text"), NOT_WORD).alias("w"))
    d = words.select("doc_id", *[word_count(F.col("w"), ws).alias(k) for k, ws in ARCS.items()])
    label, most = first_of({k: F.col(k) for k in ARCS}, "neutral")
    return d.select("doc_id", label.alias("arc"), most.alias("intensity"), *ARCS)


def pov(g: Story) -> DataFrame:
    words = g["documents"].select("doc_id", F.split(F.lower("text"), NOT_WORD).alias("w"))
    d = words.select("doc_id", *[word_count(F.col("w"), ws).alias(f"n_{k}") for k, ws in PERSONS.items()])
    total = F.col("n_first") + F.col("n_second") + F.col("n_third")
    share = {k: F.try_divide(F.col(f"n_{k}"), total) for k in PERSONS}
    first, second = share["first"] > 0.4, share["second"] > 0.3
    kind = F.when(total == 0, "unknown").when(first, "first_person").when(second, "second_person").otherwise("third_person")
    sure = F.when(total == 0, 0.0).when(first, share["first"]).when(second, share["second"]).otherwise(share["third"])
    return d.select("doc_id", "n_first", "n_second", "n_third", kind.alias("pov"), F.round(sure, 6).alias("confidence"))


def _trie(words: list[str]) -> str:
    """A pattern of these words by their common beginnings; none begins another."""
    if words == [""]:
        return ""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    arms = [ch + _trie(rest) for ch, rest in by.items()]
    return arms[0] if len(arms) == 1 else f"(?:{'|'.join(arms)})"


def overlaps_itself(word: str) -> bool:
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def family_matches(text: Column, words: list[str]) -> Column:
    """Every match of these words (plain letters), in one pass, inside other words too and where they overlap each other. No
    word begins another, and none overlaps itself, so a word's matches are as many as its uses."""
    words = sorted(set(words))
    if any(b.startswith(a) for a, b in zip(words, words[1:], strict=False)) or any(map(overlaps_itself, words)):
        raise ValueError("a word begins another or overlaps itself")
    first = "".join(sorted({w[0] for w in words}))
    return F.regexp_extract_all(text, F.lit(f"(?=[{first}])(?=({_trie(words)}))"), F.lit(1))


def family_counts(rows: DataFrame, text: Column, families: dict[str, tuple[str, ...]], *keys: str) -> DataFrame:
    """keys and, for each family, its words' uses, of one word not overlapping. One scan of the text for all words, and one for
    each that overlaps itself, whose uses are counted by what the text loses without them."""
    plain = [w for ws in families.values() for w in ws if not overlaps_itself(w)]
    lost = lambda w: F.floor((F.length("text") - F.length(F.replace("text", F.lit(w), F.lit("")))) / len(w)).cast("int")
    found = rows.select(*keys, text.alias("text")).select(*keys, "text", family_matches(F.col("text"), plain).alias("found"))
    return found.select(*keys, *[reduce(lambda a, b: a + b, [lost(w) for w in ws if overlaps_itself(w)], word_count(F.col("found"), ws)).alias(m) for m, ws in families.items()])


def mood_lexical(g: Story) -> DataFrame:
    d = family_counts(g["documents"], F.lower("text"), MOODS, "doc_id")
    label, most = first_of({m: F.col(m) for m in MOODS}, "neutral")
    return d.select("doc_id", label.alias("mood"), F.round(F.least(most / 3, F.lit(1.0)), 6).alias("intensity"))


def letter_words(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) > 2)


def significance_tfidf(g: Story, top: int = 5, tokens=letter_words) -> DataFrame:
    """Per turn: the mean of the `top` largest tf * texts / (df + 1), at most 1; 0.3 without terms. df counts the narrative's texts that hold the term anywhere. `tokens` may be replaced."""
    body = g["turns"].select("conv_id", "turn", F.lower("text").alias("body"))
    size = body.groupBy("conv_id").agg(F.count("*").alias("texts"))
    words = body.select("conv_id", "turn", tokens(F.col("body")).alias("w"))
    tf = words.select("conv_id", "turn", F.size("w").alias("total"), F.explode("w").alias("term")).groupBy("conv_id", "turn", "term", "total").agg(F.count("*").alias("n"))
    df = tf.select("conv_id", "term").distinct().join(body.select("conv_id", "body"), "conv_id").filter(F.col("body").contains(F.col("term"))).groupBy("conv_id", "term").agg(F.count("*").alias("df"))
    scored = tf.join(df, ["conv_id", "term"]).join(size, "conv_id").withColumn("x", F.col("n") / F.col("total") * (F.col("texts") / (F.col("df") + 1)))
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy(F.desc("x"), "term"))).filter(F.col("r") <= top)
    found = best.groupBy("conv_id", "turn").agg(F.least(F.sum("x") / top, F.lit(1.0)).alias("x"))
    return body.select("conv_id", "turn").join(found, ["conv_id", "turn"], "left").select("conv_id", "turn", F.round(F.coalesce("x", F.lit(0.3)), 4).alias("significance"))


def continuity_edges(g: Story, patterns: tuple[str, ...] = CALLBACKS, least: int = 3) -> DataFrame:
    """An edge from a scene, for each of its callback phrases, to every other scene of the story that shares `least` words.

    Only scenes with a phrase enter the join on words, from the left.
    """
    s = scenes(g).select("conv_id", "scene_order", "text")

    def phrases_of(k: int, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(f"(?i){pattern}"), F.lit(0)), lambda x: F.struct(F.lit(f"pattern_{k}").alias("pattern_type"), x.alias("phrase")))

    phrases = F.concat(*[phrases_of(k, p) for k, p in enumerate(patterns)])
    found = s.select("conv_id", "scene_order", "text", phrases.alias("p")).filter("size(p) > 0")
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+")))
    a = found.select("conv_id", F.col("scene_order").alias("from_scene"), words.alias("word"))
    b = s.select("conv_id", F.col("scene_order").alias("to_scene"), words.alias("word"))
    near = a.join(b, ["conv_id", "word"]).filter("from_scene <> to_scene").groupBy("conv_id", "from_scene", "to_scene").agg(F.count("*").alias("shared")).filter(F.col("shared") >= least)
    each = found.select("conv_id", F.col("scene_order").alias("from_scene"), F.explode("p").alias("p"))
    sure = F.when(holds(F.lower("p.phrase"), EXPLICIT), 0.8).otherwise(0.6)
    return near.join(each, ["conv_id", "from_scene"]).select("conv_id", "from_scene", "to_scene", "p.pattern_type", F.col("p.phrase").alias("callback_phrase"), sure.alias("confidence"), F.abs(F.col("to_scene") - F.col("from_scene")).alias("scene_order_diff"))


def entity_kind(name: Column, context: Column) -> Column:
    name, context = F.lower(name), F.lower(context)
    return F.when(holds(name, LOCATION_NAMES), "LOCATION").when(holds(context, CHARACTER_CONTEXT), "CHARACTER").when(holds(name, ITEM_NAMES), "ITEM").when(holds(context, EVENT_CONTEXT), "EVENT").otherwise("CHARACTER")


def entity_type(g: Story) -> DataFrame:
    return g["entities"].select("entity_id", entity_kind(F.col("name"), F.col("summary")).alias("entity_type"))


def traceability(g: Story) -> DataFrame:
    s = g["scenes"].select("scene_id")
    segments = s.select(F.concat(F.lit("segment_"), F.col("scene_id").cast("string")).alias("source"), "scene_id")
    entities = g["present_in"].select(F.concat(F.lit("entity_"), F.col("character_id").cast("string")).alias("source"), "scene_id")
    return segments.union(entities)


def processing_stats(g: Story) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return g["events"].select("event_id", F.count("*").over(w).alias("n"), (F.sum(F.col("value").cast("decimal(18,2)")).over(w).cast("double") / F.count("*").over(w)).alias("running_mean"))


def fix_generic(edges: DataFrame) -> DataFrame:
    """edges (type, name): generic ones with a name of their own take it as their type, in capitals; counted by (from, to, name)."""
    own = edges.filter(F.col("type").isin(*GENERIC_TYPES) & F.col("name").isNotNull() & (F.col("name") != F.col("type")))
    return own.groupBy(F.col("type").alias("from_type"), F.translate(F.upper("name"), " -", "__").alias("to_type"), F.col("name").alias("original_name")).agg(F.count("*").alias("converted"))


def fix_generic_relationships(g: Story) -> DataFrame:
    kind = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'RELATES_TO' WHEN 1 THEN 'MENTIONS' WHEN 2 THEN 'HAS_MEMBER' ELSE 'KNOWS' END")
    return fix_generic(g["part"].select(kind.alias("type"), F.when(F.col("p_partkey") % 16 == 0, "RELATES_TO").otherwise(F.col("p_name")).alias("name")))


def search_mapping(g: Story) -> DataFrame:
    """Search hits as typed rows: an edge gives a relationship and, if it states a fact, a knowledge row; a node gives an entity."""
    hits = g["turns"].select("conv_id", "turn", (F.col("role") == "user").alias("is_edge"), "text")
    row = lambda kind, name, entity: F.struct(F.lit(kind).alias("kind"), name.alias("name"), entity.alias("entity_type"))
    none = F.lit(None).cast("string")
    fact = F.concat(F.lit("Fact: "), F.substring("text", 1, 50), F.lit("..."))
    rows = F.when(F.col("is_edge"), F.when(F.col("text") != "", F.array(row("relationship", F.lit("RELATED_TO"), none), row("knowledge", fact, none))).otherwise(F.array(row("relationship", F.lit("RELATED_TO"), none)))).otherwise(F.array(row("entity", F.substring("text", 1, 20), entity_kind(F.substring("text", 1, 20), F.col("text")))))
    return hits.select("conv_id", "turn", F.explode(rows).alias("x")).select("conv_id", "turn", "x.kind", "x.name", "x.entity_type", F.lit(0.8).alias("confidence"))


def upsert_rows(g: Story) -> DataFrame:
    """What a story writes to the graph, as typed rows; one row for each kind and id."""
    row = lambda table, kind, key, name: g[table].select(kind.alias("type"), F.col(key).cast("string").alias("id"), name.alias("name"))
    found = [row("entities", entity_kind(F.col("name"), F.col("summary")), "entity_id", F.col("name")), row("scenes", F.lit("SCENE"), "scene_id", F.col("title")), row("knowledge", F.lit("KNOWLEDGE"), "knowledge_id", F.concat(F.lit("Fact: "), F.substring("content", 1, 50), F.lit("...")))]
    return reduce(DataFrame.unionByName, found).groupBy("type", "id").agg(F.max("name").alias("name"))


def story_metadata(g: Story) -> DataFrame:
    """Words, scenes, and scenes that hold no word at all, which later steps can't read."""
    return scenes(g).groupBy("conv_id").agg(F.sum("word_count").alias("word_count"), F.count("*").alias("scene_count"), F.sum((~F.col("text").rlike(r"[\p{L}\p{N}]")).cast("int")).alias("scene_errors"))


def narrative_context(g: Story, scene: str | None = None) -> DataFrame:
    """A story's bodies in order with blank lines between; of a body with `Story Content:`, what stands before its entities. scene: only bodies that name it."""
    t = g["turns"] if scene is None else g["turns"].filter(F.lower("text").contains(scene.lower()))
    part = stripped(F.get(F.split(F.get(F.split("text", "Story Content:"), F.lit(1)), "\n\nEntities:"), F.lit(0)))
    told = F.when(F.col("text").contains("Story Content:"), part).otherwise(F.col("text")) if scene is None else F.col("text")
    return joined(t.select("conv_id", "turn", told.alias("told")).filter("told <> ''"), "conv_id", "turn", "told", "content").select("conv_id", F.length("content").alias("n_chars"), F.md5("content").alias("digest"))


def dialogue_pairs(g: Story) -> DataFrame:
    """Unordered pairs of the names in a body that tells of speech."""
    names = F.array_sort(F.array_distinct(F.filter(F.split("text", NOT_WORD), lambda w: w.rlike("^[A-Z][a-z]+$") & ~w.isin(*NO_NAMES))))
    t = g["turns"].filter(holds(F.lower("text"), ("dialogue", "said"))).select("conv_id", "turn", names.alias("names")).filter("size(names) >= 2")
    one = t.select("conv_id", "turn", "names", F.posexplode("names").alias("i", "a"))
    return one.select("conv_id", "turn", "a", F.explode(F.slice("names", F.col("i") + 2, F.size("names"))).alias("b"), F.lit("dialogue").alias("interaction_type"))


def strengths(pairs: DataFrame) -> DataFrame:
    """Dialogue counts 2, any other interaction 1."""
    return pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.when(F.col("interaction_type") == "dialogue", 2).otherwise(1)).alias("strength"))


def interaction_strength(g: Story) -> DataFrame:
    return strengths(dialogue_pairs(g))


def sna_relationships(g: Story) -> DataFrame:
    """Both directions of every pair, with the bands of strength 15, 8 and 3."""
    s = interaction_strength(g)
    both = s.select("a", "b", "strength").union(s.select("b", "a", "strength"))
    kind = F.when(F.col("strength") >= 15, "FRIENDS_WITH").when(F.col("strength") >= 8, "KNOWS").when(F.col("strength") >= 3, "ACQUAINTED_WITH").otherwise("MENTIONED_WITH")
    return both.select("a", "b", "strength", kind.alias("type"), F.round(F.least(F.col("strength") / 20, F.lit(1.0)), 6).alias("confidence"), F.least(F.floor(F.col("strength") / 2), F.lit(10)).cast("int").alias("trust_level"))


def discovery_metrics(g: Story) -> DataFrame:
    return interaction_strength(g).agg(F.sum("strength").alias("total"), F.count("*").alias("pairs"), F.round(F.avg("strength"), 6).alias("mean"))


def search_term(g: Story) -> DataFrame:
    """The literal of a query's CONTAINS or LIKE; * without one."""
    found = F.regexp_extract("text", r"""(?i)CONTAINS\s+['"]([^'"]+)['"]|LIKE\s+['"]%?([^'"]+)%?['"]""", 1)
    like = F.regexp_extract("text", r"""(?i)CONTAINS\s+['"]([^'"]+)['"]|LIKE\s+['"]%?([^'"]+)%?['"]""", 2)
    return g["turns"].select("conv_id", "turn", F.when(found != "", found).when(like != "", like).otherwise("*").alias("term"))


def followup_flags(g: Story) -> DataFrame:
    text = F.lower("text")
    return g["turns"].select("conv_id", "turn", holds(text, FOLLOW_UPS).alias("follow_up"), holds(text, DECLINES).alias("declines"))


def pacing(g: Story, long: int = 300) -> DataFrame:
    """Of each chapter: scenes, words a scene, and the share of long scenes."""
    return scenes(g).join(chapter_episode_numbers(g), ["conv_id", "scene_order"]).groupBy("conv_id", "chapter").agg(F.count("*").alias("scenes"), F.round(F.avg("word_count"), 6).alias("words"), F.round(F.avg((F.col("word_count") > long).cast("int")), 6).alias("long_share"))


def _changes(rows: DataFrame, kind: str) -> DataFrame:
    """Scenes in which a label differs from the scene's before."""
    w = Window.partitionBy("conv_id").orderBy("scene_order")
    return rows.withColumn("before", F.lag(kind).over(w)).filter(F.col("before").isNull() | (F.col("before") != F.col(kind))).select("conv_id", "scene_order", F.col("before"), kind)


def arc_progression(g: Story) -> DataFrame:
    counted = scenes(g).select("conv_id", "scene_order", F.split(F.lower("text"), NOT_WORD).alias("w")).select("conv_id", "scene_order", *[word_count(F.col("w"), ws).alias(k) for k, ws in ARCS.items()])
    return _changes(counted.select("conv_id", "scene_order", first_of({k: F.col(k) for k in ARCS}, "neutral")[0].alias("arc")), "arc")


def mood_progression(g: Story) -> DataFrame:
    d = family_counts(scenes(g), F.lower("text"), MOODS, "conv_id", "scene_order")
    return _changes(d.select("conv_id", "scene_order", first_of({m: F.col(m) for m in MOODS}, "neutral")[0].alias("mood")), "mood")


def character_development(g: Story) -> DataFrame:
    """What a character's ties gained from the first year to the last."""
    y = g["years"]
    ends = y.select("src", F.col("dst").alias("other"), "year", "strength").unionAll(y.select("dst", "src", "year", "strength")).groupBy(F.col("src").alias("character_id"), "year").agg(F.sum("strength").alias("strength"))
    return ends.groupBy("character_id").agg((F.max_by("strength", "year") - F.min_by("strength", "year")).alias("delta"), F.count("*").alias("years"))
