"""Scope, search, joins, the incremental scan and delivery: against plain code, the full scan, and a restart."""

from __future__ import annotations

import datetime
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from narralake.functions import text
from narralake.operators import consistency, joins, search
from narralake.plans.adapter import DRIVER, TABLES, Story
from narralake.plans.engine import Engine
from narralake.streaming.delivery import Inbox
from narralake.streaming.scan import IncrementalScan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def whole(spark):
    return Story(spark, SF)


@pytest.fixture(scope="module")
def scope(whole):
    one = whole["characters"].orderBy("character_id").first()
    return whole.scoped(one.story_id, one.user_id)


@pytest.mark.parametrize("name", [*DRIVER, *TABLES])
def test_scope_holds_nothing_foreign(whole, scope, name):
    own, all_ = scope[name], whole[name]
    key = [F.to_json(F.struct(*[F.col(c) for c in all_.columns]))]
    assert own.select(*key).exceptAll(all_.select(*key)).isEmpty()
    if "story_id" in own.columns:
        assert own.filter(F.col("story_id") != scope.story_id).isEmpty()
    for column in ("l_suppkey", "character_id", "s_suppkey", "src", "dst"):
        if column in own.columns and name != "source_lines":
            mine = whole["characters"].filter((F.col("story_id") == scope.story_id) & (F.col("user_id") == scope.user_id)).select(F.col("character_id").alias(column))
            assert own.select(column).join(mine, column, "left_anti").isEmpty()
    if name in ("supplier", "lineitem", "orders", "characters", "known"):
        assert not own.isEmpty() and own.count() < all_.count()


def test_a_foreign_owner_sees_nothing(whole, scope):
    stranger = whole.scoped(scope.story_id, "NOBODY")
    assert all(stranger[n].isEmpty() for n in (*DRIVER, "known", "turns", "locations", "entities"))
    with pytest.raises(PermissionError):
        scope.scoped(scope.story_id + 1, scope.user_id)
    with pytest.raises(PermissionError):
        scope.source("no_such_table")


@pytest.mark.parametrize(
    "query",
    [
        f"SELECT * FROM parquet.`{SF}/events.parquet`",
        f"SELECT * FROM {{events}} WHERE event_id IN (SELECT event_id FROM parquet.`{SF}/events.parquet`)",
        f"SELECT (SELECT max(event_id) FROM parquet.`{SF}/events.parquet`) AS x FROM {{known}}",
        f"WITH c AS (SELECT * FROM parquet.`{SF}/events.parquet`) SELECT * FROM c",
        f"SELECT 1 AS x UNION ALL SELECT event_id FROM parquet.`{SF}/events.parquet`",
        "SELECT * FROM other_view",
        "DROP TABLE x",
        "-- SELECT\nDROP TABLE x",
        "INSERT INTO t SELECT 1",
        "FROM {known} INSERT OVERWRITE DIRECTORY '/tmp/never' USING parquet SELECT *",
        "SELECT java_method('java.lang.System', 'getenv')",
    ],
)
def test_free_sql_reaches_the_scope_only(spark, scope, query):
    spark.range(3).createOrReplaceTempView("other_view")
    engine = Engine(spark, SF, allow_sql=True)
    with pytest.raises(PermissionError):
        engine.sql(query, scope.story_id, scope.user_id)
    got = engine.sql("WITH k AS (SELECT * FROM {known}) SELECT count(*) AS n FROM k WHERE knowledge_id IN (SELECT knowledge_id FROM {knows})", scope.story_id, scope.user_id)
    assert got.first().n == scope["known"].count()


def test_replaced_template_forgets_results(spark, scope):
    engine, at = Engine(spark, SF), {"story_id": scope.story_id, "user_id": scope.user_id}
    engine.add_template("mine", lambda g, day=None: g.spark.range(1))
    assert engine.template("mine", **at, day=datetime.date(2024, 1, 1)).count() == 1
    engine.add_template("mine", lambda g, day=None: g.spark.range(2))
    assert engine.template("mine", **at, day=datetime.date(2024, 1, 1)).count() == 2


def _bm25(texts: dict[int, list[str]], terms: set[str], k: int) -> list[tuple[int, float]]:
    usual = sum(map(len, texts.values())) / len(texts)
    score: dict[int, float] = {}
    for t in terms:
        df = sum(t in w for w in texts.values())
        for key, w in texts.items():
            if t in w:
                tf = w.count(t)
                score[key] = score.get(key, 0) + math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / usual))
    return sorted(((key, round(x, 6)) for key, x in score.items()), key=lambda r: (-r[1], r[0]))[:k]


def test_search_equals_brute_force_and_skips_blocks(spark, tmp_path):
    rng = random.Random(5)
    vocabulary = ["the", "king", "was", "dead", *[f"w{i}" for i in range(40)]]
    rows = [(g, 1000 * g + i, " ".join(rng.choices(vocabulary, [60, 1, 8, 2, *[3] * 40], k=rng.randint(0, 30))).title()) for g in range(3) for i in range(700 if g == 0 else 40)]
    rows += [(3, 1, None), (3, 2, "The KING, the king!")]
    frame = spark.createDataFrame(rows, "g int, k int, t string")
    search.build(frame, "g", "k", "t").save(str(tmp_path / "index"))
    index, terms = search.Index.load(spark, str(tmp_path / "index")), search.terms_of(spark, "the KING was dead, dead")
    got = sorted(search.search(index, terms, 5).collect(), key=lambda r: (r.group, r.place))
    for g in range(4):
        texts = {k: [] if t is None else [w for w in t.lower().replace(",", " ").replace("!", " ").split()] for h, k, t in rows if h == g}
        assert [(r.key, r.score) for r in got if r.group == g] == _bm25(texts, {"the", "king", "was", "dead"}, 5)
    counted = search.postings(index, terms, 5).filter("group = 0").count()
    assert counted < index.blocks.filter("group = 0 AND term IN ('the', 'king', 'was', 'dead')").agg(F.sum("n")).first()[0] / 2
    assert search.search(index, spark.createDataFrame([], "term string"), 5).isEmpty()


def test_before_pairs_splits_a_hot_key(spark):
    rng = random.Random(2)
    times = [None, *range(30)]
    a = [(1 if i % 2 else i % 40, i, rng.choice(times) if i % 5 else 7) for i in range(600)]
    b = [(1 if i % 2 else i % 40, i, rng.choice(times) if i % 5 else 7) for i in range(600)]
    want = sorted((k, i, j) for (k, i, s), (h, j, e) in itertools.product(a, b) if k == h and s is not None and e is not None and s > e)
    left, right = spark.createDataFrame(a, "k int, i int, s int"), spark.createDataFrame(b, "k int, j int, e int")
    for least in (10, 100, 5000):
        assert sorted((r.k, r.i, r.j) for r in joins.before_pairs(left, right, ["k"], "s", "e", least).collect()) == want
    sides = joins.dealt(left, right, ["k"], "s", "e", 10)
    for side in sides:
        sizes = side.groupBy("k", "cell_a", "cell_b").count()
        total, most = sizes.agg(F.sum("count"), F.max("count")).first()
        assert most <= 0.01 * total
    assert joins.before_pairs(left.limit(0), right, ["k"], "s", "e").isEmpty()


def test_containing(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("ab ", k=rng.randint(0, 6))) for _ in range(120)]
    x, y = spark.createDataFrame([(w,) for w in words], "x string"), spark.createDataFrame([(w,) for w in words[:60]], "y string")
    assert sorted(map(tuple, joins.containing(x, y).collect())) == sorted({(p, q) for p in words for q in words[:60] if q in p})


def test_family_matches_overlap_and_count(spark):
    families = {"a": ("laugh", "sad"), "b": ("happy", "tear", "rush", "delighted")}
    row = spark.createDataFrame([("laughappy sadsad tearush delightedelightedelighted",)], "t string")
    got = text.family_counts(row, F.col("t"), families).first()
    assert (got.a, got.b) == (3, 5)
    with pytest.raises(ValueError, match="begins another"):
        text.family_matches(F.col("t"), ["tear", "tears"])


LINKS = ("contradicts", "character_contradicts", "scene_contradicts")


def _found(frame):
    return sorted(map(tuple, frame.collect()))


def test_any_split_finds_what_the_full_scan_finds(spark, whole, tmp_path):
    rng = random.Random(1)
    scan = IncrementalScan(spark, str(tmp_path / "scan"))
    sources = {"statements": consistency.statements, "presences": consistency.presences, "states": consistency.states}
    links = {n: whole[n] for n in LINKS}
    own = {}
    made = [(1, 10, 11, t, y) for t, y in (("ally", 1), ("enemy", 2), ("ally", 3), ("friend", 3))]
    for kind, of in sources.items():
        frame = of(whole).filter("story_id % 5 = 0") if kind != "states" else spark.createDataFrame(made, "story_id int, src long, dst long, type string, created_at int")
        own[kind] = frame
        part = F.pmod(F.xxhash64(*frame.columns, F.lit(rng.random())), F.lit(3))
        for batch in range(3):
            scan.add(kind, frame.filter(part == batch), batch)
    got = _found(scan.findings(links))
    want = []
    for name, rule in consistency.PAIR_RULES.items():
        rows = own[rule.source.__name__]
        want += _found(rule.findings(name, rule.pairs(rows, rows), links[rule.links]))
    assert got == sorted(want) and {"temporal", "relationship", "location", "unlinked"} <= {r[0] for r in got}


def test_a_stream_that_stops_midway_counts_once(spark, whole, tmp_path):
    rows = consistency.statements(whole).filter("story_id % 5 = 1")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rules = {n: consistency.PAIR_RULES[n] for n in ("temporal", "state")}
    scan, calls = IncrementalScan(spark, str(tmp_path / "scan"), rules), []
    add = scan.add

    def failing(kind, batch, number):
        add(kind, batch, number)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost after the batch was written")

    scan.add = failing
    with pytest.raises(Exception, match="lost"):
        scan.follow("statements", stream(), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    scan.follow("statements", stream(), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    assert calls[1] == calls[2] and len(calls) >= 4
    links = {n: whole[n] for n in LINKS}
    assert _found(scan.findings(links)) == sorted(x for n, r in rules.items() for x in _found(r.findings(n, r.pairs(rows, rows), links[r.links])))


def test_alerts_are_delivered_once_and_to_their_user(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    schema = "event_id long, user_id string, reason string, severity string, alert_type string, detected_at timestamp"
    alerts = [(i, f"u{i % 3}", "x", "high", "contradiction_detected", at) for i in range(12)]
    for n in range(3):
        spark.createDataFrame(alerts[4 * n : 4 * n + 4] + alerts[:1], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    box, calls = Inbox(spark, str(tmp_path / "box")), []
    deliver = box.deliver

    def failing(rows, number):
        deliver(rows, number)
        calls.append(number)
        if len(calls) == 2:
            raise RuntimeError("lost behind the ledger")

    box.deliver = failing
    with pytest.raises(Exception, match="lost"):
        box.follow(stream(), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    box.follow(stream(), str(tmp_path / "cp"), availableNow=True).awaitTermination()
    for u in range(3):
        got = box.read(f"u{u}").collect()
        assert sorted(r.event_id for r in got) == [i for i in range(12) if i % 3 == u] and {r.user_id for r in got} == {f"u{u}"}
        rest = box.read(f"u{u}", (got[0].batch, got[0].seq)).collect()
        assert [r.event_id for r in rest] == [r.event_id for r in got[1:]]
    assert box.read("nobody").isEmpty()
