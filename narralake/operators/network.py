"""Social-network operators over the projection (src, dst) of a story's ties.

The projection is written once, and so is every round: plans don't grow with rounds, and lineitem is read once. Rounds
go on until nothing new is reached; frontiers and ranks are tables. Stories don't touch each other, so all are run at
once. `brandes` and `louvain_members` take a story as one group of bounded cost; larger stories go the way of joins.
"""

from __future__ import annotations

from collections import deque
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.plans.adapter import Story
from narralake.plans.storage import discard, written

PROJECTED = ("FRIENDS_WITH", "KNOWS", "ACQUAINTED_WITH")
#: What a story may cost as one group: edges for communities, nodes times edges for betweenness.
GROUP_EDGES, GROUP_STEPS = 200_000, 50_000_000
BLOCK = 4_000_000
#: Pairs of a story that half moves take as one group of arrays (about 100 MB for its rows).
MOVED_EDGES = 1_000_000
ROUNDS, LEVELS = 32, 12


def projection(g: Story) -> DataFrame:
    return g["sna_edges"].filter(F.col("type").isin(*PROJECTED)).select("story_id", "src", "dst", "strength")


def pairs(g: Story) -> DataFrame:
    """(story_id, src, dst), each once, written."""
    return written(projection(g).select("story_id", "src", "dst").distinct(), "projection")


def network_full(g: Story, types: tuple[str, ...] = PROJECTED, min_strength: int = 0, min_trust: int = 0) -> DataFrame:
    """Edges of these types from these bounds on."""
    return g["sna_edges"].filter(F.col("type").isin(*types) & (F.col("strength") >= min_strength) & (F.col("trust_level") >= min_trust)).select("src", "dst", "type", "strength", "trust_level")


def network_nodes(g: Story, types: tuple[str, ...] = PROJECTED, min_strength: int = 0, min_trust: int = 0) -> DataFrame:
    """The characters of a story with their number of such edges, none included."""
    n = network_full(g, types, min_strength, min_trust).groupBy(F.col("src").alias("character_id")).agg(F.count("*").alias("edges"))
    return g["characters"].join(n, "character_id", "left").select("character_id", "name", F.coalesce("edges", F.lit(0)).alias("edges"))


def network_episode_range(g: Story, start: int, end: int) -> DataFrame:
    cast = g["present_in"].join(g["scenes"].filter(F.col("scene_order").between(start, end)), "scene_id").select("character_id").distinct()
    return network_full(g).join(cast.withColumnRenamed("character_id", "src"), "src", "left_semi").join(cast.withColumnRenamed("character_id", "dst"), "dst", "left_semi").select("src", "dst", "type", "strength")


def distances(g: Story, depth: int | None = None, start: int | None = None, e: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(start, node, dist) up to depth hops, or as far as paths go: a frontier a round, less what has been seen. e, nodes: other
    edges and starts than the graph's."""
    e = pairs(g) if e is None else e
    nodes = g["characters"].select(F.col("character_id").alias("start")) if nodes is None else nodes
    nodes = nodes if start is None else nodes.filter(F.col("start") == start)
    seen = frontier = written(nodes.select("start", F.col("start").alias("node"), F.lit(0).alias("dist")), "frontier")
    for d in count(1):
        if depth is not None and d > depth:
            break
        reached = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(d).alias("dist")).distinct()
        frontier = written(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def network_ego(g: Story, character_id: int, degrees: int = 2) -> DataFrame:
    return distances(g, degrees, character_id).select("node", "dist")


def degree_centrality(g: Story) -> DataFrame:
    n = projection(g).groupBy("src").agg(F.count("*").alias("degree"))
    return g["characters"].join(n, F.col("character_id") == F.col("src"), "left").select("character_id", F.coalesce("degree", F.lit(0)).alias("degree"))


def hops(own: np.ndarray, src: np.ndarray, dst: np.ndarray) -> pd.DataFrame:
    """(start, dist, n): how many nodes are so many hops away from each of `own`; searches run level by level in blocks of
    starts, of about BLOCK flags and BLOCK edges at once."""
    names, at = np.unique(np.concatenate([own, src, dst]), return_inverse=True)
    starts, a, b = np.split(at, [len(own), len(own) + len(src)])
    order = np.argsort(a, kind="stable")
    to, first = b[order], np.searchsorted(a[order], np.arange(len(names) + 1))
    rows, size = [], max(1, BLOCK // max(len(names), len(src), 1))
    for i in range(0, len(starts), size):
        node = starts[i : i + size]
        row, seen = np.arange(len(node)), np.zeros((len(node), len(names)), bool)
        seen[row, node] = True
        for dist in count(1):
            degree = first[node + 1] - first[node]
            row = np.repeat(row, degree)
            node = to[np.repeat(first[node] - (np.cumsum(degree) - degree), degree) + np.arange(len(row))]
            fresh = ~seen[row, node]
            row, node = np.divmod(np.unique(row[fresh] * len(names) + node[fresh]), len(names))
            if not len(row):
                break
            seen[row, node] = True
            who, n = np.unique(row, return_counts=True)
            rows.append(pd.DataFrame({"start": names[starts[i + who]], "dist": np.int32(dist), "n": n}))
    return pd.concat(rows) if rows else pd.DataFrame({"start": [], "dist": [], "n": []})


def hop_counts(g: Story) -> DataFrame:
    """(start, dist, n) for all distances, without a table of pairs. A story of at most GROUP_EDGES edges goes to tasks with all
    its edges, its starts dealt over them by GROUP_STEPS; larger ones go the way of joins."""
    (cast, few), rest = _by_cost(g, pairs(g), F.col("edges"), GROUP_EDGES)
    starts = few.select("story_id", F.col("src").alias("start")).distinct().join(cast.select(F.col("character_id").alias("start")), "start", "left_semi")
    sizes = starts.groupBy("story_id").agg(F.count("*").alias("nodes")).join(few.groupBy("story_id").agg(F.count("*").alias("edges")), "story_id")
    parts = sizes.select("story_id", F.ceil(F.col("nodes") * F.col("edges") / GROUP_STEPS).cast("int").alias("parts"))
    dealt = starts.join(parts, "story_id").select(F.col("story_id").alias("story_id"), F.pmod(F.xxhash64("start"), F.col("parts")).cast("int").alias("part"), "start")
    copies = few.join(parts, "story_id").select(F.col("story_id").alias("story_id"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "src", "dst")

    def group(key: tuple, own: pd.DataFrame, ties: pd.DataFrame) -> pd.DataFrame:
        return hops(*(c.to_numpy(np.int64) for c in (own["start"], ties["src"], ties["dst"])))

    small = dealt.groupBy("story_id", "part").cogroup(copies.groupBy("story_id", "part")).applyInPandas(group, "start long, dist int, n long")
    if rest is None:
        return small
    far = distances(g, e=rest[1], nodes=rest[0].select(F.col("character_id").alias("start"))).filter("dist > 0")
    return small.unionByName(far.groupBy("start", "dist").agg(F.count("*").alias("n")))


def closeness(g: Story) -> DataFrame:
    return hop_counts(g).groupBy("start").agg(F.sum("n").alias("reachable"), F.sum(F.col("n") * F.col("dist")).alias("total")).withColumn("closeness", F.round(F.col("reachable") / F.col("total"), 6))


def influence_paths(g: Story, top: int = 20) -> DataFrame:
    """The shortest distances between two characters; the top report itself is the feature. Paths grow hop by hop, and only
    until `top` pairs are met: those that are farther apart can't be among them."""
    c, e = g["characters"], pairs(g)
    a, b = c.select(F.col("character_id").alias("start"), F.col("name").alias("name_1")), c.select(F.col("character_id").alias("node"), F.col("name").alias("name_2"))
    seen = frontier = written(e.select(F.col("src").alias("start"), F.col("dst").alias("node"), F.lit(1).alias("dist")).filter("start <> node"), "frontier")
    for d in count(2):
        if frontier.isEmpty() or seen.count() >= top:
            break
        reached = frontier.join(e, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(d).alias("dist")).filter("start <> node").distinct()
        frontier = written(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.join(a, "start").join(b, "node").orderBy("dist", "name_1", "name_2").limit(top).select("name_1", "name_2", "dist")


def distance_histogram(g: Story) -> DataFrame:
    return hop_counts(g).groupBy("dist").agg(F.sum("n").alias("n"))


def pagerank(g: Story, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(1 - d) + d * sum of rank / out-degree over in-edges, from (1 - d), a fixed number of rounds."""
    e = pairs(g)
    share = written(e.join(e.groupBy("src").agg(F.count("*").alias("k")), "src").select("src", "dst", "k"), "share")
    everyone = written(g["characters"].select("character_id"), "everyone")
    rank = everyone.withColumn("rank", F.lit(1 - damping))
    for _ in range(rounds):
        sent = share.join(rank, F.col("src") == F.col("character_id")).groupBy("dst").agg(F.sum(F.col("rank") / F.col("k")).alias("got"))
        before, rank = rank, written(everyone.join(sent, F.col("character_id") == F.col("dst"), "left").select("character_id", ((1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")), "rank")
        if hasattr(before, "written_to"):
            discard(before)
    return rank.withColumn("rank", F.round("rank", 6))


def label_propagation(g: Story, rounds: int = 2) -> DataFrame:
    """Every round a node takes its neighbours' most frequent label, the least of equals; a fixed number of rounds."""
    e = pairs(g)
    label = written(g["characters"].select("character_id", F.col("character_id").alias("label")), "label")
    for _ in range(rounds):
        votes = e.join(label, F.col("dst") == F.col("character_id")).groupBy("src", "label").agg(F.count("*").alias("n"))
        best = votes.groupBy("src").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("x")).select("src", F.col("x.label").alias("new"))
        before, label = label, written(label.join(best, F.col("character_id") == F.col("src"), "left").select("character_id", F.coalesce("new", "label").alias("label")), "label")
        discard(before)
    return label


def louvain_members(nodes: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """node -> community, named by its least member. Each edge has weight 1 in both directions together; moves go in the
    order of ids, to the community of the largest gain in modularity, the one of the least name among equals, and levels
    are folded until none moves."""
    weight: dict[int, dict[int, float]] = {n: {} for n in nodes}
    for a, b in edges:
        for x, y in ((a, b), (b, a)):
            weight[x][y] = weight[x].get(y, 0.0) + 0.5
    member = {n: n for n in nodes}
    total = sum(sum(w.values()) for w in weight.values())
    while total:
        own = {n: n for n in weight}
        degree = {n: sum(w.values()) for n, w in weight.items()}
        held = dict(degree)
        moved, again = False, True
        while again:
            again = False
            for n in sorted(weight):
                links: dict[int, float] = {own[n]: 0.0}
                for m, w in weight[n].items():
                    if m != n:
                        links[own[m]] = links.get(own[m], 0.0) + w
                held[own[n]] -= degree[n]
                gain = {c: w - held[c] * degree[n] / total for c, w in links.items()}
                best = min(gain, key=lambda c: (-round(gain[c], 12), c))
                if gain[best] <= gain[own[n]] + 1e-12:
                    best = own[n]
                held[best] += degree[n]
                if best != own[n]:
                    own[n], moved, again = best, True, True
        if not moved:
            break
        folded: dict[int, dict[int, float]] = {}
        for n, w in weight.items():
            into = folded.setdefault(own[n], {})
            for m, x in w.items():
                into[own[m]] = into.get(own[m], 0.0) + x
        weight = folded
        member = {n: own[c] for n, c in member.items()}
    least: dict[int, int] = {}
    for n, c in member.items():
        least[c] = min(n, least.get(c, n))
    return {n: least[c] for n, c in member.items()}


def modularity(members: DataFrame, edges: DataFrame) -> DataFrame:
    """story_id, q. members: story_id, character_id, community; edges: story_id, src, dst, each direction with weight 1/2."""
    one, two = members.select(F.col("character_id").alias("src"), F.col("community").alias("c1")), members.select(F.col("character_id").alias("dst"), F.col("community").alias("c2"))
    ends = edges.select("story_id", "src", "dst").join(one, "src").join(two, "dst")
    total = ends.groupBy("story_id").agg(F.count("*").alias("m"), F.sum((F.col("c1") == F.col("c2")).cast("int")).alias("inside"))
    degree = ends.select("story_id", F.explode(F.array("c1", "c2")).alias("c")).groupBy("story_id", "c").agg(F.count("*").alias("d"))
    return degree.join(total, "story_id").groupBy("story_id").agg((F.first("inside") / F.first("m") - F.sum(F.pow(F.col("d") / (2 * F.col("m")), F.lit(2)))).alias("q"))


def _half_moves(w: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, bool]:
    """w: story_id, a, b, w (both directions, loops too) -> (a, own: its community), whether any node moved. Every round each
    node looks for the community of the largest gain, the least name among equals; of those that gain, half move, chosen
    by a hash of node and round, so that neighbours don't change places for ever."""
    degree = w.groupBy("story_id", "a").agg(F.sum("w").alias("degree"))
    node = degree.join(degree.groupBy("story_id").agg(F.sum("degree").alias("total")), "story_id")
    own = written(node.select("story_id", "a", "degree", "total", F.col("a").alias("own")), "own")
    others, moved = w.filter("a <> b").select("a", "b", "w"), False
    for r in range(rounds):
        links = others.join(own.select(F.col("a").alias("b"), F.col("own").alias("c")), "b").select("a", "c", "w")
        options = links.unionByName(own.select("a", F.col("own").alias("c"), F.lit(0.0).alias("w"))).groupBy("a", "c").agg(F.sum("w").alias("w"))
        held = own.groupBy(F.col("own").alias("c")).agg(F.sum("degree").alias("held"))
        both = options.join(held, "c").join(own.select("story_id", "a", "degree", "total", "own"), "a")
        gain = F.round(F.col("w") - (F.col("held") - F.when(F.col("c") == F.col("own"), F.col("degree")).otherwise(0.0)) * F.col("degree") / F.col("total"), 12)
        best = both.withColumn("gain", gain).groupBy("story_id", "a", "degree", "total", "own").agg(F.min(F.struct((-F.col("gain")).alias("loss"), "c")).alias("best"), F.max(F.when(F.col("c") == F.col("own"), F.col("gain"))).alias("home"))
        wants = -F.col("best.loss") > F.col("home") + 1e-12
        go = wants & (F.pmod(F.xxhash64("a", F.lit(r)), F.lit(2)) == 0)
        own_next = written(best.select("story_id", "a", "degree", "total", F.when(go, F.col("best.c")).otherwise(F.col("own")).alias("own"), wants.alias("wants"), go.alias("went")), "own")
        wanting, went = own_next.agg(F.sum(F.col("wants").cast("int")), F.sum(F.col("went").cast("int"))).first()
        discard(own)
        own, moved = own_next, moved or bool(went)
        if not wanting:
            break
    return own.select("a", "own"), moved


def _half_move_levels(nodes: np.ndarray, turns: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The community of each of a story's nodes (sorted), by the rounds and levels of `louvain_by_joins` on arrays. turns: bit r
    says whether a node may move in round r; a, b: places of the ends of each pair."""
    community = np.arange(len(nodes))
    edges = (np.concatenate([a, b]), np.concatenate([b, a]), np.full(2 * len(a), 0.5))

    def summed(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        key, at = np.unique(x * len(nodes) + y, return_inverse=True)
        return key // len(nodes), key % len(nodes), np.bincount(at, w, len(key))

    for _ in range(LEVELS):
        x, y, w = edges = summed(*edges)
        degree = np.bincount(x, w, len(nodes))
        live, total = np.unique(x), degree.sum()
        own, moved, other = np.arange(len(nodes)), False, x != y
        for r in range(ROUNDS):
            u, c, links = summed(np.concatenate([x[other], live]), np.concatenate([own[y[other]], own[live]]), np.concatenate([w[other], np.zeros(len(live))]))
            held = np.bincount(own[live], degree[live], len(nodes))
            gain = np.round(links - (held[c] - np.where(c == own[u], degree[u], 0.0)) * degree[u] / total, 12)
            order = np.lexsort((c, -gain, u))
            first = order[np.searchsorted(u[order], live)]
            home = np.zeros(len(nodes))
            home[u[c == own[u]]] = gain[c == own[u]]
            wants = gain[first] > home[live] + 1e-12
            go = wants & ((turns[live] >> r) & 1 == 0)
            own[live[go]] = c[first[go]]
            moved |= bool(go.any())
            if not wants.any():
                break
        if not moved:
            break
        least = np.full(len(nodes), len(nodes))
        np.minimum.at(least, own[live], live)
        name = np.arange(len(nodes))
        name[live] = least[own[live]]
        community, edges = name[community], (name[x], name[y], w)
    least = np.full(len(nodes), len(nodes))
    np.minimum.at(least, community, np.arange(len(nodes)))
    return nodes[least[community]]


def louvain_by_joins(g: Story, e: DataFrame | None = None) -> DataFrame:
    """`louvain_by_tables`; stories of at most MOVED_EDGES pairs go through the same rounds as one group on arrays, with the same
    result, for a round of joins costs seconds however little moves."""
    (cast, few), rest = _by_cost(g, pairs(g) if e is None else e, F.col("edges"), MOVED_EDGES)
    turns = reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(F.pmod(F.xxhash64("character_id", F.lit(r)), F.lit(2)).cast("long"), r) for r in range(ROUNDS)])
    cast = cast.select("story_id", "character_id").distinct().withColumn("turns", turns)

    def group(key: tuple, cast: pd.DataFrame, ties: pd.DataFrame) -> pd.DataFrame:
        cast = cast.sort_values("character_id")
        nodes = cast["character_id"].to_numpy()
        found = _half_move_levels(nodes, cast["turns"].to_numpy(), *(np.searchsorted(nodes, ties[k].to_numpy()) for k in ("src", "dst")))
        return pd.DataFrame({"character_id": nodes, "community": found})

    small = cast.groupBy("story_id").cogroup(few.groupBy("story_id")).applyInPandas(group, "character_id long, community long")
    if rest is None:
        return small
    return small.unionByName(louvain_by_tables(g, rest[1]).join(rest[0].select("character_id"), "character_id", "left_semi"))


def louvain_by_tables(g: Story, e: DataFrame | None = None) -> DataFrame:
    """character_id, community (its least member): the same measure as `louvain`, with tables only and no bound of a story's
    size. Levels are rounds of half moves; then communities become nodes, and their edges are summed. The result is
    the same on every run; it need not be the one of single moves in the order of ids."""
    e = pairs(g) if e is None else e
    half = e.select("story_id", F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(e.select("story_id", F.col("dst").alias("a"), F.col("src").alias("b")))
    w = written(half.groupBy("story_id", "a", "b").agg((F.count("*") / 2).alias("w")), "weights")
    member = written(g["characters"].select("character_id", F.col("character_id").alias("community")), "members")
    for _ in range(LEVELS):
        own, moved = _half_moves(w)
        if not moved:
            break
        names = own.groupBy("own").agg(F.min("a").alias("name"))
        own = written(own.join(names, "own").select("a", F.col("name").alias("own")), "folded")
        member = written(member.join(own, F.col("community") == F.col("a"), "left").select("character_id", F.coalesce("own", "community").alias("community")), "members")
        up = w.join(own.select("a", F.col("own").alias("na")), "a").join(own.select(F.col("a").alias("b"), F.col("own").alias("nb")), "b")
        w = written(up.groupBy("story_id", F.col("na").alias("a"), F.col("nb").alias("b")).agg(F.sum("w").alias("w")), "weights")
    least = member.groupBy("community").agg(F.min("character_id").alias("least"))
    return member.join(least, "community").select("character_id", F.col("least").alias("community"))


def _by_cost(g: Story, e: DataFrame, cost: Column, most: int) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """(characters, edges) of the stories that cost at most so much as one group, and of the others, if there are any."""
    cast = g["characters"].select("story_id", "character_id")
    n = cast.groupBy("story_id").agg(F.count("*").alias("nodes")).join(e.groupBy("story_id").agg(F.count("*").alias("edges")), "story_id")
    large = written(n.filter(cost > most).select("story_id"), "large")
    if large.isEmpty():
        return (cast, e), None
    cut = lambda rows, how: rows.join(large, "story_id", how)
    return (cut(cast, "left_anti"), cut(e, "left_anti")), (cut(cast, "left_semi"), cut(e, "left_semi"))


def louvain(g: Story) -> DataFrame:
    """character_id, community: by modularity, story by story; those of over GROUP_EDGES edges by joins."""
    (cast, few), rest = _by_cost(g, pairs(g), F.col("edges"), GROUP_EDGES)

    def group(key: tuple, cast: pd.DataFrame, ties: pd.DataFrame) -> pd.DataFrame:
        found = louvain_members(sorted(cast["character_id"].tolist()), list(zip(ties["src"].tolist(), ties["dst"].tolist(), strict=True)))
        return pd.DataFrame({"character_id": list(found), "community": list(found.values())})

    small = cast.groupBy("story_id").cogroup(few.groupBy("story_id")).applyInPandas(group, "character_id long, community long")
    if rest is None:
        return small
    return small.unionByName(louvain_by_joins(g, rest[1]).join(rest[0].select("character_id"), "character_id", "left_semi"))


def communities(g: Story) -> DataFrame:
    """Each community with its members' names in order, and their number."""
    named = louvain(g).join(g["characters"].select("character_id", "name"), "character_id")
    return named.groupBy("community").agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))


def propagated_communities(g: Story) -> DataFrame:
    named = label_propagation(g).join(g["characters"].select("character_id", "name"), "character_id")
    return named.groupBy("label").agg(F.count("*").alias("total"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("members"))


def clustering(g: Story) -> DataFrame:
    """Local coefficients on the undirected simple graph; triangles by edges oriented from low to high."""
    e = written(projection(g).filter("src < dst").select("src", "dst").distinct(), "oriented")
    ab, ac, bc = e.toDF("a", "b"), e.toDF("a", "c"), e.toDF("b", "c")
    tri = ab.join(ac, "a").filter("b < c").join(bc, ["b", "c"]).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    deg = e.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    return deg.join(tri, "node", "left").na.fill(0).select("node", "d", "triangles", F.round(F.when(F.col("d") > 1, 2 * F.col("triangles") / (F.col("d") * (F.col("d") - 1))).otherwise(0.0), 6).alias("coefficient"))


def global_clustering(g: Story) -> DataFrame:
    c = clustering(g)
    return c.agg(F.sum("triangles").alias("corners"), F.sum(F.expr("d * (d - 1) div 2")).alias("wedges")).withColumn("coefficient", F.round(F.col("corners") / F.col("wedges"), 6))


def relationship_tension(g: Story, below: int = 5) -> DataFrame:
    r = g["relationships"].filter(F.col("relationship_strength") < below)
    both = r.select("src", "dst", "relationship_strength").union(r.select("dst", "src", "relationship_strength"))
    return both.groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("relationship_strength").alias("total"))


def network_density(g: Story) -> DataFrame:
    """By story, on the undirected simple graph."""
    e = projection(g).select("story_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().groupBy("story_id").agg(F.count("*").alias("e"))
    n = g["characters"].groupBy("story_id").agg(F.count("*").alias("n"))
    return n.join(e, "story_id", "left").na.fill(0).select("story_id", "n", "e", F.round(F.when(F.col("n") > 1, 2 * F.col("e") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0), 6).alias("density"))


def key_influencers(g: Story, top: int = 5) -> DataFrame:
    """The top report itself is the feature."""
    return pagerank(g).join(g["characters"].select("character_id", "name"), "character_id").orderBy(F.desc("rank"), "name").limit(top).select("name", "rank")


def brandes(nodes: list[int], edges: list[tuple[int, int]], steps: int | None = None) -> dict[int, float]:
    """Shortest-path betweenness of directed unweighted edges: a breadth-first search from every node, and its
    dependencies summed from the far end. steps: paths of so many edges at most count; without it, all do."""
    out: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in sorted(set(edges)):
        out[a].append(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, ways, before, order, queue = {s: 0}, {s: 1.0}, {s: []}, [], deque([s])
        while queue:
            v = queue.popleft()
            order.append(v)
            for w in out[v] if steps is None or dist[v] < steps else ():
                if w not in dist:
                    dist[w], ways[w], before[w] = dist[v] + 1, 0.0, []
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    ways[w] += ways[v]
                    before[w].append(v)
        share = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in before[w]:
                share[v] += ways[v] / ways[w] * (1 + share[w])
            if w != s:
                score[w] += share[w]
    return score


def betweenness(g: Story, steps: int | None = None) -> DataFrame:
    """Story by story where nodes times edges are at most GROUP_STEPS, else by joins; of all shortest paths, or of those of
    `steps` edges at most."""
    (cast, few), rest = _by_cost(g, pairs(g), F.col("nodes") * F.col("edges"), GROUP_STEPS)

    def group(key: tuple, cast: pd.DataFrame, ties: pd.DataFrame) -> pd.DataFrame:
        found = brandes(sorted(cast["character_id"].tolist()), list(zip(ties["src"].tolist(), ties["dst"].tolist(), strict=True)), steps)
        return pd.DataFrame({"character_id": list(found), "betweenness": list(found.values())})

    small = cast.groupBy("story_id").cogroup(few.groupBy("story_id")).applyInPandas(group, "character_id long, betweenness double")
    small = small.withColumn("betweenness", F.round("betweenness", 4) + 0.0)
    if rest is None:
        return small
    return small.unionByName(betweenness_by_joins(g, rest[1], rest[0].select("character_id"), steps))


def betweenness_by_joins(g: Story, e: DataFrame | None = None, cast: DataFrame | None = None, steps: int | None = None) -> DataFrame:
    """The same with tables only: paths are counted on the way out; on the way back, farthest nodes first, each node
    hands its dependency to those before it. Rows are (source, node) pairs, never triples."""
    e = pairs(g) if e is None else e
    cast = g["characters"].select("character_id") if cast is None else cast
    front = written(cast.select(F.col("character_id").alias("s"), F.col("character_id").alias("t"), F.lit(0).alias("d"), F.lit(1.0).alias("ways")), "paths")
    levels = [front]
    while steps is None or len(levels) <= steps:
        seen = levels[0]
        for more in levels[1:]:
            seen = seen.unionByName(more)
        reached = front.join(e.select(F.col("src").alias("t"), "dst"), "t").groupBy("s", F.col("dst").alias("t")).agg(F.sum("ways").alias("ways"))
        front = written(reached.join(seen.select("s", "t"), ["s", "t"], "left_anti").select("s", "t", F.lit(len(levels)).alias("d"), "ways"), "paths")
        if front.isEmpty():
            break
        levels.append(front)
    shares, score = None, []
    for level in reversed(levels[1:]):
        own = level.withColumn("share", F.lit(0.0)) if shares is None else level.join(shares, ["s", "t"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
        own = written(own, "shares")
        score.append(own.groupBy(F.col("t").alias("character_id")).agg(F.sum("share").alias("x")))
        depth = len(levels) - len(score) - 1
        back = own.select("s", F.col("t").alias("dst"), (((1 + F.col("share")) / F.col("ways"))).alias("part")).join(e.select(F.col("src").alias("t"), "dst"), "dst")
        shares = back.join(levels[depth].select("s", "t", "ways"), ["s", "t"]).groupBy("s", "t").agg(F.sum(F.col("part") * F.col("ways")).alias("share"))
    total, found = cast, None
    for part in score:
        found = part if found is None else found.unionByName(part)
    if found is None:
        return total.withColumn("betweenness", F.lit(0.0))
    return total.join(found.groupBy("character_id").agg(F.sum("x").alias("x")), "character_id", "left").select("character_id", F.round(F.coalesce("x", F.lit(0.0)), 4).alias("betweenness"))


def bridge_characters(g: Story, top: int = 10, steps: int | None = None) -> DataFrame:
    return betweenness(g, steps).join(g["characters"].select("character_id", "name"), "character_id").orderBy(F.desc("betweenness"), "name").limit(top).select("name", "betweenness")


def rank_in_story(g: Story) -> DataFrame:
    w = Window.partitionBy("story_id").orderBy(F.desc("degree"), "character_id")
    return degree_centrality(g).join(g["characters"].select("character_id", "story_id"), "character_id").select("story_id", "character_id", "degree", F.row_number().over(w).alias("place"))
