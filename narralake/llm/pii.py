"""Operator 11 [native]: personal data by candidate gradient boosting, DataFrame functions only.

1. Generators propose candidate spans: the base pattern of each kind, and looser ones that find what base patterns merge,
   cut or don't know (numbers in groups, national and international phone forms, runs of digits alone, addresses with
   bracketed at and dot). Proposals overlap. A pattern's places come from the text split by it; each candidate keeps its
   span and small whole numbers that describe its format and its context (CHECKS, FEATURES).
2. A candidate that equals a valid base span teaches "yes"; one that breaks its kind's format (Luhn, octets, digits, top
   level domain) or crosses a base span teaches "no"; one that lies inside a base span, or meets none, teaches nothing.
   Candidates are counted by their features, over all documents, and all counted vectors of a kind train its boosted trees
   by logistic loss. Up to VECTORS of them are fitted on the driver; of more, only the histograms of a tree's level come
   there, and Spark sums them. The features leave out what only the base pattern asks for (the plus sign of a phone, the at
   sign of an address), so that the trees judge other forms by format and context.
3. A quarter of the documents, by a hash of their id, is kept from the fit and calibrates: a kind's threshold is the least
   score from which on at least PRECISION of what they teach is "yes"; a kind without such a score adds nothing.
4. Trees become CASE expressions. Candidates of valid format that reach their kind's threshold and meet no base span are
   added; those that overlap each other become one span of the best one's kind. Base spans all stay.

Nulls: a null text is an empty one, without spans; null ids stay. Empty tables give no rows. Rows repeated under one id
are each searched. Very long texts and runs are searched whole, every pattern in linear time. Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narralake.llm.common import id_and_text, materialize

KINDS = ("email", "ip", "card", "phone")
VECTORS, TREES, DEPTH, RATE, LAMBDA, LEAST, PRECISION = 20_000, 30, 3, 0.3, 1.0, 3.0, 0.98
UNIT = float(1 << 24)

#: (kind, pattern, a text without this holds no match). The first four are the base; possessive forms of the same matches.
GENERATORS: tuple[tuple[str, str, str], ...] = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9]++(?:[\x20-][0-9]++)*+(?<=[0-9][\x20-]?[0-9])", ""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[\p{L}0-9-]{1,63}+(?:\x20?(?:\.|[\[(](?:dot|DOT)[\])])\x20?[\p{L}0-9-]{1,63}+)++", "t"),
    ("email", r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]{1,64}+@[\p{L}0-9-]{1,63}+(?:\.[\p{L}0-9-]{1,63}+)++", "@"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}(?!\.?[0-9])", "."),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
    ("card", r"(?<![0-9])[0-9]{13,19}+(?![0-9])", ""),
    ("card", r"(?<![0-9])(?:[0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}[\x20.-][0-9]{4}|3[0-9]{3}[\x20.-][0-9]{6}[\x20.-][0-9]{5})(?![0-9])", ""),
    ("phone", r"\+[0-9]{1,3}+[\x20.-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])", "+"),
    ("phone", r"(?<![0-9+.-])(?:00[0-9]{1,3}[\x20.-])?(?:\([0-9]{2,4}\)\x20?|[0-9]{3,4}[.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9.-])", ""),
)
BASE = 4
#: What stands before a candidate: words that go with a kind, and words of numbers that are none.
HINTS = {
    1: r"(?i)(?:e-?mail|mail|contact|write|courriel|correo)\W{0,3}(?:\p{L}+\W{0,3})?$",
    2: r"(?i)(?:\bip|address|host|server|client|from|adresse)\W{0,3}(?:\p{L}+\W{0,3})?$",
    3: r"(?i)(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|pan)\W{0,3}(?:\p{L}+\W{0,3})?$",
    4: r"(?i)(?:call|phone|tel|mobile|fax|cell|dial|whatsapp|telefon|tél|teléfono)\W{0,3}(?:\p{L}+\W{0,3})?$",
    5: r"(?i)(?:version|release|isbn|issn|order|invoice|ticket|serial|section|chapter|page|date|build|\bid|\bno|nr|\bv|doi|figure|token|password|key)\W{0,3}$",
}
FEATURES = ("fits", "digits", "parts", "first_len", "last_len", "seps", "left", "right", "hint", "letters")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]+", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    place = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(place, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def octets(x: Column) -> Column:
    return ~F.exists(F.split(x, "\\."), lambda p: ~p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


#: kind -> whether a base match counts.
CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": octets,
    "card": lambda m: F.when(F.length(_digits(m)).between(13, 19), luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
#: kind -> whether a candidate of another pattern has the kind's format at all.
FORMATS = {
    "email": lambda m: m.rlike(r"(?:\.|[\])]\x20?)\p{L}{2,24}$"),
    "ip": lambda m: m.contains(":") | octets(m),
    "card": CHECKS["card"],
    "phone": CHECKS["phone"],
}


def _by_kind(kind: Column, of: dict[str, Column]) -> Column:
    return reduce(lambda acc, kv: acc.when(kind == KINDS.index(kv[0]), kv[1]), of.items(), F).otherwise(F.lit(False))


def _matches(text: Column, number: int) -> Column:
    """All matches of a generator: gap (what lies before it since the last match), m, and what follows up to the next."""
    kind, pattern, needs = GENERATORS[number]
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    after = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda p: F.substring(p, 1, 1))
    zipped = F.filter(F.arrays_zip(parts.alias("p"), found.alias("m"), after.alias("a")), lambda z: z["m"].isNotNull())
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(number).alias("gen"), i.alias("i"), F.length(z["p"]).alias("gap"), F.substring(z["p"], -40, 40).alias("before"), z["m"].alias("m"), F.coalesce(z["a"], F.lit("")).alias("after")))
    return F.when(F.contains(text, F.lit(needs)), rows).otherwise(F.array().cast(_ROWS)) if needs else rows


_ROWS = "array<struct<gen:int,i:int,gap:int,before:string,m:string,after:string>>"


def _class(x: Column) -> Column:
    """Of one character: 0 none or blank, 1 letter, 2 digit, 3 another one."""
    return F.when((x == "") | x.rlike(r"^\s"), 0).when(x.rlike(r"^\p{L}"), 1).when(x.rlike("^[0-9]"), 2).otherwise(3)


def candidates(docs: DataFrame) -> DataFrame:
    """docs: rid, doc_id, text -> rid, doc_id, gen, kind, start, end (code points, end exclusive), base and FEATURES; and a
    row of gen -1 for each document."""
    numbered = docs.select("rid", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array(F.struct(F.lit(-1).alias("gen"), F.lit(0).alias("i"), F.lit(0).alias("gap"), F.lit("").alias("before"), F.lit("").alias("m"), F.lit("").alias("after")))
    some = F.when(F.col("text").rlike("[0-9@\\[(]"), F.concat(*[_matches(F.col("text"), g) for g in range(len(GENERATORS))])).otherwise(F.array().cast(_ROWS))
    rows = numbered.select("rid", "doc_id", F.explode(F.concat(none, some)).alias("x")).select("rid", "doc_id", "x.*")
    upto = Window.partitionBy("rid", "gen").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("m")).over(upto)
    kind = reduce(lambda acc, g: acc.when(F.col("gen") == g, KINDS.index(GENERATORS[g][0])), range(1, len(GENERATORS)), F.when(F.col("gen") == 0, 0)).otherwise(-1)
    m = F.col("m")
    placed = rows.select("rid", "doc_id", "gen", kind.alias("kind"), (end - F.length("m")).cast("long").alias("start"), end.cast("long").alias("end"), "m", "before", "after")
    k = F.col("kind")
    valid = _by_kind(k, {n: check(m) for n, check in CHECKS.items()})
    groups = F.split(m, "[^\\p{L}0-9]+")
    digits = F.length(_digits(m))
    hint = reduce(lambda acc, kv: acc.when(F.col("before").rlike(kv[1]), kv[0]), HINTS.items(), F).otherwise(0)
    seps = reduce(lambda a, b: a + b, [F.when(m.contains(ch), bit).otherwise(0) for ch, bit in ((" ", 1), ("-", 2), (".", 4), ("(", 8), (":", 16))])
    is_mail = k == 0
    own = {
        "fits": _by_kind(k, {n: form(m) for n, form in FORMATS.items()}),
        "digits": F.least(digits, F.lit(20)),
        "parts": F.least(F.size(groups), F.lit(8)),
        "first_len": F.least(F.length(F.element_at(groups, 1)), F.lit(8)),
        "last_len": F.least(F.length(F.element_at(groups, -1)), F.lit(8)),
        "seps": F.when(is_mail, 0).otherwise(seps),
        "left": _class(F.substring("before", -1, 1)),
        "right": _class(F.col("after")),
        "hint": hint,
        "letters": F.when(m.rlike("[^\\x00-\\x7F]"), 2).when(m.rlike("[A-Za-z]"), 1).otherwise(0),
    }
    return placed.select("rid", "doc_id", "gen", "kind", "start", "end", ((F.col("gen") >= 0) & (F.col("gen") < BASE) & valid).alias("base"), *[F.coalesce(c.cast("int"), F.lit(0)).alias(n).alias(n) for n, c in own.items()])


def marked(found: DataFrame) -> DataFrame:
    """Adds to every candidate met (overlaps a base span), equal (is one, of its kind), within (lies inside one)."""
    w = Window.partitionBy("rid").orderBy("start", F.desc("end"), F.desc("base"), "gen")
    same_start = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = w.rowsBetween(1, Window.unboundedFollowing)
    base_end = F.when(F.col("base"), F.col("end"))
    out = found.select("*", F.max(base_end).over(same_start).alias("reach"), F.min(F.when(F.col("base"), F.col("start"))).over(later).alias("next"), F.max(F.col("base")).over(Window.partitionBy("rid", "kind", "start", "end")).alias("equal"))
    return out.withColumn("met", F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))).withColumn("within", F.coalesce(F.col("reach") >= F.col("end"), F.lit(False))).drop("reach", "next")


@dataclass
class Tree:
    """A node: a leaf's value, or feature <= cut to the left, else to the right."""

    value: float = 0.0
    feature: int = -1
    cut: int = 0
    left: Tree | None = None
    right: Tree | None = None

    def column(self) -> Column:
        if self.left is None:
            return F.lit(float(self.value))
        return F.when(F.col(FEATURES[self.feature]) <= self.cut, self.left.column()).otherwise(self.right.column())

    def apply(self, x: np.ndarray) -> np.ndarray:
        if self.left is None:
            return np.full(len(x), self.value)
        return np.where(x[:, self.feature] <= self.cut, self.left.apply(x), self.right.apply(x))


def _whole(x: np.ndarray) -> np.ndarray:
    """In whole units, so that sums don't depend on the order of rows."""
    return np.rint(x * UNIT)


def _leaf(total_g: float, total_h: float) -> float:
    return float(-RATE * total_g / (total_h + LAMBDA))


def _split(sums: list[tuple[np.ndarray, np.ndarray]], total_g: float, total_h: float) -> tuple[int, int]:
    """(feature, cut) of the largest gain, from each feature's gradients and curvatures by value; feature -1 if none gains."""
    best = (1e-6, -1, 0)
    for f, (g, h) in enumerate(sums):
        hg, hh = g.cumsum()[:-1] / UNIT, h.cumsum()[:-1] / UNIT
        if len(hg):
            gain = hg**2 / (hh + LAMBDA) + (total_g - hg) ** 2 / (total_h - hh + LAMBDA) - total_g**2 / (total_h + LAMBDA)
            gain[(hh < 1e-3) | (total_h - hh < 1e-3)] = -1
            at = int(gain.argmax())
            best = max(best, (float(gain[at]), f, at), key=lambda t: t[0])
    return best[1:]


def _grown(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> Tree:
    """One tree by histograms of gradients and curvatures over the features' values, split where the gain is largest."""
    total_g, total_h = g[rows].sum() / UNIT, h[rows].sum() / UNIT
    feature, cut = _split([(np.bincount(x[rows, f], g[rows]), np.bincount(x[rows, f], h[rows])) for f in range(x.shape[1])], total_g, total_h) if depth else (-1, 0)
    if feature < 0:
        return Tree(_leaf(total_g, total_h))
    low = x[rows, feature] <= cut
    return Tree(0.0, feature, cut, _grown(x, g, h, rows[low], depth - 1), _grown(x, g, h, rows[~low], depth - 1))


def boost(x: np.ndarray, yes: np.ndarray, no: np.ndarray) -> list[Tree]:
    """Trees of additive log odds for feature vectors seen `yes` and `no` times; the first is a constant."""
    base = Tree(float(np.log((yes.sum() + 1) / (no.sum() + 1))))
    trees, score = [base], np.full(len(x), base.value)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grown(x, _whole((yes + no) * p - yes), _whole((yes + no) * p * (1 - p)), np.arange(len(x)), DEPTH)
        trees.append(tree)
        score += tree.apply(x)
    return trees


def _grown_by_sums(rows: DataFrame) -> Tree:
    """The same tree from a table (FEATURES, g, h): a level's histograms are summed by Spark; only they come to the driver."""
    root = Tree()
    level = [root]
    for depth in range(DEPTH, -1, -1):

        def place(tree: Tree, numbers: dict[int, int]) -> Column:
            if tree.left is None:
                return F.lit(numbers.get(id(tree), -1))
            return F.when(F.col(FEATURES[tree.feature]) <= tree.cut, place(tree.left, numbers)).otherwise(place(tree.right, numbers))

        at = place(root, {id(t): i for i, t in enumerate(level)})
        flat = rows.select(at.alias("at"), "g", "h", F.posexplode(F.array(*FEATURES)).alias("f", "v")).filter("at >= 0")
        sums: list[list[dict[int, tuple[float, float]]]] = [[{} for _ in FEATURES] for _ in level]
        for r in flat.groupBy("at", "f", "v").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            sums[r["at"]][r.f][r.v] = (float(r.g), float(r.h))
        below = []
        for tree, own in zip(level, sums, strict=True):
            columns = [tuple(np.array([f.get(v, (0.0, 0.0))[i] for v in range(max(f, default=-1) + 1)]) for i in (0, 1)) for f in own]
            total_g, total_h = (float(c.sum()) / UNIT for c in columns[0])
            feature, cut = _split(columns, total_g, total_h) if depth else (-1, 0)
            if feature < 0:
                tree.value = _leaf(total_g, total_h)
            else:
                tree.feature, tree.cut, tree.left, tree.right = feature, cut, Tree(), Tree()
                below += [tree.left, tree.right]
        level = below
        if not level:
            break
    return root


def boost_by_sums(counted: DataFrame) -> tuple[list[Tree], float]:
    """`boost` and the threshold for any number of vectors. counted: FEATURES, yes, no, held_yes, held_no."""
    total = counted.agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).first()
    trees = [Tree(float(np.log((total.yes + 1) / (total.no + 1))))]
    scored = counted.withColumn("score", trees[0].column())
    for _ in range(TREES):
        p, n = 1 / (1 + F.exp(-F.col("score"))), F.col("yes") + F.col("no")
        rows = materialize(scored.withColumn("p", p).withColumn("g", F.rint((n * F.col("p") - F.col("yes")) * UNIT).cast("long")).withColumn("h", F.rint(n * F.col("p") * (1 - F.col("p")) * UNIT).cast("long")), "gradients")
        trees.append(_grown_by_sums(rows))
        scored = rows.drop("p", "g", "h").withColumn("score", F.col("score") + trees[-1].column())
    by_score = scored.groupBy("score").agg(F.sum("held_yes").alias("y"), F.sum("held_no").alias("n"))
    parts = materialize(by_score.repartitionByRange(F.desc("score")).withColumn("part", F.spark_partition_id()), "scores")
    whole = parts.groupBy("part").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    # One row for each part: what the parts of higher scores hold.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    higher = whole.select("part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_before") for k in "yn"])
    upto = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = parts.join(F.broadcast(higher), "part").select("score", *[(F.sum(k).over(upto) + F.col(f"{k}_before")).alias(k) for k in "yn"])
    least = reached.filter((F.col("y") >= PRECISION * (F.col("y") + F.col("n"))) & (F.col("y") >= LEAST)).agg(F.min("score")).first()[0]
    return trees, float("inf") if least is None else float(least) - 1e-9


@dataclass
class Model:
    trees: list[Tree]
    threshold: float

    def score(self) -> Column:
        return reduce(lambda a, b: a + b, [t.column() for t in self.trees])


def _threshold(score: np.ndarray, yes: np.ndarray, no: np.ndarray) -> float:
    """The least score from which on at least PRECISION is yes; infinite where there is none."""
    order = np.argsort(-score, kind="stable")
    y, n, s = yes[order].cumsum(), no[order].cumsum(), score[order]
    last = np.append(s[1:] < s[:-1], True)  # equal scores stand or fall together
    good = np.flatnonzero(last & (y >= PRECISION * (y + n)) & (y >= LEAST))
    return float(s[good[-1]]) - 1e-9 if len(good) else float("inf")


def learn(found: DataFrame) -> dict[int, Model]:
    """found: marked candidates -> kind number: model. What comes to the driver: VECTORS counted vectors of a kind at most, or
    else sums by a feature's value."""
    crossing = F.col("met") & ~F.col("within")
    lesson = F.when(F.col("equal"), 1).when((F.col("fits") == 0) | crossing, 0)
    kept_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    tally = lambda y, out: F.sum(F.when((F.col("y") == y) & (F.col("out") == out), 1).otherwise(0))
    counted = found.filter("gen >= 0").select("kind", *FEATURES, lesson.alias("y"), F.coalesce(kept_out, F.lit(False)).alias("out")).filter("y IS NOT NULL").groupBy("kind", *FEATURES).agg(F.count("*").alias("n"), tally(1, False).alias("yes"), tally(0, False).alias("no"), tally(1, True).alias("held_yes"), tally(0, True).alias("held_no"))
    counted = materialize(counted, "vectors")
    sizes = {r.kind: r.n for r in counted.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    few = [kind for kind, n in sizes.items() if n <= VECTORS]
    rows = counted.filter(F.col("kind").isin(few)).orderBy("kind", F.desc("n"), *FEATURES).collect()
    models = {}
    for kind in range(len(KINDS)):
        if sizes.get(kind, 0) > VECTORS:
            all_of = counted.filter(F.col("kind") == kind)
            if not all_of.filter("yes > 0").isEmpty() and not all_of.filter("no > 0").isEmpty():
                models[kind] = Model(*boost_by_sums(all_of.drop("kind", "n")))
            continue
        own = [r for r in rows if r.kind == kind]
        x = np.array([[r[f] for f in FEATURES] for r in own], int).reshape(len(own), len(FEATURES))
        yes, no, held_yes, held_no = (np.array([r[c] for r in own], float) for c in ("yes", "no", "held_yes", "held_no"))
        if yes.sum() and no.sum():
            trees = boost(x, yes, no)
            score = sum(t.apply(x) for t in trees)
            models[kind] = Model(trees, _threshold(score, held_yes, held_no))
    return {k: m for k, m in models.items() if np.isfinite(m.threshold)}


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rid (a number for each row), doc_id, text."""
    return id_and_text(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())


def spans(rows: DataFrame) -> DataFrame:
    """rows: rid, doc_id, text -> rid, doc_id, kind (its number), start, end, base: all spans, and for each row one of kind -1."""
    found = materialize(marked(candidates(rows)), "candidates")
    models = learn(found)
    own = found.filter("base OR gen < 0").select("rid", "doc_id", "kind", "start", "end", "base")
    if not models:
        return own
    score = reduce(lambda acc, km: acc.when(F.col("kind") == km[0], km[1].score() - km[1].threshold), models.items(), F)
    more = found.filter("gen >= 0 AND fits = 1 AND NOT met").withColumn("over", score).filter("over >= 0")
    before = F.max("end").over(Window.partitionBy("rid").orderBy("start", "end", "gen").rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.when(F.col("start") < F.col("before"), 0).otherwise(1)).over(Window.partitionBy("rid").orderBy("start", "end", "gen"))
    merged = more.withColumn("before", before).withColumn("chain", chain).groupBy("rid", "chain").agg(F.first("doc_id").alias("doc_id"), F.max_by("kind", F.struct("over", -F.col("gen"))).alias("kind"), F.min("start").alias("start"), F.max("end").alias("end"))
    return own.unionByName(merged.select("rid", "doc_id", "kind", "start", "end", F.lit(False).alias("base")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (kind number, start, end, base) in order of kind and start; a row for each row of docs."""
    span = F.when(F.col("kind") >= 0, F.struct("kind", "start", "end", "base"))
    return spans(numbered(docs, id_col, text_col)).groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans")).select("doc_id", "spans")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[{}]") -> DataFrame:
    """doc_id, text with every span replaced by its kind in brackets; overlapping ones by the first one's."""
    rows = materialize(numbered(docs, id_col, text_col), "numbered")
    found = spans(rows).filter("kind >= 0")
    ends = F.max("end").over(Window.partitionBy("rid").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1))
    chain = F.sum(F.when(F.col("start") < F.col("ends"), 0).otherwise(1)).over(Window.partitionBy("rid").orderBy("start", F.desc("end"), "kind"))
    merged = found.withColumn("ends", ends).withColumn("chain", chain).groupBy("rid", "chain").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "kind")).alias("kind"))
    lists = merged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    name = lambda s: F.element_at(F.array(*[F.lit(mask.format(k.upper())) for k in KINDS]), s["kind"] + 1)
    pieces = F.transform("s", lambda s, i: F.concat(F.substring(F.col("text"), F.when(i > 0, F.get("s", i - 1)["end"]).otherwise(0).cast("int") + 1, (s["start"] - F.when(i > 0, F.get("s", i - 1)["end"]).otherwise(0)).cast("int")), name(s)))
    tail = F.substring(F.col("text"), F.element_at("s", -1)["end"].cast("int") + 1, F.length("text"))
    return rows.join(lists, "rid", "left").select("doc_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), tail)).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """find()'s rows as counts of base spans by kind, the hash of their list, and the list of all spans."""
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    said = lambda rows: F.array_join(F.transform(rows, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    rows = found.select("doc_id", "spans", base.alias("base"))
    return rows.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
