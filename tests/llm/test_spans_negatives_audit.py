"""Operators 11 to 13 against plain code, on odd rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

llm = pytest.importorskip("narralake.llm")

from narralake.llm import filter_audit, hard_negatives, pii  # noqa: E402

SF = "/root/testdata/sf0.001"
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def holds(kind, m):
        digits = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": all(int(x) <= 255 for x in m.split(".")) if kind == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if holds(k, m.group())]


def said(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check_base(rows, got):
    assert len(rows) == len(got)
    want = sorted((hashlib.sha256(said(base_spans(t)).encode()).hexdigest(), *[sum(k == x for k, _, _ in base_spans(t)) for x in PATTERNS]) for _, t in rows)
    assert sorted((r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == want
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t)
    for r in got:
        assert any(set(filter(None, said(base_spans(t)).split(","))) <= set(r.spans.split(",")) for t in texts[r.doc_id])


@pytest.mark.parametrize("seed", range(2))
def test_base_spans_equal_plain_code_on_random_text(spark, seed):
    rng = random.Random(seed)
    pieces = ["4111111111111111", "1.2.3.4", "256.1.1.1", "a@b.c", "x_y@", "@d.e", "+1 (225) 555-3104", "+", "0", "12", "-", " ", "  ", ".", "..", "é", "🙂", "\n", "(", ")", "a", "%", "@", "378282246310005", "00012", "+49 30 12345678901234"]
    rows = [(i, "".join(rng.choices(pieces, k=rng.randint(0, 14)))) for i in range(400)]
    got = pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    check_base(rows, got)


def test_odd_and_long_texts(spark):
    rows = [(1, "9" * 30_000), (2, "1 " * 30_000), (3, "z" * 60_000), (4, "a@" * 20_000), (5, "+" + "1 " * 20_000), (6, "1." * 20_000), (7, None), (7, None), (None, "x@y.z"), (8, ""), (9, "call +1 (855) 555-4208 4866351201689520")]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, spans string, kind int")
    check_base(rows, pii.digest(pii.find(frame)).collect())
    assert pii.find(frame.limit(0)).isEmpty()


def test_trees_add_what_base_patterns_merge(spark):
    rng = random.Random(7)

    def card():
        while True:
            d = "4" + "".join(rng.choices("0123456789", k=15))
            if luhn(d):
                return d

    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    junk = lambda: "".join(rng.choices("0123456789", k=16))
    rows = [(i, f"the card {card()} and the phone {phone()} stand here, {junk()} not") for i in range(150)]
    merged = [(1000 + i, f"the words {phone()} {card()} end") for i in range(5)]
    got = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(rows + merged, "doc_id long, text string"))).collect()}
    check_base(rows + merged, list(got.values()))
    for i, text in merged:
        a, b = text.index("+"), text.rindex(" ")
        assert got[i].spans == f"card:{text.rindex(' ', 0, b) + 1}:{b},phone:{a}:{a + 17}", text
    assert all(got[i].spans == said(base_spans(t)) for i, t in rows)
    clean = pii.redact(spark.createDataFrame([(1, f"é card {card()}, mail a@b.co"), (2, None), (3, "none")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.text for r in clean} == {1: "é card [CARD], mail [EMAIL]", 2: None, 3: "none"}


def test_boosting_learns_an_interaction():
    x = np.array(list(itertools.product(range(3), range(3), [0], [0], [0], [0], [0], [0], [0], [0])))
    y = ((x[:, 0] == 1) ^ (x[:, 1] == 2)).astype(float)
    trees = pii.boost(x, 20 * y, 20 * (1 - y))
    score = sum(t.apply(x) for t in trees)
    assert ((score > 0) == (y == 1)).all()
    assert pii._threshold(np.array([3.0, 2, 1]), np.array([50.0, 40, 1]), np.array([0.0, 1, 30])) == pytest.approx(2.0)


def plain_negatives(rows, every=100, k=5):
    best = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints = [int(np.floor(256 * float(x))) for x in v]
        if sum(x * x for x in ints) < 1 << 62:
            best[i] = min(best.get(i, (label, ints)), (label, ints))
    out = []
    for a, (label, x) in best.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, w, strict=False)), i, other) for i, (other, w) in best.items() if i != a)
        for s, i, other in [r for r in scored if r[2] == label][:k]:
            found = [r for r in scored if r[2] != label and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(a, i, n + 1, j, -s, -t) for n, (t, j, _) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize(("pivots", "group"), [(64, 4096), (7, 3), (1, 1)])
def test_hard_negatives_equal_plain_code(spark, pivots, group):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 8)) * 3
    rows = [(int(i), [float(x) for x in centers[i % 6] + rng.normal(size=8)], int(rng.integers(0, 4))) for i in range(0, 700)]
    rows += [(1000 + i, rows[0][1], i % 2) for i in range(60)]
    rows += [(2000, None, 1), (2100, [1.0, None], 1), (2200, [float("nan")] * 8, 1), (2300, [1.0] * 8, None), (None, [1.0] * 8, 1), (2400, [3.0], 1), (2500, [], 2), (2600, [0.0] * 8, 3), (2700, [1e30] * 8, 1), (2800, [9e6] * 8, 1), (2900, [9e6] * 8, 2), (100, rows[100][1], rows[100][2]), (200, rows[201][1], 0)]
    frame = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<double>, label int, x string, norm double")
    got = hard_negatives.mine(frame, pivots=pivots, group=group)
    assert sorted(map(tuple, got.collect())) == plain_negatives(rows)
    assert hard_negatives.mine(frame.limit(0)).isEmpty() and hard_negatives.mine(frame.filter("vec_id = 1")).isEmpty()


def test_best_takes_ties_by_id():
    scores, ids = np.array([5, 7, 7, 3, 9]), np.array([4, 3, 2, 1, 0])
    found = hard_negatives.best(scores, ids, np.ones(5, bool), np.array([[3, 7], [6, 9]]), 2)
    assert [[int(ids[i]) for i in f] for f in found] == [[2, 3], [0, 2]]


def plain_audit(docs, labels):
    marks = {}
    for i, quality, toxic in labels:
        if i is not None:
            q, t = marks.get(i, (False, False))
            marks[i] = (q or quality == 1, t or toxic == 1)
    fails = []
    for i, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {c for c, bad in (("A", len(w) < 50), ("B", 100 * len(set(w)) < 65 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 5 * len(t)), ("D", re.search(r"[#$%&*|]", t) is not None), ("E", i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs))) if bad}
        fails.append((part or "", own, *marks.get(i, (False, False))))
    out = []
    for part in {f[0] for f in fails}:
        own, shapley, steps = [f for f in fails if f[0] == part], {}, []
        for order in itertools.permutations("ABCDE"):
            for s, c in enumerate(order):
                before = set(order[:s])
                here = [f for f in own if c in f[1] and not f[1] & before]
                shapley[c] = shapley.get(c, 0) + len(here)
                steps.append(("".join(order), s + 1, c, sum(not f[1] & (before | {c}) for f in own), len(here), sum(c in f[1] and bool(f[1] & before) for f in own), sum(f[1] == {c} for f in own), sum(f[2] for f in here), sum(f[3] for f in here)))
        out += [(part, o, s, *rest, shapley[c]) for o, s, c, *rest in steps]
    return sorted(out)


def test_audit_equals_plain_code(spark):
    rng = random.Random(11)
    texts = ["", None, "word", " \t\n", "a b " * 40, " ".join(f"w{i}" for i in range(60)), "LOUD " * 60, " ".join(f"X{i}" for i in range(60)), "# " + " ".join(f"v{i}" for i in range(80)), "é" * 200, "long " * 20_000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(120)]
    docs += [docs[5], docs[5]]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 40, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, n int, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(frame, marks).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert sorted(map(tuple, got.collect())) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), marks).isEmpty()
    two = filter_audit.audit(frame, marks.limit(0), {"A": filter_audit.FILTERS["A"]}, "Z")
    assert {r.filter_order for r in two.collect()} == {"AZ", "ZA"} and two.agg(F.sum("good_lost")).first()[0] == 0


def test_all_counted_vectors_teach(spark, monkeypatch):
    """A kind of more vectors than the driver fits gets the trees and the threshold that the driver would find."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = pii.materialize(pii.marked(pii.candidates(pii.numbered(docs))), "candidates")
    monkeypatch.setattr(pii, "TREES", 3)
    whole = pii.learn(found)
    monkeypatch.setattr(pii, "VECTORS", 2)
    parted = pii.learn(found)
    assert whole and whole.keys() == parted.keys()
    for kind, model in whole.items():
        assert parted[kind].threshold == pytest.approx(model.threshold, abs=1e-6)
        scores = found.filter(f"kind = {kind}").select(model.score().alias("a"), parted[kind].score().alias("b"))
        assert scores.filter("abs(a - b) > 1e-6").count() == 0 and scores.distinct().count() > 1


def test_sums_grow_the_drivers_trees(spark, monkeypatch):
    monkeypatch.setattr(pii, "TREES", 2)
    rng = np.random.default_rng(5)
    x = np.unique(rng.integers(0, 4, (60, len(pii.FEATURES))), axis=0)
    yes = np.where((x[:, 1] > 1) ^ (x[:, 6] > 2), 9, 1) + rng.integers(0, 3, len(x))
    counts = np.stack([yes, 10 - np.minimum(yes, 10), yes // 2, 3 - np.minimum(yes // 3, 3)], axis=1)
    table = spark.createDataFrame(np.concatenate([x, counts], axis=1).tolist(), [*pii.FEATURES, "yes", "no", "held_yes", "held_no"])
    trees = pii.boost(x, *counts[:, :2].T.astype(float))
    score = sum(t.apply(x) for t in trees)
    grown, threshold = pii.boost_by_sums(table.repartition(3))
    assert grown == trees and len(np.unique(score)) > 4
    assert threshold == pytest.approx(pii._threshold(score, *counts[:, 2:].T.astype(float)), abs=1e-9)
