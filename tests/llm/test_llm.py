"""Operators of the llm subpackage against plain code, on odd rows and on the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

llm = pytest.importorskip("narralake.llm")

from narralake.llm import ann, bpe_codec, components, encoding, near_dedup, packing, quality, sharding, substring_dedup, token_binary, token_count, toxicity  # noqa: E402
import public_tokenizers  # noqa: E402

BYTE, RANKS, WORD, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json", "piece_bpe_32k.model"))
ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a   b", "x\n\n y", "x \n y", "don't 12 %% ...", "<|endoftext|>", "x  <|endoftext|> y", "<|endo ftext|>", "É ñandú İI ß ŒΣΣ", "日本語 テスト 漢字", "é café", " x  y", "a\tb\r\nc", "word " * 3000, "z" * 5000, "🙂🙂 ok", "\x1c \x1f x"]
SCHEMA = "doc_id long, text string, lang string, score double, label int, rank int, bucket string, row string"


@pytest.fixture(scope="module")
def docs(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf in the old dark forest. "
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, base * 4 + f"tail {i}.") for i in range(12)] + [(200 + i, base * 6) for i in range(5)]
    rows += [(300, None), (None, "no id here"), (301, "same row"), (301, "same row")]
    return spark.createDataFrame([(*r, "en", 0.5, 1, 2, "b", "r") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def tokenizers_():
    from tokenizers import Tokenizer

    return {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


@pytest.mark.parametrize(("path", "ranks"), [(BYTE, RANKS), (WORD, None)])
def test_encoder_equals_library(path, ranks, tokenizers_):
    ids, bounds = encoding.Encoder(path, ranks).encode(pa.array([*ODD, None]))
    for k, text in enumerate([*ODD, ""]):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizers_[path].encode(text, add_special_tokens=False).ids, text[:40]


@pytest.mark.parametrize("seed", range(3))
def test_encoder_equals_library_on_random_text(seed, tokenizers_):
    rng = np.random.default_rng(seed)
    alphabet = list("abcXYZ 019'.,!\n\t  sdtm<|>éßñΣ語🙂 ́")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(400)]
    for path, ranks in ((BYTE, RANKS), (WORD, None)):
        ids, bounds = encoding.Encoder(path, ranks).encode(pa.array(texts))
        for k, text in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizers_[path].encode(text, add_special_tokens=False).ids, text


def test_codec_reuses_chunks_and_is_exact(docs, empty, tokenizers_):
    out = bpe_codec.decode(bpe_codec.encode(docs, BYTE, RANKS), BYTE).collect()
    want = Counter((r.doc_id, hashlib.sha256(np.array(tokenizers_[BYTE].encode(r.text or "", add_special_tokens=False).ids, "<u4").tobytes()).digest(), r.text or "") for r in docs.collect())
    assert Counter((r.doc_id, hashlib.sha256(bytes(r.ids)).digest(), r.decoded) for r in out) == want
    assert bpe_codec.encode(empty, BYTE, RANKS).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 20_000, dtype=np.uint8))
    cut = lambda d: {d[a:b] for a, b in zip([0, *bpe_codec.cuts(d)], bpe_codec.cuts(d), strict=False)}
    assert len(cut(b"x" * 777 + passage) & cut(b"yz" * 500 + passage)) > 8


def test_token_files_round_trip(docs, empty, spark, tokenizers_):
    got = sorted(token_binary.token_files(spark, docs, BYTE, RANKS).collect(), key=lambda r: r.start)
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append([*tokenizers_[BYTE].encode(r.text or "", add_special_tokens=False).ids, 2])
    at = 0
    for r in got:
        assert r.start == at and any(zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32 and len(x) == r.n_tokens for x in ids[r.doc_id])
        at += r.n_tokens
    order = [r.doc_id for r in got if r.doc_id is not None]
    assert len(got) == docs.count() and order == sorted(order)
    assert token_binary.token_files(spark, empty, BYTE, RANKS).count() == 0


def test_ranges_of_ids_over_small_files(spark, tmp_path, tokenizers_):
    """Files end early, one id is on many rows, and any range is read back by its blocks."""
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["alpha", "beta", "12345", "ñandú", "x"], rng.integers(0, 300))) for _ in range(150)]
    rows = [(7 if i % 3 == 0 else i, t) for i, t in enumerate(texts)] + [(None, "no id"), (None, None)]
    path = f"file://{tmp_path}/tokens"
    manifest = token_binary.write_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, BYTE, RANKS, file_bytes=2000).cache()
    assert manifest.count() > 4
    docs_ = sorted(token_binary.read_tokens(manifest, path).collect(), key=lambda r: r.start)
    ids = [x for r in docs_ for x in r.ids]
    assert [r.start for r in docs_] == np.concatenate([[0], np.cumsum([r.n_tokens for r in docs_])[:-1]]).tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in docs_]
    assert order == sorted(order) and Counter((r.doc_id, tuple(r.ids)) for r in docs_) == Counter((i, (*tokenizers_[BYTE].encode(t or "", add_special_tokens=False).ids, 2)) for i, t in rows)
    for first, last in ((0, 1), (0, len(ids)), (127, 129), (995, 1010), (len(ids) - 3, len(ids) + 50), (len(ids), len(ids) + 5), (2500, 2500), (640, 1920)):
        got = sorted(token_binary.read_range(manifest, path, first, last).collect(), key=lambda r: r.start)
        assert [x for r in got for x in r.ids] == ids[first:last]
    manifest.unpersist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


@pytest.mark.parametrize("n", [1, 127, 128, 129, 1000])
def test_pack_unpack(n):
    rng = np.random.default_rng(n)
    for x in (rng.integers(0, 1 << 16, n), rng.zipf(1.2, n) % 65_536, np.full(n, 65_535), np.zeros(n)):
        x = x.astype(np.uint16)
        assert (token_binary.unpack(token_binary.pack(x)[0]) == x).all()


def sharded(table, shards):
    out = sharding.shard(table, shards).toPandas()
    for _, s in out.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    want = Counter((None if r.doc_id is None else r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in table.collect())
    assert Counter((None if np.isnan(a) else int(a), b, c) for a, b, c in zip(out.doc_id, out["size"], out.text_crc32, strict=True)) == want
    return out


def test_sharding(docs, empty):
    out = sharded(docs, 4)
    assert sharding.shard(empty, 4).count() == 0
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= 2 * out["size"].max()


def test_sharding_keeps_groups_whole_unless_they_cannot_fit(spark):
    """A third of all rows has one text, one id and no other column; groups of 40, 20 and 10 rows have texts of their own."""
    rng = np.random.default_rng(6)
    single = [(i, " ".join(rng.choice(list("abcdefgh"), 60))) for i in range(3000)]
    groups = [(10_000 + 100 * g + i, f"group {g} " + "same " * 22) for g, n in enumerate((40, 40, 20, 20, 10)) for i in range(n)]
    table = spark.createDataFrame(single + groups + [(None, "everywhere " * 11)] * 1500, "doc_id long, text string").repartition(5)
    out = sharded(table, 24)
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 24 and sizes.max() - sizes.min() <= 0.03 * sizes.mean()
    parts = out.groupby("g").shard.nunique()
    hot = out[out["size"] == len("everywhere " * 11) + 8].g.iloc[0]
    assert (parts.drop(hot) == 1).all() and parts[hot] >= 8


@pytest.mark.parametrize("seed", range(5))
def test_placing_groups(seed):
    rng = np.random.default_rng(seed)
    groups = [(i, int(x)) for i, x in enumerate(rng.integers(1, 90, 30))] + [(99, 260)]
    capacity = sum(b for _, b in groups) / 10 + 20
    placed, room = sharding.place_groups(groups, [capacity] * 10)
    load = Counter()
    for key, size in groups:
        at = 0
        for upto, s in placed[key]:
            load[s] += upto - at
            at = upto
        assert at == size and (len(placed[key]) == 1 or size > min(room))
    assert all(abs(capacity - load[s] - room[s]) < 1e-6 for s in range(10)) and len(placed[99]) >= 2 and min(room) > -1e-6


def test_packing(docs, empty, tokenizers_):
    out = packing.pack_documents(docs, WORD).toPandas()
    assert packing.pack_documents(empty, WORD).count() == 0
    assert out.groupby("sequence_id").length.sum().max() <= 4096
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()
    total = sum(len(tokenizers_[WORD].encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert out.length.sum() == total and out.sequence_id.nunique() == packing.bound(out.length.to_numpy(), 4096)


def test_pieces_of_long_and_odd_documents(spark, tokenizers_):
    """Every piece against the library: ids, cuts, places. The longest text has over three times the capacity."""
    rows = [(1, "lorem ipsum dolor " * 5000), (2, None), (2, "x"), (None, "no id"), (3, "same"), (3, "same"), (4, "word " * 4095), (5, "word " * 4096)]
    out = packing.pack_documents(spark.createDataFrame([(*r, 1, 2, "p") for r in rows], "doc_id long, text string, length int, offset int, piece string"), WORD).toPandas()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizers_[WORD].encode(t or "", add_special_tokens=False).ids, 1]
        for p, s in enumerate(range(0, len(ids), 4096)):
            want[i, p, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())] += 1
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert got == want and max(k[1] for k in want) >= 3
    for _, s in out.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 4096


def test_bounds_never_exceed_an_optimum():
    rng = np.random.default_rng(3)
    for _ in range(50):
        sizes = rng.integers(1, 101, rng.integers(1, 60))
        window, offset, rooms = packing.best_fit_decreasing(sizes, 100)
        assert packing.bound(sizes, 100) <= len(rooms) and (np.bincount(window, sizes) <= 100).all()


def near_truth(rows, k, percent):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter((a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(docs, empty):
    got = near_dedup.near_components(docs).collect()
    truth = near_truth([(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None], 4, 80)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == truth[r.doc_id] and r.kept == (truth[r.doc_id][1] == r.doc_id)
    assert len(got) == docs.count() and near_dedup.near_components(empty).count() == 0


def test_near_duplicates_on_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = near_truth([(r.doc_id, r.text) for r in table.collect()], 4, 80)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(table).collect()} == truth


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{100 + i: 100 for i in range(20)}}


def test_repeats(spark, empty):
    passage = " ".join(f"word{i}" for i in range(60)) + "."
    rows = [(3, f"Intro one. {passage} Outro."), (1, f"Other start. {passage}"), (2, "Stock phrase. Own words here."), (4, "Stock phrase. More of it."), (5, None), (None, passage), (6, "")]
    got = {r.doc_id: r for r in substring_dedup.repeat_rows(spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, again string, key int"), 25).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed > 300 and got[3].text == "Intro one. Outro." and got[None].n_removed > 300
    assert got[3].removed[0].start == len("Intro one.") and got[4].n_removed == 0 and got[5].text is None and got[6].text == ""
    assert got[3].row.again == "x" and substring_dedup.repeats(empty).count() == 0


def plain_repeats(rows, stock):
    """What is left of each text, by plain code: sentence ends and line ends close a unit, blank units join the one behind."""
    seen, out = {}, {}
    cut = {}
    for k, (i, text) in enumerate(rows):
        spans, start = [], 0
        for m in re.finditer(r"[.!?]+(?=\s)|\n", text or ""):
            if text[start : m.end()].strip():
                spans.append((start, m.end()))
                start = m.end()
        if (text or "")[start:].strip():
            spans.append((start, len(text)))
        cut[k] = [(a, b, " ".join(text[a:b].lower().split())) for a, b in spans]
        for p, (_, _, unit) in enumerate(cut[k]):
            rank = (substring_dedup.LAST if i is None else i, substring_dedup.text_key(text), p)
            seen[unit] = min(seen.get(unit, rank), rank)
    for k, (i, text) in enumerate(rows):
        gone, run = [], []
        for p, (a, b, unit) in enumerate([*cut[k], (0, 0, None)]):
            rank = (substring_dedup.LAST if i is None else i, substring_dedup.text_key(text), p)
            if unit is not None and seen[unit] != rank:
                run.append((a, b, unit))
                continue
            if run and sum(len(u.split()) for _, _, u in run) >= stock:
                gone.append((run[0][0], run[-1][1]))
            run = []
        out.setdefault(i, Counter())[tuple(gone)] += 1
    return out


@pytest.mark.parametrize("stock", [0, 6])
def test_repeats_equal_plain_code(spark, stock):
    rng = np.random.default_rng(9)
    lines = [" ".join(rng.choice(list("abcdef"), rng.integers(1, 6))) + rng.choice([".", "!", "", "?!"]) for _ in range(25)]
    text = lambda: "".join(rng.choice(lines) + rng.choice([" ", "\n", "\n\n", "  "]) for _ in range(rng.integers(0, 9)))
    rows = [(int(i), text()) for i in rng.integers(0, 60, 90)] + [(None, text()), (None, lines[0]), (5, None), (5, ""), (7, "\n \n"), (61, "A B. a  b."), (62, "x " * 30_000)]
    rows += [rows[0], rows[1]]
    rows = [(i, re.sub("a", lambda m: rng.choice(["a", "A"]), t) if t else t) for i, t in rows]
    table = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, pos int, key string").repartition(3)
    got = substring_dedup.repeat_rows(table, stock).collect()
    found: dict = {}
    for r in got:
        spans = tuple((x.start, x.end) for x in r.removed)
        found.setdefault(r.doc_id, Counter())[spans] += 1
        assert r.row.key == "k" and r.n_removed == sum(b - a for a, b in spans)
    assert found == plain_repeats(rows, stock)


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_count.unigram_vocabulary(PIECES)
    t = Tokenizer(models.Unigram(vocabulary, 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    want = Counter((r.doc_id, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in token_count.token_counts(docs, PIECES).collect()) == want
    assert token_count.token_counts(empty, PIECES).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_token_counts_of_ties_and_long_words(seed):
    """Vocabularies full of equal scores, whose best paths tie, and words of thousands of characters without a blank."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = np.random.default_rng(seed)
    pieces = {"".join(rng.choice(list("ab▁"), rng.integers(1, 5))) for _ in range(25)} | {"a", "▁"}
    vocabulary = [("<unk>", 0.0), *((p, float(rng.choice([-1.0, -2.0, -3.0]))) for p in sorted(pieces))]
    t = Tokenizer(models.Unigram(vocabulary, 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    texts = ["".join(rng.choice(list("abc "), n, p=[0.45, 0.4, 0.05, 0.1])) for n in rng.integers(1, 60, 300)]
    texts += ["".join(rng.choice(list("abc"), n, p=[0.5, 0.48, 0.02])) for n in (3000, 20_000)] + ["c" * 5000, "ab" * 9000]
    counter = token_count.Counter(vocabulary)
    assert counter.counts(pa.array(texts)).tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_quality_rules(docs, empty, spark):
    labels = spark.createDataFrame([(100, 1), (101, 1), (None, 1), (102, None)], "doc_id long, quality int")
    got = defaultdict(list)
    for r in quality.judge(docs.select("doc_id", "text"), labels).collect():
        got[r.doc_id].append(r)
    for d in docs.collect():
        t = d.text or ""
        w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want = (len(w), sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
        r = got[d.doc_id][0]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t[:40]
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty.select("doc_id", "text"), labels).count() == 0


def test_log_ratio_equals_plain_code(spark):
    """The verdict from hashed counts, computed again in plain Python; conflicting labels, null texts and repeated rows included."""
    import regex

    rng = np.random.default_rng(12)
    words = ["good", "fine", "ñandú", "x1", "--", "spam", "???", "buy"]
    text = lambda bad: " ".join(rng.choice(words[4 if bad else 0 : 8 if bad else 5], 80)) + rng.choice(["", "\n", "\tend."])
    rows = [(i, text(i % 3 == 0)) for i in range(60)] + [(100, None), (101, ""), (None, text(False)), (5, "second text of one id"), (7, "same"), (7, "same")]
    labels = [(i, int(i % 3 != 0)) for i in range(60)] + [(3, 1), (None, 1), (200, 1), (1, None)]

    def buckets(t):
        tokens = regex.findall(r"[\p{L}\p{N}]+|[^\p{L}\p{N} \t\n\x0b\f\r]+", t or "")
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in tokens]
        as_long = lambda x, seed: xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed)
        both = [as_long(b, as_long(a, 42)) for a, b in zip(h, h[1:], strict=False)]
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return [signed(x) % quality.BUCKETS for x in (*h, *both)]

    good = {i for i, q in labels if i is not None and q == 1}
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i in good:
            target.update(buckets(t))
    n = {k: sum(c.values()) + quality.PRIOR * quality.BUCKETS for k, c in (("r", raw), ("t", target))}
    weight = lambda b: np.log((target[b] + quality.PRIOR) / n["t"]) - np.log((raw[b] + quality.PRIOR) / n["r"])
    want = Counter()
    for i, t in rows:
        b = buckets(t)
        llr = float(np.mean([weight(x) for x in b])) if b else 0.0
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want[i, round(llr, 9), len(w) >= 50 and llr >= quality.THRESHOLD] += 1
    docs_ = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter()
    for r in quality.judge(docs_, spark.createDataFrame(labels, "doc_id long, quality int")).collect():
        assert not r.kept or not r.base_failed
        got[r.doc_id, round(r.llr, 9), r.kept if not (r.base_failed and r.n_words >= 50) else True] += 1
    repeated = {k for k in want if k not in got}  # texts of few words repeat windows, and fail by that rule alone
    assert {(k[0], k[1]) for k in got} == {(k[0], k[1]) for k in want} and all(not x[2] or (x[0], x[1], False) in got for x in repeated)
    assert len({k[2] for k in want}) == 2


def test_toxicity_on_held_out_rows(spark, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.95 and got.score.between(0, 1).all()
    assert toxicity.score(empty, labels).count() == 0


def neighbours_of(x, ids, got, k=20):
    """Recall with ties counted as hits; ranks, scores and order are checked on the way."""
    place = {i: n for n, i in enumerate(ids)}
    hits = []
    for q, found in got.groupby("query_id"):
        found = found.sort_values("rank")
        own = x[place[q]].astype(float)
        s = x.astype(float) @ own
        assert list(found["rank"]) == list(range(1, min(k, len(ids) - 1) + 1)) and q not in set(found.vec_id)
        exact = [float(sum(a * b for a, b in zip(own.tolist(), x[place[v]].astype(float).tolist(), strict=True))) for v in found.vec_id]
        assert np.allclose(found.score, exact, rtol=1e-12, atol=1e-12)
        order = list(zip(-found.score, found.vec_id, strict=True))
        assert order == sorted(order)
        s[place[q]] = -np.inf
        bound = np.sort(s)[-min(k, len(ids) - 1)]
        hits.append((s[[place[v] for v in found.vec_id]] >= bound - 1e-9).mean())
    return np.mean(hits)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (None, [1.0] * 16), (599, x[599].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).withColumn("node", F.lit("n"))
    got = ann.nearest(table).toPandas()
    assert got.query_id.nunique() == 30 and neighbours_of(x, list(range(600)), got) >= 0.95
    same = got[got.query_id == 60].sort_values("rank").vec_id.tolist()
    assert same == [i for i in range(50, 90) if i != 60][:20]  # equal vectors: the least ids
    assert ann.nearest(table.limit(0)).count() == 0
    few = spark.createDataFrame([(i, x[i].tolist()) for i in (0, 20, 41)], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.vec_id) for r in ann.nearest(few).collect()) == [(0, 20), (0, 41), (20, 0), (20, 41)]
    with pytest.raises(ValueError, match="components"):
        ann.nearest(table.union(spark.createDataFrame([(2000, [1.0, 2.0], 1, "n")], table.schema)))


@pytest.mark.parametrize(("n", "spread"), [(12_000, 0.0), (2_000, 0.8)])
def test_nearest_neighbours_without_clusters(spark, n, spread):
    """Isotropic vectors, of one length or of very unequal ones, which tells inner products from angles."""
    rng = np.random.default_rng(11)
    x = rng.standard_normal((n, 64))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True) * np.exp(spread * rng.standard_normal((n, 1)))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = ann.nearest(table, k=20, every=40).toPandas()
    assert got.query_id.nunique() == n // 40 and neighbours_of(x, list(range(n)), got) >= 0.9


def test_graph_reaches_the_true_neighbours(spark):
    """NN-descent against brute force, and no search."""
    x = np.random.default_rng(3).standard_normal((3000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ready, count = ann._ready(spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "node long, v array<double>"), 24)
    graph = ann.build_graph(ready, count).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = np.argsort(-s, axis=1)[:, :10]
    near = {u: set(g.v) for u, g in graph.groupby("u")}
    assert np.mean([len(near[u] & set(true[u])) / 10 for u in range(3000)]) >= 0.9 and max(map(len, near.values())) == ann.near_of(3000)


def test_graph_begins_near_the_truth(spark, monkeypatch):
    """Isotropic vectors: few rounds are left after the first groups, and the lists are better than from groups of 256."""
    n, names = 8000, []
    materialize = ann.materialize
    monkeypatch.setattr(ann, "materialize", lambda frame, name: names.append(name) or materialize(frame, name))
    x = np.random.default_rng(3).standard_normal((n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ready, count = ann._ready(spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "node long, v array<double>"), 64)
    graph = ann.build_graph(ready, count).toPandas()
    s = x @ x.T
    np.fill_diagonal(s, -2)
    true = np.argpartition(-s, 20, axis=1)[:, :20]
    near = {u: set(g.v) for u, g in graph.groupby("u")}
    assert np.mean([len(near[u] & set(true[u])) / 20 for u in range(n)]) >= 0.89
    assert sum(name.startswith("graph") for name in names) <= 8
    assert not graph.duplicated(["u", "v"]).any() and (graph.u != graph.v).all() and max(map(len, near.values())) == ann.near_of(n)


@pytest.mark.parametrize("sizes", [[3, 1, 2], [], [5]])
def test_packed_rows_give_their_values_back(sizes):
    u = np.repeat(np.arange(len(sizes)) * 7, sizes)
    v, state = np.arange(len(u)) * 11 - 3, np.arange(len(u)).astype(np.int8)
    keys, values, states = ann._packed(u, v, state)
    assert keys.to_pylist() == [7 * i for i in range(len(sizes))]
    for column, want in ((values, v), (states, state)):
        got, lengths = ann._unpacked(column, want.dtype.type)
        assert got.tolist() == want.tolist() and lengths.tolist() == sizes
        got, lengths = ann._unpacked(column.slice(1), want.dtype.type)
        assert got.tolist() == want[sum(sizes[:1]) :].tolist() and lengths.tolist() == sizes[1:]


@pytest.mark.parametrize("name", ["quality_rules", "toxicity", "near_dedup", "substring_dedup", "packing"])
def test_stages_one_by_one(spark, name):
    """Odd rows and columns of clashing names through each stage, and an empty table."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "src0", None), (900_001, None, "en", None, 0), (None, "word " * 60, None, "s", 5), (900_002, "", "en", "s", 0), (900_003, "long text " * 9000, "en", "s", 90_000), (900_003, "long text " * 9000, "en", "s", 90_000)], table.schema)
    extra = {"key": F.lit("k"), "row": F.lit(1), "score": F.lit(0.5), "kept": F.lit("yes"), "pos": F.lit(2)}
    docs_ = table.unionByName(odd).withColumns(extra)
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs_, sf)
    assert stage(spark, docs_.limit(0), sf).count() == 0
    if name == "packing":
        rows = out.toPandas()
        assert rows.groupby("sequence_id").length.sum().max() <= 4096 and rows[rows.piece == 0].shape[0] == docs_.count()
        return
    assert out.columns == docs_.columns
    kept, before = [tuple(r) for r in out.collect()], Counter(tuple(r) for r in docs_.collect())
    if name == "substring_dedup":
        assert len(kept) == sum(before.values())
        left = {r.doc_id: r.text for r in docs_.collect()}
        assert all(r.text is None if left[r.doc_id] is None else len(r.text) <= len(left[r.doc_id]) for r in out.collect() if r.doc_id is not None)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    else:
        assert not Counter(kept) - before and 0 < len(kept) < sum(before.values())
    if name == "near_dedup":
        truth = near_truth([(r.doc_id, r.text) for r in docs_.collect() if r.doc_id is not None], 5, 80)
        assert {r.doc_id for r in out.collect()} - {None} == {i for i, (_, c) in truth.items() if i == c}


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, sf).toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().set_index("doc_id")
    kept = labels[labels.index.isin(out.doc_id)]
    assert len(out) and out.groupby("sequence_id").length.sum().max() <= 4096 and (kept.quality == 1).mean() > 0.95


def plain_toxicity(rows, labelled):
    """Scores of (id, text) rows by plain code: dictionaries trained here, every window compressed by a fresh compressor,
    features in plain loops; the module gives constants and the regression."""
    import zstandard

    t = toxicity

    def code(text):
        return [xxhash.xxh3_64(w.encode()).digest() for w in re.findall(r"[^\W\d_]+", text.lower())]

    def windows(codes, n, step):
        return [b"".join(codes[i : i + n]) for i in range(0, max(len(codes) - n, 0) + (step if len(codes) > n else 1), step)]

    def dictionary(samples, size):
        if sum(map(len, samples)) <= size:
            return b"".join(samples)
        try:
            return zstandard.train_dictionary(size, samples, k=t.SEGMENT, d=t.DMER).as_bytes()
        except zstandard.ZstdError:
            return b"".join(samples)[-size:]

    def length(data, content):
        own = zstandard.ZstdCompressionParameters.from_level(t.LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=own).compress(data))

    def kind_of(codes, kinds):
        sizes = [length(b"".join(codes), k) for k in kinds]
        return sizes.index(min(sizes))

    def trained(texts, kind):
        pieces = {y: [w for k, codes, toxic in texts if (k, toxic) == (kind, y) for w in windows(codes, t.WINDOW, t.WINDOW) if w] for y in (0, 1)}
        share = sum(map(len, pieces[1])) // t.TOXIC_PART
        return dictionary(pieces[1], max(min(t.TOXIC_BYTES, share), 256)), b"".join(dictionary(pieces[0][i :: t.PARTS], t.ORDINARY_BYTES // t.PARTS) for i in range(t.PARTS))

    def features(codes, toxic, ordinary):
        saved = [length(w, ordinary) - length(w, toxic + ordinary) for w in windows(codes, t.WINDOW, t.STEP)]
        out = [1.0]
        for least in t.THRESHOLDS:
            hits = sum(s >= least for s in saved)
            out += [math.log1p(hits), hits / len(saved)]
        mean = sum(saved) / len(saved)
        return [*out, mean, mean * math.sqrt(len(saved)), max(saved), math.log(len(saved))]

    texts = [(h // 3 % t.FOLDS, code(text), toxic) for h, text, toxic in labelled]
    n = max(1, min(t.KINDS, sum(toxic for *_, toxic in texts) // t.TOXIC_A_KIND))
    long = [codes for _, codes, _ in texts if len(codes) >= 8][: t.GROUPED]
    own = [i % n for i in range(len(long))]
    for _ in range(t.ROUNDS):
        kinds = [dictionary([w for codes, o in zip(long, own, strict=True) if o == k for w in windows(codes, 32, 32)], t.KIND_BYTES) for k in range(n)]
        before, own = own, [kind_of(codes, kinds) for codes in long]
        if own == before:
            break
    texts = [(fold, kind_of(codes, kinds), codes, toxic) for fold, codes, toxic in texts]
    seen = []
    for fold in range(t.FOLDS):
        pairs = [trained([x[1:] for x in texts if x[0] != fold], k) for k in range(n)]
        seen += [(k, features(codes, *pairs[k]), toxic) for f, k, codes, toxic in texts if f == fold]
    weigh = lambda found: t._logistic(np.array([x for _, x, _ in found]), np.array([y for *_, y in found], float))
    weights = []
    for k in range(n):
        part = [x for x in seen if x[0] == k]
        weights.append(weigh(part if sum(y for *_, y in part) >= t.LEAST_TOXIC and not all(y for *_, y in part) else seen))
    pairs = [trained([x[1:] for x in texts], k) for k in range(n)]
    out = {}
    for i, text in rows:
        codes = code(text or "")
        k = kind_of(codes, kinds)
        z = sum(w * x for w, x in zip(weights[k], features(codes, *pairs[k]), strict=True))
        out[i] = 1 / (1 + math.exp(-max(-30, min(30, z))))
    return out


def test_toxicity_equals_plain_code_on_odd_rows(spark):
    rng = np.random.default_rng(2)
    words, bad = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"], ["zorgle", "vexpit", "quandro"]
    text = lambda n, k: " ".join([*rng.choice(words, n), *rng.choice(bad, k)] if k else rng.choice(words, n))
    words = [re.sub(r"\d", "", w) for w in words]
    rows = [(i, text(int(rng.integers(5, 300)), 6 if i % 4 == 0 else 0)) for i in range(240)]
    labels = [(i, int(i % 4 == 0)) for i, _ in rows if i % 5] + [(8, 0), (None, 1), (9, None)]
    rows += [(1000, None), (1001, ""), (None, text(40, 6)), (1002, text(30_000, 200)), (4, rows[4][1]), (1003, "123 ... !!")]
    docs = spark.createDataFrame([(*r, 1.0, "r", "h", 3) for r in rows], "doc_id long, text string, score double, row string, h string, toxic int")
    marked = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, marked).collect()
    of = lambda i: zlib.crc32(str(i).encode())
    toxic = {i: t for i, t in labels if i is not None and t is not None}
    toxic[8] = 1  # conflicting labels: one of them is toxic
    learned = sorted({(of(i), t or "", toxic[i]) for i, t in rows if i in toxic and of(i) % 3 != 1})
    want = plain_toxicity(rows, learned)
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and of(r.doc_id) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        assert r.doc_id is None or abs(r.score - want[r.doc_id]) < 1e-9
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 240]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.9
    nobody = toxicity.score(docs, marked.limit(0)).collect()
    assert len(nobody) == len(rows) and all(r.score == 0 and r.predicted == 0 for r in nobody)


def test_word_codes_search_a_known_piece_no_more(monkeypatch):
    odd = ["a_b1c É²½x\x1cy z ΑΣ ΑΣ, b \ud800 " + "w" * 100, "", " \n", "ΟΔΟΣ, ΟΔΟΣ\u3000İi (one,two)three"]
    words = lambda text: re.findall(r"[^\W\d_]+", text.lower())
    codes = toxicity.Codes()
    assert [codes.stream(t) for t in odd] == [b"".join(xxhash.xxh3_64_digest(w.encode("utf-8", "surrogatepass"))[: toxicity.CODE] for w in words(t)) for t in odd]
    known = codes.stream("One, two; three")
    monkeypatch.setattr(toxicity, "_WORD", None)
    assert codes.stream("one, TWO;\nthree") == known


def test_toxicity_parts_its_texts_into_kinds(spark):
    rng = np.random.default_rng(7)
    tongues = [[a + b + end for a in "bdfgklmnpr" for b in ("a", "e", "i", "o")] for end in ("sko", "trel")]
    bad = [["zorgle", "vexpit"], ["quandro", "ulmish"]]
    text = lambda k, toxic: " ".join(rng.permutation([*rng.choice(tongues[k], int(rng.integers(30, 90))), *rng.choice(bad[k], 4 * toxic)]))
    rows = [(i, text(i % 2, int(i % 6 < 2))) for i in range(540)]
    labelled = sorted((zlib.crc32(str(i).encode()), t, int(i % 6 < 2)) for i, t in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    model = toxicity.fit(labelled)
    assert len(model.kinds) == len(model.toxic) == len(model.ordinary) == len(model.weights) == 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = toxicity.score(docs, spark.createDataFrame([(i, int(i % 6 < 2)) for i, _ in rows], "doc_id long, toxic int")).collect()
    want = plain_toxicity(rows, labelled)
    assert all(abs(r.score - want[r.doc_id]) < 1e-9 for r in got)
    assert np.mean([r.predicted == int(r.doc_id % 6 < 2) for r in got if r.held_out]) > 0.9
