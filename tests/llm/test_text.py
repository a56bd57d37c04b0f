"""Text operators against brute force, round trips and held-out accuracy; nulls, empty and long texts, repeats, extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import alignment, bpe_tree, brown, mixing, packing, resampling, simhash_bk, suffix_dedup, zdict_tox
from millrace.llm.common import LOWER, components

SCHEMA = "doc_id long, text string, fp long, h string"
ODD = [(None, None, 1, "a"), (1, "", 1, None), (2, "one", None, "b"), (2, "one", None, "b"), (3, "one two", 3, "c"), (None, "null id", 3, "c"), (4, "x" * 5000 + "é" * 300, 1, "d")]


def docs(spark, rows):
    return spark.createDataFrame([(*r, None, None)[:4] if len(r) == 2 else r for r in rows], SCHEMA)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "be", "co", "dé", "ein", "fo", "ß"]) for _ in range(rng.randint(1, 3)))
    base = [" ".join(word() for _ in range(rng.randint(40, 160))) for _ in range(10)]
    rows = []
    for i in range(n):
        b = rng.choice(base)
        a = rng.randint(0, len(b) // 2)
        rows.append((i, rng.choice(["", " ".join(word() for _ in range(30)) + ". "]) + b[a : a + rng.randint(50, 900)] + rng.choice(["", "\n" + word() * 40])))
    return rows + [(i, t) for i, t, *_ in ODD] + [(n, rows[0][1]), (n + 1, rows[0][1] + " end")]


def key(rows):
    return sorted(map(str, rows))


def brute_repeats(rows):
    count = Counter(d[k : k + 200] for d in ((t or "").encode() for _, t in rows) for k in range(len(d) - 199))
    out = []
    for i, t in rows:
        d = (t or "").encode()
        gone = np.zeros(len(d) + 1, int)
        for k in range(len(d) - 199):
            if count[d[k : k + 200]] > 1:
                gone[k] += 1
                gone[k + 200] -= 1
        m = np.cumsum(gone)[: len(d)] > 0
        runs = int((np.diff(np.append(0, m.astype(int))) == 1).sum()) if len(d) else 0
        out.append((i, len(d), int(m.sum()), runs, hashlib.sha256(np.frombuffer(d, np.uint8)[~m].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [512, 2])
def test_suffix_dedup_is_brute_force(spark, group):
    rows = corpus()
    got = suffix_dedup.repeats(docs(spark, rows), group).collect()
    assert key(tuple(r) for r in got) == key(brute_repeats(rows))


def test_suffix_blocks_of_hot_groups_are_brute_force(spark):
    rng = random.Random(17)
    make = lambda n: "".join(rng.choice("ab") for _ in range(n))
    passage, rows = make(700), []
    for i in range(150):
        a, b = rng.choice([0, 0, rng.randint(0, 300)]), rng.choice([700, 700, rng.randint(400, 700)])
        body = list(passage[a:b])
        if i % 5 == 0:  # variants that share a part of their windows with a few others
            body[(i * 7) % len(body)] = "c"
        rows.append((i, make(rng.randint(0, 250)) + "".join(body) + make(rng.randint(0, 250))))
    got = suffix_dedup.repeats(docs(spark, rows), 1).collect()
    assert key(tuple(r) for r in got) == key(brute_repeats(rows))


def test_suffix_sort_orders_and_verifies():
    rng = np.random.default_rng(1)
    buf = np.concatenate([rng.integers(97, 99, 900, np.uint8)] * 2)
    starts = np.arange(len(buf) - 200)
    order, shared = suffix_dedup.suffix_sort(buf, starts, suffix_dedup.Prefix(buf, suffix_dedup.BASES[0]))
    text = [bytes(buf[s : s + 200]) for s in order]
    assert text == sorted(text) and shared.tolist() == [k > 0 and text[k] == text[k - 1] for k in range(len(text))]


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    rows = [(0, "".join(random.Random(5).choice("abc ") for _ in range(4000)) * 2), (1, "y" * 3000)]
    texts = [t.encode() for _, t in rows]
    ids, seen, places = np.arange(2), set(), []
    for _, _, _, i, _, pos in suffix_dedup._runs(ids, np.zeros(2, np.int32), texts):
        for k, p in zip(i.tolist(), pos.tolist(), strict=True):
            t = (p >> 16) - (p >> 8 & 255)
            places.append((k, p >> 16))
            seen |= {(k, w) for w in range(t, t + (p & 255) + 1)}
    assert seen == {(k, w) for k, t in enumerate(texts) for w in range(len(t) - 199)}
    assert len(places) == len(set(places))  # else an anchor at a seam would pass for a copy of itself


def test_long_clean_text_loses_nothing(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh ") for _ in range(3 << 20))
    assert [r["n_removed"] for r in suffix_dedup.repeats(docs(spark, [(1, text), (2, "z" + text[:150])])).collect()] == [0, 0]


def test_suffix_dedup_of_shared_and_null_ids(spark):
    """Texts of one doc_id are texts of their own, whatever their checksums; whole copies under null ids go; columns may have any name."""
    rng = random.Random(23)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows, by_crc = [], {}
    while len(rows) < 6:  # pairs of unequal texts of one id whose crc32 agree in their last byte
        t = make(600)
        other = by_crc.setdefault(zlib.crc32(t.encode()) % 256, t)
        if other is not t:
            rows += [(1, other), (1, t)]
    rows += [(2, rows[0][1])] + [(None, make(260))] * 50 + [(None, make(300)), (None, None)]
    got = suffix_dedup.repeats(docs(spark, rows)).collect()
    assert key(tuple(r) for r in got) == key(brute_repeats(rows))
    schema = "doc_id long, text string, id long, tie string, spans int, row string, key long, data binary, _part int, n_chars long"
    frame = spark.createDataFrame([(i, t, 7, "t", 5, "r", 9, b"d", 3, len(t or "")) for i, t in rows], schema)
    kept = suffix_dedup.strip(frame)
    assert kept.schema.names == frame.schema.names
    want = Counter((r[0], r[4]) for r in brute_repeats(rows))
    assert want == Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect())
    assert all(r["n_chars"] == len(r["text"] or "") and (r["id"], r["tie"], r["spans"], r["row"], r["key"], r["_part"]) == (7, "t", 5, "r", 9, 3) for r in kept.collect())


def test_suffix_dedup_of_a_hot_group_and_many_copies(spark):
    """Over 5,000 contexts around one passage, and 10,000 whole copies under null ids."""
    rng = random.Random(29)
    make = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    passage = make(260)
    rows = [(i, make(rng.randint(20, 60)) + passage[rng.choice([0, 0, 0, 30]) :] + make(rng.randint(20, 60))) for i in range(5200)]
    rows += [(None, make(230) + passage)] * 10_000
    got = Counter(map(tuple, suffix_dedup.repeats(docs(spark, rows)).collect()))
    assert got == Counter(brute_repeats(rows))


def brute_print(text):
    w = (text or "").encode().translate(LOWER).split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


@pytest.mark.parametrize("shard_rows", [1024, 3])
def test_simhash_is_brute_force(spark, shard_rows):
    rows = corpus(9, 90)
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    want = [(rows[k][0], format(prints[k], "016x"), least[group[k]]) for k in range(len(rows))]
    assert key(tuple(r) for r in simhash_bk.near_duplicates(docs(spark, rows), shard_rows=shard_rows).collect()) == key(want)


def test_forest_links_what_is_near():
    rng = random.Random(2)
    values = list({rng.getrandbits(64) if rng.random() < 0.5 else 12345 ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)})
    edges = simhash_bk.forest(values, 3)
    assert all((a ^ b).bit_count() <= 3 for a, b in edges) and len({frozenset(e) for e in edges}) == len(edges)


def test_keep_one_keeps_the_smallest_and_all_columns(spark):
    rows = [(5, "a b c d e f g", 1, "x"), (2, "a b c d e f g", 1, "y"), (2, "a b c d e f g", 1, "y"), (9, "something else entirely here", 2, "z"), (None, "alone with no name at all", 3, "n"), (None, "a b c d e f g", 3, "n")]
    got = simhash_bk.keep_one(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "fp", "h"] and sorted((str(r[0]), r[3]) for r in got.collect()) == [("2", "y"), ("9", "z"), ("None", "n")]


def test_keep_one_of_shared_ids_and_clashing_columns(spark):
    """Unequal texts of one doc_id don't compete, and columns of any name come back as they were."""
    schema = "doc_id long, text string, fp long, row string, key string, n long, id long, root long"
    rows = [(2, "a b c d e f g"), (2, "totally different words in here now fine"), (None, "lone words that nobody else has"), (None, "lone words that nobody else has"), (3, "a b c d e f g"), (None, "a b c d e f g"), (4, None), (5, "")]
    frame = spark.createDataFrame([(i, t, 77, "r", "k", 6, 8, 9) for i, t in rows], schema)
    got = simhash_bk.keep_one(frame)
    assert got.schema.names == frame.schema.names
    want = [(2, "a b c d e f g"), (2, "totally different words in here now fine"), (4, None), (None, "lone words that nobody else has")]
    assert key(tuple(r) for r in got.collect()) == key((i, t, 77, "r", "k", 6, 8, 9) for i, t in want)
    assert simhash_bk.keep_one(frame.where("false")).count() == 0


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_packing_gives_every_id_once(spark):
    rows = [*corpus(4, 60), (900, "Word by word. " * 3000), (901, "nopunctuation" * 4000), (902, "a <|endoftext|> b\t c")]
    enc = packing.Encoder()
    want = {}
    for i, t in rows:
        ids = [*enc.model.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault((i, len(ids)), []).append(ids)
    got = packing.pack(docs(spark, rows)).collect()
    pieces, seqs = {}, {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    for own in seqs.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    assert {k: len(v) * k[1] for k, v in want.items()} == {k: sum(r["length"] for r in v) for k, v in pieces.items()}
    for k, v in pieces.items():
        for r in v:
            crcs = {zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for ids in want[k]}
            assert r["ids_crc32"] in crcs
    filled = sum(sum(n for _, n in own) for own in seqs.values())
    padded = sum(2048 - n for own in seqs.values() if (n := sum(x for _, x in own)) & (n - 1))
    assert padded < 0.02 * filled + 4 * 2048


def test_cuts_are_the_cheapest():
    rng = random.Random(8)
    for _ in range(40):
        cuts = np.cumsum([rng.randint(1, 9) for _ in range(rng.randint(1, 14))])
        cost = np.array([rng.choice([0, 1, 3]) for _ in cuts])
        pad = lambda n, m=16: 0 if n & (n - 1) == 0 and n >= 64 else m - n
        best = {0: 0}
        for k, c in enumerate(cuts.tolist()):
            best[c] = min(best[b] + pad(c - b) for b in best if c - b <= 16) + int(cost[k])
        at, total = 0, 0
        for i in packing.choose(cuts, cost, 16):
            total += pad(int(cuts[i]) - at) + int(cost[i])
            at = int(cuts[i])
        assert at == cuts[-1] and total == best[int(cuts[-1])]


def test_words_encode_like_whole_texts():
    enc, rng = packing.Encoder(), random.Random(1)
    bits = [" ", "  ", "\n", "\t", " ", "the", "é", "😀", "'s", "12", ".", "x" * 60, "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    assert all(np.array_equal(enc.whole(t), i) for t, i in zip(texts, enc.encode([t.encode() for t in texts]), strict=True))
    one_by_one = packing.Encoder()
    one_by_one.many = None  # as in a library without the joint call
    assert all(np.array_equal(a, b) for a, b in zip(enc.encode([t.encode() for t in texts]), one_by_one.encode([t.encode() for t in texts]), strict=True))


def test_bpe_tree_is_the_library(spark):
    rows = corpus(6, 30) + [(800, "thinger" * 3000 + "<|endoftext|>" + "Ä" * 2500), (801, "İ Σ ﬁ ǅ　中文'll!!")]
    codec = bpe_tree.Codec()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = codec.model.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(codec.model.decode(ids, skip_special_tokens=False).encode())))
    frame = docs(spark, rows)
    assert key(tuple(r) for r in bpe_tree.digests(frame).collect()) == key(want)
    texts = bpe_tree.decode(bpe_tree.encode(frame))
    assert sorted(str(r[0]) for r in texts.collect()) == sorted(str(i) for i, _ in rows)


def test_joins_of_short_leaves():
    codec, rng = bpe_tree.Codec(leaf=5), random.Random(2)
    for _ in range(300):
        w = "".join(rng.choice(["a", "the", "ing", "er", "é", "s", "t"]) for _ in range(rng.randint(1, 50)))
        assert codec.long(w) == codec.model.encode(w, add_special_tokens=False).ids


def test_brown_counts_are_exact_and_classes_help(spark):
    rows = corpus(7, 150)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    toks = lambda t: [*(t or "").encode().translate(LOWER).split(), None]
    c = Counter(w for i, t in rows if not held(i) for w in toks(t))
    n, v = sum(c.values()), len(c)
    want = [(i, held(i), len(toks(t)), sum(w in c for w in toks(t)), n) for i, t in rows]
    got = brown.score(docs(spark, rows)).collect()
    assert key((r[0], r[1], r[2], r[3], r[4]) for r in got) == key(want)
    base = sorted(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)) for _, t in rows)
    assert np.allclose(sorted(r["base_score"] for r in got), base) and sum(r["score"] for r in got) > sum(base)


def test_exchange_finds_two_languages():
    n = np.zeros((21, 21))
    for k in range(10):
        n[k, :10] += 5
        n[10 + k, 10:20] += 5
    at = brown.exchange(n, classes=3)
    assert len(set(at[:10])) == 1 and len(set(at[10:20])) == 1 and at[0] != at[10] and at[20] == 0


def brute_score(rows, classes, kinds, default):
    """The docstring's formulas in plain Python, with the classes as they were found."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    toks = lambda t: [*(t or "").encode().translate(LOWER).split(), None]
    of = lambda w: 0 if w is None else classes.get(w, default)
    count, pair = Counter(), Counter()
    for i, t in rows:
        if not held(i):
            ws = toks(t)
            count.update(ws)
            pair.update(zip([0, *map(of, ws)], map(of, ws), strict=False))
    n, v = sum(count.values()), len(count)
    size, last = Counter(), Counter()
    for (a, b), k in pair.items():
        size[b] += k
        last[a] += k
    out = []
    for i, t in rows:
        total, a = 0.0, 0
        for w in toks(t):
            b = of(w)
            step = (pair[a, b] + brown.B * size[b] / n) / (last[a] + brown.B)
            word = (count[w] + brown.A) / (size[b] + brown.A * (kinds[b] + 1))
            total += math.log10(brown.SHARE * step * word + (1 - brown.SHARE) * (count[w] + 0.1) / (n + 0.1 * (v + 1)))
            a = b
        out.append((i, round(total, 6)))
    return out


@pytest.mark.parametrize(("core", "head"), [(1 << 16, 1 << 18), (200, 40), (60, 0)])
def test_brown_score_is_brute_force(spark, monkeypatch, core, head):
    """Every word is clustered, whatever part of them is core, broadcast, or joined."""
    monkeypatch.setattr(brown, "CORE", core)
    monkeypatch.setattr(brown, "HEAD", head)
    monkeypatch.setattr(brown, "SEEDS", 20)
    rows = corpus(7, 80)
    rows += [(77, "ünknown wörds an be")] * 3 + [(rows[0][0], "same id, other text")]
    frame = docs(spark, rows)
    lexicon, others, kinds = brown.fit(brown.source(frame))
    words = sorted({w for _, t in rows for w in (t or "").encode().translate(LOWER).split()})
    _, one, two = brown.tokens([b" ".join(words)])
    found = lexicon.table.find(one, two)
    classes = {w: int(k) & 255 for w, k in zip(words, found, strict=True) if k >= 0}
    rest = {(r["h"], r["l"]): r["class"] for r in others.collect()}
    for w, a, b in zip(words, one.view(np.int64).tolist(), two.view(np.int64).tolist(), strict=True):
        if (a, b) in rest:
            assert classes.get(w, rest[a, b]) == rest[a, b]
            classes[w] = rest[a, b]
    trained = {w for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 10 for w in (t or "").encode().translate(LOWER).split()}
    assert set(classes) == trained and sum(kinds) == len(trained) + 1
    got = [(r["doc_id"], r["score"]) for r in brown.score(frame).collect()]
    order = lambda xs: sorted(xs, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = order(brute_score(rows, classes, kinds, lexicon.default))
    got = order(got)
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([x for _, x in got], [x for _, x in want], atol=1e-5)


def test_brown_places_rare_words_by_their_own_neighbours(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 60)
    monkeypatch.setattr(brown, "SEEDS", 8)
    rng, held = random.Random(4), lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    lead = {"p": ["ka", "ke", "ki", "ko"], "q": ["ma", "me", "mi", "mo"]}
    rare = {k: [f"{k}{i}ing" for i in range(60)] for k in lead}  # equal in their last three bytes
    line = lambda a, b: " ".join(f"{rng.choice(lead[a])} {rng.choice(lead[a])} {rng.choice(rare[b])}" for _ in range(20))
    rows = [(i, line(k, k)) for i in range(400) if not held(i) for k in [rng.choice("pq")]]
    a, b = [i for i in range(400, 500) if held(i)][:2]
    words = [[rng.choice(x) for x in (lead["p"], lead["p"], rare["p"], lead["q"], lead["q"], rare["q"])] for _ in range(20)]
    run = lambda *by: " ".join(w[k] for part in by for w in words for k in part)
    rows += [(a, run((0, 1, 2), (3, 4, 5))), (b, run((0, 1, 5), (3, 4, 2)))]  # the same words
    got = {r["doc_id"]: r for r in brown.score(docs(spark, rows)).where(f"doc_id in ({a}, {b})").collect()}
    assert abs(got[a]["base_score"] - got[b]["base_score"]) < 1e-6 and got[a]["score"] > got[b]["score"] + 5


def test_brown_repeats(spark, monkeypatch):
    """Hot repeated rows, tail words joined or broadcast: the same scores."""
    monkeypatch.setattr(brown, "HOT", 2)
    monkeypatch.setattr(brown, "CORE", 100)
    rows, want = corpus(7, 60), {}
    for head in (1 << 18, 0):
        monkeypatch.setattr(brown, "HEAD", head)
        want[head] = sorted(tuple(str(round(x, 5)) if isinstance(x, float) else str(x) for x in r) for r in brown.score(docs(spark, rows * 7)).collect())
    assert want[0] == want[1 << 18] and len(want[0]) == 7 * len(rows)


def test_placing_is_the_gain_of_exchange():
    rng = np.random.default_rng(5)
    pair = rng.integers(0, 40, (brown.CLASSES, brown.CLASSES)).astype(float)
    slot, n = np.array([3, 7, 48 + 3, 48 + 9, 96]), np.array([5, 60, 2, 40, 4])
    f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
    whole = []
    for k in range(1, brown.CLASSES):
        p = pair.copy()
        for s, m in zip(slot.tolist(), n.tolist(), strict=True):
            p[(s, k) if s < 48 else (k, s - 48) if s < 96 else (k, k)] += m
        whole.append(f(p) - f(p.sum(axis=1)) - f(p.sum(axis=0)))
    got, c = brown.Placer(pair).best(np.array([0]), slot, n)
    assert got[0] == 1 + int(np.argmax(whole)) and c[0] == 69


def labelled(n=400):
    rng = random.Random(11)
    bad = ["grubnak", "zwoffel", "plurtig", "skamvod"]
    word = lambda: "".join(rng.choice(["an", "be", "co", "in", "the", "ou", "er"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        ws = [word() for _ in range(rng.randint(20, 120))]
        for _ in range(4 if toxic else 0):
            ws.insert(rng.randrange(len(ws)), rng.choice(bad))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    frame, y = docs(spark, rows + [(i, t) for i, t, *_ in ODD]), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = zdict_tox.fit(frame, y)
    got = zdict_tox.score(frame, model).collect()
    truth = dict(labels)
    test = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] > 4]
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) / len(test) > 0.95
    kept = zdict_tox.drop_toxic(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(1 - r["predicted"] for r in got)


def test_toxicity_fit_of_repeated_rows_is_that_of_single_rows(spark):
    rows, labels = labelled()
    frame, y = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    ids = [i for i, t in labels if not t and zlib.crc32(str(i).encode()) % 5]
    want = zdict_tox.fit(frame, y, 80, 160)
    assert want.dicts
    hot = frame.where(frame.doc_id.isin(ids)).crossJoin(spark.range(30).select())  # ordinary rows alone, many times
    for again in (frame.unionByName(frame), frame.unionByName(hot)):
        got = zdict_tox.fit(again, y, 80, 160)
        assert got.dicts == want.dicts and np.allclose(got.weights, want.weights)
        assert again.count() > zdict_tox.drop_toxic(again, got).count() > 0


def test_toxicity_of_a_phrase_of_ordinary_words(spark):
    """Every word is as frequent in ordinary text; a whole document between the calibrated windows may be long."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice(["an", "be", "co", "in", "the", "ou", "er"]) for _ in range(rng.randint(1, 4)))
    phrase, rows, labels = "go back under your bridge now", [], []
    for i in range(600):
        toxic = i % 3 == 0
        ws = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(3):
            bits = phrase.split()
            at = rng.randrange(len(ws))
            if toxic:
                ws[at:at] = bits
            else:
                for b in bits:
                    ws.insert(rng.randrange(len(ws)), b)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(toxic)))
    schema = "doc_id long, text string, lower string, row int, _lower long"
    frame, y = spark.createDataFrame([(*r, "x", 4, 5) for r in rows], schema), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = zdict_tox.fit(frame, y)
    truth = dict(labels)
    test = [r for r in zdict_tox.score(frame, model).collect() if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in test) / len(test) > 0.85
    long = spark.createDataFrame([(1000, " ".join(word() for _ in range(300_000)), "x", 4, 5), (1001, None, "x", 4, 5), (1002, "", None, None, None)], schema)
    kept = zdict_tox.drop_toxic(frame.unionByName(long), model)
    assert kept.schema.names == frame.schema.names and {(r[3], r[4]) for r in kept.collect()} == {(4, 5), (None, None)}


OPERATORS = {
    "suffix_dedup": suffix_dedup.repeats, "simhash": simhash_bk.near_duplicates, "packing": packing.pack, "bpe": bpe_tree.digests, "brown": brown.score, "alignment": alignment.align, "mixing": mixing.taken,
    "resampling": lambda d: resampling.resample(d, d.select("text")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(spark, name):
    assert OPERATORS[name](docs(spark, [(0, "a")]).where("false").withColumn("source", F.lit("s"))).count() == 0


def test_toxicity_of_an_empty_table(spark):
    none = docs(spark, [(0, "a")]).where("false")
    model = zdict_tox.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert zdict_tox.score(none, model).count() == 0 and zdict_tox.score(docs(spark, ODD), model).count() == len(ODD)


@pytest.mark.parametrize("case", ["empty texts", "all held out", "all distinct", "one word"])
def test_brown_without_a_core(spark, case):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    distinct = [" ".join(f"w{i}x{k}" for k in range(700)) for i in range(139)]
    rows = {"empty texts": [(1, ""), (2, None), (3, " \n ")], "all held out": [(i, "some words") for i in held[:3]], "all distinct": list(enumerate(distinct)), "one word": [(1, "a a a"), (2, "a")]}[case]
    got = brown.score(docs(spark, rows)).collect()
    toks = lambda t: [*(t or "").encode().split(), None]
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in toks(t))
    n, v = sum(c.values()), len(c)
    assert key((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == key((i, len(toks(t)), sum(w in c for w in toks(t)), n) for i, t in rows)
    base = {i: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t)) for i, t in rows}
    assert all(abs(base[r["doc_id"]] - r["base_score"]) < 1e-6 and math.isfinite(r["score"]) for r in got)


def test_brown_comes_to_rest_where_no_pass_gains(spark, monkeypatch):
    """The classes that stand are at least as likely as those of the seeds alone after one pass."""
    monkeypatch.setattr(brown, "SEEDS", 12)
    rows = brown.source(docs(spark, corpus(9, 60)))
    words = brown.vocabulary(rows).orderBy("h", "l").toArrow()
    h, l = (words[k].to_numpy().view(np.uint64) for k in ("h", "l"))
    types = brown.Types(h, l)
    seqs = brown.numbered(rows, types)
    first = brown.exchange(brown.bigrams(seqs, types, 12))
    at = np.full(types.core, -1)
    at[:12] = first[:12]
    once, _, _ = brown.core_exchange(brown.core_contexts(seqs, types, np.append(at, [-1, 0])), at)
    rest, _ = brown.settled(seqs, types, at)
    like = lambda a: brown.likelihood(brown.core_bigrams(brown.core_contexts(seqs, types, np.append(a, [-1, 0])), a))
    assert (rest > 0).all() and like(rest) >= like(once) - 1e-6


def test_toxicity_figures_of_the_readme(spark):
    """On the held-out labelled rows of the test tables."""
    table = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    found = zdict_tox.score(table("documents"), zdict_tox.fit(table("documents"), table("labels"))).where("held_out").join(table("labels").where("toxic in (0, 1)"), "doc_id").select("toxic", "predicted", "score").toPandas()
    y, p = found["toxic"].to_numpy(), found["predicted"].to_numpy()
    place = found["score"].rank().to_numpy()
    area = (place[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))
    figures = (p == y).mean(), y[p == 1].mean(), p[y == 1].mean(), area
    print("accuracy, precision, recall, area:", figures)
    assert len(y) == 825 and y.sum() == 97 and all(a >= b for a, b in zip(figures, (0.94, 0.85, 0.6, 0.91), strict=True))
