"""Alignment, resampling and mixing against brute force and SQL; nulls, empty and long texts, ties, repeats, clashing columns, hot sources."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from millrace.llm import alignment, mixing, queries, resampling
from millrace.llm.packing import BYTE_OF

SCHEMA = "doc_id long, text string, source string, row string, n int, before string, copy long, part string, no long, pair int, h string, size string, score double, fit int"
ODD = ["", None, " ", "a▁b", "hello <|endoftext|> <s> </s> <unk> <0x41> world", "aaaa aaaaaa aaa", "Ünï  日本語\n\n x　y", " lead\r\n\x0b tail ", "x" * 3000, "é" * 700 + "🙂" * 40, "trailing ", "I'll don't 1234567 ,,, ...", "  x"]


def frame(spark, rows):
    """Rows (doc_id, text, source) with columns whose names the operators use too."""
    return spark.createDataFrame([(*r, None)[:3] + ("r", 7, "b", 1, "p", 2, 3, "h", "s", 0.5, 1) for r in rows], SCHEMA)


def corpus(n=60, seed=5):
    rng = random.Random(seed)
    words = ["the", "Data", "naïve", "réseau", "antidisestablishment", "of", "and", "to", "42", "x-ray", "über", "数据", "don't", "http://a.b/c?d=e"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", ", ", "\n", "."]) for _ in range(rng.randint(0, 120)))
    rows = [(i, text(), rng.choice(["a", "a", "b", "Z", "é", None])) for i in range(n)]
    rows += [(n + k, t, "odd") for k, t in enumerate(ODD)]
    return rows + [rows[3]] * 3 + [(None, "null id the Data", "a"), (None, "null id, other text", "a"), (7, "same id, other text", "b")]


def key(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


def brute_alignment(rows):
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out, count = [], Counter()
    for i, t, *_ in rows:
        spaced, links, groups, a, b = (" " + (t or "")).encode(), [], [], [], []
        if t:
            a, b = a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)
        a_bytes = [bytes(BYTE_OF[c] for c in a_model.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(b_model.id_to_piece(x)[3:5], 16)]) if b_model.is_byte(x) else b_model.id_to_piece(x).replace("▁", " ").encode() for x in b]
        if not t or b"".join(a_bytes) != spaced or b"".join(b_bytes) != spaced:
            out.append((i, 0, 0, 0, [], ""))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            ends = np.cumsum([len(x) for x in parts]).tolist()
            spans.append(list(zip([0, *ends], ends, strict=False)))
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (p, q) in zip(b, spans[1], strict=True) if s < q and p < e] if len(t) < 5000 else None
        last = 0
        for end in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
            groups.append("|".join(",".join(str(x) for x, (s, e) in zip(ids, own, strict=True) if s >= last and e <= end) for ids, own in zip((a, b), spans, strict=True)))
            last = end
        out.append((i, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(set(links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [(i, na, nb, ng, len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), sha) for i, na, nb, ng, ls, sha in out], count, top


@pytest.mark.parametrize(("head", "held"), [(1 << 16, 1 << 17), (5, 20), (0, 1)])
def test_alignment_is_brute_force(spark, monkeypatch, head, held):
    """Whatever part of the keys is broadcast, and however often tasks hand on their dictionaries."""
    monkeypatch.setattr(alignment, "HEAD", head)
    monkeypatch.setattr(alignment, "HELD", held)
    rows = corpus()
    want, count, top = brute_alignment(rows)
    assert key(alignment.align(frame(spark, rows).repartition(3)).collect()) == key(want)
    if head:
        assert key(alignment.pair_counts(frame(spark, rows)).collect()) == key((a, b, n, n == top[a]) for (a, b), n in count.items())


def test_a_long_text_aligns(spark):
    rng = random.Random(1)
    text = " ".join(rng.choice(["alpha", "βήτα", "gam\tma", "delta,", "9876"]) for _ in range(60_000))
    got = alignment.align(frame(spark, [(1, text)])).first()
    assert got["n_a"] > 60_000 and got["n_links"] == got["n_a"] + got["n_b"] - got["n_groups"] and got["n_best"] <= got["n_links"] == got["count_sum"]


def test_links_of_a_group_are_overlaps():
    sizes = np.array([1, 2, 3, 5]), np.array([1, 2, 4])
    assert alignment.links_of([3, 2], [2, 2], sizes) == [(3, 2), (3, 2), (2, 2)]
    assert alignment.links_of([0, 3], [1, 2], sizes) == [(0, 1), (3, 1), (3, 2)]


def brute_resampling(rows, target):
    def buckets(t):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]

    own = [(i, *buckets(t)) for i, t, *_ in rows]
    s, t = Counter(k for *_, f in own for k in f), Counter(k for x in target for k in buckets(x)[1])
    many, all_t = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (many + 10_000) / ((s[k] + 1) * (all_t + 10_000)))) for k in s}
    out = []
    for i, words, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words >= 20])
    fit = sorted((o for o in out if o[4]), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    ranks = {id(o): k + 1 for k, o in enumerate(fit[: 5 * len(fit) // 100])}
    return [(*o[:4], ranks.get(id(o))) for o in out]


@pytest.mark.parametrize("n", [60, 400])
def test_resampling_is_brute_force(spark, monkeypatch, n):
    monkeypatch.setattr("millrace.llm.common.SPAN", 64)  # many ranges
    rows = corpus(n)
    target = ["the Data of réseau", None, "", "to THE data of réseau 42"]
    got = resampling.resample(frame(spark, rows).repartition(3), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert key(got) == key(brute_resampling(rows, target))
    assert n < 400 or any(r["rank"] for r in got)


def test_resampling_of_a_row_that_is_a_third_of_all(spark):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(5, text)] * 3000 + [(k, text + f" {k}") for k in range(1000, 1100)]
    got = resampling.resample(frame(spark, rows), spark.createDataFrame([("w1 w2",)], "text string"))
    assert got.count() == 3100 and sorted(r["rank"] for r in got.where("rank is not null").collect()) == list(range(1, 156))
    assert resampling.resample(frame(spark, rows), spark.createDataFrame([], "text string")).count() == 3100


def test_suffix_arrays_group_equal_runs():
    texts = [b"a b c a b c a b", b"b c a", b"", b"c", b"A b! c"]
    doc, word, known = resampling.words_of(texts)
    order, lcp = resampling.suffix_array(doc, word)
    seqs = [[known[word[p + k]] for k in range(3) if p + k < len(word) and doc[p + k] == doc[p]] for p in range(len(word))]
    runs = [[word[p + k] if p + k < len(word) and doc[p + k] == doc[p] else -1 for k in range(3)] for p in order]
    assert runs == sorted(runs)
    common = lambda a, b: next((k for k in range(3) if k >= min(len(a), len(b)) or a[k] != b[k]), 3)
    assert lcp.tolist() == [0] + [common(seqs[a], seqs[b]) for a, b in zip(order, order[1:], strict=False)]
    long = np.arange(3000)[::-1] % 2999
    assert np.array_equal(resampling.suffix_array(np.zeros(3000, int), long)[0], np.lexsort([np.append(long[2:] + 1, [0, 0]), np.append(long[1:] + 1, 0), long + 1]))


def test_checksums_of_concatenations():
    rng = random.Random(2)
    for n in (0, 1, 5, 127, 128, 129, 1000):
        a, b = rng.randbytes(9), rng.randbytes(n)
        got = resampling.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b))
        assert int(got[0]) == zlib.crc32(a + b)


def by_sql(rows):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows])
    return db.sql(queries.ORACLES["op13_mixing"]).fetchall()


@pytest.mark.parametrize("span", [1 << 14, 16])
def test_mixing_is_its_sql(spark, monkeypatch, span):
    monkeypatch.setattr("millrace.llm.common.SPAN", span)
    rng = random.Random(4)
    text = lambda n: "\t".join(rng.choice(["a", "bb", "ccc\x0bd", "\n"]) for _ in range(n))
    rows = [(i, text(rng.choice([0, 3, 40, 700])), rng.choice(["hot"] * 6 + ["b", "é", "A", "zz", None])) for i in range(150)] + [(150, None, "b"), (151, "", None), (152, text(20_000), "long"), (None, "one null id", "b"), (153, "tiny", "tiny")]
    got = mixing.taken(frame(spark, rows).repartition(5)).collect()
    assert key(got) == key(by_sql(rows)) == key(mixing.taken(frame(spark, rows).repartition(2)).collect())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    per = defaultdict(lambda: [0, 0, 0.0])
    source = {i: s for i, _, s in rows}
    for r in got:
        own = per[source[r["doc_id"]]]
        own[0], own[1], own[2] = own[0] + r["taken"], r["source_size"], r["target"]
    assert all(abs(t - target) <= 0.5 and target <= 2 * size for t, size, target in per.values())
    assert abs(sum(t for t, _, _ in per.values()) - 1.5 * sum(r["size"] for r in got)) <= len(per)


def test_mixing_of_repeated_rows(spark):
    rows = [(1, "a b c", "s")] * 2500 + [(1, "other text", "s"), (1, "x y z", "s"), (2, None, None), (2, None, None)]
    one, two = (mixing.taken(frame(spark, rows).repartition(k)).collect() for k in (2, 7))
    assert len(one) == len(rows) and key(one) == key(two)
    assert sum(r["taken"] for r in one) == int(1.5 * (3 * 2501 + 2) + 0.5) and all(r["taken"] <= 2 * r["size"] for r in one)


def test_pieces_fill_their_slots(spark):
    rows = [(i, "w " * (i % 37) * 9, "ab"[i % 3 == 0]) for i in range(200)]
    found = mixing.mix(frame(spark, rows)).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"], r["slot"]].append((r["at"], r["length"], r["no"]))
    for own in slots.values():
        own.sort()
        assert [a for a, *_ in own] == np.cumsum([0, *[n for _, n, _ in own]])[:-1].tolist() and len({s for *_, s in own}) == 1 and sum(n for _, n, _ in own) <= mixing.BLOCK
    assert all(0 <= r["word"] and r["word"] + r["length"] <= len(rows[r["doc_id"]][1].split()) for r in found)


def test_every_index_has_one_place(spark):
    from pyspark.sql import functions as F

    for k in (1, 2, 5, 64, 1001):
        got = spark.range(k).select(mixing.shuffled(F.col("id"), F.lit(k).cast("long"), 42, F.lit("key")).alias("x")).collect()
        assert sorted(r["x"] for r in got) == list(range(k)) and (k < 64 or [r["x"] for r in got] != list(range(k)))


def test_shards_have_multinomial_counts(spark):
    """Counts by shard vary as draws do, totals are the quotas."""
    sources = spark.createDataFrame([(0, 128 * 40_000, 128 * 30_000.0), (1, 128 * 20_000, 128 * 10_000.0)], "no long, source_size long, target double")
    got = mixing.slots(sources).groupBy("shard", "no").count().collect()
    whole = {s for s in {r["shard"] for r in got} if sum(r["count"] for r in got if r["shard"] == s) == mixing.SLOTS}
    one = [r["count"] for r in got if r["no"] == 0 and r["shard"] in whole]
    assert sum(r["count"] for r in got if r["no"] == 0) == 30_000 and abs(np.mean(one) - 768) < 12 and 7 < np.std(one) < 24
