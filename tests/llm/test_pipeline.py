"""The corpus pipeline against brute force, stage by stage and as a whole, on a small odd table."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from millrace.llm import packing, zdict_tox

from .test_text import brute_print, brute_repeats, corpus, labelled

SCHEMA = "doc_id long, text string, lang string, fp long, row string, key string, n_chars long, spans int, lower string"


def rows_of():
    rng = random.Random(41)
    rows, labels = labelled(300)
    long = " ".join(f"w{rng.randrange(90)}" for _ in range(12_000))
    odd = [(None, None), (None, ""), (901, None), (901, ""), (902, rows[1][1]), (902, rows[2][1] + " and more of it"), (None, rows[1][1]), (None, "nobody else says this here"), (None, "nobody else says this here"), (903, long), (904, long[:9000])]
    more = [(1000 + i if i is not None else None, t) for i, t, *_ in corpus(5, 40)]
    every = rows + odd + more + [rows[7]] * 3
    return [(i, t, "xx", 7, "r", "k", len(t or ""), 5, "UP") for i, t in every], labels


def name(text):
    digest = hashlib.sha256((text or "").encode()).hexdigest()
    return int.from_bytes(bytes.fromhex(digest[:16]), "big", signed=True), int(digest[16:24], 16) - (1 << 31)


def by_hand(rows, model):
    """The rows after the first three stages."""
    meter = zdict_tox.Meter(*model.dicts)
    rows = [r for r in rows if model.score(meter, [(r[1] or "").lower().encode()])[0] < 0.5]
    yield rows
    prints, group = [brute_print(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 3:
                group = [group[j] if g == group[i] else g for g in group]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, *name(rows[k][1])))
    first = {}
    for k in order:
        first.setdefault(group[k], k)
    rows = [rows[k] for k in first.values()]
    yield rows
    out = []
    for r, (_, n, gone, _, _) in zip(rows, brute_repeats([r[:2] for r in rows]), strict=True):
        if gone:
            d = (r[1] or "").encode()
            keep = np.ones(n, bool)
            for k in range(n - 199):
                if sum(_starts(o[1], d[k : k + 200]) for o in rows) > 1:
                    keep[k : k + 200] = False
            text = np.frombuffer(d, np.uint8)[keep].tobytes().decode("utf-8", "ignore")
            r = (r[0], text, *r[2:6], len(text), *r[7:])
        out.append(r)
    yield out


def _starts(text, piece):
    d, at, n = (text or "").encode(), -1, 0
    while (at := d.find(piece, at + 1)) >= 0:
        n += 1
    return n


def plain(rows):
    """Null and empty texts have one name: of such rows, any one stays."""
    return Counter((r[0], r[1] or "", *r[2:]) for r in rows)


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_is_brute_force(spark, tmp_path, empty):
    rows, labels = rows_of()
    frame = spark.createDataFrame([] if empty else rows, SCHEMA)
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    y.write.parquet(str(tmp_path / "labels.parquet"))
    if empty:
        assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
        return
    model = zdict_tox.fit(frame, y)
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (stage, f), want in zip(corpus_pipeline.STAGES[:-1], by_hand(rows, model), strict=True):
        now = f(spark, now, str(tmp_path))
        assert now.schema.names == frame.schema.names, stage
        got = plain(now.collect())
        assert got == plain(want), stage
        now = spark.createDataFrame(sorted(got.elements(), key=str), SCHEMA)
    assert 0 < len(want) < len(rows)
    enc = packing.Encoder()
    ids = Counter((r[0], zlib.crc32(np.array([*enc.model.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for r in want)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokens = Counter()
    for r in pieces:
        tokens[r["doc_id"]] += r["length"]
        if r["length"] == r["doc_tokens"]:  # a whole document has a crc to compare
            assert (r["doc_id"], r["ids_crc32"]) in ids
    count = Counter()
    for r in want:
        count[r[0]] += len(enc.model.encode(r[1] or "", add_special_tokens=False).ids) + 1
    assert tokens == count
