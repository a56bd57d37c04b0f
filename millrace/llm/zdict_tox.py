"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, two pairs of them.

Running windows. One pair is trained on all text of its class. Text is lower-cased and cut into windows of ``WINDOW`` bytes, half a window apart; a window's margin is
the bytes that the ordinary dictionary needs more than the toxic one. The mean, the largest and the mean of the largest tenth of a text's margins are features: fixed
phrases and word order show there. In a short window a single word moves the length by a byte or two, so a second pair looks at words.

Words. Words are runs of letters and other non-ASCII bytes; runs over 48 bytes come in pieces. A window is a word repeated ``REPEATS`` times,
so that its block is compressible whatever the word. A text's counts and shares of windows above the thresholds ``STEPS``, and its largest margin, are
features. A toxic document is mostly ordinary text, so this pair's toxic dictionary learns from those of its words that have a 5-letter run which is ``RATIO`` times as
frequent in toxic text; runs count once for each word before, so copies of a passage count once. Ordinary words that have such a run are repeated in the ordinary samples.

A logistic curve over all features calibrates the score. Labels are read only where crc32(doc_id) mod 5 isn't 0. The fit uses at most ``TOXIC`` toxic and ``ORDINARY`` ordinary labelled ids (parameters of ``fit``), those
of smallest hash of doc_id, with their whole texts, and of rows that share an id the smallest text: one half trains the dictionaries, the other calibrates, in one task. A word dictionary, of 16 KB at most, is trained on at most ``WORDS`` words of that half, drawn with a fixed seed.

Nulls: a null text is empty and gets a score like any text; a null doc_id is never fitted on, is not held out, and stays null. Without labels
of both kinds every score is the share of toxic ones (0 without labels). Repeated rows stay repeated, an empty table gives an
empty result, and other columns, of whatever name, are ignored or kept as they are.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .words import LONGEST, WordIds

TOXIC, ORDINARY, FOLDS, WORDS = 1500, 3000, 5, 200_000
GRAM, RATIO, LEVEL, REPEATS, SIZES, STEPS = 5, 8.0, 19, (2, 4), (8192, 16384), (2, 3, 4, 5, 6, 8)
WINDOW, SAMPLE, PLAIN_SIZE, FAST = 64, 256, 8192, 3
_BREAK = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


def spans(data: bytes, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the words of lower-cased UTF-8; docs: where texts begin, and the end."""
    ink = ~_BREAK[np.frombuffer(data, np.uint8)]
    edge = np.zeros(len(data) + 1, bool)
    edge[docs] = True
    before = np.append(False, ink[:-1]) & ~edge[:-1]
    after = np.append(ink[1:], False) & ~edge[1:]
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    pieces = np.maximum(-(-(ends - starts) // LONGEST), 1)
    first = np.repeat(starts, pieces) + LONGEST * (np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return first, np.minimum(np.repeat(ends, pieces) - first, LONGEST)


def words(data: bytes) -> list[bytes]:
    starts, lens = spans(data, np.array([0, len(data)]))
    return [data[s : s + n] for s, n in zip(starts.tolist(), lens.tolist(), strict=True)]


def grams(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1))}


def support(texts: list[list[bytes]]) -> Counter:
    """How many distinct pairs (word before, word) have each run of letters."""
    seen: set[int] = set()
    pairs: Counter = Counter()
    for t in texts:
        for pair in zip([b"", *t], t, strict=False):
            if (h := hash(pair)) not in seen:
                seen.add(h)
                pairs[pair[1]] += 1
    count: Counter = Counter()
    for word, n in pairs.items():
        for g in grams(word):
            count[g] += n
    return count


def by_fours(found: list[bytes]) -> list[bytes]:
    return [b" " + b" ".join(found[i : i + 4]) + b" " for i in range(0, len(found), 4)]


def dictionary(joined: list[bytes], size: int) -> bytes:
    """A trained dictionary; of too few samples, their text."""
    try:
        return zstandard.train_dictionary(size, joined, level=9).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(joined))[-size:] or b" "


def compressors(dicts: tuple[bytes, bytes], level: int) -> list[zstandard.ZstdCompressor]:
    how = zstandard.ZstdCompressionParameters.from_level(level, source_size=64, dict_size=8192, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0)
    return [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), compression_params=how) for d in dicts]


class Running:
    """Margins of windows of running text under two dictionaries of whole texts."""

    def __init__(self, dicts: tuple[bytes, bytes]):
        self.by = compressors(dicts, FAST)

    def features(self, data: bytes, docs: np.ndarray) -> np.ndarray:
        """A row for each of the texts that begin at docs: mean margin, largest, mean of the largest tenth."""
        step, size = WINDOW // 2, np.diff(docs)
        many = np.where(size > 0, np.maximum(1, -(-(size - WINDOW) // step) + 1), 0)
        own = np.repeat(np.arange(len(size)), many)
        starts = docs[:-1][own] + step * (np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many))
        out = np.zeros((len(size), 3))
        if not len(own):
            return out
        windows = zstandard.BufferWithSegments(data, np.stack([starts, np.minimum(WINDOW, docs[1:][own] - starts)], axis=1).astype(np.uint64).tobytes())
        toxic, ordinary = (np.fromiter(map(len, c.multi_compress_to_buffer(windows)), np.int64, len(own)) for c in self.by)
        margin = ordinary - toxic
        order = np.lexsort((-margin, own))
        first = np.cumsum(many) - many
        place = np.arange(len(own)) - first[own]
        top = place < np.maximum(1, many // 10)[own]
        some = many > 0
        out[:, 0] = np.bincount(own, margin, len(size)) / np.maximum(many, 1)
        out[some, 1] = margin[order][first[some]] / 4
        out[:, 2] = np.bincount(own[top], margin[order][top], len(size)) / np.maximum(1, many // 10) / 4
        return out


class Meter:
    """Margins of words under two dictionaries, and of running windows under two others."""

    def __init__(self, words_by: tuple[bytes, bytes], running_by: tuple[bytes, bytes]):
        self.by = [c.compress for c in compressors(words_by, LEVEL)]
        self.running = Running(running_by)
        self.known = WordIds(self.learn)

    def learn(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        toxic, ordinary = self.by
        out = np.zeros(len(found), np.int64)
        for k, w in enumerate(found):
            for n in REPEATS:
                x = b" " + (w + b" ") * n
                out[k] += len(ordinary(x)) - len(toxic(x))
        return (out.clip(-100, 100) + 100).astype(np.uint32), np.ones(len(found), np.int64)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """A row for each lower-cased UTF-8 text."""
        docs = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
        data = b"".join(texts)
        starts, lens = spans(data, docs)
        out = np.zeros((len(texts), 2 * len(STEPS) + 1))
        if len(starts):
            margin = self.known.ids(data, starts, lens)[0].astype(np.int64) - 100
            upto = np.searchsorted(starts, docs)
            n = np.diff(upto)
            for k, step in enumerate(STEPS):
                c = np.diff(np.concatenate(([0], np.cumsum(margin >= step)))[upto])
                out[:, 2 * k], out[:, 2 * k + 1] = np.log1p(c), np.sqrt(c / (n + 20)) * 4
            some = n > 0
            out[some, -1] = np.maximum.reduceat(margin, upto[:-1][some]).clip(0, 12) / 4
        return np.hstack([out, self.running.features(data, docs)])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    x = np.c_[np.ones(len(x)), x]
    b, eye = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    eye[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ b).clip(-30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + eye, x.T @ (weight * (y - p)) - eye @ b)
        b += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-7:
            break
    return b


class Model:
    """Fitted on lower-cased UTF-8 texts."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self.rate = len(toxic) / max(1, len(toxic) + len(ordinary))
        self.dicts = self.weights = None
        if min(len(toxic), len(ordinary)) < 2:
            return
        one: dict[bytes, bytes] = {}  # a word once, however often it occurs
        t, o = ([[one.setdefault(w, w) for w in words(x)] for x in texts[::2]] for texts in (toxic, ordinary))
        in_t, in_o = support(t), support(o)
        all_t, all_o, least = sum(in_t.values()), sum(in_o.values()), max(3.0, 0.01 * len(t))
        telling = {g for g, n in in_t.items() if n >= least and n / all_t >= RATIO * (in_o[g] + 1) / max(1, all_o)}
        tells: dict[bytes, bool] = {}
        for own in (*t, *o):
            for w in own:
                if w not in tells:
                    tells[w] = not telling.isdisjoint(grams(w))
        mine = [w for own in t for w in own if tells[w]]
        hard = [w for own in o for w in own if tells[w]]
        rng = np.random.default_rng(3)
        mix = lambda ws, most: [ws[i] for i in rng.permutation(len(ws))[:most]]
        plain = [w for own in o for w in own]
        run = lambda texts: dictionary([x[i : i + SAMPLE] for x in texts for i in range(0, len(x), SAMPLE)], PLAIN_SIZE)
        by_word = dictionary(by_fours(mix(mine, WORDS)), SIZES[0]), dictionary(by_fours(mix(plain, WORDS) + hard * 4), SIZES[1])
        self.dicts = by_word, (run(toxic[::2]), run(ordinary[::2]))
        rest = [*toxic[1::2], *ordinary[1::2]]
        y = np.r_[np.ones(len(toxic[1::2])), np.zeros(len(ordinary[1::2]))]
        x = Meter(*self.dicts).features(rest)
        self.weights = logistic(x, y, np.ones(len(y)))

    def score(self, meter: Meter | None, texts: list[bytes]) -> np.ndarray:
        if meter is None:
            return np.full(len(texts), self.rate)
        z = meter.features(texts) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-z.clip(-40, 40)))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC, ordinary: int = ORDINARY) -> Model:
    """From labelled rows of docs (doc_id, text) and labels (doc_id, toxic) that aren't held out, of that many ids at most."""
    y = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fit_on = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    named = fit_on.select("doc_id").join(y, "doc_id")  # the choice moves ids alone
    take = lambda kind, n: named.where(F.col("toxic") == kind).distinct().orderBy(*order).limit(n)
    chosen = F.broadcast(take(1, toxic).unionByName(take(0, ordinary)))  # that many ids at most
    texts = fit_on.join(chosen, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min(F.coalesce("text", F.lit(""))).alias("text"))
    rows = texts.select("toxic", "doc_id", F.encode(F.lower("text"), "UTF-8").alias("text")).repartition(1).sortWithinPartitions("toxic", *order)  # a row for each chosen id, however often it is repeated

    def each(batches):
        found = pa.Table.from_batches([b.select(["toxic", "text"]) for b in batches], pa.schema([("toxic", pa.int32()), ("text", pa.binary())]))
        by_kind = [found.filter(pc.equal(found["toxic"], kind))["text"].to_pylist() for kind in (1, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(*by_kind))], pa.binary())], ["model"])

    ship(docs.sparkSession)
    made = rows.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(each, "model binary").first()  # the sample is bounded: one task fits, the driver gets four dictionaries and some weights
    return pickle.loads(made["model"]) if made else Model([], [])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


_METERS: dict = {}


def _scorer(shared):
    """texts -> scores, with one meter for each model of a worker."""
    m = shared.value
    if m.dicts and m.dicts not in _METERS:
        _METERS.clear()
        _METERS[m.dicts] = Meter(*m.dicts)
    meter = _METERS.get(m.dicts)
    return lambda column: m.score(meter, [t or b"" for t in column.to_pylist()])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # four dictionaries and a few weights

    def each(batches):
        of = _scorer(shared)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                p = of(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.encode(F.lower("text"), "UTF-8").alias("text"))
    return rows.mapInArrow(each, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows predicted toxic, with all their columns."""
    ship(docs.sparkSession)
    columns = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        of = _scorer(shared)
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays(part.column(0).flatten(), columns).filter(pa.array(of(part.column(1)) < 0.5))

    return docs.select(F.struct("*").alias("row"), F.encode(F.lower("text"), "UTF-8").alias("lower")).mapInArrow(each, docs.schema)
