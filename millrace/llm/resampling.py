"""Importance resampling towards a target: word-id suffix arrays give hashed n-gram counts, whose gains weigh documents.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; features are all runs of 1 to ``LONGEST`` words within a document, joined by a space; a feature's bucket is the crc32 of its UTF-8 modulo
``BUCKETS``.

Suffix arrays. A task takes its texts in blocks of about ``SLICE`` bytes, gives each distinct word of a block a number, and sorts the block's suffixes, as sequences of word numbers, as far as features reach. Neighbours in that
array share a prefix (LCP) of 0 to 3 words: for each n, a run of neighbours with an LCP of n or more is one n-gram with all its places. Each run is hashed once, from its words' checksums (a crc32 of a concatenation
follows from those of its parts), and its bucket is scattered back to the run's places, which gives every document the buckets of its features in turn, two bytes each. They are written once, so the texts are read
and hashed once; what differs from block to block is only how often an n-gram is hashed, not its bucket.

Counts by bucket (``BUCKETS`` of them) are added up in the tasks, then by a grouped sum, and reach the driver; gains go back to the tasks. A document's weight is the sum of its gains, its score adds a Gumbel draw from its
doc_id, and of the documents with ``WORDS`` words or more a share is drawn by score. Ranks come from sums over ranges of the order (``running``): no sort passes through one task.

Nulls: a null text has no words, so weight 0, and counts no features. A null doc_id is kept as null; its draw is that of the seed alone, and it comes last among ties. Repeated rows stay repeated, count in the statistics as often,
and have ranks of their own. Null benchmark texts have no features. An empty table gives an empty result; without target features, all t are 0. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .brown import slices
from .common import LOWER, cut, release, repeated, running, ship

LONGEST, BUCKETS, WORDS, SHARE, SEED = 3, 10_000, 20, (5, 100), "42"
#: Word lengths (bytes) whose checksum shifts are tables; longer ones are shifted in steps.
REACH = 128
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _shifts() -> np.ndarray:
    """[n, k, byte]: what byte k of a checksum becomes when n bytes more follow, but for those bytes' own checksum."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    out = np.zeros((REACH + 1, 4, 256), np.uint32)
    for k in range(4):
        x = (np.arange(256, dtype=np.uint32) << np.uint32(8 * k)).astype(np.uint32)
        for n in range(REACH + 1):
            out[n, k] = x
            x = one[x & 255] ^ (x >> np.uint32(8))
    return out


_SHIFTS = _shifts()


def shifted(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """crc32 of a text becomes, xor the crc32 of n further bytes, that of both: this is the first part."""
    crc, n = crc.copy(), n.copy()
    while True:
        step = np.minimum(n, REACH)
        crc = _SHIFTS[step, 0, crc & 255] ^ _SHIFTS[step, 1, (crc >> np.uint32(8)) & 255] ^ _SHIFTS[step, 2, (crc >> np.uint32(16)) & 255] ^ _SHIFTS[step, 3, crc >> np.uint32(24)]
        n -= step
        if not n.any():
            return crc


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(document number, word number of each word in turn, the distinct words), numbers from 0."""
    data = b"".join(texts).translate(LOWER)
    docs = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    ink = _WORD[np.frombuffer(data, np.uint8)]
    edge = np.zeros(len(ink) + 1, bool)
    edge[docs] = True
    starts = np.flatnonzero(ink & ~(np.append(False, ink[:-1]) & ~edge[:-1]))
    ends = np.flatnonzero(ink & ~(np.append(ink[1:], False) & ~edge[1:])) + 1
    known: dict[bytes, int] = {}
    ids = [known.setdefault(data[s:e], len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
    return np.searchsorted(docs, starts, side="right") - 1, np.array(ids, np.int64), list(known)


def suffix_array(doc: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the order of their suffixes, LCP of each with the one before), both as far as LONGEST words and never past a document's end."""
    after = np.zeros((LONGEST, len(word)), np.int64)  # 0 stands for what lies past the end
    for k in range(LONGEST):
        same = doc[k:] == doc[: len(doc) - k]
        after[k, : len(word) - k] = np.where(same, word[k:] + 1, 0)
    top = int(word.max()) + 2 if len(word) else 1
    if top ** LONGEST < 1 << 62:
        key = after[0]
        for k in range(1, LONGEST):
            key = key * top + after[k]
        order = np.argsort(key, kind="stable")
    else:
        order = np.lexsort(after[::-1])
    lcp, alike = np.zeros(len(word), np.int64), np.ones(max(0, len(word) - 1), bool)
    for k in range(LONGEST):
        mine = after[k, order]
        alike = alike & (mine[1:] == mine[:-1]) & (mine[1:] > 0)
        lcp[1:] += alike
    return order, lcp


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, its words' number by document, buckets [n - 1, place]) of a block; a place without an n-gram has BUCKETS."""
    doc, word, known = words_of(texts)
    size = np.bincount(doc, minlength=len(texts))
    out = np.full((LONGEST, len(word)), BUCKETS, np.int64)
    if not len(word):
        return doc, size, out
    crc = np.fromiter(map(zlib.crc32, known), np.uint32, len(known))
    spaced = np.fromiter((zlib.crc32(b" " + w) for w in known), np.uint32, len(known))
    length = np.fromiter(map(len, known), np.int64, len(known)) + 1
    left = np.cumsum(size)[doc] - np.arange(len(word))  # words from a place to its document's end
    order, lcp = suffix_array(doc, word)
    for n in range(1, LONGEST + 1):
        full = left[order] >= n
        first = np.flatnonzero((lcp < n) & full)  # each begins a run of equal n-grams
        run = np.cumsum((lcp < n) & full) - 1
        at = order[first]
        value = crc[word[at]]
        for k in range(1, n):
            w = word[at + k]
            value = shifted(value, length[w]) ^ spaced[w]
        out[n - 1, order[full]] = (value % BUCKETS)[run[full]]
    return doc, size, out


def hashed(rows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words and the buckets of all features, two bytes each, of rows (..., text)."""
    kinds = {f.name: f.dataType for f in rows.select(*keep).schema.fields}

    def each(batches):
        for b, texts in slices(batches, len(keep)):
            doc, size, found = buckets_of(texts)
            place = np.argsort(np.tile(doc, LONGEST), kind="stable")
            flat = found.ravel()[place]
            there = flat < BUCKETS
            n = np.bincount(np.tile(doc, LONGEST)[place][there], minlength=len(texts))
            data, upto = flat[there].astype("<u2").tobytes(), (2 * np.concatenate(([0], np.cumsum(n)))).tolist()
            made = [pa.array(size.astype(np.int64)), pa.array([data[s:e] for s, e in zip(upto, upto[1:], strict=False)], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(keep))], *made], [*keep, "n_words", "seq"])

    schema = ", ".join([f"`{c}` {kinds[c].simpleString()}" for c in keep] + ["n_words long", "seq binary"])
    return rows.select(*keep, F.encode("text", "UTF-8").alias("text")).mapInArrow(each, schema)


def counts(found: DataFrame) -> np.ndarray:
    """How often each bucket comes in hashed rows."""

    def each(batches):
        seen = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                seen += np.bincount(np.frombuffer(x, "<u2"), minlength=BUCKETS)
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(seen[there])], ["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in found.select("seq").mapInArrow(each, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain, in thousandths: the log of how much likelier it is in the target."""
    s, t = raw.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = SHARE, words: int = WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for every row of docs (doc_id, text); target (text). rank is null where the row isn't drawn."""
    ship(docs.sparkSession)
    found = cut(hashed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"]))
    aimed = cut(hashed(target.select("text"), []))
    gain = gains(counts(found), counts(aimed))
    release(aimed)

    def weigh(batches):
        for b in batches:
            seqs = [np.frombuffer(x, "<u2") for x in b.column(2).to_pylist()]
            n, weight = np.fromiter(map(len, seqs), np.int64, len(seqs)), np.fromiter((int(gain[x].sum()) for x in seqs), np.int64, len(seqs))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    each = found.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    kinds = cut(each.groupBy("doc_id", "n_features", "weight", "score", (F.col("n_words") >= words).alias("fit")).agg(F.count(F.lit(1)).alias("n")))
    release(found)
    many = share[0] * (kinds.where("fit").agg(F.sum("n")).first()[0] or 0) // share[1]
    ranked = running(kinds, [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").desc()], F.col("n"))
    release(kinds)
    place = F.col("before") + F.col("copy") + 1
    return repeated(ranked, "n", "copy").select("doc_id", "n_features", "weight", "score", F.when(F.col("fit") & (place <= many), place).alias("rank"))
